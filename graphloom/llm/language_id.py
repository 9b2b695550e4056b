"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays (operator 7)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches
from .common import held_out

LETTERS = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"
#: Multiplier of the rolling hash over code points, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def padded(word: str, order: int) -> str:
    return BEGIN * (order - 1) + word + END


def rolling(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Entry k - 1: for each position the hash of the k characters that end there, the last with power 0."""
    out, power = [], np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes), np.uint64)
        for k in range(order):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[k:] = codes[: len(codes) - k]
            total = total + shifted * power
            power = power * BASE
            out.append(total.copy())
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted hash array, and which keys are there."""
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Sparse:
    """A sorted hash array; each hash has a run of languages that know it, with a number each. Others have ``fill``."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray], fill: float):
        self.fill = fill
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        who = np.concatenate([np.zeros(0, np.int32), *[np.full(len(k), i, np.int32) for i, k in enumerate(keys)]])
        order = np.lexsort([who, every])
        self.table, first = np.unique(every[order], return_index=True)
        self.starts = np.append(first, len(every))
        self.who, self.values = who[order], np.concatenate([np.zeros(0), *values])[order]

    def rows(self, keys: np.ndarray, width: int) -> np.ndarray:
        """A row for each key with the numbers of all languages."""
        out = np.full((len(keys), width), self.fill)
        at, found = find(self.table, keys)
        own = np.flatnonzero(found)
        first = self.starts[at[own]]
        many = self.starts[at[own] + 1] - first
        cells = np.arange(many.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(own) else np.zeros(0, int)
        out[np.repeat(own, many), self.who[cells]] = self.values[cells]
        return out


class CharModels:
    """One interpolated Kneser-Ney model for each language over the characters of words.

    For every order a sorted array holds the hashes of the grams that any language has, each with the discounted shares of those languages only, and
    another one the hashes of the contexts with their back-off weights. So a character costs two searches an order for all
    languages together, and memory grows with what the languages have, not with their number times all grams.
    """

    def __init__(self, languages: list[str], order: int = 5):
        self.languages, self.order = languages, order
        self.shares: list[Sparse] = []
        self.backoffs: list[Sparse] = []
        self.letters = 0

    def fit(self, counts: dict[str, tuple[list[str], list[int]]]) -> CharModels:
        """``counts``: for each language its grams of the highest order and how often they stand in words."""
        n = self.order
        shares: list[tuple[list, list]] = [([], []) for _ in range(n)]
        backoffs: list[tuple[list, list]] = [([], []) for _ in range(n)]
        for language in self.languages:
            texts, often = counts[language]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
            hashes, power = np.zeros((n, len(codes)), np.uint64), np.uint64(1)
            with np.errstate(over="ignore"):
                total = np.zeros(len(codes), np.uint64)
                for k in range(n):
                    total = total + codes[:, n - 1 - k] * power
                    power = power * BASE
                    hashes[k] = total
            weight = np.array(often, float)
            last = codes[:, -1]
            for k in reversed(range(n)):
                where, back = np.unique(hashes[k] - last, return_inverse=True)
                once, twice = (weight == 1).sum(), (weight == 2).sum()
                discount = once / (once + 2 * twice) if once else 0.5
                whole, kinds = np.bincount(back, weight), np.bincount(back)
                shares[k][0].append(hashes[k])
                shares[k][1].append(np.maximum(weight - discount, 0) / whole[back])
                backoffs[k][0].append(where)
                backoffs[k][1].append(np.maximum(discount * kinds / whole, 1e-9))
                if k:
                    # Below the highest order a gram counts once for each character that stands before it.
                    _, first, before = np.unique(hashes[k - 1], return_index=True, return_counts=True)
                    hashes, last, weight = hashes[:, first], last[first], before.astype(float)
        self.shares = [Sparse(*x, 0.0) for x in shares]
        # A context that a language doesn't know leaves all to the shorter one.
        self.backoffs = [Sparse(*x, 1.0) for x in backoffs]
        self.letters = len(self.shares[0].table)
        return self

    def words(self, words: list[str]) -> np.ndarray:
        """A row for each word: log probability in each language, and the number of characters with the end."""
        n, width = self.order, len(self.languages)
        text = "".join(padded(w, n) for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes = rolling(codes, n)
        asked = np.flatnonzero(codes != ord(BEGIN))
        p = np.full((len(asked), width), 1.0 / (self.letters + 1))
        for k in range(n):
            own = hashes[k][asked]
            p = self.shares[k].rows(own, width) + self.backoffs[k].rows(own - codes[asked], width) * p
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.column_stack([np.add.reduceat(np.log(p), starts, axis=0), sizes])


class Identifier:
    """Models, and what turns cross-entropies into a score: a temperature and the least score that is accepted."""

    #: Numbers of words' rows that are remembered, and that are made at once.
    KEPT, AT_ONCE = 1_500_000, 400_000

    def __init__(self, models: CharModels):
        self.models, self.temperature, self.least = models, 1.0, 0.0
        self._place: dict[str, int] = {}
        self._rows = np.zeros((0, len(models.languages) + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._place, self._rows = {}, np.zeros((0, len(self.models.languages) + 1))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy a character in each language and, last, the number of characters; 0 characters: no letter."""
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        new = list(set().union(*found) - self._place.keys())
        width = self._rows.shape[1]
        if (len(self._place) + len(new)) * width > self.KEPT:
            self._place, self._rows = {}, self._rows[:0]
            new = list(set().union(*found))
        if new:
            start, step = len(self._rows), max(1, self.AT_ONCE // (8 * width))
            self._rows = np.vstack([self._rows, *[self.models.words(new[i : i + step]) for i in range(0, len(new), step)]])
            self._place.update((w, start + i) for i, w in enumerate(new))
        out = np.zeros((len(texts), self._rows.shape[1]))
        for i, words in enumerate(found):
            if words:
                total = self._rows[np.fromiter(map(self._place.__getitem__, words), int, len(words))].sum(axis=0)
                out[i, :-1], out[i, -1] = -total[:-1] / total[-1], total[-1]
        return out

    def posterior(self, entropies: np.ndarray) -> np.ndarray:
        logits = -entropies[:, :-1] * self.temperature
        logits -= logits.max(axis=1, keepdims=True) if logits.size else 0
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def calibrate_rows(self, x: np.ndarray, languages: list[str], errors: float) -> Identifier:
        """Temperature of least log loss, and the least score above which at most ``errors`` of the answers are wrong; ``x`` as by :meth:`entropies`."""
        known = {c: i for i, c in enumerate(self.models.languages)}
        y = np.array([known.get(c, -1) for c in languages])
        x, y = x[(y >= 0) & (x[:, -1] > 0)], y[(y >= 0) & (x[:, -1] > 0)]
        if not len(y):
            return self
        best = np.inf
        for t in (0.5, 1, 2, 4, 8, 16, 32):
            self.temperature, old = float(t), self.temperature
            loss = -np.log(np.maximum(self.posterior(x)[np.arange(len(y)), y], 1e-12)).mean()
            if loss < best:
                best = loss
            else:
                self.temperature = old
        p = self.posterior(x)
        score, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-score, kind="stable")
        wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(wrong <= errors)
        self.least = float(score[order][good[-1]]) if len(good) else 1.0
        return self


def fit(documents: DataFrame, each: int = 1500, calibration: int = 1000, order: int = 5, errors: float = 0.01, few: int = 20) -> Identifier:
    """Models from about ``each`` documents a language and a calibration from about ``calibration`` others in all.

    Both bounds limit the labelled rows that the classifier is fitted on; which rows these are is settled by a hash of the id. A quarter of the ids
    is for calibration, but a language with fewer than ``few`` documents outside it learns from those as well and takes no part in calibration. However many
    languages there are, each is learnt; what comes to the driver is a row for each of them and their grams in the sample.
    """
    small_batches(documents.sparkSession)
    learn = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    sizes = learn.groupBy("lang").agg(F.count(F.when(part != 3, 1)).alias("n"), F.count(F.when(part == 3, 1)).alias("m")).collect()
    rare = {r["lang"] for r in sizes if r["n"] < few}
    models = CharModels([], order)
    share = F.xxhash64(F.lit(3), F.col("doc_id")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    shares = [F.lit(v) for r in sizes for v in (r["lang"], min(1.0, each / (r["n"] + (r["m"] if r["lang"] in rare else 0))))]
    take = F.create_map(*shares) if shares else F.create_map(F.lit(""), F.lit(0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                words = Counter(LETTERS.findall(text.as_py().lower()))
                own = seen.setdefault(lang.as_py(), Counter())
                for word, n in words.items():
                    word = padded(word, order)
                    for i in range(len(word) - order + 1):
                        own[word[i : i + order]] += n
                if len(own) > 300_000:
                    yield from flush({lang.as_py(): seen.pop(lang.as_py())})
        yield from flush(seen)

    def flush(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "gram": pa.array(list(own), pa.string()), "n": pa.array(list(own.values()), pa.int64())})

    own = F.col("lang").isin(sorted(rare))
    sample = learn.where(((part != 3) | own) & (share < F.element_at(take, F.col("lang")))).select("text", "lang")
    grams = sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toPandas()
    by = {c: g for c, g in grams.groupby("lang")} if len(grams) else {}
    models.languages = languages = sorted(by)
    found = Identifier(models.fit({c: (by[c]["gram"].tolist(), by[c]["n"].tolist()) for c in languages}))
    whole = sum(r["m"] for r in sizes if r["lang"] not in rare)
    test = learn.where((part == 3) & ~own & (share < min(1.0, calibration / max(whole, 1)))).select("text", "lang")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = found.entropies(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["lang", "x"])

    if languages:
        rows = test.mapInArrow(measure, "lang string, x array<double>").toPandas()
        x = np.array(rows["x"].tolist(), float).reshape(-1, len(languages) + 1)
        order_ = np.lexsort([*x.T, rows["lang"].to_numpy(str)])  # whatever the order in which tasks end
        found.calibrate_rows(x[order_], rows["lang"].to_numpy()[order_].tolist(), errors)
    return found


def identify(documents: DataFrame, **limits) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row of ``documents``.

    The whole text's lower-cased words are scored, each as a character sequence with its beginning and end. The language of the
    lowest cross-entropy a character is the answer (ties: the first by name), ``score`` its calibrated share, ``accepted``
    whether that share reaches what calibration asks for. Texts that are null or hold no letter get ``und``, score 0, and aren't accepted; so does everything
    if nothing could be learnt. Rows with a null doc_id, lang or text teach nothing. Repeated rows have equal results. An
    empty table gives an empty result.
    """
    found = fit(documents, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = found.entropies(batch.column(0).to_pylist())
            if not found.models.languages:
                names, score = [UNKNOWN] * len(x), np.zeros(len(x))
            else:
                p, some = found.posterior(x), x[:, -1] > 0
                names = [found.models.languages[j] if s else UNKNOWN for j, s in zip(p.argmax(axis=1), some, strict=True)]
                score = np.where(some, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array((score >= found.least) & (score > 0))], names=["doc_id", "lang_pred", "score", "accepted"]
            )

    out = documents.select("text", "doc_id").mapInArrow(run, documents.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
