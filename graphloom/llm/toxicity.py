"""Toxicity by boosted trees over dense features, with isotonic calibration (operator 5)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches, stash
from .common import held_out, labelled_sample
from .trees import BoostedTrees, Isotonic

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!|+", "oieastbasilt")
MIXED = re.compile(r"[^\W\d_][0-9@$!|+*]+[^\W\d_]")
EDGE = "\"'`.,;:!?()[]{}<>|*_-…«»„“”‘’¿¡#&/\\~^=+"
#: Lexicon entries are beginnings of words of these lengths, or whole words that are shorter.
LENGTHS = (3, 4, 5, 6, 8)
NEAR = 3

FEATURES = (
    "hits", "hits_per_word", "distinct_hits", "weight_sum", "weight_per_word", "weight_max", "disguised_hits", "near_second_person", "second_person",
    "capitals", "exclamations", "questions", "punctuation", "digits", "obfuscation", "log_words", "word_length",
)


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in LENGTHS if len(word) >= n] or [word]


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(b, 0.0) for b in beginnings(word)), default=0.0)


def features(text: str | None, lexicon: dict[str, float], starts: frozenset[str]) -> list[float]:
    """Of the whole text; ``starts`` holds the first characters of the lexicon's entries."""
    text = text or ""
    words = text.lower().split()
    n = len(words) or 1
    hits: list[tuple[int, str, float]] = []
    persons = 0
    first = LENGTHS[0]
    for i, word in enumerate(words):
        # A word that begins with a mark is rare, so two lookups settle nearly all words.
        if word[:first] in starts and (w := weight_of(word.strip(EDGE), lexicon)) > 0:
            hits.append((i, word.strip(EDGE)[: LENGTHS[-1]], w))
        elif word[0] in EDGE and (bare := word.strip(EDGE))[:first] in starts and (w := weight_of(bare, lexicon)) > 0:
            hits.append((i, bare[: LENGTHS[-1]], w))
        if word in SECOND_PERSON:
            persons += 1
    mixed = disguised = 0
    if MIXED.search(text):
        for word in words:
            if MIXED.search(word):
                mixed += 1
                disguised += weight_of(word.strip(EDGE).translate(DISGUISE), lexicon) > 0
    near = sum(any(x in SECOND_PERSON for x in words[max(0, i - NEAR) : i + NEAR + 1]) for i, _, _ in hits)
    marks = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(int(marks.sum()), 1)
    punctuation = int(marks[33:48].sum() + marks[58:65].sum() + marks[91:97].sum() + marks[123:127].sum())
    weights = [w for _, _, w in hits]
    return [
        len(hits), len(hits) / n, len({b for _, b, _ in hits}), sum(weights), sum(weights) / n, max(weights, default=0.0), disguised, near / n, persons / n,
        int(marks[65:91].sum()) / size, marks[33] / n, marks[63] / n, punctuation / size, int(marks[48:58].sum()) / size, mixed / n, math.log1p(len(words)), size / n,
    ]


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, curve: Isotonic):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve
        self.starts = frozenset(x[: LENGTHS[0]] for x in lexicon)

    def matrix(self, texts: Iterator[str | None]) -> np.ndarray:
        return np.array([features(t, self.lexicon, self.starts) for t in texts], dtype=float).reshape(-1, len(FEATURES))

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        x = self.matrix(texts)
        return np.clip(self.curve(self.trees.margin(x)), 0.0, 1.0) if len(x) else np.zeros(0)


def _lexicon(sample: DataFrame, odds: float) -> dict[str, float]:
    """Beginnings of words that stand in toxic texts far more often than chance has it, with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad, texts, toxic = Counter(), Counter(), 0, 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = {w.strip(EDGE) for w in (text.as_py() or "").lower().split()}
                terms = {b for w in words if w and not w[0].isdigit() for b in beginnings(w)}
                seen.update(terms)
                texts += 1
                if label.as_py():
                    bad.update(terms)
                    toxic += 1
            if len(seen) > 200_000:
                yield flush(seen, bad)
                seen, bad = Counter(), Counter()
        yield flush(seen, bad)
        yield pa.RecordBatch.from_pydict({"term": pa.array(["\n"], pa.string()), "n": pa.array([texts], pa.int64()), "bad": pa.array([toxic], pa.int64())})

    def flush(seen: Counter, bad: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64()), "bad": pa.array([bad[t] for t in seen], pa.int64())})

    counts = sample.where("part <> 4").select("text", "label").mapInArrow(count, "term string, n bigint, bad bigint")
    counts = stash(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    whole = counts.where("term = '\n'").first()
    if whole is None or not whole["bad"] or whole["bad"] == whole["n"]:
        return {}
    rate = whole["bad"] / whole["n"]
    log_odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - math.log(rate / (1 - rate))
    spread = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    # Chance must be ruled out over about a million terms: four standard
    # deviations and several toxic texts.
    best = counts.where(F.col("term") != "\n").select("term", "bad", log_odds.alias("odds"), spread.alias("z")).where((F.col("odds") >= odds) & (F.col("z") >= 5.0) & (F.col("bad") >= 4))
    return {r["term"]: float(r["odds"]) for r in best.orderBy("term").collect()}


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000, odds: float = 2.0) -> ToxicityModel:
    """Lexicon and trees from three parts of the labelled sample, the calibration curve from a fourth.

    ``rows`` bounds the sample of labelled rows that the classifier is fitted on; the lexicon has all terms that pass the test of significance on it.
    """
    small_batches(documents.sparkSession)
    # Written once, so that the documents are read once for all that is learnt.
    sample = stash(labelled_sample(documents, labels, "toxic", rows))
    lexicon = _lexicon(sample, odds)
    model = ToxicityModel(lexicon, BoostedTrees(prior=0.1), Isotonic())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.matrix(v.as_py() for v in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "part"])

    # At most ``rows`` rows of a few numbers each come to the driver.
    found = sample.mapInArrow(measure, "x array<double>, label int, part bigint").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y, part = found["label"].to_numpy(float), found["part"].to_numpy(int)
    order = np.lexsort([*x.T, y, part])  # whatever the order in which tasks end
    x, y, part = x[order], y[order], part[order]
    model.trees.fit(x[part != 4], y[part != 4])
    model.curve.fit(model.trees.margin(x[part == 4]), y[part == 4])
    return model


def scores(documents: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` as ``c0, c1`` and so on (whatever their names), and ``score``; a text crosses to Python once, and back only if it is kept."""
    back = [c != "text" for c in keep]
    held = documents.select("text", *[F.col(f"`{c}`") for c in keep if c != "text"]).toDF("_text", *[f"c{i}" for i, c in enumerate(keep) if back[i]])
    held = held.select("_text", *[c for c in held.columns if c != "_text"])
    places = [0 if c == "text" else sum(back[:i]) + 1 for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(v.as_py() for v in batch.column(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(p) for p in places], pa.array(found, pa.float64())], names=names)

    small_batches(documents.sparkSession)
    kinds = held.select(*[F.col("_text" if c == "text" else f"c{i}").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0.0).alias("score")).schema
    names = kinds.names
    return held.mapInArrow(run, kinds)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``; scores depend on the text alone.

    Null and empty texts are scored like a text without words. Rows with a null doc_id are scored, not learnt from; a null
    label isn't a label; of several labels of one id the greatest holds. Without labels, or with one kind only, the score is their smoothed
    rate (without any 0.1). Repeated rows have equal scores. An empty table gives an empty result.
    """
    model = fit(documents, labels, **limits)
    out = scores(documents, model, ["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), held_out(F.col("c0"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:
    """The rows of ``documents``, all columns as they were, whose score stays below ``threshold``."""
    found = scores(documents, fit(documents, labels, **limits), documents.columns)
    return found.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])
