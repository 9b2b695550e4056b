"""SentencePiece encoding and decoding by a parallel max-plus scan (operator 3).

The models at hand are byte-pair models: a merge order, not a sum of scores, decides. Still there is a path whose weight is
the greatest. A token sequence is the model's answer exactly if every token survives its own merges and every two
neighbours do (merging both together gives the two again): the first merge across a border would already happen among the two
tokens beside it. So give each pair of neighbours the weight 0 if it survives and minus infinity if not; the
answer is the one path of weight 0, and max-plus algebra over "the token that crosses this border" composes: a chunk
of a giant document is a matrix from the states at its beginning to those at its end, products of such matrices are
associative, and once the state at each border is known, every chunk finds its own tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches, stash
from .common import row_key

SPACE = "▁"
State = tuple[int, int]
#: Stands before the first token of a walk; longer than a character and no piece, so no token of a text looks like it.
BEGINS = "\x00begin\x00"
#: The state before a text: no token has begun.
START: State = (0, 0)


#: Matrices that are multiplied in one task at a time; also the width of the tree of products.
WIDE = 64


class Memo(dict):
    """Remembers what ``make`` gives, for up to ``most`` short keys; then it begins anew."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class Pieces:
    """A model's vocabulary, read with its library from the bytes of the model file; merging, scanning and decoding are our own."""

    #: Words, and pairs of tokens, that are remembered.
    KEPT = 150_000

    def __init__(self, model: bytes):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        if not loaded.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("only models that put a space before a text are read")
        self.library = loaded
        n = loaded.get_piece_size()
        self.names = [loaded.id_to_piece(i) for i in range(n)]
        special = [loaded.is_byte(i) or loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = {p: loaded.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(self.names) if loaded.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = loaded.unk_id()
        self.longest = max(map(len, self.ids))
        #: No piece goes on with a space, so no merge crosses from a word to the spaces behind it.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self._word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._pairs = Memo(self._survives, self.KEPT, 2)
        self._merged = Memo(lambda w: self.numbers(self.merge(w)), 2 * self.KEPT, 40)
    
    def merge(self, text: str) -> list[str]:
        """Tokens of ``text``: neighbours whose join is a piece merge, highest score first, leftmost of equals first."""
        n = len(text)
        token, left, right = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        scores = self.scores
        heap = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := text[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            # Stale unless both sides are still what they were.
            if not token[a] or not token[b] or right[a] != b or token[a] + token[b] != joined:
                continue
            token[a], token[b] = joined, ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
                if (p := joined + token[right[a]]) in scores:
                    heapq.heappush(heap, (-scores[p], a, right[a], p))
            if left[a] >= 0 and (p := token[left[a]] + joined) in scores:
                heapq.heappush(heap, (-scores[p], left[a], a, p))
        return [t for t in token if t]

    def numbers(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in t.encode()]
            else:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """``text`` cut where no piece crosses, between a character and the space behind it: a word with the spaces before it."""
        return self._word.findall(text) if self.cuts else [text] if text else []

    def encode(self, text: str) -> np.ndarray:
        """Ids of text whose spaces are already :data:`SPACE` and that begins with one, by merging each word."""
        return np.fromiter(chain.from_iterable(map(self._merged.__getitem__, self.words(text))), np.int32)

    def survive(self, a: str, b: str) -> bool:
        """Whether tokens ``a`` and ``b`` may stand side by side: the weight 0 of a step, or minus infinity."""
        return self._pairs[a, b]

    def _survives(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        return self.merge(a + b) == ([a, b] if a else [b])

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")

    # A chunk of a giant text: ``text[low:high]`` with at least ``longest`` characters (or all there are) on both sides.

    def states(self, text: str, border: int) -> list[State]:
        """All tokens that may cross or end at ``border``, as characters before and behind it; both chunks there list the same."""
        if border == 0:
            return [START]
        return [
            (a, b)
            for a in range(1, min(self.longest, border) + 1)
            for b in range(min(self.longest - a, len(text) - border) + 1)
            if a + b == 1 or text[border - a : border + b] in self.ids
        ]

    def _walk(self, text: str, begin: list[tuple[int, str, int]], high: int) -> dict[int, dict[str, dict[str, int]]]:
        """Max-plus products step by step: for each place and token that ends there, the tokens before it with the set of beginnings
        (bits) from which a path of weight 0 comes. ``begin`` has place, token and bit."""
        at: dict[int, dict[str, dict[str, int]]] = {}
        for place, token, bit in begin:
            own = at.setdefault(place, {}).setdefault(token, {})
            own[BEGINS] = own.get(BEGINS, 0) | bit
        first = min(p for p, _, _ in begin)
        for place in range(first + 1, high + 1):
            for n in range(1, min(self.longest, place - first) + 1):
                before = at.get(place - n)
                if before is None:
                    continue
                token = text[place - n : place]
                if n > 1 and token not in self.ids:
                    continue
                for last, ways in before.items():
                    if self.survive(last, token):
                        bits = 0
                        for b in ways.values():
                            bits |= b
                        own = at.setdefault(place, {}).setdefault(token, {})
                        own[last] = own.get(last, 0) | bits
        return at

    def _back(self, at: dict, place: int, token: str, bit: int) -> list[str]:
        """Tokens of the path to ``token`` at ``place`` from the beginning ``bit``, without the one it began with."""
        out = []
        while True:
            last = next(t for t, bits in at[place][token].items() if bits & bit)
            if last == BEGINS:
                return out[::-1]
            out.append(token)
            place, token = place - len(token), last

    def _inner(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last cut in the chunk: between them stand whole words."""
        if not self.cuts:
            return None
        found = [m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", text[max(low - 1, 0) : high])]
        found = [c + max(low - 1, 0) for c in found]
        found = [c for c in found if low < c < high]
        return (found[0], found[-1]) if found else None

    def _exits(self, text: str, at: dict, high: int, last: bool) -> dict[State, int]:
        """Beginnings from which each state at the end is reached."""
        out: dict[State, int] = {}
        for a, b in [(0, 0)] if last else self.states(text, high):
            if last:
                for ways in at.get(high, {}).values():
                    for bits in ways.values():
                        out[START] = out.get(START, 0) | bits
                continue
            token = text[high - a : high + b]
            for before, ways in at.get(high - a, {}).items():
                if self.survive(before, token):
                    for bits in ways.values():
                        out[(a, b)] = out.get((a, b), 0) | bits
        # A token from before the chunk may end right here or reach beyond it only if chunks were shorter than tokens; they aren't.
        return out

    def _begin(self, text: str, low: int) -> tuple[list[State], list[tuple[int, str, int]]]:
        entries = self.states(text, low)
        return entries, [(low + b, text[low - a : low + b], 1 << i) for i, (a, b) in enumerate(entries)]

    def transfer(self, text: str, low: int, high: int, last: bool) -> list[tuple[State, State]]:
        """The pairs of states at both ends of the chunk between which a path of weight 0 leads: the finite entries of its matrix.

        Nothing crosses a cut, so the chunk's matrix is the product of the part before its first cut, a matrix of one entry for each word
        between two cuts, and the part behind its last cut. A word's entry is the weight of its best path, and that is 0: the tokens by merging are such
        a path. So only the ends are walked here, and the words' paths are found when the chunk is traced back.
        """
        entries, begin = self._begin(text, low)
        inner = self._inner(text, low, high)
        if inner is None:
            exits = self._exits(text, self._walk(text, begin, high), high, last)
        else:
            head = self._walk(text, begin, inner[0])
            alive = 0
            for ways in head.get(inner[0], {}).values():
                for bits in ways.values():
                    alive |= bits
            tail = self._exits(text, self._walk(text, [(inner[1], "", 1)], high), high, last)
            exits = {s: alive for s in tail}
        return [(e, s) for s, bits in exits.items() for i, e in enumerate(entries) if bits >> i & 1]

    def backtrace(self, text: str, low: int, high: int, last: bool, entry: State, leave: State) -> list[int]:
        """Ids of the tokens that begin in the chunk, given the states at its ends."""
        entries, begin = self._begin(text, low)
        bit = 1 << entries.index(entry)
        inner = self._inner(text, low, high)
        crossing = [] if last else [text[high - leave[0] : high + leave[1]]]
        end = high - leave[0] if not last else high

        def path(at: dict, place: int, bit: int, then: list[str]) -> list[str]:
            for token, ways in at.get(place, {}).items():
                if any(b & bit for b in ways.values()) and (not then or self.survive(token, then[0])):
                    return self._back(at, place, token, bit)
            raise ValueError("states that don't meet")

        if inner is None:
            return self.numbers(path(self._walk(text, begin, end), end, bit, crossing) + crossing)
        head = path(self._walk(text, begin, inner[0]), inner[0], bit, [])
        tail = path(self._walk(text, [(inner[1], "", 1)], end), end, 1, crossing)
        return [*self.numbers(head), *self.encode(text[inner[0] : inner[1]]).tolist(), *self.numbers(tail + crossing)]


def combine(a: dict[State, set[State]], b: dict[State, set[State]]) -> dict[State, set[State]]:
    """Product of two transfer matrices, which keep their finite entries: associative."""
    out = {}
    for start, middle in a.items():
        ends = set().union(*(b.get(m, ()) for m in middle))
        if ends:
            out[start] = ends
    return out


def border_states(matrices: list[dict[State, set[State]]], entry: State = START, leave: State = START) -> list[State]:
    """The state at every border (one more than matrices) on the one path of weight 0 from ``entry`` to ``leave``."""
    reach: list[set[State]] = [set() for _ in matrices] + [{leave}]
    for i in reversed(range(len(matrices))):
        reach[i] = set(combine(matrices[i], {s: {leave} for s in reach[i + 1]}))
    out = [entry]
    for i, m in enumerate(matrices):
        nxt = m[out[-1]] & reach[i + 1]
        if len(nxt) != 1:
            raise ValueError(f"{len(nxt)} paths of weight 0")
        out.append(nxt.pop())
    return out


def _packed(matrix: dict[State, set[State]]) -> list[dict[str, int]]:
    return [{"a": e[0], "b": e[1], "c": s[0], "d": s[1]} for e, ends in matrix.items() for s in ends]


def _unpacked(cells: list[dict[str, int]]) -> dict[State, set[State]]:
    own: dict[State, set[State]] = {}
    for c in cells:
        own.setdefault((c["a"], c["b"]), set()).add((c["c"], c["d"]))
    return own


_LOADED: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model's pieces, once in each worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


STATE, CELLS = "struct<a:int,b:int>", "array<struct<a:int,b:int,c:int,d:int>>"
_STATE = pa.struct([(k, pa.int32()) for k in "ab"])
_CELLS = pa.list_(pa.struct([(k, pa.int32()) for k in "abcd"]))


def border_scan(cells: DataFrame) -> DataFrame:
    """``_s1, _s2, _no, entry, leave`` for each chunk, from ``_k1, _k2, no, cells``, the matrices of all chunks of all documents.

    A tree of products: :data:`WIDE` neighbours become one matrix until each document has one. Then from the root down, the states at both ends of a
    product give those between its factors. Each step is one shuffle by document and place, and a task never sees more than WIDE
    matrices of a document together.
    """

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_packed(reduce(combine, (_unpacked(m["cells"]) for m in r))) for r in batch.column("matrices").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), batch.column("_group"), pa.array(found, _CELLS)], names=["_k1", "_k2", "no", "cells"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ends = [(r[k]["a"], r[k]["b"]) for k in ("entry", "leave")]
                states = [{"a": a, "b": b} for a, b in border_states([_unpacked(m["cells"]) for m in r["matrices"]], *ends)]
                rows += [(r["_k1"], r["_k2"], m["no"], *s) for m, *s in zip(r["matrices"], states, states[1:], strict=False)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), _STATE, _STATE]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_s1", "_s2", "_no", "entry", "leave"])

    levels, top = [], cells.agg(F.coalesce(F.max("no"), F.lit(0))).first()[0]
    while True:
        grouped = cells.groupBy("_k1", "_k2", F.expr(f"no div {WIDE}").cast("int").alias("_group")).agg(F.array_sort(F.collect_list(F.struct("no", "cells"))).alias("matrices"))
        levels.append(stash(grouped))
        top //= WIDE
        if not top:
            break
        cells = levels[-1].mapInArrow(product, f"_k1 bigint, _k2 bigint, no int, cells {CELLS}")
    whole = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    found = levels.pop().withColumns({"entry": whole, "leave": whole})
    kind = f"_s1 bigint, _s2 bigint, _no int, entry {STATE}, leave {STATE}"
    while levels:
        states = found.mapInArrow(between, kind)
        found = levels.pop().join(states, (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2")) & (F.col("_group") == F.col("_no"))).select("_k1", "_k2", "matrices", "entry", "leave")
    return found.mapInArrow(between, kind)


def encode(documents: DataFrame, model_file: str, chunk: int = 32_768) -> DataFrame:
    """``doc_id, ids, n_tokens, exact`` for every row of ``documents``: the ids that the model gives for the whole text.

    ``exact`` tells whether decoding the ids gives the text back; a text that holds U+2581 itself decodes to spaces. Texts longer than
    ``chunk`` characters are encoded in chunks by different tasks. Null and empty texts have no tokens and are exact (null decodes to null); a
    null doc_id stays null; repeated rows have equal results. An empty table gives an empty result. The model is read by the driver and
    sent along (half a megabyte); columns other than ``doc_id`` and ``text`` are not read.
    """
    with open(model_file, "rb") as f:
        model = f.read()
    spark = documents.sparkSession
    small_batches(spark)
    # No chunk may be shorter than two of the longest tokens.
    chunk = max(chunk, 64)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that fit into one chunk."""
        pieces = loaded(model)
        for batch in batches:
            ids, exact, ends = [], [], np.zeros(batch.num_rows + 1, np.int32)
            for i, value in enumerate(batch.column(0)):
                text = value.as_py() or ""
                # The library merges as our own code does, three times as fast where most words are new. It gives no tokens to blanks alone.
                own = pieces.library.encode(text) if text.strip(" ") else pieces.encode(SPACE + text.replace(" ", SPACE)).tolist() if text else []
                ids.append(np.array(own, np.int32))
                exact.append(pieces.library.decode(own) == text)
                ends[i + 1] = ends[i] + len(ids[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "exact"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of giant texts with what surrounds them, a few at a time."""
        pieces = loaded(model)
        names = ["doc_id", "_k1", "_k2", "no", "last", "low", "high", "part"]
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for i, value in enumerate(batch.column(0)):
                full = SPACE + value.as_py().replace(" ", SPACE)
                # The last chunk isn't shorter than the longest token.
                starts, rows = list(range(0, len(full) - pieces.longest, chunk)), []
                for no, low in enumerate(starts):
                    high = starts[no + 1] if no + 1 < len(starts) else len(full)
                    side = max(0, low - pieces.longest)
                    rows.append((no, no + 1 == len(starts), low - side, high - side, full[side : high + pieces.longest]))
                for a in range(0, len(rows), 50):
                    part = rows[a : a + 50]
                    keys = [batch.column(k).slice(i, 1).take(pa.array([0] * len(part))) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]], names=names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            rows = batch.to_pylist()
            flat = []
            for r in batch.to_pylist():
                own: dict[State, set[State]] = {}
                for entry, leave in pieces.transfer(r["part"], r["low"], r["high"], r["last"]):
                    own.setdefault(entry, set()).add(leave)
                flat.append(_packed(own))
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), batch.column("no"), pa.array(flat, _CELLS)], names=["_k1", "_k2", "no", "cells"])

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            ids, exact = [], []
            for r in batch.to_pylist():
                got = pieces.backtrace(r["part"], r["low"], r["high"], r["last"], (r["entry"]["a"], r["entry"]["b"]), (r["leave"]["a"], r["leave"]["b"]))
                ids.append(got)
                # What this chunk's tokens spell: from where the entering token ends to where the leaving one does.
                spelt = r["part"][r["low"] + r["entry"]["b"] : r["high"] + (0 if r["last"] else r["leave"]["b"])]
                exact.append(pieces.decode([pieces.ids.get(SPACE, pieces.unknown), *got]) == spelt.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k1"), batch.column("_k2"), batch.column("no"), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], names=["_k1", "_k2", "no", "ids", "exact"]
            )

    # Texts that fit into a chunk go straight to the result; only what surrounds giant ones is written in between.
    keyed = documents.select("text", "doc_id", *row_key("doc_id", "text"))
    giant = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk
    kind = keyed.select("doc_id").schema.simpleString()[7:-1]
    small = keyed.where(~giant).select("text", "doc_id").mapInArrow(whole, f"{kind}, ids array<int>, exact boolean")
    done = stash(keyed.where(giant).mapInArrow(cut, f"{kind}, _k1 bigint, _k2 bigint, no int, last boolean, low int, high int, part string"))
    # A document that is there several times has its chunks encoded once.
    chunks = done.select("_k1", "_k2", "no", "last", "low", "high", "part").dropDuplicates(["_k1", "_k2", "no"])
    chunks = stash(chunks)
    # A few dozen cells for each chunk meet by document, not its text.
    states = border_scan(stash(chunks.mapInArrow(second, f"_k1 bigint, _k2 bigint, no int, cells {CELLS}")))
    ready = chunks.join(states, (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2")) & (F.col("no") == F.col("_no")))
    coded = ready.select("_k1", "_k2", "no", "last", "low", "high", "part", "entry", "leave").mapInArrow(fourth, "_k1 bigint, _k2 bigint, no int, ids array<int>, exact boolean")
    joined = coded.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("_parts"), F.every("exact").alias("exact"))
    joined = joined.select(F.col("_k1").alias("_s1"), F.col("_k2").alias("_s2"), F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"), "exact")
    giants = done.where("no = 0").select("doc_id", "_k1", "_k2")
    giants = giants.join(joined, (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2"))).select("doc_id", "ids", "exact")
    out = small.unionByName(giants)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    with open(model_file, "rb") as f:
        model = f.read()
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            texts = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.select("doc_id", F.lit("").alias("text")).schema
    return encoded.select("ids", "doc_id").mapInArrow(run, kind)
