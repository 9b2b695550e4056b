"""Removal of repeated passages by a distributed merge sort of suffixes (operator 11).

A byte goes if a string of ``window`` bytes that covers it starts anywhere else as well. Each such string holds an anchor: the least
hash among its grams. Equal strings hold equal anchors, so only suffixes at anchors whose hash is met twice can matter. They are sorted with the bytes before
them, each task's as a run; the runs are exchanged front-coded (only what a suffix doesn't share with the one before it) by ranges of suffixes, and
each range merges its runs by a loser tree that compares no byte twice. Neighbours in that order tell how far two places agree to the right, an order of
what stands before them how far to the left; where both add up to ``window`` or more, the bytes between are repeated.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_stash, partitions, shared_root, small_batches, stash

WINDOW = 200
#: Bytes of a text whose anchors are found at once; a window's place in a piece takes 20 bits.
PIECE = 1 << 18
#: Anchors, and suffixes, that a task gathers before it sorts them.
FLUSH, RUN = 500_000, 150_000
#: Suffixes that a range of the merge gets at about.
RANGE = 100_000
#: Suffixes of which the ranges are chosen.
SAMPLE = 8_192
#: Bytes of UTF-8 end at 0xF4: all go up by one, and 0 ends a suffix at the end of its text.
_SHIFT = bytes(min(255, b + 1) for b in range(256))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def reach(window: int) -> int:
    """How far an anchor may stand behind the start of its window: 2^j - 1, so that it can be halved, about two thirds of the window at most."""
    return (1 << max(0, (window * 2 // 3).bit_length() - 1)) - 1


def gram_hashes(source: np.ndarray, size: int) -> np.ndarray:
    """A hash of each gram of ``size`` bytes, from those of half the size. Different grams with one hash only cost time."""
    base = np.uint64(0x9E3779B97F4A7C15)
    part = (source.astype(np.uint64) + np.uint64(1)) * _MIX
    found, done, length = None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                found = part if found is None else found[: len(part) - done] * base + part[done : done + len(found)]
                done += length
            if length * 2 > size:
                break
            part = part[:-length] * base + part[length:]
            base, length = base * base + np.uint64(2), length * 2
        found = found[: len(source) - size + 1]
        found = (found ^ (found >> np.uint64(31))) * _MIX
    return found ^ (found >> np.uint64(29))


def anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows: of the grams that begin in a window's first bytes the one with the least hash, the first of equals."""
    far = reach(window)
    places, hashes = [], []
    source = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(text) - window + 1, PIECE):
        h = gram_hashes(source[at : at + PIECE + window - 1], window - far)
        least = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step <= far:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        chosen = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, found = np.concatenate(places), np.concatenate(hashes)
    once = np.concatenate([[True], place[1:] != place[:-1]])
    return place[once], found[once]


_ANCHORS = "part int, hash binary, row binary, place binary"


def _anchor_rows(window: int, parts: int) -> Callable:
    """Anchors by parts of the hashes. Of those that a task meets again itself, which are known to recur, one goes out without a place, and all places
    go without a hash."""

    def given(part: int, hashes: np.ndarray | None, rows: np.ndarray, places: np.ndarray) -> tuple:
        return part, None if hashes is None else hashes.tobytes(), rows.tobytes(), places.tobytes()

    def flush(rows: list[np.ndarray], places: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        row, place, h = row[order], place[order], h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        many = ~(first & np.concatenate([first[1:], [True]]))
        out = []
        sent = np.flatnonzero(first)
        part = (h[sent] % np.uint64(parts)).astype(np.int64)
        which, begin = np.unique(np.sort(part), return_index=True)
        for p, i in zip(which.tolist(), np.split(sent[np.argsort(part, kind="stable")], begin[1:]), strict=True):
            out.append(given(p, h[i], np.where(many[i], -1, row[i]), place[i]))
        known = np.flatnonzero(many)
        known = known[np.lexsort((place[known], row[known]))]
        for i in np.array_split(known, max(1, min(parts, len(known) // 10_000))):
            if len(i):
                out.append(given(int(row[i[0]] * 31 + place[i[0]]) % parts, None, row[i], place[i]))
        for i in range(0, len(out), 64):
            yield _batch(out[i : i + 64], _ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, places, hashes, held = [], [], [], 0
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place, h = anchors(text.as_py(), window)
                if len(place):
                    rows.append(np.full(len(place), number, dtype=np.int64))
                    places.append(place)
                    hashes.append(h)
                    held += len(place)
                if held >= FLUSH:
                    yield from flush(rows, places, hashes)
                    rows, places, hashes, held = [], [], [], 0
        if held:
            yield from flush(rows, places, hashes)

    return run


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    names, types = zip(*(x.split(" ") for x in kind.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=_KINDS[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _recurring(table: pa.Table) -> pa.Table:
    """Places of the anchors of a part whose hash came more than once, and the places that were known before."""
    hashes, rows, places, out = [], [], [], []
    for h, row, place in zip(*(table.column(c).to_pylist() for c in ("hash", "row", "place")), strict=True):
        row, place = np.frombuffer(row, dtype=np.int64), np.frombuffer(place, dtype=np.int64)
        if h is None:
            out.append((row, place))
        else:
            hashes.append(np.frombuffer(h, dtype=np.uint64))
            rows.append(row)
            places.append(place)
    if hashes:
        h, row, place = np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        h, row, place = h[order], row[order], place[order]
        same = h[1:] == h[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out.append((row[again & (row >= 0)], place[again & (row >= 0)]))
    return pa.table({"_row": np.concatenate([r for r, _ in out]), "place": np.concatenate([p for _, p in out])})


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that ``a`` and ``b`` begin with in common; that many are ``known`` to be."""
    n = min(len(a), len(b)) - known
    apart = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (apart.bit_length() + 7) // 8


def suffix_at(text: bytes, place: int, far: int, window: int) -> bytes | None:
    """What is sorted: the suffix at ``place`` as far as a window reaches, a 0, and backwards the ``far`` bytes before it; None if no window fits. ``text`` is shifted."""
    right = text[place : place + window]
    left = text[max(0, place - far) : place]
    return None if len(right) < window - far or len(right) + len(left) < window else right + b"\0" + left[::-1]


_BLOCK = "part int, shared binary, length binary, tails binary, row binary, place binary"


def _coded(part: int, keys: list[bytes], found: dict[bytes, tuple[int, int]]) -> tuple:
    """A run's suffixes of one range, front-coded; row -1 stands for one that the run has more than once."""
    common = [0, *(shared(a, b) for a, b in zip(keys, keys[1:], strict=False))]
    tails = [k[n:] for k, n in zip(keys, common, strict=True)]
    rows, places = (np.array([found[k][i] for k in keys], dtype=np.int64) for i in (0, 1))
    return part, np.array(common, dtype=np.int16).tobytes(), np.array([len(t) for t in tails], dtype=np.int16).tobytes(), b"".join(tails), rows.tobytes(), places.tobytes()


def _merged_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for row, start, end in sorted(spans):
        if out and out[-1][0] == row and start <= out[-1][2]:
            out[-1] = (row, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((row, start, end))
    return out


def _whole(key: bytes, row: int, place: int) -> tuple[int, int, int]:
    """All that the windows of a suffix cover."""
    right = key.index(0)
    return row, place - (len(key) - right - 1), place + right


class _Run:
    """The suffixes that a task gathers; flushed as front-coded blocks, one for each range, and the spans known already."""

    def __init__(self, splits: list[bytes]):
        self.splits, self.found, self.spans = splits, {}, []

    @property
    def full(self) -> bool:
        return len(self.found) + len(self.spans) >= RUN

    def add(self, key: bytes, row: int, place: int) -> None:
        before = self.found.get(key)
        if before is None:
            self.found[key] = (row, place)
            return
        if before == (row, place):
            # Halves of two suffixes of a text can be one.
            return
        # Suffixes that agree in all their bytes repeat each other wholly.
        self.spans += [_whole(key, r, p) for r, p in (before, (row, place)) if r >= 0]
        self.found[key] = (-1, 0)

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, out, at = sorted(self.found), [], 0
        for part in range(len(self.splits) + 1):
            end = bisect_left(keys, self.splits[part], at) if part < len(self.splits) else len(keys)
            if end > at:
                out.append(_coded(part, keys[at:end], self.found))
            at = end
        spans = np.array(_merged_spans(self.spans), dtype=np.int64).reshape(-1, 3)
        for i in np.array_split(spans, max(1, min(len(self.splits) + 1, len(spans) // 10_000))):
            if len(i):
                out.append((int(i[0, 0] * 31 + i[0, 1]) % (len(self.splits) + 1), None, i[:, 1].tobytes(), b"", i[:, 0].tobytes(), i[:, 2].tobytes()))
        self.found, self.spans = {}, []
        for i in range(0, len(out), 32):
            yield _batch(out[i : i + 32], _BLOCK)


def _runs_of_texts(window: int, splits: list[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, far = _Run(splits), reach(window)
        for batch in batches:
            for row, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                plain = text.as_py().translate(_SHIFT)
                for place in np.unique(places.values.to_numpy()).tolist():
                    key = suffix_at(plain, place, far, window)
                    if key is not None:
                        held.add(key, row, place)
                    if held.full:
                        yield from held.flush()
        yield from held.flush()

    return run


def _runs_of_keys(splits: list[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Run(splits)
        for batch in batches:
            for key, row, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.add(key, row, place)
                if held.full:
                    yield from held.flush()
        yield from held.flush()

    return run


class _Reader:
    """A front-coded block, suffix by suffix: each knows what it shares with the one before."""

    def __init__(self, common: bytes, lengths: bytes, tails: bytes, rows: bytes, places: bytes):
        self.common = np.frombuffer(common, dtype=np.int16).tolist()
        self.ends = np.cumsum(np.frombuffer(lengths, dtype=np.int16), dtype=np.int64).tolist()
        self.tails = tails
        self.rows, self.places = (np.frombuffer(x, dtype=np.int64).tolist() for x in (rows, places))
        self.at, self.key = -1, b""

    def advance(self) -> int:
        """What the next suffix shares with the last one; -1 if there is none."""
        self.at += 1
        if self.at >= len(self.ends):
            return -1
        n = self.common[self.at]
        self.key = self.key[:n] + self.tails[self.ends[self.at - 1] if self.at else 0 : self.ends[self.at]]
        return n


def merge(readers: list[_Reader]) -> Iterator[tuple[bytes, int, int, int]]:
    """All suffixes in order: ``key, row, place`` and what it shares with the one before.

    A tree of losers in which each loser knows how much it shares with the last suffix that came out. Whoever shares more is smaller; only equals
    are compared, from there on.
    """
    n = 1 << max(0, len(readers) - 1).bit_length()
    heads = [r.advance() for r in readers] + [-1] * (n - len(readers))
    # How much each run's head shares with what came out last; nothing came out yet.
    heads = [min(h, 0) for h in heads]
    losers = [0] * n

    def play(node: int) -> int:
        if node >= n:
            return node - n
        a, b = play(2 * node), play(2 * node + 1)
        winner, loser = contest(a, b)
        losers[node] = loser
        return winner

    def contest(a: int, b: int) -> tuple[int, int]:
        ha, hb = heads[a], heads[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = readers[a].key, readers[b].key
        same = shared(x, y, ha)
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            heads[b] = same
            return a, b
        heads[a] = same
        return b, a

    winner = play(1)
    while heads[winner] >= 0:
        reader = readers[winner]
        yield reader.key, reader.rows[reader.at], reader.places[reader.at], heads[winner]
        heads[winner] = reader.advance()
        node = (winner + n) >> 1
        while node:
            rival = losers[node]
            ha, hb = heads[winner], heads[rival]
            if ha < hb or (ha == hb and ha >= 0 and contest(winner, rival)[0] == rival):
                losers[node], winner = winner, rival
            node >>= 1


def longest(keys: list[bytes], common: list[int], window: int) -> list[tuple[int, int]]:
    """For each suffix how far left and right of its place a window reaches that another one of ``keys`` has too; (0, 0) if none.

    ``common`` tells what each shares with the one before. Neighbours to the right are joined from the longest share to the shortest; of what is joined,
    the smaller set enters the order of left contexts of the larger one, where each one's best partner stands beside it. So each suffix is moved a
    logarithm of times, and no pair is looked at but those.
    """
    ends = [k.index(0) for k in keys]
    lefts = [k[e + 1 :] for k, e in zip(keys, ends, strict=True)]
    order = sorted(range(len(keys)), key=lefts.__getitem__)
    rank = [0] * len(keys)
    for i, k in enumerate(order):
        rank[k] = i
    best = [(0, 0)] * len(keys)
    sets = [[r] for r in rank]
    of = list(range(len(keys)))

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    # What the right sides share ends where one of them ends.
    edges = sorted(((min(common[i], ends[i], ends[i - 1]), i) for i in range(1, len(keys))), reverse=True)
    for right, i in edges:
        a, b = root(i - 1), root(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        met = []
        for r in small:
            at = bisect_left(large, r)
            met += [(r, x) for x in large[max(0, at - 1) : at + 1]]
        for r, x in met:
            u, v = order[r], order[x]
            left = shared(lefts[u], lefts[v])
            if left + right >= window:
                for k in (u, v):
                    best[k] = (max(best[k][0], left), max(best[k][1], right))
        if len(small) > 8:
            large += small
            large.sort()
        else:
            for r in small:
                insort(large, r)
        of[b], sets[b] = a, []
    return best


_FOUND = "row bigint, start bigint, end bigint, key binary"


def halves(key: bytes, row: int, place: int, far: int, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The suffix once for the nearer and once for the farther half of its windows, each with longer bytes that all of them share."""
    half = far // 2
    right = key.index(0)
    left = key[right + 1 :]
    if right >= window - half and right + min(half, len(left)) >= window:
        yield row, place, 0, key[: right + 1] + left[:half]
    moved = left[half::-1] + key[: min(right, window - half - 1)]
    rest = left[half + 1 :]
    if len(left) > half and len(moved) + len(rest) >= window:
        yield row, place - half - 1 if row >= 0 else 0, 0, moved + b"\0" + rest


def _ranges(window: int, far: int, splits: list[bytes]) -> Callable:
    """Merges the runs of a range: spans that are repeated, and, where a group of suffixes goes on in another range, its suffixes for the next round."""
    least = window - far

    def torn(part: int, key: bytes) -> bool:
        return far > 0 and any(len(s) >= least and s[:least] == key[:least] for s in splits[max(0, part - 1) : part + 1] if len(s) > least)

    def run(keyed: tuple, table: pa.Table) -> pa.Table:
        part, out, readers = keyed[0].as_py(), [], []
        for common, length, tails, rows, places in zip(*(table.column(c).to_pylist() for c in ("shared", "length", "tails", "row", "place")), strict=True):
            if common is None:
                out += [(*x, None) for x in zip(*(np.frombuffer(c, dtype=np.int64).tolist() for c in (rows, length, places)), strict=True)]
            else:
                readers.append(_Reader(common, length, tails, rows, places))
        keys: list[bytes] = []
        common: list[int] = []
        held: list[list[tuple[int, int]]] = []

        def close() -> None:
            """Judge the group that ends: suffixes that share all bytes that their windows have in common."""
            singles = []
            for key, at in zip(keys, held, strict=True):
                if len(set(at)) > 1 or at[0][0] < 0:
                    out.extend((*_whole(key, r, p), None) for r, p in at if r >= 0)
                    singles.append((-1, 0))
                else:
                    singles.append(at[0])
            if torn(part, keys[0]):
                for key, (r, p) in zip(keys, singles, strict=True):
                    out.extend(halves(key, r, p, far, window))
            elif len(keys) > 1:
                for (r, p), (left, right) in zip(singles, longest(keys, common, window), strict=True):
                    if r >= 0 and right:
                        out.append((r, p - left, p + right, None))
            keys.clear()
            common.clear()
            held.clear()

        for key, row, place, same in merge(readers):
            if keys and key == keys[-1]:
                held[-1].append((row, place))
                continue
            if keys and same < least:
                close()
            keys.append(key)
            common.append(same)
            held.append([(row, place)])
        if keys:
            close()
        spans = [(*x, None) for x in _merged_spans([x[:3] for x in out if x[3] is None])]
        return pa.Table.from_batches([_batch(spans + [x for x in out if x[3] is not None], _FOUND)])

    return run


def choose_splits(sample: list[bytes], ranges: int, least: int) -> list[bytes]:
    """Where the ranges begin: at the first of a group of suffixes, so that groups stay whole, but within groups that fill whole ranges."""
    sample = sorted(set(sample))
    picked = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    out: list[bytes] = []
    for key in picked:
        start = key[:least]
        split = key if out and out[-1][:least] == start else start
        if not out or split > out[-1]:
            out.append(split)
    return out


def _bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` written in ``n`` buckets of ``key`` to the shared folder, so that joins on it deal out only their other side."""
    spark = df.sparkSession
    name = f"graphloom_{uuid.uuid4().hex}"
    path = f"{shared_root(spark).rstrip('/')}/graphloom-stash/{spark.sparkContext.applicationId}/{name}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def _bytes_under(table: DataFrame) -> int:
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    return path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength() if path else 0


def repeated_spans(held: DataFrame, window: int = WINDOW, per_range: int = RANGE) -> DataFrame:
    """``_row, start, end``: spans of bytes that are repeated, which may overlap and touch. ``held`` has ``_row, _text``, each number once, in buckets of it."""
    spark, far = held.sparkSession, reach(window)
    # About one anchor comes for 64 bytes of text, which are some 25 compressed; a part's fit into a task.
    parts = max(partitions(spark), _bytes_under(held) // (64 << 20))
    met = held.select("_row", "_text").mapInArrow(_anchor_rows(window, parts), _ANCHORS)
    recurring = stash(met.groupBy("part").applyInArrow(_recurring, "_row bigint, place bigint"))
    n = recurring.count()

    def joined(places: DataFrame) -> DataFrame:
        listed = places.groupBy("_row").agg(F.collect_list("place").alias("places"))
        return held.select("_row", "_text").join(listed.hint("shuffle_hash"), "_row").select("_row", "_text", "places")

    def splits_of(total: int, sampled: Callable[[float], DataFrame], far: int) -> list[bytes]:
        ranges = max(1, -(-total // per_range))
        if ranges == 1:
            return []
        # At most some SAMPLE suffixes of a few hundred bytes; they only settle where ranges begin.
        return choose_splits([bytes(r[0]) for r in sampled(min(1.0, SAMPLE / total)).collect()], ranges, window - far)

    def sampled_texts(share: float) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = []
                for text, places in zip(batch.column(1), batch.column(2), strict=True):
                    plain = text.as_py().translate(_SHIFT)
                    keys += [k for p in places.values.to_pylist() if (k := suffix_at(plain, p, far, window)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary())], names=["key"])

        few = recurring.where(F.pmod(F.xxhash64("_row", "place"), F.lit(1 << 30)) < int(share * (1 << 30)))
        return joined(few).mapInArrow(cut, "key binary")

    splits = splits_of(n, sampled_texts, far)
    runs = joined(recurring).mapInArrow(_runs_of_texts(window, splits), _BLOCK)
    found = stash(runs.groupBy("part").applyInArrow(_ranges(window, far, splits), _FOUND))
    every, done = found.where("key IS NULL"), [recurring]
    while far:
        torn = found.where("key IS NOT NULL").select("key", "row", F.col("start").alias("place"))
        n, far = torn.count(), far // 2
        if not n:
            break

        def sampled_keys(share: float, torn: DataFrame = torn) -> DataFrame:
            return torn.where(F.pmod(F.xxhash64("key", "row", "place"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key")

        splits = splits_of(n, sampled_keys, far)
        runs = torn.mapInArrow(_runs_of_keys(splits), _BLOCK)
        found = stash(runs.groupBy("part").applyInArrow(_ranges(window, far, splits), _FOUND))
        every = every.unionByName(found.where("key IS NULL"))
    drop_stash(*done)
    return every.select(F.col("row").alias("_row"), "start", "end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the maximal spans that went."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, kept, spans = [], [], []
        for text, found in zip(batch.column(0), batch.column(1), strict=True):
            text, at, rest = text.as_py(), 0, []
            gone = [(s, e) for _, s, e in _merged_spans([(0, x["start"], x["end"]) for x in found.as_py() or []])]
            for start, end in gone:
                rest.append(text[at:start])
                at = end
            sizes.append(len(text))
            kept.append(b"".join([*rest, text[at:]]))
            spans.append([{"start": s, "end": e} for s, e in gone])
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sizes, type=pa.int64()), pa.array(kept, type=pa.binary()), pa.array(spans, type=span)], names=[*batch.schema.names[2:], "n_bytes", "kept", "spans"])


def remove_repeats(documents: DataFrame, window: int = WINDOW, per_range: int = RANGE) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` for every row of ``documents``: the bytes that stay, and the maximal spans of those that go.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else in the corpus, the same text included; all such
    strings go, the first as well. Null texts are empty, texts shorter than ``window`` stay whole, repeated rows repeat each other, a null doc_id stays null,
    and an empty table gives an empty result. Spans may begin and end inside a code point, so ``kept`` is binary. Columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    given = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    held = _bucketed(given, "_row", partitions(spark))
    spans = repeated_spans(held, window, per_range).groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    both = held.join(spans.hint("shuffle_hash"), "_row", "left").select("_text", "_spans", "doc_id")
    kind = documents.select("doc_id").schema.simpleString()[7:-1]
    return both.mapInArrow(_cut, f"{kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
