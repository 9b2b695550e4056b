"""SimHash near-duplicate detection over pigeonhole blocks (operator 6)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_roots
from ..runtime import drop_stash, small_batches, stash

BITS = 64
#: Least hashes of a text's shingles: bands of so many rows each. Two texts of similarity s share no band with probability
#: (1 - s^ROWS)^BANDS, 3 in a million at 0.8.
BANDS, ROWS = 24, 4
#: Longs of a set's parity marks: no two sets differ in more marks than in members.
MARKS = 16
#: Buckets of so many fingerprints are compared pair by pair, larger ones with one of them first.
SMALL = 16
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a lower-cased text, piece by piece, so a giant text needs no giant list."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    kept: list[bytes] = []
    at, seen = 0, 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += PIECE // 16
        # Step back to the last white space of the piece unless the text ends here.
        if end < len(text):
            end = max(text.rfind(c, at, end + 1) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) + 1
        kept += text[at:end].split()
        seen += len(kept)
        if len(kept) >= words:
            yield np.array([digest(join(x), seed) for x in zip(*(kept[i:] for i in range(words)), strict=False)], dtype=np.uint64)
            seen -= words - 1
            kept = kept[len(kept) - words + 1 :]
        else:
            seen -= len(kept)
        at = end
    if kept and not seen:
        yield np.array([digest(join(kept), seed)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes; 0 for a text without words."""
    # bytes.lower and bytes.split know ASCII only: A-Z and the six white-space code points.
    return majority(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), words, seed))


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half the hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in pieces:
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *keep: str, words: int = 3, seed: int = 42) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(0)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    small_batches(documents.sparkSession)
    kinds = documents.select(*keep).schema.simpleString()[7:-1]
    return documents.select("text", *keep).mapInArrow(run, f"{kinds}{', ' * bool(keep)}fp: bigint")


def masks(differing: int, blocks: int) -> list[int]:
    """Signed masks, one for each choice of the blocks that must agree if at most ``differing`` bits differ."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for kept in combinations(range(blocks), blocks - differing):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        out.append(mask - (1 << BITS) * (mask >> (BITS - 1)))
    return out


def finer(mask: int, differing: int) -> list[int]:
    """Masks that keep more: the bits that ``mask`` leaves free are cut into blocks again, of which ``differing`` may differ. Few free bits stay free."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    if len(free) <= 3 * differing:
        return []
    n = 2 * differing
    blocks = [free[len(free) * i // n : len(free) * (i + 1) // n] for i in range(n)]
    whole = mask % (1 << BITS)
    out = [whole | sum(1 << i for block in kept for i in block) for kept in combinations(blocks, n - differing)]
    return [m - (1 << BITS) * (m >> (BITS - 1)) for m in out]


def blocks_for(n: int, differing: int) -> int:
    """Blocks that keep two bits more than it takes to number ``n`` fingerprints, so that chance seldom fills a bucket; twice ``differing`` at least."""
    blocks = 2 * differing
    while BITS * (blocks - differing) // blocks < n.bit_length() + 2 and blocks < BITS // 2:
        blocks += 1
    return blocks


def class_links(prints: DataFrame, differing: int = 3, blocks: int | None = None, small: int = SMALL) -> DataFrame:
    """``a, b``: links of distinct fingerprints that differ in ``differing`` bits or fewer, with the same components as all such pairs.

    With more blocks than differing bits, a close pair agrees in ``blocks - differing`` of them, so it shares the bucket of one such
    choice. In buckets of up to ``small`` fingerprints each meets each. In a larger one each meets the most central one (that shares the most
    buckets); where that leaves several components in a bucket, it is cut into buckets that keep half of the free
    bits as well, again for all choices, so that no close pair is lost. A bucket whose mask leaves so few bits free that it can't be large (three for each bit that
    may differ: at most 512 fingerprints for three) is compared pair by pair, also while others are cut. Rows thus
    grow with the fingerprints, not with the square of a group. ``prints`` holds each fingerprint once: copies make no pairs.
    """
    spark = prints.sparkSession
    n = prints.count()
    chosen = masks(differing, blocks or blocks_for(n, differing))
    keyed = prints.select("fp", F.col("fp").alias("_root"), F.explode(F.array(*[F.lit(m) for m in chosen])).alias("_m")).withColumn("_v", F.col("fp").bitwiseAND(F.col("_m")))
    same = (F.col("_m") == F.col("_m2")) & (F.bitwise_not("_v") == F.col("_v2"))
    found = None
    while True:
        # Only buckets that hold several components go on, so nearly all rows end before the join.
        shared = keyed.groupBy("_m", "_v").agg(F.count("*").alias("_n"), F.min("_root").alias("_r1"), F.max("_root").alias("_r2")).where("_r1 <> _r2")
        shared = shared.select(F.col("_m").alias("_m2"), F.bitwise_not("_v").alias("_v2"), "_n")
        live = stash(keyed.join(shared, same).select("fp", "_root", "_m", "_v", "_n"))
        rows = live.count()
        following = {m: finer(m, differing) for m in chosen}
        # Masks of one level end at different levels; what can't be cut finer is compared pair by pair.
        at_once = (F.col("_n") <= small) | (F.bit_count(F.bitwise_not("_m")) <= 3 * differing)
        few, many = live.where(at_once), live.where(~at_once)
        close = F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp2"))) <= differing
        other = few.select(F.col("fp").alias("_fp2"), F.col("_root").alias("_root2"), F.col("_m").alias("_m2"), F.bitwise_not("_v").alias("_v2"))
        pairs = few.join(other, same & (F.col("fp") < F.col("_fp2")) & (F.col("_root") != F.col("_root2")) & close).select(F.col("fp").alias("a"), F.col("_fp2").alias("b"))
        crowded = many.count()
        if crowded:
            weight = many.groupBy(F.col("fp").alias("_f")).agg(F.sum("_n").alias("_w"))
            hubs = many.join(weight, F.col("fp") == F.col("_f")).groupBy("_m", "_v").agg(F.max_by("fp", F.struct("_w", "fp")).alias("_fp2"))
            hubs = hubs.select(F.col("_m").alias("_m2"), F.bitwise_not("_v").alias("_v2"), "_fp2")
            pairs = pairs.unionByName(many.join(hubs, same & (F.col("fp") != F.col("_fp2")) & close).select(F.least("fp", "_fp2").alias("a"), F.greatest("fp", "_fp2").alias("b")))
        pairs = stash(pairs.distinct(), rows)
        if not crowded:
            drop_stash(live)
        found = pairs if found is None else found.unionByName(pairs)
        if not crowded:
            return found
        roots = component_roots(found, "a", "b")
        rooted = stash(many.join(roots, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_m", "_v"), crowded)
        torn = rooted.groupBy("_m", "_v").agg(F.min("_root").alias("_r1"), F.max("_root").alias("_r2")).where("_r1 <> _r2").select(F.col("_m").alias("_m2"), F.bitwise_not("_v").alias("_v2"))
        # At most 20 masks for each mask of the level before, whatever the table's size (for three bits).
        table = spark.createDataFrame([(m, f) for m, fs in following.items() for f in fs], "_m3 long, _f long")
        cut = rooted.join(torn, same, "left_semi").join(F.broadcast(table), F.col("_m") == F.col("_m3")).select("fp", "_root", F.col("_f").alias("_m"))
        keyed = stash(cut.distinct().withColumn("_v", F.col("fp").bitwiseAND(F.col("_m"))))
        chosen = sorted({f for fs in following.values() for f in fs})


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, words: int = 3, differing: int = 3, blocks: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``documents``.

    Fingerprints within ``differing`` bits link; ``component_id`` is the smallest doc_id that links
    reach. Null, empty and blank texts have fingerprint zero and link like any other; rows with a null
    doc_id take part, and a component of such rows only has a null component_id; repeated rows give repeated
    rows. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
    """
    prints = stash(fingerprints(documents.select("text", "doc_id"), "doc_id", words=words))
    return prints.join(grouped(prints, "doc_id", differing, blocks), prints["fp"] == F.col("_fp"), "left").select("doc_id", "fp", F.col("_least").alias("component_id"))


def grouped(prints: DataFrame, least: str, differing: int = 3, blocks: int | None = None) -> DataFrame:
    """``_fp, _least`` for each distinct fingerprint: the least value of ``least`` in its component."""
    # Copies meet here, before any pair is made; partial sums keep a hot fingerprint from one task.
    distinct = stash(prints.groupBy("fp").agg(F.min(least).alias("_own")))
    roots = component_roots(class_links(distinct.select("fp"), differing, blocks), "a", "b")
    rooted = stash(distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "_own", F.coalesce("root", "fp").alias("_root")))
    least_of = rooted.groupBy("_root").agg(F.min("_own").alias("_least")).select(F.col("_root").alias("_r"), "_least")
    # The key is written anew (not twice), so that the callers' join has an exchange of its own on both sides.
    return rooted.join(least_of, F.col("_root") == F.col("_r")).select(F.col("fp").alias("_fp"), "_least")


def keep_one(documents: DataFrame, words: int = 3, differing: int = 3, blocks: int | None = None) -> DataFrame:
    """The rows of ``documents`` of which one stays for each group: the smallest doc_id (null last).

    Rows with the same doc_id and fingerprint are told apart by their text, and rows that agree in both are one
    document, of which one row stays. All columns come back as they were.
    """
    held = _held(documents)
    prints = stash(fingerprints(held.select("row.text", _rank().alias("_rank")), "_rank", words=words))
    return _stay(held, grouped(prints, "_rank", differing, blocks))


def _held(documents: DataFrame) -> DataFrame:
    """``row, _row``: whole rows and a number for each, written once so that it stays."""
    return stash(documents.select(F.struct(*documents.columns).alias("row"), F.monotonically_increasing_id().alias("_row")))


def _rank() -> Column:
    """Which row of a group stays: the smallest doc_id, null last; of rows with one id the text decides, then any of the equal rows."""
    return F.struct(F.col("row.doc_id").isNull().alias("late"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h1"), F.col("_row").alias("_row"))


def _of(held: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of ``held`` whose number is in ``numbers``, which are hashed, so that the texts needn't be sorted."""
    return held.join(numbers.hint("shuffle_hash"), "_row", "left_semi")


def _stay(held: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``held`` that are the ``_least`` of a group; ``best`` may have a group many times."""
    return _of(held, best.groupBy("_least._row").agg(F.lit(1)).select("_row")).select("row.*")


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes in ascending order; a text of fewer words is one shingle, one without words has none."""
    parts = list(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), words, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _multipliers() -> np.ndarray:
    """Odd numbers, the same at every run; products modulo 2^64 are one permutation of the hashes each."""
    return np.array([xxhash.xxh64_intdigest(b"row", i) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, from the least products of its rows; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    by, least = _multipliers(), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, i : i + (1 << 12)] * by[:, None]).min(axis=1), out=least)
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (row >> np.uint64(29)) ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def marks(hashes: np.ndarray) -> np.ndarray:
    """Parities of the members in 64 * :data:`MARKS` cells, as bits: a member that only one set has changes one bit, so two sets
    differ in as many members as bits, or more."""
    cell = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * MARKS - 1).bit_length())
    odd = (np.bincount(cell.astype(np.int64), minlength=64 * MARKS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _per_text(documents: DataFrame, kind: str, keep: str, of: Callable[[str | None], tuple]) -> DataFrame:
    """``keep`` and the columns ``kind``, values of ``of`` for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(x.as_py()) for x in batch.column(0)]
            columns = [pa.array(c, type=t) for c, t in zip(zip(*found), types, strict=True)] if found else [pa.array([], type=t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[keep, *names])

    names = [x.split(":")[0] for x in kind.split(", ")]
    types = [pa.list_(pa.int64()) if "array" in x else pa.int64() for x in kind.split(", ")]
    small_batches(documents.sparkSession)
    return documents.select("text", keep).mapInArrow(run, f"{documents.select(keep).schema.simpleString()[7:-1]}, {kind}")


def similar_links(keyed: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float, differing: int = 3) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of sets that are ``least`` similar or more and whose fingerprints link or that share a band.

    ``keyed`` has ``_set, _n, _fp, _bands, _marks``, each set once; ``sets(chosen)`` gives ``_set, _hashes`` for the sets in ``chosen``.
    Fingerprints go first: sets of one fingerprint meet its least set, and the least sets of fingerprints that differ in ``differing`` bits or fewer meet (:func:`class_links`).
    Near copies may differ in more bits, so bands find what fingerprints have left apart. In bands that hold several components each set of a band meets the band's most central one (that shares the most bands with others), so a large group of near copies makes
    rows in proportion to its size and mostly falls into one component. Then, in bands that still hold several components, the
    sets outside the band's largest component meet all others. Of these pairs only those go on whose sizes and marks allow the similarity, a bound that
    loses none. Every pair that counts is compared on the whole sets.
    """
    every = keyed.select("_set", "_n", F.posexplode("_bands").alias("_b", "_v"))
    other = F.bitwise_not("_v").alias("_v2")
    same = (F.col("_b") == F.col("_b2")) & (F.bitwise_not("_v") == F.col("_v2"))
    shared = every.groupBy("_b", "_v").agg(F.count("*").alias("_many")).where("_many > 1").select(F.col("_b").alias("_b2"), other, "_many")
    live = stash(every.join(shared, same).select("_set", "_n", "_b", "_v", "_many"))
    rows = live.count()
    printed = stash(keyed.select("_set", "_n", "_fp"))
    leaders = stash(printed.groupBy(F.col("_fp").alias("_f")).agg(F.min(F.struct("_set", "_n")).alias("_lead")))
    copies = printed.join(leaders, F.col("_fp") == F.col("_f")).select("_set", "_n", F.col("_lead._set").alias("_set2"), F.col("_lead._n").alias("_n2")).where("_set <> _set2")
    lead = lambda c, name: leaders.select(F.col("_f").alias(c), F.col("_lead._set").alias(f"_set{name}"), F.col("_lead._n").alias(f"_n{name}"))
    linked = class_links(leaders.select(F.col("_f").alias("fp")), differing).join(lead("a", ""), "a").join(lead("b", "2"), "b").select("_set", "_n", "_set2", "_n2")
    printed_pairs = stash(copies.unionByName(linked))
    met = printed_pairs.count()
    named = printed_pairs.select(F.explode(F.array("_set", "_set2")).alias("_set"))
    held = stash(sets(live.select("_set").unionByName(named).distinct()))
    one = held.select(F.col("_set").alias("_s1"), F.col("_hashes").alias("_h1"))
    two = held.select(F.col("_set").alias("_s2"), F.col("_hashes").alias("_h2"))
    sizes = F.least("_n", "_n2") >= F.lit(least) * F.greatest("_n", "_n2")

    def close(met: DataFrame, rows: int) -> DataFrame:
        pairs = met.select(F.least("_set", "_set2").alias("a"), F.greatest("_set", "_set2").alias("b")).distinct()
        judged = stash(pairs, rows).join(one, F.col("a") == F.col("_s1")).join(two, F.col("b") == F.col("_s2"))
        both = F.size(F.array_intersect("_h1", "_h2"))
        # Whole numbers on both sides of the bound but for the factor, so a similarity of just ``least`` counts.
        return stash(judged.where(both >= F.lit(least) * (F.size("_h1") + F.size("_h2") - both)).select("a", "b"))

    found = close(printed_pairs.where(sizes), met)
    live = _torn(live, component_roots(found, "a", "b"), same, rows)
    weight = live.groupBy(F.col("_set").alias("_s")).agg(F.sum("_many").alias("_w"))
    hubs = live.join(weight, F.col("_set") == F.col("_s")).groupBy("_b", "_v").agg(F.max_by(F.struct("_set", "_n"), F.struct("_w", "_set")).alias("_hub"))
    hubs = hubs.select(F.col("_b").alias("_b2"), other, F.col("_hub._set").alias("_set2"), F.col("_hub._n").alias("_n2"))
    found = found.unionByName(close(live.join(hubs, same & (F.col("_set") != F.col("_set2")) & sizes), rows))
    roots = component_roots(found, "a", "b")
    rooted = stash(live.join(roots, F.col("_set") == F.col("id"), "left").select("_set", "_n", "_b", "_v", F.coalesce("root", "_set").alias("_root")), rows)
    largest = rooted.groupBy("_b", "_v", "_root").agg(F.count("*").alias("_k")).groupBy("_b", "_v").agg(F.max_by("_root", F.struct("_k", "_root")).alias("_top"), F.count("*").alias("_kinds"))
    torn = largest.where("_kinds > 1").select(F.col("_b").alias("_b2"), other, "_top")
    torn = rooted.join(torn, same).select("_set", "_n", "_b", "_v", "_root", "_top")
    marked = keyed.select(F.col("_set").alias("_s"), *[F.element_at("_marks", i + 1).alias(f"_p{i}_") for i in range(MARKS)])
    torn = stash(torn.join(marked, F.col("_set") == F.col("_s")).drop("_s"), rows)
    right = torn.select(*[F.col(c).alias(f"{c}2") for c in torn.columns if c not in ("_v", "_top")], other)
    apart = sum((F.bit_count(F.col(f"_p{i}_").bitwiseXOR(F.col(f"_p{i}_2"))) for i in range(1, MARKS)), F.bit_count(F.col("_p0_").bitwiseXOR(F.col("_p0_2"))))
    # Sets of n and m members whose similarity is s differ in (n + m) * (1 - s) / (1 + s) members.
    near = F.lit(1 + least) * apart <= F.lit(1 - least) * (F.col("_n") + F.col("_n2")) + 1e-6
    once = (F.col("_root2") == F.col("_top")) | (F.col("_set") < F.col("_set2"))
    found = found.unionByName(close(torn.where("_root <> _top").join(right, same & (F.col("_root") != F.col("_root2")) & once & sizes & near), rows))
    drop_stash(live, held, rooted, torn, printed, leaders, printed_pairs)
    return found


def _torn(live: DataFrame, roots: DataFrame, same: Column, rows: int) -> DataFrame:
    """The rows of bands that ``roots`` leave in several components, written anew."""
    rooted = stash(live.join(roots, F.col("_set") == F.col("id"), "left").select(*live.columns, F.coalesce("root", "_set").alias("_root")), rows)
    several = rooted.groupBy("_b", "_v").agg(F.min("_root").alias("_r1"), F.max("_root").alias("_r2")).where("_r1 <> _r2").select(F.col("_b").alias("_b2"), F.bitwise_not("_v").alias("_v2"))
    left = stash(rooted.join(several, same, "left_semi").select(*live.columns), rows)
    drop_stash(live, rooted)
    return left


def keep_one_similar(documents: DataFrame, words: int = 5, least: float = 0.8, differing: int = 3) -> DataFrame:
    """The rows of ``documents`` of which one stays for each group of similar texts: the smallest doc_id (null last).

    Texts link if their sets of ``words``-word shingles (lower-cased, split at white space) have a Jaccard similarity of ``least``
    or more, and groups are what links reach. Candidates have SimHash fingerprints (of the set) within ``differing`` bits, or share a band of least hashes (:data:`BANDS`); each is compared exactly. Texts without
    words are one group. Repeated rows are one document, of which one row stays; columns come back as they were. An empty table gives an
    empty result.
    """
    held = _held(documents)

    def whole(text: str | None) -> tuple[int, np.ndarray]:
        hashes = shingle_set(text, words)
        return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)), hashes.view(np.int64)

    def keys(text: str | None) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        key, hashes = whole(text)
        own = int(np.uint64(majority([hashes.view(np.uint64)])).view(np.int64))
        return key, len(hashes), own, bands(hashes.view(np.uint64)), marks(hashes.view(np.uint64))

    texts = held.select("row.text", _rank().alias("_rank"))
    prints = stash(_per_text(texts, "_set: bigint, _n: bigint, _fp: bigint, _bands: array<bigint>, _marks: array<bigint>", "_rank", keys))
    # Copies meet here, before any pair is made.
    distinct = stash(prints.groupBy("_set").agg(F.min("_rank").alias("_own"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"), F.first("_bands").alias("_bands"), F.first("_marks").alias("_marks")))

    def sets(chosen: DataFrame) -> DataFrame:
        numbers = distinct.join(chosen, "_set", "left_semi").select("_own._row")
        return _per_text(_of(held.select("_row", "row.text"), numbers), "_set: bigint, _hashes: array<bigint>", "_row", whole).select("_set", "_hashes")

    roots = component_roots(similar_links(distinct.select("_set", "_n", "_fp", "_bands", "_marks"), sets, least, differing), "a", "b")
    rooted = distinct.join(roots, F.col("_set") == F.col("id"), "left").select("_own", F.coalesce("root", "_set").alias("_root"))
    return _stay(held, rooted.groupBy("_root").agg(F.min("_own").alias("_least")))
