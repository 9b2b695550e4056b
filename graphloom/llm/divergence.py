"""Source divergence audit: how the words of a source differ from those of its language and of other sources (operator 13)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import drop_stash, partitions, small_batches, stash

#: Bytes that are in no term: all below 128 but the letters.
_SEPARATE = bytes(32 if b < 128 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Terms that a task adds up before it gives its sums away.
HELD = 600_000
#: Bytes of a text that are split into terms at once; a text of more pieces is one document all the same.
PIECE = 1 << 20
#: A group's remaining candidates are ranked at once if there are so many or fewer; more are cut by further digits.
NARROW = 1_024
#: Bits of a value that one histogram tells apart, and bytes of an item.
DIGIT, BYTES = 15, 2
SCALE = 1_000_000_000


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about :data:`PIECE` bytes."""
    plain = text.translate(_SEPARATE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


#: A block: the groups it names, and for each entry the group's place among them, the term, occurrences and documents.
_BLOCK = "part int, langs array<string>, sources array<string>, at binary, terms binary, n binary, docs binary, part_of bigint"
_KEPT = "lang string, source string, term binary, n bigint, total bigint, first bigint"


def _counted(parts: int) -> Callable:
    """For each group and term that a task has met: occurrences and documents, added up as far as :data:`HELD` allows, in blocks by parts of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held, giants, task = 0, 0, TaskContext.get().partitionId()

        def blocks(groups: list[tuple[str, str]], at: np.ndarray, terms: list[bytes], n: np.ndarray, docs: np.ndarray, part_of: int | None) -> pa.RecordBatch:
            part = np.array([crc32(t) for t in terms], dtype=np.int64) % parts
            order = np.argsort(part, kind="stable")
            which, begin = np.unique(part[order], return_index=True)
            langs, sources = ([g[i] for g in groups] for i in (0, 1))
            # Each group is named once more for itself, so that those without terms are known.
            rows = [(0, langs, sources, b"", b"", b"", b"", part_of)]
            for p, i in zip(which.tolist(), np.split(order, begin[1:]), strict=True):
                own = at[i]
                named, places = np.unique(own, return_inverse=True)
                rows.append((p, [langs[g] for g in named], [sources[g] for g in named], places.astype(np.int32).tobytes(), b" ".join([terms[k] for k in i.tolist()]), n[i].tobytes(), docs[i].tobytes(), part_of))
            kinds = [pa.int32(), *[pa.list_(pa.string())] * 2, *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "langs", "sources", "at", "terms", "n", "docs", "part_of"])

        def flush() -> pa.RecordBatch:
            terms, n, docs, sizes = [], [], [], []
            for own, held_by in sums.values():
                terms += own
                n.append(np.fromiter(own.values(), dtype=np.int64, count=len(own)))
                docs.append(np.fromiter(map(held_by.__getitem__, own), dtype=np.int64, count=len(own)))
                sizes.append(len(own))
            return blocks(list(sums), np.repeat(np.arange(len(sums)), sizes), terms, np.concatenate(n), np.concatenate(docs), None)

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, docs = sums.setdefault((lang, source), (Counter(), Counter()))
                if len(text) <= PIECE:
                    for terms in _pieces(text):
                        before = len(own)
                        own.update(terms)
                        docs.update(set(terms))
                        held += len(own) - before
                else:
                    # The documents of such terms are told apart by number, so that no set of all terms of a giant text is held.
                    giants += 1
                    for terms in _pieces(text):
                        counts = Counter(terms)
                        yield blocks([(lang, source)], np.zeros(len(counts), dtype=np.int64), list(counts), np.array(list(counts.values()), dtype=np.int64), np.zeros(len(counts), dtype=np.int64), task << 32 | giants)
                if held >= HELD:
                    yield flush()
                    sums, held = {}, 0
        if sums:
            yield flush()

    return run


def _kept(least: int) -> Callable:
    """Adds up the blocks of a part: the terms that ``least`` documents of their language have, and a row with a null term for each group that is named."""

    def run(table: pa.Table) -> pa.Table:
        langs: dict[str, int] = {}
        groups: dict[tuple[str, str], int] = {}
        terms: list[bytes] = []
        parts: list[tuple[np.ndarray, ...]] = []
        for row in table.select(["langs", "sources", "at", "terms", "n", "docs", "part_of"]).to_pylist():
            codes = np.array([groups.setdefault((a, b), len(groups)) for a, b in zip(row["langs"], row["sources"], strict=True)], dtype=np.int64)
            at, n, docs = (np.frombuffer(row[c], dtype=k) for c, k in (("at", np.int32), ("n", np.int64), ("docs", np.int64)))
            if len(at):
                terms += row["terms"].split(b" ")
                parts.append((codes[at], n, docs, np.full(len(at), -1 if row["part_of"] is None else row["part_of"], dtype=np.int64)))
        lang_of = np.array([langs.setdefault(a, len(langs)) for a, _ in groups], dtype=np.int64)
        names = list(groups)
        out = [pa.table([pa.array([g[0] for g in names]), pa.array([g[1] for g in names]), pa.nulls(len(names), pa.binary()), *[pa.array(np.zeros(len(names), dtype=np.int64))] * 3], schema=_SCHEMA)]
        if parts:
            group, n, docs, part_of = (np.concatenate(x) for x in zip(*parts, strict=True))
            coded = pa.array(terms, type=pa.binary()).dictionary_encode()
            term = coded.indices.to_numpy().astype(np.int64)
            many = len(coded.dictionary)
            pair, place = np.unique(group * many + term, return_inverse=True)
            total, found = np.bincount(place, n).astype(np.int64), np.bincount(place, docs).astype(np.int64)
            giant = np.flatnonzero(part_of >= 0)
            if len(giant):
                # The pieces of one giant text are one document.
                once = np.unique(np.stack([place[giant], part_of[giant]]), axis=1)[0]
                found += np.bincount(once, minlength=len(found))
            group, term = pair // many, pair % many
            whole, of = np.unique(lang_of[group] * many + term, return_inverse=True)
            every, in_docs = np.bincount(of, total).astype(np.int64), np.bincount(of, found)
            first = np.zeros(len(pair), dtype=np.int64)
            first[np.unique(of, return_index=True)[1]] = 1
            keep = np.flatnonzero(in_docs[of] >= least)
            name = [pa.array([g[i] for g in names]).take(pa.array(group[keep])) for i in (0, 1)]
            out.append(pa.table([*name, coded.dictionary.take(pa.array(term[keep])), pa.array(total[keep]), pa.array(every[of[keep]]), pa.array(first[keep])], schema=_SCHEMA))
        return pa.concat_tables(out)

    return run


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("first", pa.int64())])


def kept_terms(documents: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n, total, first``: occurrences of each kept term (bytes) in each group and in the language, and 1 in one of its groups; and a row with a null term for each group.

    Terms are dealt out in parts by a hash, so a part has all groups of its terms; a task that reads text sends each term once for each group and :data:`HELD` terms.
    """
    small_batches(documents.sparkSession)
    read = [F.coalesce("text", F.lit("")).cast("binary").alias("_t"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]]
    met = documents.select(*read).mapInArrow(_counted(partitions(documents.sparkSession)), _BLOCK)
    return met.groupBy("part").applyInArrow(_kept(least), _KEPT)


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + V)) in whole numbers of 38 digits."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(20, 0)) * CAST({n} + 1 AS DECIMAL(18, 0)) div CAST({total} + _v AS DECIMAL(20, 0))")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def _spread(groups: DataFrame, salts: int) -> DataFrame:
    """Each row once for each salt, for a join whose other side is dealt out by a salt of its rows."""
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt(salts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def audit(documents: DataFrame, least_documents: int = 3, most: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources by their distance to each other, and the terms that mark a source.

    Null text, lang and source count as empty. A language keeps the terms of ``least_documents`` of its documents or more; repeated rows are documents of their own. ``pair``
    has each other source of the language with the sum of ``(p - q)^2 / q``, rounded down for each term, over all kept terms; ``term`` the group's terms with
    a larger share than in the whole language, ``most`` at most. Groups without terms take part in pairs; a language with one source has no
    pair; an empty table gives an empty result. Further columns are not read.
    """
    spark = documents.sparkSession
    salts = max(1, min(64, partitions(spark)))
    counts = stash(kept_terms(documents, least_documents))
    kept = counts.where("term IS NOT NULL")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"), F.sum("first").alias("_v"))
    whole = own.groupBy("lang").agg(F.sum("_n").alias("_nl"), F.sum("_v").alias("_v"))
    named = counts.where("term IS NULL").select("lang", "source").distinct()
    groups = named.join(own.drop("_v"), ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_n", "_nl", "_v")])
    # A language without kept terms has no shares; 1 stands in for them.
    groups = stash(groups.withColumn("_p0", F.when(F.col("_v") > 0, F.expr(f"1 + {SCALE} div (_n + _v)")).otherwise(1)))
    shares = kept.withColumn("_salt", _salt(salts, "term")).join(_spread(groups, salts), ["lang", "source", "_salt"])
    shares = stash(shares.select("lang", "source", "term", "n", "_p0", _share("n", "_n").alias("_p"), _share("total", "_nl").alias("_q")))
    found = _pairs(shares, groups, salts).unionByName(_terms(shares, most, salts))
    drop_stash(counts)
    return found


def _pairs(shares: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """Part ``pair``: what two groups without common terms would have, corrected by the terms that they have in common.

    A term that neither group has adds a constant, a term that only one has adds what depends on its count alone; so the sum over all kept terms is
    V constants, corrected by how often each count stands in either group, and by the terms that both have.
    """
    a, b = ([F.col(c).alias(f"{c}_{x}") for c in ("source", "_p0")] for x in "ab")
    other = F.col("source_a") != F.col("source_b")
    left = groups.withColumn("_salt", _salt(salts, "source")).select("lang", "_salt", "_v", *a)
    # All ordered pairs of sources are the result itself.
    base = left.join(_spread(groups.select("lang", *b), salts), ["lang", "_salt"]).where(other)
    zero = _gap(F.col("_p0_a"), F.col("_p0_b"))
    sums = [base.select("lang", "source_a", "source_b", (F.col("_v") * zero).alias("_s"))]
    # How many terms have one count in a group: as many rows as different counts.
    alike = shares.groupBy("lang", "source", "_p", "_p0").agg(F.count("*").alias("_many")).withColumn("_salt", _salt(salts, "source", "_p"))
    for mine, sign in (("a", "_p"), ("b", "_q")):
        one = alike.select("lang", "_salt", "_many", F.col("source").alias(f"source_{mine}"), F.col("_p0").alias(f"_p0_{mine}"), F.col("_p").alias(sign))
        met = one.join(_spread(groups.select("lang", *(b if mine == "a" else a)), salts), ["lang", "_salt"]).where(other)
        gap = _gap(F.col("_p"), F.col("_p0_b")) if mine == "a" else _gap(F.col("_p0_a"), F.col("_q"))
        sums.append(met.select("lang", "source_a", "source_b", (F.col("_many") * (gap - zero)).alias("_s")))
    # Terms that two groups have, each pair of groups once; both directions come of one row.
    x, y = ([F.col(c).alias(f"{c}_{k}") for c in ("source", "_p", "_p0")] for k in "xy")
    both = shares.select("lang", "term", *x).join(shares.select("lang", "term", *y), ["lang", "term"]).where("source_x < source_y")

    def common(a: str, b: str) -> Column:
        p, p0, q, q0 = (F.col(f"{c}_{k}") for k in (a, b) for c in ("_p", "_p0"))
        return F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0))

    met = both.groupBy("lang", "source_x", "source_y").agg(common("x", "y").alias("_xy"), common("y", "x").alias("_yx"))
    ways = F.array(F.struct(F.col("source_x").alias("source_a"), F.col("source_y").alias("source_b"), F.col("_xy").alias("_s")), F.struct(F.col("source_y").alias("source_a"), F.col("source_x").alias("source_b"), F.col("_yx").alias("_s")))
    sums.append(met.select("lang", F.inline(ways)))
    # Each way is added up before they meet.
    added = [s.groupBy("lang", "source_a", "source_b").agg(F.sum("_s").alias("_s")) for s in sums]
    every = added[0]
    for s in added[1:]:
        every = every.unionByName(s)
    value = every.groupBy("lang", "source_a", "source_b").agg(F.sum("_s").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source_a").orderBy(F.desc("value"), "source_b"))
    return value.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value", rank.alias("rank"))


def _terms(shares: DataFrame, most: int, salts: int) -> DataFrame:
    """Part ``term``: the ``most`` greatest values of each group, ties to the smaller term in bytes."""
    found = shares.where("_p > _q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("_p"), F.col("_q")).alias("value"))
    top = top_by_radix(found, ["lang", "source"], "value", "item", most, salts)
    return top.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")


def top_by_radix(rows: DataFrame, keys: list[str], value: str, item: str, most: int, salts: int) -> DataFrame:
    """The ``most`` rows of each group with the greatest ``value`` (a long of 0 or more), ties to the smaller ``item`` in bytes, and their ``rank``.

    Histograms over the digits of the values, from the highest, tell in which digit the row of that rank lies: rows above are in,
    rows below are out, and the rest is cut by the next digit; rows that tie in all digits are cut by the bytes of the item, behind those that all of them share.
    A group goes on until :data:`NARROW` rows or fewer are left. No group is sorted as a whole, and a hot group's histogram is added up in every task.
    """
    state = ["_need", "_left", "_skip"]
    first = rows.groupBy(*keys).agg(F.count("*").alias("_left")).withColumns({"_need": F.lit(most).cast("long"), "_skip": F.lit(0)})
    live = stash(_with(rows, first.select(*keys, *state), keys, item, salts))
    sure, shift, byte = [], 60 - DIGIT, False
    while True:
        narrow = (F.col("_left") <= NARROW) | (F.col("_left") <= F.col("_need"))
        sure.append(live.where(narrow).select(*rows.columns, "_need"))
        wide = live.where(~narrow)
        if wide.isEmpty():
            break
        digit = F.substr(F.col(item), F.col("_skip") + 1, F.lit(BYTES)) if byte else F.shiftright(F.col(value), shift).bitwiseAND((1 << DIGIT) - 1)
        marked = wide.withColumn("_digit", digit)
        order = F.asc("_digit") if byte else F.desc("_digit")
        up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # At most 2^15 digits of a value, or 2^16 of two bytes, for each group.
        bins = marked.groupBy(*keys, "_digit", "_need", "_skip").agg(F.count("*").alias("_in"), F.min(item).alias("_low"), F.max(item).alias("_high"))
        cut = bins.withColumn("_upto", F.sum("_in").over(up_to)).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_in") < F.col("_need")))
        behind = _shared(F.col("_low"), F.col("_high")) if byte or shift == 0 else F.lit(0)
        cut = cut.select(*keys, F.col("_digit").alias("_at"), (F.col("_need") - (F.col("_upto") - F.col("_in"))).alias("_still"), F.col("_in").alias("_rest"), behind.cast("int").alias("_next"))
        told = marked.withColumn("_salt", _salt(salts, item)).join(_spread(cut, salts), [*keys, "_salt"])
        before = F.col("_digit") < F.col("_at") if byte else F.col("_digit") > F.col("_at")
        judged = stash(told.select(*rows.columns, before.alias("_in"), (F.col("_digit") == F.col("_at")).alias("_same"), "_still", "_rest", "_next").where("_in OR _same"))
        sure.append(judged.where("_in").select(*rows.columns, F.lit(None).cast("long").alias("_need")))
        live = judged.where("_same").select(*rows.columns, F.col("_still").alias("_need"), F.col("_rest").alias("_left"), F.col("_next").alias("_skip"))
        byte, shift = byte or shift == 0, max(0, shift - DIGIT)
    every = sure[0]
    for s in sure[1:]:
        every = every.unionByName(s)
    # Fewer than ``most`` sure rows and at most NARROW others of each group.
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item)))
    return ranked.where(F.col("rank") <= most).drop("_need")


def _with(rows: DataFrame, state: DataFrame, keys: list[str], item: str, salts: int) -> DataFrame:
    return rows.withColumn("_salt", _salt(salts, item)).join(_spread(state, salts), [*keys, "_salt"]).drop("_salt")


def _shared(low: Column, high: Column) -> Column:
    """Bytes that two items, and so all between them, begin with: added up from powers of two."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    fits = lambda n, step: (n + step <= F.length(low)) & (F.substr(low, n + 1, step) == F.substr(high, n + 1, step))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))
