"""Line deduplication by a deletion-neighbourhood join (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import drop_stash, ended_shuffles, running_totals, stash
from .common import fresh, row_key


def _plain(line: str) -> Column:
    """The line's words with single spaces between them; a line that is so already, as nearly all are, isn't searched by pattern."""
    own = F.col(line)
    odd = own.startswith(" ") | own.endswith(" ")
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | own.contains(mark)
    return F.when(odd, F.trim(F.regexp_replace(own, r"[\x20\x09-\x0D]+", " "))).otherwise(own)


def _lines(documents: DataFrame) -> DataFrame:
    """``_k1, _k2, doc, line_no, plain`` for each line of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(F.col("doc_id").alias("doc"), F.split(text, "\n", -1).alias("_lines"), *row_key("doc_id", "text"))
    return keyed.select("_k1", "_k2", "doc", F.posexplode("_lines").alias("line_no", "_line")).select("_k1", "_k2", "doc", "line_no", _plain("_line").alias("plain"))


def _line_key() -> list[Column]:
    """128 bits for a line's word sequence: equal lines are equal word for word, whatever the white space."""
    return [F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(7), F.col("plain")).alias("h2")]


def _halves() -> Column:
    """Keys of which two lines share one if they are within one edit: halves of a line, as itself and as the longer of a pair.

    An edit leaves one half as it was. A pair of n and n + 1 words is compared as n words, so the longer line also
    stands with the halves that it has when a word of the other half is gone. ``n`` has the number of words.
    """
    def part(size: str, side: int, count: str) -> Column:
        return F.expr(f"xxhash64({size}, {side}, substring_index(plain, ' ', {count}))")

    return F.array(part("n", 1, "n div 2"), part("n", 2, "n div 2 - n"), part("n - 1", 1, "(n - 1) div 2"), part("n - 1", 2, "(n - 1) div 2 + 1 - n"))


def _order() -> Column:
    """Documents by id, null last; rows with one id by text; then lines from the top."""
    return F.struct(F.col("doc").isNull().alias("late"), F.col("doc").alias("doc"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("line_no").alias("line_no"))


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """``rank, gone, v1, v2``: each line's variants with one word gone (its place in ``gone``) and the line itself (-1).

    A sequence's key is the exclusive or of hashes of word and place, so leaving out word i takes the places before it
    as they are and those after it one lower. Running exclusive ors give all n variants in n steps, also for a
    line of a million words.
    """
    words = texts.select("rank", F.posexplode("words").alias("gone", "_w"))
    here = {s: F.xxhash64(F.lit(s), F.col("_w"), F.col("gone")) for s in (1, 2)}
    lower = {s: F.xxhash64(F.lit(s), F.col("_w"), F.col("gone") - 1) for s in (1, 2)}
    words = words.select("rank", "gone", *[c.alias(f"x{s}") for s, c in here.items()], *[c.alias(f"y{s}") for s, c in lower.items()])
    line = Window.partitionBy("rank").orderBy("gone")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    rest = lambda s: F.expr(f"bit_xor(y{s})").over(every).bitwiseXOR(F.expr(f"bit_xor(y{s})").over(after))
    start = {s: F.coalesce(F.expr(f"bit_xor(x{s})").over(before), zero) for s in (1, 2)}
    made = words.select(
        "rank", "gone", *[c.bitwiseXOR(rest(s)).alias(f"v{s}") for s, c in start.items()], *[c.bitwiseXOR(F.col(f"x{s}")).alias(f"w{s}") for s, c in start.items()], F.lead("gone").over(line).isNull().alias("_end")
    )
    own = F.array(F.struct("gone", "v1", "v2"))
    whole = F.array(F.struct(F.lit(-1).alias("gone"), F.col("w1").alias("v1"), F.col("w2").alias("v2")))
    return made.select("rank", F.inline(F.when(F.col("_end"), F.concat(own, whole)).otherwise(own)))


def _without(words: str, gone: str) -> Column:
    place = F.col(gone)
    return F.when(place < 0, F.col(words)).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(place, F.lit(0))), F.slice(words, F.greatest(place, F.lit(0)) + 2, F.size(words))))


def near_lines(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h1, h2`` of the distinct lines that are one word edit away from a line that stands earlier.

    ``distinct`` has ``h1, h2, at, halves`` with ``at`` the first place of the line, and no halves for lines that are too short.
    """
    # Lines that share a half with no other line have no neighbour; only the others make their neighbourhoods.
    keyed = distinct.where(F.col("halves").isNotNull()).select("h1", "h2", F.explode("halves").alias("_half"))
    shared = keyed.groupBy("_half").agg(F.count("*").alias("_n")).where("_n > 1").select("_half")
    live = fresh(keyed, "_half").join(fresh(shared, "_half"), "_half", "left_semi").select("h1", "h2").distinct()
    placed = distinct.select("h1", "h2", "at").join(live, ["h1", "h2"], "left_semi")
    # From here on a line is its rank in the order of first places.
    placed = stash(running_totals(placed, [F.col("at")], {"rank": F.lit(1).cast("long")}))
    wanted = placed.groupBy(F.col("at.k1").alias("_w1"), F.col("at.k2").alias("_w2")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("no"), F.col("rank").alias("rank"))).alias("_wanted"))
    text = F.coalesce(F.col("text"), F.lit(""))
    holders = documents.select(*row_key("doc_id", "text"), text.alias("_text")).join(wanted.hint("shuffle_hash"), (F.col("_k1") == F.col("_w1")) & (F.col("_k2") == F.col("_w2")))
    split = holders.select("_wanted", F.split("_text", "\n", -1).alias("_lines"))
    picked = split.select(F.explode("_wanted").alias("_w"), "_lines").select("_w.rank", F.element_at("_lines", F.col("_w.no") + 1).alias("_line"))
    # A document that is there several times gives its lines as often.
    texts = stash(picked.select("rank", F.split(_plain("_line"), " ").alias("words")).groupBy("rank").agg(F.first("words").alias("words")))
    rows = stash(_neighbourhoods(texts))
    # A word replaced: both lines are equal without the word at one place. A word more or less: a line equals the other without a word.
    # Whatever a group's size, its earliest row is all that the others have to look at.
    pair = lambda condition: F.min(F.when(condition, F.struct("rank", "gone")))
    same = rows.where("gone >= 0").groupBy("v1", "v2", "gone").agg(F.min("rank").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = same.select(F.bitwise_not("v1").alias("_g1"), F.col("v2").alias("_g2"), F.col("gone").alias("_gone"), F.struct(F.col("_first").alias("rank"), "gone").alias("_hit"))
    by_kind = rows.groupBy("v1", "v2").agg(pair(F.col("gone") < 0).alias("_full"), pair(F.col("gone") >= 0).alias("_cut")).where("_full is not null and _cut is not null")
    by_kind = by_kind.select(F.bitwise_not("v1").alias("_g1"), F.col("v2").alias("_g2"), "_full", "_cut")
    on = (F.bitwise_not("v1") == F.col("_g1")) & (F.col("v2") == F.col("_g2"))
    replaced = rows.join(same, on & (F.col("gone") == F.col("_gone"))).select("rank", "gone", F.col("_hit").alias("_other"))
    longer = rows.join(by_kind, on).select("rank", "gone", F.when(F.col("gone") < 0, F.col("_cut")).otherwise(F.col("_full")).alias("_other"))
    claims = replaced.unionByName(longer).where(F.col("_other.rank") < F.col("rank")).groupBy("rank").agg(F.min(F.struct(F.col("_other.rank").alias("other"), F.col("gone"), F.col("_other.gone").alias("there"))).alias("c"))
    claims = stash(claims.select("rank", "c.*"))
    # Each claim is verified on the words themselves.
    proven = claims.join(texts, "rank").join(texts.select(F.col("rank").alias("_r2"), F.col("words").alias("_words2")), F.col("other") == F.col("_r2"))
    proven = proven.where(_without("words", "gone") == _without("_words2", "there")).select("rank")
    found = stash(placed.join(proven, "rank", "left_semi").select("h1", "h2"), 2 * placed.count())
    drop_stash(placed, rows, texts, claims)
    return found


def line_dedup(documents: DataFrame, least_words: int = 5, columns: bool = False) -> DataFrame:
    """Documents without lines that repeat an earlier line, word for word or but for one word.

    Lines are split at line feeds and compared as word sequences. A line goes if an equal line, or one at word edit
    distance 1 where both have ``least_words`` words or more (so that four words of five agree), stands earlier in the corpus: in a
    smaller doc_id (null last) or further up. Whether that earlier line goes itself makes no difference. Lines without words
    stay. Returns ``doc_id, text, n_lines, n_removed``, or with ``columns`` all columns with the new ``text`` and ``n_chars``.

    A null text stays null and has no lines; an empty one has one line without words. Rows with equal doc_id and text are one
    document for this purpose and come back as often as they came. An empty table gives an empty result.
    """
    # One after the other these steps exchange several times the input; what a step has exchanged goes when it is written.
    with ended_shuffles(documents.sparkSession):
        lines = _lines(documents).where(F.col("plain") != "").withColumn("n", F.char_length("plain") - F.char_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
        lines = stash(lines.select("_k1", "_k2", "doc", "line_no", *_line_key(), F.when(F.col("n") >= least_words, _halves()).alias("halves")))
        distinct = stash(lines.groupBy("h1", "h2").agg(F.min(_order()).alias("at"), F.count("*").alias("n"), F.first("halves").alias("halves")), lines.count())
        near = near_lines(documents, distinct)
        judged = distinct.select("h1", "h2", "at", "n").join(near.withColumn("_near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or _near is not null")
        judged = stash(judged.select(F.bitwise_not("h1").alias("_g1"), F.col("h2").alias("_g2"), "at", "_near"))
    drop_stash(distinct, near)
    going = lines.drop("halves").join(judged, (F.bitwise_not("h1") == F.col("_g1")) & (F.col("h2") == F.col("_g2"))).where(F.col("_near").isNotNull() | (_order() != F.col("at")))
    gone = going.groupBy("_k1", "_k2").agg(F.collect_set("line_no").alias("_gone")).select(F.col("_k1").alias("_g1"), F.col("_k2").alias("_g2"), "_gone")
    # Other columns travel in one struct, so that no name of theirs can clash.
    keyed = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", "text", *row_key("doc_id", "text"))
    # The small side is hashed, so that the texts needn't be sorted.
    joined = keyed.join(gone.hint("shuffle_hash"), (F.col("_k1") == F.col("_g1")) & (F.col("_k2") == F.col("_g2")), "left")
    parts = F.split("text", "\n", -1)

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")

    # The lines are bound to a name, else each line that stays would split the text again.
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(parts), rest), 1))
    if columns:
        changed = {"text": F.col("_new")} | ({"n_chars": F.char_length("_new").cast("long")} if "n_chars" in documents.columns else {})
        return joined.select("row", text.alias("_new")).select(*[changed.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return joined.select("doc_id", text.alias("_new"), n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")).withColumnRenamed("_new", "text")
