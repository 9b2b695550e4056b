"""Mixing sources to target weights by a low-discrepancy schedule (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import running_totals, stash
from .common import WORD

#: 2^32 over the golden ratio, taken from 2^32 so that products fit into 64 bits, and its modulus.
STEP, RING = 1640531527, 1 << 32
#: Points of the ring are dealt into so many cells for the join with the cumulative weights.
CELLS = 4096
#: Slots are ranked in runs of so many.
RUN = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` with the place of each source in code point order, null last.

    Weights repeat along that order. A source's target stops at ``most`` times its size; what it
    can't take is shared again by weight. That ends where every open source has the same
    target per weight, so one pass over the sources by ``most * size / weight`` finds it: a source is
    full as long as what is left per open weight reaches its own ratio.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(per, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = placed.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    # Ratios are compared in whole numbers: most * size * (product of the other weights) would do; one common multiple is enough.
    common = 1
    for w in weights:
        common *= w
    ratio = F.col("source_size") * (common * most) / F.col("weight")
    filled = running_totals(
        placed.withColumn("_ratio", ratio), [F.col("_ratio"), F.col("place")], {"_full": F.col("source_size") * most, "_spent": F.col("weight").cast("long")}
    )
    filled = stash(filled)
    whole = filled.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    # One row, so the cross join below adds columns and no rows.
    open_ = filled.crossJoin(F.broadcast(whole)).withColumn("_level", (F.col("_all") * share - F.col("_full")) / (F.col("_weights") - F.col("_spent")))
    is_full = F.col("_level") * F.col("weight") >= F.col("source_size") * most
    marked = open_.withColumn("_is_full", is_full)
    level = marked.where(~F.col("_is_full")).agg(F.coalesce(F.min_by("_level", F.struct("_ratio", "place")), F.lit(0.0)).alias("_last"))
    return marked.crossJoin(F.broadcast(level)).select(
        "source",
        "place",
        "source_size",
        F.when(F.col("_is_full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("_last") * F.col("weight")).alias("target"),
    )


def schedule(goal: DataFrame, block_words: int) -> DataFrame:
    """``slot, place, rank``: the slots of the mix in order, each with its source and its rank there.

    Slot i sits at the i-th golden-ratio point of a ring of 2^32; the cumulative targets cut the
    ring into one arc for each source. The arcs are dealt into cells so that finding a point's arc is an
    equality join and a comparison. Sources with words to give whose arc no point meets, being narrower than the points are apart, get
    one slot each behind all others. Ranks come from counts for each run of slots and a window
    inside the run, so that no source has to pass through one task.
    """
    spark = goal.sparkSession
    arcs = running_totals(goal, [F.col("place")], {"_low": F.col("target")})
    arcs = stash(arcs)
    total = arcs.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()
    slots = -(-int(round(total["t"])) // block_words) if total["n"] else 0
    point = lambda c: F.least(F.floor(c / F.lit(total["t"] or 1.0) * RING), F.lit(RING))
    last = arcs.select("place", point(F.col("_low")).alias("_from"), point(F.col("_low") + F.col("target")).alias("_to")).where("_to > _from")
    wide = RING // CELLS
    cells = last.withColumn("_cell", F.explode(F.sequence(F.expr(f"_from div {wide}"), F.expr(f"(_to - 1) div {wide}"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % RING) * STEP % RING).alias("_at")).withColumn("_cell", F.expr(f"_at div {wide}"))
    met = stash(points.join(cells, "_cell").where("_at >= _from and _at < _to").select("slot", "place"))
    missed = arcs.where(F.round("target") > 0).join(met.select("place").distinct(), "place", "left_anti").select((F.col("place") + slots).alias("slot"), "place")
    dealt = met.unionByName(missed).withColumn("_run", F.expr(f"slot div {RUN}"))
    before = Window.partitionBy("place").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("place", "_run").count().select("place", "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("place", "_run").orderBy("slot")
    return dealt.withColumn("_n", F.row_number().over(inside) - 1).join(runs, ["place", "_run"]).select("slot", "place", (F.col("_before") + F.col("_n")).alias("rank"))


def mix(documents: DataFrame, block_words: int = 256, seed: int = 11, most: int = 2) -> DataFrame:
    """For each document what the mix takes of it: ``doc_id, size, source_size, target, taken``, ``first_pass, second_pass`` and ``first_slot``.

    The schedule has a slot for every ``block_words`` words of the mix. A source's documents are shuffled by a seeded hash and laid end to
    end, ``most`` times; the words of that stream up to the source's target, rounded to a word, are cut into as many blocks of equal size
    (to a word) as the source has slots, and its slot of rank r takes block r. So each source gives just its target, whatever its
    size, and the slots say in which order the words come: ``first_slot`` is the first that takes words of the document, null for none.

    Null or blank texts have size 0 and are never taken; a null source is a source; rows repeated
    with all their values stay separate rows (which of them is cut at a block's end isn't told apart).
    An empty table gives an empty result. Only ``doc_id``, ``text`` and ``source`` are read.
    """
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text"), F.lit(WORD))).cast("long")
    sizes = stash(documents.select("doc_id", "source", size.alias("size")))
    return taken(sizes, block_words, seed, most)


def _by_slots(laid: DataFrame, slots: DataFrame, most: int) -> DataFrame:
    """``laid`` with ``_taken``, ``_first`` and ``first_slot``: what the slots take of each document; null for none.

    Of a source's blocks the first ``_more`` have ``_wide + 1`` words, the others ``_wide``.
    """
    passes = laid.where("size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.select("place", "_at", "_pass", "_wide", "_more", (F.col("_at") + F.col("_pass") * F.col("source_size")).alias("_low"), "size", "_goal")
    passes = passes.where("_low < _goal").withColumn("_high", F.expr("least(_low + size, _goal)"))
    block = lambda w: F.expr(f"if({w} < _more * (_wide + 1), ({w}) div (_wide + 1), _more + ({w} - _more * (_wide + 1)) div greatest(_wide, 1))")
    pieces = passes.withColumn("rank", F.explode(F.sequence(block("_low"), block("_high - 1"))))
    words = F.expr("least(_high, (rank + 1) * _wide + least(rank + 1, _more)) - greatest(_low, rank * _wide + least(rank, _more))")
    pieces = pieces.select("place", "rank", "_at", "_pass", words.alias("_words"))
    found = pieces.join(slots, ["place", "rank"]).groupBy(F.col("place").alias("_p"), F.col("_at").alias("_a")).agg(
        F.sum("_words").alias("_taken"), F.sum(F.when(F.col("_pass") == 0, F.col("_words"))).alias("_first"), F.min("slot").alias("first_slot")
    )
    # A place in its source's stream names a document that has words.
    return laid.join(found, (F.col("place") == F.col("_p")) & (F.col("_at") == F.col("_a")) & (F.col("size") > 0), "left")


def taken(sizes: DataFrame, block_words: int, seed: int, most: int, *keep: str) -> DataFrame:
    """:func:`mix` from ``doc_id, source, size``; columns named in ``keep`` are carried along."""
    goal = stash(targets(sizes, most=most))
    slots = stash(schedule(goal, block_words))
    # Shuffled by a digest that SQL engines share.
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    order = [F.col("source").asc_nulls_last(), shuffled, F.col("doc_id"), F.col("size"), *map(F.col, keep)]
    laid = running_totals(sizes, order, {"_start": F.col("size")})
    laid = laid.withColumn("_s1", F.coalesce(F.col("source"), F.lit(""))).withColumn("_s2", F.col("source").isNull())
    # Where a source's stream begins: the sizes of all sources before it.
    begins = running_totals(goal, [F.col("place")], {"_begin": F.col("source_size")})
    # The source's target as whole words and how they fall into blocks, one for each of its slots.
    begins = begins.join(slots.groupBy("place").agg(F.count("*").alias("_slots")), "place", "left").withColumn("_goal", F.round("target").cast("long"))
    begins = begins.withColumn("_wide", F.expr("_goal div coalesce(_slots, 1)")).withColumn("_more", F.expr("_goal % coalesce(_slots, 1)"))
    begins = begins.select(F.coalesce(F.col("source"), F.lit("")).alias("_s1"), F.col("source").isNull().alias("_s2"), "place", "source_size", "target", "_begin", "_goal", "_wide", "_more")
    laid = stash(laid.join(begins, ["_s1", "_s2"]).withColumn("_at", F.col("_start") - F.col("_begin")).drop("_s1", "_s2", "_start", "_begin"))
    out = _by_slots(laid, slots, most)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        *keep,
        "size",
        "source_size",
        "target",
        count("_taken").alias("taken"),
        count("_first").alias("first_pass"),
        (count("_taken") - count("_first")).alias("second_pass"),
        "first_slot",
    )


def mixed_documents(documents: DataFrame, block_words: int = 256, seed: int = 11, most: int = 2) -> DataFrame:
    """The mix itself: for each pass over a source that takes words of a document one row with these words, in all columns of ``documents``.

    A document that a pass takes whole comes back as it is; at the end of a source's last block one document is cut behind the last word that
    is taken. Documents without words are never taken. ``n_chars``, where there is such a column, follows the text. Repeated rows are rows of
    their own, each with its own place in the stream: together they come back with just the words that :func:`mix` takes.
    """
    # Rows are told apart by a number of their own, written once so that it stays; no key is hot, however often a row is there.
    held = stash(documents.select(F.struct(*documents.columns).alias("row"), F.monotonically_increasing_id().alias("_row")))
    text = F.col("row.text")
    size = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    sizes = stash(held.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), size.alias("size"), F.xxhash64(text).alias("_k1"), "_row"))
    takes = taken(sizes, block_words, seed, most, "_k1", "_row").where("taken > 0").select("_row", "size", F.array("first_pass", "second_pass").alias("_takes"))
    # Numbers and counts are hashed, so that the texts needn't be sorted.
    met = held.join(takes.hint("shuffle_hash"), "_row")
    each = met.select("row", "size", F.explode("_takes").alias("_take")).where("_take > 0")
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("_take").cast("int"))
    new = F.when(F.col("_take") == F.col("size"), text).otherwise(F.array_join(words, ""))
    changed = {"text": F.col("_new")} | ({"n_chars": F.char_length("_new").cast("long")} if "n_chars" in documents.columns else {})
    return each.select("row", new.alias("_new")).select(*[changed.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
