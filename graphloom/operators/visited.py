"""What searches have reached, as bits by ranges of ids, in few tables of falling size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_stash, stash

#: Ids of a row's bits: as many as Spark's bitmap functions hold.
RANGE = 32_768
#: Tables of pairs that are looked through as they are before they become bits.
RECENT = 8
#: Ranges of ids that a lookup names, so that only their rows are read; more aren't named.
NAMED = 1_000


class Visited:
    """Pairs ``source, to``, each added once.

    New pairs stay as tables of pairs; every :data:`RECENT` tables they are turned into bits, a row for each source and range of ids, and
    tables of bits are merged where they hold the same ranges as soon as one isn't twice as large as the next. So a lookup goes through a logarithm of tables, and a row is rewritten that often. Of
    many rows a lookup reads only those of the ranges that it needs.
    """

    def __init__(self) -> None:
        self.recent: list[DataFrame] = []
        self.levels: list[tuple[DataFrame, int]] = []
        #: Rows of bits that were written so far.
        self.written = 0

    def add(self, pairs: DataFrame) -> None:
        """``pairs`` is read again by later lookups, so it should be a written table."""
        self.recent.append(pairs.select("source", "to"))
        if len(self.recent) < RECENT:
            return
        every = reduce(DataFrame.unionByName, self.recent)
        bits = every.groupBy("source", _range("to").alias("range")).agg(F.bitmap_construct_agg(F.col("to") % RANGE).alias("bits"))
        self.recent = []
        self._push(bits)

    def _push(self, bits: DataFrame) -> None:
        table = stash(bits)
        rows = table.count()
        self.written += rows
        if self.levels and self.levels[-1][1] < 2 * rows:
            last, _ = self.levels.pop()
            self._push(last.unionByName(table).groupBy("source", "range").agg(F.bitmap_or_agg("bits").alias("bits")))
            drop_stash(last, table)
        else:
            self.levels.append((table, rows))

    @property
    def rows(self) -> int:
        """Rows of bits that a lookup without named ranges reads."""
        return sum(n for _, n in self.levels)

    def without(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` (``source, to`` and more) whose pair wasn't reached."""
        if self.recent:
            found = found.join(reduce(DataFrame.unionByName, self.recent), ["source", "to"], "left_anti")
        if not self.levels:
            return found
        bits = reduce(DataFrame.unionByName, [t for t, _ in self.levels])
        if self.rows > 10 * NAMED:
            found = stash(found)
            named = [r["r"] for r in found.select(_range("to").alias("r")).distinct().limit(NAMED + 1).collect()]
            bits = bits.where(F.col("range").isin(named)) if len(named) <= NAMED else bits
        if len(self.levels) > 1:
            bits = bits.groupBy("source", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
        held = found.withColumn("range", _range("to")).join(bits, ["source", "range"], "left")
        place = (F.col("to") % RANGE).cast("int")
        byte = F.conv(F.hex(F.substr("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.call_function("shiftright", byte, place % 8).bitwiseAND(F.lit(1)) == 1
        return held.where(~F.coalesce(there, F.lit(False))).select(*found.columns)


def _range(column: str) -> Column:
    return F.expr(f"{column} div {RANGE}")
