"""Contraction of vertices: vertex ``index1`` is merged into ``index0`` and stays without edges.

Equal indices, or ones out of range, change nothing.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..model import Graph


class Contraction:
    def _idle(self: Graph, i0: int, i1: int) -> bool:
        return i0 == i1 or not (0 <= i0 < self.num_nodes and 0 <= i1 < self.num_nodes)

    def merge_nodes_add(self: Graph, index0: int, index1: int) -> Graph:
        """MRG-1. Parallel edges add up; over both directions the new self-loop is the sum of all four cells between the two."""
        if self._idle(index0, index1):
            return self
        to = lambda c: F.when(F.col(c) == index1, F.lit(index0).cast("long")).otherwise(F.col(c))
        moved = self.cells.select(to("src").alias("src"), to("dst").alias("dst"), "weight")
        return self.like(moved.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))

    def contract(self: Graph, labels: DataFrame) -> Graph:
        """Many merges at once: vertices become their labels, parallel edges add up. Labels have to be vertex ids."""
        own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_to"))
        moved = self.cells.join(own("src"), "src").join(own("dst"), "dst").groupBy("src_to", "dst_to").agg(F.sum("weight").alias("weight"))
        return self.like(moved.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"), "weight"))

    def merge_nodes_min(self: Graph, index0: int, index1: int) -> Graph:
        """MRG-2. Where ``index1`` has an edge the lesser weight; an edge that ``index0`` lacks counts as 0."""
        return self._pick(index0, index1, F.least)

    def merge_nodes_max(self: Graph, index0: int, index1: int) -> Graph:
        """MRG-3. Where ``index1`` has an edge the greater weight; an edge that ``index0`` lacks counts as 0."""
        return self._pick(index0, index1, F.greatest)

    def _pick(self: Graph, i0: int, i1: int, pick) -> Graph:
        """Directed graphs: rows first, then columns, so a cell made in the first pass takes part in the second.

        Undirected graphs: rows of the other vertices, mirrored; the self-loop of ``index0`` meets the edge between the two
        and the self-loop of ``index1``, those of them that there are.
        """
        if self._idle(i0, i1):
            return self
        if self.directed:
            return self.like(self._fold(self._fold(self.cells, "src", "dst", i0, i1, pick), "dst", "src", i0, i1, pick))
        pair = F.col("src").isin(i0, i1), F.col("dst").isin(i0, i1)
        outer = self._fold(self.cells.where(pair[0] & ~pair[1]), "src", "dst", i0, i1, pick)
        own = F.max(F.when((F.col("src") == i0) & (F.col("dst") == i0), F.col("weight")))
        other = [F.max(F.when((F.col("src") == a) & (F.col("dst") == i1), F.col("weight"))) for a in (i0, i1)]
        zero, few = F.lit(0.0).cast("float"), self.cells.where(pair[0] & pair[1]).agg(own.alias("w0"), *[c.alias(f"w{k + 1}") for k, c in enumerate(other)])
        met = pick(F.coalesce("w0", zero), F.coalesce("w1", "w2"), F.coalesce("w2", "w1"))
        loop = few.select(F.lit(i0).cast("long").alias("src"), F.lit(i0).cast("long").alias("dst"), F.when(F.col("w1").isNull() & F.col("w2").isNull(), F.col("w0")).otherwise(met).alias("weight")).where("weight is not null")
        rest = self.cells.where(~pair[0] & ~pair[1])
        return self.like(rest.unionByName(outer).unionByName(outer.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).unionByName(loop))

    @staticmethod
    def _fold(cells: DataFrame, side: str, other: str, i0: int, i1: int, pick) -> DataFrame:
        touched = cells.where(F.col(side).isin(i0, i1)).groupBy(other).agg(
            F.max(F.when(F.col(side) == i0, F.col("weight"))).alias("w0"), F.max(F.when(F.col(side) == i1, F.col("weight"))).alias("w1")
        )
        zero = F.lit(0.0).cast("float")
        new = F.when(F.col("w1").isNull(), F.col("w0")).otherwise(pick(F.coalesce("w0", zero), F.col("w1")))
        made = touched.select(F.lit(i0).cast("long").alias(side), other, new.alias("weight"))
        return cells.where(~F.col(side).isin(i0, i1)).unionByName(made.select("src", "dst", "weight"))

    def merge_nodes_custom(self: Graph, index0: int, index1: int, alpha1: float, alpha2: float, beta: float, gamma: float) -> Graph:
        """MRG-4. Lance-Williams update ``alpha1 d0k + alpha2 d1k + beta d01 + gamma |d0k - d1k|`` for each neighbour k of ``index1``.

        Edges that only ``index0`` has stay, its self-loop goes.
        """
        self.require_undirected("a custom merge")
        if self._idle(index0, index1):
            return self
        i0, i1 = index0, index1
        both = self.cells.where(F.col("src").isin(i0, i1)).groupBy("dst").agg(
            F.max(F.when(F.col("src") == i0, F.col("weight"))).cast("double").alias("d0"), F.max(F.when(F.col("src") == i1, F.col("weight"))).cast("double").alias("d1")
        )
        # The weight between the two: one row, none if they aren't linked.
        link = both.agg(F.coalesce(F.max(F.when(F.col("dst") == i1, F.col("d0"))), F.lit(0.0)).alias("d01"))
        d0: Column = F.coalesce("d0", F.lit(0.0))
        new = alpha1 * d0 + alpha2 * F.col("d1") + beta * F.col("d01") + gamma * F.abs(d0 - F.col("d1"))
        made = both.where(~F.col("dst").isin(i0, i1)).crossJoin(F.broadcast(link)).select(F.lit(i0).cast("long").alias("src"), "dst", F.when(F.col("d1").isNull(), F.col("d0")).otherwise(new).cast("float").alias("weight"))
        rest = self.cells.where(~F.col("src").isin(i0, i1) & ~F.col("dst").isin(i0, i1))
        return self.like(rest.unionByName(made).unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
