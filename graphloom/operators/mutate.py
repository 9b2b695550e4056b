"""Edits of edges, one by one or in batches: unions and joins that give a new graph.

Pairs out of range are ignored. In undirected graphs a batch is mirrored first, so both cells change, a self-loop once.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..model import Graph

Rows = DataFrame | Iterable[tuple]


class Mutation:
    def _batch(self: Graph, rows: Rows) -> DataFrame:
        """``seq, src, dst, weight`` in range, mirrored if need be. Tables bring their own ``seq`` (0 if they have none)."""
        if isinstance(rows, DataFrame):
            batch = rows.select(
                (F.col("seq") if "seq" in rows.columns else F.lit(0)).cast("long").alias("seq"),
                F.col("src").cast("long").alias("src"),
                F.col("dst").cast("long").alias("dst"),
                (F.col("weight") if "weight" in rows.columns else F.lit(1.0)).cast("float").alias("weight"),
            )
        else:
            made = [(k, int(r[0]), int(r[1]), float(r[2]) if len(r) > 2 else 1.0) for k, r in enumerate(rows)]
            batch = self.spark.createDataFrame(made, "seq long, src long, dst long, weight float")
        n = self.num_nodes
        batch = batch.where(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
        if not self.directed:
            batch = batch.unionByName(batch.where("src <> dst").select("seq", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return batch

    def set_edges(self: Graph, rows: Rows) -> Graph:
        """MUT-1. Overwrite; of several weights for a pair the last (greatest ``seq``) holds."""
        both = self.cells.select(F.lit(-1).cast("long").alias("seq"), "src", "dst", "weight").unionByName(self._batch(rows))
        return self.like(both.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight")))

    def add_edges(self: Graph, rows: Rows) -> Graph:
        """MUT-2. Add to the weight; an absent edge counts as 0."""
        both = self.cells.select("src", "dst", "weight").unionByName(self._batch(rows).drop("seq"))
        return self.like(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))

    def min_edges(self: Graph, rows: Rows) -> Graph:
        """MUT-3. The lesser of both weights; an absent edge is made and counts as 0."""
        return self._extreme(rows, F.min, F.least)

    def max_edges(self: Graph, rows: Rows) -> Graph:
        """MUT-4. The greater of both weights; an absent edge is made and counts as 0."""
        return self._extreme(rows, F.max, F.greatest)

    def _extreme(self: Graph, rows: Rows, fold, pick) -> Graph:
        batch = self._batch(rows).groupBy("src", "dst").agg(fold("weight").alias("_new"))
        both = self.cells.join(batch, ["src", "dst"], "full_outer")
        zero = F.lit(0.0).cast("float")
        return self.like(both.select("src", "dst", F.when(F.col("_new").isNull(), F.col("weight")).otherwise(pick(F.coalesce("weight", zero), F.col("_new"))).alias("weight")))

    def del_edges(self: Graph, rows: Rows) -> Graph:
        """MUT-5. Absent edges may be deleted, too."""
        return self.like(self.cells.join(self._batch(rows).select("src", "dst"), ["src", "dst"], "left_anti"))

    def set_edge(self: Graph, i: int, j: int, weight: float = 1.0) -> Graph:
        return self.set_edges([(i, j, weight)])

    def add_edge(self: Graph, i: int, j: int, weight: float = 1.0) -> Graph:
        return self.add_edges([(i, j, weight)])

    def min_edge(self: Graph, i: int, j: int, weight: float) -> Graph:
        return self.min_edges([(i, j, weight)])

    def max_edge(self: Graph, i: int, j: int, weight: float) -> Graph:
        return self.max_edges([(i, j, weight)])

    def del_edge(self: Graph, i: int, j: int) -> Graph:
        return self.del_edges([(i, j)])
