"""Aggregates over edges: counts, degrees, weights, and local structure."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..runtime import stash

if TYPE_CHECKING:
    from ..model import Graph


class Statistics:
    def counts(self: Graph) -> DataFrame:
        """AGG-1 to AGG-4 in one pass: ``links, cells, diagonal, weights``; undirected edges count once."""
        loops = F.count_if(F.col("src") == F.col("dst"))
        weights, own = F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight"))), F.lit(0.0))
        links = F.count("*") if self.directed else F.expr("(count(*) + count_if(src = dst)) div 2")
        return self.cells.agg(links.alias("links"), F.count("*").alias("cells"), loops.alias("diagonal"), (weights if self.directed else (weights + own) / 2).alias("weights"))

    def count_links(self: Graph, directed: bool | None = None) -> int:
        row = self.counts().first()
        return row["cells"] if (self.directed if directed is None else directed) else row["links"]

    def count_links_diagonal(self: Graph) -> int:
        return self.counts().first()["diagonal"]

    def sum_weights(self: Graph) -> float:
        return self.counts().first()["weights"]

    def _per_vertex(self: Graph, side: str, value: Column, zero: Column) -> DataFrame:
        own = self.cells.groupBy(F.col(side).alias("id")).agg(value.alias("value"))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("value", zero).alias("value"))

    def out_degrees(self: Graph) -> DataFrame:
        """AGG-5. ``id, value`` for every vertex; a self-loop counts once."""
        return self._per_vertex("src", F.count("*"), F.lit(0).cast("long"))

    def in_degrees(self: Graph) -> DataFrame:
        """AGG-6."""
        return self._per_vertex("dst", F.count("*"), F.lit(0).cast("long"))

    def out_weights(self: Graph) -> DataFrame:
        """AGG-7."""
        return self._per_vertex("src", F.sum("weight"), F.lit(0.0))

    def in_weights(self: Graph) -> DataFrame:
        """AGG-8."""
        return self._per_vertex("dst", F.sum("weight"), F.lit(0.0))

    def out_degree(self: Graph, i: int) -> int:
        return self.cells.where(F.col("src") == i).count()

    def in_degree(self: Graph, i: int) -> int:
        return self.cells.where(F.col("dst") == i).count()

    def degree_anomalies(self: Graph) -> DataFrame:
        """AGG-9. Degree less the mean degree of the neighbours, 0 without any."""
        self.require_undirected("the degree anomaly")
        degrees = self.cells.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_d"))
        own = self.cells.join(degrees, "dst").groupBy(F.col("src").alias("id")).agg((F.count("*") - F.sum("_d") / F.count("*")).alias("value"))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def weight_anomalies(self: Graph) -> DataFrame:
        """AGG-10. Weight less the weighted mean of the neighbours' weights, 0 where the weight is 0."""
        self.require_undirected("the weight anomaly")
        weights = self.cells.groupBy(F.col("src").alias("dst")).agg(F.sum("weight").alias("_w"))
        own = self.cells.join(weights, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("_own"), F.sum(F.col("weight").cast("double") * F.col("_w")).alias("_near"))
        value = F.when(F.col("_own") == 0, F.lit(0.0)).otherwise(F.col("_own") - ratio(F.col("_near"), F.col("_own")))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("value"))

    def density_table(self: Graph) -> DataFrame:
        """AGG-11. Links over possible links; NaN with self-loops."""
        n = self.num_nodes
        most = n * (n - 1) if self.directed else n * (n - 1) // 2
        return self.counts().select(F.when(F.col("diagonal") > 0, F.lit(float("nan"))).otherwise(ratio(F.col("links"), F.lit(most))).alias("density"))

    def density(self: Graph) -> float:
        return self.density_table().first()["density"]

    def reciprocity_table(self: Graph) -> DataFrame:
        """AGG-12. Share of the cells whose reverse exists, self-loops among them; NaN without edges."""
        if not self.directed:
            raise ValueError("reciprocity is defined for directed graphs")
        turned = self.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_back"))
        return self.cells.join(turned, ["src", "dst"], "left").agg(ratio(F.count("_back"), F.count("*")).alias("reciprocity"))

    def reciprocity(self: Graph) -> float:
        return self.reciprocity_table().first()["reciprocity"]

    def _closed_links(self: Graph) -> DataFrame:
        """``a, b, cs``: for each link the vertices that close it to a triangle, so that each triangle stands in one row.

        Links point from the lower to the higher degree (ties by id), so that even a hub has few outgoing links. The lists of targets are written once; a
        link's two lists meet and are intersected, which moves lists and not every pair of targets.
        """
        self.require_undirected("a triangle")
        plain = self.cells.where("src <> dst").select("src", "dst")
        degrees = plain.groupBy("src").agg(F.count("*").alias("d"))
        ends = plain.join(degrees, "src").withColumnRenamed("d", "_ds").join(degrees.select(F.col("src").alias("dst"), F.col("d").alias("_dd")), "dst")
        near = stash(ends.where(F.struct("_ds", "src") < F.struct("_dd", "dst")).groupBy("src").agg(F.collect_list("dst").alias("near")))
        links = near.select(F.col("src").alias("a"), "near", F.explode("near").alias("b"))
        met = links.join(near.select(F.col("src").alias("b"), F.col("near").alias("_near2")), "b")
        return met.select("a", "b", F.array_intersect("near", "_near2").alias("cs")).where(F.size("cs") > 0)

    def triangles(self: Graph) -> DataFrame:
        """``a, b, c``: each triangle once."""
        return self._closed_links().select("a", "b", F.explode("cs").alias("c"))

    def _triples(self: Graph) -> DataFrame:
        return self.cells.where("src <> dst").groupBy(F.col("src").alias("id")).agg((F.count("*") * (F.count("*") - 1)).alias("_triples"))

    def transitivity_table(self: Graph) -> DataFrame:
        """AGG-13. Closed ordered triples over all; 0 without a triangle."""
        closed, every = self._closed_links().agg((6 * F.coalesce(F.sum(F.size("cs")), F.lit(0))).alias("_closed")), self._triples().agg(F.coalesce(F.sum("_triples"), F.lit(0)).alias("_every"))
        # Two single rows.
        return closed.crossJoin(F.broadcast(every)).select(F.when(F.col("_closed") == 0, F.lit(0.0)).otherwise(ratio(F.col("_closed"), F.col("_every"))).alias("transitivity"))

    def transitivity(self: Graph) -> float:
        return self.transitivity_table().first()["transitivity"]

    def clustering_coefficient(self: Graph) -> DataFrame:
        """AGG-14. ``id, value``: closed ordered triples at the vertex over all of its triples; 0 without a triangle."""
        # A link's ends are in all of its triangles, each closing vertex in one.
        n = F.size("cs")
        ends = F.concat(F.array(F.struct(F.col("a").alias("id"), n.alias("n")), F.struct(F.col("b").alias("id"), n.alias("n"))), F.transform("cs", lambda c: F.struct(c.alias("id"), F.lit(1).alias("n"))))
        closed = self._closed_links().select(F.inline(ends)).groupBy("id").agg((2 * F.sum("n")).alias("_closed"))
        own = self._triples().join(closed, "id").select("id", ratio(F.col("_closed"), F.col("_triples")).alias("value"))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
