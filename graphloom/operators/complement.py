"""Complements without their n^2 cells: one weight for all pairs, and the pairs that are different."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio, single
from ..runtime import running_totals, stash
from .algebra import PowerIteration
from .components import component_roots
from .edges import DENSE_LIMIT
from .labels import simplify_labels
from .stats import Statistics

if TYPE_CHECKING:
    from ..model import Graph


class Complement(PowerIteration, Statistics):
    """A graph in which every pair has an edge of weight ``default``, but for ``cells``: ``src, dst, weight``, null where there is no edge.

    Without ``loops`` no vertex has an edge to itself, unless ``cells`` has one. Undirected ones hold both directions in ``cells``. What is asked of it
    costs as much as vertices and cells, never their square, but for :meth:`materialized`.
    """

    def __init__(self, cells: DataFrame, num_nodes: int, directed: bool, default: float, loops: bool):
        self.cells, self.num_nodes, self.directed, self.loops = cells, int(num_nodes), directed, loops
        self.default = cells.sparkSession.range(1).select(single(F.lit(float(default))).cast("double")).first()[0]

    @property
    def spark(self):
        return self.cells.sparkSession

    @property
    def nodes(self) -> DataFrame:
        return self.spark.range(self.num_nodes)

    def _like(self, cells: DataFrame, default: float | None = None) -> Complement:
        return Complement(cells, self.num_nodes, self.directed, self.default if default is None else default, self.loops)

    def checkpointed(self) -> Complement:
        return self._like(stash(self.cells))

    def require_undirected(self, what: str) -> None:
        if self.directed:
            raise ValueError(f"{what} is defined for undirected graphs")

    # Cells -----------------------------------------------------------------------------------------
    def get_edge(self, i: int, j: int) -> float:
        row = self._cell(i, j)
        return 0.0 if row is None else row

    def has_edge(self, i: int, j: int) -> bool:
        return self._cell(i, j) is not None

    def _cell(self, i: int, j: int) -> float | None:
        if not (0 <= i < self.num_nodes and 0 <= j < self.num_nodes):
            return None
        row = self.cells.where((F.col("src") == i) & (F.col("dst") == j)).first()
        return row["weight"] if row is not None else self.default if i != j or self.loops else None

    def out_edges(self, i: int) -> DataFrame:
        """The edges of one vertex, a row for each."""
        own = self.cells.where(F.col("src") == i).select("dst", F.col("weight").alias("_own"), F.lit(True).alias("_there"))
        every = self.nodes.select(F.col("id").alias("dst")).where(F.lit(0 <= i < self.num_nodes)).join(own, "dst", "left")
        weight = F.when(F.col("_there"), F.col("_own")).when(F.lit(self.loops) | (F.col("dst") != i), single(F.lit(self.default)))
        return every.select("dst", weight.alias("weight")).where("weight IS NOT NULL").orderBy("dst")

    def materialized(self, limit: int | None = DENSE_LIMIT) -> Graph:
        """The graph with all its cells."""
        from ..model import Graph

        every = Graph(self.cells, self.num_nodes, self.directed)._square("the complement", limit)
        own = self.cells.select("src", "dst", F.col("weight").alias("_own"), F.lit(True).alias("_there"))
        weight = F.when(F.col("_there"), F.col("_own")).when(F.lit(self.loops) | (F.col("src") != F.col("dst")), single(F.lit(self.default)))
        return Graph(every.join(own, ["src", "dst"], "left").select("src", "dst", weight.alias("weight")).where("weight IS NOT NULL"), self.num_nodes, self.directed)

    # Projections and filters -------------------------------------------------------------------------
    def transpose(self) -> Complement:
        return self._like(self.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def multiply_const(self, factor: float) -> Complement:
        w = single(F.col("weight").cast("double") * F.lit(float(factor)))
        return self._like(self.cells.withColumn("weight", w), self.default * float(factor))

    def clamp(self, low: float, high: float) -> Complement:
        w, a, b = F.col("weight"), single(F.lit(low)), single(F.lit(high))
        bounded = lambda x: F.when(F.isnan(x), x).when(x < a, a).when(x > b, b).otherwise(x)
        default = self.spark.range(1).select(bounded(single(F.lit(self.default))).cast("double")).first()[0]
        return self._like(self.cells.withColumn("weight", F.when(w.isNotNull(), bounded(w))), default)

    def filter_weights(self, low: float, high: float) -> Complement | Graph:
        """Edges of weight ``low`` to ``high``: a plain graph of a few cells if the common weight is outside."""
        from ..model import Graph

        inside = lambda x: F.isnan(x) | x.between(single(F.lit(low)), single(F.lit(high)))
        if self.spark.range(1).select(inside(single(F.lit(self.default)))).first()[0]:
            return self._like(self.cells.withColumn("weight", F.when(inside(F.col("weight")), F.col("weight"))))
        return Graph(self.cells.where(F.col("weight").isNotNull() & inside(F.col("weight"))), self.num_nodes, self.directed)

    def invert(self, max_weight: float = 1.0, self_loops: bool = True) -> Complement | Graph:
        """The complement again: a plain graph if the common weight vanishes, so the complement of a complement comes back as it was."""
        from ..model import Graph

        top = single(F.lit(max_weight))
        turned = F.when(F.col("weight").isNull(), top).otherwise(F.when(single(top - F.col("weight")) > 0, single(top - F.col("weight"))))
        cells = self.cells.withColumn("weight", turned)
        if not self.loops:
            # No edge to itself was there, so one is there now.
            held = cells.where("src = dst").select("src")
            cells = cells.unionByName(self.nodes.select(F.col("id").alias("src")).join(held, "src", "left_anti").select("src", F.col("src").alias("dst"), top.alias("weight")))
        if not self_loops:
            cells = cells.where("src <> dst")
        default = self.spark.range(1).select(single(top - single(F.lit(self.default))).cast("double")).first()[0]
        if default > 0:
            return Complement(cells, self.num_nodes, self.directed, default, self_loops)
        return Graph(cells.where("weight IS NOT NULL"), self.num_nodes, self.directed)

    # Aggregates --------------------------------------------------------------------------------------
    def counts(self) -> DataFrame:
        n, d = F.lit(self.num_nodes).cast("long"), F.lit(self.default)
        loop, there = F.col("src") == F.col("dst"), F.col("weight").isNotNull()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        own = self.cells.agg(F.count("*").alias("k"), F.count("weight").alias("p"), F.count_if(loop).alias("kd"), F.count_if(loop & there).alias("pd"), total("weight").alias("w"), total(F.when(loop, F.col("weight"))).alias("wd"))
        plain_loops = (n - F.col("kd")) if self.loops else F.lit(0).cast("long")
        plain = n * n - n - (F.col("k") - F.col("kd")) + plain_loops
        own = own.select((plain + F.col("p")).alias("cells"), (plain_loops + F.col("pd")).alias("diagonal"), (plain * d + F.col("w")).alias("w"), (plain_loops * d + F.col("wd")).alias("wd"))
        links, weights = (F.col("cells"), F.col("w")) if self.directed else (F.expr("(cells + diagonal) div 2"), (F.col("w") + F.col("wd")) / 2)
        return own.select(links.alias("links"), "cells", "diagonal", weights.alias("weights"))

    def _rows(self, side: str) -> DataFrame:
        """``id, plain, p, w`` for every vertex: pairs with the common weight, other edges, and their weight."""
        own = self.cells.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("k"), F.count("weight").alias("p"), F.sum("weight").alias("w"), F.count_if(F.col("src") == F.col("dst")).alias("kd"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        pairs = F.lit(self.num_nodes) - zero("k") - (F.lit(0) if self.loops else 1 - zero("kd"))
        return self.nodes.join(own, "id", "left").select("id", pairs.cast("long").alias("plain"), zero("p").alias("p"), F.coalesce("w", F.lit(0.0)).alias("w"))

    def out_degrees(self) -> DataFrame:
        return self._rows("src").select("id", (F.col("plain") + F.col("p")).alias("value"))

    def in_degrees(self) -> DataFrame:
        return self._rows("dst").select("id", (F.col("plain") + F.col("p")).alias("value"))

    def out_weights(self) -> DataFrame:
        return self._rows("src").select("id", (F.col("plain") * F.lit(self.default) + F.col("w")).alias("value"))

    def in_weights(self) -> DataFrame:
        return self._rows("dst").select("id", (F.col("plain") * F.lit(self.default) + F.col("w")).alias("value"))

    def out_degree(self, i: int) -> int:
        return self.out_degrees().where(F.col("id") == i).first()["value"]

    def in_degree(self, i: int) -> int:
        return self.in_degrees().where(F.col("id") == i).first()["value"]

    def reciprocity_table(self) -> DataFrame:
        if not self.directed:
            raise ValueError("reciprocity is defined for directed graphs")
        gone = self.cells.where("weight IS NULL AND src <> dst").select("src", "dst")
        # An edge has no reverse where only the reverse is missing.
        alone = gone.join(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").agg(F.count("*").alias("alone"))
        return self.counts().crossJoin(F.broadcast(alone)).select(ratio(F.col("cells") - F.col("alone"), F.col("cells")).alias("reciprocity"))

    def multiply_vector(self, vector: DataFrame) -> DataFrame:
        """ALG-6: the common weight times the vector's sum, corrected by the cells."""
        d = F.lit(self.default)
        held = self.nodes.join(vector.select("id", "value"), "id", "left").select("id", F.coalesce("value", F.lit(0.0)).cast("double").alias("_x"))
        whole = held.agg(F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_all"))
        met = self.cells.join(held.withColumnRenamed("id", "dst"), "dst")
        # A loop that isn't there by default takes nothing away.
        less = F.sum(F.when(F.lit(self.loops) | (F.col("src") != F.col("dst")), F.col("_x")).otherwise(0.0))
        own = met.groupBy(F.col("src").alias("id")).agg(less.alias("_less"), F.sum(F.col("weight").cast("double") * F.col("_x")).alias("_more"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        plain = F.col("_all") - zero("_less") - (F.lit(0.0) if self.loops else F.col("_x"))
        return held.join(own, "id", "left").crossJoin(F.broadcast(whole)).select("id", (d * plain + zero("_more")).alias("value"))

    def degree_anomalies(self) -> DataFrame:
        self.require_undirected("the degree anomaly")
        degrees = stash(self.out_degrees())
        near = self._like(self.cells.withColumn("weight", F.when(F.col("weight").isNotNull(), single(F.lit(1.0)))), 1.0).multiply_vector(degrees)
        return self._anomalies(degrees, near)

    def weight_anomalies(self) -> DataFrame:
        self.require_undirected("the weight anomaly")
        weights = stash(self.out_weights())
        return self._anomalies(weights, self.multiply_vector(weights))

    def _anomalies(self, own: DataFrame, near: DataFrame) -> DataFrame:
        both = own.select("id", F.col("value").alias("_own")).join(near.select("id", F.col("value").alias("_near")), "id")
        return both.select("id", F.when(F.col("_own") == 0, F.lit(0.0)).otherwise(F.col("_own") - ratio(F.col("_near"), F.col("_own"))).alias("value"))

    # Objectives --------------------------------------------------------------------------------------
    def _labelled(self, labels: DataFrame) -> DataFrame:
        own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
        return self.cells.join(own("src"), "src").join(own("dst"), "dst")

    def modularity_table(self, labels: DataFrame) -> DataFrame:
        """OBJ-1 from the sizes and strengths of the groups, and the cells within them."""
        n, d = F.lit(self.num_nodes), F.lit(self.default)
        loop = F.col("src") == F.col("dst")
        met = self._labelled(labels).where("_src = _dst").agg(F.count("*").alias("k"), F.count_if(loop).alias("kd"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
        sizes = labels.groupBy("label").agg(F.count("*").alias("size")).agg(F.coalesce(F.sum(F.col("size") * F.col("size")), F.lit(0)).alias("pairs"))
        strengths = self.out_weights().select("id", F.col("value").alias("o")).join(self.in_weights().select("id", F.col("value").alias("i")), "id").join(labels, "id")
        product = strengths.groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0)).alias("product"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("norm"))
        missing = F.lit(0) if self.loops else n - F.col("kd")
        inside = d * (F.col("pairs") - F.col("k") - missing) + F.col("w")
        # Single rows side by side.
        one = met.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(product))
        return one.select(ratio(inside - ratio(F.col("product"), F.col("norm")), F.col("norm")).alias("modularity"))

    def modularity(self, labels: DataFrame) -> float:
        return self.modularity_table(labels).first()["modularity"]

    def antimodularity_table(self, labels: DataFrame) -> DataFrame:
        """OBJ-3. A group sends each vertex its size times the common weight and a difference, which is 0 for most; squares and sums take the differences alone."""
        if self.directed:
            return self.spark.range(1).select(F.lit(float("nan")).alias("antimodularity"))
        n, d = F.lit(float(self.num_nodes)), F.lit(self.default)
        loop = F.col("src") == F.col("dst")
        plain = F.when(F.lit(self.loops) | ~loop, d).otherwise(F.lit(0.0))
        changes = self.cells.join(labels.select(F.col("id").alias("src"), "label"), "src").select("label", "dst", (F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) - plain).alias("_c"))
        if not self.loops:
            changes = changes.unionByName(labels.select("label", F.col("id").alias("dst"), (-d).alias("_c")))
        per = changes.groupBy("label", "dst").agg(F.sum("_c").alias("_c")).groupBy("label").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
        sizes = labels.groupBy("label").agg(F.count("*").cast("double").alias("_k")).join(per, "label", "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        base = d * F.col("_k")
        walks, weights = n * base * base + 2 * base * zero("_s") + zero("_q"), n * base + zero("_s")
        sums = sizes.agg(F.coalesce(F.sum(walks), F.lit(0.0)).alias("walks"), F.coalesce(F.sum(weights * weights), F.lit(0.0)).alias("expected"))
        return sums.select(ratio(F.col("walks") - ratio(F.col("expected"), n), n).alias("antimodularity"))

    def antimodularity(self, labels: DataFrame) -> float:
        return self.antimodularity_table(labels).first()["antimodularity"]

    # Components --------------------------------------------------------------------------------------
    def component_roots(self) -> DataFrame:
        """TRV-8 in time and rows that grow with the missing edges.

        All vertices that the one with the fewest missing edges still has an edge to are one component. It misses 2m/n of n vertices at most, if m edges are missing; the
        pairs of those, at most 2m, are looked at one by one.
        """
        self.require_undirected("a component")
        gone = stash(self.cells.where("weight IS NULL AND src <> dst").select("src", "dst"))
        degrees = stash(self.nodes.join(gone.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k")))
        pivot = degrees.agg(F.min_by("id", F.struct("k", "id")).alias("id")).first()["id"]
        if pivot is None:
            return self.nodes.select("id", F.col("id").alias("label"))
        missed = gone.where(F.col("src") == pivot).select(F.col("dst").alias("id"))
        rest = stash(running_totals(missed, [F.col("id")], {"no": F.lit(1).cast("long")}))
        r = rest.count()
        least = self.nodes.join(rest, "id", "left_anti").agg(F.min("id").alias("id")).first()["id"]
        named = lambda end, no: rest.select(F.col("id").alias(end), F.col("no").alias(no))
        among = gone.join(named("src", "a"), "src").join(named("dst", "b"), "dst").select("src", "dst")
        inner = among.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("in"))
        outside = degrees.join(rest.select("id"), "id").join(inner, "id", "left").where(F.col("k") - F.coalesce("in", F.lit(0)) < self.num_nodes - r)
        pairs = self.spark.range(r * r).select(F.expr(f"id div {max(r, 1)}").alias("a"), (F.col("id") % max(r, 1)).alias("b")).where("a < b")
        links = pairs.join(named("src", "a"), "a").join(named("dst", "b"), "b").select("src", "dst").join(among, ["src", "dst"], "left_anti")
        links = links.unionByName(outside.select(F.lit(least).cast("long").alias("src"), F.col("id").alias("dst")))
        roots = component_roots(links).select("id", "root")
        main = roots.where(F.col("id") == least).agg(F.coalesce(F.min("root"), F.lit(least)).alias("r")).first()["r"]
        own = self.nodes.join(roots, "id", "left").join(rest.select("id", F.lit(True).alias("_rest")), "id", "left")
        return own.select("id", F.coalesce("root", F.when(F.col("_rest"), F.col("id")).otherwise(F.lit(main))).cast("long").alias("label"))

    def connected_components(self) -> DataFrame:
        return simplify_labels(self.component_roots())
