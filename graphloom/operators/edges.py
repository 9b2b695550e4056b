"""Filters, projections and access to cells."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import single

if TYPE_CHECKING:
    from ..model import Graph
    from .complement import Complement

#: Dense results have the square of the vertex count as rows; for more vertices than this they have to be asked for with ``limit=None``.
DENSE_LIMIT = 20_000


class EdgeAccess:
    def has_edge(self: Graph, i: int, j: int) -> bool:
        """FLT-1. Pairs out of range have no edge."""
        return not self.cells.where((F.col("src") == i) & (F.col("dst") == j)).isEmpty()

    def get_edge(self: Graph, i: int, j: int) -> float:
        """FLT-2. Weight of the cell, 0 where there is none."""
        return self.cells.where((F.col("src") == i) & (F.col("dst") == j)).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("w")).first()["w"]

    def out_edges(self: Graph, i: int, limit: int | None = None) -> DataFrame:
        """FLT-3, ITR-1. Neighbours of ``i`` by id, at most ``limit`` of them."""
        found = self.cells.where(F.col("src") == i).select("dst", "weight").orderBy("dst")
        return found if limit is None else found.limit(limit)

    def out_edges_reversed(self: Graph, i: int) -> DataFrame:
        """ITR-1 from the greatest id down."""
        return self.cells.where(F.col("src") == i).select("dst", "weight").orderBy(F.desc("dst"))

    def edges(self: Graph, limit: int | None = None) -> DataFrame:
        """SNK-6. Each edge once (undirected: ``dst >= src``) in order; :meth:`count_links` tells how many there are."""
        found = (self.cells if self.directed else self.cells.where("dst >= src")).orderBy("src", "dst")
        return found if limit is None else found.limit(limit)

    def lower_triangle(self: Graph) -> DataFrame:
        """ITR-3. Cells with ``dst <= src``, self-loops among them."""
        return self.cells.where("dst <= src")

    def filter_labels(self: Graph, labels: DataFrame) -> Graph:
        """FLT-4. Edges between vertices of different labels."""
        own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
        return self.like(self.cells.join(own("src"), "src").join(own("dst"), "dst").where("src_label <> dst_label"))

    def filter_weights(self: Graph, low: float, high: float) -> Graph:
        """FLT-5. Edges of weight ``low`` to ``high``, both included; NaN stays."""
        w = F.col("weight")
        return self.like(self.cells.where(F.isnan(w) | w.between(single(F.lit(low)), single(F.lit(high)))))

    def clamp(self: Graph, low: float, high: float) -> Graph:
        """PRJ-1, PRJ-2. Weights below ``low`` become ``low``, else those above ``high`` become ``high``, in this order; NaN stays."""
        w, a, b = F.col("weight"), single(F.lit(low)), single(F.lit(high))
        return self.like(self.cells.withColumn("weight", F.when(F.isnan(w), w).when(w < a, a).when(w > b, b).otherwise(w)))

    def multiply_const(self: Graph, factor: float) -> Graph:
        """PRJ-3. In double precision, stored as single."""
        return self.like(self.cells.withColumn("weight", F.col("weight").cast("double") * F.lit(float(factor))))

    def transpose(self: Graph) -> Graph:
        """PRJ-4."""
        return self.like(self.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def _square(self: Graph, what: str, limit: int | None) -> DataFrame:
        if limit is not None and self.num_nodes > limit:
            raise ValueError(f"{what} of {self.num_nodes} vertices would have {self.num_nodes**2} cells; limit=None allows it")
        n = self.num_nodes
        # Rows of the square are made from one range, so every task makes its own share.
        return self.spark.range(n * n).select(F.expr(f"id div {max(n, 1)}").alias("src"), (F.col("id") % max(n, 1)).alias("dst"))

    def invert(self: Graph, max_weight: float = 1.0, self_loops: bool = True, limit: int | None = DENSE_LIMIT) -> Graph:
        """PRJ-5. Weighted complement: ``max_weight`` less the weight, where that is above 0, and ``max_weight`` where there was no edge.

        Absent cells come out whatever ``max_weight`` is, also 0 or less. The result is dense; its size is checked.
        """
        top = single(F.lit(max_weight))
        every = self._square("the complement", limit)
        if not self_loops:
            every = every.where("src <> dst")
        left = every.join(self.cells, ["src", "dst"], "left").withColumn("_new", single(top - F.col("weight")))
        return self.like(left.where("weight is null or _new > 0").select("src", "dst", F.coalesce("_new", top).alias("weight")))

    def complement(self: Graph, max_weight: float = 1.0, self_loops: bool = True) -> Complement:
        """PRJ-5 without the square: the same edges as :meth:`invert` as a common weight and the cells that differ from it."""
        from .complement import Complement

        top = single(F.lit(max_weight))
        left = single(top - F.col("weight"))
        cells = self.cells if self_loops else self.cells.where("src <> dst")
        return Complement(cells.select("src", "dst", F.when(left > 0, left).alias("weight")), self.num_nodes, self.directed, max_weight, self_loops)

    def nonexistent(self: Graph, limit: int | None = DENSE_LIMIT) -> DataFrame:
        """ITR-5. Pairs without an edge."""
        return self._square("the complement", limit).join(self.cells, ["src", "dst"], "left_anti")

    def row_with_absent(self: Graph, i: int) -> DataFrame:
        """ITR-6. All vertices with the weight of the edge from ``i``, null where there is none."""
        own = self.cells.where(F.col("src") == i).select(F.col("dst").alias("id"), "weight")
        return self.nodes.join(own, "id", "left").select(F.col("id").alias("dst"), "weight")

    def merged_rows(self: Graph, i: int, j: int) -> DataFrame:
        """ITR-4. Both rows side by side, null where one has no edge."""
        a = self.cells.where(F.col("src") == i).select("dst", F.col("weight").alias("weight_i"))
        b = self.cells.where(F.col("src") == j).select("dst", F.col("weight").alias("weight_j"))
        return a.join(b, "dst", "full_outer")

    def matrix(self: Graph, limit: int | None = DENSE_LIMIT) -> DataFrame:
        """SNK-7. All cells of the square, 0 where there is no edge."""
        return self._square("the matrix", limit).join(self.cells, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0.0).cast("float")).alias("weight"))

    def resize(self: Graph, num_nodes: int) -> Graph:
        """PRJ-7. Vertices beyond go with their edges; new ones have none."""
        kept = self.cells if num_nodes >= self.num_nodes else self.cells.where((F.col("src") < num_nodes) & (F.col("dst") < num_nodes))
        return type(self)(kept, num_nodes, self.directed)
