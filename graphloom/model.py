"""The graph: an edge table, a vertex count and a direction flag."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import single
from .operators.algebra import Algebra
from .operators.centrality import Centrality
from .operators.community import Community
from .operators.contract import Contraction
from .operators.edges import EdgeAccess
from .operators.mutate import Mutation
from .operators.objective import Objective
from .operators.stats import Statistics
from .operators.traverse import Traversal

EDGE = "src long, dst long, weight float"


class Graph(EdgeAccess, Mutation, Contraction, Algebra, Statistics, Traversal, Centrality, Objective, Community):
    """A weighted graph on the vertices 0 .. num_nodes - 1, immutable like the DataFrame it stands on.

    ``edges(src, dst, weight)`` has at most one row for each pair; a row with weight 0 is an edge. Undirected graphs hold both
    directions of each edge, and a self-loop once. Operators return new graphs or tables and run nothing, except where
    their text says that they iterate.
    """

    def __init__(self, cells: DataFrame, num_nodes: int, directed: bool = False):
        if num_nodes < 0:
            raise ValueError("a graph can't have fewer than 0 vertices")
        self.cells, self.num_nodes, self.directed = cells, int(num_nodes), bool(directed)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def nodes(self) -> DataFrame:
        return self.spark.range(self.num_nodes)

    def like(self, cells: DataFrame, directed: bool | None = None) -> Graph:
        """A graph on the same vertices with other cells."""
        return Graph(cells.select("src", "dst", single(F.col("weight")).alias("weight")), self.num_nodes, self.directed if directed is None else directed)

    def with_direction(self, directed: bool) -> Graph:
        """The same cells, read as directed or not."""
        return Graph(self.cells, self.num_nodes, directed)

    @staticmethod
    def empty(spark: SparkSession, num_nodes: int, directed: bool = False) -> Graph:
        return Graph(spark.createDataFrame([], EDGE), num_nodes, directed)

    @staticmethod
    def from_rows(spark: SparkSession, rows: Iterable[tuple], num_nodes: int, directed: bool = False) -> Graph:
        """From a few ``(src, dst[, weight])`` given by hand; later ones win."""
        rows = [(int(r[0]), int(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in rows]
        return Graph.empty(spark, num_nodes, directed).set_edges(rows)

    @staticmethod
    def from_edges(edges: DataFrame, num_nodes: int, directed: bool = False) -> Graph:
        """From a table ``src, dst[, weight]`` in which each edge stands once (undirected ones in either direction)."""
        weight = single(F.col("weight")) if "weight" in edges.columns else F.lit(1.0).cast("float")
        cells = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        if not directed:
            # In one pass: a union would make the edges twice.
            ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
            ways = F.when(F.col("src") != F.col("dst"), F.array(ends("src", "dst"), ends("dst", "src"))).otherwise(F.array(ends("src", "dst")))
            cells = cells.select(F.explode(ways).alias("_way"), "weight").select("_way.src", "_way.dst", "weight")
        return Graph(cells, num_nodes, directed)

    @staticmethod
    def load_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
        from .sources.text import load_graph

        return load_graph(spark, path, directed)

    def copy(self) -> Graph:
        return Graph(self.cells, self.num_nodes, self.directed)

    def checkpointed(self) -> Graph:
        """The same graph with its cells written to the shared folder."""
        from .runtime import ended_shuffles, stash

        with ended_shuffles(self.spark):
            return Graph(stash(self.cells), self.num_nodes, self.directed)

    def require_undirected(self, what: str) -> None:
        if self.directed:
            raise ValueError(f"{what} is defined for undirected graphs")

    def require_same_size(self, other: Graph) -> None:
        if self.num_nodes != other.num_nodes:
            raise ValueError(f"graphs of {self.num_nodes} and {other.num_nodes} vertices don't fit together")

    def is_symmetric(self) -> bool:
        """Whether each cell has its mirror image with the same weight."""
        turned = self.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return self.cells.exceptAll(turned).isEmpty()

    # Python's brackets, for a look at single cells.
    def __getitem__(self, pair: tuple[int, int]) -> float:
        return self.get_edge(*pair)
