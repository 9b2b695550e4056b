"""Sparse-matrix algebra as joins and aggregates."""

from __future__ import annotations

from copy import copy
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import bucketed, drop_stash, stash

if TYPE_CHECKING:
    from ..model import Graph


class PowerIteration:
    """What needs products with vectors only."""

    def power_iteration(self: Graph, iterations: int = 0) -> tuple[DataFrame, float]:
        """ALG-7. Dominant eigenvector ``id, value`` and its Rayleigh quotient after ``iterations`` (0: 100) normalised steps.

        Starts from fixed values in (0, 1], so runs agree. A step is one product, written to the shared folder; its length, one row, is divided out
        in the next step, so a step is one job and a graph of any size goes the same way. The cells are written by their targets beforehand.
        """
        own = self._by_target()

        def written(vector: DataFrame) -> tuple[DataFrame, float]:
            """The vector, written, and its length, which is added up while it is written."""
            seen = Observation()
            held = stash(vector.observe(seen, F.sum(F.col("value") * F.col("value")).alias("squares")))
            return held, (seen.get["squares"] or 0.0) ** 0.5

        x, norm = written(self.nodes.select("id", ((F.col("id") * 7919 % 1000 + 1) / 1000.0).alias("value")))
        for step in range(iterations or 100):
            y, longer = written(own.multiply_vector(x.select("id", (F.col("value") / F.lit(norm)).alias("value"))) if norm else x)
            if longer == 0:
                drop_stash(y)
                if step == 0 and own.cells.isEmpty():
                    # Without edges nothing is stretched.
                    norm = 0.0
                break
            drop_stash(x)
            x, norm = y, longer
        if norm == 0:
            return self.nodes.select("id", F.lit(0.0).alias("value")), 0.0
        unit = stash(x.select("id", (F.col("value") / F.lit(norm)).alias("value")))
        both = own.multiply_vector(unit).select("id", F.col("value").alias("_y")).join(unit, "id")
        value = both.agg(F.sum(F.col("_y") * F.col("value")).alias("e")).first()["e"] or 0.0
        return unit, value

    def _by_target(self: Graph) -> Graph:
        """The same graph with its cells in buckets of their targets, where a product meets the vector."""
        held = copy(self)
        held.cells = bucketed(self.cells, "dst")
        return held


#: Edges of a heavy vertex that meet in one place of a product, from either side.
TILE = 2_000


class Algebra(PowerIteration):
    def add_elementwise(self: Graph, other: Graph) -> Graph:
        """ALG-1. A union and a sum: cheaper than an outer join, and the same."""
        self.require_same_size(other)
        both = self.cells.select("src", "dst", "weight").unionByName(other.cells.select("src", "dst", "weight"))
        return self.like(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), self.directed or other.directed)

    def multiply_elementwise(self: Graph, other: Graph) -> Graph:
        """ALG-2. Product where both have an edge."""
        met = self._met(other)
        return self.like(met.select("src", "dst", (F.col("weight") * F.col("_w2")).alias("weight")), self.directed or other.directed)

    def _met(self: Graph, other: Graph) -> DataFrame:
        self.require_same_size(other)
        return self.cells.join(other.cells.select("src", "dst", F.col("weight").alias("_w2")), ["src", "dst"])

    def scalar_product_table(self: Graph, other: Graph) -> DataFrame:
        """ALG-3 as one row; products are single precision, their sum is double."""
        return self._met(other).agg(F.coalesce(F.sum(F.col("weight") * F.col("_w2")), F.lit(0.0)).alias("product"))

    def scalar_product(self: Graph, other: Graph) -> float:
        return self.scalar_product_table(other).first()["product"]

    def multiply(self: Graph, other: Graph, tile: int = TILE) -> Graph:
        """ALG-4. Matrix product. Undirected only for a graph's own square; other products of undirected graphs may be asymmetric.

        A middle vertex with more than ``tile`` squared pairs of edges is cut into rows and columns of about ``tile`` edges each, and every row meets every column in
        a place of its own, so that no task makes all its pairs.
        """
        self.require_same_size(other)
        # Written once, as degrees and products read them both.
        mine = stash(self.cells.select("src", "dst", "weight"))
        theirs = mine if other.cells is self.cells else stash(other.cells.select("src", "dst", "weight"))
        left = mine.select("src", F.col("dst").alias("_mid"), F.col("weight").alias("_w1"))
        right = theirs.select(F.col("src").alias("_mid"), "dst", F.col("weight").alias("_w2"))
        into, out = (t.groupBy("_mid").agg(F.count("*").alias(c)) for t, c in ((left, "_in"), (right, "_out")))
        # A middle vertex with many pairs of edges has more than TILE on one side, so there are few.
        heavy = stash(into.join(out, "_mid").where(F.col("_in") * F.col("_out") > tile * tile).select("_mid", *[F.ceil(F.col(c) / tile).cast("int").alias(k) for c, k in (("_in", "_rows"), ("_out", "_columns"))]))
        keys = ["_mid"]
        if not heavy.isEmpty():
            keys = ["_mid", "_row", "_column"]
            one = F.lit(1)
            spread = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
            part = lambda c, n: F.pmod(F.hash(c), F.coalesce(n, one))
            left = left.join(heavy, "_mid", "left").select("src", "_mid", "_w1", part("src", F.col("_rows")).alias("_row"), spread(F.col("_columns")).alias("_column"))
            right = right.join(heavy, "_mid", "left").select("_mid", "dst", "_w2", part("dst", F.col("_columns")).alias("_column"), spread(F.col("_rows")).alias("_row"))
        paths = left.join(right, keys).groupBy("src", "dst").agg(F.sum(F.col("_w1") * F.col("_w2")).alias("weight"))
        return self.like(paths, self.directed if self.cells is other.cells else True)

    def square(self: Graph) -> Graph:
        """ALG-5. Weights of walks of two steps."""
        return self.multiply(self)

    def multiply_vector(self: Graph, vector: DataFrame) -> DataFrame:
        """ALG-6. ``id, value`` from a table ``id, value``; vertices that the vector lacks count as 0."""
        terms = self.cells.join(vector.select(F.col("id").alias("dst"), "value"), "dst")
        sums = terms.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight").cast("double") * F.col("value")).alias("value"))
        return self.nodes.join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
