"""Modularity and anti-modularity of a labelling."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .labels import decode_labels

if TYPE_CHECKING:
    from ..model import Graph


class Objective:
    def degree_product(self: Graph, labels: DataFrame) -> DataFrame:
        """OBJ-0 as one row: ``product``, the sum over labels of out-weight times in-weight, and ``norm``, all out-weights."""
        ends = self.cells.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("weight").cast("double").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0.0).alias("o"), F.col("weight").cast("double").alias("i")))).alias("e")).select("e.*")
        # Per vertex first: the join with the labels then meets a row for each vertex.
        per = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).join(labels, "id").groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        return per.agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0)).alias("product"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("norm"))

    def modularity_table(self: Graph, labels: DataFrame) -> DataFrame:
        """OBJ-1 as one row; NaN without edges. The norm counts every cell, so an undirected self-loop once."""
        own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
        inside = self.cells.join(own("src"), "src").join(own("dst"), "dst").where("_src = _dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
        one = inside.crossJoin(F.broadcast(self.degree_product(labels)))
        return one.select(ratio(F.col("inside") - ratio(F.col("product"), F.col("norm")), F.col("norm")).alias("modularity"))

    def modularity(self: Graph, labels: DataFrame) -> float:
        return self.modularity_table(labels).first()["modularity"]

    def modularity_decode(self: Graph, pointers: DataFrame) -> float:
        """OBJ-2."""
        return self.modularity(decode_labels(pointers))

    def antimodularity_table(self: Graph, labels: DataFrame) -> DataFrame:
        """OBJ-3 as one row; NaN for directed graphs.

        Walks of two steps within a label are counted from their middle: for each vertex and label the weights that lead there
        are added up and squared, so the square of the graph is never made.
        """
        if self.directed:
            return self.spark.range(1).select(F.lit(float("nan")).alias("antimodularity"))
        met = self.cells.join(labels.select(F.col("id").alias("src"), "label"), "src")
        arms = met.groupBy("label", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w"))
        walks = arms.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("walks"))
        weights = arms.groupBy("label").agg(F.sum("w").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("expected"))
        n = F.lit(float(self.num_nodes))
        return walks.crossJoin(F.broadcast(weights)).select(ratio(F.col("walks") - ratio(F.col("expected"), n), n).alias("antimodularity"))

    def antimodularity(self: Graph, labels: DataFrame) -> float:
        return self.antimodularity_table(labels).first()["antimodularity"]

    def antimodularity_decode(self: Graph, pointers: DataFrame) -> float:
        """OBJ-4."""
        return self.antimodularity(decode_labels(pointers))
