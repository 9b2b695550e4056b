"""The quality report of a clustering against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .labels import confusion, norm_mutual_info_table, pair_metrics, pair_scores

#: The report's names and order.
NAMES = {
    "#nodes": "nodes", "#edges": "links", "#diagonal": "diagonal", "#communities": "communities", "modularity": "modularity", "antimodularity": "antimodularity", "density": "density",
    "precision": "precision", "recall": "recall", "rand-index": "rand_index", "fowlkes-mallows": "fowlkes_mallows", "jaccard": "jaccard", "f1-measure": "f1_measure",
    "adj-rand-index": "adj_rand_index", "adj-rand-index-comp": "adj_rand_index_comp", "norm-mutual-info": "norm_mutual_info",
}


def adj_rand_index_comp_table(graph: Graph, first: DataFrame, second: DataFrame) -> DataFrame:
    """MET-8: the adjusted Rand index over pairs within one component."""
    return confusion(first, second, graph.component_roots()).select(pair_scores()["adj_rand_index"].alias("adj_rand_index_comp"))


def adj_rand_index_comp(graph: Graph, first: DataFrame, second: DataFrame) -> float:
    return adj_rand_index_comp_table(graph, first, second).first()[0]


def metric_report(graph: Graph, clusters: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """SNK-5. ``place, metric, value`` of what is defined, in the report's order; one contingency table serves all pair scores."""
    nan = F.lit(float("nan"))
    counts = graph.counts().select(F.lit(graph.num_nodes).alias("nodes"), "links", "diagonal")
    parts = [counts, clusters.agg(F.countDistinct("label").alias("communities")), graph.modularity_table(clusters), graph.antimodularity_table(clusters), graph.density_table()]
    if truth is not None:
        parts += [pair_metrics(truth, clusters), norm_mutual_info_table(truth, clusters)]
        if not graph.directed:
            parts.append(adj_rand_index_comp_table(graph, truth, clusters))
    # Single rows side by side.
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), (F.col(c).cast("double") if c in row.columns else nan).alias("value")) for i, (n, c) in enumerate(NAMES.items())]
    return row.select(F.inline(F.array(*pairs))).where(~F.isnan("value") & F.col("value").isNotNull())
