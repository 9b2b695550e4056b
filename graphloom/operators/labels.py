"""Operators on label tables ``id, label``: renumbering, contingency, and scores that compare two labellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ratio
from ..runtime import running_totals
from .components import component_roots


def identity_labels(spark: SparkSession, num_nodes: int) -> DataFrame:
    """SRC-4."""
    return spark.range(num_nodes).select("id", F.col("id").alias("label"))


def labels_from(spark: SparkSession, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id long, label long")


def count_labels(labels: DataFrame) -> int:
    """AGG-15."""
    return labels.agg(F.countDistinct("label").alias("n")).first()["n"]


def _ranked(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys with ``rank`` from 0 in their order; only the keys are ordered, and by ranges, not in one task."""
    return running_totals(keys.select(*columns).distinct(), [F.col(c) for c in columns], {"rank": F.lit(1).cast("long")})


def simplify_labels(labels: DataFrame) -> DataFrame:
    """WIN-1. Labels become 0 .. k-1 in their order."""
    ranks = _ranked(labels, "label")
    return labels.join(ranks, "label").select("id", F.col("rank").alias("label"))


def split_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """WIN-2. Pairs of labels become 0 .. k-1 in lexicographic order."""
    both = pair_labels(first, second)
    return both.join(_ranked(both, "label1", "label2"), ["label1", "label2"]).select("id", F.col("rank").alias("label"))


def pair_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("id", F.col("label").alias("label1")).join(second.select("id", F.col("label").alias("label2")), "id")


def decode_labels(pointers: DataFrame) -> DataFrame:
    """LBL-1. ``id, label`` from ``id, parent``: the least vertex that chains of pointers link with; pointers out of range end them. Iterates."""
    n = pointers.agg(F.count("*").alias("n")).first()["n"]
    links = pointers.where(F.col("parent").between(0, n - 1)).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    roots = component_roots(links)
    return pointers.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label"))


def contingency(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    """Counts ``n`` for each pair of labels that occurs."""
    return pair_labels(first, second).groupBy("label1", "label2").agg(F.count("*").alias("n"))


def intersection_matrix(first: DataFrame, second: DataFrame):
    """LBL-2. The contingency table over renumbered labels, as a directed graph."""
    from ..model import Graph

    cells = contingency(simplify_labels(first), simplify_labels(second)).select(F.col("label1").alias("src"), F.col("label2").alias("dst"), F.col("n").cast("float").alias("weight"))
    n = cells.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0)).alias("n")).first()["n"]
    return Graph(cells, n, directed=True)


def confusion(first: DataFrame, second: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """LBL-3, LBL-4. One row ``a, b, c, d``: vertex pairs together in both labellings, only in the second, only in the first, in neither.

    With ``components`` (a labelling) only pairs within one component count. Counts are whole numbers.
    """
    both = pair_labels(first, second)
    both = both.join(components.select("id", F.col("label").alias("part")), "id") if components is not None else both.withColumn("part", F.lit(0).cast("long"))
    cells = both.groupBy("part", "label1", "label2").agg(F.count("*").alias("n"))
    pairs = lambda table, name: table.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias(name))
    rows, columns = (cells.groupBy("part", c).agg(F.sum("n").alias("n")) for c in ("label1", "label2"))
    whole = cells.groupBy("part").agg(F.sum("n").alias("n"))
    # Single rows side by side.
    one = pairs(cells, "a").crossJoin(F.broadcast(pairs(rows, "r"))).crossJoin(F.broadcast(pairs(columns, "k"))).crossJoin(F.broadcast(pairs(whole, "t")))
    return one.select("a", (F.col("k") - F.col("a")).alias("b"), (F.col("r") - F.col("a")).alias("c"), (F.col("t") - F.col("r") - F.col("k") + F.col("a")).alias("d"))


def confusion_matrix(first: DataFrame, second: DataFrame) -> list[list[int]]:
    r = confusion(first, second).first()
    return [[r["a"], r["b"]], [r["c"], r["d"]]]


def pair_scores() -> dict[str, Column]:
    """MET-1 to MET-7 over the columns of :func:`confusion`."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    same = (b == 0) & (c == 0)
    one, zero = F.lit(1.0), F.lit(0.0)
    whole, chance = a + b + c + d, (a + b) * (a + c) + (c + d) * (b + d)
    guard = lambda value: F.when(same, one).otherwise(value)
    found = lambda value: F.when(same, one).when(a == 0, zero).otherwise(value)
    return {
        "precision": found(ratio(a, a + b)),
        "recall": found(ratio(a, a + c)),
        "rand_index": guard(ratio(a + d, whole)),
        "fowlkes_mallows": found(ratio(a, F.sqrt((a + b) * (a + c)))),
        "jaccard": guard(ratio(a, a + b + c)),
        "f1_measure": guard(ratio(2 * a, 2 * a + b + c)),
        "adj_rand_index": guard(ratio(whole * (a + d) - chance, whole * whole - chance)),
    }


def pair_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row with all pair-counting scores: the contingency table is made once."""
    return confusion(first, second).select(*[v.alias(k) for k, v in pair_scores().items()])


def norm_mutual_info_table(first: DataFrame, second: DataFrame) -> DataFrame:
    """MET-9 as one row: twice the mutual information over both entropies; 1 if both are 0."""
    cells = contingency(first, second)
    whole = cells.agg(F.sum("n").cast("double").alias("t"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(m)) for c, m in (("label1", "r"), ("label2", "k")))
    met = cells.join(rows, "label1").join(columns, "label2").crossJoin(F.broadcast(whole))
    p = lambda c: F.col(c) / F.col("t")
    mutual = met.agg(F.coalesce(F.sum(p("n") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("k")))), F.lit(0.0)).alias("mi"))
    entropy = lambda table, c, name: table.crossJoin(F.broadcast(whole)).agg(F.coalesce(-F.sum(p(c) * F.log(p(c))), F.lit(0.0)).alias(name))
    one = mutual.crossJoin(F.broadcast(entropy(rows, "r", "h1"))).crossJoin(F.broadcast(entropy(columns, "k", "h2")))
    return one.select(F.when((F.abs("h1") < 1e-300) & (F.abs("h2") < 1e-300), F.lit(1.0)).otherwise(ratio(2 * F.col("mi"), F.col("h1") + F.col("h2"))).alias("norm_mutual_info"))


def _score(name: str):
    def score(first: DataFrame, second: DataFrame) -> float:
        return pair_metrics(first, second).select(name).first()[0]

    score.__name__ = name
    score.__doc__ = f"The score ``{name}`` of the second labelling against the first."
    return score


precision, recall, rand_index, fowlkes_mallows, jaccard, f1_measure, adj_rand_index = map(
    _score, ("precision", "recall", "rand_index", "fowlkes_mallows", "jaccard", "f1_measure", "adj_rand_index")
)


def norm_mutual_info(first: DataFrame, second: DataFrame) -> float:
    return norm_mutual_info_table(first, second).first()[0]
