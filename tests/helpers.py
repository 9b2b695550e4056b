"""Small things that the graph tests share."""

from graphloom.model import Graph
from graphloom.operators.labels import labels_from


def cells(graph):
    return {(r["src"], r["dst"]): r["weight"] for r in graph.cells.collect()}


def vector(df):
    return [r[1] for r in sorted(df.collect())]


def directed(spark, n, rows):
    return Graph.from_rows(spark, rows, n, directed=True)


def undirected(spark, n, rows):
    return Graph.from_rows(spark, rows, n)


def labels(spark, values):
    return labels_from(spark, values)
