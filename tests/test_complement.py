"""Complements as a common weight and exceptions, against the literal ones."""

import random

import pytest
from helpers import cells, labels, vector

from graphloom import cli
from graphloom.model import Graph


def close(a, b):
    assert list(map(float, a)) == pytest.approx(list(map(float, b)), rel=1e-6, abs=1e-6, nan_ok=True)


@pytest.mark.parametrize(("seed", "n", "directed", "dense", "top", "loops"), [(1, 14, False, 0.6, 1.0, False), (2, 9, True, 0.4, 1.5, False), (3, 9, False, 0.8, 1.0, True), (4, 7, True, 0.9, 1.0, True)])
def test_as_the_literal_complement(spark, seed, n, directed, dense, top, loops):
    rng = random.Random(seed)
    g = Graph.from_rows(spark, [(i, j, rng.choice([0, 0.5, 1, 1, 2])) for i in range(n) for j in range(n) if rng.random() < dense], n, directed=directed).checkpointed()
    plain, sparse = g.invert(top, loops).checkpointed(), g.complement(top, loops).checkpointed()
    own = lambda x: cells(x if isinstance(x, Graph) else x.materialized())
    assert own(sparse) == cells(plain)
    for name in ("out_degrees", "in_degrees", "out_weights", "in_weights"):
        close(vector(getattr(sparse, name)()), vector(getattr(plain, name)()))
    close(sparse.counts().first(), plain.counts().first())
    own_labels = labels(spark, [rng.randrange(3) for _ in range(n)])
    close([sparse.density(), sparse.modularity(own_labels), sparse.antimodularity(own_labels)], [plain.density(), plain.modularity(own_labels), plain.antimodularity(own_labels)])
    v = spark.createDataFrame([(i, rng.random()) for i in range(n - 1)], "id long, value double")
    close(vector(sparse.multiply_vector(v)), vector(plain.multiply_vector(v)))
    assert own(sparse.transpose()) == cells(plain.transpose()) and own(sparse.clamp(0.6, 0.9)) == cells(plain.clamp(0.6, 0.9)) and own(sparse.multiply_const(0.1)) == cells(plain.multiply_const(0.1))
    for low, high in ((0.4, 1.2), (0, 0.7)):
        assert own(sparse.filter_weights(low, high)) == cells(plain.filter_weights(low, high))
    assert own(sparse.invert(1.2, not loops)) == cells(plain.invert(1.2, not loops))
    assert [tuple(r) for r in sparse.out_edges(1).collect()] == [tuple(r) for r in plain.out_edges(1).collect()]
    assert [(sparse.get_edge(0, i), sparse.has_edge(i, i)) for i in (0, 1, n)] == [(plain.get_edge(0, i), plain.has_edge(i, i)) for i in (0, 1, n)]
    if directed:
        close([sparse.reciprocity()], [plain.reciprocity()])
    else:
        assert vector(sparse.component_roots()) == vector(plain.component_roots())
        close(vector(sparse.degree_anomalies()), vector(plain.degree_anomalies()))
        close(vector(sparse.weight_anomalies()), vector(plain.weight_anomalies()))


def test_components_of_dense_graphs(spark):
    """The complement of a complete graph has no edge, that of a complete bipartite one two sides, that of a graph without edges is one component."""
    everything = Graph.from_rows(spark, [(i, j) for i in range(6) for j in range(i)], 6)
    sides = Graph.from_rows(spark, [(i, j) for i in range(0, 7, 2) for j in range(1, 7, 2)], 7)
    assert vector(everything.complement(1, False).connected_components()) == [0, 1, 2, 3, 4, 5]
    assert vector(sides.complement(1, False).connected_components()) == [0, 1, 0, 1, 0, 1, 0]
    assert vector(Graph.empty(spark, 4).complement().connected_components()) == [0, 0, 0, 0]


def test_no_square_in_the_plan(spark):
    g = Graph.from_edges(spark.range(1000).selectExpr("id AS src", "id + 1 AS dst"), 2_000_000).complement(1, False)
    own = spark.range(2_000_000).selectExpr("id", "id % 5 AS label")
    assert g.counts().first()["cells"] == 2_000_000 * 1_999_999 - 2000
    assert abs(g.modularity(own)) < 1e-6


def test_report_of_an_inverted_graph(spark, tmp_path, capsys):
    (tmp_path / "g").write_text("4\n1 2\n3 4 0.5\n")
    (tmp_path / "c").write_text("# Labels\n0 0 1 1\n")
    assert cli.main(["metrics", "--invert", f"--clusters={tmp_path / 'c'}", str(tmp_path / "g")], spark) == 0
    report = dict(x.split(": ") for x in capsys.readouterr().out.strip().split("\n"))
    plain = Graph.from_rows(spark, [(0, 1), (2, 3, 0.5)], 4).invert()
    assert float(report["#edges"]) == plain.count_links() and float(report["modularity"]) == pytest.approx(plain.modularity(labels(spark, [0, 0, 1, 1])), abs=1e-6)
