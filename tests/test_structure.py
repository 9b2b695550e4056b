"""Statistics, labels, objectives, traversal and centrality."""

import itertools
import math

import pytest
from helpers import cells, directed, labels, undirected, vector

from graphloom.model import Graph
from graphloom.operators import labels as L
from graphloom.operators.report import adj_rand_index_comp


def test_anomalies(spark):
    rows = [(i, j, i * (i + 1) // 2 + j) for i in range(5) for j in range(i + 1) if (i * (i + 1) // 2 + j) % 3]
    g = undirected(spark, 5, rows).checkpointed()
    assert vector(g.degree_anomalies()) == pytest.approx([-2.5, 1.6, -2 / 3, -1, 0.5])
    assert vector(g.weight_anomalies()) == pytest.approx([-34.9090909, -9.12, -7.0588235, -5.3928571, 18.3958333])
    assert vector(Graph.empty(spark, 2).degree_anomalies()) == [0, 0] == vector(Graph.empty(spark, 2).weight_anomalies())


@pytest.mark.parametrize("n", [3, 5])
def test_complete_graphs(spark, n):
    pairs = [(i, j) for i in range(n) for j in range(i)]
    for rows in (pairs, [*pairs, (0, 0)]):
        g = undirected(spark, n, rows)
        assert g.transitivity() == 1 and vector(g.clustering_coefficient()) == [1] * n
    assert undirected(spark, n, pairs).density() == 1 and math.isnan(undirected(spark, n, [(0, 0)]).density())
    assert undirected(spark, 3, [(0, 1), (1, 2)]).transitivity() == 0


def test_reciprocity(spark):
    g, found = directed(spark, 3, [(0, 1), (1, 2), (2, 0)]), []
    for step in (None, (1, 0), (2, 1), (0, 2), (0, 0)):
        g = g if step is None else g.set_edge(*step)
        found.append(g.reciprocity())
    found.append(g.del_edge(0, 2).reciprocity())
    assert found == pytest.approx([0, 1 / 2, 4 / 5, 1, 1, 5 / 6])
    assert math.isnan(Graph.empty(spark, 2, True).reciprocity())


# Small labellings and the scores that are documented for them.
ONE, TWO = [5, 5, 7, 7, 5, 7, 8, 8, 8], [0, 1, 1, 1, 0, 0, 1, 0, 1]


def test_label_renumbering(spark):
    one, two = labels(spark, ONE), labels(spark, TWO)
    assert vector(L.simplify_labels(one)) == [0, 0, 1, 1, 0, 1, 2, 2, 2] and L.count_labels(one) == 3
    assert vector(L.split_labels(one, two)) == [0, 1, 3, 3, 0, 2, 5, 4, 5]
    m = L.intersection_matrix(one, two)
    assert cells(m) == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2, (2, 0): 1, (2, 1): 2} and m.num_nodes == 3 and m.directed
    assert vector(L.identity_labels(spark, 3)) == [0, 1, 2]


def test_pair_scores(spark):
    one, two = labels(spark, ONE), labels(spark, TWO)
    r = L.pair_metrics(one, two).first().asDict()
    want = {"precision": 0.1875, "recall": 1 / 3, "rand_index": 0.4722222, "fowlkes_mallows": 0.25, "jaccard": 0.1363636, "f1_measure": 0.24, "adj_rand_index": -0.1176470}
    assert r == pytest.approx(want, abs=1e-6)
    assert L.norm_mutual_info(one, two) == pytest.approx(0.05650554) and L.jaccard(one, two) == pytest.approx(0.1363636, abs=1e-6)


@pytest.mark.parametrize("a,b,want", [([1] * 5, [1] * 5, 1), ([1] * 5, list(range(5)), 0), (list(range(5)), [1] * 5, 0), (list(range(5)), list(range(5)), 1)])
def test_degenerate_scores(spark, a, b, want):
    r = L.pair_metrics(labels(spark, a), labels(spark, b)).first().asDict()
    assert list(r.values()) == pytest.approx([want] * 7) and L.norm_mutual_info(labels(spark, a), labels(spark, b)) == pytest.approx(want)


def test_confusion(spark):
    a, b = [0] * 6 + [1] * 6 + [2] * 5, [0, 0, 0, 0, 0, 1, 0, 1, 1, 1, 1, 2, 0, 0, 2, 2, 2]
    pairs = list(itertools.combinations(range(17), 2))
    count = lambda x, y: sum((a[i] == a[j]) == x and (b[i] == b[j]) == y for i, j in pairs)
    assert L.confusion_matrix(labels(spark, a), labels(spark, b)) == [[count(True, True), count(False, True)], [count(True, False), count(False, False)]]
    assert L.confusion(labels(spark, a), labels(spark, b)).first()["a"] == 20


def decode(spark, parents):
    return vector(L.decode_labels(spark.createDataFrame(list(enumerate(parents)), "id long, parent long")))


def test_decode(spark):
    assert [decode(spark, p) for p in ([0, 0, 0], [1, 0, 2], [2, 3, 2], [10, 2, 1])] == [[0, 0, 0], [0, 0, 2], [0, 1, 0], [0, 1, 1]]


def test_component_scores(spark):
    g, true = undirected(spark, 4, [(0, 1), (2, 3)]), labels(spark, [0, 1, 0, 1])
    for pred, plain, own in (([0, 1, 2, 3], 0, 1), ([0, 1, 0, 3], 0.5714286, 1), ([0, 1, 1, 0], -0.5, 1), ([0, 1, 1, 1], 0, 0)):
        assert L.adj_rand_index(true, labels(spark, pred)) == pytest.approx(plain, abs=1e-6)
        assert adj_rand_index_comp(g, true, labels(spark, pred)) == pytest.approx(own)


def test_objectives(spark):
    d2 = directed(spark, 2, [(0, 0, 1), (0, 1, 2), (1, 0, 3)])
    u2 = undirected(spark, 2, [(0, 0, 1), (0, 1, 2)])
    assert d2.modularity(labels(spark, [0, 0])) == pytest.approx(0) and d2.modularity(labels(spark, [0, 1])) == pytest.approx(-1 / 3)
    assert u2.modularity(labels(spark, [0, 0])) == pytest.approx(0) and u2.modularity(labels(spark, [0, 1])) == pytest.approx(-0.32)
    assert u2.antimodularity(labels(spark, [0, 0])) == pytest.approx(0.25) and math.isnan(d2.antimodularity(labels(spark, [0, 0])))
    pointers = spark.createDataFrame([(0, 1), (1, 1)], "id long, parent long")
    assert u2.modularity_decode(pointers) == pytest.approx(0) and u2.antimodularity_decode(pointers) == pytest.approx(0.25)
    assert math.isnan(Graph.empty(spark, 2).modularity(labels(spark, [0, 1])))


@pytest.fixture(scope="module")
def b5(spark):
    return directed(spark, 5, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1.5), (2, 4, 1.5)]).checkpointed()


def test_distances(b5):
    inf = float("inf")
    assert vector(b5.all_distances_count(0)) == [0, 1, 2, 3, 3] and vector(b5.all_distances_count(0, 2)) == [0, 1, 2, None, None]
    assert vector(b5.all_distances_weight(0)) == [0, 1, 2, 3, 3.5] and vector(b5.all_distances_weight(0, 2)) == [0, 1, 2, inf, inf]
    assert b5.distance_count(0, 4) == 3 and b5.distance_weight(0, 4) == 3.5 and b5.distance_count(4, 0) is None and b5.distance_weight(9, 0) == inf
    far = b5.del_edge(2, 4)
    assert far.distance_count(0, 4) == 4 and far.distance_weight(0, 4) == 4.5
    assert far.distance_count(2, 2) == 0 and far.distance_weight(2, 2) == 0.0
    # The rounds end with the one that reaches the vertex asked for.
    reached = [r["count"] for r in far.hop_tree(far._starts(0), until=2).collect()]
    assert max(reached) == far.distance_count(0, 2)
    assert cells(b5.all_distances_graph())[1, 4] == 2 and (4, 0) not in cells(b5.all_distances_graph(True))
    assert [tuple(r) for r in b5.bfs_count(0).collect()] == [(0, 0, None, 0), (1, 1, 0, 1), (2, 2, 1, 2), (3, 3, 2, 3), (3.5, 3, 2, 4)]
    assert [tuple(r) for r in b5.bfs_weight(0, 3).collect()] == [(0, 0, None, 0), (1, 1, 0, 1), (2, 2, 1, 2), (3, 3, 2, 3)]
    with pytest.raises(ValueError):
        b5.set_edge(0, 1, -1).all_distances_weight(0)


def test_components(spark):
    g = undirected(spark, 6, [(0, 1), (1, 3), (2, 4), (4, 5)])
    assert vector(g.connected_components()) == [0, 0, 1, 0, 1, 1]
    with pytest.raises(ValueError):
        g.with_direction(True).connected_components()
    path = undirected(spark, 300, [(i, i + 1) for i in range(298)])
    assert vector(path.connected_components()) == [0] * 299 + [1]


def test_centrality_of_parts_that_do_not_meet(spark):
    g, far = undirected(spark, 3, [(0, 1)]), 4294967295
    assert vector(g.closeness_centrality()) == pytest.approx([2 / (1 + far), 2 / (1 + far), 2 / (2 * far)])
    assert vector(g.closeness_centrality("ignore"))[:2] == [1, 1]
    assert vector(g.harmonic_centrality()) == pytest.approx([(1 + 1 / far) / 2, (1 + 1 / far) / 2, 1 / far])
    assert vector(g.harmonic_centrality(2, fast=True)) == [0.5, 0.5, 0]
    assert all(math.isnan(v) for v in vector(Graph.empty(spark, 1).closeness_centrality()))


def test_triangles_by_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = {(i, j) for i, j in itertools.combinations(range(14), 2) if rng.random() < 0.4}
    want = {t for t in itertools.combinations(range(14), 3) if all(p in pairs for p in itertools.combinations(t, 2))}
    found = [tuple(sorted(r)) for r in undirected(spark, 14, [*pairs, (3, 3)]).triangles().collect()]
    assert len(found) == len(want) and set(found) == want
