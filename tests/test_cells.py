"""Filters, projections, edits, contraction and algebra on graphs of a few vertices."""

import math

import pytest
from helpers import cells, directed, labels, undirected, vector

from graphloom.model import Graph


@pytest.fixture(scope="module")
def d2(spark):
    return directed(spark, 2, [(0, 0, 1), (0, 1, 2), (1, 0, 3)])


@pytest.fixture(scope="module")
def u2(spark):
    return undirected(spark, 2, [(0, 0, 1), (0, 1, 2)])


@pytest.fixture(scope="module")
def t4(spark):
    return undirected(spark, 4, [(i, j, i * (i + 1) // 2 + j) for i in range(4) for j in range(i + 1)]).checkpointed()


def test_counts_degrees_weights(d2, u2):
    r = d2.counts().first()
    assert (r["links"], r["cells"], r["diagonal"], r["weights"]) == (3, 3, 1, 6)
    r = u2.counts().first()
    assert (r["links"], r["cells"], r["diagonal"], r["weights"]) == (2, 3, 1, 3)
    assert (vector(d2.out_degrees()), vector(d2.in_degrees())) == ([2, 1], [2, 1])
    assert (vector(d2.out_weights()), vector(d2.in_weights())) == ([3, 3], [4, 2])
    assert vector(u2.out_weights()) == [3, 2]
    assert (d2.out_degree(0), d2.in_degree(1), d2.count_links(), u2.count_links(directed=True)) == (2, 1, 3, 3)


def test_squares(d2, u2):
    assert cells(d2.square()) == {(0, 0): 7, (0, 1): 2, (1, 0): 3, (1, 1): 6}
    assert cells(u2.square()) == {(0, 0): 5, (0, 1): 2, (1, 0): 2, (1, 1): 4}
    assert not u2.square().directed


def test_invert(d2, u2):
    assert cells(d2.invert(3)) == {(0, 0): 2, (0, 1): 1, (1, 1): 3}
    assert cells(d2.invert(3, self_loops=False)) == {(0, 1): 1}
    assert cells(u2.invert(2)) == {(0, 0): 1, (1, 1): 2}
    assert cells(u2.invert(0)) == {(1, 1): 0}  # absent cells come out even so


def test_filters_and_clamps(spark):
    f2 = directed(spark, 2, [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)])
    assert cells(f2.filter_labels(labels(spark, [0, 1]))) == {(0, 1): 2, (1, 0): 3}
    assert cells(f2.filter_weights(2.5, 3.5)) == {(1, 0): 3}
    assert cells(f2.clamp(2, 3)) == {(0, 0): 2, (0, 1): 2, (1, 0): 3, (1, 1): 3}
    assert cells(f2.clamp(3, 2)) == {(0, 0): 3, (0, 1): 3, (1, 0): 2, (1, 1): 2}
    nan = directed(spark, 2, [(0, 1, math.nan), (1, 0, 9)])
    assert math.isnan(cells(nan.filter_weights(0, 1))[0, 1]) and math.isnan(cells(nan.clamp(0, 1))[0, 1])
    assert cells(f2.multiply_const(0.5)) == {(0, 0): 0.5, (0, 1): 1, (1, 0): 1.5, (1, 1): 2}
    assert cells(f2.transpose())[0, 1] == 3


def test_access(spark):
    g = directed(spark, 3, [(0, 2, 1), (1, 2, 2), (2, 2, 3), (0, 1, 0)])
    assert g.has_edge(0, 1) and g[0, 1] == 0 and not g.has_edge(1, 0) and g[7, 7] == 0
    assert [tuple(r) for r in g.out_edges(0).collect()] == [(1, 0), (2, 1)]
    assert [r["dst"] for r in g.out_edges_reversed(0).collect()] == [2, 1]
    assert [tuple(r) for r in g.edges(2).collect()] == [(0, 1, 0), (0, 2, 1)]
    assert {(r["src"], r["dst"]): r["weight"] for r in g.matrix().collect()} == {(i, j): w for (i, j), w in {**{(i, j): 0 for i in range(3) for j in range(3)}, (0, 2): 1, (1, 2): 2, (2, 2): 3}.items()}
    assert {tuple(r) for r in g.nonexistent().collect()} == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert sorted((r["dst"], r["weight"]) for r in g.row_with_absent(1).collect() if r["weight"] is not None) == [(2, 2)]
    assert {tuple(r) for r in g.merged_rows(0, 1).collect()} == {(1, 0, None), (2, 1, 2)}


def test_resize(spark):
    g = directed(spark, 3, [(i, j, 3 * i + j + 1) for i in range(3) for j in range(3)])
    small = g.resize(2).resize(3)
    assert cells(small) == {(0, 0): 1, (0, 1): 2, (1, 0): 4, (1, 1): 5} and small.num_nodes == 3
    assert cells(g.resize(1)) == {(0, 0): 1} and cells(g.resize(0)) == {}


def test_batches(spark):
    g, pairs = Graph.empty(spark, 3, directed=True), [(0, 1, 1), (1, 2, 2), (2, 0, 3), (3, 3, 4)]
    twice = g.add_edges(pairs).add_edges(pairs)
    assert cells(twice) == {(0, 1): 2, (1, 2): 4, (2, 0): 6}
    g = twice.set_edges(pairs)
    assert cells(g) == {(0, 1): 1, (1, 2): 2, (2, 0): 3}
    assert cells(g.min_edges([p[:2] + (2,) for p in pairs])) == {(0, 1): 1, (1, 2): 2, (2, 0): 2}
    assert cells(g.max_edges([p[:2] + (2,) for p in pairs])) == {(0, 1): 2, (1, 2): 2, (2, 0): 3}
    assert cells(g.del_edges(pairs)) == {} and cells(g.set_edges([])) == cells(g)
    assert cells(g.min_edge(0, 2, 5)) == {**cells(g), (0, 2): 0} and cells(g.max_edge(0, 2, -5))[0, 2] == 0
    u = undirected(spark, 3, [(0, 1, 1), (1, 0, 5), (2, 2, 7)])
    assert cells(u) == {(0, 1): 5, (1, 0): 5, (2, 2): 7} and u.is_symmetric()
    assert cells(u.del_edge(1, 0)) == {(2, 2): 7} and cells(u.add_edge(1, 0, 1))[0, 1] == 6


REST = {(1, 1): 2, (1, 3): 7, (3, 1): 7, (3, 3): 9}


def both(i, j, w):
    return {(i, j): w, (j, i): w}


def test_contraction_undirected(t4):
    assert cells(t4.merge_nodes_add(0, 2)) == {(0, 0): 11, **both(0, 1, 5), **both(0, 3, 14), **REST}
    assert cells(t4.merge_nodes_min(0, 2)) == {(0, 0): 0, **both(0, 1, 1), **both(0, 3, 6), **REST}
    assert cells(t4.merge_nodes_max(0, 2)) == {(0, 0): 5, **both(0, 1, 4), **both(0, 3, 8), **REST}
    for preset, a, b in (((0.5, 0.5, 0, -0.5), 1, 6), ((0.5, 0.5, 0, 0.5), 4, 8), ((0.5, 0.5, -0.25, 0), 1.75, 6.25)):
        assert cells(t4.merge_nodes_custom(0, 2, *preset)) == {**both(0, 1, a), **both(0, 3, b), **REST}
    assert cells(t4.merge_nodes_add(0, 0)) == cells(t4.merge_nodes_min(9, 1)) == cells(t4)


def test_contraction_of_unlinked_vertices(spark):
    g = undirected(spark, 3, [(0, 0, 5), (1, 1, 3), (1, 2, 4)])
    assert cells(g.merge_nodes_min(0, 1)) == {(0, 0): 3, (0, 2): 0, (2, 0): 0}
    assert cells(g.merge_nodes_max(0, 1)) == {(0, 0): 5, (0, 2): 4, (2, 0): 4}
    d = g.with_direction(True)
    assert cells(d.merge_nodes_min(0, 1))[0, 0] == 0  # the row pass makes a cell of 0 that the column pass meets


def test_contraction_directed(spark):
    g = directed(spark, 4, [(i, j, 4 * i + j) for i in range(4) for j in range(4)]).checkpointed()
    rest = {(1, 1): 5, (1, 3): 7, (3, 1): 13, (3, 3): 15}
    assert cells(g.merge_nodes_add(0, 2)) == {(0, 0): 20, (0, 1): 10, (0, 3): 14, (1, 0): 10, (3, 0): 26, **rest}
    assert cells(g.merge_nodes_min(0, 2)) == {(0, 0): 0, (0, 1): 1, (0, 3): 3, (1, 0): 4, (3, 0): 12, **rest}
    assert cells(g.merge_nodes_max(0, 2)) == {(0, 0): 10, (0, 1): 9, (0, 3): 11, (1, 0): 6, (3, 0): 14, **rest}


def test_algebra(spark):
    g = directed(spark, 2, [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)])
    h = directed(spark, 2, [(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8)])
    flat = lambda x: [cells(x)[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert flat(g.multiply_elementwise(h)) == [5, 12, 21, 32] and g.scalar_product(h) == 70
    assert flat(g.multiply(h)) == [19, 22, 43, 50] and flat(g.add_elementwise(h)) == [6, 8, 10, 12]
    for op in ("multiply", "add_elementwise", "multiply_elementwise", "scalar_product"):
        with pytest.raises(ValueError):
            getattr(g, op)(g.resize(3))
    u, v = undirected(spark, 2, [(0, 1, 1)]), undirected(spark, 2, [(0, 0, 1), (0, 1, 1)])
    assert u.multiply(v).directed and cells(u.multiply(v)) == {(0, 0): 1, (1, 0): 1, (1, 1): 1}


@pytest.mark.parametrize("sign", [1, -1])
def test_power_iteration(spark, sign):
    g = directed(spark, 2, [(0, 0, 0.5 * sign), (0, 1, 0.5 * sign), (1, 0, 0.2 * sign), (1, 1, 0.8 * sign)])
    x, value = g.power_iteration()
    assert value == pytest.approx(sign, abs=1e-6)
    assert [abs(v) for v in vector(x)] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6)
    y, value2 = g.power_iteration(9)
    assert value2 == pytest.approx(sign, abs=1e-3)


def test_direction_and_limits(spark):
    with pytest.raises(ValueError):
        Graph.empty(spark, 30_000).invert()
    with pytest.raises(ValueError):
        Graph.empty(spark, -1)


def test_dense_results_on_demand(spark, monkeypatch):
    g = undirected(spark, 5, [(0, 1)])
    for change in (lambda **k: g.invert(**k).cells, lambda **k: g.matrix(**k), lambda **k: g.nonexistent(**k)):
        with pytest.raises(ValueError):
            change(limit=4)
        assert change(limit=None).count() == change().count() > 0
