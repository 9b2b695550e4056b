"""Searches against plain Python: many sources as bits, buckets of weight, pairs from both ends, reached vertices as bits, tiles of products."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from helpers import cells, vector
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import algebra, centrality, components, kernels, traverse
from graphloom.operators import visited as V
from graphloom.runtime import stash


def near(graph):
    out = {}
    for r in graph.cells.collect():
        out.setdefault(r["src"], {})[r["dst"]] = r["weight"]
    return out


def dijkstra(ways, start):
    best, done, heap = {start: (0.0, 0, -1)}, {}, [((0.0, 0, -1), start)]
    while heap:
        k, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = k
        for v, w in ways.get(u, {}).items():
            c = (k[0] + w, k[1] + 1, u)
            if v not in best or c < best[v]:
                best[v] = c
                heapq.heappush(heap, (c, v))
    return done


def hops(ways, start):
    return {v: k[1] for v, k in dijkstra({u: dict.fromkeys(x, 1) for u, x in ways.items()}, start).items()}


def some(spark, directed, seed, n=40, m=70):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), rng.choice([0, 0.5, 1, 1, 3, 7])) for _ in range(m)]
    return Graph.from_rows(spark, rows, n, directed=directed).checkpointed(), rng


@pytest.mark.parametrize("directed", [False, True])
def test_least_weight(spark, directed):
    g, _ = some(spark, directed, 11)
    want = dijkstra(near(g), 0)
    assert {r["to"]: (r["weight"], r["count"], -1 if r["from"] is None else r["from"]) for r in g.bfs_weight(0).collect()} == want
    bounded = {r["to"]: r["weight"] for r in g.bfs_weight(0, 4).collect()}
    assert bounded == {v: k[0] for v, k in want.items() if k[0] <= 4}
    far = max(want, key=want.get)
    assert g.distance_weight(0, far) == want[far][0]


def test_odd_weights(spark):
    inf = float("inf")
    g = Graph.from_rows(spark, [(0, 1, inf), (1, 2, 1), (0, 3, 1e30), (3, 4, 1), (4, 5, 0), (5, 4, 0)], 7, directed=True)
    got = vector(g.all_distances_weight(0))
    assert got[:3] == [0, inf, inf] and got[3] == pytest.approx(1e30, rel=1e-6) and got[4] == got[5] == got[3] and got[6] == inf
    with pytest.raises(ValueError):
        Graph.from_rows(spark, [(0, 1, -1)], 2).all_distances_weight(0)


@pytest.mark.parametrize("directed", [False, True])
def test_pairs_from_both_ends(spark, monkeypatch, directed):
    monkeypatch.setattr(V, "RECENT", 2)
    g, rng = some(spark, directed, 12, m=55)
    ways = near(g)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(40)] + [(3, 3), (0, 45), (-1, 2)]
    got = {(r["a"], r["b"]): r["value"] for r in g.pair_distances(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(a, b): hops(ways, a).get(b) if 0 <= a < 40 else None for a, b in pairs}
    short = {(r["a"], r["b"]): r["value"] for r in g.pair_distances(spark.createDataFrame(pairs, "a long, b long"), most=2).collect()}
    assert short == {p: d if d is not None and d <= 2 else None for p, d in got.items()}
    assert {r["to"]: r["count"] for r in g.bfs_count(0).collect()} == hops(ways, 0)


def test_visited_bits(spark, monkeypatch):
    monkeypatch.setattr(V, "RECENT", 1)
    held, rng, known = V.Visited(), random.Random(1), set()
    make = lambda rows: spark.createDataFrame(sorted(rows), "source long, to long")
    for _ in range(6):
        new = {(rng.randrange(2), rng.choice([0, 7, 8, 32767, 32768, 99999, rng.randrange(200000)])) for _ in range(20)} - known
        asked = make(new | set(rng.sample(sorted(known), min(5, len(known)))))
        assert {tuple(r) for r in held.without(asked).collect()} == new
        held.add(make(new))
        known |= new


def test_a_directed_path_reads_few_rows(spark, monkeypatch):
    """On a path the bits of all rounds fall together, so what a round reads stays small and what is written grows with the rounds."""
    monkeypatch.setattr(V, "RECENT", 2)
    rows, reads = 24, []
    held = V.Visited()
    for i in range(rows):
        held.add(spark.createDataFrame([(0, i)], "source long, to long"))
        reads.append(held.rows + len(held.recent))
    assert max(reads) <= 3 and held.written <= rows
    g = Graph.from_rows(spark, [(i, i + 1) for i in range(9)], 10, directed=True)
    assert vector(g.all_distances_count(0)) == list(range(10))


@pytest.mark.parametrize("directed", [False, True])
def test_hop_counts_as_bits(spark, monkeypatch, directed):
    monkeypatch.setattr(centrality, "WORDS", 1)
    monkeypatch.setattr(centrality, "BLOCK", 64)
    rng = random.Random(7)
    g = Graph.from_rows(spark, [(rng.randrange(70), rng.randrange(70)) for _ in range(120)], 70, directed=directed).checkpointed()
    ways, want = near(g), {}
    for s in range(70):
        for t, k in hops(ways, s).items():
            if t != s:
                want[s, k] = want.get((s, k), 0) + 1
    for bits in (1 << 36, 64 * 70):
        assert {(r["id"], r["hops"]): r["n"] for r in g.hop_counts(block_bits=bits).collect()} == want
    assert {(r["id"], r["hops"]): r["n"] for r in g.hop_counts(1).collect()} == {k: n for k, n in want.items() if k[1] == 1}
    assert Graph.empty(spark, 3).hop_counts().count() == 0


def test_heavy_vertices_in_tiles(spark):
    """A star and a few more: the tiled product is the plain one, and no place of it has more than a tile's pairs of the hub."""
    rows = [(0, i, 1 + i % 3) for i in range(1, 60)] + [(i, i + 1, 2) for i in range(1, 20)]
    g = Graph.from_rows(spark, rows, 60).checkpointed()
    assert cells(g.multiply(g, tile=7)) == cells(g.square())
    t = g.transpose().multiply_const(2).checkpointed()
    assert cells(g.multiply(t, tile=5)) == cells(g.multiply(t, tile=algebra.TILE))


def test_power_iteration_of_any_size(spark):
    g, _ = some(spark, False, 3)
    ways = near(g)
    x = [(i * 7919 % 1000 + 1) / 1000 for i in range(40)]
    for _ in range(15):
        y = [sum(w * x[j] for j, w in ways.get(i, {}).items()) for i in range(40)]
        norm = sum(v * v for v in y) ** 0.5
        x = [v / norm for v in y]
    found, value = g.power_iteration(15)
    assert vector(found) == pytest.approx(x, abs=1e-9)
    assert value == pytest.approx(sum(x[i] * w * x[j] for i, r in ways.items() for j, w in r.items()))
    assert vector(Graph.empty(spark, 3).power_iteration(2)[0]) == [0, 0, 0]


@pytest.mark.parametrize("directed", [False, True])
def test_components_are_searched_in_tasks_of_their_own(spark, monkeypatch, directed):
    """Counts and distances are the same from tasks and from joins, also where targets and pairs go to several tasks, and no pair in two components is searched."""
    rng = random.Random(11)
    rows = [(c * 40 + rng.randrange(40), c * 40 + rng.randrange(40)) for c in range(3) for _ in range(70)]
    g = Graph.from_rows(spark, rows, 125, directed=directed).checkpointed()
    ways, want = near(g), {}
    for v in range(125):
        for d in hops(ways, v).values():
            if d:
                want[v, d] = want.get((v, d), 0) + 1
    monkeypatch.setattr(centrality, "TASK_WORK", 1000)
    monkeypatch.setattr(centrality, "BITS", 16)
    for local in (0, 130, 1 << 20):
        assert {(r["id"], r["hops"]): r["n"] for r in g.hop_counts(local_cells=local).collect()} == want
    assert {(r["id"], r["hops"]): r["n"] for r in g.hop_counts(2).collect()} == {k: n for k, n in want.items() if k[1] <= 2}
    pairs = [(rng.randrange(125), rng.randrange(125)) for _ in range(300)] + [(3, 3), (124, 124), (0, 300), (-1, 2)]
    asked = spark.createDataFrame(pairs, "a long, b long")
    far = {(a, b): hops(ways, a).get(b) if 0 <= a < 125 else None for a, b in pairs}
    monkeypatch.setattr(traverse, "BITS", 16)
    monkeypatch.setattr(traverse, "TASK_PAIRS", 10)
    for local in (130, 1 << 20):
        assert {(r["a"], r["b"]): r["value"] for r in g.pair_distances(asked, few=5, local_cells=local).collect()} == far
    searched = []
    monkeypatch.setattr(Graph, "_meeting", lambda self, alive, most: searched.append({(r["a"], r["b"]) for r in alive.collect()}) or alive.selectExpr("source", "a AS value").where("false"))
    g.pair_distances(asked, few=5, local_cells=0)
    assert all(a // 40 == b // 40 for a, b in searched[0])


def test_long_rows_of_bits_and_ids_far_apart():
    """Rows longer than what is ored at once, and ids that lie close together or far apart, give the hops that a plain search gives."""
    rng = random.Random(5)
    for far in (1, 10**12):
        pairs = sorted({(0, v) for v in range(1, 700)} | {(rng.randrange(900), rng.randrange(900)) for _ in range(1500)})
        src, dst = (np.array(x) * far + 3 for x in zip(*pairs, strict=True))
        ids, near_, far_ = kernels.numbered(src, dst)
        assert ids.tolist() == sorted({*src.tolist(), *dst.tolist()}) and (np.diff(near_) >= 0).all()
        assert sorted(zip(ids[near_].tolist(), ids[far_].tolist(), strict=True)) == list(zip(src.tolist(), dst.tolist(), strict=True))
        ways: dict = {}
        for a, b in zip(near_.tolist(), far_.tolist(), strict=True):
            ways.setdefault(a, {})[b] = 1
        got = {}
        for n, bits in kernels.hop_bits(near_, far_, len(ids), np.arange(len(ids))):
            for v, k in zip(*np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")), strict=True):
                got[int(v), int(k)] = n
        assert got == {(v, t): d for v in range(len(ids)) for t, d in hops(ways, v).items() if d}
    assert kernels.targets_at_once(20_000, 2048) == 2048 and kernels.targets_at_once(2_000_000, 2048) * 2_000_000 <= 1 << 29


def test_a_forest_of_near_ids_has_few_links(spark, monkeypatch):
    """The forest connects what the links connect, with as many links a task as vertices at most, also where tasks pass on what they have."""
    rng = random.Random(2)
    rows = sorted({tuple(sorted((c * 50 + rng.randrange(50), c * 50 + rng.randrange(50)), reverse=True)) for c in range(8) for _ in range(900)})
    links = stash(spark.createDataFrame(rows, "src long, dst long"))
    want = {(r["id"], r["root"]) for r in components.component_roots(links).collect()}
    for most in (components.FOREST_LINKS, 40):
        monkeypatch.setattr(components, "FOREST_LINKS", most)
        found = components.forest(links, False)
        assert {(r["id"], r["root"]) for r in components.component_roots(found).collect()} == want
        assert {r["src"]: r["n"] for r in found.groupBy("src").agg(F.sum("n").alias("n")).collect()} == dict(Counter(v for a, b in rows for v in {a, b}))
        if most > 40:
            assert found.count() <= 2 * 400 < len(rows)


def test_pair_distances_let_their_shuffle_files_go(spark, monkeypatch):
    key, real, noted = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", traverse.stash, []
    before = spark.conf.get(key, None)
    monkeypatch.setattr(traverse, "stash", lambda df, *rows: noted.append(spark.conf.get(key, None)) or real(df, *rows))
    g = Graph.from_rows(spark, [(0, 1), (1, 2), (3, 4)], 5, directed=True)
    asked = spark.createDataFrame([(0, 2), (0, 4), (3, 4)], "a long, b long")
    assert {(r["a"], r["b"]): r["value"] for r in g.pair_distances(asked, few=1).collect()} == {(0, 2): 2, (0, 4): None, (3, 4): 1}
    assert set(noted) == {"true"} and spark.conf.get(key, None) == before


def test_undirected_edges_are_made_once(spark):
    """No union makes the edges a second time for the other direction."""
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 2.0), (2, 2, 3.0)], "src long, dst long, weight double"), 3)
    assert cells(g) == {(0, 1): 2, (1, 0): 2, (2, 2): 3}
    assert "Union" not in g.cells._jdf.queryExecution().optimizedPlan().toString()


def test_harmonic_counts_let_their_shuffle_files_go(spark, monkeypatch):
    key, real, noted = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", centrality.stash, []
    monkeypatch.setattr(centrality, "stash", lambda df, *rows: noted.append(spark.conf.get(key, None)) or real(df, *rows))
    g = Graph.from_rows(spark, [(0, 1), (1, 2)], 4, directed=True).checkpointed()
    assert vector(g.harmonic_centrality(unreachable="ignore")) == pytest.approx([0.5, 1 / 3, 0, 0])
    assert set(noted) == {"true"}
