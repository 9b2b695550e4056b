"""Exact top-k search by inner product: ball trees with branch and bound in each shard (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import small_batches, stash

LEAF = 64
#: Slack of the bounds, relative to the norms, that covers rounding: a node that just ties is still searched.
SLACK = 1e-9
#: Below this, whole numbers and their sums are exact as doubles; below the other, as longs.
DOUBLES, LONGS = 2.0**52, 2.0**62


def _cuts(n: int) -> list[np.ndarray]:
    """Borders of the nodes, level by level, in a tree over ``n`` rows; each node is halved until about :data:`LEAF` rows are left."""
    out = [np.array([0, n])]
    for _ in range(max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0):
        a, b = out[-1][:-1], out[-1][1:]
        out.append(np.concatenate([[0], np.stack([a + (b - a) // 2, b], axis=1).ravel()]))
    return out


def _products(queries: np.ndarray, vectors: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products of whole numbers; ``size`` bounds their absolute values."""
    if size < DOUBLES:
        return queries.astype(float) @ vectors.astype(float).T
    if size < LONGS:
        return queries @ vectors.T
    return queries.astype(object) @ vectors.astype(object).T


def _halves(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that order like the scores and add up to them, the first in units of 2^62 (0 for all but enormous ones)."""
    if scores.dtype != object:
        return np.zeros(len(scores), np.int64), scores.astype(np.int64)
    unit, most = 1 << 62, (1 << 63) - 1
    high = [(abs(s) // unit) * (1 if s >= 0 else -1) for s in scores]
    low = [s - h * unit for s, h in zip(scores, high, strict=True)]
    return np.array([max(-most, min(most, h)) for h in high], np.int64), np.array(low, np.int64)


class BallTree:
    """A complete binary tree over one shard's vectors of whole numbers; level by level the centres and radii of its nodes.

    Rows are ordered so that the nodes of every level are runs of rows, whose borders follow from the number of rows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.ids, self.vectors, self.real = ids, vectors, vectors.astype(float)
        self.cuts = _cuts(len(ids))
        nodes = np.cumsum([len(c) - 1 for c in self.cuts])[:-1]
        self.centres, self.radii = np.split(centres, nodes), np.split(radii, nodes)
        self.largest = float(np.abs(self.real).max()) if self.real.size else 0.0

    @classmethod
    def grown(cls, ids: np.ndarray, vectors: np.ndarray) -> BallTree:
        order, real, cuts = np.arange(len(ids)), vectors.astype(float), _cuts(len(ids))
        for level in cuts[:-1]:
            for a, b in zip(level[:-1], level[1:], strict=True):
                rows = order[a:b]
                if len(rows) > 1:
                    own = real[rows]
                    # Split at the median along the line to the row that is farthest from the centre.
                    middle = own.mean(axis=0)
                    far = own[((own - middle) ** 2).sum(axis=1).argmax()] - middle
                    order[a:b] = rows[np.argsort(own @ far, kind="stable")]
        real = real[order]
        ends = [(a, b) for level in cuts for a, b in zip(level[:-1], level[1:], strict=True)]
        centres, radii = np.zeros((len(ends), vectors.shape[1])), np.zeros(len(ends))
        for i, (a, b) in enumerate(ends):
            if b > a:
                centres[i] = real[a:b].mean(axis=0)
                radii[i] = np.sqrt(((real[a:b] - centres[i]) ** 2).sum(axis=1).max())
        return cls(ids[order], vectors[order], centres, radii)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query place, score (as by :func:`_halves`) and id of what can be among each query's best k, given k-th scores known from elsewhere.

        Nodes go on while their upper bound (inner product with the centre, plus norm times radius) reaches the query's current k-th
        score. Leaves come in the order of their bounds; scores found raise the k-th score for all that follows.
        """
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not len(self.ids) or not len(qids):
            return best
        asked = queries.astype(float)
        size = asked.shape[1] * self.largest * (float(np.abs(asked).max()) if asked.size else 0.0)
        bound, norm = bound.copy(), np.sqrt((asked**2).sum(axis=1))
        q, node = np.arange(len(qids)), np.zeros(len(qids), int)
        upper = np.zeros(0)
        for level in range(len(self.cuts)):
            if level:
                q, node = np.repeat(q, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            upper = np.empty(len(q))
            for i in range(0, len(q), 1 << 14):
                s = slice(i, i + (1 << 14))
                c, r = self.centres[level][node[s]], self.radii[level][node[s]]
                dot = np.einsum("ij,ij->i", asked[q[s]], c)
                upper[s] = dot + norm[q[s]] * r + SLACK * (1 + norm[q[s]] * (r + np.sqrt((c**2).sum(axis=1))))
            alive = (upper >= bound[q]) & (self.cuts[level][node + 1] > self.cuts[level][node])
            q, node, upper = q[alive], node[alive], upper[alive]
        order = np.lexsort([-upper, q])
        q, node, upper = q[order], node[order], upper[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, int)
        turn = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) if len(q) else np.zeros(0, int)
        # Each query's best leaf, then its next four, sixteen and so on: later turns meet higher k-th scores.
        start, wide = 0, 1
        while len(q) and start <= turn.max():
            now = np.flatnonzero((turn >= start) & (turn < start + wide))
            now = now[upper[now] >= bound[q[now]]]
            now = now[np.argsort(node[now], kind="stable")]
            for part in np.split(now, np.flatnonzero(np.diff(node[now])) + 1) if len(now) else []:
                a, b = self.cuts[-1][node[part[0]]], self.cuts[-1][node[part[0]] + 1]
                who = q[part]
                scores = asked[who] @ self.real[a:b].T if size < DOUBLES else _products(queries[who], self.vectors[a:b], size)
                hit = (scores.astype(float) >= bound[who][:, None]) & (self.ids[a:b][None, :] != qids[who][:, None])
                i, j = np.nonzero(hit)
                if len(i):
                    best = self._merge(best, (who[i], *_halves(scores[i, j]), self.ids[a:b][j]), k, bound)
            start, wide = start + wide, wide * 4
        return best

    @staticmethod
    def _merge(best: tuple, more: tuple, k: int, bound: np.ndarray) -> tuple:
        q, high, low, ids = (np.concatenate(x) for x in zip(best, more, strict=True))
        order = np.lexsort([ids, ~low, ~high, q])
        q, high, low, ids = q[order], high[order], low[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == k - 1
        bound[q[last]] = np.maximum(bound[q[last]], kth(high[last], low[last]))
        keep = rank < k
        return q[keep], high[keep], low[keep], ids[keep]


def kth(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A score as a double, never above it."""
    return np.where(high == 0, low.astype(float), (high.astype(float) * LONGS + low) - np.abs(high) * LONGS * 1e-14)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """Part, dimension, ids and vectors of each run of equal part and dimension in rows that are sorted by them; one run is held at a time."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        part, dim, ids = (batch.column(i).to_numpy() for i in range(3))
        flat, at = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
        edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(dim) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
            key = (int(part[a]), int(dim[a]))
            if held and key != now:
                yield now, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
            now = key
            held.append((ids[a:b], flat[at[a] - at[0] : at[b] - at[0]].reshape(b - a, key[1])))
    if held:
        yield now, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _sorted(rows: DataFrame, part: Column) -> DataFrame:
    dealt = rows.select(part.cast("long").alias("part"), F.size("ints").cast("long").alias("dim"), "vec_id", "ints")
    return dealt.repartition("part").sortWithinPartitions("part", "dim")


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard and dimension: the finished tree."""
    for (shard, dim), ids, vectors in _runs(batches):
        tree = BallTree.grown(ids, vectors)
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int64()),
                "dim": pa.array([dim], pa.int64()),
                "ids": [_bytes(tree.ids, "<i8")],
                "vectors": [_bytes(tree.vectors, "<i8")],
                "centres": [_bytes(np.concatenate(tree.centres), "<f8")],
                "radii": [_bytes(np.concatenate(tree.radii), "<f8")],
            }
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block and dimension: its queries."""
    for (block, dim), ids, vectors in _runs(batches):
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "dim": pa.array([dim], pa.int64()), "ids": [_bytes(ids, "<i8")], "vectors": [_bytes(vectors, "<i8")]})


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, shard_numbers: int = 1 << 20, shard_rows: int = 16_384, block_rows: int = 1_024, copy_blocks: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every`` its k highest inner products.

    Components x become floor(256 * x), kept within a long; scores are exact whole numbers, ties go to the smaller vec_id, and fewer than k
    candidates give fewer ranks. A score beyond a long is given as the nearest long, but ranked by its own value (values beyond 2^124 count as
    equal). Candidates are all rows but those with the query's own vec_id, of the query's dimension. Vectors that are null or hold null,
    NaN or infinite components take no part, nor do rows without vec_id; a query that is there twice is asked once,
    a candidate that is there twice is found twice; rows of one vec_id with different vectors are one query whose scores compete. An empty
    table gives an empty result.

    Plan: candidates are dealt by a hash of the row into shards of at most about ``shard_rows`` rows and ``shard_numbers`` components; each shard's
    tree is built once and written. Queries are packed into blocks of ``block_rows``. Each block first searches one shard; then the blocks,
    with the k-th scores found there, go to all other shards. Trees don't follow the blocks: a tree is sent once in each of the two rounds, and once more for
    every ``copy_blocks`` blocks beyond the first, so that no task has more blocks than that. What is shuffled is the table a few
    times, and the queries once for each shard. A task holds one tree and one block.
    """
    spark = embeddings.sparkSession
    small_batches(spark, rows=4_096)
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(F.when(fine, x), lambda v: F.floor(v.cast("double") * 256))
    rows = stash(embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints")))
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ints")), F.lit(0)).alias("numbers"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    shards = max(1, -(-sizes["n"] // shard_rows), -(-sizes["numbers"] // shard_numbers))
    blocks = max(1, -(-sizes["q"] // block_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id"), F.col("ints")), F.lit(n))
    trees = stash(_sorted(rows, deal(shards, 1)).mapInArrow(_trees, "shard bigint, dim bigint, ids binary, vectors binary, centres binary, radii binary"))
    asked = stash(_sorted(rows.where(F.col("vec_id") % every == 0).distinct(), deal(blocks, 2)).mapInArrow(_blocks, "block bigint, dim bigint, ids binary, vectors binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                key = row["shard"], row["copy"], row["dim"]
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dim"])
                if row["block"] < 0:
                    radii = np.frombuffer(row["radii"], "<f8")
                    tree, at = BallTree(ids, vectors, np.frombuffer(row["centres"], "<f8").reshape(len(radii), row["dim"]), radii), key
                elif key == at:
                    known = {p["query_id"]: p["kth"] for p in row["known"] or []}
                    q, high, low, found = tree.search(ids, vectors, k, np.array([known.get(int(n), -np.inf) for n in ids], float))
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([row["block"]] * len(q), pa.int64()), "query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(found, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())}
                    )

    none = F.lit(None).cast("binary")

    def met(sent: DataFrame, of: DataFrame, copies: int) -> DataFrame:
        """What the blocks in ``sent`` find in their shard (column ``shard``); each tree in ``of`` stands before the blocks that ask it."""
        there = of.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "dim", F.lit(-1).cast("long").alias("block"), "ids", "vectors", "centres", "radii", F.lit(None).cast(sent.schema["known"].dataType).alias("known"))
        asks = sent.select("shard", (F.col("block") % copies).alias("copy"), "dim", "block", "ids", "vectors", none.alias("centres"), none.alias("radii"), "known")
        dealt = there.unionByName(asks).repartition(min(2 * shards * copies, 10_000), "shard", "copy").sortWithinPartitions("shard", "copy", "dim", "block")
        return stash(dealt.mapInArrow(search, "block bigint, query_id bigint, vec_id bigint, high bigint, low bigint"))

    best_first = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    home = F.col("block") % shards
    pilot = met(asked.select(home.alias("shard"), "*", F.lit(None).cast("array<struct<query_id:bigint,kth:double>>").alias("known")), trees.where(F.col("shard") < blocks), -(-blocks // (shards * copy_blocks)))
    found = pilot
    if shards > 1:
        last = pilot.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k)
        score = F.when(F.col("high") == 0, F.col("low").cast("double")).otherwise(F.col("high") * F.lit(LONGS) + F.col("low") - F.abs("high") * F.lit(LONGS * 1e-14))
        known = last.groupBy("block").agg(F.collect_list(F.struct("query_id", score.alias("kth"))).alias("known"))
        every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
        sent = asked.join(known, "block", "left").select(every_shard, "*").where(F.col("shard") != home)
        found = pilot.unionByName(met(sent, trees, -(-blocks // copy_blocks)))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    whole = F.when(F.col("high") >= 2, F.lit((1 << 63) - 1)).when(F.col("high") <= -2, F.lit(-(1 << 63))).otherwise(F.col("high") * (1 << 62) + F.col("low"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", whole.alias("score"))
