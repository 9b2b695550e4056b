"""Traversal as fixpoints: frontiers that are joined with the edges, round by round, each round written to the shared folder."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_stash, ended_shuffles, stash
from . import kernels
from .components import component_roots, sized_components
from .labels import simplify_labels
from .visited import Visited

if TYPE_CHECKING:
    from ..model import Graph

#: The hop count of a vertex that can't be reached, where tables show one.
UNREACHABLE = 4294967295
#: The bucket of weights that are infinite, not a number or out of scale.
LAST = 1 << 60
#: Cells of a component that one task may hold; larger ones are searched by joins.
LOCAL_CELLS = 1 << 22
#: Targets that are searched from at once in a task, at most.
BITS = 2048
#: So many pairs are searched from both ends; of more, those within one component share searches.
FEW_PAIRS = 1_000
#: Pairs of one component that one task looks up.
TASK_PAIRS = 1 << 20


class Traversal:
    def _starts(self: Graph, start: int) -> DataFrame:
        """No row for a start out of range."""
        return self.spark.range(1 if 0 <= start < self.num_nodes else 0).select(F.lit(start).cast("long").alias("source"))

    def hop_tree(self: Graph, starts: DataFrame, most: int | None = None, until: int | None = None) -> DataFrame:
        """``source, from, to, count, weight`` for each vertex that a source reaches in ``most`` hops.

        Of several parents at the same distance the least id is taken; ``weight`` adds up along the parents, in the start it is 0 and
        the parent null. A vertex is joined with the edges once for each source, in the round after it was reached. With ``until`` the rounds end when
        one has reached that vertex.
        """
        first = starts.select("source", F.lit(None).cast("long").alias("from"), F.col("source").alias("to"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("weight"))
        rounds, hops = [stash(first)], 0
        reached = Visited()
        reached.add(rounds[0])
        while most is None or hops < most:
            hops += 1
            edge = self.cells.select(F.col("src").alias("to"), "dst", F.col("weight").cast("double").alias("_w"))
            ways = rounds[-1].join(edge, "to").groupBy("source", F.col("dst").alias("to")).agg(F.min(F.struct(F.col("to").alias("from"), (F.col("weight") + F.col("_w")).alias("weight"))).alias("way"))
            if self.directed:
                new = reached.without(ways)
            else:
                # A neighbour of the last round is in that round, the one before, or new.
                new = ways.join(reduce(DataFrame.unionByName, rounds[-2:]).select("source", "to"), ["source", "to"], "left_anti")
            found = stash(new.select("source", "way.from", "to", F.lit(hops).cast("long").alias("count"), "way.weight"))
            if found.isEmpty():
                drop_stash(found)
                break
            rounds.append(found)
            if self.directed:
                reached.add(found)
            if until is not None and not found.where(F.col("to") == until).isEmpty():
                break
        return reduce(DataFrame.unionByName, rounds)

    def weight_tree(self: Graph, starts: DataFrame, most: float | None = None, until: int | None = None) -> DataFrame:
        """The same by least weight, then hops, then parent's id.

        Vertices are settled in buckets of weight. In the open bucket short edges are followed until nothing improves; then all its vertices are final, and their edges lead to
        candidates of later buckets, which nobody looks at before. So a round rewrites the open bucket alone. With ``until`` it ends when that vertex is settled. Negative weights raise ValueError.
        """
        row = self.cells.agg(F.min("weight").alias("low"), F.avg(F.when(F.abs("weight") < float("inf"), F.col("weight"))).alias("mean")).first()
        if row["low"] is not None and row["low"] < 0:
            raise ValueError("shortest paths need weights of 0 or more")
        step = 2 * row["mean"] if row["mean"] else 1.0
        edge = self.cells.select(F.col("src").alias("to"), "dst", F.col("weight").cast("double").alias("_w"))
        places = F.col("weight") / F.lit(step)
        bucket = F.when(F.isnan(places) | (places >= LAST), F.lit(LAST)).otherwise(F.floor(places)).cast("long")
        way = F.struct("weight", "count", "from").alias("way")
        first = starts.select("source", F.col("source").alias("to"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("count"), F.lit(None).cast("long").alias("from"), F.lit(0).cast("long").alias("bucket"))
        waiting, settled, final = [(stash(first), 0, 0)], Visited(), []

        def followed(rows: DataFrame, edges: DataFrame) -> DataFrame:
            tried = rows.join(edges, "to").select("source", F.col("dst").alias("to"), (F.col("weight") + F.col("_w")).alias("weight"), (F.col("count") + 1).alias("count"), F.col("to").alias("from"))
            return (tried if most is None else tried.where(F.col("weight") <= most)).withColumn("bucket", bucket)

        best = lambda rows: rows.groupBy("source", "to").agg(F.min(way).alias("way"))
        while waiting:
            k = min(low for _, low, _ in waiting)
            due = reduce(DataFrame.unionByName, [t for t, low, high in waiting if low <= k <= high]).where(F.col("bucket") == k)
            opened = stash(settled.without(best(due)).select("source", "to", "way", F.lit(True).alias("new")))
            # Only edges that are shorter than a bucket can end in it; in the last one, of what is out of scale, all can.
            short = edge.where(F.col("_w") < step) if k < LAST else edge
            while not opened.where("new").isEmpty():
                tried = followed(opened.where("new").select("source", "to", "way.*"), short).where(F.col("bucket") == k)
                tried = settled.without(best(tried)).select("source", "to", F.col("way").alias("other"))
                both = opened.join(tried, ["source", "to"], "full_outer")
                # A start keeps its own row: nothing is less than weight 0 and 0 hops.
                key = lambda c: F.struct(f"{c}.weight", f"{c}.count", F.coalesce(F.col(f"{c}.from"), F.lit(-1)))
                better = F.col("way").isNull() | (F.col("other").isNotNull() & (key("other") < key("way")))
                kept = stash(both.select("source", "to", F.when(better, F.col("other")).otherwise(F.col("way")).alias("way"), better.alias("new")))
                drop_stash(opened)
                opened = kept
            rows = opened.select("source", "way.from", "to", "way.count", "way.weight")
            final.append(rows)
            settled.add(opened)
            if until is not None and not rows.where(F.col("to") == until).isEmpty():
                break
            later = stash(best(followed(rows, edge).where(F.col("bucket") > k)).select("source", "to", "way.*").withColumn("bucket", bucket))
            span = later.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
            # What starts no earlier than the next bucket is left of each table that waits.
            ahead = [(t, self._next_bucket(t, k), high) for t, _, high in waiting if high > k]
            waiting = ahead + ([(later, span["low"], span["high"])] if span["low"] is not None else [])
        return reduce(DataFrame.unionByName, final)

    def _next_bucket(self: Graph, waiting: DataFrame, k: int) -> int:
        return waiting.where(F.col("bucket") > k).agg(F.min("bucket").alias("b")).first()["b"]

    def pair_distances(self: Graph, pairs: DataFrame, most: int | None = None, few: int = FEW_PAIRS, local_cells: int = LOCAL_CELLS) -> DataFrame:
        """TRV-2 for a table of pairs ``a, b``: ``a, b, value``, the hops from ``a`` to ``b``, null if it can't be reached (in ``most`` hops).

        Up to ``few`` pairs are searched one by one from both ends. Of more, pairs in two components have no way and aren't searched; pairs in a component of up to
        ``local_cells`` cells share the searches of a task, as bits; those in larger ones are searched from both ends. Repeated pairs are one.
        """
        # All but the last join is written, so that its shuffle files go before that.
        with ended_shuffles(self.spark):
            wanted = stash(pairs.select("a", "b").distinct().withColumn("source", F.monotonically_increasing_id()))
            there = lambda c: F.col(c).between(0, self.num_nodes - 1)
            alive = wanted.where(there("a") & there("b"))
            if len(wanted.limit(few + 1).take(few + 1)) <= few:
                every = self._meeting(alive, most)
            else:
                same = alive.where("a = b").select("source", F.lit(0).cast("long").alias("value"))
                sized = sized_components(self.cells, self.directed)
                end = lambda c: sized.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"), *[F.col(x).alias(f"_{x}") for x in ["cells"] if c == "a"])
                joint = stash(alive.where("a <> b").join(end("a"), "a").join(end("b"), "b").where("_a = _b").select("source", "a", "b", F.col("_a").alias("root"), F.col("_cells").alias("cells")))
                every = same.unionByName(self._looked_up(joint.where(F.col("cells") <= local_cells), sized, most))
                large = joint.where(F.col("cells") > local_cells)
                if not large.isEmpty():
                    every = every.unionByName(self._meeting(large, most))
            every = stash(every)
        return wanted.join(every, "source", "left").select("a", "b", "value")

    def _looked_up(self: Graph, pairs: DataFrame, sized: DataFrame, most: int | None) -> DataFrame:
        """``source, value`` for pairs whose ends are in one component (``root``) that a task can hold."""
        parts = pairs.groupBy("root").agg(F.ceil(F.count("*") / TASK_PAIRS).cast("int").alias("parts"))
        roots = sized.select(F.col("id").alias("src"), "root").join(parts, "root")
        cells = self.cells.select("src", "dst").join(roots, "src").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst")
        dealt = pairs.join(parts, "root").select("root", F.pmod(F.hash("b"), F.col("parts")).alias("part"), "source", "a", "b")

        def run(cells: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
            found = np.full(len(pairs), -1)
            if len(pairs) and len(cells):
                ids, src, dst = kernels.numbered(cells["src"].to_numpy(), cells["dst"].to_numpy())
                a = np.searchsorted(ids, pairs["a"].to_numpy())
                ends, k = np.unique(pairs["b"].to_numpy(), return_inverse=True)
                ends, order = np.searchsorted(ids, ends), np.argsort(k, kind="stable")
                a, k = a[order], k[order]
                at_once = kernels.targets_at_once(len(ids), BITS)
                for low in range(0, len(ends), at_once):
                    own = slice(*np.searchsorted(k, (low, low + at_once)))
                    at, place = a[own], k[own] - low
                    for hops, bits in kernels.hop_bits(src, dst, len(ids), ends[low : low + at_once], most):
                        met = bits[at, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) == 1
                        found[order[own][met]] = hops
            return pd.DataFrame({"source": pairs["source"], "value": found})[found >= 0]

        return cells.groupBy("root", "part").cogroup(dealt.groupBy("root", "part")).applyInPandas(run, "source long, value long")

    def _meeting(self: Graph, alive: DataFrame, most: int | None) -> DataFrame:
        """``source, value`` for the pairs of ``alive`` that have a way.

        Each pair searches from both ends at once, forwards from ``a`` and backwards from ``b``; the side with fewer vertices at its edge takes the next step. Both meet
        in the middle, so a pair looks at the vertices of two half distances. Pairs that have met, or have a side that can't go on, leave.
        """
        sides = [stash(alive.select("source", F.col(c).alias("to"))) for c in ("a", "b")]
        edges = [self.cells.select(F.col(x).alias("to"), F.col(y).alias("_end")) for x, y in (("src", "dst"), ("dst", "src"))]
        rounds, reached, hops = [[s] for s in sides], [Visited(), Visited()], 0
        met = [stash(alive.where("a = b").select("source", F.lit(0).cast("long").alias("value")))]
        for k in (0, 1):
            reached[k].add(sides[k])
            sides[k] = sides[k].join(met[0], "source", "left_anti")
        while most is None or hops < most:
            sizes = [s.count() for s in sides]
            if not all(sizes):
                break
            k = 0 if sizes[0] <= sizes[1] else 1
            ways = sides[k].join(edges[k], "to").select("source", F.col("_end").alias("to")).distinct()
            found = stash(reached[k].without(ways) if self.directed else ways.join(reduce(DataFrame.unionByName, rounds[k][-2:]), ["source", "to"], "left_anti"))
            hops += 1
            rounds[k].append(found)
            if self.directed:
                reached[k].add(found)
            new = stash(found.join(sides[1 - k], ["source", "to"], "left_semi").select("source").distinct().withColumn("value", F.lit(hops).cast("long")))
            met.append(new)
            # A pair goes on if it hasn't met and both sides have somewhere to go.
            sides[k] = found.join(new, "source", "left_anti")
            sides[1 - k] = stash(sides[1 - k].join(found.select("source").distinct(), "source", "left_semi").join(new, "source", "left_anti"))
        return reduce(DataFrame.unionByName, met)

    def bfs_count(self: Graph, start: int, most: int | None = None) -> DataFrame:
        """TRV-7. ``weight, count, from, to`` in the order of hops, then ids."""
        return self.hop_tree(self._starts(start), most).select("weight", "count", "from", "to").orderBy("count", "to")

    def bfs_weight(self: Graph, start: int, most: float | None = None) -> DataFrame:
        """TRV-7 by weight."""
        return self.weight_tree(self._starts(start), most).select("weight", "count", "from", "to").orderBy("weight", "count", "to")

    def distance_count(self: Graph, i: int, j: int) -> int | None:
        """TRV-2. Hops, null if ``j`` can't be reached; searched from both ends."""
        return self.pair_distances(self.spark.createDataFrame([(i, j)], "a long, b long")).first()["value"]

    def distance_weight(self: Graph, i: int, j: int) -> float:
        """TRV-3. Least weight, infinite if ``j`` can't be reached."""
        row = self.weight_tree(self._starts(i), until=j).where(F.col("to") == j).first()
        return row["weight"] if row else float("inf")

    def all_distances_count(self: Graph, start: int, most: int | None = None) -> DataFrame:
        """TRV-4. ``id, value`` for every vertex; null beyond ``most`` hops."""
        own = self.hop_tree(self._starts(start), most).select(F.col("to").alias("id"), F.col("count").alias("value"))
        return self.nodes.join(own, "id", "left")

    def all_distances_weight(self: Graph, start: int, most: float | None = None) -> DataFrame:
        """TRV-5. ``id, value`` for every vertex; infinite beyond weight ``most``."""
        own = self.weight_tree(self._starts(start), most).select(F.col("to").alias("id"), F.col("weight").alias("value"))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("value", F.lit(float("inf"))).alias("value"))

    def all_distances_graph(self: Graph, use_weights: bool = False) -> Graph:
        """TRV-6. Distances between all pairs that reach each other, as a directed graph without self-loops.

        All sources go at once, round by round; the result has up to the square of the vertex count as cells.
        """
        starts = self.nodes.select(F.col("id").alias("source"))
        found = self.weight_tree(starts).withColumn("value", F.col("weight")) if use_weights else self.hop_tree(starts).withColumn("value", F.col("count"))
        cells = found.where("source <> to").select(F.col("source").alias("src"), F.col("to").alias("dst"), F.col("value").cast("float").alias("weight"))
        return self.like(cells, directed=True)

    def component_roots(self: Graph) -> DataFrame:
        """``id, label``: the least vertex of each vertex's component."""
        self.require_undirected("a component")
        roots = component_roots(self.cells)
        return self.nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label"))

    def connected_components(self: Graph) -> DataFrame:
        """TRV-8. ``id, label``: components are numbered in the order of their least vertices."""
        return simplify_labels(self.component_roots())
