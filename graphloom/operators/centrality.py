"""Closeness and harmonic centrality from searches that carry many sources as bits."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..runtime import bucketed, drop_stash, ended_shuffles, stash
from . import kernels
from .components import sized_components
from .traverse import BITS, LOCAL_CELLS, UNREACHABLE

if TYPE_CHECKING:
    from ..model import Graph

#: Longs of a row, with a bit for each of its sources.
WORDS = 16
BLOCK = 64 * WORDS
#: Bits of all vertices and sources that one pass holds; more sources go in several passes, with the same result.
PASS_BITS = 1 << 32
#: Vertices times cells that a task searches; a component with more goes to several tasks, with a range of targets each.
TASK_WORK = 1 << 36


class Centrality:
    def hop_counts(self: Graph, most: int | None = None, block_bits: int = PASS_BITS, local_cells: int = LOCAL_CELLS) -> DataFrame:
        """``id, hops, n``: how many vertices are at each distance from ``id``, itself left out; distances that none has are missing.

        Searches don't leave a component. Those of up to ``local_cells`` cells are dealt to tasks, each of which searches from :data:`BITS` targets of its
        component at once; only its cells and the counts are moved. Larger ones are searched by joins (:meth:`_joined_counts`).
        """
        sized = sized_components(self.cells, self.directed)
        # Written, so that the shuffle files of the cells go.
        with ended_shuffles(self.spark):
            found = stash(self._local_counts(sized.where(F.col("cells") <= local_cells), most))
        large = sized.where(F.col("cells") > local_cells).select(F.col("id").alias("v"))
        return found if large.isEmpty() else found.unionByName(self._joined_counts(large, most, block_bits))

    def _local_counts(self: Graph, sized: DataFrame, most: int | None) -> DataFrame:
        parts = F.greatest(F.lit(1), F.ceil(F.col("cells").cast("double") * F.col("vertices") / TASK_WORK)).cast("int")
        own = sized.select(F.col("id").alias("src"), "root", parts.alias("parts"))
        # Of links that stand both ways one direction is dealt out.
        one_way = self.cells.select("src", "dst") if self.directed else self.cells.select("src", "dst").where("src >= dst")
        rows = one_way.join(own, "src").select("root", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst")
        directed = self.directed

        def run(table: pa.Table) -> pa.Table:
            part, parts = table["part"][0].as_py(), table["parts"][0].as_py()
            src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
            if not directed:
                apart = src != dst
                src, dst = np.concatenate([src, dst[apart]]), np.concatenate([dst, src[apart]])
            ids, src, dst = kernels.numbered(src, dst)
            counts: dict[int, np.ndarray] = {}
            targets = np.arange(len(ids) * part // parts, len(ids) * (part + 1) // parts)
            at_once = kernels.targets_at_once(len(ids), BITS)
            for low in range(0, len(targets), at_once):
                for hops, bits in kernels.hop_bits(src, dst, len(ids), targets[low : low + at_once], most):
                    counts[hops] = counts.get(hops, 0) + np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            hops, n = np.repeat(list(counts), len(ids)).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *counts.values()])
            return pa.table({"id": np.tile(ids, len(counts))[n > 0], "hops": hops[n > 0], "n": n[n > 0]})

        counted = rows.groupBy("root", "part").applyInArrow(run, "id long, hops long, n long")
        return counted.groupBy("id", "hops").agg(F.sum("n").alias("n"))

    def _joined_counts(self: Graph, vertices: DataFrame, most: int | None, block_bits: int) -> DataFrame:
        """The same for whole components of ``vertices`` (``v``), by rounds of joins.

        A row holds for a vertex and :data:`BLOCK` targets the bits of those that the last round reached. A round joins rows with the edges that lead to
        their vertices, ors what meets and takes away what was reached before; the ones are counted, so no pair has a row. Targets go in passes, and the
        tables of a pass go with it.
        """
        n = self.num_nodes
        at_once = max(1, block_bits // max(1, n) // BLOCK) * BLOCK
        # The edges are dealt out once; a round only moves its bits.
        edges = bucketed(self.cells.select(F.col("dst").alias("v"), F.col("src").alias("u")).join(vertices, "v", "left_semi"), "v")
        words, zero = [f"b{k}" for k in range(WORDS)], F.lit(0).cast("long")
        counted = []
        for low in range(0, n, at_once):
            place = (F.col("id") % BLOCK).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
            first = vertices.where(F.col("v").between(low, low + at_once - 1)).select("v", F.col("v").alias("id")).select("v", F.expr(f"id div {BLOCK}").alias("block"), *[F.when(F.floor(place / 64) == k, bit).otherwise(zero).alias(w) for k, w in enumerate(words)])
            rounds, seen, hops, tables = [stash(first)], None, 0, []
            ones = reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])
            while most is None or hops < most:
                hops += 1
                moved = rounds[-1].join(edges, "v").select(F.col("u").alias("v"), "block", *words, *[zero.alias(f"s{w}") for w in words])
                # Undirected: a neighbour of the last round is in it, in the one before, or new. Else all that was reached is kept for each vertex.
                before = rounds[-2:] if not self.directed else [seen or rounds[0]]
                known = reduce(DataFrame.unionByName, [x.select("v", "block", *words) for x in before])
                known = known.select("v", "block", *[zero.alias(w) for w in words], *[F.col(w).alias(f"s{w}") for w in words])
                met = moved.unionByName(known).groupBy("v", "block").agg(*[F.bit_or(w).alias(w) for w in [*words, *(f"s{w}" for w in words)]])
                new = [F.col(w).bitwiseAND(F.bitwise_not(F.col(f"s{w}"))) for w in words]
                if self.directed:
                    both = stash(met.select("v", "block", *[c.alias(w) for w, c in zip(words, new, strict=True)], *[F.col(w).bitwiseOR(F.col(f"s{w}")).alias(f"s{w}") for w in words]))
                    tables.append(both)
                    found = both.where(_any(words)).select("v", "block", *words)
                    seen = both.select("v", "block", *[F.col(f"s{w}").alias(w) for w in words])
                else:
                    found = stash(met.select("v", "block", *[c.alias(w) for w, c in zip(words, new, strict=True)]).where(_any(words)))
                if found.isEmpty():
                    break
                rounds.append(found)
                counted.append(stash(found.groupBy(F.col("v").alias("id")).agg(F.sum(ones).alias("n")).select("id", F.lit(hops).cast("long").alias("hops"), "n")))
                # No later round reads further back than two.
                drop_stash(*(tables[:-1] if self.directed else rounds[:-2]))
                tables, rounds = tables[-1:], rounds[-2:]
            drop_stash(*tables, *([] if self.directed else rounds))
        if not counted:
            return self.nodes.select("id", zero.alias("hops"), zero.alias("n")).where("false")
        return reduce(DataFrame.unionByName, counted).groupBy("id", "hops").agg(F.sum("n").alias("n"))

    def _hops(self: Graph, most: int | None) -> DataFrame:
        own = self.hop_counts(most).groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("hops")).alias("total"), F.sum(F.col("n") / F.col("hops")).alias("inverse"))
        zero = F.lit(0)
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("n", zero).alias("n"), F.coalesce("total", zero).alias("total"), F.coalesce("inverse", F.lit(0.0)).alias("inverse"))

    def closeness_centrality(self: Graph, unreachable: str = "count") -> DataFrame:
        """CEN-1. ``id, value``: other vertices over the sum of hops to them.

        A vertex that can't be reached adds 4294967295 hops, or with ``unreachable='ignore'`` is left out of both.
        """
        n = self.num_nodes - 1
        if unreachable == "ignore":
            return self._hops(None).select("id", ratio(F.col("n"), F.col("total")).alias("value"))
        return self._hops(None).select("id", ratio(F.lit(n), F.col("total") + (n - F.col("n")) * F.lit(UNREACHABLE).cast("double")).alias("value"))

    def harmonic_centrality(self: Graph, max_count: int | None = None, fast: bool = False, unreachable: str = "count") -> DataFrame:
        """CEN-2, CEN-3. ``id, value``: mean of 1 over hops to the other vertices.

        Beyond ``max_count`` hops or unreachable a vertex adds 1/4294967295; with ``unreachable='ignore'``, or ``fast`` and at most 3
        hops, it adds 0.
        """
        n = self.num_nodes - 1
        ignore = unreachable == "ignore" or (fast and max_count in (0, 1, 2, 3))
        rest = F.lit(0.0) if ignore else (n - F.col("n")) / F.lit(float(UNREACHABLE))
        return self._hops(max_count).select("id", ratio(F.col("inverse") + rest, F.lit(n)).alias("value"))


def _any(words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(w) != 0 for w in words])
