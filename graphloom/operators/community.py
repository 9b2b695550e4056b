"""Communities and anti-communities: label propagation, greedy agglomeration and block-model sampling."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import drop_stash, ended_shuffles, partitions, running_totals, stash
from . import kernels
from .components import linked_roots

if TYPE_CHECKING:
    from ..model import Graph

#: Vertices up to which agglomeration over all pairs of a directed graph, or one with negative strengths, is done on a dense matrix in one task.
DENSE_VERTICES = 5_000


class Community:
    def laprop(self: Graph, written: bool = False) -> DataFrame:
        """COM-1. ``id, label``: groups without inner links.

        Vertices begin with their own ids. In ascending order each takes over the label of the first vertex that isn't its neighbour, has a
        lower label, and whose label no neighbour carries; at once, so later vertices see it. Sweeps go on until one changes
        nothing.

        In the first sweep only lower vertices carry labels that can be taken over, and the first vertex with a label is the one whose id it is. So labels
        in ascending order are colours, and each vertex takes the least colour that no lower neighbour has; then lower neighbours
        have all lesser colours, and a second sweep changes nothing. Colours depend on neighbours alone, so each component is coloured by a task of its own, from its cells in
        one direction, and a label is the least vertex of its colour in the whole graph.
        ``written``: the cells come from a written table, so they needn't be written again.
        """
        self.require_undirected("label propagation")

        def run(table: pa.Table) -> pa.Table:
            ids, colours = kernels.spread_colours(table["src"].to_numpy(), table["dst"].to_numpy())
            return pa.table({"id": ids, "colour": colours})

        with ended_shuffles(self.spark):
            lower = self.cells.select("src", "dst").where("src >= dst")
            lower = lower if written else stash(lower)
            roots = linked_roots(lower)
            parts = lower.join(roots.select(F.col("id").alias("src"), "root"), "src")
            found = parts.groupBy("root").applyInArrow(run, "id long, colour long")
            # A vertex without links has the least colour.
            coloured = stash(self.nodes.join(found, "id", "left").select("id", F.coalesce("colour", F.lit(0)).alias("colour")))
            if not written:
                drop_stash(lower)
        labels = coloured.groupBy("colour").agg(F.min("id").alias("label"))
        return coloured.join(labels, "colour").select("id", "label")

    def newman(self: Graph, minimize: bool = False, fast: bool = False, antimodularity: bool = False, num_clusters: int | None = None, strict: bool = False) -> DataFrame:
        """COM-2. ``id, label``: the best labelling on the way of greedy merges from single vertices.

        Labels are ids of vertices. ``fast`` looks at linked pairs only (with ``minimize``: unlinked ones, and for directed graphs all); ``antimodularity``
        works on the squared graph. With ``num_clusters`` only labellings of that many groups count; ValueError if there
        is none. ``strict`` checks the objective of the result against one computed anew.

        Fast maximising never merges across components, and gains depend on both communities and the norm alone, so components
        run as tasks of their own and their merges are put into the global order afterwards. The other kinds compare pairs across
        components: one task, with the links of an undirected graph in memory; on a dense matrix, for at most DENSE_VERTICES vertices, where
        the graph is directed or strengths are negative.
        """
        given = self._merge_input(antimodularity)
        log = stash(self._merges(*given, minimize, fast))
        n = self.num_nodes
        start = self._initial_objective(*given)
        summed = stash(running_totals(log, [F.col("order")], {"_before": F.col("delta")}).withColumn("objective", F.lit(start) + F.col("_before") + F.col("delta")))
        better = F.asc("objective") if minimize else F.desc("objective")
        allowed = summed if num_clusters is None else summed.where(F.col("order") + 1 == n - num_clusters)
        best = allowed.orderBy(better, "order").select("order", "objective").first()
        zero = num_clusters is None or num_clusters == n
        steps = None
        if best is not None and (not zero or (best["objective"] < start if minimize else best["objective"] > start)):
            steps = best["order"] + 1
        elif zero:
            steps = 0
        if steps is None:
            raise ValueError(f"no labelling on the way has {num_clusters} groups")
        labels = self._apply_merges(summed.where(F.col("order") < steps))
        if strict:
            found = self._objective_of(labels, *given)
            claimed = start if steps == 0 else best["objective"]
            if abs(found - claimed) >= 1e-5 * max(1.0, abs(claimed)):
                raise AssertionError(f"objective {claimed} was expected, {found} found")
        return labels

    def merges(self: Graph, minimize: bool = False, fast: bool = False, antimodularity: bool = False) -> DataFrame:
        """``order, delta, index0, index1``: all merges in the order in which the greedy algorithm makes them."""
        return self._merges(*self._merge_input(antimodularity), minimize, fast).select("order", "delta", "index0", "index1")

    def _merges(self: Graph, cells: DataFrame, norm: float, strengths: DataFrame, minimize: bool, fast: bool) -> DataFrame:
        """The merges and ``part``, the component (0 where all are one task's)."""
        n, directed = self.num_nodes, self.directed
        if fast and not minimize:
            # Gains without a finite norm have no order to go by, so such graphs stay with the kernel that takes them as they come.
            one_way = not directed and norm != 0 and math.isfinite(norm)
            cells = cells.where("src >= dst") if one_way else cells
            with ended_shuffles(self.spark):
                cells = stash(cells.select("src", "dst", "weight"))
                roots = linked_roots(cells, directed)
                own = strengths.join(roots, "id")
                # Strengths are rows behind the links: one table is dealt out, of few columns.
                rows = cells.join(roots, F.col("src") == F.col("id")).select(F.col("root").alias("part"), "src", "dst", F.col("weight").cast("double").alias("value"))
                for k, c in enumerate(["o"] if one_way else ["o", "i"], 1):
                    rows = rows.unionByName(own.select(F.col("root").alias("part"), F.col("id").alias("src"), F.lit(-k).cast("long").alias("dst"), F.col(c).alias("value")))
                rows = stash(rows)
                drop_stash(cells)

            def run(table: pa.Table) -> pa.Table:
                part = table["part"][0].as_py()
                src, dst, value = (table[c].to_numpy() for c in ("src", "dst", "value"))
                del table
                outs, ins = (dict(zip(src[dst == -k].tolist(), value[dst == -k].tolist(), strict=True)) for k in (1, 2))
                real = dst >= 0
                src, dst, weight = src[real], dst[real], value[real].astype(np.float32)
                if one_way:
                    log = kernels.greedy_neighbours(src, dst, weight, norm, outs)
                else:
                    order = np.lexsort((dst, src))
                    log = kernels.greedy_links(src[order], dst[order], weight[order], norm, directed, {v: (o, ins[v]) for v, o in outs.items()})
                delta, index0, index1 = zip(*log, strict=True) if log else ((), (), ())
                return pa.table({"part": pa.array([part] * len(log), "int64"), "step": pa.array(range(len(log)), "int32"), "delta": pa.array([float(x) for x in delta], "float64"), "index0": pa.array([int(x) for x in index0], "int64"), "index1": pa.array([int(x) for x in index1], "int64")})

            # By ranges, so that a few components are dealt out one by one.
            with ended_shuffles(self.spark):
                log = stash(rows.repartitionByRange(partitions(self.spark), "part").groupBy("part").applyInArrow(run, f"part long, {kernels.MERGES}"))
                drop_stash(rows)
            # Components take turns by the gain at their heads. A merge waits for the worst head up to it in its own component, so
            # ordering by that worst head is the order in which the heads are taken.
            head = F.struct((-F.col("delta")).alias("d"), F.col("index0").alias("i"), F.col("index1").alias("j"))
            worst = F.max(head).over(Window.partitionBy("part").orderBy("step"))
            ranked = log.withColumn("_worst", worst)
            return running_totals(ranked, [F.col("_worst"), F.col("step")], {"order": F.lit(1).cast("long")}).select("part", "order", "delta", "index0", "index1")
        sparse = not directed and norm > 0 and strengths.where("o < 0").isEmpty()
        if n > DENSE_VERTICES and not sparse:
            raise ValueError(f"agglomeration over all pairs of a directed graph or with negative strengths is for at most {DENSE_VERTICES} vertices")
        which = "apart" if fast and minimize else "any"
        mark = self.spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(0.0).cast("float").alias("weight"), F.lit(0.0).alias("o"), F.lit(0.0).alias("i"))
        rows = cells.select("src", "dst", "weight", F.lit(0.0).alias("o"), F.lit(0.0).alias("i")).unionByName(strengths.select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(0.0).cast("float").alias("weight"), "o", "i")).unionByName(mark)

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            out, inn = np.zeros(n), np.zeros(n)
            own, links = pdf[(pdf["dst"] < 0) & (pdf["src"] >= 0)], pdf[pdf["dst"] >= 0]
            out[own["src"]], inn[own["src"]] = own["o"], own["i"]
            if sparse:
                log = kernels.greedy_scattered(links["src"].to_numpy(), links["dst"].to_numpy(), links["weight"].to_numpy(float), norm, out, minimize, which)
            else:
                matrix = np.full((n, n), np.nan)
                matrix[links["src"], links["dst"]] = links["weight"]
                log = kernels.greedy_pairs(matrix, out, inn if directed else out, norm, directed, minimize, which) if n else []
            return pd.DataFrame({"part": 0, "order": range(len(log)), "delta": [x[0] for x in log], "index0": [x[1] for x in log], "index1": [x[2] for x in log]})

        return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(whole, "part long, order long, delta double, index0 long, index1 long")

    def _merge_input(self: Graph, antimodularity: bool) -> tuple[DataFrame, float, DataFrame]:
        """Cells, norm, and the strengths of all vertices: ``id, o, i`` of the graph as it was given, also for the squared one."""
        ins = self.in_weights().select("id", F.col("value").alias("i")) if self.directed else None
        outs = self.out_weights().select("id", F.col("value").alias("o"))
        strengths = stash(outs.withColumn("i", F.col("o")) if ins is None else outs.join(ins, "id"))
        if antimodularity:
            return self.square().cells, float(self.num_nodes), strengths
        return self.cells, float(self.sum_weights()) * (1 if self.directed else 2), strengths

    def _initial_objective(self: Graph, cells: DataFrame, norm: float, strengths: DataFrame) -> float:
        """Not divided by the norm; here the norm counts an undirected self-loop twice."""
        loops = cells.where("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s")).first()["s"]
        return loops - strengths.agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0)).alias("s")).first()["s"] / (norm or 1.0)

    def _objective_of(self: Graph, labels: DataFrame, cells: DataFrame, norm: float, strengths: DataFrame) -> float:
        own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
        inside = cells.join(own("src"), "src").join(own("dst"), "dst").where("_src = _dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s")).first()["s"]
        groups = strengths.join(labels, "id").groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        return inside - groups.agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0)).alias("s")).first()["s"] / (norm or 1.0)

    def _apply_merges(self: Graph, merges: DataFrame) -> DataFrame:
        """Each vertex is merged away at most once, so merges are pointers; the one at the top of a chain is the label. Chains don't leave a component."""

        def follow(pdf: pd.DataFrame) -> pd.DataFrame:
            last = pdf.sort_values("order", ascending=False)
            top: dict[int, int] = {}
            for i, j in zip(last["index0"].tolist(), last["index1"].tolist(), strict=True):
                top[j] = top.get(i, i)
            return pd.DataFrame({"id": list(top), "_top": list(top.values())}, dtype="int64")

        own = merges.select("part", "order", "index0", "index1").groupBy("part").applyInPandas(follow, "id long, _top long")
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("_top", "id").alias("label"))

    def sbm(self: Graph, sweeps: int = 10_000, most_groups: int = 25, chains: int = 1, seed: int = 1) -> DataFrame:
        """COM-4. ``chain, sweep, groups, log_probability``: independent seeded chains, one task each.

        The share of sweeps with k groups after a burn-in is the posterior of k. Weights are ignored.
        """
        return self._chains(kernels.sample_blocks, sweeps, most_groups, chains, seed)

    def sbm_heat_bath(self: Graph, sweeps: int = 10_000, most_groups: int = 40, chains: int = 1, seed: int = 1) -> DataFrame:
        """COM-5. The same columns from the older sampler, whose groups may be empty and whose vertices move by heat bath."""
        return self._chains(kernels.sample_blocks_heat, sweeps, most_groups, chains, seed)

    def _chains(self: Graph, sample, sweeps: int, most_groups: int, chains: int, seed: int) -> DataFrame:
        self.require_undirected("the block model")
        n = self.num_nodes
        rows = self.cells.select("src", "dst").unionByName(self.spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst")))
        each = rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, real = int(pdf["chain"].iloc[0]), pdf[pdf["src"] >= 0].sort_values(["src", "dst"])
            found = sample(real["src"].to_numpy(), real["dst"].to_numpy(), n, sweeps, most_groups, seed * 1009 + chain)
            return pd.DataFrame({"chain": chain, "sweep": [x[0] for x in found], "groups": [x[1] for x in found], "log_probability": [x[2] for x in found]})

        return each.groupBy("chain").applyInPandas(run, "chain int, sweep int, groups int, log_probability double")
