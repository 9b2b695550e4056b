"""Connected components by min-label hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_stash, ended_shuffles, partitions, stash
from . import kernels

#: Links that a task contracts at once, and vertices of which it passes on what it has.
FOREST_LINKS = 1 << 20


def component_roots(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``id, root`` for every end of ``links``: the smallest id that can be reached, itself included.

    Each round contracts: every vertex hooks to the least label among its neighbours, labels are
    followed two steps, and links are rewritten to labels; links inside a group vanish. The number of
    groups falls by half at least each round, so a path of n vertices takes O(log n) rounds, and
    what a round shuffles shrinks with it. Links are looked at both ways from the first round on, but written both ways only when that has
    contracted them; of links that stand both ways one direction will do.
    """
    ends = stash(links.select(F.col(a).alias("src"), F.col(b).alias("dst")))
    edges = ends.where("src <> dst")
    labels = stash(ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("root", F.col("id")))
    # No later table is larger than these, so small ones needn't be dealt over all shuffle partitions.
    many, most = 2 * edges.count(), labels.count()
    last = ends
    while not edges.isEmpty():
        # Least neighbour or itself; pointers only fall, so following them ends in a root.
        hooks = (_both_ways(edges) if last is ends else edges).groupBy("src").agg(F.min("dst").alias("_near")).select("src", F.least("src", "_near").alias("to"))
        hooks = stash(hooks, many)
        while True:
            up = hooks.select(F.col("src").alias("_to"), F.col("to").alias("_top"))
            jumped = stash(hooks.join(up, hooks["to"] == up["_to"], "left").select("src", F.coalesce("_top", "to").alias("to"), (F.coalesce("_top", "to") != F.col("to")).alias("moved")), 2 * many)
            done = jumped.where("moved").isEmpty()
            drop_stash(hooks)
            hooks = jumped.select("src", "to")
            if done:
                break
        up = hooks.select(F.col("src").alias("_was"), F.col("to").alias("_now"))
        labels, old = stash(labels.join(up, F.col("root") == F.col("_was"), "left").select("id", F.coalesce("_now", "root").alias("root")), most + many), labels
        moved = edges.join(up, F.col("src") == F.col("_was")).select(F.col("_now").alias("src"), "dst")
        moved = moved.join(up, F.col("dst") == F.col("_was")).select("src", F.col("_now").alias("dst"))
        moved = moved.where("src <> dst")
        left = stash((_both_ways(moved) if last is ends else moved).distinct(), 2 * many)
        drop_stash(old, last, jumped)
        edges = last = left
    drop_stash(last)
    return labels


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def forest(links: DataFrame, directed: bool) -> DataFrame:
    """``src, dst, n``, written: fewer links that connect what ``links`` (ids from 0, a written table) connects, and every end; ``n``: how many cells begin there.

    Links are dealt out by ranges, so those of near ids meet, and each task links its vertices to the least one that it knows them to be
    connected with; of a graph whose links lead anywhere hardly any can be spared. Undirected links stand in one direction and are two cells.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        ids, roots, n, held, size = none, none, none, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            src, dst = (np.concatenate(x) for x in zip((none, none), *held, strict=True))
            every, low = kernels.least_linked(np.concatenate([ids, src]), np.concatenate([roots, dst]))
            begun = src if directed else np.concatenate([src, dst[src != dst]])
            counts = np.bincount(np.searchsorted(every, begun), minlength=len(every))
            counts[np.searchsorted(every, ids)] += n
            return every, low, counts

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= FOREST_LINKS:
                (ids, roots, n), held, size = merged(), [], 0
                if len(ids) >= FOREST_LINKS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, roots, n)], ["src", "dst", "n"])
                    ids, roots, n = none, none, none
        ids, roots, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, roots, n)], ["src", "dst", "n"])

    dealt = links.select("src", "dst").repartitionByRange(partitions(links.sparkSession), "src", "dst")
    with ended_shuffles(links.sparkSession):
        return stash(dealt.mapInArrow(contract, "src long, dst long, n long"))


def linked_roots(links: DataFrame, directed: bool = False) -> DataFrame:
    """:func:`component_roots` of a written table, by way of its :func:`forest`."""
    with ended_shuffles(links.sparkSession):
        return component_roots(forest(links, directed))


def sized_components(cells: DataFrame, directed: bool) -> DataFrame:
    """``id, root, cells, vertices`` for every end of ``cells``: its component, and how large that is."""
    links = forest(cells if directed else cells.where("src >= dst"), directed)
    with ended_shuffles(cells.sparkSession):
        roots = component_roots(links)
        own = roots.join(links.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("_n")), "id")
        sizes = own.groupBy("root").agg(F.sum("_n").alias("cells"), F.count("*").alias("vertices"))
        return stash(roots.join(sizes, "root").select("id", "root", "cells", "vertices"))
