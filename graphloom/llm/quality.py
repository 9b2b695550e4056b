"""Quality by document evidence and hierarchical empirical Bayes over sites (operator 10)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches, stash
from .common import held_out, labelled_sample
from .trees import BoostedTrees

MARKED = re.compile(r"[!#$%&*|=~^<>_]{1,}")
FEATURES = ("log_words", "word_length", "capitals", "punctuation", "odd_marks", "marked_words", "digits", "distinct", "repeats", "top_word", "stops", "line_words", "short_words")


def features(text: str | None) -> list[float]:
    """Of the whole text, the same for a null text as for an empty one."""
    text = text or ""
    words = text.split()
    n = len(words) or 1
    marks = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(int(marks.sum()), 1)
    upper, lower = int(marks[65:91].sum()), int(marks[97:123].sum())
    odd = sum(int(marks[ord(c)]) for c in "!#$%&*|=~^<>_")
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(len(words)), size / n, upper / max(upper + lower, 1), (int(marks[33:48].sum()) + int(marks[58:65].sum())) / n, odd / n,
        sum(c for w, c in counts.items() if MARKED.search(w)) / n, int(marks[48:58].sum()) / size, len(counts) / n, repeats / n, max(counts.values(), default=0) / n,
        int(marks[46]) / n, int(marks[10]) / n, sum(c for w, c in counts.items() if len(w) <= 4) / n,
    ]


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000) -> BoostedTrees:
    """The document classifier, from at most ``rows`` labelled rows outside the held-out part."""
    small_batches(documents.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    # At most ``rows`` rows of a few numbers each come to the driver.
    found = labelled_sample(documents, labels, "quality", rows).select("text", "label").mapInArrow(measure, "x array<double>, label int").toPandas()
    x, y = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["label"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # whatever the order in which tasks end
    return BoostedTrees(rounds=50).fit(x[order], y[order])


def site(documents: DataFrame) -> tuple[Column, Column]:
    """Host and first path segment of the column ``url``, where there is one; otherwise a source is a host and a language within it a path."""
    if "url" not in documents.columns:
        return F.col("source"), F.col("lang")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host), F.regexp_extract("url", r"^[^:/?#]*:?//[^/?#]*(/[^/?#]*)", 1)


def evidence(documents: DataFrame, model: BoostedTrees, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, margin``: log odds of good quality by the text alone; ``path`` lies within ``host``."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(0)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.margin(x), pa.float64())], names=["doc_id", "host", "path", "margin"])

    held = documents.select("text", "doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"))
    return held.mapInArrow(run, held.select("doc_id", "host", "path", F.lit(0.0).alias("margin")).schema)


def _strength(groups: DataFrame, mean: Column, most: float) -> DataFrame:
    """One row with ``strength``: pseudo-documents of the prior over groups, by the method of moments.

    ``groups`` has a group's documents ``n`` and their sum of evidence ``good``. What the groups' means scatter beyond the scatter
    of n draws is their own variance; none of it means that the prior rules.
    """
    sums = groups.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("n") * mean * (1 - mean)).alias("draws"))
    # The scatter of one draw, over the documents.
    within = F.col("draws") / F.col("all")
    room = F.greatest(F.col("all") - F.col("sq") / F.col("all"), F.lit(1e-9))
    own = F.greatest((F.col("between") - (F.col("k") - 1) * within) / room, F.lit(0.0))
    return sums.select(F.least(F.greatest(within / F.greatest(own, F.lit(1e-12)) - 1, F.lit(1.0)), F.lit(most)).alias("strength"))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 20_000, most_strength: float = 1e4, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, document_score, host_posterior, path_posterior`` for every row of ``documents``.

    A document counts in its site with its label, where it has one to learn from, or else with the classifier's probability. A host's
    posterior shrinks to the global mean, a path's to its host's, each by a strength estimated from how
    much groups differ; sparse sites thus take the prior's word. A document's own part is taken out of its site's sums, so nothing vouches for
    itself. The score adds the site's log odds, relative to the global ones, to the document's. ``host`` and ``path`` are expressions over
    ``documents``, by default those of :func:`site`.

    Null and empty texts are scored like a text without words; null hosts and paths are groups of their own; null doc_ids have no label. Without
    labels the classifier gives even odds. Repeated rows have equal scores. An empty table gives an empty result.
    """
    model = fit(documents, labels, rows)
    own = site(documents) if host is None or path is None else (host, path)
    found = evidence(documents, model, own[0] if host is None else host, own[1] if path is None else path)
    marks = labels.where(~held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("_label"))
    plain = 1 / (1 + F.exp(-F.col("margin")))
    joined = found.join(marks, F.col("doc_id") == F.col("_id"), "left")
    # Host and path keys with nulls made values of their own.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rated = stash(joined.select("doc_id", key("host").alias("host"), key("path").alias("path"), "margin", F.coalesce("_label", plain).alias("_good")))
    paths = stash(rated.groupBy("host", "path").agg(F.sum("_good").alias("good"), F.count("*").alias("n")))
    hosts = stash(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    whole = hosts.agg(F.coalesce(F.sum("good") / F.sum("n"), F.lit(0.5)).alias("mean"))
    safe = F.least(F.greatest(F.col("mean"), F.lit(1e-4)), F.lit(1 - 1e-4))
    # Single rows: the global mean and both strengths.
    whole = whole.select(safe.alias("mean"))
    host_strength = _strength(hosts.crossJoin(F.broadcast(whole)), F.col("mean"), most_strength).select(F.coalesce("strength", F.lit(most_strength)).alias("_hs"))
    nested = paths.join(hosts.select(F.col("host").alias("_h"), F.col("good").alias("_hg"), F.col("n").alias("_hn")), F.col("host") == F.col("_h")).drop("_h")
    path_strength = _strength(nested.withColumn("mean", F.least(F.greatest(F.col("_hg") / F.col("_hn"), F.lit(1e-4)), F.lit(1 - 1e-4))), F.col("mean"), most_strength).select(F.coalesce("strength", F.lit(most_strength)).alias("_ps"))
    sites = stash(nested.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(host_strength)).crossJoin(F.broadcast(path_strength)))
    sites = sites.select(F.xxhash64("host", "path").alias("_s"), F.col("host").alias("_h"), F.col("path").alias("_p"), "good", "n", "_hg", "_hn", "mean", "_hs", "_ps")
    both = rated.withColumn("_s", F.xxhash64("host", "path")).join(sites, "_s").where("host = _h and path = _p")
    host = (F.col("_hg") - F.col("_good") + F.col("_hs") * F.col("mean")) / (F.col("_hn") - 1 + F.col("_hs"))
    path = (F.col("good") - F.col("_good") + F.col("_ps") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("_ps"))
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    out = both.withColumn("host_posterior", host).withColumn("path_posterior", path)
    score = 1 / (1 + F.exp(-(F.col("margin") + odds(F.col("path_posterior")) - odds(F.col("mean")))))
    return out.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), plain.alias("document_score"), "host_posterior", "path_posterior"
    )
