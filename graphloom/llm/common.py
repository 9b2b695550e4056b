"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six code points; Java, RE2 and Python read the class alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes, 128 bits together, that stand for the values of ``columns`` (nulls included).

    Rows that agree in all of them share a key and so every decision taken by key.
    """
    marks = [F.col(c).isNull() for c in columns]
    cols = [F.col(c) for c in columns]
    return [F.xxhash64(*marks, *cols).alias("_k1"), F.xxhash64(F.lit(7), *marks, *cols).alias("_k2")]


def fresh(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its join keys rewritten, so that the join deals its rows out anew.

    Spark splits a hot partition of a join only if both sides come straight from an exchange of that
    join; a side that was just grouped by the same key would hide its own exchange.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0x5BD1E995)) for k in keys})


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the named remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label, part`` of at most ``rows`` labelled rows, the same at every run; ``part`` is crc32 of the id modulo 5, never 0.

    The chosen ids (at most ``rows`` longs) are broadcast, so the texts aren't shuffled to find them. Null ids and labels teach
    nothing; of several labels of an id the greatest holds, and of several texts the one with the least hash.
    """
    learn = labels.where(~held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    marks = learn.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    part = (F.crc32(F.col("doc_id").cast("string")) % 5).alias("part")
    met = documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    # Of an id that stands several times one row teaches, so an id of a million rows doesn't bring them all.
    once = met.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return once.select("text", F.col("label").cast("int").alias("label"), part)
