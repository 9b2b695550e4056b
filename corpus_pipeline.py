"""A training corpus from ``documents``: civil, without repeats, mixed by source, and encoded.

Each stage takes what its predecessor kept, as a table, and its decisions take effect on it: toxic documents go, lines that repeat
go, of near duplicates one document stays, sources are mixed to their targets, and what is left is encoded.

All stages take nulls in any column, repeated rows, empty tables and further columns of any name; each states what they give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import line_dedup, mixing, pieces, simhash, toxicity
from graphloom.llm.common import table
from graphloom.llm.queries import MODEL_FILE
from graphloom.runtime import scratch, shared_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5, all columns as they were. Null and empty texts have no toxic word and stay; a null doc_id is scored like any other,
    repeated rows go or stay together, and an empty table stays empty. The model learns from ``labels`` and the given rows."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier line of the corpus repeats; ``n_chars`` follows. Null texts stay null, a null doc_id comes after all others, rows
    with equal doc_id and text lose the same lines, and an empty table stays empty."""
    return line_dedup.line_dedup(docs, columns=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of texts that five-word shingles link at a similarity of 0.8: the smallest doc_id, null last. SimHash fingerprints within 3 bits
    are compared first, bands of least hashes find the near copies that lie further apart. Texts that are null or have no
    word are one group; of repeated rows one stays; an empty table stays empty."""
    return simhash.keep_one_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each pass of the mix over a document a row with the words that it takes. Null texts and texts without words are never taken, a null source
    is a source, repeated rows are rows of their own, and an empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, exact`` for every row. Null and empty texts have no tokens, a null doc_id stays null, repeated rows have equal results,
    and an empty table gives an empty result."""
    return pieces.encode(docs, MODEL_FILE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Trees, fingerprints and merges aren't SQL; the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each but the last written as Parquet in the shared folder and read again.

    What a stage has written on its way is deleted when its result is there. The results themselves lie beside the other written tables of the
    application, which :func:`graphloom.runtime.clear_stash` deletes.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark).rstrip('/')}/graphloom-stash/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
