"""Session helpers that every operator shares: the shared folder and tables written to cut a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A table of which it is known that it has few rows gets a file, and so a task, for so many of them at least.
FILE_ROWS = 20_000
#: Folders of written tables, in the order of writing.
_written: list[tuple[SparkSession, str]] = []
#: Folders that are deleted when the application ends.
_ending: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; where none is named, a local one in local mode and an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        context.setCheckpointDir(root)
    return root


def _stash_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/graphloom-stash/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing twice.

    Parquet rather than ``checkpoint()``: the reread keeps column pruning, file statistics and
    pushed filters, and each branch that uses the table reads only the columns it needs. ``rows`` bounds the rows that the last stage
    reads, where that is known: a few rows then aren't dealt over as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{_stash_folder(spark)}/{uuid.uuid4().hex}"
    files = partitions(spark) if rows is None else max(1, -(-rows // FILE_ROWS))
    (df.coalesce(files) if files < partitions(spark) else df).write.parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _note(spark: SparkSession, path: str) -> None:
    """Remember a written table; all of an application's go when its JVM ends."""
    _written.append((spark, path))
    folder = _stash_folder(spark)
    if folder not in _ending:
        _ending.add(folder)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def bucketed(df: DataFrame, key: str, files: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, as many as shuffle partitions, so that joins and aggregates on it deal out only their other side."""
    spark = df.sparkSession
    n, name = partitions(spark), f"graphloom_{uuid.uuid4().hex}"
    path = f"{_stash_folder(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").option("compression", files).option("path", path).bucketBy(n, key).saveAsTable(name)
    _note(spark, path)
    return spark.table(name)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, for files that go with the application's tables."""
    return f"{_stash_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`stash` writes inside are deleted at the end; what is still needed must have been written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


@contextmanager
def ended_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end; else files stay until the driver happens to collect its garbage.

    A query that is run inside and once more later makes its shuffles anew, so this is for queries that are run once, as those that
    :func:`stash` writes. The session's setting comes back at the end.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_stash(spark: SparkSession) -> None:
    """Delete all tables that this application has written; to be called when no result of it will be read any more."""
    _delete(spark, _stash_folder(spark))


def drop_stash(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stash` returned and that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for name in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if "graphloom-stash" in path.toString():
                _delete(spark, path.toString())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running totals in a global order, without a single-partition window.

    Rows are range-partitioned by ``order`` and written once; the totals of the partitions (one row
    each) give every partition its offset, and a window inside each partition does the rest. ``sums``
    maps a new column to what it adds up. Rows that tie in ``order`` should be interchangeable.
    """
    n = partitions(df.sparkSession)
    dealt = stash(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))
    slices = dealt.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each shuffle partition, so one task and a broadcast are bounded by that setting.
    offsets = slices.select("_slice", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "_slice")
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()],
    )


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Let no Arrow batch hold more than so many rows or bytes; long texts by the ten thousand don't fit into an executor.

    Spark reads these settings when a plan runs, which for a returned table is later, so they stay lowered in the caller's session (README).
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))
