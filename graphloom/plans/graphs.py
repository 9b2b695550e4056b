"""Graphs derived from whole sales tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: nation of the customer to nation of the supplier, weighted by line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    cells = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").groupBy("src", "dst").agg(F.count("*").cast("float").alias("weight"))
    return Graph(cells, table(spark, sf_dir, "nation").count(), directed=True)


TRADE = """e AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::FLOAT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  v AS (SELECT n_nationkey::BIGINT AS id FROM nation), l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label FROM nation)"""


def follow(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: from the part of each line of an order to the part of its next line, weighted by such lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("_no"), F.col("l_partkey").alias("src"))
    after = lines.select("l_orderkey", (F.col("_no") - 1).alias("_no"), F.col("src").alias("dst"))
    cells = lines.join(after, ["l_orderkey", "_no"]).groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.count("*").cast("float").alias("weight"))
    return Graph(cells, table(spark, sf_dir, "part").count(), directed=True)


FOLLOW = """e AS (SELECT a.l_partkey::BIGINT AS src, b.l_partkey::BIGINT AS dst, count(*)::FLOAT AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2),
  v AS (SELECT unnest(range((SELECT count(*) FROM part))) AS id), l AS (SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS label FROM part)"""


def partners(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: nations, weighted by the line items in both directions that exceed an even share of all.

    What is left of the trade above the mean flow, so that the graph isn't complete.
    """
    cells = trade(spark, sf_dir).cells
    both = cells.unionByName(cells.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    mean = both.agg(F.avg("w").alias("m"))
    return Graph(both.crossJoin(F.broadcast(mean)).where("w > m").select("src", "dst", F.col("w").cast("float").alias("weight")), table(spark, sf_dir, "nation").count())


PARTNERS = TRADE.replace("e AS (", "t AS (", 1) + """,
  b AS (SELECT src, dst, sum(weight) AS w FROM (SELECT * FROM t UNION ALL SELECT dst, src, weight FROM t WHERE src <> dst) GROUP BY 1, 2),
  e AS (SELECT src, dst, w::FLOAT AS weight FROM b WHERE w > (SELECT avg(w) FROM b))"""


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and bipartite: suppliers and, numbered behind them, the parts they delivered, weighted by line items."""
    n, m = table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + n).alias("dst")).agg(F.count("*").alias("weight"))
    return Graph.from_edges(lines, n + m)


SUPPLY = """o AS (SELECT l_suppkey AS src, l_partkey + (SELECT count(*) FROM supplier) AS dst, count(*)::FLOAT AS weight FROM lineitem GROUP BY 1, 2),
  e AS (SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o), v AS (SELECT unnest(range((SELECT count(*) FROM supplier) + (SELECT count(*) FROM part))) AS id),
  l AS (SELECT id, (id >= (SELECT count(*) FROM supplier))::BIGINT AS label FROM v)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of :func:`supply`: 0 for suppliers, 1 for parts."""
    n, m = table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()
    return spark.range(n + m).select("id", (F.col("id") >= n).cast("long").alias("label"))


def copart(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: parts that stand in one order, weighted by such pairs of line items."""
    return Graph.from_edges(copart_links(spark, sf_dir), table(spark, sf_dir, "part").count())


def copart_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight`` of :func:`copart`, each pair once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"))
    return lines.join(lines.select("l_orderkey", F.col("src").alias("dst")), "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


COPART = """o AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::FLOAT AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2),
  e AS (SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o), v AS (SELECT unnest(range((SELECT count(*) FROM part))) AS id),
  l AS (SELECT p_partkey AS id, p_size::BIGINT AS label FROM part)"""


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("label"))


def accounts(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: customers and, numbered behind them, their orders; weight 1. Its components are customers with their orders."""
    n, m = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "orders").count()
    place = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + n).alias("dst"))
    top = place.agg(F.max("dst").alias("t")).first()["t"]
    return Graph.from_edges(place, max(n + m, (top or 0) + 1))


ACCOUNTS = """o AS (SELECT o_custkey AS src, o_orderkey + (SELECT count(*) FROM customer) AS dst, 1::FLOAT AS weight FROM orders),
  e AS (SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o),
  v AS (SELECT unnest(range(greatest((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders), (SELECT max(dst) + 1 FROM o)))) AS id)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))


def rated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two labellings of the labelled documents: quality and toxic."""
    own = table(spark, sf_dir, "labels")
    return own.select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label")), own.select(F.col("doc_id").alias("id"), F.col("toxic").cast("long").alias("label"))


RATED = "p AS (SELECT doc_id AS id, quality::BIGINT AS label1, toxic::BIGINT AS label2 FROM labels)"


def classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two labellings of the embeddings: their class, and their id modulo 10."""
    own = table(spark, sf_dir, "embeddings")
    return own.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")), own.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).alias("label"))


CLASSES = "p AS (SELECT vec_id AS id, label::BIGINT AS label1, vec_id % 10 AS label2 FROM embeddings)"
