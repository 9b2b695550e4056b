"""Every operator as a query over graphs from whole tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import labels as L
from ..operators.report import adj_rand_index_comp_table, metric_report
from ..runtime import drop_stash, new_folder, stash
from ..sources import text
from . import graphs as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _r(column: str) -> str:
    return f"round({column}::DOUBLE, 6) + 0.0"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in columns})


def _edges(name: str, graph: Callable[[SparkSession, str], Graph], change: Callable, base: str, sql: str) -> None:
    """A query that gives a graph's cells; ``sql`` is what follows the graph's tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = change(graph(spark, sf_dir), spark, sf_dir)
        return _round(found.cells if isinstance(found, Graph) else found, "weight")

    _add(name, query, f"WITH {base} {sql}")


def _written(graph: Callable[[SparkSession, str], Graph]) -> Callable[[SparkSession, str], Graph]:
    """The graph with its cells written, for operators that read them several times: the joins that derive it run once."""
    return lambda spark, sf_dir: graph(spark, sf_dir).checkpointed()


def _vertices(name: str, graph, change: Callable, base: str, value: str, integer: bool = False, recursive: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = change(graph(spark, sf_dir))
        return found if integer else _round(found, "value")

    _add(name, query, f"WITH {'RECURSIVE ' if recursive else ''}{base} {value}")


def _one(name: str, query: Query, column: str, base: str, sql: str) -> None:
    _add(name, lambda s, d: _round(query(s, d), column), f"WITH {base} {sql}")


CELLS = f"SELECT src, dst, {_r('weight')} AS weight FROM"

# Projections and filters -------------------------------------------------------------------------
_edges("edges_scan", G.copart, lambda g, *_: g.edges(), G.COPART, f"{CELLS} e WHERE dst >= src")
_edges("edges_transpose", G.follow, lambda g, *_: g.transpose(), G.FOLLOW, f"SELECT dst AS src, src AS dst, {_r('weight')} AS weight FROM e")
_edges("edges_scale", G.follow, lambda g, *_: g.multiply_const(0.1), G.FOLLOW, f"SELECT src, dst, {_r('(weight::DOUBLE * 0.1::DOUBLE)::FLOAT')} AS weight FROM e")
_edges("edges_clamp", G.copart, lambda g, *_: g.clamp(2, 3), G.COPART, f"SELECT src, dst, {_r('CASE WHEN weight < 2 THEN 2 WHEN weight > 3 THEN 3 ELSE weight END')} AS weight FROM e")
_edges("edges_clamp_inverted_bounds", G.copart, lambda g, *_: g.clamp(3, 2), G.COPART, f"SELECT src, dst, {_r('CASE WHEN weight < 3 THEN 3 WHEN weight > 2 THEN 2 ELSE weight END')} AS weight FROM e")
_edges("edges_filter_weights", G.copart, lambda g, *_: g.filter_weights(2, 3), G.COPART, f"{CELLS} e WHERE weight BETWEEN 2 AND 3")
_edges("edges_filter_labels", G.follow, lambda g, s, d: g.filter_labels(G.part_sizes(s, d)), G.FOLLOW, f"{CELLS} e JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.label <> b.label")
_edges("edges_invert", G.partners, lambda g, *_: g.invert(1000, False), G.PARTNERS, f"SELECT a.id AS src, b.id AS dst, {_r('coalesce((1000 - weight)::FLOAT, 1000)')} AS weight FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.id AND dst = b.id WHERE a.id <> b.id AND (weight IS NULL OR 1000 - weight > 0)")
_edges("edges_resize", G.copart, lambda g, *_: g.resize(g.num_nodes // 2), G.COPART, f"{CELLS} e WHERE src < (SELECT count(*) // 2 FROM part) AND dst < (SELECT count(*) // 2 FROM part)")
_edges("edges_lower_triangle", G.partners, lambda g, *_: g.lower_triangle(), G.PARTNERS, f"{CELLS} e WHERE dst <= src")
_edges("edges_dense_matrix", G.partners, lambda g, *_: g.matrix(), G.PARTNERS, f"SELECT a.id AS src, b.id AS dst, {_r('coalesce(weight, 0)')} AS weight FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.id AND dst = b.id")
_add("edges_nonexistent", lambda s, d: G.partners(s, d).nonexistent(), f"WITH {G.PARTNERS} SELECT a.id AS src, b.id AS dst FROM v a CROSS JOIN v b ANTI JOIN e ON src = a.id AND dst = b.id")
_edges("edges_row", G.copart, lambda g, *_: g.out_edges(7), G.COPART, f"SELECT dst, {_r('weight')} AS weight FROM e WHERE src = 7")
_edges("edges_row_with_absent", G.copart, lambda g, *_: g.row_with_absent(7), G.COPART, f"SELECT id AS dst, {_r('weight')} AS weight FROM v LEFT JOIN (SELECT * FROM e WHERE src = 7) ON dst = id")
_add("edges_merged_rows", lambda s, d: _round(G.copart(s, d).merged_rows(7, 8), "weight_i", "weight_j"), f"WITH {G.COPART} SELECT dst, {_r('a.weight')} AS weight_i, {_r('b.weight')} AS weight_j FROM (SELECT dst, weight FROM e WHERE src = 7) a FULL JOIN (SELECT dst, weight FROM e WHERE src = 8) b USING (dst)")
_add("edges_point", lambda s, d: s.createDataFrame([(G.trade(s, d).get_edge(1, 2), G.trade(s, d).has_edge(1, 2))], "weight double, has boolean"), f"WITH {G.TRADE} SELECT coalesce(max(weight), 0)::DOUBLE AS weight, count(*) > 0 AS has FROM e WHERE src = 1 AND dst = 2")

# Edits: the batch holds the parts of each order's first two lines, so pairs that the graph has, and pairs by key, some of them repeated or out of range.
BATCH = """b AS (SELECT a.l_orderkey * 2 AS seq, a.l_partkey::BIGINT AS src, b.l_partkey::BIGINT AS dst, (a.l_orderkey % 97)::FLOAT AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
  UNION ALL SELECT o_orderkey * 2 + 1, (o_custkey % 50)::BIGINT, (o_orderkey % (p.n + 20))::BIGINT, (o_orderkey % 89)::FLOAT FROM orders, (SELECT count(*) AS n FROM part) p), r AS (SELECT * FROM b WHERE dst < (SELECT count(*) FROM part))"""


def _batch(s: SparkSession, d: str) -> DataFrame:
    n = G.table(s, d, "part").count()
    lines = G.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("p"))
    first, second = lines.where("l_linenumber = 1").withColumnRenamed("p", "src"), lines.where("l_linenumber = 2").withColumnRenamed("p", "dst").drop("l_linenumber")
    known = first.join(second, "l_orderkey").select((F.col("l_orderkey") * 2).alias("seq"), "src", "dst", (F.col("l_orderkey") % 97).cast("float").alias("weight"))
    orders = G.table(s, d, "orders").select((F.col("o_orderkey") * 2 + 1).alias("seq"), (F.col("o_custkey") % 50).cast("long").alias("src"), (F.col("o_orderkey") % (n + 20)).cast("long").alias("dst"), (F.col("o_orderkey") % 89).cast("float").alias("weight"))
    return known.unionByName(orders)


_edges("edit_set", G.follow, lambda g, s, d: g.set_edges(_batch(s, d)), f"{G.FOLLOW}, {BATCH}", f"SELECT src, dst, {_r('arg_max(weight, seq)')} AS weight FROM (SELECT -1 AS seq, src, dst, weight FROM e UNION ALL SELECT seq, src, dst, weight FROM r) GROUP BY 1, 2")
_edges("edit_add", G.follow, lambda g, s, d: g.add_edges(_batch(s, d)), f"{G.FOLLOW}, {BATCH}", f"SELECT src, dst, {_r('sum(weight)')} AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT src, dst, weight FROM r) GROUP BY 1, 2")
for _name, _fold, _pick in (("min", "min", "least"), ("max", "max", "greatest")):
    _edges(f"edit_{_name}", G.follow, lambda g, s, d, m=_name: getattr(g, f"{m}_edges")(_batch(s, d)), f"{G.FOLLOW}, {BATCH}, n AS (SELECT src, dst, {_fold}(weight) AS w FROM r GROUP BY 1, 2)", f"SELECT src, dst, {_r(f'CASE WHEN w IS NULL THEN weight ELSE {_pick}(coalesce(weight, 0), w) END')} AS weight FROM e FULL JOIN n USING (src, dst)")
_edges("edit_delete", G.follow, lambda g, s, d: g.del_edges(_batch(s, d)), f"{G.FOLLOW}, {BATCH}", f"{CELLS} e ANTI JOIN r USING (src, dst)")

# Contraction of vertex 2 into vertex 1.
_to = "CASE WHEN {0} = 2 THEN 1 ELSE {0} END"
_edges("merge_add", G.follow, lambda g, *_: g.merge_nodes_add(1, 2), G.FOLLOW, f"SELECT {_to.format('src')} AS src, {_to.format('dst')} AS dst, {_r('sum(weight)')} AS weight FROM e GROUP BY 1, 2")
_edges("merge_labels", G.follow, lambda g, s, d: g.contract(G.part_sizes(s, d)), G.FOLLOW, f"SELECT a.label AS src, b.label AS dst, {_r('sum(weight)')} AS weight FROM e JOIN l a ON src = a.id JOIN l b ON dst = b.id GROUP BY 1, 2")
for _name, _pick in (("min", "least"), ("max", "greatest")):
    _edges(f"merge_{_name}", G.follow, lambda g, *_, m=_name: getattr(g, f"merge_nodes_{m}")(1, 2), f"""{G.FOLLOW},
      x AS (SELECT dst, max(CASE WHEN src = 1 THEN weight END) AS a, max(CASE WHEN src = 2 THEN weight END) AS b FROM e WHERE src IN (1, 2) GROUP BY 1),
      f AS (SELECT src, dst, weight FROM e WHERE src NOT IN (1, 2) UNION ALL SELECT 1, dst, CASE WHEN b IS NULL THEN a ELSE {_pick}(coalesce(a, 0), b) END FROM x),
      y AS (SELECT src, max(CASE WHEN dst = 1 THEN weight END) AS a, max(CASE WHEN dst = 2 THEN weight END) AS b FROM f WHERE dst IN (1, 2) GROUP BY 1)""", f"SELECT src::BIGINT AS src, dst::BIGINT AS dst, {_r('weight')} AS weight FROM (SELECT src, dst, weight FROM f WHERE dst NOT IN (1, 2) UNION ALL SELECT src, 1, CASE WHEN b IS NULL THEN a ELSE {_pick}(coalesce(a, 0), b) END FROM y)")
_edges("merge_custom", G.partners, lambda g, *_: g.merge_nodes_custom(1, 2, 0.5, 0.5, -0.25, 0.0), f"""{G.PARTNERS},
  x AS (SELECT dst, max(CASE WHEN src = 1 THEN weight END)::DOUBLE AS a, max(CASE WHEN src = 2 THEN weight END)::DOUBLE AS b FROM e WHERE src IN (1, 2) GROUP BY 1),
  y AS (SELECT dst, (CASE WHEN b IS NULL THEN a ELSE 0.5 * coalesce(a, 0) + 0.5 * b - 0.25 * coalesce((SELECT a FROM x WHERE dst = 2), 0) END)::FLOAT AS weight FROM x WHERE dst NOT IN (1, 2))""", f"SELECT src::BIGINT AS src, dst::BIGINT AS dst, {_r('weight')} AS weight FROM (SELECT src, dst, weight FROM e WHERE src NOT IN (1, 2) AND dst NOT IN (1, 2) UNION ALL SELECT 1, dst, weight FROM y UNION ALL SELECT dst, 1, weight FROM y)")

# Algebra ------------------------------------------------------------------------------------------
_edges("alg_add", G.follow, lambda g, *_: g.add_elementwise(g.transpose()), G.FOLLOW, f"SELECT src, dst, {_r('sum(weight)')} AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2")
_edges("alg_hadamard", G.follow, lambda g, *_: g.multiply_elementwise(g.transpose()), G.FOLLOW, f"SELECT a.src, a.dst, {_r('a.weight * b.weight')} AS weight FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
_one("alg_scalar", lambda s, d: G.follow(s, d).scalar_product_table(G.follow(s, d).transpose()), "product", G.FOLLOW, f"SELECT {_r('sum(a.weight * b.weight)')} AS product FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
_matmul = f"SELECT src, dst, {_r('w::FLOAT')} AS weight FROM (SELECT a.src AS src, b.dst AS dst, sum(a.weight * b.weight) AS w FROM e a JOIN {{}} b ON a.dst = b.src GROUP BY 1, 2)"
_edges("alg_matmul", G.follow, lambda g, *_: g.multiply(g.transpose()), G.FOLLOW, _matmul.format("(SELECT dst AS src, src AS dst, weight FROM e)"))
_edges("alg_square", G.partners, lambda g, *_: g.square(), G.PARTNERS, _matmul.format("e"))
_vertices("alg_matvec", G.copart, lambda g: g.multiply_vector(g.nodes.select("id", (F.col("id") % 7).cast("double").alias("value"))), G.COPART, f"SELECT v.id, {_r('coalesce(sum(weight * (dst % 7)::DOUBLE), 0)')} AS value FROM v LEFT JOIN e ON src = v.id GROUP BY 1")
_power = "x0 AS (SELECT id, value / sqrt(sum(value * value) OVER ()) AS value FROM (SELECT id, (id * 7919 % 1000 + 1) / 1000.0::DOUBLE AS value FROM v))" + "".join(
    f", x{i + 1} AS MATERIALIZED (SELECT id, y / sqrt(sum(y * y) OVER ()) AS value FROM (SELECT v.id, coalesce(sum(weight::DOUBLE * x.value), 0) AS y FROM v LEFT JOIN e ON src = v.id LEFT JOIN x{i} x ON x.id = dst GROUP BY 1))" for i in range(100)
)
_add("alg_power", lambda s, d: _round(G.partners(s, d).power_iteration()[0], "value"), f"WITH {G.PARTNERS.replace('e AS (SELECT src, dst, w::FLOAT', 'e AS MATERIALIZED (SELECT src, dst, w::FLOAT')}, {_power} SELECT id, {_r('value')} AS value FROM x100")

# Statistics ---------------------------------------------------------------------------------------
_add("stat_counts", lambda s, d: _round(G.partners(s, d).counts(), "weights"), f"WITH {G.PARTNERS} SELECT (count(*) + count(*) FILTER (src = dst)) // 2 AS links, count(*) AS cells, count(*) FILTER (src = dst) AS diagonal, {_r('(sum(weight) + coalesce(sum(weight) FILTER (src = dst), 0)) / 2')} AS weights FROM e")
_add("stat_counts_directed", lambda s, d: _round(G.follow(s, d).counts(), "weights"), f"WITH {G.FOLLOW} SELECT count(*) AS links, count(*) AS cells, count(*) FILTER (src = dst) AS diagonal, {_r('sum(weight)')} AS weights FROM e")
for _side, _word in (("src", "out"), ("dst", "in")):
    _vertices(f"stat_{_word}_degrees", G.copart, lambda g, w=_word: getattr(g, f"{w}_degrees")(), G.COPART, f"SELECT v.id, count({_side}) AS value FROM v LEFT JOIN e ON {_side} = v.id GROUP BY 1", integer=True)
    _vertices(f"stat_{_word}_weights", G.follow, lambda g, w=_word: getattr(g, f"{w}_weights")(), G.FOLLOW, f"SELECT v.id, {_r('coalesce(sum(weight), 0)')} AS value FROM v LEFT JOIN e ON {_side} = v.id GROUP BY 1")
_vertices("stat_degree_anomalies", _written(G.copart), lambda g: g.degree_anomalies(), f"{G.COPART}, d AS (SELECT src AS id, count(*) AS d FROM e GROUP BY 1)", f"SELECT v.id, {_r('coalesce(count(d.d) - sum(d.d) / count(d.d), 0)')} AS value FROM v LEFT JOIN e ON src = v.id LEFT JOIN d ON d.id = dst GROUP BY 1")
_vertices("stat_weight_anomalies", _written(G.copart), lambda g: g.weight_anomalies(), f"{G.COPART}, d AS (SELECT src AS id, sum(weight) AS d FROM e GROUP BY 1)", f"SELECT v.id, {_r('coalesce(sum(weight) - sum(weight::DOUBLE * d.d) / sum(weight), 0)')} AS value FROM v LEFT JOIN e ON src = v.id LEFT JOIN d ON d.id = dst GROUP BY 1")
_one("stat_density", lambda s, d: G.copart(s, d).density_table(), "density", G.COPART, f"SELECT {_r('(SELECT count(*) / 2.0 FROM e) / (count(*) * (count(*) - 1) / 2)')} AS density FROM v")
_one("stat_reciprocity", lambda s, d: G.trade(s, d).filter_weights(25, 1e9).reciprocity_table(), "reciprocity", G.TRADE + ", h AS (SELECT * FROM e WHERE weight >= 25)", f"SELECT {_r('CASE WHEN count(*) = 0 THEN CAST(\'NaN\' AS DOUBLE) ELSE count(b.src)::DOUBLE / count(*) END')} AS reciprocity FROM h a LEFT JOIN h b ON a.src = b.dst AND a.dst = b.src")
_tri = "t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN e c ON c.src = a.src AND c.dst = b.dst), k AS (SELECT src, count(*) AS d FROM e WHERE src <> dst GROUP BY 1)"
_one("stat_transitivity", lambda s, d: G.copart(s, d).checkpointed().transitivity_table(), "transitivity", f"{G.COPART}, {_tri}", f"SELECT {_r('6.0 * (SELECT count(*) FROM t) / (SELECT sum(d * (d - 1)) FROM k)')} AS transitivity")
_vertices("stat_clustering", _written(G.copart), lambda g: g.clustering_coefficient(), f"{G.COPART}, {_tri}, q AS (SELECT unnest([x, y, z]) AS id FROM t), m AS (SELECT id, count(*) AS n FROM q GROUP BY 1)", f"SELECT v.id, {_r('coalesce(2.0 * n / (d * (d - 1)), 0)')} AS value FROM v LEFT JOIN m ON m.id = v.id LEFT JOIN k ON k.src = v.id")

# Labels -------------------------------------------------------------------------------------------
_add("lbl_count", lambda s, d: G.part_sizes(s, d).agg(F.countDistinct("label").alias("n")), "SELECT count(DISTINCT p_size) AS n FROM part")
_add("lbl_simplify", lambda s, d: L.simplify_labels(G.part_sizes(s, d).withColumn("label", F.col("label") * F.col("label"))), "SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_size) - 1 AS label FROM part")
_add("lbl_split", lambda s, d: L.split_labels(*G.classes(s, d)), f"WITH {G.CLASSES} SELECT id, dense_rank() OVER (ORDER BY label1, label2) - 1 AS label FROM p")
_edges("lbl_contingency", lambda s, d: L.intersection_matrix(*G.classes(s, d)), lambda g, *_: g, G.CLASSES, "SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT dense_rank() OVER (ORDER BY label1) - 1 AS src, dense_rank() OVER (ORDER BY label2) - 1 AS dst FROM p) GROUP BY 1, 2")
_conf = """c AS (SELECT {part} label1, label2, count(*)::HUGEINT AS n FROM p GROUP BY ALL), pr AS (SELECT sum(n * (n - 1) // 2) AS a FROM c),
  ro AS (SELECT sum(n * (n - 1) // 2) AS r FROM (SELECT {part} label1, sum(n) AS n FROM c GROUP BY ALL)), co AS (SELECT sum(n * (n - 1) // 2) AS k FROM (SELECT {part} label2, sum(n) AS n FROM c GROUP BY ALL)),
  al AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT {part} sum(n) AS n FROM c GROUP BY ALL)), cf AS (SELECT a::BIGINT AS a, (k - a)::BIGINT AS b, (r - a)::BIGINT AS c, (t - r - k + a)::BIGINT AS d FROM pr, ro, co, al)"""
_add("lbl_confusion", lambda s, d: L.confusion(*G.rated(s, d)), f"WITH {G.RATED}, {_conf.format(part='')} SELECT * FROM cf")
_cls = lambda s, d: (G.regions(s, d), G.regions(s, d).select("id", (F.col("id") % 3).alias("label")))
# Components of the partners, found by following links from every nation.
_pc = "z AS (SELECT id AS src, id AS dst FROM v UNION SELECT z.src, e.dst FROM z JOIN e ON z.dst = e.src), cp AS (SELECT src AS id, min(dst) AS part FROM z GROUP BY 1)"
_nat = "p AS (SELECT l.id, label AS label1, l.id % 3 AS label2, part FROM l JOIN cp ON cp.id = l.id)"
_add("lbl_confusion_comp", lambda s, d: L.confusion(*_cls(s, d), G.partners(s, d).checkpointed().component_roots()), f"WITH RECURSIVE {G.PARTNERS}, {_pc}, {_nat}, {_conf.format(part='part,')} SELECT * FROM cf")
# Pointers: each customer to the customer of the same nation whose key is a third; chains end at small keys.
_add("lbl_decode", lambda s, d: L.decode_labels(G.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_custkey div 3 ELSE c_custkey + 100000000 END").alias("parent"))), "WITH RECURSIVE z AS (SELECT c_custkey AS id, c_custkey AS cur FROM customer UNION SELECT id, cur // 3 FROM z WHERE cur % 3 = 0) SELECT id, min(cur) AS label FROM z GROUP BY 1")
_scores = {
    "precision": "CASE WHEN b = 0 AND c = 0 THEN 1 WHEN a = 0 THEN 0 ELSE a / (a + b) END",
    "recall": "CASE WHEN b = 0 AND c = 0 THEN 1 WHEN a = 0 THEN 0 ELSE a / (a + c) END",
    "rand_index": "CASE WHEN b = 0 AND c = 0 THEN 1 ELSE (a + d) / (a + b + c + d) END",
    "fowlkes_mallows": "CASE WHEN b = 0 AND c = 0 THEN 1 WHEN a = 0 THEN 0 ELSE a / sqrt((a + b) * (a + c)) END",
    "jaccard": "CASE WHEN b = 0 AND c = 0 THEN 1 ELSE a / (a + b + c) END",
    "f1_measure": "CASE WHEN b = 0 AND c = 0 THEN 1 ELSE 2 * a / (2 * a + b + c) END",
    "adj_rand_index": "CASE WHEN b = 0 AND c = 0 THEN 1 ELSE ((a + b + c + d) * (a + d) - ((a + b) * (a + c) + (c + d) * (b + d))) / ((a + b + c + d) * (a + b + c + d) - ((a + b) * (a + c) + (c + d) * (b + d))) END",
}
_dbl = "(SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM cf)"
for _name, _sql in _scores.items():
    _one(f"met_{_name}", lambda s, d, n=_name: L.pair_metrics(*G.rated(s, d)).select(n), _name, f"{G.RATED}, {_conf.format(part='')}", f"SELECT {_r(_sql)} AS {_name} FROM {_dbl}")
_one("met_adj_rand_index_comp", lambda s, d: adj_rand_index_comp_table(G.partners(s, d).checkpointed(), *_cls(s, d)), "adj_rand_index_comp", f"RECURSIVE {G.PARTNERS}, {_pc}, {_nat}, {_conf.format(part='part,')}", f"SELECT {_r(_scores['adj_rand_index'])} AS adj_rand_index_comp FROM {_dbl}")
_nmi = """c AS (SELECT label1, label2, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), r AS (SELECT label1, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT label2, sum(n) AS k FROM c GROUP BY 1),
  mi AS (SELECT sum(n / t * ln(n * t / (r * k))) AS mi FROM c JOIN r USING (label1) JOIN k USING (label2), t), h1 AS (SELECT -sum(r / t * ln(r / t)) AS h1 FROM r, t), h2 AS (SELECT -sum(k / t * ln(k / t)) AS h2 FROM k, t)"""
_one("met_norm_mutual_info", lambda s, d: L.norm_mutual_info_table(*G.classes(s, d)), "norm_mutual_info", f"{G.CLASSES}, {_nmi}", f"SELECT {_r('2 * mi / (h1 + h2)')} AS norm_mutual_info FROM mi, h1, h2")

# Objectives ---------------------------------------------------------------------------------------
_mod = """, s AS (SELECT coalesce(sum(weight), 0) AS s FROM e JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.label = b.label), w AS (SELECT sum(weight) AS n FROM e),
  o AS (SELECT label, sum(weight) AS o FROM e JOIN l ON src = id GROUP BY 1), i AS (SELECT label, sum(weight) AS i FROM e JOIN l ON dst = id GROUP BY 1), q AS (SELECT sum(o * i) AS q FROM {o} JOIN i USING (label))"""
_one("obj_modularity", lambda s, d: G.copart(s, d).modularity_table(G.part_sizes(s, d)), "modularity", G.COPART + _mod.replace("o AS (SELECT label", "oo AS (SELECT label").format(o="oo"), f"SELECT {_r('(s - q / n) / n')} AS modularity FROM s, w, q")
_one("obj_modularity_directed", lambda s, d: G.follow(s, d).modularity_table(G.part_sizes(s, d)), "modularity", G.FOLLOW + _mod.format(o="o"), f"SELECT {_r('(s - q / n) / n')} AS modularity FROM s, w, q")
_anti = ", a AS (SELECT label, dst, sum(weight) AS w FROM e JOIN l ON src = id GROUP BY 1, 2), k AS (SELECT label, sum(w) AS k FROM a GROUP BY 1)"
_anti_value = "((SELECT sum(w * w) FROM a) - (SELECT sum(k * k) FROM k) / (SELECT count(*) FROM v)) / (SELECT count(*) FROM v)"
_one("obj_antimodularity", lambda s, d: G.supply(s, d).antimodularity_table(G.sides(s, d)), "antimodularity", G.SUPPLY + _anti, f"SELECT {_r(_anti_value)} AS antimodularity")

# Traversal ----------------------------------------------------------------------------------------
_vertices("trv_components", _written(G.accounts), lambda g: g.connected_components(), f"{G.ACCOUNTS}, z AS (SELECT id AS src, id AS dst FROM v UNION SELECT z.src, e.dst FROM z JOIN e ON z.dst = e.src), m AS (SELECT src AS id, min(dst) AS root FROM z GROUP BY 1)", "SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM m", integer=True, recursive=True)
_hops = "z AS (SELECT 0::BIGINT AS cur, 0::BIGINT AS n UNION SELECT e.dst, z.n + 1 FROM z JOIN e ON z.cur = e.src WHERE z.n < {most}), h AS (SELECT cur, min(n) AS value FROM z GROUP BY 1)"
_vertices("trv_hops_single", _written(G.copart), lambda g: g.all_distances_count(0), f"{G.COPART}, {_hops.format(most=12)}", "SELECT id, value FROM v LEFT JOIN h ON cur = id", integer=True, recursive=True)
_vertices("trv_hops_bounded", _written(G.supply), lambda g: g.all_distances_count(0, 2), f"{G.SUPPLY}, {_hops.format(most=2)}", "SELECT id, value FROM v LEFT JOIN h ON cur = id", integer=True, recursive=True)
# Shortest ways among nations by weight: few vertices, so eight rounds of relaxation are the closure.
_bf = "z0 AS (SELECT id AS s, id AS t, 0::DOUBLE AS d FROM v)" + "".join(f", z{i + 1} AS (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM z{i} UNION ALL SELECT s, dst, d + weight FROM z{i} JOIN e ON t = src) GROUP BY 1, 2)" for i in range(24))
_vertices("trv_weight_single", _written(G.partners), lambda g: g.all_distances_weight(0), f"{G.PARTNERS}, {_bf}", f"SELECT id, {_r('coalesce(d, CAST(\'Infinity\' AS DOUBLE))')} AS value FROM v LEFT JOIN z24 ON t = id AND s = 0")
_vertices("trv_weight_bounded", _written(G.partners), lambda g: g.all_distances_weight(0, 100), f"{G.PARTNERS}, {_bf}", f"SELECT id, {_r('coalesce(d, CAST(\'Infinity\' AS DOUBLE))')} AS value FROM v LEFT JOIN z24 ON t = id AND s = 0 AND d <= 100")
_ah = "z AS (SELECT id AS s, id AS t, 0::BIGINT AS n FROM v UNION SELECT s, dst, n + 1 FROM z JOIN e ON t = src WHERE n < 25), h AS (SELECT s, t, min(n) AS n FROM z GROUP BY 1, 2)"
_add("trv_all_pairs_hops", lambda s, d: _round(G.partners(s, d).checkpointed().all_distances_graph().cells, "weight"), f"WITH RECURSIVE {G.PARTNERS}, {_ah} SELECT s AS src, t AS dst, n::DOUBLE AS weight FROM h WHERE s <> t")
_edges("trv_all_pairs_weight", _written(G.partners), lambda g, *_: g.all_distances_graph(True), f"{G.PARTNERS}, {_bf}", f"SELECT s AS src, t AS dst, {_r('d')} AS weight FROM z24 WHERE s <> t")
_tree = "p AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN h a ON a.cur = e.src JOIN h b ON b.cur = e.dst WHERE b.value = a.value + 1 GROUP BY 1), k AS (SELECT p.id, p.parent, e.weight::DOUBLE AS w FROM p JOIN e ON e.src = p.parent AND e.dst = p.id), t AS (SELECT 0::BIGINT AS id, 0::DOUBLE AS weight UNION ALL SELECT k.id, t.weight + k.w FROM t JOIN k ON k.parent = t.id)"
_add("trv_bfs_tree", lambda s, d: _round(G.copart(s, d).checkpointed().bfs_count(0), "weight").select(F.col("from").alias("parent"), F.col("to").alias("vertex"), "count", "weight"), f"WITH RECURSIVE {G.COPART}, {_hops.format(most=12)}, {_tree} SELECT k.parent, t.id AS vertex, value AS count, {_r('t.weight')} AS weight FROM t LEFT JOIN k ON k.id = t.id JOIN h ON cur = t.id")
# Relaxation from vertex 0 by weight, then hops, then the parent's id; no best way has more than 24 hops.
_relax = "z0 AS (SELECT 0::BIGINT AS t, 0::DOUBLE AS d, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS f)" + "".join(
    f", z{i + 1} AS MATERIALIZED (SELECT t, d, n, f FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, n, f NULLS FIRST) AS r FROM (SELECT t, d, n, f FROM z{i} UNION ALL SELECT dst, d + weight, n + 1, t FROM z{i} JOIN e ON t = src)) WHERE r = 1)" for i in range(24)
)
_add("trv_bfs_weight", lambda s, d: _round(G.copart(s, d).checkpointed().bfs_weight(0), "weight").select(F.col("from").alias("parent"), F.col("to").alias("vertex"), "count", "weight"), f"WITH {G.COPART.replace('e AS (SELECT', 'e AS MATERIALIZED (SELECT')}, {_relax} SELECT f AS parent, t AS vertex, n AS count, {_r('d')} AS weight FROM z24")

# Centrality ---------------------------------------------------------------------------------------
_n = "(SELECT count(*) - 1 FROM v)"
_cen = f"{G.PARTNERS}, {_ah}, g AS (SELECT s, count(*) AS c, sum(n) AS t, sum(1.0 / n) AS i, sum(1.0 / n) FILTER (n <= 2) AS i2 FROM h WHERE s <> t GROUP BY 1)"
_vertices("cen_closeness", _written(G.partners), lambda g: g.closeness_centrality().withColumn("value", F.col("value") * 1e6), _cen, f"SELECT id, {_r(f'1e6 * {_n} / (coalesce(t, 0) + ({_n} - coalesce(c, 0)) * 4294967295.0::DOUBLE)')} AS value FROM v LEFT JOIN g ON s = id", recursive=True)
_vertices("cen_harmonic", _written(G.partners), lambda g: g.harmonic_centrality(), _cen, f"SELECT id, {_r(f'(coalesce(i, 0) + ({_n} - coalesce(c, 0)) / 4294967295.0::DOUBLE) / {_n}')} AS value FROM v LEFT JOIN g ON s = id", recursive=True)
_vertices("cen_harmonic_bounded", _written(G.partners), lambda g: g.harmonic_centrality(2, fast=True), _cen, f"SELECT id, {_r(f'coalesce(i2, 0) / {_n}')} AS value FROM v LEFT JOIN g ON s = id", recursive=True)

# Communities: orders of merges and sweeps aren't SQL; what must hold for any result is checked beside them.
_add("com_laprop", lambda s, d: G.copart(s, d).laprop())


def _inner_links(s: SparkSession, d: str) -> DataFrame:
    links = stash(G.copart_links(s, d))
    labels = Graph.from_edges(links, G.table(s, d, "part").count()).laprop(written=True)
    own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
    # A link is two cells.
    return links.join(own("src"), "src").join(own("dst"), "dst").agg((2 * F.count_if((F.col("_src") == F.col("_dst")) & (F.col("src") != F.col("dst")))).alias("inner_links"))


_add("com_laprop_inner_links", _inner_links)
for _name, _flags in {"max": {}, "max_fast": {"fast": True}, "min": {"minimize": True}, "min_fast": {"minimize": True, "fast": True}, "anti": {"antimodularity": True}, "anti_fast": {"antimodularity": True, "fast": True}}.items():
    _add(f"com_newman_{_name}", lambda s, d, f=_flags: G.partners(s, d).checkpointed().newman(**f))
_add("com_newman_directed", lambda s, d: G.trade(s, d).checkpointed().newman(fast=True))
_add("com_newman_copart", lambda s, d: G.copart(s, d).checkpointed().newman(fast=True))
_add("com_newman_k", lambda s, d: G.partners(s, d).checkpointed().newman(num_clusters=7))
_add("com_newman_k_groups", lambda s, d: G.partners(s, d).checkpointed().newman(num_clusters=7).agg(F.countDistinct("label").alias("n")))
_add("com_sbm", lambda s, d: G.partners(s, d).checkpointed().sbm())
_add("com_sbm_heat_bath", lambda s, d: G.partners(s, d).checkpointed().sbm_heat_bath())


def _report(s: SparkSession, d: str) -> DataFrame:
    return _round(metric_report(G.partners(s, d).checkpointed(), G.regions(s, d), _cls(s, d)[1]), "value").select("metric", "value")


_truth = "p AS (SELECT l.id, l.id % 3 AS label1, label AS label2, part FROM l JOIN cp ON cp.id = l.id)"
_loose = f"x AS (WITH {_conf.format(part='')} SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM cf), xc AS (WITH {_conf.format(part='part,')} SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM cf)"
_report_rows = [
    ("#nodes", "(SELECT count(*) FROM v)"), ("#edges", "(SELECT (count(*) + count(*) FILTER (src = dst)) // 2 FROM e)"), ("#diagonal", "(SELECT count(*) FROM e WHERE src = dst)"),
    ("#communities", "(SELECT count(DISTINCT label) FROM l)"), ("modularity", "(SELECT (s - q / n) / n FROM s, w, q)"), ("antimodularity", f"({_anti_value})"),
    ("density", "(SELECT CASE WHEN count(*) FILTER (src = dst) = 0 THEN count(*) / 2.0 / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1) / 2) END FROM e)"),
    *[(n.replace("_", "-"), f"(SELECT {sql} FROM x)") for n, sql in _scores.items()], ("adj-rand-index-comp", f"(SELECT {_scores['adj_rand_index']} FROM xc)"),
    ("norm-mutual-info", f"(WITH {_nmi} SELECT 2 * mi / (h1 + h2) FROM mi, h1, h2)"),
]
_add(
    "met_report",
    _report,
    f"WITH RECURSIVE {G.PARTNERS}, {_pc}, {_truth}{_mod.replace('o AS (SELECT label', 'oo AS (SELECT label').format(o='oo')}{_anti}, {_loose}, rows_ AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, {_r(v)} AS value" for n, v in _report_rows)
    + ") SELECT metric, value FROM rows_ WHERE value IS NOT NULL AND NOT isnan(value)",
)

# Undirected contraction, pointers instead of labels, single distances and limits, over the graph of parts.
_edges("merge_add_undirected", G.copart, lambda g, *_: g.merge_nodes_add(1, 2), G.COPART, f"SELECT {_to.format('src')} AS src, {_to.format('dst')} AS dst, {_r('sum(weight)')} AS weight FROM e GROUP BY 1, 2")
for _name, _pick in (("min", "least"), ("max", "greatest")):
    _edges(f"merge_{_name}_undirected", _written(G.copart), lambda g, *_, m=_name: getattr(g, f"merge_nodes_{m}")(1, 2), f"""{G.COPART},
      x AS (SELECT dst, max(CASE WHEN src = 1 THEN weight END) AS a, max(CASE WHEN src = 2 THEN weight END) AS b FROM e WHERE src IN (1, 2) AND dst NOT IN (1, 2) GROUP BY 1),
      y AS (SELECT dst, CASE WHEN b IS NULL THEN a ELSE {_pick}(coalesce(a, 0), b) END AS weight FROM x)""", f"""SELECT src::BIGINT AS src, dst::BIGINT AS dst, {_r('weight')} AS weight FROM (SELECT src, dst, weight FROM e WHERE src NOT IN (1, 2) AND dst NOT IN (1, 2)
      UNION ALL SELECT 1, dst, weight FROM y UNION ALL SELECT dst, 1, weight FROM y UNION ALL SELECT 1, 1, {_pick}(0, weight) FROM e WHERE src = 1 AND dst = 2)""")
_edges("merge_custom_parts", _written(G.copart), lambda g, *_: g.merge_nodes_custom(1, 2, 0.5, 0.5, -0.25, 0.0), *(x.replace(G.PARTNERS, G.COPART).removeprefix("WITH ") for x in (ORACLES["merge_custom"].split(" SELECT src::BIGINT")[0], "SELECT src::BIGINT" + ORACLES["merge_custom"].split(" SELECT src::BIGINT")[1])))
_pointers = lambda s, d: G.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_partkey div 3 ELSE p_partkey + 100000000 END").alias("parent"))
_chained = "RECURSIVE " + G.COPART.replace("l AS (SELECT p_partkey AS id, p_size::BIGINT AS label FROM part)", "z AS (SELECT p_partkey AS id, p_partkey AS cur FROM part UNION SELECT id, cur // 3 FROM z WHERE cur % 3 = 0), l AS (SELECT id, min(cur) AS label FROM z GROUP BY 1)")
_one("obj_modularity_decode", lambda s, d: s.createDataFrame([(G.copart(s, d).checkpointed().modularity_decode(_pointers(s, d)),)], "modularity double"), "modularity", _chained + _mod.replace("o AS (SELECT label", "oo AS (SELECT label").format(o="oo"), f"SELECT {_r('(s - q / n) / n')} AS modularity FROM s, w, q")
_one("obj_antimodularity_decode", lambda s, d: s.createDataFrame([(G.copart(s, d).checkpointed().antimodularity_decode(_pointers(s, d)),)], "antimodularity double"), "antimodularity", _chained + _anti, f"SELECT {_r(_anti_value)} AS antimodularity")
_edges("edges_limit", G.copart, lambda g, *_: g.edges(limit=100), G.COPART, f"{CELLS} e WHERE dst >= src ORDER BY src, dst LIMIT 100")
_edges("edges_row_limit", G.copart, lambda g, *_: g.out_edges(7, limit=5), G.COPART, f"SELECT dst, {_r('weight')} AS weight FROM e WHERE src = 7 ORDER BY dst LIMIT 5")


def _apart(s: SparkSession, d: str) -> DataFrame:
    """Both distances from part 0 to the last part."""
    g = G.follow(s, d).checkpointed()
    return _round(s.createDataFrame([(g.distance_count(0, g.num_nodes - 1), g.distance_weight(0, g.num_nodes - 1))], "hops long, weight double"), "weight")


# Complements of the graph of parts, of which no query makes the square; the SQL does.
_inv = f"{G.COPART}, i AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, coalesce((10 - weight)::FLOAT, 10)::FLOAT AS weight FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.id AND dst = b.id WHERE a.id <> b.id AND (weight IS NULL OR 10 - weight > 0))"
_complement = lambda s, d: G.copart(s, d).checkpointed().complement(10, False)
_vertices("inv_degrees", _complement, lambda c: c.out_degrees(), _inv, "SELECT v.id, count(src) AS value FROM v LEFT JOIN i ON src = v.id GROUP BY 1", integer=True)
_vertices("inv_weights", _complement, lambda c: c.in_weights(), _inv, f"SELECT v.id, {_r('coalesce(sum(weight::DOUBLE), 0)')} AS value FROM v LEFT JOIN i ON dst = v.id GROUP BY 1")
_vertices("inv_degree_anomalies", _complement, lambda c: c.degree_anomalies(), f"{_inv}, d AS (SELECT src AS id, count(*) AS d FROM i GROUP BY 1)", f"SELECT v.id, {_r('coalesce(count(d.d) - sum(d.d) / count(d.d), 0)')} AS value FROM v LEFT JOIN i ON src = v.id LEFT JOIN d ON d.id = dst GROUP BY 1")
_vertices("inv_matvec", _complement, lambda c: c.multiply_vector(c.nodes.select("id", (F.col("id") % 7).cast("double").alias("value"))), _inv, f"SELECT v.id, {_r('coalesce(sum(weight::DOUBLE * (dst % 7)::DOUBLE), 0)')} AS value FROM v LEFT JOIN i ON src = v.id GROUP BY 1")
_add("inv_counts", lambda s, d: _round(_complement(s, d).counts(), "weights"), f"WITH {_inv} SELECT count(*) // 2 AS links, count(*) AS cells, 0::BIGINT AS diagonal, {_r('sum(weight::DOUBLE) / 2')} AS weights FROM i")
_one("inv_density", lambda s, d: _complement(s, d).density_table(), "density", _inv, f"SELECT {_r('(SELECT count(*) / 2.0 FROM i) / (count(*) * (count(*) - 1) / 2)')} AS density FROM v")
_one("inv_modularity", lambda s, d: _complement(s, d).modularity_table(G.part_sizes(s, d)), "modularity", _inv + _mod.replace("o AS (SELECT label", "oo AS (SELECT label").format(o="oo").replace("FROM e ", "FROM i ").replace("FROM e)", "FROM i)").replace("sum(weight)", "sum(weight::DOUBLE)").replace(", i AS (SELECT label", ", ii AS (SELECT label").replace("JOIN i USING", "JOIN ii USING"), f"SELECT {_r('(s - q / n) / n')} AS modularity FROM s, w, q")
_one("inv_antimodularity", lambda s, d: _complement(s, d).antimodularity_table(G.part_sizes(s, d)), "antimodularity", _inv + _anti.replace("FROM e ", "FROM i ").replace("sum(weight)", "sum(weight::DOUBLE)"), f"SELECT {_r(_anti_value)} AS antimodularity")
_edges("inv_filter_weights", _complement, lambda c, *_: c.filter_weights(1, 8.5), _inv, f"{CELLS} i WHERE weight BETWEEN 1 AND 8.5")
_edges("inv_again", _complement, lambda c, *_: c.invert(10, False), G.COPART, f"SELECT src, dst, {_r('least(weight, 10)')} AS weight FROM e")
_edges("inv_row", _complement, lambda c, *_: c.out_edges(7), _inv, f"SELECT dst, {_r('weight')} AS weight FROM i WHERE src = 7")
_vertices("inv_components", _complement, lambda c: c.connected_components(), f"{_inv}, z AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM z JOIN i ON src = z.id)", "SELECT id, 0::BIGINT AS label FROM v WHERE id IN (SELECT id FROM z)", integer=True, recursive=True)

# Larger graphs: distances between all parts are found round by round, each taking away the pairs that were there before.
_all_pairs = "r0 AS (SELECT id AS s, id AS t FROM v), r1 AS MATERIALIZED (SELECT src AS s, dst AS t FROM e WHERE src <> dst)" + "".join(
    f", r{k + 1} AS MATERIALIZED (SELECT DISTINCT r.s, e.dst AS t FROM r{k} r JOIN e ON r.t = e.src EXCEPT ({' UNION ALL '.join(f'SELECT s, t FROM r{j}' for j in range(k + 1))}))" for k in range(1, 12)
)
_far = "h AS (" + " UNION ALL ".join(f"SELECT s, t, {k} AS n FROM r{k}" for k in range(13)) + "), g AS (SELECT s, count(*) AS c, sum(n) AS t, sum(1.0::DOUBLE / n) AS i, sum(1.0::DOUBLE / n) FILTER (n <= 2) AS i2 FROM h WHERE n > 0 GROUP BY 1)"
_vertices("cen_closeness_parts", _written(G.follow), lambda g: g.closeness_centrality().withColumn("value", F.col("value") * 1e6), f"{G.FOLLOW}, {_all_pairs}, {_far}", f"SELECT id, {_r(f'1e6 * {_n} / (coalesce(t, 0) + ({_n} - coalesce(c, 0)) * 4294967295.0::DOUBLE)')} AS value FROM v LEFT JOIN g ON s = id")
_vertices("cen_harmonic_parts", _written(G.follow), lambda g: g.harmonic_centrality(), f"{G.FOLLOW}, {_all_pairs}, {_far}", f"SELECT id, {_r(f'(coalesce(i, 0) + ({_n} - coalesce(c, 0)) / 4294967295.0::DOUBLE) / {_n}')} AS value FROM v LEFT JOIN g ON s = id")
# Undirected, two rounds: what the links lead to, and what is behind that.
_vertices("cen_harmonic_bounded_parts", _written(G.copart), lambda g: g.harmonic_centrality(2, fast=True), f"{G.COPART}, r1 AS (SELECT src AS s, dst AS t FROM e), r2 AS (SELECT DISTINCT r1.s, e.dst AS t FROM r1 JOIN e ON r1.t = e.src WHERE r1.s <> e.dst EXCEPT SELECT s, t FROM r1), g AS (SELECT s, sum(i) AS i FROM (SELECT s, 1.0::DOUBLE AS i FROM r1 UNION ALL SELECT s, 0.5::DOUBLE FROM r2) GROUP BY 1)", f"SELECT id, {_r(f'coalesce(i, 0) / {_n}')} AS value FROM v LEFT JOIN g ON s = id")
_hit = "p AS (SELECT DISTINCT (o_custkey % n)::BIGINT AS a, (o_orderkey % n)::BIGINT AS b FROM orders, (SELECT count(*) AS n FROM part))"


def _order_pairs(s: SparkSession, d: str) -> DataFrame:
    n = G.table(s, d, "part").count()
    return G.table(s, d, "orders").select((F.col("o_custkey") % n).cast("long").alias("a"), (F.col("o_orderkey") % n).cast("long").alias("b"))


_add("trv_pair_distances", lambda s, d: G.follow(s, d).checkpointed().pair_distances(_order_pairs(s, d)), f"WITH {G.FOLLOW}, {_hit}, {_all_pairs}, {_far} SELECT a, b, n::BIGINT AS value FROM p LEFT JOIN h ON s = a AND t = b")
_add("trv_bfs_tree_directed", lambda s, d: _round(G.follow(s, d).checkpointed().bfs_count(0), "weight").select(F.col("from").alias("parent"), F.col("to").alias("vertex"), "count", "weight"), f"WITH RECURSIVE {G.FOLLOW}, {_hops.format(most=30)}, {_tree} SELECT k.parent, t.id AS vertex, value AS count, {_r('t.weight')} AS weight FROM t LEFT JOIN k ON k.id = t.id JOIN h ON cur = t.id")
_inf, _share = "coalesce(d, CAST('Infinity' AS DOUBLE))", "CASE WHEN count(*) = 0 THEN CAST('NaN' AS DOUBLE) ELSE count(b.src)::DOUBLE / count(*) END"
_follow_once = G.FOLLOW.replace("e AS (SELECT", "e AS MATERIALIZED (SELECT")
_vertices("trv_weight_single_parts", _written(G.follow), lambda g: g.all_distances_weight(0), f"{_follow_once}, {_relax}", f"SELECT id, {_r(_inf)} AS value FROM v LEFT JOIN z24 ON t = id")
_vertices("trv_weight_bounded_parts", _written(G.follow), lambda g: g.all_distances_weight(0, 4), f"{_follow_once}, {_relax}", f"SELECT id, {_r(_inf)} AS value FROM v LEFT JOIN z24 ON t = id AND d <= 4")
_edges("alg_square_parts", G.follow, lambda g, *_: g.square(), G.FOLLOW, _matmul.format("e"))
_power20 = _power.split(", x21 AS MATERIALIZED")[0]
_add("alg_power_parts", lambda s, d: _round(G.copart(s, d).power_iteration(20)[0], "value"), f"WITH {G.COPART.replace('o AS (', 'o AS MATERIALIZED (', 1)}, {_power20} SELECT id, {_r('value')} AS value FROM x20")
_one("stat_reciprocity_parts", lambda s, d: G.follow(s, d).checkpointed().reciprocity_table(), "reciprocity", G.FOLLOW, f"SELECT {_r(_share)} AS reciprocity FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src")
_add("trv_distance", _apart, f"WITH {_follow_once}, {_relax}, {_all_pairs} SELECT (SELECT min(n)::BIGINT FROM (" + " UNION ALL ".join(f"SELECT {k} AS n FROM r{k} WHERE s = 0 AND t = (SELECT max(id) FROM v)" for k in range(13)) + f")) AS hops, {_r('coalesce(max(d), CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE))')} AS weight FROM z24 WHERE t = (SELECT max(id) FROM v)")
_add("stat_counts_parts", lambda s, d: _round(G.copart(s, d).counts(), "weights"), f"WITH {G.COPART} SELECT (count(*) + count(*) FILTER (src = dst)) // 2 AS links, count(*) AS cells, count(*) FILTER (src = dst) AS diagonal, {_r('(sum(weight) + coalesce(sum(weight) FILTER (src = dst), 0)) / 2')} AS weights FROM e")
_edges("edges_lower_triangle_parts", G.copart, lambda g, *_: g.lower_triangle(), G.COPART, f"{CELLS} e WHERE dst <= src")
_add("io_graph_text_parts", lambda s, d: text.graph_lines(G.follow(s, d)).select("line"), f"WITH {G.FOLLOW} SELECT (SELECT count(*)::VARCHAR FROM part) AS line UNION ALL SELECT '' UNION ALL SELECT concat_ws(' ', (src + 1)::VARCHAR, (dst + 1)::VARCHAR, CASE WHEN weight <> 1 THEN printf('%.6f', weight::DOUBLE) END) FROM e")


def _gml_parts(s: SparkSession, d: str) -> DataFrame:
    path, links = new_folder(s), stash(G.copart_links(s, d))
    text.write_gml(Graph.from_edges(links, G.table(s, d, "part").count()), path, {"size": G.part_sizes(s, d)}, "gzip")
    drop_stash(links)
    g, names = text.load_gml(s, path)
    return _round(g.cells, "weight").select("src", "dst", "weight", F.lit(g.directed).alias("directed"), F.lit(names.count()).alias("nodes"))


_add("io_load_gml_parts", _gml_parts, f"WITH {G.COPART} {CELLS.replace(' FROM', ', false AS directed, (SELECT count(*) FROM v) AS nodes FROM')} e")
_edges("io_load_graph_undirected_parts", lambda s, d: text.load_graph(s, _file(text.graph_lines(G.copart(s, d)))), lambda g, *_: g, G.COPART, f"{CELLS} e")

# Text ---------------------------------------------------------------------------------------------
_add("io_graph_text", lambda s, d: text.graph_lines(G.trade(s, d)).select("line"), f"WITH {G.TRADE} SELECT (SELECT count(*)::VARCHAR FROM nation) AS line UNION ALL SELECT '' UNION ALL SELECT concat_ws(' ', (src + 1)::VARCHAR, (dst + 1)::VARCHAR, CASE WHEN weight <> 1 THEN printf('%.6f', weight::DOUBLE) END) FROM e")
_add("io_gml", lambda s, d: text.gml_lines(G.trade(s, d), {"region": G.regions(s, d)}).select("line"), f"""WITH {G.TRADE} SELECT unnest(['graph [', '    directed 1', ']']) AS line UNION ALL
  SELECT unnest(['    node [', '        id ' || id, '        region ' || label, '    ]']) FROM l UNION ALL SELECT unnest(['    edge [', '        source ' || src, '        target ' || dst, '        value ' || printf('%.6f', weight::DOUBLE), '    ]']) FROM e""")


def _file(lines: DataFrame) -> str:
    """The lines as a text file in the shared folder."""
    path = new_folder(lines.sparkSession)
    text.write_lines(lines, path)
    return path


def _gml(s: SparkSession, d: str) -> DataFrame:
    g, names = text.load_gml(s, _file(text.gml_lines(G.trade(s, d), {"region": G.regions(s, d)})))
    return _round(g.cells, "weight").select("src", "dst", "weight", F.lit(g.directed).alias("directed"), F.lit(names.count()).alias("nodes"))


_edges("io_load_graph", lambda s, d: text.load_graph(s, _file(text.graph_lines(G.follow(s, d))), directed=True), lambda g, *_: g, G.FOLLOW, f"{CELLS} e")
_edges("io_load_graph_undirected", lambda s, d: text.load_graph(s, _file(text.graph_lines(G.partners(s, d)))), lambda g, *_: g, G.PARTNERS, f"{CELLS} e")
def _labels(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    text.write_labels(G.part_sizes(s, d), path)
    return text.load_labels(s, path, G.table(s, d, "part").count())


_add("io_load_labels", _labels, "SELECT p_partkey AS id, p_size::BIGINT AS label FROM part")
_add("io_load_gml", _gml, f"WITH {G.TRADE} {CELLS.replace(' FROM', ', true AS directed, (SELECT count(*) FROM v) AS nodes FROM')} e")
_add("io_labels_text", lambda s, d: text.labels_lines(G.regions(s, d)).select("line"), f"WITH {G.TRADE} SELECT '# Labels' AS line UNION ALL SELECT string_agg(label::VARCHAR, ' ' ORDER BY id) FROM l")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the trade between nations when they are grouped by region."""
    return QUERIES["obj_modularity_directed"](spark, sf_dir)


