"""Text formats. Ids in edge lists are 1-based, in GML and everywhere else 0-based.

Files are read in splits, each by a task of its own, and written as one part for each range of lines; parts in the order of their names are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from ..runtime import running_totals, stash

BLANK = r"^\s*$"
#: Where a piece of text stands: its file, the split of it, and the place within.
PLACE = ["file", "split", "place"]


def placed(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``file, split, place, text``: what stands between separators in a file, or in the files of a folder one after the other.

    Parts that Spark has written are ordered by their numbers, other files by name. ``place`` grows within a split without gaps. A
    missing file raises FileNotFoundError.
    """
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.option("lineSep", separator).text(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    name = F.col("_metadata.file_path")
    folder, number = F.regexp_extract(name, r"^(.*/)[^/]*$", 1), F.regexp_extract(name, r"/part-(\d+)[^/]*$", 1).try_cast("long")
    return found.select(F.struct(folder.alias("folder"), number.alias("number"), name.alias("name")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, text`` of a file or folder, from 0.

    The splits are read by as many tasks. A line's number is its place in its split and the lines of all splits before, of which there is one row each.
    """
    lines = stash(placed(spark, path))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = stash(running_totals(splits, [F.col("file"), F.col("split")], {"before": F.col("n")}).select("file", "split", "first", "before"))
    return lines.join(before, ["file", "split"]).select((F.col("before") + F.col("place") - F.col("first")).alias("line_no"), "text")


def is_comment(text: Column) -> Column:
    return text.startswith("#") | text.startswith(";")


def load_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """SRC-1. First the vertex count, then ``i j [weight]``; ``#`` and ``;`` begin comments.

    A missing or unreadable weight is 1; of repeated edges the last holds, in undirected graphs in either direction. Lines without two ids, ids out of
    range and a missing count raise ValueError. Lines of blanks are skipped.
    """
    lines = numbered_lines(spark, path).where(~is_comment(F.col("text")) & ~F.col("text").rlike(BLANK))
    lines = stash(lines)
    first = lines.agg(F.min_by("text", "line_no").alias("text"), F.min("line_no").alias("no")).first()
    digits = first["text"].split()[0] if first["text"] else ""
    if not digits.isdigit():
        raise ValueError(f"{path} has no vertex count")
    n = int(digits)
    number = lambda k: F.regexp_extract("text", rf"^\s*{k}", 1)
    one, two, three = r"(\d+)", r"\d+\s+(\d+)", r"\d+\s+\d+\s+([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|inf|nan))"
    rows = lines.where(F.col("line_no") > first["no"]).select(
        F.col("line_no").cast("long").alias("seq"), (number(one).try_cast("long") - 1).alias("src"), (number(two).try_cast("long") - 1).alias("dst"), F.coalesce(number(three).try_cast("float"), F.lit(1.0).cast("float")).alias("weight")
    )
    rows = stash(rows)
    bad = rows.where(F.col("src").isNull() | F.col("dst").isNull() | ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)).agg(F.min("seq").alias("no")).first()["no"]
    if bad is not None:
        raise ValueError(f"{path}, line {bad + 1}: an edge between two of {n} vertices was expected")
    return Graph.empty(spark, n, directed).set_edges(rows)


def load_labels(spark: SparkSession, path: str, num_nodes: int) -> DataFrame:
    """SRC-2. Whole numbers, one for each vertex, over any number of lines. Too many, too few or anything else raise ValueError.

    All labels may stand in one line, so the file is cut at spaces; whether a piece lies in a comment is carried from the last piece with a line's
    beginning before it, over the splits as well.
    """
    pieces = stash(placed(spark, path, " ").select(*PLACE, F.split("text", "\n", -1).alias("lines")))
    start = pieces.agg(F.min(F.struct(*PLACE)).alias("p")).first()["p"]
    is_start = (F.col("place") == F.lit(start["place"] if start else None)) & (F.col("split") == 0)
    # Whether the line that goes on behind a piece is a comment; null where the piece begins none.
    begun = F.when(F.size("lines") > 1, is_comment(F.element_at("lines", -1))).when(is_start, is_comment(F.col("lines")[0]))
    pieces = pieces.withColumns({"begun": begun, "starts": is_start})
    splits = pieces.groupBy("file", "split").agg(F.max_by("begun", F.when(F.col("begun").isNotNull(), F.col("place"))).alias("last"))
    # One row for each split.
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    carried = stash(splits.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("carried")))
    inside = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.last("begun", ignorenulls=True).over(inside), F.col("carried"), F.lit(False))
    inherited = F.when(F.col("starts"), is_comment(F.col("lines")[0])).otherwise(goes_on)
    lines = pieces.join(carried, ["file", "split"]).select(*PLACE, inherited.alias("inherited"), F.posexplode("lines").alias("k", "line"))
    lines = lines.where(~F.when(F.col("k") == 0, F.col("inherited")).otherwise(is_comment(F.col("line"))))
    words = lines.select(*PLACE, "k", F.posexplode(F.regexp_extract_all("line", F.lit(r"\S+"), 0)).alias("at", "word"))
    order = [F.col(c) for c in (*PLACE, "k", "at")]
    words = stash(running_totals(words.select(*PLACE, "k", "at", F.col("word").try_cast("long").alias("label")), order, {"id": F.lit(1).cast("long")}))
    row = words.agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull() | (F.col("label") < 0)).alias("bad")).first()
    if row["bad"] or row["n"] != num_nodes:
        raise ValueError(f"{path}: {num_nodes} labels were expected, {row['n']} found, {row['bad']} of them no label")
    return words.select("id", "label")


def gml_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, at, token, depth, opened``: the words, strings and brackets of a GML file, how many lists are open before each, and how many lists of the second level have begun.

    Brackets within strings are none. A string may go on over lines, of which only its beginning is kept; lines that begin with ``#`` are comments.
    """
    lines = numbered_lines(spark, path).where(~F.col("text").startswith("#"))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    lines = running_totals(lines.withColumn("quotes", quotes), [F.col("line_no")], {"before": F.col("quotes")})
    # A line that begins within a string counts from the string's end, if it has one.
    text = F.when(F.col("before") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", '^[^"]*("|$)', ""))
    pattern = r'"[^"]*"?|\[|\]|[^\s\[\]"]+'
    tokens = lines.select("line_no", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("at", "token"))
    order = [F.col("line_no"), F.col("at")]
    step = F.when(F.col("token") == "[", 1).when(F.col("token") == "]", -1).otherwise(0)
    tokens = running_totals(tokens, order, {"depth": step.cast("long")})
    begins = ((F.col("token") == "[") & (F.col("depth") == 1)).cast("long")
    tokens = running_totals(tokens, order, {"opened": begins})
    return tokens.withColumn("opened", F.col("opened") + begins)


#: A key and a value that hold neither brackets nor line feeds, and can't be taken for each other.
PAIR = r'(?:\s+[A-Za-z_]\w*\s+(?:[-+.\d][^\s\[\]"]*|"[^"\[\]\n]*"))'
#: What stands before the first list of a graph: pairs, the graph's name and bracket, and its own pairs.
HEAD = rf"^(?:\s*(?!graph\b)[A-Za-z_]\w*\s+(?:[-+.\d][^\s\[\]\"]*|\"[^\"\[\]\n]*\"))*+\s*graph\s*\[({PAIR}*+)(?=\s+(?:node|edge)\s*\[)"


def load_gml(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """SRC-5. The graph, and ``id, name`` of its vertices; ids are made 0 .. n-1 in the order of the file's.

    Lists within a vertex or edge are passed over, strings may hold brackets, and the lists of vertices and edges may stand in any order. Brackets
    have to be closed.

    A file is cut at closing brackets first. If every piece is one list of plain pairs, but for what stands before the first and behind the last, no
    piece depends on another and none is dealt out. Any other file is read by the depth of its brackets.
    """
    pieces = stash(_gml_pieces(spark, path))
    lists, directed = _plain_lists(pieces) or _nested_lists(spark, path)
    number = lambda c: F.col(c).try_cast("long")
    plain = F.regexp_replace("label", '^"|"$', "")
    nodes = lists.where("kind = 'node'").select(number("id").alias("key"), F.coalesce(plain, F.lit("")).alias("name"))
    nodes = stash(running_totals(nodes, [F.col("key")], {"id": F.lit(1).cast("long")}))
    edges = lists.where("kind = 'edge'").select(number("source").alias("s"), number("target").alias("t"), F.coalesce(F.col("value").try_cast("float"), F.lit(1.0)).alias("weight"), "seq")
    n = nodes.count()
    if nodes.where(~F.col("key").eqNullSafe(F.col("id"))).isEmpty():
        # Ids that are 0 .. n-1 already.
        links = edges.where(F.col("s").between(0, n - 1) & F.col("t").between(0, n - 1)).select("seq", F.col("s").alias("src"), F.col("t").alias("dst"), "weight")
    else:
        end = lambda key, name: nodes.select(F.col("key").alias(key), F.col("id").alias(name))
        links = edges.join(end("s", "src"), "s").join(end("t", "dst"), "t").select("seq", "src", "dst", "weight")
    if directed:
        return Graph.empty(spark, n, True).set_edges(links), nodes.select("id", "name")
    # The last weight holds in either direction, so each edge is dealt out once and mirrored afterwards.
    links = links.select("seq", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    cells = Graph.empty(spark, n, True).set_edges(links).cells.select(F.explode(F.when(F.col("src") == F.col("dst"), F.slice(turned, 1, 1)).otherwise(turned)).alias("_cell"), "weight")
    return Graph(cells.select("_cell.src", "_cell.dst", "weight"), n), nodes.select("id", "name")


def _gml_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, place, s, t, w, text``: what stands between closing brackets; for an edge of source, target and value alone these, and no text."""
    lines = placed(spark, path, "]").withColumn("lines", F.split("text", "\n"))
    line = lambda k: F.trim(F.get("lines", F.lit(k)))
    after = lambda k, key: F.when(line(k).startswith(f"{key} "), F.substring(line(k), len(key) + 2, 1_000))
    s, t, w = after(2, "source").try_cast("long"), after(3, "target").try_cast("long"), after(4, "value").try_cast("float")
    is_edge = (F.size("lines") == 6) & (line(0) == "") & (line(1) == "edge [") & (line(5) == "") & (F.length("text") < 1_000) & s.isNotNull() & t.isNotNull() & w.isNotNull()
    return lines.select(*PLACE, F.when(is_edge, s).alias("s"), F.when(is_edge, t).alias("t"), F.when(is_edge, w).alias("w"), F.when(~is_edge, F.col("text")).alias("text"))


def _plain_lists(pieces: DataFrame) -> tuple[DataFrame, bool] | None:
    """``kind, id, label, source, target, value, seq`` of the lists of the second level, and whether the graph is directed; None if a piece isn't plain.

    A file's last piece has no bracket behind it, so it has to be blank; in the last file, the graph's own bracket stands before that.
    """
    text = F.col("text")
    # Long lists aren't plain, as what the expressions keep of a text grows with it.
    short = text.isNull() | (F.length("text") < 5_000)
    is_head, is_blank = short & F.coalesce(text.rlike(HEAD), F.lit(False)), F.coalesce(text.rlike(r"^\s*$"), F.lit(False))
    rest = F.regexp_replace("text", HEAD, "")
    lists = pieces.withColumns({"head": is_head, "blank": is_blank, "plain": text.isNull() | (short & F.coalesce(rest.rlike(rf"^\s*(?:node|edge)\s*\[{PAIR}++\s*$"), F.lit(False)))})
    splits = stash(lists.groupBy("file", "split").agg(
        F.count_if(~F.col("plain") & ~F.col("blank")).alias("odd"), F.count_if("head").alias("heads"), F.min(F.when(F.col("head"), F.col("place"))).alias("head"), F.min("place").alias("start"),
        F.count_if("blank").alias("blanks"), F.min(F.when(F.col("blank"), F.col("place"))).alias("blank"), F.max(F.when(~F.col("blank"), F.col("place"))).alias("last"), F.count("*").alias("n"),
    ))
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("split", c))
    files = splits.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("odd", "heads", "blanks")], *[F.min(at(c)).alias(c) for c in ("head", "start", "blank")], F.max(at("last")).alias("last"))
    ends = files.agg(F.min("file").alias("_first"), F.max("file").alias("_last"), F.count("*").alias("_n"))
    is_first, is_last = F.col("file") == F.col("_first"), F.col("file") == F.col("_last")
    begins = F.when(is_first, (F.col("heads") == 1) & (F.col("head") == F.col("start"))).otherwise(F.col("heads") == 0)
    closes = F.when(is_last, (F.col("blanks") == 2) | ((F.col("blanks") == 1) & (F.col("_n") == 1))).otherwise(F.col("blanks") == 1)
    regular = (F.col("odd") == 0) & begins & closes & (F.col("last").isNull() | (F.col("last") < F.col("blank")))
    if files.isEmpty() or not files.crossJoin(F.broadcast(ends)).where(~F.coalesce(regular, F.lit(False))).isEmpty():
        return None
    head = lists.where("head").select(F.regexp_extract("text", HEAD, 1).rlike(rf"^{PAIR}*?\s+directed\s+1(?:\s|$)").alias("directed")).first()
    # The order of pieces as one number: splits are counted, of which there is one row each.
    before = stash(running_totals(splits, [F.col("file"), F.col("split")], {"before": F.col("n")}).select("file", "split", F.col("start").alias("_start"), F.col("before").alias("_before")), 1)
    ordered = pieces.join(before, ["file", "split"]).withColumn("seq", F.col("_before") + F.col("place") - F.col("_start"))
    other = lambda key: F.nullif(F.regexp_extract(rest, rf'\[(?:(?!\s+{key}\s){PAIR})*+\s+{key}\s+([^\s"]+|"[^"]*")', 1), F.lit(""))
    own = lambda key, column: F.when(text.isNull(), F.col(column)).otherwise(other(key)).alias(key)
    kind = F.when(text.isNull(), "edge").otherwise(F.regexp_extract(rest, r"^\s*(node|edge)", 1)).alias("kind")
    found = ordered.where(text.isNull() | ~is_blank).select(kind, *[F.when(text.isNotNull(), other(k)).alias(k) for k in ("id", "label")], own("source", "s"), own("target", "t"), own("value", "w"), "seq")
    return found, head["directed"]


def _nested_lists(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The same of any file, by the depth of its brackets."""
    tokens = stash(gml_tokens(spark, path))
    order = F.struct("line_no", "at")
    word = ~F.col("token").isin("[", "]")
    # What stands between two lists of the second level are a few words of the graph itself; the last one names the list.
    own = tokens.where(word & (F.col("depth") == 1))
    kinds = own.groupBy((F.col("opened") + 1).alias("opened")).agg(F.max_by("token", order).alias("kind"))
    follows = F.lag("token").over(Window.partitionBy("opened").orderBy("line_no", "at"))
    directed = not own.select("token", follows.alias("key")).where("key = 'directed' AND token = '1'").isEmpty()
    # In a list of the second level keys and values take turns, but for keys of further lists.
    listed = Window.partitionBy("opened").orderBy("line_no", "at")
    inner = tokens.where("depth >= 2").withColumn("next", F.lead("token").over(listed))
    turn = inner.where(word & (F.col("depth") == 2) & ~F.coalesce(F.col("next") == "[", F.lit(False))).withColumns({"turn": F.row_number().over(listed), "value": F.lead("token").over(listed)})
    pairs = turn.where("turn % 2 = 1").select("opened", F.col("token").alias("key"), "value", order.alias("order"))
    first = lambda key: F.min_by("value", F.when(F.col("key") == key, F.col("order"))).alias(key)
    lists = stash(pairs.groupBy("opened").agg(*[first(k) for k in ("id", "label", "source", "target", "value")]).join(kinds, "opened"))
    return lists.withColumnRenamed("opened", "seq"), directed


def comments(spark: SparkSession, path: str) -> DataFrame:
    """SNK-4. The comment lines of a file: ``line_no, text``."""
    return numbered_lines(spark, path).where(is_comment(F.col("text")))


def _ordered(*blocks: DataFrame) -> DataFrame:
    """``block, a, b, line``: blocks of lines, one after the other, as a table to be ordered by its first three columns."""
    out = None
    for k, block in enumerate(blocks):
        named = block.select(F.lit(k).alias("block"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "line")
        out = named if out is None else out.unionByName(named)
    return out


def _line(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "a long, b long, line string")


def graph_lines(graph: Graph) -> DataFrame:
    """SNK-1. The edge list: vertex count, every cell with 1-based ids and its weight (6 decimals) unless it is 1, and an empty line."""
    cell = F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.when(F.col("weight") != 1, F.format_string("%.6f", F.col("weight").cast("double"))))
    rows = graph.cells.select(F.col("src").alias("a"), F.col("dst").alias("b"), cell.alias("line"))
    return _ordered(_line(graph.spark, str(graph.num_nodes)), rows, _line(graph.spark, ""))


def labels_lines(labels: DataFrame) -> DataFrame:
    """SNK-2. A heading and one line with all labels in the order of ids."""
    row = labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"].cast("string")), " ").alias("line"))
    return _ordered(_line(labels.sparkSession, "# Labels"), row.select(F.lit(0).alias("a"), F.lit(0).alias("b"), "line"))


def gml_lines(graph: Graph, attributes: dict[str, DataFrame] | None = None) -> DataFrame:
    """SNK-3. GML with one attribute line for each labelling; undirected edges stand once."""
    nodes = graph.nodes
    rows = [F.lit("    node ["), F.format_string("        id %d", "id")]
    for k, (name, labels) in enumerate((attributes or {}).items()):
        nodes = nodes.join(labels.select("id", F.col("label").alias(f"_{k}")), "id", "left")
        rows.append(F.concat(F.lit(f"        {name} "), F.col(f"_{k}").cast("string")))
    rows.append(F.lit("    ]"))
    spread = lambda table, lines: table.select("a", "b0", F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("k", "line"))
    vertices = spread(nodes.select("*", F.col("id").alias("a"), F.lit(0).alias("b0")), rows).select("a", F.col("k").alias("b"), "line")
    edge = [F.lit("    edge ["), F.format_string("        source %d", "src"), F.format_string("        target %d", "dst"), F.format_string("        value %.6f", F.col("weight").cast("double")), F.lit("    ]")]
    cells = graph.cells if graph.directed else graph.cells.where("dst >= src")
    links = spread(cells.select("*", F.col("src").alias("a"), F.col("dst").alias("b0")), edge).select("a", (F.col("b0") * 8 + F.col("k")).alias("b"), "line")
    head = ["graph [", *["    directed 1"] * graph.directed]
    return _ordered(_line(graph.spark, *head), vertices, links, _line(graph.spark, "]"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as a folder of parts, each a range of them; the parts one after the other are the file."""
    lines.orderBy("block", "a", "b").select("line").write.text(path)


def write_gml(graph: Graph, path: str, attributes: dict[str, DataFrame] | None = None, compression: str = "none") -> None:
    """SNK-3 as a folder of parts: the lines of :func:`gml_lines`. Lists are put in order before they become text, and none is cut in two."""
    nodes, names = graph.nodes, list(attributes or {})
    for k, name in enumerate(names):
        nodes = nodes.join(attributes[name].select("id", F.col("label").cast("string").alias(f"_{k}")), "id", "left")
    texts = F.array(*[F.concat(F.lit(f"\n        {name} "), F.col(f"_{k}")) for k, name in enumerate(names)]).cast("array<string>")
    none = F.lit(None).cast("string")
    vertices = nodes.select(F.lit(1).alias("block"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).cast("float").alias("weight"), F.array_join(texts, "").alias("text"))
    cells = graph.cells if graph.directed else graph.cells.where("dst >= src")
    links = cells.select(F.lit(2).alias("block"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight", none.alias("text"))
    ends = graph.spark.createDataFrame([(0, "\n".join(["graph [", *["    directed 1"] * graph.directed])), (3, "]")], "block int, text string")
    ends = ends.select("block", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).cast("float").alias("weight"), "text")
    ordered = vertices.unionByName(links).unionByName(ends).orderBy("block", "a", "b")
    w = F.col("weight").cast("double")
    # Positive whole numbers need no formatting.
    value = F.when((w > 0) & (w < 1e15) & (w == F.floor(w)), F.concat(F.floor(w).cast("string"), F.lit(".000000"))).otherwise(F.format_string("%.6f", w))
    vertex = F.concat(F.lit("    node [\n        id "), F.col("a").cast("string"), F.col("text"), F.lit("\n    ]"))
    edge = F.concat(F.lit("    edge [\n        source "), F.col("a").cast("string"), F.lit("\n        target "), F.col("b").cast("string"), F.lit("\n        value "), value, F.lit("\n    ]"))
    line = F.when(F.col("block") == 2, edge).when(F.col("block") == 1, vertex).otherwise(F.col("text"))
    ordered.select(line.alias("line")).write.option("compression", compression).text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """SNK-2 as a folder: heading, all labels but the last with a space behind each in parts by ranges of ids, and the last one with the line's end.

    The parts of ``block=0``, ``block=1`` and ``block=2`` one after the other are the file.
    """
    spark = labels.sparkSession
    last = labels.agg(F.max_by("label", "id").alias("label"), F.max("id").alias("id")).first()
    spark.createDataFrame([("# Labels",)], "line string").write.text(f"{path}/block=0")
    body = labels.where(F.col("id") < F.lit(last["id"])).orderBy("id").select(F.col("label").cast("string"))
    body.write.option("lineSep", " ").text(f"{path}/block=1")
    spark.createDataFrame([("" if last["label"] is None else str(last["label"]),)], "line string").write.text(f"{path}/block=2")


def collect_lines(lines: DataFrame) -> list[str]:
    """For output to a terminal."""
    return [r["line"] for r in lines.orderBy("block", "a", "b").select("line").toLocalIterator()]
