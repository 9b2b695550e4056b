"""Text formats, programs and the registered queries' shape."""

import gzip
import random
from pathlib import Path

import pytest
from helpers import cells, directed, labels, undirected, vector

from graphloom import cli
from graphloom.runtime import shared_root
from graphloom.sources import text

FILE = """; a comment
# label(1)="x"

4
1 2
2 1 2.5
2 3 abc
  3 4 0
"""


@pytest.fixture
def graph_file(tmp_path):
    path = tmp_path / "sample.graph"
    path.write_text(FILE)
    return str(path)


def test_load(spark, graph_file, tmp_path):
    g = text.load_graph(spark, graph_file)
    assert g.num_nodes == 4 and cells(g) == {(0, 1): 2.5, (1, 0): 2.5, (1, 2): 1, (2, 1): 1, (2, 3): 0, (3, 2): 0}
    assert cells(text.load_graph(spark, graph_file, directed=True)) == {(0, 1): 1, (1, 0): 2.5, (1, 2): 1, (2, 3): 0}
    for bad in ("", "# only\n", "3\n1\n", "3\n1 4\n", "3\n0 1\n", "x\n1 2\n"):
        (tmp_path / "bad.graph").write_text(bad)
        with pytest.raises(ValueError):
            text.load_graph(spark, str(tmp_path / "bad.graph"))
    with pytest.raises(FileNotFoundError):
        text.load_graph(spark, str(tmp_path / "none.graph"))


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("# Labels\n3 1 \n\n2\n")
    assert vector(text.load_labels(spark, str(path), 3)) == [3, 1, 2]
    for n, content in ((2, "1 2 3"), (4, "1 2 3"), (2, "1 -2"), (2, "1 x")):
        path.write_text(content)
        with pytest.raises(ValueError):
            text.load_labels(spark, str(path), n)


def test_round_trips(spark, graph_file, tmp_path):
    g = text.load_graph(spark, graph_file)
    lines = text.collect_lines(text.graph_lines(g))
    assert lines == ["4", "1 2 2.500000", "2 1 2.500000", "2 3", "3 2", "3 4 0.000000", "4 3 0.000000", ""]
    text.write_lines(text.graph_lines(g), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*"))
    assert cells(text.load_graph(spark, str(part))) == cells(g)
    gml = text.collect_lines(text.gml_lines(g, {"side": labels(spark, [0, 1, 0, 1])}))
    assert gml[:5] == ["graph [", "    node [", "        id 0", "        side 0", "    ]"] and gml[-1] == "]" and "directed 1" not in " ".join(gml)
    (tmp_path / "g.gml").write_text("\n".join(gml))
    again, names = text.load_gml(spark, str(tmp_path / "g.gml"))
    assert cells(again) == cells(g) and again.num_nodes == 4 and names.count() == 4
    (tmp_path / "h.gml").write_text('graph [\n directed 1\n node [ id 7 label "a b" ]\n node [ id 3 label "c" ]\n edge [ source 7 target 3 value 2 ]\n]')
    other, names = text.load_gml(spark, str(tmp_path / "h.gml"))
    assert other.directed and cells(other) == {(1, 0): 2} and {tuple(r) for r in names.collect()} == {(0, "c"), (1, "a b")}
    assert text.collect_lines(text.labels_lines(labels(spark, [2, 0, 1]))) == ["# Labels", "2 0 1"]


def test_programs(spark, tmp_path, capsys):
    g = undirected(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
    path, clusters = tmp_path / "g.graph", tmp_path / "c.txt"
    path.write_text("# kept\n" + "\n".join(text.collect_lines(text.graph_lines(g))))
    clusters.write_text("0 0 0 1 1 1\n")

    def run(*a):
        code = cli.main([*a, str(path)], spark)
        got = capsys.readouterr()
        return code, got.out.strip().split("\n"), got.err

    code, out, _ = run("maxmodularity", "--fast", "--strict", "--verbose")
    found = out[1].split()
    assert code == 0 and out[0] == "# Labels" and found[0] == found[1] == found[2] != found[3] == found[4] == found[5]
    assert len(set(run("minmodularity", "--clusters=3")[1][1].split())) == 3
    assert run("components")[1][1] == "0 0 0 0 0 0" and "Components: 1" in run("components")[2]
    assert run("laprop", "--invert")[0] == 0
    report = dict(x.split(": ") for x in run("metrics", f"--clusters={clusters}", f"--groundtruth={clusters}")[1])
    assert report["#nodes"] == "6.000000" and report["precision"] == "1.000000" and list(report)[:4] == ["#nodes", "#edges", "#diagonal", "#communities"]
    assert "density" in report and "norm-mutual-info" in report
    assert run("subgraph", f"--clusters={clusters}")[1] == ["# kept", "6", "3 4", "4 3"]
    gml = run("gml", f"--one={clusters}", f"--two={clusters}")[1]
    assert gml[3:5] == ["        two 0", "        one 0"]
    assert cli.main(["components", str(tmp_path / "none")], spark) == 1


@pytest.fixture
def in_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(old, ("700", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.rglob("part-*"), key=lambda p: (str(p.parent), p.name)))


def test_files_of_many_splits(spark, tmp_path, in_splits):
    """Numbers of lines, the header and the last of repeated edges hold over splits; parts one after the other are the file."""
    rng = random.Random(2)
    rows = [(rng.randrange(200), rng.randrange(200), rng.randint(1, 9)) for _ in range(2000)]
    path = tmp_path / "g.graph"
    path.write_text("# first\n;second\n\n200\n" + "".join(f"{'# c' if rng.random() < 0.02 else ''}\n{i + 1} {j + 1} {w}" for i, j, w in rows) + "\n")
    assert text.placed(spark, str(path)).rdd.getNumPartitions() > 10
    assert [r["text"] for r in text.numbered_lines(spark, str(path)).orderBy("line_no").collect()] == path.read_text().split("\n")[:-1]
    want = {(i, j): float(w) for i, j, w in rows}
    g = text.load_graph(spark, str(path), directed=True)
    assert cells(g) == want
    text.write_lines(text.graph_lines(g), str(tmp_path / "out"))
    assert joined(tmp_path / "out").decode() == "\n".join(["200", *(f"{i + 1} {j + 1}" + (f" {w:f}" if w != 1 else "") for (i, j), w in sorted(want.items()))]) + "\n\n"
    assert cells(text.load_graph(spark, str(tmp_path / "out"), directed=True)) == want


def test_labels_in_one_long_line(spark, tmp_path, in_splits):
    rng = random.Random(3)
    own = [rng.randrange(50) for _ in range(1000)]
    line = "# Labels\n" + " ".join(map(str, own)) + "\n"
    text.write_labels(labels(spark, own), str(tmp_path / "out"))
    (tmp_path / "one").write_text(line)
    assert joined(tmp_path / "out").decode() == line
    for path in ("out", "one"):
        assert vector(text.load_labels(spark, str(tmp_path / path), 1000)) == own
    (tmp_path / "odd").write_text("# 1 2 3 4 5 6 7" * 200 + " x\n1 2\n;3 4\n 5\t6 \n# " + "9 " * 900 + "\n7 8")
    assert vector(text.load_labels(spark, str(tmp_path / "odd"), 6)) == [1, 2, 5, 6, 7, 8]
    text.write_labels(labels(spark, [7]), str(tmp_path / "single"))
    assert joined(tmp_path / "single") == b"# Labels\n7\n"


def test_nested_gml(spark, tmp_path, in_splits):
    node = lambda k: f' node [ id {7 * k + 3} graphics [ x 1.5 label "no" deep [ id 5 ] ] label "a ] \'{k}\' [" ]\n' if k % 2 else f" node\n [\n id {7 * k + 3}\n label \"n{k}\"\n ]\n"
    edge = lambda k: f' edge [ source {7 * k + 3} target {7 * ((k * k + 1) % 60) + 3} data [ value 99 ] value {k / 2} label "two\nlines [ ]" ]\n'
    (tmp_path / "g.gml").write_text('Creator "x [ y"\n# comment [ "\ngraph [\n directed 1\n comment "a ] b"\n' + "".join(map(node, range(60))) + "".join(map(edge, range(60))) + "]\n")
    g, names = text.load_gml(spark, str(tmp_path / "g.gml"))
    assert g.directed and cells(g) == {(k, (k * k + 1) % 60): k / 2 for k in range(60)}
    assert {tuple(r) for r in names.collect()} == {(k, f"a ] '{k}' [" if k % 2 else f"n{k}") for k in range(60)}


def gml_file(folder):
    return b"".join(gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes() for p in sorted(folder.glob("part-*")))


@pytest.mark.parametrize("make", [undirected, directed])
def test_gml_of_plain_lists(spark, tmp_path, make):
    """Parts of GML, compressed or not, are the file of the lines; reading one writes a part of what the text takes, not a row for each word."""
    pairs = {(i * i % 300, (7 * i + k) % 300): (i + k) / 2 - 3 for i in range(300) for k in range(8)}
    g = make(spark, 300, [(a, b, w) for (a, b), w in pairs.items()]).checkpointed()
    sides = {"side": labels(spark, [i % 3 for i in range(300)])}
    lines = "\n".join(text.collect_lines(text.gml_lines(g, sides))) + "\n"
    stashed = lambda: sum(p.stat().st_size for p in Path(shared_root(spark).removeprefix("file://")).rglob("*.parquet"))
    for kind in ("none", "gzip"):
        text.write_gml(g, str(tmp_path / kind), sides, kind)
        assert gml_file(tmp_path / kind).decode() == lines
        before = stashed()
        again, names = text.load_gml(spark, str(tmp_path / kind))
        assert again.directed == g.directed and again.num_nodes == names.count() == 300 and cells(again) == cells(g)
        assert stashed() - before < len(lines)


def test_gml_that_only_looks_plain(spark, tmp_path):
    """What isn't plain goes by the depth of brackets, with the same result as if all did."""
    node = lambda k: f" node [ id {k} ]\n"
    edge = "    edge [\n        source {}\n        target {}\n        value {}\n    ]\n".format
    nodes, edges = "".join(map(node, range(5))), "".join(edge(k, (k + 1) % 5, k + 2) for k in range(5))
    files = {
        "plain": f"Creator \"a\"\ngraph [ directed 1\n{nodes}{edges}]\n",
        "no line feed": f"graph [ directed 1\n{nodes}{edges}]",
        "in a string": f"graph [ directed 1 label \"\n{edge(3, 3, 9)}\"\n{nodes}{edges}]\n",
        "comments": f"graph [ directed 1\n{nodes}# ]\n#{edge(3, 3, 9).splitlines()[0]}\n{edges}]\n",
        "behind the graph": f"graph [ directed 1\n{nodes}{edges}]\n{edge(3, 3, 9)}",
        "before the graph": f"{edge(3, 3, 9)}graph [ directed 1\n{nodes}{edges}]\n",
        "other lists": f"graph [ directed 1\n{nodes}{edges} data [ source 3 target 3 ]\n]\n",
        "further keys": f"graph [ directed 1\n{nodes}{edges.replace('source', 'label \"source 4 target 4\" source')}]\n",
        "repeated keys": f"graph [ directed 1\n{nodes}{edges.replace('    ]', ' value 77 ]')}]\n",
        "repeated edges": f"graph [ directed 1\n{nodes}{edges.replace('value', 'value 5 x')}{edges}]\n",
    }
    for name, content in files.items():
        (tmp_path / "one.gml").write_text(content)
        g, names = text.load_gml(spark, str(tmp_path / "one.gml"))
        want, _ = text._nested_lists(spark, str(tmp_path / "one.gml"))
        assert g.directed and names.count() == 5, name
        assert cells(g) == {(k, (k + 1) % 5): k + 2 for k in range(5)}, name
        assert want.where("kind = 'edge'").count() >= 5, name
    # Ids that aren't 0 .. n-1, links to vertices that aren't there, and an undirected edge whose last weight stands the other way round.
    (tmp_path / "two.gml").write_text("graph [\n" + "".join(map(node, (9, 4, 7))) + edge(9, 4, 1) + edge(4, 9, 2) + edge(7, 7, 3) + edge(7, 8, 4) + "]\n")
    g, names = text.load_gml(spark, str(tmp_path / "two.gml"))
    assert cells(g) == {(0, 2): 2, (2, 0): 2, (1, 1): 3} and names.count() == 3
