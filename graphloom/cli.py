"""Command-line programs: ``python -m graphloom.cli PROGRAM [options] GRAPH``.

All read an edge list, then with --unweighted set weights to 1 and with --invert take the complement, in this order.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .model import Graph
from .operators.labels import count_labels
from .sources import text

GREEDY = {"maxmodularity": {}, "minmodularity": {"minimize": True}, "antimodularity": {"antimodularity": True}}


def prepared(spark: SparkSession, options: argparse.Namespace) -> Graph:
    graph = text.load_graph(spark, options.graph, options.directed)
    if options.unweighted:
        graph = graph.clamp(1.0, 1.0)
    if options.invert:
        # Reports and components need no cell of the complement.
        sparse = graph.complement(1.0, True).checkpointed()
        return sparse if options.program in ("metrics", "components") else sparse.materialized().checkpointed()
    return graph.checkpointed()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    programs = top.add_subparsers(dest="program", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    for name in ("directed", "unweighted", "invert"):
        shared.add_argument(f"--{name}", action="store_true")
    shared.add_argument("graph")
    for name in GREEDY:
        p = programs.add_parser(name, parents=[shared])
        p.add_argument("--clusters", type=int)
        for flag in ("fast", "verbose", "strict"):
            p.add_argument(f"--{flag}", action="store_true")
    for name in ("laprop", "components"):
        programs.add_parser(name, parents=[shared])
    p = programs.add_parser("metrics", parents=[shared])
    p.add_argument("--clusters", required=True)
    p.add_argument("--groundtruth")
    p = programs.add_parser("subgraph", parents=[shared])
    p.add_argument("--clusters", required=True)
    programs.add_parser("gml", parents=[shared], epilog="--NAME=FILE adds an attribute, any number of times")
    return top


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    options, rest = parser().parse_known_args(arguments)
    attributes = dict(x[2:].split("=", 1) for x in rest if x.startswith("--") and "=" in x)
    if options.program != "gml" and attributes or any(x.startswith("--") and "=" not in x for x in rest):
        parser().error(f"unknown options: {' '.join(rest)}")
    if ignored := [x for x in rest if not x.startswith("--")]:
        print(f"ignored: {' '.join(ignored)}", file=sys.stderr)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        graph = prepared(spark, options)
        labels = lambda path: text.load_labels(spark, path, graph.num_nodes)
        if options.program in GREEDY:
            if options.verbose:
                for m in graph.merges(fast=options.fast, **GREEDY[options.program]).orderBy("order").toLocalIterator():
                    print(f"Merging community {m['index0']} and {m['index1']} (delta_mod = {m['delta']:f})", file=sys.stderr)
            try:
                found = graph.newman(fast=options.fast, num_clusters=options.clusters, strict=options.strict, **GREEDY[options.program])
            except ValueError:
                return 0  # no labelling has so many groups: nothing is printed
            lines = text.labels_lines(found)
        elif options.program == "laprop":
            found = graph.laprop()
            print(f"Modularity: {graph.modularity(found):f}", file=sys.stderr)
            lines = text.labels_lines(found)
        elif options.program == "components":
            found = graph.connected_components()
            print(f"Components: {count_labels(found)}", file=sys.stderr)
            lines = text.labels_lines(found)
        elif options.program == "metrics":
            from .operators.report import metric_report

            report = metric_report(graph, labels(options.clusters), labels(options.groundtruth) if options.groundtruth else None)
            for r in report.orderBy("place").collect():  # at most sixteen rows
                print(f"{r['metric']}: {r['value']:f}")
            return 0
        elif options.program == "subgraph":
            for r in text.comments(spark, options.graph).orderBy("line_no").toLocalIterator():
                print(r["text"])
            lines = text.graph_lines(graph.filter_labels(labels(options.clusters)))
        else:
            # Attributes come out last named first.
            lines = text.gml_lines(graph, {k: labels(v) for k, v in reversed(attributes.items())})
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    for line in text.collect_lines(lines):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
