"""Runs scripts: python -m rivulet --file SCRIPT, or --map SCRIPT [--reduce SCRIPT] for two stages; - is standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rivulet.plans.graph import Graph, MapReduceJob
from rivulet.sources.files import write_text


def text_of(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path) as f:
        return f.read()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="rivulet", description=__doc__)
    p.add_argument("--file", help="a graph to run")
    p.add_argument("--compile", action="store_true", help="print the checked graph instead of running it")
    p.add_argument("--plan", help="a graph that --compile printed")
    p.add_argument("--map", help="the first graph of a two-stage job")
    p.add_argument("--reduce", help="its second graph")
    p.add_argument("--numreduces", type=int, default=8)
    p.add_argument("--input", help="files of lines for the map operator")
    p.add_argument("--output", help="folder for the text of the job's open output")
    a = p.parse_args(args)
    if sum(x is not None for x in (a.file, a.plan, a.map)) != 1:
        p.error("one of --file, --plan and --map is needed")
    graph = Graph.parse(text_of(a.file)) if a.file else Graph.from_json(text_of(a.plan)) if a.plan else None
    if graph and a.compile:
        print(graph.to_json())
        return 0
    spark = spark or SparkSession.builder.appName("rivulet").getOrCreate()
    if graph:
        ends = graph.run(spark)
    else:
        lines = spark.read.text(a.input) if a.input else None
        ends = MapReduceJob(text_of(a.map), text_of(a.reduce) if a.reduce else None, a.numreduces).run(spark, lines)
    for name, r in ends.items():
        if a.output:
            write_text(r, a.output if len(ends) == 1 else f"{a.output}/{name}")
        else:
            r.visible().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
