"""Graphs: parse, check, and run as Spark plans; and jobs of two graphs, map and reduce."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.registry import kind_of
from rivulet.operators.relation import ORDER, Relation
from rivulet.plans.syntax import LanguageError, Operator, parse_graph
from rivulet.sources import files


@dataclass
class Graph:
    nodes: dict[str, Operator]
    edges: list[tuple[str, str]]
    order: list[str]

    @classmethod
    def parse(cls, script: str) -> Graph:
        """The checked graph of a script: known operators and arguments, numbers of arrows, no cycle."""
        nodes, edges = parse_graph(script)
        into, out = defaultdict(list), defaultdict(list)
        for a, b in edges:
            into[b].append(a)
            out[a].append(b)
        for name, node in nodes.items():
            kind = kind_of(node)
            for what, n, (low, high) in (("inputs", len(into[name]), kind.inputs), ("outputs", len(out[name]), kind.outputs)):
                if not low <= n <= high:
                    raise LanguageError(f"{name}: {node.kind} has {n} {what}")
        order: list[str] = []
        waiting = {n: len(into[n]) for n in nodes}
        ready = [n for n in nodes if not waiting[n]]
        while ready:
            name = ready.pop(0)
            order.append(name)
            for b in out[name]:
                waiting[b] -= 1
                if not waiting[b]:
                    ready.append(b)
        if len(order) < len(nodes):
            raise LanguageError("the graph has a cycle")
        return cls(nodes, edges, order)

    def to_json(self) -> str:
        """The checked graph as text, which from_json() reads."""
        return json.dumps({"nodes": [[o.name, o.kind, o.params] for o in self.nodes.values()], "edges": self.edges, "order": self.order})

    @classmethod
    def from_json(cls, text: str) -> Graph:
        x = json.loads(text)
        nodes = {n: Operator(n, k, [(a, b) for a, b in p]) for n, k, p in x["nodes"]}
        return cls(nodes, [(a, b) for a, b in x["edges"]], x["order"])

    def run(self, spark: SparkSession, given: dict[str, Relation] | None = None) -> dict[str, Relation]:
        """The relation at the end of every open output, by operator. Sinks (write, devNull) run at once.

        given: what operators of those names make, instead of what they say.
        """
        given, made, ends = given or {}, {}, {}
        port = [sum(a == x for x, _ in self.edges[:i]) for i, (a, _) in enumerate(self.edges)]  # which output of its origin an arrow takes
        for name in self.order:
            inputs = [made[a][min(port[i], len(made[a]) - 1)] for i, (a, b) in enumerate(self.edges) if b == name]
            arrows = sum(a == name for a, _ in self.edges)
            node = self.nodes[name]
            if name in given:
                made[name] = [given[name]]
            else:
                count = arrows or (len(node.all("output")) if node.kind.lower() == "copy" else 1)
                made[name] = kind_of(node).run(spark, node, inputs, count)
            if not arrows and made[name]:
                ends[name] = made[name][0]
        return ends


def run(spark: SparkSession, script: str) -> DataFrame:
    """The one open output of a script, as a DataFrame."""
    ends = Graph.parse(script).run(spark)
    if len(ends) != 1:
        raise LanguageError(f"the script has {len(ends)} open outputs")
    return next(iter(ends.values())).visible()


def explain(spark: SparkSession, script: str, show: Callable[[str], None] = print) -> None:
    for name, r in Graph.parse(script).run(spark).items():
        show(f"-- {name}\n{r.visible()._jdf.queryExecution().toString()}")


class MapReduceJob:
    """Two graphs with a shuffle between: the map graph ends in `emit`, the reduce graph begins with `reduce`.

    Rows are dealt out by the key's text, or by the emitted partition, over `reducers` partitions and
    sorted there by the key's text. `map`, if there is one, parses lines of text. The reduce graph
    sees all keys' rows, so that it groups by the key itself.
    """

    def __init__(self, map_script: str, reduce_script: str | None = None, reducers: int = 8):
        self.map, self.reduce, self.reducers = Graph.parse(map_script), Graph.parse(reduce_script) if reduce_script else None, reducers

    @staticmethod
    def _only(graph: Graph, kind: str) -> str | None:
        found = [n for n, o in graph.nodes.items() if o.kind.lower() == kind]
        if len(found) > 1:
            raise LanguageError(f"a job has one {kind}")
        return found[0] if found else None

    def emitted(self, spark: SparkSession, lines: DataFrame | None = None) -> Relation | None:
        """What the map graph emits, shuffled and sorted; None if it has no emit."""
        given = {}
        if name := self._only(self.map, "map"):
            if lines is None:
                raise LanguageError("the map graph needs input lines")
            node = self.map.nodes[name]
            fields = files.read_format(spark, node.get("format"), node.get("formatFile"))
            numbered = lines.select("value", F.monotonically_increasing_id().alias(ORDER))
            df = files.parsed(numbered, fields, files.SEPARATORS.get(s := node.get("fieldSeparator", default="\t"), s), None, (ORDER,))
            given[name] = Relation(df, fields, ((ORDER, True),))
        ends = self.map.run(spark, given)
        name = self._only(self.map, "emit")
        if not name:
            return None
        r = ends[name]
        chosen = self.map.nodes[name].get("partition") is not None
        unsigned = F.pmod(F.pmod(F.col("__partition"), F.lit(1 << 32)), F.lit(self.reducers)).cast("int")
        placed = r.df.repartitionById(self.reducers, unsigned) if chosen else r.df.repartition(self.reducers, F.col("__key"))
        return Relation(placed.sortWithinPartitions("__key"), r.fields, r.order)

    def run(self, spark: SparkSession, lines: DataFrame | None = None) -> dict[str, Relation]:
        shuffled = self.emitted(spark, lines)
        if self.reduce is None:
            return {"emit": shuffled} if shuffled else {}
        name = self._only(self.reduce, "reduce")
        if not name or shuffled is None:
            raise LanguageError("a job with a reduce graph needs emit and reduce")
        node = self.reduce.nodes[name]
        if node.get("format") or node.get("formatFile"):
            fields = files.read_format(spark, node.get("format"), node.get("formatFile"))
            if len(fields) != len(shuffled.fields):
                raise LanguageError("reduce's format differs from what is emitted")
            columns = [files.parsed_field(files.rendered(f, F.col(f"`{f.name}`")), g).alias(g.name) for f, g in zip(shuffled.fields, fields, strict=True)]
            shuffled = Relation(shuffled.df.select(*columns, "__key", "__partition"), fields, shuffled.order)
        return self.reduce.run(spark, {name: shuffled})
