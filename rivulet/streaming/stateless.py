"""Graphs over streams: filter, copy, switch, union_all and joins with a static table work on streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from rivulet.operators.relation import of_dataframe
from rivulet.plans.graph import Graph
from rivulet.plans.syntax import LanguageError

STATELESS = frozenset(("read", "filter", "copy", "switch", "union_all", "unpivot", "hash_join", "hash_right_semi_join", "hash_right_outer_join"))


def stream(script: str, sources: dict[str, DataFrame]) -> DataStreamWriter:
    """A writer of the script's one open output; `sources` replace the operators of their names."""
    graph = Graph.parse(script)
    if stateful := sorted({n.kind for n in graph.nodes.values() if n.kind.lower() not in STATELESS}):
        raise LanguageError(f"{stateful} need all rows and don't run on streams")
    session = next(iter(sources.values())).sparkSession
    ends = graph.run(session, {k: of_dataframe(v) for k, v in sources.items()})
    if len(ends) != 1:
        raise LanguageError(f"the script has {len(ends)} open outputs")
    return next(iter(ends.values())).visible().writeStream
