"""Operators by their name in scripts: parameters, numbers of inputs and outputs, and what each makes.

An operator takes (session, node, inputs, number of outputs) and gives a list of relations, one
for each output. register_operator() adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.functions import expressions as X
from rivulet.operators import aggregate, join, shape
from rivulet.operators.relation import Relation
from rivulet.plans.syntax import LanguageError, Operator
from rivulet.sources import files

ANY = 1 << 30
Run = Callable[[SparkSession, Operator, list[Relation], int], list[Relation]]


@dataclass(frozen=True)
class Kind:
    """inputs and outputs: least and most."""

    run: Run
    params: frozenset[str]
    inputs: tuple[int, int]
    outputs: tuple[int, int]


REGISTRY: dict[str, Kind] = {}


def register_operator(name: str, run: Run, params: tuple[str, ...] = (), inputs: tuple[int, int] = (1, 1), outputs: tuple[int, int] = (0, 1)) -> None:
    REGISTRY[name.lower()] = Kind(run, frozenset(p.lower() for p in params), inputs, outputs)


def kind_of(node: Operator) -> Kind:
    if node.kind.lower() not in REGISTRY:
        raise LanguageError(f"{node.name}: unknown operator {node.kind}")
    kind = REGISTRY[node.kind.lower()]
    for p, _ in node.params:
        if p.lower() not in kind.params:
            raise LanguageError(f"{node.name}: unknown argument {p}")
    return kind


def _names(node: Operator, key: str) -> list[str]:
    return [str(v).strip() for v in node.all(key)]


def _read(spark, node, inputs, n):
    mode = str(node.get("mode", default="binary")).lower()
    file = node.get("file")
    output = node.get("output")
    wanted = [x.strip() for x in output.split(",")] if output else None
    if mode == "text":
        fields = files.read_format(spark, node.get("format"), node.get("formatFile"))
        r = files.read_text(spark, file, fields, node.get("fieldSeparator", default="\t"), node.get("recordSeparator", default="\n"), node.get("comment"), node.flag("skipHeader"), wanted, node.flag("bucketed"))
    elif mode in ("binary", "parquet"):
        r = files.read_parquet(spark, file, wanted)
    else:
        raise LanguageError(f"{node.name}: unknown mode {mode}")
    return [files.broadcast(r) if node.flag("broadcast") else r]


def _write(spark, node, inputs, n):
    mode, over = str(node.get("mode", default="binary")).lower(), "overwrite" if node.flag("overwrite") else "errorifexists"
    path, directory = node.get("file"), None
    if node.get("connect"):
        path, directory = node.get("connect"), node.get("file")
    if mode == "text":
        files.write_text(inputs[0], path, node.flag("header"), node.get("headerFile"), node.get("formatFile"), node.flag("format"), directory, over)
    elif mode in ("binary", "parquet"):
        files.write_parquet(inputs[0], path, over, node.get("headerFile"), node.get("formatFile"), directory)
    else:
        raise LanguageError(f"{node.name}: unknown mode {mode}")
    return []


def _generate(spark, node, inputs, n):
    return [shape.generate(spark, node.get("output", "program"), int(node.get("numRecords", default=10)), int(node.get("partitions", default=1)))]


def _filter(spark, node, inputs, n):
    limit = node.get("limit")
    return [shape.filter_rows(inputs[0], node.get("where"), None if limit is None else int(limit))]


def _copy(spark, node, inputs, n):
    outputs = node.all("output")
    if len(outputs) != n:
        raise LanguageError(f"{node.name}: {len(outputs)} outputs for {n} arrows")
    return shape.copy(inputs[0], outputs)


def _print(spark, node, inputs, n):
    return [shape.printed(inputs[0], int(node.get("numToPrint", "limit", default=5)), int(node.get("printFrequency", default=1)), node.get("where"))]


def _dev_null(spark, node, inputs, n):
    shape.dev_null(inputs[0])
    return []


def _group(spark, node, inputs, n):
    keys = [*_names(node, "key"), *_names(node, "sortKey"), *_names(node, "hashKey")]
    output, first, update = node.get("output", "program"), node.get("initialize"), node.get("update")
    order = _names(node, "orderBy")
    if (first is None) != (update is None):
        raise LanguageError(f"{node.name}: initialize and update go together")
    each = node.flag("runningtotal")
    if each and node.kind.lower() != "sort_group_by":
        raise LanguageError(f"{node.name}: running totals are sort_group_by's")
    if first is not None:
        out = aggregate.fold(inputs[0], keys, first, update, each, order)
    elif each:
        out = aggregate.running(inputs[0], keys, output, order)
    else:
        out = aggregate.group_by(inputs[0], keys, output)
    return [out]


def _join(kind: str, strategy: str) -> Run:
    def run(spark, node, inputs, n):
        a, b = ("tableKey", "probeKey") if strategy == "hash" else ("leftKey", "rightKey")
        aliases = ("table", "probe") if strategy == "hash" else ("l", "r")
        return [join.join(inputs[0], inputs[1], kind, _names(node, a), _names(node, b), node.get("residual", "where"), node.get("output"), aliases, strategy)]

    return run


def _map(spark, node, inputs, n):
    raise LanguageError(f"{node.kind} is the input of a map/reduce job: run it with MapReduceJob")


def _emit(spark, node, inputs, n):
    """The rows with their key, and the partition they ask for, hidden."""
    r, key = inputs[0], node.get("key")
    field = r.field(key)
    columns = [F.col(f"`{x}`") for x in r.names]
    text = files.rendered(field, r.columns()[key]).alias("__key")
    partition = node.get("partition")
    where = X.integer(X.value(partition, r.scope())).column.cast("long") if partition else F.lit(None).cast("long")
    return [Relation(r.df.select(*columns, text, where.alias("__partition")), r.fields, (("__key", True),))]


def _load() -> None:
    none, one, two = (0, 0), (1, 1), (2, 2)
    register_operator("read", _read, ("file", "format", "formatFile", "mode", "fieldSeparator", "recordSeparator", "comment", "skipHeader", "output", "bucketed", "broadcast"), none)
    register_operator("write", _write, ("file", "mode", "connect", "header", "headerFile", "format", "formatFile", "overwrite"), one, none)
    register_operator("generate", _generate, ("output", "program", "numRecords", "partitions"), none)
    register_operator("filter", _filter, ("where", "limit"))
    register_operator("copy", _copy, ("output", "pic"), one, (0, ANY))
    register_operator("switch", lambda s, node, i, n: shape.switch(i[0], node.get("on"), n), ("on",), one, (1, ANY))
    register_operator("union_all", lambda s, node, i, n: [shape.union_all(i, node.flag("concatenate") or node.flag("concat"))], ("concatenate", "concat"), (1, ANY))
    register_operator("unpivot", lambda s, node, i, n: [shape.unpivot(i[0], node.get("columnPattern"), node.all("pivotColumn"), node.get("valueColumn"))], ("columnPattern", "pivotColumn", "valueColumn"))
    register_operator("sort", lambda s, node, i, n: [shape.sort(i[0], node.all("key"), node.all("presorted"))], ("key", "presorted", "memory", "tempDir"))
    register_operator("sort_merge", lambda s, node, i, n: [shape.sort_merge(i, node.all("key"))], ("key",), (1, ANY))
    for strategy, keys in (("hash", ("tableKey", "probeKey")), ("merge", ("leftKey", "rightKey"))):
        for kind in join.KINDS:
            name = f"{strategy}_join" if kind == "inner" else f"{strategy}_{kind}_join"
            register_operator(name, _join(kind, strategy), (*keys, "residual", "where", "output"), two)
    for name in ("hash_group_by", "sort_group_by", "group_by"):
        register_operator(name, _group, ("key", "sortKey", "hashKey", "output", "program", "initialize", "update", "runningtotal", "orderBy"))
    for name in ("map", "reduce"):
        register_operator(name, _map, ("format", "formatFile", "fieldSeparator"), none)
    register_operator("emit", _emit, ("key", "partition"), one, none)
    register_operator("print", _print, ("numToPrint", "limit", "printFrequency", "where"))
    register_operator("devNull", _dev_null, (), one, none)


_load()
