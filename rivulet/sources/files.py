"""Text and Parquet files.

A text line is a record; NULL is `\\N`, recognised in nullable fields alone, and an empty field is
an empty text. A line with another number of fields than the format, or a field that is not of
its type, ends the query with an error: rows are never dropped in silence. Compression follows
the files' names. Files are split and read by Spark, from any file system that it knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import expressions as X
from rivulet.functions.scalars import as_text
from rivulet.functions.types import Field, Type, Typed, parse_format, print_format
from rivulet.operators.join import BROADCAST_BYTES, estimated_bytes
from rivulet.operators.relation import ORDER, Relation, of_dataframe
from rivulet.plans.syntax import LanguageError

NULL = "\\N"
SEPARATORS = {"\\t": "\t", "\\n": "\n"}
#: Never in a line of text, so that the csv writer, which knows headers, leaves lines whole.
NO_SEPARATOR = "\x01"


def read_format(spark: SparkSession, inline: str | None, path: str | None) -> list[Field]:
    if inline is None and path is None:
        raise LanguageError("format or formatFile is needed")
    if inline is None:
        inline = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # type: ignore[arg-type]
    return parse_format(inline)


def parsed_field(text: Column, f: Field) -> Column:
    kind = f.type.name
    value = F.when(text == NULL, None).otherwise(text) if f.type.nullable else text
    if kind in ("VARCHAR", "CHAR"):
        return value
    if kind == "DATETIME":
        return value.cast("timestamp_ntz")
    return value.cast(f.type.spark)


def parsed(lines: DataFrame, fields: list[Field], separator: str, wanted: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a column `value` of lines; only wanted ones are converted."""
    parts = F.split("value", re.escape(separator), -1)
    n = len(fields)
    message = F.concat(F.lit("invalid input record: "), F.col("value"))
    checked = lines.select(F.when(F.size(parts) == n, parts).otherwise(F.raise_error(message).cast("array<string>")).alias("__parts"), *keep)
    chosen = [(i, f) for i, f in enumerate(fields) if wanted is None or f.name in wanted]
    if wanted is not None:
        chosen.sort(key=lambda x: wanted.index(x[1].name))
    return checked.select(*[parsed_field(F.col("__parts")[i], f).alias(f.name) for i, f in chosen], *keep)


def without_first_lines(lines: DataFrame) -> DataFrame:
    """Lines, as they are read, without the first one of each file: the first row of a split that starts at byte 0. Blank lines are lines.

    Rows are streamed in the order of reading; Spark's csv reader knows headers too, but loses blank lines.
    """
    kept = [c for c in lines.columns if c not in ("__file", "__from")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            file, start = (batch.column(at(c)).to_numpy() for c in ("__file", "__from"))
            new = np.ones(len(file), bool)
            new[1:] = (file[1:] != file[:-1]) | (start[1:] != start[:-1])
            new[0] = before != (file[0], start[0])
            before = (file[-1], start[-1])
            yield batch.select(kept).filter(pa.array(~(new & (start == 0))))

    return lines.mapInArrow(run, lines.select(*kept).schema)


def read_text(spark: SparkSession, file: str, fields: list[Field], field_separator: str = "\t", record_separator: str = "\n", comment: str | None = None, skip_header: bool = False, output: list[str] | None = None, bucketed: bool = False) -> Relation:
    field_separator, record_separator = (SEPARATORS.get(s, s) for s in (field_separator, record_separator))
    if bucketed:
        file = file.rstrip("/") + "/serial_*"
    lines = spark.read.text(file, lineSep=record_separator)
    extra = [F.regexp_extract(F.input_file_name(), r"serial_(\d+)", 1).cast("int").alias("__bucket")] if bucketed else []
    split = [F.xxhash64(F.input_file_name()).alias("__file"), F.input_file_block_start().alias("__from")] if skip_header else []
    lines = lines.select("value", F.monotonically_increasing_id().alias(ORDER), *extra, *split)
    if skip_header:
        lines = without_first_lines(lines)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    if output is not None:
        unknown = [n for n in output if n not in {f.name for f in fields}]
        if unknown:
            raise LanguageError(f"unknown fields {unknown} in output")
    df = parsed(lines, fields, field_separator, output, (ORDER,))
    by_name = {f.name: f for f in fields}
    return Relation(df, [by_name[n] for n in output] if output is not None else fields, ((ORDER, True),))


def read_parquet(spark: SparkSession, file: str, output: list[str] | None = None) -> Relation:
    df = spark.read.parquet(file)
    return of_dataframe(df.select(*output) if output is not None else df)


def broadcast(r: Relation) -> Relation:
    """A hint, where Spark's estimate of the relation is within the bound; beyond it, joins shuffle."""
    return Relation(F.broadcast(r.df), r.fields, r.order) if estimated_bytes(r) <= BROADCAST_BYTES else r


def rendered(f: Field, column: Column) -> Column:
    if f.type.name == "DOUBLE":
        text = F.format_string("%.9f", column)
        text = F.when(column.isNotNull(), text)
    elif f.type.name == "ARRAY":
        text = column.cast("string")
    else:
        text = as_text(Typed(column, f.type))
    return F.coalesce(text, F.lit(NULL))


def line(r: Relation) -> Column:
    columns = r.columns()
    parts = [rendered(f, columns[f.name]) for f in r.fields]
    return F.concat(*reduce(lambda a, b: [*a, F.lit("\t"), b], parts[1:], [parts[0]])) if parts else F.lit("")


def write_sides(r: Relation, header_file: str | None, format_file: str | None, mode: str) -> None:
    """The names and the format of a relation's fields, in files of their own."""
    for target, text in ((header_file, "\t".join(r.names)), (format_file, print_format(r.fields))):
        if target:
            r.df.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode(mode).text(target)


def folders(r: Relation, directory: str | None) -> list[tuple[str, Column]]:
    """The column, if any, that tells the folder of each row: `dir`, with underscores added while a field has that name."""
    if directory is None:
        return []
    name = "dir"
    while name in {n.lower() for n in r.names}:
        name += "_"
    return [(name, X.value(directory, r.scope()).column.cast("string").alias(name))]


def write_text(r: Relation, path: str, header: bool = False, header_file: str | None = None, format_file: str | None = None, format_line: bool = False, directory: str | None = None, mode: str = "errorifexists") -> None:
    """Tab-separated lines, in the relation's order, under the folder `path`; `.gz` paths are compressed.

    header: the first line of each part file, written for empty outputs too. directory: an
    expression that tells the folder of each row.
    """
    write_sides(r, header_file, format_file, mode)
    gzip = {"compression": "gzip"} if path.endswith(".gz") or ".gz/" in path else {}
    names, extra = "\t".join(r.names), folders(r, directory)
    first = print_format(r.fields) if format_line else names
    df = r.df.select(line(r).alias(first if header or format_line else "value"), *[c for _, c in extra])
    out = df.write.mode(mode).options(**gzip).partitionBy(*[n for n, _ in extra])
    if header or format_line:
        plain = {"header": True, "sep": NO_SEPARATOR, "quote": "", "escapeQuotes": False, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.options(**plain).csv(path)
    else:
        out.text(path)


def write_parquet(r: Relation, path: str, mode: str = "errorifexists", header_file: str | None = None, format_file: str | None = None, directory: str | None = None) -> None:
    """Parquet under the folder `path`; a file has its names and types, so headers and formats go to files of their own alone."""
    write_sides(r, header_file, format_file, mode)
    extra = folders(r, directory)
    r.df.select(*[F.col(f"`{n}`") for n in r.names], *[c for _, c in extra]).write.mode(mode).partitionBy(*[n for n, _ in extra]).parquet(path)


def constant(spark: SparkSession, rows: list[tuple], fields: list[Field]) -> Relation:
    """Literal rows, in order."""
    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(f.name, f.type.spark, True) for f in fields], T.StructField(ORDER, T.LongType(), False)])
    return Relation(spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], schema), fields, ((ORDER, True),))


__all__ = ["Type", "broadcast", "constant", "parsed", "read_format", "read_parquet", "read_text", "write_parquet", "write_text"]
