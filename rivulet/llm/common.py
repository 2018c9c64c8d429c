"""Helpers that every training-data operator shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import remove, shared_path, ship

#: The ASCII white space that parts words: space, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut from its lineage: written as Parquet into the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() stored for these, which nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)  # type: ignore[attr-defined]


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column (in any case of letters) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> Iterator[None]:
    """Plans made inside hand at most so many rows and bytes to Python at once; the session's own settings come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row: Catalyst would otherwise inline it at each use, inside lambdas at each element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def id_cuts(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending doc_ids that part the rows into about equal numbers. Only ids are read."""
    if n < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return [*dict.fromkeys(cuts or [])]


def places(cuts: np.ndarray, ids: pa.Array, null_first: bool = True) -> np.ndarray:
    """How many of the ascending cuts are below each id: 0 to len(cuts), in the order of ids."""
    below = np.searchsorted(cuts, np.asarray(ids.fill_null(0)), side="left").astype(np.int32)
    below[np.asarray(ids.is_null())] = 0 if null_first else len(cuts)
    return below
