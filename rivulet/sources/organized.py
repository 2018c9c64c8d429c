"""Tables in folders by version: ROOT/COMMON_SERIALS/TABLE/VERSION/MINOR/DATE/BATCH/serial_ddddd[.gz].

The folders' names are columns MinorNumber (INTEGER), Date (DATE, from yyyymmdd) and BatchId
(INTEGER). A predicate over them picks folders before any file is read.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.functions import expressions as X
from rivulet.functions.types import Field, Type, Typed
from rivulet.operators.relation import Relation
from rivulet.plans.syntax import LanguageError
from rivulet.sources.files import read_text

FOLDERS = [Field("MinorNumber", Type("INTEGER")), Field("Date", Type("DATE")), Field("BatchId", Type("INTEGER"))]


def folders(spark: SparkSession, base: str, predicate: str | None) -> list[str]:
    """The folders of batches that the predicate takes. Their names are listed on the driver, and no file in them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/*/*/*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in (fs.globStatus(path) or [])]
    rows = [(x, *m.groups()) for x in found if (m := re.search(r"/(\d+)/(\d{8})/(\d+)$", x))]
    if not predicate:
        return sorted(r[0] for r in rows)
    table = spark.createDataFrame(rows, "path string, minor string, day string, batch string")
    scope = X.Scope({"input": {
        "MinorNumber": Typed(F.col("minor").cast("int"), FOLDERS[0].type),
        "Date": Typed(F.to_date("day", "yyyyMMdd"), FOLDERS[1].type),
        "BatchId": Typed(F.col("batch").cast("int"), FOLDERS[2].type),
    }})
    return sorted(r[0] for r in table.where(X.condition(predicate, scope)).select("path").collect())


def read_organized(spark: SparkSession, root: str, common: int, serials: int, table: str, version: int, fields: list[Field], predicate: str | None = None) -> Relation:
    """The rows of a table's batches that the predicate takes."""
    chosen = folders(spark, f"{root.rstrip('/')}/{common}_{serials}/{table}/{version}", predicate)
    if not chosen:
        raise LanguageError("no batch matches")
    return read_text(spark, [f"{x}/serial_*" for x in chosen], fields)  # type: ignore[arg-type]
