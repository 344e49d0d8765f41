"""Loading the two input tables and writing results.

Sources are Spark's own readers (Parquet by default; CSV and JSON by file
extension or ``fmt``). Spreadsheets have no Spark reader: convert them to
Parquet or CSV once, outside the query path. Column headers are stripped of
surrounding blanks on load.

Sinks: JSON records (one object per row, as a column or as files), and the
multi-table report written as one Parquet directory per table, or published as a
whole behind a manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import strip_headers

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}
SPREADSHEET = {".xlsx", ".xls", ".xlsm"}


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in SPREADSHEET:
        raise ValueError(f"{path}: spreadsheets have no Spark reader; save the sheet as "
                         "Parquet or CSV first")
    return READERS.get(ext, "parquet")


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: StructType | str | None = None, **options) -> DataFrame:
    """Read one table and strip blanks around its column names.

    CSV defaults: header row, ``inferSchema`` only when no ``schema`` is
    given (inference costs an extra pass; give a schema for large inputs).
    """
    kind = _format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        options.setdefault("header", "true")
        if schema is None:
            options.setdefault("inferSchema", "true")
    df = reader.options(**options).format(kind).load(path)
    return strip_headers(df)


def load_data(spark: SparkSession, bookings_path: str, revenue_path: str,
              fmt: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The (bookings, revenue) pair, headers stripped."""
    return (load_table(spark, bookings_path, fmt, **options),
            load_table(spark, revenue_path, fmt, **options))


def records_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row (the records form), computed per task. Null
    values keep their key, timestamps their microseconds."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_OPTIONS).alias(column))


def records_from_json(records: DataFrame, schema: StructType, column: str = "json") -> DataFrame:
    """Parse records written by ``records_json`` back into columns."""
    return records.select(F.from_json(F.col(column), schema, JSON_OPTIONS).alias("_r")).select("_r.*")


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines files, one per task (never gathered on the driver)."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)


def write_report(tables: Mapping[str, DataFrame | None], path: str, mode: str = "overwrite") -> list[str]:
    """Write each non-empty report table to ``path/<name>`` as Parquet.

    Returns the names written. Tables that could not be built (None) are
    skipped.
    """
    written = []
    for name, table in tables.items():
        if table is None:
            continue
        table.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


MANIFEST = "report.json"


def publish_report(tables: Mapping[str, DataFrame | None], path: str) -> str:
    """Write the report as a whole: its tables go to a new folder under ``path``, then
    the manifest that names the folder takes the place of the old one. A failure
    before that leaves the report that readers see untouched. Returns the folder.
    Earlier folders stay until they are cleaned."""
    spark = SparkSession.getActiveSession()
    root = path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    written = write_report(tables, f"{root}/{version}", mode="error")
    body = json.dumps({"version": version, "tables": written}).encode()
    fs, old = _file(spark, f"{root}/{MANIFEST}")
    _, new = _file(spark, f"{root}/{version}/{MANIFEST}")
    out = fs.create(new)
    out.write(bytearray(body))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(old), options)  # one step
    return f"{root}/{version}"


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the report last published under ``path``."""
    root = path.rstrip("/")
    text = "".join(r["value"] for r in spark.read.text(f"{root}/{MANIFEST}").collect())  # one small file
    found = json.loads(text)
    return {name: spark.read.parquet(f"{root}/{found['version']}/{name}") for name in found["tables"]}


def _file(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
