"""Scans and writes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv", "json")


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame:
    """Parquet, CSV (header row) or JSON-lines scan.

    CSV and JSON want a schema: inferring one reads the whole input twice.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    return getattr(reader, fmt)(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> DataFrame:
    """Write through Spark's commit protocol and hand back a scan of what was written.

    Task attempts land in a staging folder and appear on commit only, so a
    reader never meets a half-written table and a retried task leaves no copy.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return read_table(df.sparkSession, path, fmt, None if fmt == "parquet" else df.schema)


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A model-sized table (parameters, grids, expectations) as a local relation.

    Arrow keeps it a literal in the plan: the optimiser knows its size and no
    Python-side RDD is scanned each time it is used.
    """
    parsed = StructType.fromDDL(schema)
    arrow = pa.Table.from_pylist(rows, schema=to_arrow_schema(parsed))
    return spark.createDataFrame(arrow, parsed)
