"""Parquet and JSON tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path``, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().toString() for f in files.listStatus(at) if f.isDirectory())


def read_json_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    """Overwrite a Parquet table, optionally under published column names."""
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite a JSON artifact, one document per row."""
    df.write.mode("overwrite").json(path)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` for every named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
