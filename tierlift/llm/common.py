"""Helpers the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.session import cut_lineage

# Rows of text handed to vectorised code at once; a single longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice have at most ``limit`` bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there."""
    return cut_lineage(df)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf.newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so once the driver's JVM has collected the plans, which may else take half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole_text(column: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_key(docs: DataFrame, key: str, id_column: str, text_column: str) -> DataFrame:
    """Add a distinct bigint that ascends in the order of the documents.

    It is the id where ids are distinct and not null. Else rows are put in order (null ids first,
    rows of one id by a hash of their text) and stored, and the ids that Spark gives to ordered
    partitions, which ascend, are the key.
    """
    ids = F.col(f"`{id_column}`").cast("bigint")
    odd = docs.select(ids.alias("id")).groupBy("id").count().where("count > 1 or id is null")
    if odd.isEmpty():
        return docs.withColumn(key, ids)
    tie = fresh_name(docs, "tie")
    tied = docs.withColumn(key, ids).withColumn(tie, F.xxhash64(whole_text(f"`{text_column}`")))
    ordered = tied.repartitionByRange(key, tie).sortWithinPartitions(key, tie)
    return stored(ordered.drop(tie).withColumn(key, F.monotonically_increasing_id()))
