"""Event-time windows over a stream whose rows come out of order and sometimes too late.

Windows and sessions are Spark's own, with a watermark that trails the largest event time by a
delay; their state holds open windows only. A row of which every window has closed is dropped
by Spark without a trace, so ``store_late_rows`` keeps those: it applies the same rule from the
largest time of the earlier batches, which it stores as one row per batch. Spark drops by the
watermark that the batch before closed windows with, so the batch just before does not count.

Each batch overwrites the folder of its own number, so a batch that is repeated after a failure
changes nothing, and a restarted job goes on after its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_windows(events: DataFrame, time: str, keys: list[str], size: str, slide: str,
                    delay: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per key and window; works on a stream and on a table."""
    return (
        events.withWatermark(time, delay).groupBy(F.window(time, size, slide), *keys)
        .agg(*aggregates)
        .select(F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "*").drop("window"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, delay: str,
             aggregates: list[Column]) -> DataFrame:
    """Aggregates per key and session: rows less than ``gap`` apart from the next one."""
    return (
        events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys)
        .agg(*aggregates)
        .select(F.col("session_window.start").alias("session_start"),
                F.col("session_window.end").alias("session_end"), "*").drop("session_window"))


def store_closed(windows: DataFrame, state: str) -> None:
    """Append every window once, when the watermark has passed its end; stop with the input."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/closed/batch={number:010d}")

    (windows.writeStream.outputMode("append").foreachBatch(store)
     .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
     .awaitTermination())


def closed(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/closed").drop("batch")


def last_window_end(time: str, size: str, slide: str) -> Column:
    """End of the last window that holds a time: it starts at the last step before the time."""
    step = F.window(time, slide, slide).getField("start")
    return step + F.expr(f"interval {size}")


def store_late_rows(events: DataFrame, time: str, ends: Column, delay: str, state: str) -> None:
    """Keep the rows whose last window, ending at ``ends``, is closed when they come.

    ``late/batch=n`` has the rows and ``seen/batch=n`` the largest time up to the batch.
    """
    spark = events.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        def seen(back: int) -> DataFrame:
            if number < back:
                return batch.select(F.col(time).alias("latest")).limit(0)
            return spark.read.parquet(f"{state}/seen/batch={number - back:010d}")

        seen(1).unionByName(batch.agg(F.max(time).alias("latest"))).agg(
            F.max("latest").alias("latest")).write.mode("overwrite").parquet(
            f"{state}/seen/batch={number:010d}")
        latest = seen(2).first()
        late = batch.limit(0)
        if latest is not None and latest["latest"] is not None:
            # Watermarks count whole milliseconds.
            mark = F.date_trunc("millisecond", F.lit(latest["latest"])) - F.expr(f"interval {delay}")
            late = batch.where(ends <= mark)
        late.write.mode("overwrite").parquet(f"{state}/late/batch={number:010d}")

    (events.writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def late_rows(spark: SparkSession, state: str) -> DataFrame:
    """The late rows of all batches, with the number of the batch they came in."""
    return spark.read.parquet(f"{state}/late").withColumn("batch", F.col("batch").cast("int"))


def replay(batches: DataFrame, column: str, folder: str, files: int = 1) -> None:
    """Write a table as if it had come in batches: one set of ``files`` files per number.

    The stream takes the oldest files first, so the batches are written one after the other.
    """
    spark, numbers = batches.sparkSession, [
        r[0] for r in batches.select(column).distinct().orderBy(column).collect()]
    for number in numbers:
        (batches.where(F.col(column) == number).drop(column).repartition(files)
         .write.mode("append").parquet(folder))


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    return (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
            .parquet(folder))
