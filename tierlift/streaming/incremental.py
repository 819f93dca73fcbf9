"""Resumable load of new page files.

The stream's checkpoint remembers which files were read, so a restarted job continues after the
last one. Every micro-batch writes its own best record per key to the folder of its number, and
then a new version of the list of live folders, by one rename: readers see the batch whole or
not at all. A repeated batch overwrites its folder and changes nothing. The current table is the
best over the live folders; ``compact`` folds these into one, swaps the list, and only then
deletes what is not in it, so a job that stops on the way loses nothing and the next compaction
clears what it left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.functions.clean import clean_float
from tierlift.operators.normalise import keep_best
from tierlift.sources.raw_json import explode_records, parsed_pages, type_records

ARRIVAL = ["file", "pos"]


def best_records(records: DataFrame) -> DataFrame:
    return keep_best(records, "entity_id", clean_float(F.col("metric")),
                     F.col("n_items"), ARRIVAL)


def page_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    pages = parsed_pages(spark, spark.readStream, path, maxFilesPerTrigger=max_files)
    return type_records(explode_records(pages))


class State:
    """The folders of a load: ``best``, ``compacted``, ``live`` (versions of the list) and
    ``checkpoint``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(path).getFileSystem(
            spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self.jvm.Path(f"{self.path}/{folder}")
        if not self.files.exists(at):
            return []
        return sorted(f.getPath().getName() for f in self.files.listStatus(at))

    def _versions(self) -> list[str]:
        return [n for n in self._names("live") if n.isdigit()]

    def live(self) -> list[str]:
        """Folders of the newest version of the list."""
        versions = self._versions()
        if not versions:
            return []
        text = self.spark.read.text(f"{self.path}/live/{versions[-1]}")
        return sorted(r["value"] for r in text.collect())

    def publish(self, folders: list[str]) -> None:
        """Make ``folders`` the live ones; the list appears by a rename, whole or not at all."""
        number = int((self._versions() or ["0"])[-1]) + 1
        draft = f"{self.path}/live/_draft-{uuid.uuid4().hex}"
        out = self.files.create(self.jvm.Path(draft))
        out.write("\n".join(sorted(folders)).encode())
        out.close()
        if not self.files.rename(self.jvm.Path(draft), self.jvm.Path(f"{self.path}/live/{number:012d}")):
            raise RuntimeError(f"version {number} of {self.path} is there already")

    def clear(self) -> None:
        """Delete folders that are not live and all but the newest version of the list."""
        live = set(self.live())
        for kind in ("best", "compacted"):
            for name in self._names(kind):
                if f"{kind}/{name}" not in live:
                    self.files.delete(self.jvm.Path(f"{self.path}/{kind}/{name}"), True)
        for name in self._versions()[:-1]:
            self.files.delete(self.jvm.Path(f"{self.path}/live/{name}"), False)


def ingest_available(spark: SparkSession, pages: str, state: str, max_files: int = 1000) -> str:
    """Load every page file not seen before, then stop. Returns the state folder."""
    here = State(spark, state)

    def store(batch: DataFrame, number: int) -> None:
        # Stage first: the batch is read once and keep_best then scans few columns.
        staged = f"{state}/staged/batch={number:010d}"
        batch.write.mode("overwrite").parquet(staged)
        folder = f"best/{number:010d}"
        best_records(spark.read.parquet(staged)).write.mode("overwrite").parquet(f"{state}/{folder}")
        here.publish([*{*here.live(), folder}])
        here.files.delete(here.jvm.Path(staged), True)

    run = (
        page_stream(spark, pages, max_files).writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return state


def current_records(spark: SparkSession, state: str) -> DataFrame:
    """The best record per key over all batches so far."""
    return best_records(spark.read.parquet(*[f"{state}/{f}" for f in State(spark, state).live()]))


def compact(spark: SparkSession, state: str) -> None:
    """Fold the live folders into one. No load may run meanwhile; readers may."""
    here = State(spark, state)
    live = here.live()
    if len(live) > 1:
        folder = f"compacted/{uuid.uuid4().hex}"
        current_records(spark, state).write.parquet(f"{state}/{folder}")
        here.publish([folder])
    here.clear()
