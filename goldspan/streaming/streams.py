"""Structured Streaming forms of the stateful operators; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.operators.deliveries import DeliveryLedger
from goldspan.operators.landing import latest_by
from goldspan.runtime import Manifest, Workspace
from goldspan.sources.files import stream_of

__all__ = ["ExactlyOnce", "Upserts", "as_files", "hourly_counts", "latest_state", "run_to_end", "stream_of"]


def as_files(rows: DataFrame, file: Column, files: int, space: Workspace) -> str:
    """Write rows as so many folders of one stream, in the order in which they land, and return the folder above them."""
    folder = f"{space.root}/landed"
    saved = space.save(rows.withColumn("_file", file), "landing")
    for n in range(files):
        space.write(saved.where(F.col("_file") == n).drop("_file").coalesce(1), f"{folder}/file-{n:03d}")
    return folder


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], space: Workspace, mode: str = "append") -> None:
    """Process all that is there in micro-batches, the sink called once for each batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{space.root}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def hourly_counts(events: DataFrame, ts: str, by: str, lateness: str = "2 hours") -> DataFrame:
    """Counts by hour; late rows count while the watermark leaves their hour open."""
    return events.withWatermark(ts, lateness).groupBy(by, F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("hour"), "n")


def latest_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key so far, for update mode: sent on whenever it moves; older rows never move a state back."""
    return latest_by(events, keys, order)


class Upserts:
    """A sink of update mode: the rows of the last batch that told a key stand for it. A replayed batch replaces its own rows."""

    def __init__(self, space: Workspace, keys: list[str]):
        self.root, self.keys = f"{space.root}/upserts", keys

    def sink(self, batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{self.root}/epoch={epoch:09d}")

    def read(self, spark: SparkSession) -> DataFrame:
        return latest_by(spark.read.parquet(f"{self.root}/*"), self.keys, ["_epoch"]).drop("_epoch")


class ExactlyOnce:
    """A sink that stores each identifier once, whatever is delivered, replayed or restarted.

    Rows have scope, event_id and landing_seq. What was seen lies in a delivery
    ledger and the stored batches in a manifest, so nothing is kept in memory: a
    batch whose epoch is known stores the rows it stored before.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int = 16):
        self.spark, self.root = spark, root
        self.ledger, self.manifest = DeliveryLedger(spark, f"{root}/ledger", shards), Manifest(spark, f"{root}/stored")

    def sink(self, batch: DataFrame, epoch: int) -> None:
        base, held = self.manifest.latest()
        if str(epoch) in held.get("epochs", {}):
            return
        admitted = self.ledger.admit(batch, f"epoch-{epoch}")  # after a crash the rows it admitted first
        path = f"{self.root}/rows/{epoch:09d}"
        admitted.write.mode("overwrite").parquet(path)
        self.manifest.commit(base, {"epochs": {**held.get("epochs", {}), str(epoch): path}})
        self.ledger.release(f"epoch-{epoch}")

    def read(self) -> DataFrame:
        paths = sorted(self.manifest.latest()[1].get("epochs", {}).values())
        schema = "scope string, event_id string, landing_seq bigint, copies bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
