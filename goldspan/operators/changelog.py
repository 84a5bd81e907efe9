"""Current state from a feed of upserts and deletes: a log-structured merge store.

Each batch of changes becomes a run: the last change of each of its records, in
files bucketed by record and sorted by record and order. Runs are never changed.
A read brings the files of one bucket of all runs into one task, where their
sorted stretches are merged (Spark's sort finds and merges ascending stretches);
nothing is exchanged. The last change of each record decides, deletes being
tombstones that hide the record and stay in the store, so that an older change
that lands afterwards cannot bring it back. Whenever a level holds ``fanout``
runs, they are compacted into one run of the next level, so a change is
rewritten logarithmically often; replaced runs are deleted one compaction later.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from goldspan.runtime import Manifest, Workspace

KEY = ("entity", "source_system", "source_key")
#: Order of a record's changes: version (0 where the source has none), moment, landing number, then the event's own id.
ORDER = ("version", "occurred_at", "landing_seq", "event_id")
#: Sources whose source_version orders their changes.
VERSIONED_SOURCES = ("hr", "finance")


def change_order() -> Column:
    return F.struct(*ORDER, "op")


def _last(rows: DataFrame) -> DataFrame:
    """The last change of each record; formed in part before any exchange, so a record of any number of changes costs a row a task."""
    last = rows.groupBy(*KEY).agg(F.max(change_order()).alias("last"))
    return last.select(*KEY, *(F.col(f"last.{c}").alias(c) for c in (*ORDER, "op")))


class ChangeStore:
    """Runs of changes under one folder.

    A change has the columns of KEY, ORDER and op. A null version or moment
    comes before every value. Changes that tie in all of ORDER are one change.
    An operation other than ``delete`` counts as an upsert. Rows whose key has
    a null part are kept and form a record of their own, null being a value of
    the key. Empty batches add an empty run. ``buckets`` is fixed when the store
    is made: about one for each 100 MB of state; it defaults to the session's
    shuffle partitions.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fanout: int = 4):
        self.space = Workspace(spark, "changes", root)
        self.spark, self.manifest, self.fanout = spark, Manifest(spark, self.space.root), fanout
        _, held = self.manifest.latest()
        self.buckets = held.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, name: str) -> str:
        return self.space.write_sorted(rows, self.space.path(name), KEY, ORDER, self.buckets)

    def append(self, changes: DataFrame) -> None:
        """Write one batch as a sorted run and publish it; compact every level that has filled up."""
        base, held = self.manifest.latest()
        rows = _last(changes.select(*KEY, *ORDER, "op"))
        run = {"path": self._write(rows, "run"), "level": 0}
        self.manifest.commit(base, held | {"buckets": self.buckets, "runs": [*held.get("runs", []), run], "schema": rows.schema.json()})
        level = 0
        while sum(r["level"] == level for r in self.runs()) >= self.fanout:
            self.compact(level)
            level += 1

    def runs(self) -> list[dict]:
        return self.manifest.latest()[1].get("runs", [])

    def _merged(self, paths: list[str], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        rows = self.space.read_sorted(paths, kind, KEY, ORDER, self.buckets)
        return _last(rows)

    def merged(self) -> DataFrame:
        """The last change of every record, tombstones included."""
        _, held = self.manifest.latest()
        if not held.get("runs"):
            raise ValueError("the store has no run yet")
        return self._merged([r["path"] for r in held["runs"]], held["schema"])

    def state(self) -> DataFrame:
        """One row for each record that exists, with the change that gave its state."""
        return self.merged().where(~F.coalesce(F.col("op") == "delete", F.lit(False)))

    def compact(self, level: int | None = None) -> None:
        """Merge the runs of a level, or all runs, into one of the next level, tombstones included.

        Runs replaced by the compaction before are deleted: a reader that began
        before it has then had one compaction's time.
        """
        base, held = self.manifest.latest()
        old = [r for r in held.get("runs", []) if level is None or r["level"] == level]
        if len(old) < 2:
            return
        merged = {"path": self._write(self._merged([r["path"] for r in old], held["schema"]), "merged"), "level": max(r["level"] for r in old) + 1}
        kept = [r for r in held["runs"] if r not in old]
        self.manifest.commit(base, held | {"runs": [merged, *kept], "stale": [r["path"] for r in old]})
        for path in held.get("stale", []):
            self.space.delete(path)


def queued_changes(queue: DataFrame, landing: DataFrame, versioned: tuple[str, ...] = VERSIONED_SOURCES) -> DataFrame:
    """Every event of the queue once, with its operation, moment and version from the landed rows.

    An event's landing_seq is the smallest of its rows in the queue. Events of
    the queue that never landed are left out, as are landed ones that aren't queued.
    """
    heard = (
        queue.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.min("landing_seq").alias("landing_seq"), F.min(F.struct(*KEY)).alias("key"))
        .select("event_id", "landing_seq", *(F.col(f"key.{c}").alias(c) for c in KEY))
    )
    told = (
        landing.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.min(F.struct("landing_seq", "op", "occurred_at", "source_version")).alias("row"))
        .select("event_id", F.col("row.op").alias("op"), F.col("row.occurred_at").alias("occurred_at"), F.col("row.source_version").alias("source_version"))
    )
    version = F.when(F.col("source_system").isin(*versioned), F.col("source_version")).otherwise(F.lit(0)).cast("bigint")
    return heard.join(told, "event_id").withColumn("version", version).select(*KEY, *ORDER, "op")


def current_state(spark: SparkSession, queue: DataFrame, landing: DataFrame, batches: int = 3, fanout: int = 4) -> DataFrame:
    """The state of every source record after all queued events, which are appended in ``batches`` runs by landing number.

    With as many batches as ``fanout`` the runs are compacted on the way.
    """
    store = ChangeStore(spark, fanout=fanout)
    changes = store.space.save(queued_changes(queue, landing), "queued")
    ends = changes.agg(F.min("landing_seq").alias("lo"), F.max("landing_seq").alias("hi")).first()
    lo, width = ends.lo or 0, ((ends.hi or 0) - (ends.lo or 0)) // batches + 1
    for n in range(batches):
        at = F.coalesce(F.col("landing_seq"), F.lit(lo))
        store.append(changes.where((at >= lo + n * width) & (at < lo + (n + 1) * width)))
    return store.state()
