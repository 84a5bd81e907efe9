"""A reader of an append-only feed that loses nothing, however late a row is committed.

The reader keeps the highest number it has read and the ranges of numbers that
were missing then. Each batch reads the rows inside open ranges first, then those
above the mark; numbers that stay missing become new ranges. A range that a probe
found empty after the timeout is lost; lost ranges are probed again by
``reconcile`` until the retention has passed. Ranges and mark change together by
one manifest commit, with the batch's rows written before: a batch that is asked
for again after a crash gives the rows it gave first.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.operators.landing import carried, gaps, range_probe, split_gaps
from goldspan.runtime import Manifest, Workspace

GAPS = "lo bigint, hi bigint, state string, first_seen timestamp, lost_at timestamp"


class GapReader:
    """Reads a feed by its sequence column, each row exactly once.

    Rows without a number are left out; rows of one number come together.
    ``timeout`` is how long a range may stay open, ``retention`` how long a lost
    one is still probed. An empty feed gives empty batches.
    """

    def __init__(self, spark: SparkSession, seq: str, root: str | None = None, timeout: float = 600, retention_days: int = 14):
        self.space = Workspace(spark, "reader", root)
        self.spark, self.seq, self.manifest = spark, seq, Manifest(spark, self.space.root)
        self.timeout, self.retention = datetime.timedelta(seconds=timeout), datetime.timedelta(days=retention_days)

    def _held(self) -> tuple[int, dict]:
        base, held = self.manifest.latest()
        return base, {"high": 0, "gaps": None, "batches": {}, **held}

    def ranges(self) -> DataFrame:
        """lo, hi, state (open or lost), first_seen and lost_at."""
        at = self._held()[1]["gaps"]
        return self.spark.read.schema(GAPS).parquet(at) if at else self.spark.createDataFrame([], GAPS)

    def marks(self) -> tuple[int, int]:
        """The high-water mark, and the low-water mark, below which nothing is open."""
        high = self._held()[1]["high"]
        low = self.ranges().where("state = 'open'").agg(F.min("lo")).first()[0]
        return high, high if low is None else low - 1

    def _inside(self, feed: DataFrame, ranges: DataFrame) -> DataFrame:
        """Rows of the feed inside ranges; only the stretch between the first and the last range is read."""
        ends = ranges.agg(F.min("lo").alias("a"), F.max("hi").alias("b")).first()
        if ends.a is None:
            return feed.where("false")
        near = feed.where(F.col(self.seq).between(ends.a, ends.b))
        return near.join(range_probe(near.select(self.seq).distinct(), ranges.select("lo", "hi"), self.seq).select(self.seq), self.seq, "left_semi")

    def _commit(self, base: int, held: dict, batch: str, rows: DataFrame, high: int, ranges: DataFrame) -> DataFrame:
        path = self.space.write(rows, self.space.path("rows"))
        at = self.space.write(ranges, self.space.path("gaps"))
        self.manifest.commit(base, {"high": high, "gaps": at, "batches": {**held["batches"], batch: path}})
        return self.spark.read.schema(rows.schema).parquet(path)

    def _pieces(self, ranges: DataFrame, found: DataFrame) -> DataFrame:
        """Ranges without the numbers found, with their states and times."""
        left = split_gaps(ranges.select("lo", "hi"), found, self.seq).select(F.col("lo").alias("l"), F.col("hi").alias("h"))
        # Pieces lie inside their range: the range that begins last at or before a piece is its own.
        marks = ranges.select(F.col("lo").alias("at"), F.lit(0).alias("row"), F.lit(None).cast("bigint").alias("h"), F.struct("state", "first_seen", "lost_at").alias("own"))
        cut = left.select(F.col("l").alias("at"), F.lit(1).alias("row"), "h", F.lit(None).cast(marks.schema["own"].dataType).alias("own"))
        out = carried(marks.unionAll(cut), "at", ["row"], "own").where("row = 1")
        return out.select(F.col("at").alias("lo"), F.col("h").alias("hi"), "own.state", "own.first_seen", "own.lost_at")

    def next_batch(self, feed: DataFrame, batch: str, now: datetime.datetime) -> DataFrame:
        """The rows of the feed that haven't been read: those in open ranges, and those above the mark."""
        base, held = self._held()
        if batch in held["batches"]:
            return self.spark.read.schema(feed.schema).parquet(held["batches"][batch])
        feed = feed.where(F.col(self.seq).isNotNull())
        every = self.ranges()
        open_ = every.where("state = 'open'")
        late = self._inside(feed, open_)
        above = feed.where(F.col(self.seq) > held["high"])
        rows = self.space.save(late.withColumn("_late", F.lit(True)).unionByName(above.withColumn("_late", F.lit(False))), "read")
        top = rows.where("not _late").agg(F.max(self.seq)).first()[0]
        found = rows.where("_late").select(self.seq).distinct()
        kept = self._pieces(open_, found)
        # A probe has just read every open range to its end: those past the timeout are lost.
        old = F.col("first_seen") <= F.lit(now - self.timeout)
        kept = kept.withColumns({"state": F.when(old, "lost").otherwise(F.col("state")), "lost_at": F.when(old, F.lit(now)).otherwise(F.col("lost_at"))})
        mark = self.spark.createDataFrame([(held["high"],)], f"{self.seq} bigint")
        missing = gaps(mark.unionAll(rows.where("not _late").select(F.col(self.seq).cast("bigint"))), self.seq)
        new = missing.select("lo", "hi", F.lit("open").alias("state"), F.lit(now).alias("first_seen"), F.lit(None).cast("timestamp").alias("lost_at"))
        ranges = kept.unionByName(new).unionByName(every.where("state <> 'open'"))
        return self._commit(base, held, batch, rows.drop("_late"), max(held["high"], top or 0), ranges)

    def reconcile(self, feed: DataFrame, batch: str, now: datetime.datetime) -> DataFrame:
        """The rows found in lost ranges; lost ranges past the retention with nothing found are given up."""
        base, held = self._held()
        if batch in held["batches"]:
            return self.spark.read.schema(feed.schema).parquet(held["batches"][batch])
        every = self.ranges()
        lost = every.where("state = 'lost'")
        rows = self.space.save(self._inside(feed.where(F.col(self.seq).isNotNull()), lost), "read")
        kept = self._pieces(lost, rows.select(self.seq).distinct()).where(F.col("lost_at") > F.lit(now - self.retention))
        return self._commit(base, held, batch, rows, held["high"], kept.unionByName(every.where("state <> 'lost'")))

    def release(self, batch: str) -> None:
        """Forget the rows of a batch that its consumer has stored."""
        base, held = self._held()
        path = held["batches"].pop(batch, None)
        if path:
            self.manifest.commit(base, held)
            self.space.delete(path)
