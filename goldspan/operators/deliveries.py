"""Exactly one copy of every message that was delivered at least once.

Identifiers are dictionary-encoded exactly: each lives in the shard its hash
names and holds a dense number there. A shard's numbers index compressed
bitmaps of what has been seen. A batch admits one arrival for every identifier
whose bit is unset and refuses every other arrival; the new bits, of the shards
the batch touched only, are published together with the admitted rows by one
manifest commit, so a batch is seen whole or not at all. A batch that is asked
for again, after a crash or a replay, gives the rows it gave first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldspan.runtime import Manifest, Workspace

DICTIONARY = "shard int, scope string, event_id string, code bigint"
BITMAPS = "shard int, bucket bigint, bits binary"
TOPS = "shard int, top bigint"
VERDICTS = "scope string, event_id string, landing_seq bigint, copies bigint, fresh boolean"


class DeliveryLedger:
    """The identifiers seen so far, and the admission of further arrivals.

    ``judge`` takes rows with ``scope`` (what the identifier is unique within),
    ``event_id`` and ``landing_seq`` and returns one row for each identifier of
    the batch: scope, event_id, landing_seq (the smallest of the batch's rows
    that carry it), copies (how many of them there are) and fresh (its bit was
    unset, so one of them is admitted). ``admit`` gives the fresh ones only.

    Rows with a null event_id have no identity and are left out. An empty batch
    admits nothing. A null landing_seq counts after every number; an identifier
    of which all numbers are null is admitted with null. Further columns are
    ignored. Rows equal in everything are copies. Identifiers compare byte for
    byte: case and spaces count. ``shards`` is fixed when the ledger is made:
    about one for each four million identifiers expected, as a shard's new
    identifiers are numbered in one task.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shards: int = 256, fanout: int = 8):
        self.space = Workspace(spark, "ledger", root)
        self.spark, self.manifest, self.fanout = spark, Manifest(spark, self.space.root), fanout
        _, held = self.manifest.latest()
        self.shards = held.get("shards", shards)

    def _read(self, paths: list[str], schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def bits(self, held: dict) -> DataFrame | None:
        """The union of all published bits by shard and bucket."""
        seen = self._read(held.get("bitmaps", []), BITMAPS)
        return seen if seen is None or len(held["bitmaps"]) == 1 else seen.groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def admit(self, arrivals: DataFrame, batch: str | None = None) -> DataFrame:
        return self.judge(arrivals, batch).where("fresh").drop("fresh")

    def judge(self, arrivals: DataFrame, batch: str | None = None) -> DataFrame:
        base, held = self.manifest.latest()
        batch = batch if batch is not None else f"#{base + 1}"
        if batch in held.get("batches", {}):
            return self._read([held["batches"][batch]], VERDICTS)
        dictionary = self._read(held.get("dictionary", []), DICTIONARY)
        tops = self._read(held.get("tops", []), TOPS)

        # Copies of one identifier meet before the shuffle, so one that fills a third of the batch costs a row per task.
        ids = (
            arrivals.select("scope", "event_id", F.col("landing_seq").cast("bigint").alias("landing_seq"))
            .where(F.col("event_id").isNotNull())
            .groupBy("scope", "event_id")
            .agg(F.min("landing_seq").alias("landing_seq"), F.count(F.lit(1)).alias("copies"))
            .withColumn("shard", F.pmod(F.xxhash64("scope", "event_id"), F.lit(self.shards)).cast("int"))
        )
        met = ids.withColumn("code", F.lit(None).cast("bigint")) if dictionary is None else ids.join(dictionary, ["shard", "scope", "event_id"], "left")
        met = met.withColumn("known", F.col("code").isNotNull())
        rank = F.row_number().over(Window.partitionBy("shard", "known").orderBy("scope", "event_id"))
        coded = met.withColumn("rank", rank)
        coded = coded.withColumn("top", F.lit(None).cast("bigint")) if tops is None else coded.join(F.broadcast(tops), "shard", "left")  # a row for each shard
        coded = coded.withColumn("code", F.coalesce("code", F.coalesce("top", F.lit(-1)) + F.col("rank")))
        coded = self.space.save(
            coded.select("shard", "scope", "event_id", "code", "known", "landing_seq", "copies").withColumn("bucket", F.expr("bitmap_bucket_number(code)")), "coded"
        )
        seen, lit_up = self.bits(held), F.lit(False)
        if seen is not None:
            byte = F.conv(F.hex(F.substring("bits", F.expr("int(bitmap_bit_position(code) div 8) + 1"), F.lit(1))), 16, 10).cast("int")
            lit_up = F.col("bits").isNotNull() & (F.call_function("getbit", byte, F.expr("int(bitmap_bit_position(code) % 8)")) == 1)
        looked_up = coded if seen is None else coded.join(seen, ["shard", "bucket"], "left")
        looked_up = looked_up.withColumn("fresh", ~F.coalesce(lit_up, F.lit(False)))
        # The verdicts are fixed before the bits that would change them are published.
        verdicts_at = self.space.write(looked_up.select("scope", "event_id", "landing_seq", "copies", "fresh"), self.space.path("verdicts"))
        new = looked_up.where("fresh")
        bits_at = self.space.write(new.groupBy("shard", "bucket").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(code))").alias("bits")), self.space.path("bitmaps"))
        words_at = self.space.write(coded.where(~F.col("known")).select("shard", "scope", "event_id", "code"), self.space.path("dictionary"))
        new_tops = coded.groupBy("shard").agg(F.max("code").alias("top"))
        if tops is not None:
            new_tops = tops.unionByName(new_tops).groupBy("shard").agg(F.max("top").alias("top"))
        tops_at = self.space.write(new_tops, self.space.path("tops"))
        now = held | {
            "shards": self.shards, "dictionary": [*held.get("dictionary", []), words_at], "bitmaps": [*held.get("bitmaps", []), bits_at], "tops": [tops_at],
            "batches": {**held.get("batches", {}), batch: verdicts_at},
        }
        self.manifest.commit(base, now)
        self.space.drop(coded)
        for path in held.get("tops", []):
            self.space.delete(path)
        if len(now["bitmaps"]) >= self.fanout:
            self.compact()
        return self._read([verdicts_at], VERDICTS)

    def release(self, batch: str) -> None:
        """Forget the rows of a batch that its consumer has safely stored; its bits stay."""
        base, held = self.manifest.latest()
        batches = dict(held.get("batches", {}))
        path = batches.pop(batch, None)
        if path:
            self.manifest.commit(base, held | {"batches": batches})
            self.space.delete(path)

    def compact(self) -> None:
        """Unite the bitmaps and the parts of the dictionary into one table each, and delete what they replace."""
        base, held = self.manifest.latest()
        if len(held.get("bitmaps", [])) < 2:
            return
        bits_at = self.space.write(self.bits(held), self.space.path("bitmaps"))
        words_at = self.space.write(self._read(held["dictionary"], DICTIONARY), self.space.path("dictionary"))
        self.manifest.commit(base, held | {"bitmaps": [bits_at], "dictionary": [words_at]})
        for path in (*held["bitmaps"], *held["dictionary"]):
            self.space.delete(path)


def repeated_ids(spark: SparkSession, tables: dict[str, DataFrame], batches: int = 2) -> DataFrame:
    """The identifiers that more than one row of a table carries, with the smallest landing_seq of those rows.

    The tables are delivered to a ledger in batches by landing number. An
    identifier is repeated where an arrival was refused: its bit was set by an
    earlier batch, or by another arrival of its own batch.
    """
    arrivals = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("scope"), "event_id", F.col("landing_seq").cast("bigint").alias("landing_seq"))
        arrivals = part if arrivals is None else arrivals.unionAll(part)
    ends = arrivals.agg(F.min("landing_seq").alias("lo"), F.max("landing_seq").alias("hi")).first()
    lo, width = ends.lo or 0, ((ends.hi or 0) - (ends.lo or 0)) // batches + 1
    ledger, verdicts = DeliveryLedger(spark), None
    for n in range(batches):
        at = F.coalesce(F.col("landing_seq"), F.lit(lo))  # a missing number is delivered first
        judged = ledger.judge(arrivals.where((at >= lo + n * width) & (at < lo + (n + 1) * width)))
        verdicts = judged if verdicts is None else verdicts.unionAll(judged)
    refused = F.sum(F.col("copies") - F.col("fresh").cast("bigint"))
    repeated = verdicts.groupBy("scope", "event_id").agg(refused.alias("refused"), F.min("landing_seq").alias("landing_seq"))
    return repeated.where("refused > 0").select(F.col("scope").alias("table_name"), "event_id", "landing_seq")
