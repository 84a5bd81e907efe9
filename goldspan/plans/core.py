"""Queries of the core's own operators for general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.operators import changelog, deliveries, loads
from goldspan.runtime import table

DELIVERED = ("landing_rows", "arrival_queue", "landing_reject")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.repeated_ids(spark, {name: table(spark, sf_dir, name) for name in DELIVERED})


def p2_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue in two batches, the later half of its moments second; the ledger lets each event pass once."""
    queue = table(spark, sf_dir, "arrival_queue").select(F.lit("arrival_queue").alias("scope"), "event_id", "landing_seq", "queued_at")
    ledger = deliveries.DeliveryLedger(spark)
    middle = queue.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("queued_at")) + F.max(F.unix_micros("queued_at"))) / 2)).alias("m")).first().m
    if middle is None:
        return ledger.admit(queue).select("event_id", F.lit(1).alias("batch"))
    first = ledger.admit(queue.where(F.col("queued_at") <= F.lit(middle))).select("event_id", F.lit(1).alias("batch"))
    second = ledger.admit(queue.where(~F.coalesce(F.col("queued_at") <= F.lit(middle), F.lit(False)))).select("event_id", F.lit(2).alias("batch"))
    return first.unionAll(second)


P2_FOUND = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, event_id, min(landing_seq) AS landing_seq FROM {t} WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1"
    for t in DELIVERED
)
P2_EXACTLY_ONCE = """
WITH m AS (SELECT (min(epoch_us(queued_at)) + max(epoch_us(queued_at))) // 2 AS mid FROM arrival_queue)
SELECT event_id, CASE WHEN min(epoch_us(queued_at)) <= min(mid) THEN 1 ELSE 2 END AS batch
FROM arrival_queue, m WHERE event_id IS NOT NULL GROUP BY event_id
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.changed(table(spark, sf_dir, "load_extract"))


def p3_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p3_found with the features that tell them."""
    return loads.explained(table(spark, sf_dir, "load_extract"))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.profile(table(spark, sf_dir, "load_extract"))


def p3_profile_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column, of which p3_profile, as its SQL, has nine."""
    extract = table(spark, sf_dir, "load_extract")
    return loads.profile(extract, loads.columns_of(extract))


def p3_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    extract = table(spark, sf_dir, "load_extract")
    return loads.expressions(extract, loads.columns_of(extract))


_TEXT = {a: a for a in loads.ATTRIBUTES} | {"source_version": "CAST(source_version AS VARCHAR)", "occurred_at": "CAST(epoch_us(occurred_at) AS VARCHAR)"}
P3_PROFILE = (
    "WITH cells AS (\n"
    + "\nUNION ALL\n".join(f"SELECT load_no, source_system, '{a}' AS attr_name, {e} AS v FROM load_extract" for a, e in _TEXT.items())
    + """),
counted AS (SELECT load_no, source_system, attr_name, v, count(*) AS n, v IS NOT NULL AND trim(regexp_replace(v, '\\s+', ' ', 'g')) <> '' AS full_ FROM cells GROUP BY ALL),
top AS (SELECT load_no, source_system, attr_name, v, n, row_number() OVER (PARTITION BY load_no, source_system, attr_name ORDER BY n DESC, v) AS rn FROM counted WHERE full_)
SELECT c.load_no, c.source_system, c.attr_name, CAST(sum(c.n) AS BIGINT) AS n_rows, CAST(coalesce(sum(c.n) FILTER (WHERE full_), 0) AS BIGINT) AS filled,
    CAST(count(*) FILTER (WHERE full_) AS BIGINT) AS distincts, min(c.v) FILTER (WHERE full_) AS least, max(c.v) FILTER (WHERE full_) AS largest,
    min(t.v) AS top_value, CAST(min(t.n) AS BIGINT) AS top_rows
FROM counted c LEFT JOIN top t ON t.rn = 1 AND t.load_no = c.load_no AND t.source_system = c.source_system AND t.attr_name = c.attr_name
GROUP BY ALL"""
)

_MORE = {"source_key": "source_key", "row_no": "CAST(row_no AS VARCHAR)", "loaded_at": "CAST(epoch_us(loaded_at) AS VARCHAR)"}
P3_PROFILE_WHOLE = (
    "WITH cells AS (\n"
    + "\nUNION ALL\n".join(f"SELECT load_no, source_system, '{a}' AS attr_name, {e} AS v FROM load_extract" for a, e in (_TEXT | _MORE).items())
    + P3_PROFILE[P3_PROFILE.index("),\ncounted") :]
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changelog.current_state(spark, table(spark, sf_dir, "arrival_queue"), table(spark, sf_dir, "landing_rows"))
    return state.select("entity", "source_system", "source_key", "event_id")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from nine runs, compacted as levels fill up."""
    state = changelog.current_state(spark, table(spark, sf_dir, "arrival_queue"), table(spark, sf_dir, "landing_rows"), batches=9)
    return state.select("entity", "source_system", "source_key", "event_id")


P6_FOUND = """
WITH q AS (
    SELECT event_id, min(landing_seq) AS seq, min(entity) AS entity, min(source_system) AS source_system, min(source_key) AS source_key
    FROM arrival_queue WHERE event_id IS NOT NULL GROUP BY event_id),
l AS (SELECT event_id, op, occurred_at, source_version FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY landing_seq) AS rn FROM landing_rows) WHERE rn = 1),
ranked AS (
    SELECT q.entity, q.source_system, q.source_key, q.event_id, l.op, row_number() OVER (
        PARTITION BY q.entity, q.source_system, q.source_key
        ORDER BY CASE WHEN q.source_system IN ('hr', 'finance') THEN l.source_version ELSE 0 END DESC NULLS LAST, l.occurred_at DESC NULLS LAST, q.seq DESC NULLS LAST, q.event_id DESC) AS rn
    FROM q JOIN l USING (event_id))
SELECT entity, source_system, source_key, event_id FROM ranked WHERE rn = 1 AND op IS DISTINCT FROM 'delete'
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_exactly_once, p3_found, p3_explained, p3_profile, p3_profile_whole, p3_expressions, p6_found, p6_runs)}
SQL = {"p2_found": P2_FOUND, "p2_exactly_once": P2_EXACTLY_ONCE, "p3_profile": P3_PROFILE, "p3_profile_whole": P3_PROFILE_WHOLE, "p6_found": P6_FOUND, "p6_runs": P6_FOUND}
