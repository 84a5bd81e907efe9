"""Reading an append-only landing log: latest states, gaps of the sequence, hourly counts, contract checks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size limits of the landing contract.
LONGEST_TEXT, LARGEST_PAYLOAD = 4_000, 65_536
OPERATIONS = ("upsert", "delete")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; a maximum of structs, so partial results form before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in (*order, *rest)))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in (*order, *rest)))


def insert_new(stored: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the batch whose key isn't stored yet, the first of each key."""
    return first_by(batch, [key], order).join(stored.select(key).distinct(), key, "left_anti")


def gaps(seqs: DataFrame, seq: str, bucket: int = 1_000_000) -> DataFrame:
    """lo and hi of every run of numbers missing between the smallest and the largest.

    The sequence is cut into buckets of numbers; each is searched on its own, and
    the buckets' ends are joined up by a window over one row per bucket.
    """
    s = seqs.select(F.col(seq).cast("bigint").alias("s")).where("s is not null").distinct()
    s = s.withColumn("b", F.floor(F.col("s") / bucket))
    inner = s.withColumn("p", F.lag("s").over(Window.partitionBy("b").orderBy("s"))).where("s - p > 1")
    ends = s.groupBy("b").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    between = ends.withColumn("p", F.lag("last").over(Window.orderBy("b"))).where("first - p > 1")
    pairs = inner.select("p", "s").unionAll(between.select("p", F.col("first").alias("s")))
    return pairs.select((F.col("p") + 1).alias("lo"), (F.col("s") - 1).alias("hi"))


def split_gaps(open_gaps: DataFrame, arrived: DataFrame, seq: str) -> DataFrame:
    """What is left of gaps (lo, hi) after late rows arrived inside them."""
    hit = range_probe(arrived.select(F.col(seq).alias("s")), open_gaps, "s").select("lo", "hi", "s")
    marks = hit.select("lo", "hi", F.col("s").alias("x")).unionAll(open_gaps.select("lo", "hi", (F.col("lo") - 1).alias("x"))).unionAll(
        open_gaps.select("lo", "hi", (F.col("hi") + 1).alias("x"))
    )
    w = Window.partitionBy("lo", "hi").orderBy("x")
    cut = marks.distinct().withColumn("next", F.lead("x").over(w)).where("next - x > 1")
    return cut.select((F.col("x") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))


def carried(rows: DataFrame, at: str, ties: list[str], value: str, bucket: int = 1_000_000) -> DataFrame:
    """rows with ``value`` where it is null taken from the last row before, in the order of the number ``at`` and ``ties``, that has one.

    The order is cut into buckets of numbers; one row for each bucket carries the value on from bucket to bucket.
    """
    cut = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_b").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.groupBy("_b").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at, *ties, F.col(value).alias("_v")))).alias("m")).select("_b", F.col("m._v").alias("_v"))
    before = ends.select("_b", F.last("_v", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_v"))
    return cut.withColumn(value, own).join(before, "_b").withColumn(value, F.coalesce(value, "_v")).drop("_b", "_v")


def range_probe(rows: DataFrame, ranges: DataFrame, seq: str) -> DataFrame:
    """Rows whose number lies in one of the ranges (lo, hi), which don't overlap, with that range.

    A number belongs to the last range that begins at or before it, if that
    reaches so far: numbers and ranges are put in one order, no range is unrolled.
    """
    begun = ranges.select(F.col("lo").alias("_at"), F.lit(0).alias("_row"), F.struct("lo", "hi").alias("_range")).where("_at is not null").dropDuplicates(["_at"])
    asked = rows.select(F.col(seq).cast("bigint").alias("_at")).where("_at is not null").distinct().select("_at", F.lit(1).alias("_row"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("_range"))
    begun = begun.withColumn("_range", F.col("_range").cast("struct<lo:bigint,hi:bigint>"))
    met = carried(begun.unionAll(asked), "_at", ["_row"], "_range").where("_row = 1 and _at <= _range.hi")
    met = met.select(F.col("_at"), F.col("_range.lo").alias("lo"), F.col("_range.hi").alias("hi"))
    return rows.join(met, F.col(seq) == F.col("_at")).drop("_at")


def hourly_counts(events: DataFrame, ts: str, by: str) -> DataFrame:
    return events.groupBy(by, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def spikes(counts: DataFrame, by: str, factor: float = 5.0, least: int = 1_000, days: int = 7) -> DataFrame:
    """Hours of at least ``least`` arrivals and ``factor`` times the mean of the same hour of the days before; a missing hour counts 0.

    Seven equi-joins fold into one: each hour is sent to the days after it.
    """
    later = counts.select(by, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d"), "hour", "n")
    later = later.select(by, (F.col("hour") + F.make_dt_interval(F.col("d"))).alias("hour"), "n")
    mean = later.groupBy(by, "hour").agg((F.sum("n") / days).alias("usual"))
    out = counts.join(mean, [by, "hour"], "left").withColumn("usual", F.coalesce("usual", F.lit(0.0)))
    return out.withColumn("spike", (F.col("n") >= least) & (F.col("n") >= factor * F.col("usual")))


#: The JSON kinds that a value of each type can't have.
NEVER = {
    "text": ("OBJECT", "ARRAY"), "date": ("OBJECT", "ARRAY"), "timestamp": ("OBJECT", "ARRAY"), "boolean": ("OBJECT", "ARRAY"),
    "integer": ("OBJECT", "ARRAY", "BOOLEAN"), "number": ("OBJECT", "ARRAY", "BOOLEAN"), "reference": ("OBJECT", "ARRAY", "BOOLEAN"),
}
MOST_ENTRIES = 100


def _parsed(rows: DataFrame) -> DataFrame:
    """rows with the payload's members (_m), their JSON kinds by the first three letters (_k, null for null) and the lengths of their texts (_n), each worked out once."""
    whole = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")
    rows = rows.withColumn("_m", whole)
    kind = F.transform_values("_m", lambda _, v: F.nullif(F.substring(F.schema_of_variant(v), 1, 3), F.lit("VOI")))
    return rows.withColumns({"_k": kind, "_n": F.transform_values("_m", lambda _, v: F.length(F.try_variant_get(v, "$", "string")))})


def _entries(name: str) -> Column:
    return F.try_variant_get(F.col("_m")[name], "$", "array<variant>")


def type_problems(attributes: dict[str, str]) -> Column:
    """Names of attributes whose JSON kind their type (text, date, timestamp, boolean, integer, number, reference, group) can never hold, over ``_parsed`` rows."""
    found = []
    for name, kind in attributes.items():
        has = F.col("_k")[name]
        if kind == "group":
            odd = F.exists(_entries(name), lambda e: ~F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)))
            bad = (has != "ARR") | F.when(has == "ARR", odd)
        else:
            bad = has.isin(*(k[:3] for k in NEVER[kind]))
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*found))


def size_problems(attributes: dict[str, str], fields: tuple[str, ...] = ()) -> Column:
    """Names of attributes with a text over LONGEST_TEXT characters anywhere inside, or a group over MOST_ENTRIES, over ``_parsed`` rows.

    A payload that is no longer than LONGEST_TEXT itself isn't searched.
    """
    found = []
    for name, kind in attributes.items():
        if kind == "group":
            longest = lambda e: F.greatest(F.lit(0), *(F.length(F.try_variant_get(e, f"$.{f}", "string")) for f in fields))
            has = F.col("_k")[name] == "ARR"
            bad = F.when(has, (F.size(_entries(name)) > MOST_ENTRIES) | F.when(F.length("payload") > LONGEST_TEXT, F.exists(_entries(name), lambda e: longest(e) > LONGEST_TEXT)))
        else:
            bad = F.col("_n")[name] > LONGEST_TEXT
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*found))


def contract(rows: DataFrame, attributes: dict[str, dict[str, str]], sources: dict[str, tuple[str, ...]], versioned: tuple[str, ...], fields: tuple[str, ...] = ()) -> DataFrame:
    """rows with reason, the first breach of the landing contract or null, and the names of the attributes at fault.

    Beyond ``reject_reason``: too_large names attributes over the size limits,
    bad_payload those that the entity's model doesn't have, bad_type those of an
    impossible type; the names are sorted. ``attributes`` has each entity's types.
    """
    columns = rows.columns
    rows = _parsed(rows)
    none = F.array().cast("array<string>")
    per = lambda of: F.coalesce(*(F.when(F.col("entity") == e, of(a)) for e, a in attributes.items()), none)
    rows = rows.withColumns({
        "_first": reject_reason(sources, versioned), "_large": per(lambda a: size_problems(a, fields)), "_unknown": per(lambda a: F.array_except(F.map_keys("_k"), F.array(*map(F.lit, (*a, "master_id"))))),
        "_wrong": F.when(F.col("op") == "upsert", per(type_problems)).otherwise(none), "_hint": F.coalesce(F.col("_k")["master_id"] != "STR", F.lit(False)),
    })
    has = lambda c: F.size(F.coalesce(F.col(c), none)) > 0
    reason = F.when(F.col("_first").isNotNull(), F.col("_first")).when(has("_large"), "too_large").when(has("_unknown"), "bad_payload").when(F.col("_hint") | has("_wrong"), "bad_type")
    names = F.when(F.col("_first").isNotNull(), none).when(has("_large"), F.col("_large")).when(has("_unknown"), F.col("_unknown")).when(F.col("_hint"), F.array(F.lit("master_id"))).when(has("_wrong"), F.col("_wrong")).otherwise(none)
    return rows.select(*columns, reason.alias("reason"), F.array_sort(names).alias("attributes"))


def reject_reason(sources: dict[str, tuple[str, ...]], versioned: tuple[str, ...]) -> Column:
    """The first breach of the landing contract, or null: entity, source, key, operation, version, payload, size.

    ``sources`` lists the sources registered for each entity.
    """
    entity, source = F.col("entity"), F.col("source_system")
    known = F.lit(False)
    for e, names in sources.items():
        known = known | ((entity == e) & source.isin(*names))
    is_object = F.col("payload").rlike(r"^\s*\{[\s\S]*\}\s*$") & F.try_parse_json("payload").isNotNull()
    return (
        F.when(entity.isNull() | ~entity.isin(*sources), "unknown_entity")
        .when(~F.coalesce(known, F.lit(False)), "unknown_source")
        .when(F.col("source_key").isNull() | (F.trim("source_key") == ""), "missing_key")
        .when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "bad_op")
        .when(source.isin(*versioned) & F.col("source_version").isNull(), "missing_version")
        .when((F.col("op") == "upsert") & ~F.coalesce(is_object, F.lit(False)), "bad_payload")
        .when(F.octet_length("payload") > LARGEST_PAYLOAD, "too_large")
    )


def page_after(rows: DataFrame, order: list[str], after: tuple, limit: int) -> DataFrame:
    """The next ``limit`` rows behind a cursor: a comparison of structs, never an offset."""
    cursor = F.struct(*(F.lit(v).alias(c) for c, v in zip(order, after)))
    return rows.where(F.struct(*order) > cursor).orderBy(*order).limit(limit)
