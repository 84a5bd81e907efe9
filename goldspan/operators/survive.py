"""Surviving values of golden records by any list of strategies, with stewards' values, pins and repeating groups.

Offers are rows of master_id, attr_name, source_system, source_key, value (text),
trust, occurred_at and landing_seq, and optionally ``filled`` (filled fields of a
group). Offers without a value don't take part. Null trust ranks after every
number, null moments and numbers last. Ties go to the smaller source_system, then
source_key. Only the first rows of a group are kept before any exchange, so a
group may be of any size.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("master_id", "attr_name")
UNTRUSTED = 1_000_000
#: The name under which a steward's value competes, and how many runners-up are told.
STEWARD, RUNNERS_UP = "steward", 5
_LAST = (1 << 63) - 1


def offered(offers: DataFrame) -> DataFrame:
    return offers.where("value is not null and trim(value) <> ''")


def with_stewards(offers: DataFrame, stewards: DataFrame, rank: int, now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Offers joined by the stewards' unpinned values, and the values whose pin holds at ``now``.

    stewards has master_id, attr_name, value, set_at and pinned_until. A pin that
    has run out is ignored together with its value.
    """
    held = stewards.where("value is not null")
    pinned = held.where(F.col("pinned_until") > F.lit(now)).select(*GROUP, "value")
    free = held.where("pinned_until is null").select(
        *GROUP, F.lit(STEWARD).alias("source_system"), F.col("attr_name").alias("source_key"), "value", F.lit(rank).cast("int").alias("trust"), F.col("set_at").alias("occurred_at"), F.lit(_LAST).alias("landing_seq")
    )
    return offers.unionByName(free, allowMissingColumns=True), pinned


def approved(members: DataFrame, committing: DataFrame) -> DataFrame:
    """rec and values of members: the current values of records committing now, else those approved before (null where none were)."""
    return members.join(committing.select("rec").withColumn("_now", F.lit(True)), "rec", "left").select("master_id", "rec", F.when(F.col("_now"), F.col("current_values")).otherwise(F.col("approved_values")).alias("values"))


def _keys(strategy: str, filled: bool) -> list[Column]:
    """Sort keys of a strategy, smaller first."""
    return {
        "source_trust": lambda: [F.coalesce(F.col("trust").cast("bigint"), F.lit(UNTRUSTED).cast("bigint"))],
        "recency": lambda: [F.coalesce(-F.unix_micros("occurred_at"), F.lit(_LAST)), F.coalesce(-F.col("landing_seq"), F.lit(_LAST))],
        "completeness": lambda: [-(F.coalesce("filled", F.length("value")) if filled else F.length("value")).cast("bigint")],
        "frequency": lambda: [-F.col("freq")],
    }[strategy]()


def ranked(offers: DataFrame, strategies: list[str], most: int = RUNNERS_UP + 1, within: tuple[str, ...] = GROUP) -> DataFrame:
    """The first ``most`` offers of each group with their rank and, as arrays, each strategy's sort keys."""
    rows = offered(offers)
    if "frequency" in strategies:
        folded = F.lower(F.trim("value"))
        counts = rows.groupBy(*within, folded.alias("_folded")).agg(F.count(F.lit(1)).alias("freq"))
        rows = rows.withColumn("_folded", folded).join(counts, [*within, "_folded"]).drop("_folded")
    filled = "filled" in rows.columns
    rows = rows.withColumn("keys", F.array(*(F.array(*_keys(s, filled)) for s in strategies)))
    order = [F.col("keys"), F.col("source_system"), F.col("source_key"), F.col("value")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= most)


def survive(offers: DataFrame, strategies: dict[str, list[str]], default: list[str], stewards: DataFrame | None = None, steward_rank: int = 0, now: datetime.datetime | None = None, style: str = "consolidated") -> DataFrame:
    """master_id, attr_name, value, source, decided_by, runners_up and pinned of every attribute with a value.

    decided_by is ``pin``, ``only``, the first strategy that tells the winner from
    the second, or ``tie_break``. runners_up are up to five (source, value). A
    master of style ``registry`` has no values of its own.
    """
    pinned = None
    if stewards is not None:
        offers, pinned = with_stewards(offers, stewards, steward_rank, now or datetime.datetime.now(datetime.timezone.utc))
    out = None
    own = sorted(strategies)
    plans = {tuple(s): [a for a in own if tuple(strategies[a]) == tuple(s)] for s in strategies.values()}
    parts = [(offers.where(F.col("attr_name").isin(*names)), list(s)) for s, names in plans.items()] + [(offers.where(~F.col("attr_name").isin(*own)) if own else offers, default)]
    for rows, plan in parts:
        kept = ranked(rows, plan)
        entry = F.struct("rank", F.concat_ws(":", "source_system", "source_key").alias("source"), "value", "keys")
        per = kept.groupBy(*GROUP).agg(F.array_sort(F.collect_list(entry)).alias("r"))  # six rows at most
        first, second = F.element_at("r", 1), F.get("r", F.lit(1))
        told = F.lit("tie_break")
        for k, s in reversed(list(enumerate(plan))):
            told = F.when(first["keys"][k] != second["keys"][k], s).otherwise(told)
        part = per.select(
            *GROUP, first["value"].alias("value"), first["source"].alias("source"), F.when(second.isNull(), "only").otherwise(told).alias("decided_by"),
            F.transform(F.slice("r", 2, RUNNERS_UP), lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))).alias("runners_up"),
            F.transform(F.slice("r", 1, RUNNERS_UP), lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))).alias("_all"),
        )
        out = part if out is None else out.unionAll(part)
    if pinned is not None:
        own_pin = pinned.withColumnRenamed("value", "_pin")
        out = out.join(own_pin, list(GROUP), "full")
        is_pin = F.col("_pin").isNotNull()
        none = F.array().cast("array<struct<source:string,value:string>>")
        out = out.select(
            *GROUP, F.coalesce("_pin", "value").alias("value"), F.when(is_pin, F.concat_ws(":", F.lit(STEWARD), "attr_name")).otherwise(F.col("source")).alias("source"), F.when(is_pin, "pin").otherwise(F.col("decided_by")).alias("decided_by"),
            F.when(is_pin, F.coalesce("_all", none)).otherwise(F.col("runners_up")).alias("runners_up"), is_pin.alias("pinned"),
        )
    else:
        out = out.drop("_all").withColumn("pinned", F.lit(False))
    return out.where(F.lit(style != "registry"))


def keyed_union(entries: DataFrame, strategies: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Of a repeating group's entries (offers with a column ``key``) the best for each folded key, and the source that won most of them by master.

    Entries whose key is null or blank take no part.
    """
    rows = entries.where(F.col(key).isNotNull() & (F.trim(key) != "")).withColumn("_key", F.lower(F.trim(key)))
    best = ranked(rows, strategies, 1, ("master_id", "_key"))
    wins = best.groupBy("master_id", "source_system", "source_key").agg(F.count(F.lit(1)).alias("n"))
    top = wins.groupBy("master_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "source_system", "source_key")).alias("t"))
    top = top.select("master_id", F.concat_ws(":", "t.source_system", "t.source_key").alias("source"), (-F.col("t.m")).alias("entries"))
    return best.drop("rank", "keys").withColumnRenamed("_key", "folded_key"), top


def whole_group(groups: DataFrame, strategies: list[str]) -> DataFrame:
    """The whole group (offers, ``filled`` telling its filled fields) of the best member of each master."""
    return ranked(groups, strategies, 1, ("master_id",)).drop("rank", "keys")


def why(survived: DataFrame) -> DataFrame:
    """One sentence for each surviving value."""
    n = F.size("runners_up")
    others = F.concat(n.cast("string"), F.when(n == 1, " other value").otherwise(" other values"))
    text = (
        F.when(F.col("decided_by") == "pin", "A steward pinned this value.").when(F.col("decided_by") == "only", F.concat(F.col("source"), F.lit(" is the only source with a value.")))
        .when(F.col("decided_by") == "source_trust", F.concat(F.col("source"), F.lit(" is the most trusted source; it stands before "), others, F.lit(".")))
        .when(F.col("decided_by") == "recency", F.concat(F.col("source"), F.lit(" has the latest value; it stands before "), others, F.lit(".")))
        .when(F.col("decided_by") == "completeness", F.concat(F.col("source"), F.lit(" has the most complete value; it stands before "), others, F.lit(".")))
        .when(F.col("decided_by") == "frequency", F.concat(F.col("source"), F.lit(" has the commonest value; it stands before "), others, F.lit(".")))
        .otherwise(F.concat(F.col("source"), F.lit(" comes first by name among equals.")))
    )
    return survived.select(*GROUP, text.alias("why"))
