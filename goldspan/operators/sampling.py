"""Samples, shares and breakers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldspan.runtime import numbered


def wilson_upper(agreed: Column, n: Column, z: float = 1.645) -> Column:
    """Upper bound of a share by Wilson's score."""
    p = agreed / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (middle + spread) / (1 + z * z / n)


def agreement(reviews: DataFrame, by: list[str], agreed: str) -> DataFrame:
    out = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(agreed).cast("bigint")).alias("agreed"))
    return out.withColumn("upper", F.round(wilson_upper(F.col("agreed"), F.col("n")), 6))


def breaker(reviews: DataFrame, by: list[str], order: list[Column], agreed: str, window: int = 100, least: int = 20, threshold: float = 0.95) -> DataFrame:
    """Agreement among the newest ``window`` reviews of each group; tripped where at least ``least`` are so bad that chance is no excuse."""
    newest = reviews.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= window)
    return agreement(newest, by, agreed).withColumn("tripped", (F.col("n") >= least) & (F.col("upper") < threshold))


def allocation(strata: DataFrame, total: int) -> DataFrame:
    """stratum, n and take: shares of ``total`` by size, the largest remainders rounded up, one at least and never more than n.

    ``strata`` is a row for each stratum, so the window over all of them is small.
    """
    w = Window.orderBy(F.lit(1))
    out = strata.withColumn("exact", F.col("n") * F.lit(float(total)) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("base", F.floor("exact")).withColumn("rest", F.col("exact") - F.col("base"))
    left = F.lit(total) - F.sum("base").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("left", left).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rest"), "stratum")))
    take = F.greatest(F.lit(1), F.col("base") + (F.col("rn") <= F.col("left")).cast("bigint"))
    return out.select("stratum", "n", F.least(F.col("n"), take).alias("take"))


def draw(items: DataFrame, taken: DataFrame, order: list[Column]) -> DataFrame:
    """The first ``take`` items of each stratum by their draw numbers; a task keeps no more than the largest take of each before they meet."""
    most = taken.agg(F.max("take")).first()[0] or 0
    first = items.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).where(F.col("rn") <= most)
    return first.join(F.broadcast(taken.select("stratum", "take")), "stratum").where("rn <= take").drop("rn", "take")  # a row for each stratum


def review_draw(items: DataFrame, by: list[str], order: list[str], share: float) -> DataFrame:
    """The first share of each group, rounded up and one at least, by draw numbers ``order``, which tell items apart.

    Items are put in one order of group and draw number, in ranges: a group of any size spreads over many tasks.
    """
    placed = numbered(items, [*by, *order], "_n")
    groups = placed.groupBy(*by).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    joined = placed.alias("i").join(F.broadcast(groups.alias("g")), same)  # a row for each group of reviews
    kept = joined.where(F.col("_n") - F.col("_first") < F.greatest(F.lit(1), F.ceil(F.round(F.col("_size") * F.lit(share), 9))))
    return kept.select(*(F.col(f"i.{c}") for c in items.columns))


def capped_sample(drawn: DataFrame, by: list[str], order: list[str], open_now: DataFrame, cap: int) -> DataFrame:
    """Of newly drawn samples those for which there is room: ``cap`` less what is open (by columns and n), in landing order."""
    room = open_now.select(*by, (F.lit(cap) - F.col("n")).alias("_room"))
    first = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= cap)
    return first.join(F.broadcast(room), by, "left").where(F.col("_rn") <= F.coalesce("_room", F.lit(cap))).drop("_rn", "_room")  # a row for each group


def pack(items: DataFrame, by: str, order: str, target: str, rows: int, targets: int) -> DataFrame:
    """chunk of each item: chunks in order, each with at most ``rows`` items and ``targets`` distinct targets.

    The order decides, so each group (a batch of at most some thousand items) is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        chunk, n, held, out = 0, 0, set(), []
        for t in pdf[target]:
            if n >= rows or (t not in held and len(held) >= targets):
                chunk, n, held = chunk + 1, 0, set()
            n += 1
            held.add(t)
            out.append(chunk)
        return pdf.assign(chunk=out)[[by, order, target, "chunk"]]

    kinds = dict(items.dtypes)
    return items.select(by, order, target).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {target} {kinds[target]}, chunk int")
