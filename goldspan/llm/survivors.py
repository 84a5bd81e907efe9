"""One surviving value per attribute of each duplicate group, and how far the sources can be trusted.

``survivors`` ranks the members of a group for each attribute by the strategies
that a trust table lists. ``source_quality`` and ``true_values`` are the latent
model: every distinct value of an attribute in a group is a claim that is true or
false; a source that speaks about the attribute asserts the claim or passes it
over. Each source's sensitivity (how often it asserts true claims) and
specificity (how often it passes over false ones) come from
expectation-maximisation, and an attribute keeps every value judged true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldspan.functions import standard as std
from goldspan.runtime import Workspace

#: Rank of a source that the trust table doesn't name for an attribute.
UNTRUSTED = 1_000_000
LAST = (1 << 63) - 1


def offered(members: DataFrame) -> DataFrame:
    """Every value that says something, one row for each member and attribute."""
    rows = members.where("master_id is not null").select(
        "master_id", "entity", "source_system", "source_key", "occurred_at", "landing_seq",
        F.explode(F.map_entries("member_values")).alias("e"),
    )
    rows = rows.select("*", F.col("e.key").alias("attr_name"), F.col("e.value").alias("value")).drop("e")
    iso = std.iso_date("value", F.col("source_system").isin(*std.DAY_FIRST_SOURCES))
    dated = F.col("attr_name") == "birth_date"
    return rows.where(std.says_something("value") & ~(dated & std.is_placeholder_date(iso, F.col("source_system"))))


def _rules(trust: DataFrame) -> DataFrame:
    """The strategies of each attribute in order, and the ranks of its sources."""
    return trust.groupBy("entity", "attr_name").agg(
        F.split(F.regexp_replace(F.min("strategies"), r"\s", ""), ",").alias("order"),
        F.map_from_entries(F.collect_list(F.struct("source_system", "trust"))).alias("ranks"),
    )


def _keys() -> Column:
    """The sort key of a member: two numbers for each strategy of the list in turn, smaller first."""
    last, none = F.lit(LAST), F.lit(0).cast("bigint")
    trusted = F.coalesce(F.col("ranks")[F.col("source_system")].cast("bigint"), F.lit(UNTRUSTED).cast("bigint"))
    bare_year = F.col("value").rlike(r"^\s*\d{4}\s*$").cast("bigint")

    def key(name: Column) -> Column:
        first = F.when(name == "source_trust", trusted).when(name == "recency", F.coalesce(-F.unix_micros("occurred_at"), last)).when(name == "completeness", bare_year)
        return F.struct(first.otherwise(none).alias("first"), F.when(name == "recency", F.coalesce(-F.col("landing_seq"), last)).otherwise(none).alias("then"))

    return F.transform("order", key)


def survivors(members: DataFrame, trust: DataFrame) -> DataFrame:
    """master_id, attr_name, source_system, source_key and value of each surviving value.

    One row for each group and each attribute listed in ``trust`` for its entity
    for which some member has a value that says something. Members rank by the
    strategies, then by source_system and source_key. A null moment or landing_seq
    ranks last, a source without a trust row after all that have one. A group whose
    members say nothing has no row; a null map offers nothing; rows without a
    master_id are left out; repeated rows change nothing. The best member is a
    minimum, formed in part before the shuffle, so a group may be of any size.
    """
    found = offered(members).join(_rules(trust), ["entity", "attr_name"])
    best = found.groupBy("master_id", "attr_name").agg(
        F.min(F.struct(_keys().alias("keys"), "source_system", "source_key", "value")).alias("best")
    )
    return best.select("master_id", "attr_name", "best.source_system", "best.source_key", "best.value")


def _claims(members: DataFrame, trust: DataFrame) -> DataFrame:
    """One row for each group, attribute and distinct value: the sources that assert it and those that speak otherwise."""
    iso = std.iso_date("value", F.col("source_system").isin(*std.DAY_FIRST_SOURCES))
    plain = F.when(F.col("attr_name") == "birth_date", F.coalesce(iso, "value"))
    plain = plain.when(F.col("attr_name") == "phone", F.coalesce(std.phone_e164("value"), "value"))
    plain = plain.when(F.col("attr_name") == "postcode", std.postcode("value")).otherwise(std.fold("value", python=False))
    rows = offered(members).join(_rules(trust).select("entity", "attr_name"), ["entity", "attr_name"])
    rows = rows.withColumn("folded", F.coalesce(plain, F.col("value")))
    told = rows.groupBy("master_id", "entity", "attr_name", "folded").agg(
        F.array_sort(F.collect_set("source_system")).alias("yes"), F.min("value").alias("value")
    )
    spoke = rows.groupBy("master_id", "attr_name").agg(F.array_sort(F.collect_set("source_system")).alias("all"))
    return told.join(spoke, ["master_id", "attr_name"]).withColumn("no", F.array_except("all", "yes")).drop("all")


def _scores(quality: dict[tuple[str, str, str], tuple[float, float]], prior: dict[tuple[str, str], float], claims: DataFrame) -> DataFrame:
    """claims with the chance t that each is true; the quality of sources goes along as a map for each attribute, a row for each line of the trust table."""
    per: dict[tuple[str, str], tuple[dict[str, float], dict[str, float]]] = {}
    for (entity, attr, source), (sens, spec) in quality.items():
        ups, downs = per.setdefault((entity, attr), ({}, {}))
        ups[source], downs[source] = math.log(sens / (1 - spec)), math.log((1 - sens) / spec)
    rows = [(e, a, ups, downs, math.log(prior[e, a] / (1 - prior[e, a]))) for (e, a), (ups, downs) in sorted(per.items())]
    told = claims.sparkSession.createDataFrame(rows, "entity string, attr_name string, ups map<string,double>, downs map<string,double>, base double")
    add = lambda arr, m: F.aggregate(arr, F.lit(0.0), lambda a, s: a + F.coalesce(F.col(m)[s], F.lit(0.0)))
    logit = F.col("base") + add(F.col("yes"), "ups") + add(F.col("no"), "downs")
    return claims.join(F.broadcast(told), ["entity", "attr_name"]).withColumn("t", 1 / (1 + F.exp(-logit))).drop("ups", "downs", "base")


def _fit(claims: DataFrame, rounds: int = 30) -> tuple[dict[tuple[str, str, str], tuple[float, float]], dict[tuple[str, str], float]]:
    """Sensitivity and specificity by (entity, attr, source), and prior by (entity, attr).

    Claims shrink to distinct patterns of asserting and passing sources with
    counts. Both steps of a round are aggregates over the patterns, however many
    there are; only the sources' sums come to the driver, one row each.
    """
    space = Workspace(claims.sparkSession, "survivors")
    patterns = space.save(claims.groupBy("entity", "attr_name", "yes", "no").agg(F.count(F.lit(1)).alias("n")), "patterns")
    known = patterns.select("entity", "attr_name", F.explode(F.array_union("yes", "no")).alias("s")).distinct().collect()
    quality = {(r.entity, r.attr_name, r.s): (0.8, 0.8) for r in known}
    prior = {(r.entity, r.attr_name): 0.5 for r in known}
    said = F.concat(F.transform("yes", lambda s: F.struct(s.alias("s"), F.lit(1.0).alias("y"))), F.transform("no", lambda s: F.struct(s.alias("s"), F.lit(0.0).alias("y"))), F.array(F.struct(F.lit(None).cast("string").alias("s"), F.lit(1.0).alias("y"))))
    for _ in range(rounds if known else 0):
        sums = _scores(quality, prior, patterns).withColumn("x", F.explode(said)).groupBy("entity", "attr_name", "x.s").agg(
            F.sum(F.col("t") * F.col("n") * F.col("x.y")).alias("said_true"), F.sum(F.col("t") * F.col("n")).alias("true"),
            F.sum((1 - F.col("t")) * F.col("n") * (1 - F.col("x.y"))).alias("passed_false"), F.sum((1 - F.col("t")) * F.col("n")).alias("false"),
        ).collect()
        moved = 0.0
        for r in sums:
            if r.s is None:  # of all claims
                prior[r.entity, r.attr_name] = min(0.99, max(0.01, r.true / (r.true + r.false)))
                continue
            # A claim that several sources assert is likelier true than one that a single source does: sensitivity stays over 1 - specificity.
            spec = min(0.999, max(0.5, (1 + r.passed_false) / (2 + r.false)))
            sens = min(0.999, max(1 - spec + 0.01, (1 + r.said_true) / (2 + r.true)))
            moved = max(moved, abs(sens - quality[r.entity, r.attr_name, r.s][0]))
            quality[r.entity, r.attr_name, r.s] = sens, spec
        if moved < 1e-4:
            break
    return quality, prior


QUALITY = "entity string, attr_name string, source_system string, sensitivity double, specificity double, prior double"


def source_quality(members: DataFrame, trust: DataFrame) -> DataFrame:
    """entity, attr_name, source_system, sensitivity, specificity and prior, fitted over all groups; empty for no claims."""
    quality, prior = _fit(_claims(members, trust))
    return members.sparkSession.createDataFrame([(*k, *v, prior[k[:2]]) for k, v in sorted(quality.items())], QUALITY)


def true_values(members: DataFrame, trust: DataFrame, least: float = 0.5) -> DataFrame:
    """master_id, attr_name, value and p_true of every value judged true; several per attribute where several are."""
    claims = _claims(members, trust)
    judged = _scores(*_fit(claims), claims).withColumn("p_true", F.round("t", 6))
    return judged.where(F.col("p_true") >= least).select("master_id", "attr_name", "value", "p_true")
