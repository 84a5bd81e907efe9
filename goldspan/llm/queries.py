"""The queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.llm import addresses, components, garbled, matching, mixture, survivors, tokens
from goldspan.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("entity", "left_rec", "right_rec")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.all_matches(table(spark, sf_dir, "person_records"), table(spark, sf_dir, "organisation_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = survivors.survivors(table(spark, sf_dir, "group_members"), table(spark, sf_dir, "source_trust"))
    return best.select("master_id", "attr_name", "source_system", "source_key")


def p4_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.source_quality(table(spark, sf_dir, "group_members"), table(spark, sf_dir, "source_trust"))


def p4_true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.true_values(table(spark, sf_dir, "group_members"), table(spark, sf_dir, "source_trust"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_location(table(spark, sf_dir, "postal_addresses"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = components.linked(table(spark, sf_dir, "pair_scores"))
    return components.groups(nodes, links).select(F.col("scope").alias("entity"), "rec", "group_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, shares = mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return uses.join(shares.select("source", "target_share", "actual_share"), "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.judged(table(spark, sf_dir, "documents")).where("damaged").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.judged(table(spark, sf_dir, "documents")).where("damaged").drop("damaged")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_matches, p4_found, p4_source_quality, p4_true_values, p5_found, p7_found, p8_ids, p9_mix, p9_shares, p10_found, p10_restored)
    return {f.__name__: f for f in own}
