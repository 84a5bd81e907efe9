"""Profile of a table's columns: filled and distinct cells, lengths, commonest values and patterns.

Cells shrink to distinct values with counts before anything else; the ten
commonest are cut in every task before they meet. Blank text isn't filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldspan.functions import keys as K


def cells(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """attr, v (text, null for null or blank) and n of every distinct value of every column, by one pass over the rows."""
    text = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    each = F.array(*(F.struct(F.lit(a).alias("attr"), text(a).alias("v")) for a in attributes))
    return rows.select(F.explode(each).alias("x")).select("x.*").groupBy("attr", "v").agg(F.count(F.lit(1)).alias("n"))


def attributes(counted: DataFrame) -> DataFrame:
    """attr, filled, empty, distincts, shortest and longest."""
    has = F.col("v").isNotNull()
    return counted.groupBy("attr").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("empty"), F.count("v").alias("distincts"),
        F.min(F.length("v")).alias("shortest"), F.max(F.length("v")).alias("longest"),
    )


def _first(counts: DataFrame, value: str, most: int) -> DataFrame:
    w = Window.partitionBy("attr").orderBy(F.desc("n"), value)
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def top_values(counted: DataFrame, most: int = 10) -> DataFrame:
    """attr, v and n of the commonest values, of equally common ones the smaller."""
    return _first(counted.where("v is not null"), "v", most)


def top_patterns(counted: DataFrame, most: int = 10) -> DataFrame:
    """attr, pattern and n of the commonest patterns."""
    return _first(counted.where("v is not null").groupBy("attr", K.pattern_of("v").alias("pattern")).agg(F.sum("n").alias("n")), "pattern", most)
