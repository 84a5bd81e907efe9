"""Code lists, loaded in versions that never change, and snapshots of the versions in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.runtime import Manifest, Workspace

CODES = "list_name string, code string, label string, version bigint"


class CodeLists:
    """Lists under one folder; a load is published whole or not at all.

    Codes without a name or list are left out; of a code's rows in one load the
    one with the smallest label counts. A list that a load doesn't name keeps the
    version it has.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.space = Workspace(spark, "codes", root)
        self.spark, self.manifest = spark, Manifest(spark, self.space.root)

    def load(self, codes: DataFrame, version: int) -> None:
        base, held = self.manifest.latest()
        rows = codes.where("list_name is not null and code is not null").groupBy("list_name", "code").agg(F.min("label").alias("label"))
        path = self.space.write(rows.withColumn("version", F.lit(version).cast("bigint")), self.space.path("codes"))
        self.manifest.commit(base, {"loads": [*held.get("loads", []), path]})

    def snapshot(self, names: list[str] | None = None, upto: int | None = None) -> DataFrame:
        """list_name, version, code and label of each list's last version (not beyond ``upto``)."""
        paths = self.manifest.latest()[1].get("loads", [])
        rows = self.spark.read.schema(CODES).parquet(*paths) if paths else self.spark.createDataFrame([], CODES)
        if names is not None:
            rows = rows.where(F.col("list_name").isin(*names))
        if upto is not None:
            rows = rows.where(F.col("version") <= upto)
        last = rows.groupBy("list_name").agg(F.max("version").alias("version"))
        return rows.join(F.broadcast(last), ["list_name", "version"]).select("list_name", "version", "code", "label")  # a row for each list
