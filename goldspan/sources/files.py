"""Tables and streams from parquet files, and typed columns from JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over parquet at ``path``: a file, a folder of files, or a folder of such folders; the pace is files per trigger."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if not fs.getFileStatus(fs_path).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)
    inner = any(s.isDirectory() for s in fs.listStatus(fs_path))
    pattern = f"{path}/*" if inner else path
    return reader.schema(spark.read.parquet(pattern).schema).parquet(pattern)


def payload_columns(payload: Column | str, attributes: dict[str, str]) -> list[Column]:
    """A column for each attribute of a JSON object, by its type (text, integer, number, boolean, or a DDL type for groups); null where it isn't there or can't be read."""
    kinds = {"text": "string", "reference": "string", "date": "string", "timestamp": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
    v = F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)
    return [F.try_variant_get(v, f"$.{name}", kinds.get(kind, kind)).alias(name) for name, kind in attributes.items()]
