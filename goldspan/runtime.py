"""Session-level helpers: the shared folder, materialised intermediates, input spreading.

Intermediates that are read more than once, or that end an iteration's lineage,
are written as parquet under the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees it, so the loss of an executor
loses nothing. Where that setting is absent, only a session on one machine
(master ``local``) may use a folder of its own; on a cluster it is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is set and everything runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="goldspan-")
    return _own_dirs[app]


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _table_name(path: str) -> str:
    return "goldspan_" + hashlib.sha256(path.encode()).hexdigest()[:24]


class Workspace:
    """A private directory in the shared folder for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/goldspan/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._saved: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{uuid.uuid4().hex[:6]}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write df and return a reader of the written table, its lineage cut."""
        path = self.path(name)
        out = self.read(self.write(df, path, partition_by), df.schema)
        self._saved.setdefault(name, []).append(path)
        return out

    def clear(self, *names: str) -> None:
        """Delete all that save() wrote under these names, once nothing reads it any more."""
        for name in names:
            for path in self._saved.pop(name, []):
                self.delete(path)

    def write(self, df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def write_sorted(self, df: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int) -> str:
        """Write df in ``buckets`` files, one for each hash of ``keys``, each sorted by keys and order."""
        name = _table_name(path)
        cut = df.repartition(buckets, *keys)
        writer = cut.write.format("parquet").option("compression", "zstd").option("path", path)
        writer.bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files are the caller's
        return path

    def read_sorted(self, paths: list[str], schema: StructType, keys: tuple[str, ...], order: tuple[str, ...], buckets: int) -> DataFrame:
        """What write_sorted wrote to several paths, as one table of a partition each: a task reads one bucket of all, so grouping by keys needs no exchange."""
        name = _table_name("|".join(paths))
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            by, sort = ", ".join(keys), ", ".join((*keys, *order))
            self.spark.sql(f"CREATE TABLE {name} ({columns}, _run int) USING parquet PARTITIONED BY (_run) CLUSTERED BY ({by}) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{self.root}/none'")
            for k, path in enumerate(paths):
                self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (_run={k}) LOCATION '{path}'")
        return self.spark.table(name).drop("_run")

    def delete(self, path: str) -> None:
        fs, jpath = _path(self.spark, path)
        fs.delete(jpath, True)

    def read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._goldspan_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that save() wrote, once nothing reads it any more."""
        path = getattr(df, "_goldspan_path", None)
        if path:
            self.delete(path)


class Manifest:
    """Numbered JSON files; each is created whole under a new number, never replaced.

    A reader takes the largest number. Creating refuses to overwrite, so of two
    writers that start from one version only one commits: the switch is atomic.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self) -> list[int]:
        fs, folder = _path(self.spark, self.root)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        found = self.versions()
        if not found:
            return 0, {}
        fs, path = _path(self.spark, f"{self.root}/manifest-{found[-1]:08d}.json")
        stream = fs.open(path)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found[-1], json.loads(raw)

    def commit(self, base: int, content: dict) -> int:
        """Publish content as version base + 1; fails when that version exists already."""
        body = bytearray(json.dumps(content, sort_keys=True).encode())
        fs, final = _path(self.spark, f"{self.root}/manifest-{base + 1:08d}.json")
        if fs.exists(final):
            raise RuntimeError(f"version {base + 1} of {self.root} was committed by another writer")
        _, draft = _path(self.spark, f"{self.root}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(body)
        stream.close()
        if not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {base + 1} of {self.root} could not be committed")
        return base + 1


def spread(df: DataFrame, cpu_heavy: bool = True) -> DataFrame:
    """Round-robin a file scan over all cores where it has fewer splits than the cluster has cores.

    For per-row CPU work on a scan. Large inputs have more splits than cores
    and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not cpu_heavy:
        return df
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    size = sum(_file_bytes(spark, f) for f in files)
    return df.repartition(cores) if size < split * cores else df


def _file_bytes(spark: SparkSession, path: str) -> int:
    fs, jpath = _path(spark, path)
    return fs.getFileStatus(jpath).getLen()


#: Rows of one key that one task may join; keys with more are joined by broadcast, there being at most a ten-millionth of all rows such keys.
HEAVY = 10_000_000


def join_one(left: DataFrame, right: DataFrame, on: list[str], rows: str, heavy: int | None = None) -> DataFrame:
    """Inner join with ``right``, saved and unique in ``on``, of which ``rows`` counts the rows of left that carry the key.

    A hot key never meets in one task: the few keys of more than ``heavy`` rows
    are broadcast. The result is the same as that of a plain join.
    """
    limit = HEAVY if heavy is None else heavy
    light = left.join(right.where(F.col(rows) <= limit).drop(rows), on)
    hot = right.where(F.col(rows) > limit).drop(rows)
    return light if hot.isEmpty() else light.unionByName(left.join(F.broadcast(hot), on))


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows with their place, from 1, in the order of columns that tell them apart: ranges are sorted apart and counted up, one row for each range."""
    space = Workspace(rows.sparkSession, "numbered")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = space.save(placed, "placed")
    sizes, before = {}, 0
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # a row for each range
        sizes[r["_part"]], before = before, before + r.n
    at = rows.sparkSession.createDataFrame(sorted(sizes.items()), "_part int, _first bigint")
    return placed.join(F.broadcast(at), "_part").withColumn(name, F.col("_first") + F.col("_pos") + 1).drop("_part", "_pos", "_first")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
