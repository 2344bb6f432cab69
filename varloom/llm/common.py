"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows counts as heavy, so that there are at most 1/HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their path has it as the driver's has.

    For sessions that were started elsewhere and find the package by sys.path alone.
    """
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    path = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in path or Path.cwd().resolve() == root:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "varloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "varloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests), and else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_kept: ContextVar[list[str] | None] = ContextVar("varloom_scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/varloom-{name}-{uuid.uuid4().hex}"
    if _kept.get() is not None:
        _kept.get().append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """All that operators write to the shared folder within goes at its end: results must have been written elsewhere by then."""
    before = _kept.set([])
    try:
        yield
    finally:
        paths = _kept.get()
        _kept.reset(before)
        for path in paths:
            delete(spark, path)


class Tables:
    """Tables that one operator writes to the shared folder on its way, to be dropped together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def write(self, df: DataFrame, name: str, codec: str = "snappy", keep: bool = False) -> DataFrame:
        """df, written and read back: later steps start from files that outlive an executor. keep: `drop` leaves it."""
        path = scratch_path(self.spark, name)
        df.write.option("compression", codec).parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str, codec: str = "snappy") -> DataFrame:
        """df as a table bucketed by key, one bucket a shuffle partition: joins on key read it without moving it again.

        df should come from a grouping by key, so that its tasks hold whole buckets and write a file for each.
        """
        table = f"varloom_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", codec).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        for path in self.paths:
            delete(self.spark, path)
        self.paths, self.names = [], []


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files that outlive an executor."""
    return Tables(df.sparkSession).write(df, name, codec)


def plain_text(name: str = "text") -> Column:
    """The text column as it is, a null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def attach_stats(rows: DataFrame, stats: DataFrame, key: str, size: str, total: int, spread: list[str]) -> DataFrame:
    """Left join of rows with stats (one row a key, which holds the key's row count in column `size`).

    A key may hold a third of all rows, and one task must not get them all. Keys with at least HEAVY_SHARE of
    `total` rows are at most 1/HEAVY_SHARE in number, whatever the input: these few rows are broadcast. All others
    meet in a shuffle join, from which rows of heavy keys stay away by a salt drawn from the columns `spread`.
    Null keys find no partner. Columns of stats should be narrow, as up to 1/HEAVY_SHARE rows of them are broadcast.

    The salt is part of the join's key, so that rows are dealt by (key, salt): the heavy ones fall into all partitions.
    On the other side it is 0 for every key, but written as a remainder by 1 of the key's hash; as a literal the
    optimizer would turn it into a filter and deal rows by the key alone.
    """
    at_least = max(2, int(total * HEAVY_SHARE))
    heavy = stats.filter(F.col(size) >= at_least)
    light = stats.filter(F.col(size) < at_least)
    names = [c for c in stats.columns if c != key]
    out = rows.join(F.broadcast(heavy.select(F.col(key).alias("_vl_k"), *[F.col(c).alias(f"_vl_h_{c}") for c in names])), F.col(key) == F.col("_vl_k"), "left")
    loose = F.col("_vl_k").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_vl_salt", F.when(loose, F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(4096))).otherwise(F.lit(0)))
    light = light.select(F.col(key).alias("_vl_lk"), F.pmod(F.xxhash64(key), F.lit(1)).cast("long").alias("_vl_ls"), *[F.col(c).alias(f"_vl_l_{c}") for c in names])
    out = out.join(light, (F.col(key) == F.col("_vl_lk")) & (F.col("_vl_salt") == F.col("_vl_ls")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_vl_h_{c}", f"_vl_l_{c}").alias(c) for c in names])


#: Into how many tasks the rows of a heavy key are dealt by attach_wide.
WAYS = 32


def attach_wide(rows: DataFrame, stats: DataFrame, key: str, size: str, total: int, spread: list[str]) -> DataFrame:
    """As attach_stats, for stats of any width: of heavy keys only the keys are broadcast, and their rows of stats are dealt WAYS times by a salt."""
    at_least = max(2, int(total * HEAVY_SHARE))
    heavy = stats.filter(F.col(size) >= at_least).select(F.col(key).alias("_vl_k"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_vl_k"), "left")
    deal = F.pmod(F.xxhash64(*spread), F.lit(WAYS))
    out = out.withColumn("_vl_salt", F.when(F.col("_vl_k").isNotNull() | F.col(key).isNull(), deal).otherwise(F.lit(0)))
    names = [c for c in stats.columns if c != key]
    salts = F.when(F.col(size) >= at_least, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    each = stats.select(F.col(key).alias("_vl_lk"), F.explode(salts.cast("array<bigint>")).alias("_vl_ls"), *[F.col(c).alias(f"_vl_w_{c}") for c in names])
    out = out.join(each, (F.col(key) == F.col("_vl_lk")) & (F.col("_vl_salt") == F.col("_vl_ls")), "left")
    return out.select(*rows.columns, *[F.col(f"_vl_w_{c}").alias(c) for c in names])


def total_of(stats: DataFrame, size: str) -> int:
    return int(stats.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
