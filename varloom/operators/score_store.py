"""Score tables laid out for lookups: a query reads the partitions that it touches, not the table.

Rows are partitioned by contig and bin of `width` bases and sorted by place within files, so that statistics of row groups narrow a bin further. The
touched bins of a query set are at most those of the layout (some 750 for a genome at 4 Mi bases), whatever the number of queries, which is why the
driver may hold them: they become partition filters, and the range of positions within each bin is pushed to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.operators import scores as S

#: Bins up to this number are filtered with their ranges of positions, up to the other by themselves; positions outside of any genome could make more.
RANGED, LISTED = 200, 20_000


def contig(chrom: Column) -> Column:
    """The partition of a chromosome; never a number, which readers would take for an integer."""
    return F.concat(F.lit("c_"), A.chromosome(chrom))


def with_place(rows: DataFrame, width: int, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    return rows.withColumns({"contig": contig(F.col(chrom)), "bin": F.floor(F.col(pos) / width).cast("int")})


def write_placed(rows: DataFrame, path: str, pos: str = "pos", mode: str = "overwrite") -> None:
    """rows (contig, bin, pos) by range of place: a crowded bin is dealt to several tasks, a task writes neighbouring bins only."""
    rows.repartitionByRange("contig", "bin", pos).sortWithinPartitions("contig", "bin", pos).write.mode(mode).partitionBy("contig", "bin").parquet(path)


def touched(places: DataFrame, pos: str = "pos") -> Column | None:
    """A condition on contig, bin and pos that holds for every row of places (contig, bin, pos); None for too many bins."""
    at = places.filter(F.col("bin").isNotNull() & F.col("contig").isNotNull()).groupBy("contig", "bin").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi")).limit(LISTED + 1).collect()
    if len(at) > LISTED:
        return None
    if len(at) <= RANGED:
        return reduce(lambda a, b: a | b, [(F.col("contig") == r.contig) & (F.col("bin") == r.bin) & F.col(pos).between(r.lo, r.hi) for r in at], F.lit(False))
    return F.concat_ws("/", "contig", "bin").isin([f"{r.contig}/{r.bin}" for r in at])


class ScoreStore:
    """A published score table under path: chrom, pos, ref, alt, dimensions and outputs."""

    def __init__(self, spark: SparkSession, path: str, width: int = 1 << 22):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def publish(self, scores: DataFrame) -> None:
        """Write scores (chrom in any spelling, pos, ref, alt and others)."""
        write_placed(with_place(scores, self.width).withColumn("chrom", A.chromosome(F.col("chrom"))), self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def near(self, queries: DataFrame) -> DataFrame:
        """The stored rows in the touched bins and ranges of queries (chrom, pos)."""
        condition = touched(with_place(queries.select("chrom", "pos"), self.width))
        return self.read() if condition is None else self.read().filter(condition)

    def lookup(self, queries: DataFrame, spec: S.ScoreSpec) -> DataFrame:
        """`scores.lookup` of queries (chrom, pos, ref, alt and dimensions) against the store; alleles are compared as stored."""
        asked = queries.withColumn("chrom", A.chromosome(F.col("chrom")))
        return S.lookup(asked, self.near(queries).drop("contig", "bin"), spec)
