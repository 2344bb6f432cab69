"""A cohort's published tables, keyed for searches by region, variant key and rsID.

Sites, annotations and calls all carry their site's contig, bin and position and are partitioned by the first two; a second table leads from an rsID to places,
partitioned by the rsID's hash and sorted by it. A region search prunes all three tables by the same filters. A search by
keys and rsIDs is the union of two pruned lookups, by place and key in the one table and by hash and rsID in the other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import cohort as H
from varloom.operators import score_store as P

RSID_PARTS = 64
KEY = re.compile(r"^(?:CHR)?([^:]+):(\d+):([^:]*):([^:]*)$")


class CohortStore:
    def __init__(self, spark: SparkSession, path: str, width: int = 1 << 20):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def publish(self, sites: DataFrame, annotations: DataFrame, calls: DataFrame) -> None:
        """Write the tables of sites (chrom, pos, ref, alt, and rsid if known), annotations and calls (both by site_id)."""
        keyed = P.with_place(H.keyed_sites(sites), self.width).withColumn("key", F.upper("variant_key"))
        P.write_placed(keyed, f"{self.path}/sites")
        sites = self._read("sites")
        if "rsid" in sites.columns:
            names = sites.filter("rsid IS NOT NULL").select(F.upper("rsid").alias("rsid"), "site_id", "contig", "bin", "pos")
            names = names.withColumn("part", F.pmod(F.xxhash64("rsid"), F.lit(RSID_PARTS)).cast("int"))
            names.repartitionByRange("part", "rsid").sortWithinPartitions("part", "rsid").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rsids")
        place = sites.select("site_id", "contig", "bin", "pos")
        for name, rows in (("annotations", annotations), ("calls", calls)):
            P.write_placed(rows.join(place, "site_id"), f"{self.path}/{name}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def _region(self, rows: DataFrame, q: H.CohortQuery) -> DataFrame:
        here = (F.col("contig") == f"c_{q.chrom}") & F.col("bin").between(q.start // self.width, q.end // self.width)
        return rows.filter(here & F.col("pos").between(q.start, q.end))

    def by_key(self, keys: tuple[str, ...]) -> DataFrame:
        """Sites of variant keys: contig, bin, pos and key are filters of the scan."""
        found = [(m[1], int(m[2])) for m in map(KEY.match, (k.upper() for k in keys)) if m]
        sites = self._read("sites")
        here = F.col("contig").isin(sorted({f"c_{c}" for c, _ in found})) & F.col("bin").isin(sorted({p // self.width for _, p in found}))
        return sites.filter(here & F.col("pos").isin(sorted({p for _, p in found})) & F.col("key").isin(sorted({re.sub("^CHR", "", k.upper()) for k in keys})))

    def by_rsid(self, ids: tuple[str, ...]) -> DataFrame:
        """Sites of rsIDs, through their own table: the hash is a partition filter, the rsID a filter of the scan; then sites by place."""
        sites = self._read("sites")
        if "rsid" not in sites.columns:
            return sites.limit(0)
        wanted = sorted({k.upper() for k in ids})
        parts = [r[0] for r in self.spark.createDataFrame([(k,) for k in wanted], "k string").select(F.pmod(F.xxhash64("k"), F.lit(RSID_PARTS)).cast("int")).distinct().collect()]
        names = self._read("rsids").filter(F.col("part").isin(parts) & F.col("rsid").isin(wanted)).select("contig", "bin", "pos", "site_id")
        condition = P.touched(names)
        near = sites if condition is None else sites.filter(condition)
        return near.join(names.select("site_id").distinct(), "site_id", "left_semi")

    def matched(self, q: H.CohortQuery) -> DataFrame:
        """The sites that a query is about; a site that both lookups find is there once."""
        if q.mode == "variant":
            both = self.by_key(q.keys).unionByName(self.by_rsid(q.keys))
            return both.dropDuplicates(["site_id"])
        return self._region(self._read("sites"), q) if q.mode == "region" else self._read("sites")

    def search(self, files: DataFrame, q: H.CohortQuery, individuals: DataFrame | None = None) -> DataFrame:
        """`cohort.search` on the published tables: annotations and calls are read where the matched sites lie."""
        matched, tables = self.matched(q), [self._read("annotations"), self._read("calls")]
        if q.mode == "region":
            tables = [self._region(t, q) for t in tables]
        elif q.mode == "variant":
            condition = P.touched(matched.select("contig", "bin", "pos"))
            tables = tables if condition is None else [t.filter(condition) for t in tables]
        annotations, calls = [t.drop("contig", "bin", "pos") for t in tables]
        return H.search_matched(matched.drop("contig", "bin", "key", "rsid"), annotations, calls, files, q, individuals)
