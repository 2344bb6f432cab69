"""Hot keys are dealt over all partitions, without AQE's help."""

import pytest
from pyspark.sql import functions as F

from varloom.llm import common


@pytest.fixture
def without_aqe(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "8", "-1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hot_key_and_nulls_are_split(spark, without_aqe):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    rows = spark.range(60_000).select("id", key.alias("key"))
    stats = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = common.attach_stats(rows, stats, "key", "n", 40_000, ["id"])
    out.cache()
    sizes = sorted(r.rows for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows")).collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    out.unpersist()
    want = {r.key: (r.n, r.least) for r in stats.collect()}
    got = out.collect()
    assert len(got) == 60_000 and all((r.n, r.least) == want.get(r.key, (None, None)) for r in got)


def test_rows_are_dealt_by_key_and_salt(spark, without_aqe):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("key"))
    stats = rows.groupBy("key").agg(F.count("*").alias("n"))
    plan = common.attach_stats(rows, stats, "key", "n", 1000, ["id"])._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning(key#" in x and "_vl_salt" in x]
    assert dealt, plan


def test_wide_stats_of_a_hot_key_are_dealt_and_not_broadcast(spark, without_aqe):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    rows = spark.range(60_000).select("id", key.alias("key"))
    stats = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, 50).alias("ids"))
    out = common.attach_wide(rows, stats, "key", "n", 40_000, ["id"]).cache()
    sizes = sorted(r.rows for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows")).collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    want = {r.key: (r.n, r.ids) for r in stats.collect()}
    got = out.collect()
    out.unpersist()
    assert len(got) == 60_000 and all((r.n, r.ids) == want.get(r.key, (None, None)) for r in got)
