"""Published score and cohort tables: what is read, and overlap bins of all lengths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from varloom.operators import cohort as H
from varloom.operators import cohort_store as HS
from varloom.operators import intervals as I  # noqa: E741
from varloom.operators import score_store as ST
from varloom.operators import scores as S


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def files_read(df):
    """Number of files that the plan's scan of a published table picks after pruning."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found += p.metrics().apply("numFiles").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
    return found


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(c, p, "A", b, f"T{p % 3}", p % 100) for c in ("1", "chr2", "M") for p in range(1, 40_000, 37) for b in "CG"]
    out = ST.ScoreStore(spark, str(tmp_path_factory.mktemp("store") / "scores"), width=1000)
    out.publish(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, feature string, score int"))
    return out, rows


def test_a_lookup_reads_only_touched_partitions(spark, store):
    table, rows = store
    asked = [("chr1", 38, "A", "C", "T2"), ("1", 1111, "A", "G", "T9"), ("MT", 75, "A", "C", "T0"), ("2", 999_999, "A", "C", "T0"), ("7", 38, "A", "C", "T0"), (None, 38, "A", "C", "T0")]
    queries = spark.createDataFrame(asked, "chrom string, pos int, ref string, alt string, feature string")
    near = table.near(queries)
    assert files_read(near) <= 4 < files_read(table.read())
    plan = plan_of(near)
    assert re.search(r"PartitionFilters: \[.*contig.*bin", plan) and re.search(r"PushedFilters: \[.*pos", plan)
    spec = S.ScoreSpec(("chrom", "pos", "ref", "alt"), ("feature",))
    got = {(r.chrom, r.pos): (r.status, r.score) for r in table.lookup(queries, spec).collect()}
    assert got == {("1", 38): ("exact", 38), ("1", 1111): ("partial", None), ("MT", 75): ("exact", 75), ("2", 999_999): (None, None), ("7", 38): (None, None), (None, 38): (None, None)}


def test_many_bins_are_filtered_as_a_list(spark, store, monkeypatch):
    table, rows = store
    queries = spark.createDataFrame([r[:4] for r in rows if r[0] == "1"], "chrom string, pos int, ref string, alt string")
    monkeypatch.setattr(ST, "RANGED", 3)
    near = table.near(queries)
    assert {r.contig for r in near.select("contig").distinct().collect()} == {"c_1"} and near.count() == sum(r[0] == "1" for r in rows)
    assert files_read(near) < files_read(table.read())
    monkeypatch.setattr(ST, "LISTED", 5)
    assert table.near(queries).count() == len(rows)
    assert table.near(queries.limit(0)).count() == 0


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    sites = spark.createDataFrame([(i, c, 100 + i * 500, "A", "C", f"rs{i % 50}") for i, c in enumerate(["1", "chr2", "X"] * 60)], "site_id long, chrom string, pos int, ref string, alt string, rsid string")
    annotations = sites.select("site_id", F.lit(0).alias("k"), F.lit("G1").alias("gene"), F.lit("T").alias("transcript"), F.lit("HIGH").alias("impact"), F.lit("x").alias("consequence"), F.lit(0.001).alias("popmax"), F.lit(1).alias("mane"), F.lit(0).alias("picked"))
    calls = sites.select(F.lit("S1").alias("sample_id"), "site_id", F.lit("0/1").alias("gt"), F.lit(30).alias("dp"), F.lit(60).cast("long").alias("gq"), F.lit(15).alias("ad_alt"), F.lit("PASS").alias("filter"))
    files = spark.createDataFrame([("S1", 1, "exome", "full")], "sample_id string, file_id int, analysis_scope string, import_profile string")
    out = HS.CohortStore(spark, str(tmp_path_factory.mktemp("cohort") / "c"), width=10_000)
    out.publish(sites, annotations, calls)
    return out, sites, annotations, calls, files


def rows_of(df):
    return sorted((r.variant_key, r.sample_id, r.sample_qualifying_variant_count) for r in df.collect())


def test_a_region_prunes_all_tables(cohort):
    store, sites, annotations, calls, files = cohort
    q = H.CohortQuery("region", chrom="2", start=5_000, end=14_999)
    assert rows_of(store.search(files, q)) == rows_of(H.search(sites, annotations, calls, files, q))
    plan = plan_of(store.matched(q))
    assert re.search(r"PartitionFilters: \[.*contig.*bin", plan) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(pos,5000\).*LessThanOrEqual\(pos,14999\)", plan)
    full = plan_of(store.search(files, q))
    assert len(re.findall(r"PartitionFilters: \[.*contig.*bin", full)) == full.count("PartitionFilters: [") >= 3


def test_keys_and_rsids_are_two_pruned_lookups(cohort):
    store, sites, annotations, calls, files = cohort
    q = H.CohortQuery("variant", keys=("chr2:600:a:c", "RS1", "rs7", "1:1600:A:C", "rs999", "nothing"))
    got = rows_of(store.search(files, q))
    wanted = H.CohortQuery("variant", keys=("2:600:A:C", "RS1", "rs7", "1:1600:A:C"))
    keyed = H.keyed_sites(sites).filter(F.upper("variant_key").isin("2:600:A:C", "1:1600:A:C") | F.upper("rsid").isin("RS1", "RS7"))
    assert [r[0] for r in got] == sorted(r.variant_key for r in keyed.collect()) and wanted.mode == "variant"
    plan = plan_of(store.matched(q))
    assert "Union" in plan and re.search(r"PushedFilters: \[.*In\(key", plan)
    names = plan_of(store.by_rsid(("rs1",)))
    assert re.search(r"PartitionFilters: \[.*part", names) and re.search(r"PushedFilters: \[.*rsid", names)
    assert re.search(r"PartitionFilters: \[.*contig.*bin", plan_of(store.by_key(("2:600:A:C",))))


def mixed(rng, n):
    """Intervals of one base up to a chromosome."""
    out = []
    for i in range(n):
        length = int(2 ** rng.uniform(0, 27))
        start = rng.randint(0, 240_000_000 - length)
        start = start >> 14 << 14 if i % 7 == 0 else start
        out.append((i, rng.choice("12"), start, start + length))
    return [*out, (n, "1", 0, 248_956_422), (n + 1, "1", 16_383, 16_385), (n + 2, "1", 1 << 26, (1 << 26) + 1), (n + 3, "1", 0, 1), (n + 4, "1", 0, 3_000_000_000)]


def test_overlaps_of_all_lengths_against_brute_force(spark):
    rng = random.Random(6)
    a, b = mixed(rng, 150), mixed(rng, 200)
    left, right = spark.createDataFrame(a, "id int, chrom string, start0 long, end0 long"), spark.createDataFrame(b, "r_id int, chrom string, start0 long, end0 long")
    got = sorted((r.id, r.r_id) for r in I.overlaps(left, right).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want
    assert {r.id for r in I.overlaps(left, right, keep="semi").collect()} == {i for i, _ in want}
    points = spark.createDataFrame([(i, c, s + 1) for i, c, s, _ in a], "id int, chrom string, pos long")
    within = [r.id for r in I.points_within(points, right.filter("r_id % 9 = 0")).collect()]
    assert sorted(within) == [i for i, c, s, _ in a if any(y[0] % 9 == 0 and y[1] == c and y[2] <= s < y[3] for y in b)]


def test_long_intervals_make_few_keys(spark):
    rows = spark.createDataFrame([(100_000, 100_100_000), (0, 248_956_422), (5, 6), (16_000, 17_000), ((1 << 26) - 5, (1 << 26) + 5)], "s long, e long")
    for sides in ((I.ASKS, I.STANDS), (I.STANDS, I.ABOVE)):
        n = [r.n for r in rows.select(F.size(I._keys(F.col("s"), F.col("e"), I.BIN, *sides)).alias("n")).collect()]
        assert max(n) <= 12 and n[0] <= 4
