"""Queries whose work must grow no faster than their input, and keys that only larger tables hold."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from varloom.functions import fields as X
from varloom.operators import genes as E
from varloom.operators import intervals as I  # noqa: E741
from varloom.operators import matrix as M
from varloom.operators import reference as P
from varloom.operators import regulatory as R
from varloom.operators import scores as S
from varloom.plans import files, registry
from varloom.plans.base import Views
from varloom.sources import fixtures
from varloom.sources import vcf as V
from varloom.streaming import intake


def test_links_of_individuals_without_calls(spark, tmp_path):
    """a registered sample is known also if no file has calls of it."""
    spark.range(1, 13).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "id % 25 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 5).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 5).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    line = "id AS l_orderkey, CAST(1 AS BIGINT) AS l_linenumber, id AS l_partkey, id AS l_suppkey, 5.0 AS l_quantity, 9.0 AS l_extendedprice, 0.1 AS l_discount, 'N' AS l_returnflag"
    spark.range(1, 5).selectExpr(*line.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.individual_id: (r.status, r.sample_id) for r in registry.QUERIES["j25_link_validation"](spark, str(tmp_path)).collect()}
    assert got == {f"P{n}": ("unmatched", None) if n % 5 == 0 else ("suggestion" if n % 2 == 0 else "exact", f"S{n}") for n in range(1, 13)}


def test_numbers_of_seven_digits(spark):
    """numbers of phenotypes go on after 999999."""
    rows = spark.createDataFrame([("MIM #1234567", "Name, 1234567 (3), AD"), ("MIM #12345", "Name (2)")], "i string, t string")
    got = [tuple(r) for r in rows.select(E.disease_id(F.col("i")), E.phenotype_parts(F.col("t"))["name"], E.phenotype_parts(F.col("t"))["mim"]).collect()]
    assert got == [("OMIM:1234567", "Name", "1234567"), (None, "Name", None)]


def test_codes_meet_as_columns(spark):
    """No task keeps a row a pair of element and sample; more samples than a block has, repeats and odd samples."""
    rows = [(1, 0, 3), (1, 0, 2), (1, 40, 5), (1, 69, 1), (2, 31, 4), (2, 32, None), (3, 70, 8), (3, -1, 8), (4, None, 6)]
    codes = spark.createDataFrame(rows, "row_index long, sample_index long, code int")
    packed = M.pack(codes, 70)
    got = {r.row_index: {i: c for i, c in enumerate(r.codes) if c is not None} for r in packed.collect()}
    assert got == {1: {0: 2, 40: 5, 69: 1}, 2: {31: 4}, 3: {}, 4: {}} and all(len(r.codes) == 70 for r in packed.collect())
    counted = R.histograms(codes)
    assert sorted(map(tuple, counted.collect()), key=str) == sorted([(0, 2, 1, 1), (40, 5, 1, 0), (69, 1, 1, 0), (31, 4, 1, 0), (32, None, 1, 0), (70, 8, 1, 0), (-1, 8, 1, 0), (None, 6, 1, 0)], key=str)
    for df in (packed, counted):
        dealt = [x.split("ENSURE")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(row_index" in x]
        assert dealt and not any("sample_index" in x for x in dealt)


@pytest.fixture(scope="module")
def places(spark):
    """Elements, TSS and sites at odd places: empty, touching, of one base, long, at the chromosome's start."""
    rng = random.Random(7)
    ccres = [(i, rng.choice("12"), s, s + rng.choice([0, 1, 1, 2, 5, 40, 700]), rng.choice("abc")) for i, s in enumerate(rng.choices(range(300), k=150))]
    tss = [(i, rng.choice("12"), rng.choice("+-"), rng.randint(1, 900)) for i in range(120)]
    sites = [(i, rng.choice("12"), rng.randint(1, 320), "A" * rng.choice([0, 1, 1, 3, 60])) for i in range(200)]
    frames = (spark.createDataFrame(ccres, "row_index long, chrom string, start0 long, end0 long, ccre_class string"), spark.createDataFrame(tss, "tx_id long, chrom string, strand string, tss long"), spark.createDataFrame(sites, "site_id long, chrom string, pos long, ref string"))
    return ccres, tss, sites, *frames


def near(c, tss, window):
    """(distance, tx_id, side) by brute force."""
    out = []
    for tx, chrom, strand, t in tss:
        at, (_, where, s, e, _) = t - 1, c
        gap = s - at if at < s else e - 1 - at if at >= e else 0
        if chrom == where and abs(gap) <= window:
            out.append((abs(gap), tx, "overlap" if gap == 0 else "downstream" if (gap > 0) == (strand == "+") else "upstream"))
    return sorted(out)


def hit(site, c):
    _, chrom, pos, ref = site
    return chrom == c[1] and pos - 1 < c[3] and c[2] < pos - 1 + len(ref)


def moved_keys(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(row_index" in x]


@pytest.mark.parametrize("window", [0, 7, 100])
def test_lists_of_genes_without_moving_pairs(places, window):
    """F1."""
    ccres, tss, _, c, t, _ = places
    out = I.genes_around(c, t, window)
    want = {e[0]: [(d, x) for d, x, _ in near(e, tss, window)] for e in ccres}
    assert {r.row_index: [tuple(g) for g in r.genes] for r in out.collect()} == {k: g for k, g in want.items() if g}
    assert not moved_keys(out)


@pytest.mark.parametrize("window", [0, 7, 100])
def test_report_by_nodes(places, window):
    """the report's counts, classes and nearest genes, made without pairs of sites and elements."""
    ccres, tss, sites, c, t, s = places
    got = {r.site_id: (r.overlaps, r.classes, r.nearest and tuple(r.nearest), r.most_genes) for r in I.context_report(s, c, t, window).collect()}
    genes, want = {e[0]: near(e, tss, window) for e in ccres}, {}
    for site in sites:
        own = [e for e in ccres if hit(site, e)]
        if own:
            want[site[0]] = (len(own), sorted({e[4] for e in own}), min((genes[e[0]][0] for e in own if genes[e[0]]), default=None), max(len(genes[e[0]]) for e in own))
    assert got == want


@pytest.mark.parametrize("mode", ["any", "all"])
def test_contexts_of_sites_by_islands(spark, places, mode):
    """a site meets a context's islands, of which there are fewer than elements."""
    ccres, _, sites, c, _, s = places
    on = {"x": [e for e in ccres if e[0] % 3 == 0], "y": [e for e in ccres if e[0] % 4 == 1]}
    contexts = spark.createDataFrame([(e[0], k, int(e in on[k])) for e in ccres for k in on], "row_index long, ontology_id string, detected int")
    own = I.as_interval(s)
    got = {r.site_id for r in R.filter_sites(own, c, contexts, ["x", "y"], mode).collect()}
    assert got == {site[0] for site in sites if (any if mode == "any" else all)(any(hit(site, e) for e in on[k]) for k in on)}
    assert R.context_islands(c, contexts, ["x", "y"]).count() < sum(map(len, on.values()))
    with pytest.raises(ValueError):
        R.filter_sites(own, c, contexts, ["x", "z"], mode)


@pytest.mark.parametrize("name", ["x30_context_report", "f17_any_context", "f17_all_contexts", "j06_genes_near_elements"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """Files of some KB explode to many rows, which no plan may send whole through the driver."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and re.search(r"\bnode#|_rbin#|_gbin#", x)]


def test_islands_of_equal_starts(spark):
    """intervals with one start are one row before any task orders them."""
    rows = spark.range(3000).selectExpr("CAST(id % 2 AS STRING) AS chrom", "(id % 3) * 100 AS start0", "(id % 3) * 100 + id % 50 AS end0")
    out = I.merged(rows, -1)
    assert sorted(map(tuple, out.collect())) == [(c, k, k + 48 + int(c)) for c in "01" for k in (0, 100, 200)]
    assert re.search(r"Aggregate \[chrom#\d+, start0#\d+L?\]", out._jdf.queryExecution().optimizedPlan().toString())


def test_sites_at_one_place_ask_once(places, spark):
    """all sites of a place get its report, though it is asked for once."""
    ccres, tss, sites, c, t, s = places
    twice = s.unionByName(s.withColumn("site_id", F.col("site_id") + 1000))
    got = {r.site_id: tuple(r)[1:] for r in I.context_report(twice, c, t, 7).collect()}
    one = {k: v for k, v in got.items() if k < 1000}
    assert one and {k - 1000: v for k, v in got.items() if k >= 1000} == one
    plan = I.context_report(twice, c, t, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[chrom#\d+, low#\d+L?, high#\d+L?\], \[chrom#\d+, low#\d+L?, high#\d+L?\]", plan)


def test_rows_of_a_small_file_are_dealt(spark, tmp_path):
    """one file of many rows keeps all cores busy."""
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    dealt = fixtures.dealt(spark.read.parquet(f"{tmp_path}/t"))
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and dealt.agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("name", ["t03_intake_counters", "t01_t02_streamed_calls"])
def test_intake_has_files_for_all_cores(spark, monkeypatch, name):
    """no task takes a third of all calls."""
    seen = []

    def start(spark, source, *others, **named):
        seen.append(source)
        raise InterruptedError

    monkeypatch.setattr(intake, "start", start)
    with pytest.raises(InterruptedError):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(spark.read.text(seen[0]).inputFiles()) >= spark.sparkContext.defaultParallelism


def test_uncalled_cells_carry_nothing(spark):
    """cells that are told by a comparison, and those that only look like them."""
    rows = spark.createDataFrame([("5_0", "1", 7, "A", "C", "PASS", "GT:DP", ["./.", "./.:3", "./1:4", "0/1", None, "././1", "."])], "id string, chrom string, pos long, ref string, alt string, filter string, format string, samples array<string>")
    got = V.genotypes(V.alleles(rows), tuple("abcdefg"))
    assert sorted(r.sample_id for r in got.collect()) == ["c", "d", "f"]


def test_reference_is_never_broadcast(spark, tmp_path):
    """chunks of some KB in files may be a genome; a plan that broadcasts them keeps all of them in each task."""
    chunks = spark.createDataFrame([("1", 0, "ACGT" * 4), ("1", 1, "TTTTGGGGCCCCAAAA")], "chrom string, chunk long, sequence string")
    chunks.write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    rows = spark.createDataFrame([(0, "1", 18), (1, "1", 3), (2, "2", 3)], "id int, chrom string, pos long")
    out = P.with_window(rows, chunks, size=16)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.window, r.window_start) for r in out.collect()} == {0: ("ACGT" * 4 + "TTTTGGGGCCCCAAAA", 1), 1: ("ACGT" * 4 + "TTTTGGGGCCCCAAAA", 1), 2: (None, None)}


@pytest.mark.parametrize("name", ["j08_stored_lookup", "j08_indexed_lookup", "j09_missense_lookup", "e02_manifest_lookup"])
def test_score_tables_are_never_broadcast(spark, name):
    """neither the scores nor the sites, whose files look small, are kept in each task; no query row is grouped after it met its records."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    joined = [x for x in plan.split("\n") if "SortMergeJoin" in x or "Aggregate" in x]
    assert "SortMergeJoin" in joined[0]


def test_lookups_by_one_row_an_allele(spark):
    """repeated records, ones that lack a dimension, queries that do, and equal queries, against a loop over all records."""
    rng = random.Random(5)
    scores = [(rng.randint(0, 12), rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.choice([1.0, 2.0, None])) for _ in range(60)]
    queries = [(i // 2, rng.randint(0, 16), rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 1, None])) for i in range(120)]
    queries += [(99, None, "a", 0), (99, 1, "a", 0), (99, 1, "a", 0)]
    out = S.lookup(spark.createDataFrame(queries, "id int, site_id int, tx string, copy int"), spark.createDataFrame(scores, "site_id int, tx string, copy int, score double"), S.ScoreSpec(dimensions=("tx", "copy")))
    want = []
    for q in queries:
        own = [s for s in scores if s[0] == q[1]]
        agree = [0 if s[1] is None or s[1] != q[2] else 1 if s[2] is None or s[2] != q[3] else 2 for s in own]
        missing, exact = None in q[2:], [s[3] for s, a in zip(own, agree) if a == 2]
        status = None if not own else "ambiguous" if missing or len(exact) > 1 else "exact" if exact else "partial"
        match = None if not own else "query_target_unavailable" if missing else "multiple_exact_records" if len(exact) > 1 else ["allele_only", "allele_tx", "allele_tx_copy"][max(agree)]
        targets = sorted({":".join(str(x) for x in s[1:3] if x is not None) for s in own})
        want.append((*q, status, match, targets, exact[0] if status == "exact" else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_overlap_summaries_within_rows(spark):
    """elements without a context, contexts without a code, one mixed; no row a pair is made, moved or joined."""
    codes = [(1, 0, 1), (1, 1, 4), (1, 2, 0), (1, 4, 3), (2, 3, 7), (3, 4, 8), (4, 0, 0), (4, 2, 2)]
    packed = M.pack(spark.createDataFrame(codes, "row_index long, sample_index long, code int"), 5).localCheckpoint()
    members = spark.createDataFrame([("CL:1", "D1", 0, "full_classification"), ("CL:1", "D2", 1, "accessibility_only"), ("CL:2", "D1", 2, "full_classification"), ("CL:3", "D4", 3, "accessibility_only")], "ontology_id string, donor string, sample_index long, evidence_tier string")
    got = sorted(map(tuple, M.overlap_summary(packed, members).collect()))
    assert got == [(1, 3, 4, 1, 2, 1), (2, 1, 1, 1, 1, 0), (4, 1, 2, 1, 2, 0)]
    plan = registry.QUERIES["a25_overlap_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Aggregate|Generate", plan)


def test_calls_are_dealt_once_for_lines(spark):
    """Calls of a site are dealt by the site alone, which its lines and its join share; repeats of cells, first and last places."""
    lines = files.vcf_lines(Views(spark, "/root/testdata/sf0.001"))
    assert not re.search(r"hashpartitioning\(site_id#\d+L?, [a-z_]", lines._jdf.queryExecution().executedPlan().toString())
    calls = {(r.site_id, int(r.sample_id[1:])): f"{r.gt}:{r.dp}:{r.gq}" for r in fixtures.load(spark, "/root/testdata/sf0.001", "fx_calls").collect()}
    seen = 0
    for parts in (r.value.split("\t") for r in lines.collect()):
        site, block = map(int, parts[2].split("_"))
        assert parts[9:] == [calls.get((site, block * files.BLOCK + i), "./.") for i in range(files.BLOCK)]
        seen += sum(x != "./." for x in parts[9:])
    assert seen == len(calls)


@pytest.mark.parametrize("name", ["s26_sample_projection", "s24_info_write_back", "s01_p06_vcf_alleles", "s01_p15_vcf_genotypes", "s05_p08_vcf_consequences"])
def test_lines_are_compressed_on_disk(spark, monkeypatch, tmp_path, name):
    """A line of 32 cells, of which one or two are called, is not kept as plain text."""
    monkeypatch.setattr(files, "scratch_path", lambda _, kind: f"{tmp_path}/{kind}")
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    parts = list(tmp_path.glob("vcf/part-*"))
    assert parts and all(p.suffix == ".gz" for p in parts)
    assert sum(p.stat().st_size for p in parts) * 4 < spark.read.text(f"{tmp_path}/vcf").agg(F.sum(F.length("value") + 1)).first()[0]


def test_wordings_go_over_a_text_once(spark, tmp_path):
    """tags and cells of odd texts as by SQL, without expressions that read the text anew for each wording and each use."""
    odd = ["", None, "  \t\n", "\x0b", "NAÏVE cells", "b  \ncell", "not\tassessed, low", "not\x0bassessed", "gamma   delta", "gamma\x0bdelta", "gamma--delta", "low to\n\nnormal", "Kappa NK", "unknowns", "Tregs/red  cells", "x ", "DCé", "may  be"]
    spark.createDataFrame([(8 * i + 6 + i % 2, t) for i, t in enumerate(odd)] + [(8 * i + 1000 + j, t) for i, t in enumerate(odd) for j in range(6)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = registry.QUERIES["p31_finding_tags"](spark, str(tmp_path))
    want = con.execute(f"SELECT doc_id, tags, cells FROM ({registry.ORACLE_SQL['p31_finding_tags']})").fetchall()
    assert sorted(map(tuple, out.select("doc_id", "tags", "cells").collect())) == sorted(want) and len(want) == 7 * len(odd)
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows, listed", [(3, 4), (10_000, 1 << 20)])
def test_lists_of_genes_as_text(spark, places, monkeypatch, rows, listed):
    """lists are made from numbers, a tile at a time, also where a tile goes over several batches and its lists over several parts; null places stay out."""
    ccres, tss, _, c, t, _ = places
    monkeypatch.setattr(I, "LISTED", listed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        more = spark.createDataFrame([(1000, None, 5, 9, "a"), (1001, "1", None, 9, "a"), (1002, "9", 5, 9, "a")], c.schema)
        out = I.genes_around(c.unionByName(more), t.unionByName(spark.createDataFrame([(1000, None, "+", 7), (1001, "1", "+", None)], t.schema)), 100, text=True)
        got = {r.row_index: (r.chrom, r.start0, r.end0, r.ccre_class, r.genes) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {e[0]: (*e[1:], ",".join(str(x) for _, x, _ in near(e, tss, 100))) for e in ccres}
    assert got == {k: v for k, v in want.items() if v[-1]} and len(got) > 100


def test_nearest_genes_interpret_no_pair(spark):
    """no expression is interpreted for each pair of element and TSS."""
    plan = registry.QUERIES["o05_nearest_genes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("transform|sort_array|array_join", plan)


def test_pairs_are_made_in_many_tasks(spark, places):
    """few bytes are dealt for many pairs, so that tasks put together by bytes would be fewer than cores need; neither side is dealt twice."""
    ccres, tss, _, c, t, _ = places
    out = I.nearby_genes(c, t, 100)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert out.rdd.getNumPartitions() >= I.SHARES * spark.sparkContext.defaultParallelism
    assert sorted((r.row_index, abs(r.distance), r.tx_id, r.side) for r in out.collect()) == sorted((e[0], *n) for e in ccres for n in near(e, tss, 100))


def test_one_value_of_info(spark):
    """one value without a map of all, made once a row and not for each use."""
    texts = ["DB;CSQ=a|b,c", "CSQ=a;CSQ=b=c;X=1", "CSQ", "CSQ=", "CSQ;;CSQ=z", "CSQX=1;XCSQ=2", "", ".", None, "CSQ=x;CSQ"]
    rows = spark.createDataFrame([(t,) for t in texts], "info string").select(X.info_value(F.col("info"), "CSQ").alias("one"), X.info_map(F.col("info"))["CSQ"].alias("same"))
    assert all(r.one == r.same for r in rows.collect()) and {r.one for r in rows.collect()} == {"a|b,c", "b=c", "1", "", "z", None, "1"}
    allele = spark.createDataFrame([(k, t, "A", "C", ["C"], 0) for k, t in enumerate(["DB;CSQ=C|x", "CSQ=C|y;CSQ=C|z", "DB", None])], "variant_key int, info string, ref string, alt string, alts array<string>, alt_index int")
    out = V.consequences(allele, ("Allele", "SYMBOL"))
    assert sorted((r.variant_key, r.entry["SYMBOL"]) for r in out.collect()) == [(0, "x"), (1, "z")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and plan.count("split(info#") == 1
