"""Headers of file sets, quoted phenotype tables, and the intake's table of deltas with its counters."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from varloom.functions.scratch import scratch_path
from varloom.sources import headers, phenotypes, vcf
from varloom.streaming import intake

HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=CSQ,Number=.,Type=String,Description="x. Format: Allele|SYMBOL">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', "##contig=<ID=chr1,length=5>"]


def columns(*samples):
    return "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])


@pytest.fixture(scope="module")
def heads(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("heads")
    long = [*HEAD[:1], *[f"##contig=<ID=p{i}>" for i in range(40_000)], *HEAD[1:], columns("A", "B"), "1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0/0"]
    (d / "a.vcf").write_text("\n".join(long))
    other = [HEAD[0], HEAD[1].replace("Allele|SYMBOL", "SYMBOL | Allele|More"), HEAD[2].replace("Number=A", "Number=1"), columns("C", "B", "B", "")]
    with gzip.open(d / "b.vcf.gz", "wt") as f:
        f.write("\r\n".join(other) + "\r\n")
    with gzip.open(d / "b.vcf.gz", "at") as f:  # a second member, as block-compressed files have
        f.write("1\t5\t.\tA\tC\n")
    (d / "c.vcf").write_text("1\t5\t.\tA\tC\n")
    (d / "d.vcf").write_text(HEAD[0] + "\n" + columns())
    return str(d), headers.read_headers(spark, str(d))


def name(c="file"):
    return F.element_at(F.split(c, "/"), -1).alias("file")


def test_heads_are_read_to_their_columns(spark, heads):
    path, h = heads
    assert sorted(tuple(r) for r in h.samples().select(name(), "ordinal", "sample").collect()) == [("a.vcf", 0, "A"), ("a.vcf", 1, "B"), ("b.vcf.gz", 0, "C"), ("b.vcf.gz", 1, "B"), ("b.vcf.gz", 2, "B"), ("b.vcf.gz", 3, "")]
    got = sorted(tuple(r) for r in h.csq().select(name(), F.array_join("csq", ",")).collect())
    assert got == [("a.vcf", "Allele,SYMBOL"), ("b.vcf.gz", "SYMBOL,Allele,More")]
    assert vcf.read_header(spark, f"{path}/a.vcf").samples == ("A", "B")
    assert h.contigs().filter("length IS NULL").count() == 40_000
    problems = sorted(tuple(r) for r in h.problems().select(name(), "problem").collect())
    assert problems == [("b.vcf.gz", "empty_sample"), ("b.vcf.gz", "repeated_sample"), ("c.vcf", "no_columns"), ("c.vcf", "no_csq"), ("c.vcf", "no_fileformat"), ("d.vcf", "no_csq"), ("d.vcf", "no_samples")]
    conflicts = sorted(tuple(r) for r in h.conflicts().collect())
    assert conflicts == [("info_number", "AF", "1,A"), ("sample_in_files", "B", "a.vcf,b.vcf.gz")]


def test_entries_go_by_their_own_file(spark, heads):
    _, h = heads
    rows = h.lines.select("file").distinct().withColumn("csq", F.lit("x%3By|z,w"))
    got = {r.file: r.entries for r in headers.entries_by_file(rows, h).select(name(), "entries").collect()}
    assert got["a.vcf"] == [{"Allele": "x;y", "SYMBOL": "z"}, {"Allele": "w", "SYMBOL": ""}]
    assert got["b.vcf.gz"] == [{"SYMBOL": "x;y", "Allele": "z", "More": ""}, {"SYMBOL": "w", "Allele": "", "More": ""}]
    assert got["c.vcf"] is None


def test_phenotypes_are_parsed_with_quotes(spark, tmp_path):
    one = 'Subject ID,VCF Sample,Sex,Clinical Summary,Extra Lab Field,Extra Lab Field,,Age Unit\r\nCASE-1,"P1, P9",F,"Low ""IgG"",\nfevers",IgG 300,x\r\n\r\n,,,\r\nCASE-2,F_S,M,,,,left\r\nCASE-1,P3\r\n'
    (tmp_path / "a.csv").write_text("\ufeffMade today,\n" + one)
    (tmp_path / "b.csv").write_text("Case,Sample\nDUP,P1\nOK1,P2\nDUP,P2\n")
    t = phenotypes.read_phenotypes(spark, str(tmp_path))
    rows = {(r.f, r.row_no): r for r in t.rows.withColumn("f", name()).collect()}
    a = rows["a.csv", 1]
    assert (a.individual_id, a.sample_ids, a.sex_at_birth, a.phenotype_summary, a.custom) == ("CASE-1", "P1, P9", "F", 'Low "IgG",\nfevers', {"Extra Lab Field": "IgG 300", "Extra Lab Field (2)": "x"})
    assert (rows["a.csv", 2].individual_id, rows["a.csv", 2].custom) == ("CASE-2", {"Column 7": "left"}) and rows["a.csv", 3].sample_ids == "P3" and len(rows) == 6
    heads = {r.f: r for r in t.headers.withColumn("f", name()).collect()}
    assert heads["a.csv"].header_row == 2 and heads["a.csv"].columns[4:8] == ["Extra Lab Field", "Extra Lab Field (2)", "Column 7", "Age Unit"]
    assert heads["b.csv"].mapping == {"individual_id": "Case", "sample_ids": "Sample"}
    assert sorted((r.f, r.individual_id, r.row_nos) for r in t.duplicates().withColumn("f", name()).collect()) == [("a.csv", "CASE-1", [1, 3]), ("b.csv", "DUP", [1, 3])]


def test_separators_are_found_and_wide_rows_are_refused(spark, tmp_path):
    for k, sep in enumerate(phenotypes.SEPARATORS):
        f = tmp_path / f"{k}.txt"
        f.write_text(sep.join(["Patient", "Sex", "Notes"]) + "\n" + sep.join(["P1", "F", f'"a{sep}b"']) + "\n")
        assert phenotypes.separator_of(spark, str(f)) == sep
        assert phenotypes.read_phenotypes(spark, str(f)).rows.first().notes == f"a{sep}b"
    (tmp_path / "wide.csv").write_text(",".join(f"n{i}" for i in range(300)) + "\n")
    with pytest.raises(Exception, match="more than 256 columns"):
        phenotypes.read_phenotypes(spark, str(tmp_path / "wide.csv")).headers.collect()


def calls(spark, *rows):
    return spark.createDataFrame([(s, n, gt, dp, 20, 4, "PASS", "f") for s, n, gt, dp in rows], intake.CALLS)


def held(table, parts=None):
    return sorted((r.sample_id, r.site_id, r.gt, r.dp) for r in table.read(parts).collect())


def test_deltas_cost_what_they_hold(spark):
    table = intake.DeltaTable(spark, scratch_path(spark, "deltas"), part_sites=10)
    assert held(table) == [] and table.fold() == set()
    assert table.append(calls(spark, ("S1", 1, "0/1", 9), ("S1", 25, "0/1", 9), ("S2", 1, "1/1", 7)), 0)
    assert table.fold() == {0, 2} and table.state().deltas == () and len(held(table)) == 3
    assert table.append(calls(spark, ("S1", 1, None, 8), ("S3", 31, "0/1", 5)), 1) and not table.append(calls(spark, ("S9", 1, "0/1", 1)), 1)
    assert table.append(calls(spark, ("S1", 1, "1/1", None)), 2)
    assert spark.read.parquet(f"{table.path}/delta/b=1").count() == 2  # the batch's own rows only
    want = [("S1", 1, "1/1", 8), ("S1", 25, "0/1", 9), ("S2", 1, "1/1", 7), ("S3", 31, "0/1", 5)]
    assert held(table) == want and held(table, {0}) == [want[0], want[2]] and held(table, {3}) == [want[3]]
    before = dict(table.state().base)
    assert table.fold() == {0, 3} and held(table) == want
    after = dict(table.state().base)
    assert after[2] == before[2] and after[0] > before[0] and table.state().batch == 2
    table.vacuum()
    assert held(table) == want and not table.append(calls(spark, ("S9", 1, "0/1", 1)), 2)
    assert table.append(calls(spark, ("S2", 1, "0/0", 1)), 3) and ("S2", 1, "0/0", 1) in held(table)


def test_a_crash_between_writes_changes_nothing(spark, monkeypatch):
    table = intake.DeltaTable(spark, scratch_path(spark, "crash"), part_sites=10)
    table.append(calls(spark, ("S1", 1, "0/1", 9)), 0)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(intake.DeltaTable, "_log", lost)
        with pytest.raises(RuntimeError):
            table.append(calls(spark, ("S1", 1, "1/1", 5), ("S2", 2, "0/1", 5)), 1)
        with pytest.raises(RuntimeError):
            table.fold()
    assert held(table) == [("S1", 1, "0/1", 9)] and table.state().batch == 0
    table.append(calls(spark, ("S2", 2, "0/1", 5)), 1)
    assert held(table) == [("S1", 1, "0/1", 9), ("S2", 2, "0/1", 5)]
    table.fold()
    assert held(table) == [("S1", 1, "0/1", 9), ("S2", 2, "0/1", 5)]


def test_a_small_delta_does_not_shuffle_the_base(spark):
    table = intake.DeltaTable(spark, scratch_path(spark, "plan"), part_sites=1000)
    table.append(spark.range(5000).select(F.lit("S1").alias("sample_id"), F.col("id").alias("site_id"), F.lit("0/1").alias("gt"), F.lit(1).alias("dp"), F.lit(1).cast("long").alias("gq"), F.lit(1).alias("ad_alt"), F.lit("PASS").alias("filter"), F.lit("f").alias("file_id")), 0)
    table.fold()
    table.append(calls(spark, ("S1", 1, "1/1", 9)), 1)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and len(held(table)) == 5000


def test_intake_replays_without_change_and_counts(spark):
    source, target, bad, checkpoint = (scratch_path(spark, f"t-{k}") for k in "stbc")
    log = intake.ProgressLog()
    spark.streams.addListener(log)
    try:
        lines = ["S1\t1\t0/1\t9\t20\t4\tPASS", "S1\tx\t0/1\t9\t20\t4\tPASS", "S2\t1\t0/1"]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(source)
        for _ in range(2):
            intake.start(spark, source, target, bad, checkpoint).awaitTermination()
            table = intake.DeltaTable(spark, target)
            assert [(r.sample_id, r.site_id, r.gt) for r in table.read().collect()] == [("S1", 1, "0/1")] and table.state().batch == 0
        more = ["S1\t1\t1/1\t9\t20\t4\tLowQ", "S3\t2\t0/1\t9\t20\t4\tPASS"]
        spark.createDataFrame([(x,) for x in more], "value string").coalesce(1).write.mode("append").text(source)
        intake.start(spark, source, target, bad, checkpoint, fold_every=1).awaitTermination()
        for _ in range(50):
            if sum(n for _, _, n in log.rows) >= 5:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert table.state().deltas == () and sorted((r.sample_id, r.gt) for r in table.read().collect()) == [("S1", "1/1"), ("S3", "0/1")]
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["field count", "site"]
    assert sorted(tuple(r) for r in intake.counters(spark, target).select("batch", "records", "passing", "quarantined").collect()) == [(0, 3, 1, 2), (1, 2, 1, 0)]
    assert sum(n for _, _, n in log.rows) == 5


def test_counters_of_a_scan(spark):
    rows = calls(spark, *[(f"S{i}", i, "0/1", i) for i in range(10)])
    assert intake.scan_counters(rows, F.col("dp") > 3) == {"records": 10, "passing": 6, "quarantined": 4}
    assert intake.scan_counters(rows.limit(0)) == {"records": 0, "passing": 0, "quarantined": 0}
