"""Queries on frameshifts, haplotypes and stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import clinical as L
from varloom.operators import haplotypes as T
from varloom.plans.base import on_views

N, V = ("fx_sites", "fx_annotations"), ("fx_sites", "fx_annotations", "fx_calls")
INDEX = "ix AS (SELECT site_id, list_sort(list(DISTINCT split_part(transcript, '.', 1))) AS transcripts, length(alt) - length(ref) AS change FROM fx_annotations JOIN fx_sites USING (site_id) WHERE consequence = 'frameshift_variant' AND (length(alt) - length(ref)) % 3 <> 0 GROUP BY site_id, ref, alt)"
EVENTS = """
ct AS (SELECT 'T' || site_id % 35 AS transcript, site_id // 200 AS event_id, site_id, length(alt) - length(ref) AS change FROM fx_sites WHERE (length(alt) - length(ref)) % 3 <> 0),
ev AS (SELECT event_id, transcript, count(*) AS members, list(site_id ORDER BY site_id) AS sites FROM ct GROUP BY ALL HAVING count(*) >= 2 AND sum(change) % 3 = 0)"""


@on_views("x07_frameshift_index", N, "SELECT site_id, array_to_string(transcripts, ',') AS transcripts, change FROM ix", INDEX)
def index(v):
    return T.frameshift_index(v.annotations, v.sites).select("site_id", F.array_join("transcripts", ",").alias("transcripts"), "change")


def found(v):
    n = F.col("site_id")
    containers = v.sites.select(F.concat(F.lit("T"), n % 35).alias("transcript"), F.floor(n / 200).alias("event_id"), "site_id")
    shifts = v.sites.select("site_id", F.array(F.concat(F.lit("T"), n % 35)).alias("transcripts"), (F.length("alt") - F.length("ref")).alias("change")).filter(F.pmod("change", F.lit(3)) != 0)
    return T.events(containers, shifts)


@on_views("j18_frame_events", ("fx_sites",), "SELECT event_id, transcript, members, array_to_string(sites, ',') AS sites FROM ev", EVENTS)
def events(v):
    return found(v).withColumn("sites", F.array_join(F.transform("sites", lambda x: x.cast("string")), ","))


@on_views("x06_frame_restorations", ("fx_sites", "fx_calls"), """SELECT event_id, transcript, sample_id, CASE WHEN open <= 1 THEN 'FRAME_RESTORED_CONFIRMED' WHEN len(places) > len(sets) THEN 'TRANS' WHEN placed = open AND len(places) <= 1 THEN 'FRAME_RESTORED_CONFIRMED'
 WHEN placed > len(places) THEN 'FRAME_RESTORATION_PARTIAL_CONFIRMED' ELSE 'FRAME_RESTORING_POSSIBLE_UNPHASED' END AS status FROM (SELECT event_id, transcript, members, sample_id, count(*) AS n, count(*) FILTER (WHERE gt <> '1/1') AS open, count(*) FILTER (WHERE contains(gt, '|')) AS placed,
  coalesce(list(DISTINCT (site_id // 500)::VARCHAR || gt) FILTER (WHERE contains(gt, '|')), []) AS places, coalesce(list(DISTINCT site_id // 500) FILTER (WHERE contains(gt, '|')), []) AS sets FROM (SELECT event_id, transcript, members, unnest(sites) AS site_id FROM ev) JOIN fx_calls USING (site_id) WHERE gt <> '0/0' GROUP BY ALL) WHERE n = members""", EVENTS)
def restorations(v):
    calls = v.calls.withColumn("phase_set", F.floor(F.col("site_id") / 500).cast("string"))
    return T.restorations(found(v), calls)


@on_views("w13_distinct_events", ("fx_calls",), "SELECT DISTINCT site_id, sample_id, substr(gt, 2, 1) AS status FROM fx_calls")
def distinct(v):
    rows = v.calls.select("site_id", "sample_id", F.lit("T").alias("transcript"), F.substring("gt", 2, 1).alias("status"))
    return T.distinct_events(rows.union(rows)).select("site_id", "sample_id", "status")


@on_views("p21_haplotype_evidence", ("fx_calls",), """SELECT variant_key, sample_id, status, partners FROM (SELECT *, row_number() OVER (PARTITION BY variant_key, sample_id ORDER BY r, partners) AS o FROM (SELECT site_id % 50 AS variant_key, sample_id, gq::VARCHAR AS partners, CASE gq % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS r,
 CASE gq % 4 WHEN 0 THEN 'FRAME_RESTORED_CONFIRMED' WHEN 1 THEN 'FRAME_RESTORATION_PARTIAL_CONFIRMED' WHEN 2 THEN 'FRAME_RESTORING_POSSIBLE_UNPHASED' END AS status FROM fx_calls) WHERE r IS NOT NULL) WHERE o = 1""")
def evidence(v):
    q = F.col("gq") % 4
    rows = v.calls.select((F.col("site_id") % 50).alias("variant_key"), "sample_id", F.lit("T").alias("transcript"), F.when(q == 0, T.CONFIRMED).when(q == 1, T.PARTIAL).when(q == 2, T.POSSIBLE).otherwise("other").alias("status"), F.col("gq").cast("string").alias("partners"))
    return L.haplotype_evidence(rows).drop("transcript")



CHUNK = 64  # bases in a chunk of the sequence table here, so that models need several


def features(v):
    """GTF features of fx_coding: places in the transcript, mapped to its contig and turned on the reverse strand."""
    exon = v.coding.select("*", F.explode(F.expr("sequence(0, exons - 1)")).alias("e")).selectExpr("*", "e * x AS lo", "least((e + 1) * x, length(cdna)) AS hi", "20 * e AS moved")
    coding = exon.selectExpr("*", "greatest(lo, 12) AS clo", "least(hi, 12 + length(cds)) AS chi")
    of = lambda rows, kind, lo, hi: rows.selectExpr("n", "strand", "length(contig) AS total", f"{kind} AS feature", f"{lo} + moved AS p", f"{hi} + moved AS q")
    rows = of(exon, "'exon'", "lo", "hi").union(of(coding.filter("chi > clo"), "CASE WHEN e % 2 = 0 THEN 'CDS' ELSE 'stop_codon' END", "clo", "chi")).union(of(exon.filter("e = 0 AND n % 37 = 9"), "'Selenocysteine'", "30", "33"))
    ends = ["CASE WHEN strand = '+' THEN p + 1 ELSE total - q + 1 END AS start1", "CASE WHEN strand = '+' THEN q ELSE total - p END AS end1"]
    return rows.selectExpr("concat('M', n) AS tx_id", "3 AS version", "CASE n % 17 WHEN 3 THEN 'protein_coding_LoF' ELSE 'protein_coding' END AS biotype", "concat('T', n) AS chrom", "strand", "feature", *ends)


def models(v):
    chunks = v.coding.select(F.expr("concat('T', n)").alias("chrom"), "contig", F.explode(F.expr(f"sequence(0, CAST((length(contig) - 1) / {CHUNK} AS INT))")).alias("chunk"))
    return T.coding_models(features(v), chunks.select("chrom", "chunk", F.expr(f"substr(contig, chunk * {CHUNK} + 1, {CHUNK})").alias("sequence")), CHUNK)


SOUND = """
md AS (SELECT *, concat_ws('+', CASE WHEN n % 13 = 7 THEN 'cds_no_terminal_stop' END, CASE WHEN n % 41 = 10 AND n % 37 <> 9 THEN 'cds_internal_stop' END) AS problems, (exons - 1) * x - 12 AS junction,
  CASE WHEN (11 + length(cds)) // x > 0 THEN (11 + length(cds)) // x * x - 12 END AS coding_junction, substr(cdna, 13) AS coding FROM fx_coding)"""
RULED = """
ed AS (SELECT m.*, e.* EXCLUDE (n), CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS delta,
  CASE WHEN kind = 2 THEN CASE WHEN strand = '+' THEN left(coding, a + 1) || substr(coding, a + 3) ELSE left(coding, a) || substr(coding, a + 2) END
   WHEN strand = '+' THEN left(coding, a + 1) || CASE kind WHEN 0 THEN 'G' ELSE 'GT' END || substr(coding, a + 2) ELSE left(coding, a) || CASE kind WHEN 0 THEN 'C' ELSE 'AC' END || substr(coding, a + 1) END AS edited FROM md m JOIN fx_edits e USING (n)),
st AS (SELECT *, list_min([k * 3 FOR k IN range(0, length(edited) // 3) IF substr(edited, k * 3 + 1, 3) IN ('TAA', 'TAG', 'TGA')]) AS stop FROM ed),
rs AS (SELECT *, CASE WHEN n % 31 = 0 THEN 'no_transcript_model' WHEN n % 17 = 3 THEN 'unsupported_transcript_biotype:protein_coding_LoF' WHEN problems <> '' THEN 'bad_transcript_model:' || problems WHEN n % 37 = 9 THEN 'selenocysteine'
  WHEN n % 19 = 4 THEN 'start_lost_unsupported' WHEN n % 23 = 5 THEN 'transcript_version_mismatch' WHEN n % 29 = 6 THEN 'unsupported_allele' WHEN kind = 2 AND strand = '+' AND (13 + a) % x = 0 THEN 'outside_cds'
  WHEN n % 11 = 8 AND kind < 2 THEN 'ref_mismatch' WHEN stop IS NULL THEN 'no_stop_found' WHEN exons = 1 THEN 'not_applicable_single_exon_transcript' WHEN junction >= length(cds) THEN 'ok_utr_only_terminal_exon' ELSE 'ok' END AS status FROM st),
ds AS (SELECT n, tx_id, status, CASE WHEN status LIKE 'ok%' OR status LIKE 'not_app%' THEN stop END AS ptc, CASE WHEN status LIKE 'ok%' THEN junction + CASE WHEN a < junction THEN delta ELSE 0 END - stop END AS ptc_distance,
  CASE WHEN status LIKE 'ok%' THEN coding_junction + CASE WHEN a < coding_junction THEN delta ELSE 0 END - stop END AS coding_distance FROM rs),
ru AS (SELECT n, tx_id, status, ptc, ptc_distance, CASE WHEN ptc_distance > 50 THEN 'PASS' WHEN ptc_distance IS NOT NULL THEN 'FAIL' END AS rule, coding_distance, CASE WHEN coding_distance > 50 THEN 'PASS' WHEN coding_distance IS NOT NULL THEN 'FAIL' END AS coding_rule FROM ds)"""


@on_views("j19_coding_models", ("fx_coding",), "SELECT concat('M', n) AS tx_id, coding, length(cds) AS cds_length, exons, junction AS last_junction, coding_junction AS last_coding_junction, problems FROM md", SOUND)
def coding_models(v):
    return models(v).select("tx_id", "coding", "cds_length", "exons", "last_junction", "last_coding_junction", F.array_join("problems", "+").alias("problems"))


@on_views("x08_stop_rule", ("fx_coding", "fx_edits"), "SELECT * FROM ru", SOUND, RULED)
def stop_rule(v):
    return T.stop_rule(v.edits.select("n", "tx_id", "pos", "ref", "alt", "consequence"), models(v)).drop("pos", "ref", "alt", "consequence")


@on_views("x09_applied_rule", ("fx_coding", "fx_edits"), """SELECT n AS site_id, CASE WHEN rule IS NULL THEN info WHEN n % 4 = 1 THEN 'X:1&50_BP_RULE:' || rule WHEN n % 4 = 2 THEN '50_BP_RULE:' || rule || ',X:1' ELSE info END AS lof_info,
 CASE n % 4 WHEN 2 THEN 'PASS' END AS rule_original, rule, CASE n % 4 WHEN 2 THEN 'PASS' END <> rule AS rule_changed FROM (SELECT *, CASE n % 4 WHEN 1 THEN 'X:1' WHEN 2 THEN '50_BP_RULE:PASS,X:1' WHEN 3 THEN '' END AS info FROM ru)""", SOUND, RULED)
def applied(v):
    n = F.col("n") % 4
    ruled = T.stop_rule(v.edits.select(F.col("n").alias("site_id"), "tx_id", "pos", "ref", "alt", "consequence"), models(v))
    rows = v.edits.select(F.col("n").alias("site_id"), F.col("tx_id").alias("transcript"), F.when(n == 1, "X:1").when(n == 2, "50_BP_RULE:PASS,X:1").when(n == 3, "").alias("lof_info"))
    return T.apply_rule(rows, ruled).drop("transcript")
