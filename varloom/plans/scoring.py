"""Queries on score tables, predictors and the whole-genome prefilter."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions.scratch import scratch_path
from varloom.operators import cohort as H
from varloom.operators import intervals as I  # noqa: E741
from varloom.operators import prefilter as W
from varloom.operators import score_store as ST
from varloom.operators import scores as S
from varloom.operators import source_rules as SR
from varloom.plans.base import KEYED, on_views

N, SC = ("fx_annotations",), ("fx_annotations", "fx_scores")


def asked(v):
    return v.annotations.select("site_id", "k", "consequence", A.stable_id(F.col("transcript")).alias("transcript_base"), (F.col("k") % 2).alias("copy_no"))


LOOKUP = """
q AS (SELECT site_id, k, split_part(transcript, '.', 1) AS transcript_base, k % 2 AS copy_no FROM fx_annotations),
m AS (SELECT q.site_id, q.k, count(*) FILTER (WHERE s.transcript_base = q.transcript_base AND s.copy_no = q.copy_no) AS n,
  max(CASE WHEN s.transcript_base = q.transcript_base THEN CASE WHEN s.copy_no = q.copy_no THEN 2 ELSE 1 END ELSE 0 END) AS best,
  max(score) FILTER (WHERE s.transcript_base = q.transcript_base AND s.copy_no = q.copy_no) AS score FROM q JOIN fx_scores s USING (site_id) GROUP BY ALL)"""


@on_views("j08_indexed_lookup", SC, """SELECT site_id, k, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'exact' WHEN n = 0 THEN 'partial' END AS status,
 CASE WHEN n > 1 THEN 'multiple_exact_records' ELSE ['allele_only', 'allele_transcript_base', 'allele_transcript_base_copy_no'][best + 1] END AS match, CASE WHEN n = 1 THEN score END AS score FROM q LEFT JOIN m USING (site_id, k)""", LOOKUP)
def lookup(v):
    spec = S.ScoreSpec(dimensions=("transcript_base", "copy_no"))
    return S.lookup(asked(v), v.scores, spec).select("site_id", "k", "status", "match", "score")


@on_views("j09_missense_lookup", SC, """SELECT q.site_id, q.k, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'exact' WHEN n = 0 THEN 'partial' END AS status, CASE WHEN n = 1 THEN score END AS score FROM fx_annotations q LEFT JOIN
 (SELECT a.site_id, a.k, count(*) FILTER (WHERE s.transcript_base = split_part(a.transcript, '.', 1)) AS n, max(score) FILTER (WHERE s.transcript_base = split_part(a.transcript, '.', 1)) AS score FROM fx_annotations a JOIN fx_scores s USING (site_id) GROUP BY ALL) USING (site_id, k)
 WHERE consequence = 'missense_variant'""")
def missense(v):
    spec = S.ScoreSpec(dimensions=("transcript_base",), consequences=("missense_variant",))
    return S.lookup(asked(v), v.scores, spec).select("site_id", "k", "status", "score")


MANIFEST = {
    "table": {"columns": ["chr", "at", "r", "a", "feature", "copy", "value"]},
    "match": {"required": ["allele", "transcript"], "dimensions": {"allele": {"chrom": "chr", "position": "at", "reference": "r", "alternate": "a"}, "transcript": {"column": "feature", "normalization": "strip_version"}}},
    "outputs": [{"id": "made_score", "column": "value", "type": "number", "minimum": 0, "maximum": 0.9}], "applicability": {"consequences": ["missense_variant", "synonymous_variant"]},
}


def by_manifest(v):
    """(spec, the table under its names): scores of alleles by place, with transcript versions that the calls don't have."""
    spec, names = S.spec_of(MANIFEST)
    sites = v.sites.select("site_id", F.col("chrom").alias("chr"), F.col("pos").alias("at"), F.col("ref").alias("r"), F.col("alt").alias("a"))
    table = v.scores.join(sites.hint("merge"), "site_id").select("chr", "at", "r", "a", F.concat("transcript_base", F.lit(".44")).alias("feature"), F.col("copy_no").alias("copy"), F.col("score").alias("value"))
    return spec, S.named(table, names)


PLACED = """
q AS (SELECT site_id, k, split_part(transcript, '.', 1) AS b, chrom, pos, ref, alt FROM fx_annotations JOIN fx_sites USING (site_id) WHERE consequence IN ('missense_variant', 'synonymous_variant')),
t AS (SELECT chrom, pos, ref, alt, transcript_base AS b, score FROM fx_scores JOIN fx_sites USING (site_id)),
m AS (SELECT q.site_id, q.k, count(*) FILTER (WHERE t.b = q.b) AS n, max(t.score) FILTER (WHERE t.b = q.b) AS score FROM q JOIN t USING (chrom, pos, ref, alt) GROUP BY ALL)"""


@on_views("e02_manifest_lookup", ("fx_annotations", "fx_scores", "fx_sites"), "SELECT site_id, k, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'exact' WHEN n = 0 THEN 'partial' END AS status, CASE WHEN n = 1 THEN score END AS made_score FROM q LEFT JOIN m USING (site_id, k)", PLACED)
def manifest_lookup(v):
    spec, scores = by_manifest(v)
    places = v.sites.select("site_id", "chrom", F.col("pos").alias("position"), F.col("ref").alias("reference"), F.col("alt").alias("alternate"))
    rows = v.annotations.select("site_id", "k", "transcript", F.concat("consequence", F.lit("&NMD_transcript_variant")).alias("consequence")).join(places.hint("merge"), "site_id")
    return S.lookup(rows, scores, spec).select("site_id", "k", "status", "made_score")


@on_views("j08_stored_lookup", ("fx_annotations", "fx_scores", "fx_sites"), """SELECT site_id, k, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'exact' WHEN n = 0 THEN 'partial' END AS status,
 CASE WHEN n > 1 THEN 'multiple_exact_records' ELSE ['allele_only', 'allele_transcript_base', 'allele_transcript_base_copy_no'][best + 1] END AS match, CASE WHEN n = 1 THEN score END AS score FROM q LEFT JOIN m USING (site_id, k)""",
 """q AS (SELECT site_id, k, split_part(transcript, '.', 1) AS b, k % 2 AS c, chrom, pos, ref, alt FROM fx_annotations JOIN fx_sites USING (site_id)),
t AS (SELECT chrom, pos, ref, alt, transcript_base AS b, copy_no AS c, score FROM fx_scores JOIN fx_sites USING (site_id)),
m AS (SELECT q.site_id, q.k, count(*) FILTER (WHERE t.b = q.b AND t.c = q.c) AS n, max(CASE WHEN t.b = q.b THEN CASE WHEN t.c = q.c THEN 2 ELSE 1 END ELSE 0 END) AS best,
  max(t.score) FILTER (WHERE t.b = q.b AND t.c = q.c) AS score FROM q JOIN t USING (chrom, pos, ref, alt) GROUP BY ALL)""")
def stored_lookup(v):
    """The score table is published by place, then looked up by all annotations."""
    store = ST.ScoreStore(v.sites.sparkSession, scratch_path(v.sites.sparkSession, "scores"), width=1 << 16)
    alleles = v.sites.select("site_id", "chrom", "pos", "ref", "alt")
    store.publish(v.scores.join(alleles.hint("merge"), "site_id").drop("site_id"))
    spec = S.ScoreSpec(("chrom", "pos", "ref", "alt"), ("transcript_base", "copy_no"))
    return store.lookup(asked(v).join(alleles.hint("merge"), "site_id"), spec).select("site_id", "k", "status", "match", "score")


@on_views("e02_scores_out_of_range", ("fx_scores", "fx_sites"), "SELECT transcript_base || '.44' AS transcript, score AS made_score, 'made_score' AS outputs FROM fx_scores JOIN fx_sites USING (site_id) WHERE score > 0.9 OR score < 0")
def range_check(v):
    spec, scores = by_manifest(v)
    return S.out_of_range(scores, spec).select("transcript", "made_score", F.array_join("outputs", ",").alias("outputs"))


def versioned(v):
    return v.scores.select("site_id", "score", F.when(F.col("site_id") % 4 == 0, F.concat("transcript_base", F.lit(".1"))).otherwise(F.concat("transcript_base", F.lit(".9"))).alias("transcript"))


@on_views("j10_version_or_base", SC, """SELECT a.site_id, a.k, CASE WHEN e.n = 1 THEN 'exact_version' WHEN e.n IS NULL AND b.n = 1 THEN 'unique_base' WHEN b.n IS NOT NULL THEN 'ambiguous' END AS match,
 CASE WHEN e.n = 1 THEN e.score WHEN e.n IS NULL AND b.n = 1 THEN b.score END AS score FROM fx_annotations a
 LEFT JOIN (SELECT site_id, transcript, count(*) AS n, max(score) AS score FROM vs GROUP BY ALL) e USING (site_id, transcript)
 LEFT JOIN (SELECT site_id, split_part(transcript, '.', 1) AS base, count(*) AS n, max(score) AS score FROM vs GROUP BY ALL) b ON b.site_id = a.site_id AND b.base = split_part(a.transcript, '.', 1)""",
 "vs AS (SELECT site_id, score, transcript_base || CASE WHEN site_id % 4 = 0 THEN '.1' ELSE '.9' END AS transcript FROM fx_scores)")
def version(v):
    return S.by_version_or_base(v.annotations.select("site_id", "k", "transcript"), versioned(v)).select("site_id", "k", "match", "score")


@on_views("j11_symbol_map", ("fx_annotations", "fx_scores", "fx_aliases"), """SELECT a.site_id, a.k, CASE WHEN n = 1 THEN score END AS score FROM fx_annotations a LEFT JOIN
 (SELECT site_id, hgnc_id, count(DISTINCT score) AS n, max(score) AS score FROM (SELECT site_id, 'OLD' || site_id % 15 AS symbol, score FROM fx_scores) JOIN
  (SELECT alias, min(hgnc_id) AS hgnc_id FROM fx_aliases GROUP BY alias HAVING count(DISTINCT hgnc_id) = 1) ON alias = symbol GROUP BY ALL) s ON s.site_id = a.site_id AND 'G' || s.hgnc_id = a.gene""")
def symbols(v):
    scores = v.scores.select("site_id", F.concat(F.lit("OLD"), F.col("site_id") % 15).alias("symbol"), "score")
    queries = v.annotations.select("site_id", "k", F.substring("gene", 2, 9).cast("long").alias("gene_id"))
    return S.by_symbol(queries, scores, v.aliases.select(F.col("alias").alias("symbol"), F.col("hgnc_id").cast("long").alias("gene_id"))).select("site_id", "k", "score")


@on_views("w08_resolved_scores", ("fx_scores",), """SELECT site_id, tier, n > 1 AS conflict, CASE WHEN n = 1 THEN score END AS score FROM (SELECT site_id, min(tier) AS tier, count(DISTINCT score) AS n, max(score) AS score FROM
 (SELECT *, CASE WHEN score % 5 = 0 THEN 0 WHEN score % 2 = 0 THEN 1 ELSE 2 END AS tier, min(CASE WHEN score % 5 = 0 THEN 0 WHEN score % 2 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY site_id) AS top FROM fx_scores) WHERE tier = top GROUP BY site_id)""")
def resolved(v):
    rows = v.scores.withColumns({"canonical": F.col("score") % 5 == 0, "exact": F.col("score") % 2 == 0})
    return S.resolved(rows, ["site_id"], "canonical", "exact").select("site_id", "tier", "conflict", "score")


@on_views("w11_best_prediction", ("fx_scores",), "SELECT site_id, score, status FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY (status = 'exact') DESC, o DESC) AS r FROM (SELECT *, CASE WHEN score % 3 = 0 THEN 'exact' ELSE 'partial' END AS status, score * 10 + copy_no AS o FROM fx_scores)) WHERE r = 1")
def best(v):
    rows = v.scores.withColumns({"status": F.when(F.col("score") % 3 == 0, "exact").otherwise("partial"), "o": F.col("score") * 10 + F.col("copy_no")})
    return S.best_prediction(rows, ["site_id"], "status", "o").select("site_id", "score", "status")


@on_views("p22_classified_scores", ("fx_scores",), "SELECT predictor, site_id, transcript_base, copy_no, CASE predictor WHEN 'p0' THEN score >= 60 WHEN 'p1' THEN score <= 20 ELSE abs(score - 50) >= 40 END AS damaging FROM (SELECT *, 'p' || site_id % 3 AS predictor FROM fx_scores)")
def classified(v):
    limits = v.scores.sparkSession.createDataFrame([("p0", 60.0, "higher"), ("p1", 20.0, "lower"), ("p2", 40.0, "absolute")], "predictor string, threshold double, direction string")
    rows = v.scores.withColumn("predictor", F.concat(F.lit("p"), F.col("site_id") % 3)).withColumn("v", F.when(F.col("site_id") % 3 == 2, F.col("score") - 50).otherwise(F.col("score")))
    return S.classified(rows, limits, "v").select("predictor", "site_id", "transcript_base", "copy_no", "damaging")


REGISTRY = [S.Predictor("missense", "alpha_missense", 0, 0.9, "transcript", priority=2), S.Predictor("frequency", "popmax", 0, 1), S.Predictor("rank", "mane", 0, 1, priority=5)]
OBSERVED = """
o AS (SELECT site_id, k, 'missense' AS predictor, CASE WHEN alpha_missense <= 0.9 THEN alpha_missense END::DOUBLE AS value, 'exact' AS status, CASE WHEN alpha_missense > 0.9 THEN 'alpha_missense' ELSE '' END AS invalid, transcript AS target FROM fx_annotations WHERE alpha_missense IS NOT NULL
 UNION ALL SELECT site_id, k, 'frequency', popmax::DOUBLE, 'exact', '', '' FROM fx_annotations WHERE popmax IS NOT NULL UNION ALL SELECT site_id, k, 'rank', mane::DOUBLE, 'exact', '', '' FROM fx_annotations)"""


@on_views("p23_e01_observations", N, "SELECT * FROM o", OBSERVED)
def observations(v):
    return S.observations(v.annotations, REGISTRY)


@on_views("f16_metric_filter", N, "SELECT * FROM o WHERE predictor = 'missense' AND value >= 0.5", OBSERVED)
def metric(v):
    return S.metric_filter(S.observations(v.annotations, REGISTRY), "missense", ">=", 0.5)


@on_views("e03_installed_sources", N, "SELECT * FROM o WHERE predictor <> 'frequency'", OBSERVED)
def installed(v):
    return S.observations(v.annotations, REGISTRY, installed=("missense", "rank"))


@on_views("w12_predictor_priority", N, "SELECT predictor, count(*) AS n, min(CASE predictor WHEN 'rank' THEN 1 WHEN 'missense' THEN 2 ELSE 3 END) AS place FROM o GROUP BY predictor", OBSERVED)
def priority(v):
    order = [p.name for p in S.checked_registry(REGISTRY)]
    rows = S.observations(v.annotations, REGISTRY).groupBy("predictor").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.array_position(F.array(*[F.lit(n) for n in order]), F.col("predictor")).cast("int"))


@on_views("a38_alt_columns", ("fx_scores",), """SELECT site_id, max(score) FILTER (WHERE alt = 'A') AS A, max(score) FILTER (WHERE alt = 'C') AS C, max(score) FILTER (WHERE alt = 'G') AS G, max(score) FILTER (WHERE alt = 'T') AS T, count(DISTINCT alt) = 3 AS complete
 FROM (SELECT *, substr('ACGT', CAST(1 + score % 4 AS INT), 1) AS alt FROM fx_scores) GROUP BY site_id""")
def alt_columns(v):
    rows = v.scores.withColumn("alt", F.substring(F.lit("ACGT"), (F.col("score") % 4 + 1).cast("int"), F.lit(1)))
    return S.pivot_alts(rows, ["site_id"])


@on_views("a39_per_position", ("fx_sites", "fx_scores"), """SELECT chrom, pos, ref, string_agg(alt || '=' || score, ',' ORDER BY alt, score) AS alts, count(*) = 3 AND count(DISTINCT alt) = 3 AND NOT bool_or(alt = ref) AS complete
 FROM (SELECT DISTINCT chrom, pos, substr(ref, 1, 1) AS ref, substr('ACGT', CAST(1 + score % 4 AS INT), 1) AS alt, score FROM fx_scores JOIN fx_sites USING (site_id)) GROUP BY ALL""")
def per_position(v):
    rows = v.scores.join(v.sites.select("site_id", "chrom", "pos", F.substring("ref", 1, 1).alias("ref")), "site_id").withColumn("alt", F.substring(F.lit("ACGT"), (F.col("score") % 4 + 1).cast("int"), F.lit(1)))
    return S.per_position(rows).withColumn("alts", F.array_join(F.transform("alts", lambda a: F.concat_ws("=", a["alt"], a["score"].cast("string"))), ","))


@on_views("a38_first_transcripts", ("fx_exons",), "SELECT chrom, tss, strand, min(tx_id) AS tx_id, count(*) AS transcripts FROM (SELECT tx_id, chrom, strand, (CASE WHEN strand = '+' THEN min(start1) ELSE max(end1) END) // 50000 AS tss FROM fx_exons GROUP BY tx_id, chrom, strand) GROUP BY chrom, tss, strand")
def first_transcripts(v):
    rows = I.gene_tss(v.exons).withColumns({"tss": F.floor(F.col("tss") / 50000), "source_ordinal": F.col("tx_id")})
    return S.first_transcript_of_tss(rows)


@on_views("x14_splice_subset", ("fx_scores",), "SELECT site_id, copy_no, transcript_base, 'G' || site_id % 23 AS symbol, (score / 100.0)::DOUBLE AS delta FROM fx_scores WHERE score % 7 <> 0")
def splice(v):
    """Entries of splice text made from scores; every seventh has a delta out of range."""
    text = F.concat(F.lit("T|G"), F.col("site_id") % 23, F.lit("|0.0|"), (F.col("score") / 100).cast("string"), F.lit("|0.00|"), F.when(F.col("score") % 7 == 0, "7.5").otherwise("0"), F.lit("|1|2|3|4"))
    return v.scores.select("site_id", "copy_no", "transcript_base", F.inline(S.parse_splice(text))).select("site_id", "copy_no", "transcript_base", "symbol", "delta")


@on_views("x12_x13_coding_subset", ("fx_sites", "fx_scores", "fx_exons"), "SELECT site_id, transcript_base, copy_no, score FROM fx_scores s JOIN keyed USING (site_id) WHERE score BETWEEN 0 AND 90 AND EXISTS (SELECT 1 FROM fx_exons e WHERE e.chrom = keyed.chrom AND pos BETWEEN e.start1 AND e.end1)", KEYED)
def coding(v):
    exons = v.exons.select("chrom", (F.col("start1") - 1).alias("start0"), F.col("end1").alias("end0"))
    sites = H.keyed_sites(v.sites).select("site_id", "chrom", "pos")
    return I.points_within(v.scores.filter(F.col("score").between(0, 90)).join(sites, "site_id"), exons).select("site_id", "transcript_base", "copy_no", "score")


@on_views("x16_probability_checks", ("fx_scores",), """SELECT site_id, transcript_base, copy_no, concat_ws(',', CASE WHEN score % 10 = 3 THEN 'sum' END, CASE WHEN (score >= 50) <> (site_id % 9 <> 0 AND score >= 50 OR site_id % 9 = 0 AND score < 50) THEN 'label' END) AS violations
 FROM fx_scores WHERE score <> 50 AND (score % 10 = 3 OR site_id % 9 = 0)""")
def probabilities(v):
    p = F.col("score") / 100.0
    rows = v.scores.filter("score <> 50").withColumns({"p1": p, "p0": F.when(F.col("score") % 10 == 3, 2 - p - 1 + 0.001).otherwise(1 - p), "label": F.when((F.col("score") >= 50) == (F.col("site_id") % 9 != 0), "one").otherwise("zero")})
    return S.probability_violations(rows, {"one": "p1", "zero": "p0"}, "label").select("site_id", "transcript_base", "copy_no", F.array_join("violations", ",").alias("violations"))


@on_views("p18_p20_promoter_status", ("fx_scores",), """SELECT site_id, transcript_base, copy_no, CASE WHEN site_id % 4 = 0 THEN 'partial' WHEN site_id % 4 = 1 THEN 'exact' WHEN site_id % 4 = 2 THEN 'unmatched' ELSE 'partial' END AS status, CASE WHEN score % 2 = 0 THEN score::DOUBLE END AS phred FROM fx_scores""")
def promoter(v):
    kind = F.col("site_id") % 4
    score = F.when(kind == 0, "0.1&0.2").when(kind == 2, ".").otherwise("0.5&0.5")
    out = S.promoter_status(score, F.when(kind != 2, F.col("transcript_base")).otherwise("-"), F.when(kind == 3, ".").when(kind == 2, "").otherwise("100"), F.when(kind == 2, ".").otherwise("-"))
    return v.scores.select("site_id", "transcript_base", "copy_no", out.alias("status"), S.phred(F.when(F.col("score") % 2 == 0, F.col("score").cast("string")).otherwise(F.concat(F.lit("-"), F.col("score")))).alias("phred"))


FLAGS = ("fx_sites", "fx_annotations", "fx_ccre", "fx_exons", "fx_scores")
ALTS = """
al AS (SELECT k.site_id, k.site_id // 2 AS record_id, (k.site_id % 2)::INT AS alt_index, k.chrom, k.pos, s.ref, s.alt, pos_raw,
  (SELECT max(popmax) FROM fx_annotations a WHERE a.site_id = k.site_id) AS popmax, (SELECT max(score) / 100.0 FROM fx_scores c WHERE c.site_id = k.site_id AND c.copy_no = 0) AS splice,
  CASE WHEN k.site_id % 3 = 0 THEN (k.site_id % 200 - 100) / 100.0 END AS promoter,
  EXISTS (SELECT 1 FROM fx_annotations a WHERE a.site_id = k.site_id AND consequence = 'intron_variant') AS intron,
  EXISTS (SELECT 1 FROM fx_exons e WHERE e.chrom = k.chrom AND pos_raw - 1 < e.end1 + 20 AND e.start1 - 21 < pos_raw - 1 + length(s.ref)) AS in_exome,
  EXISTS (SELECT 1 FROM fx_ccre e WHERE e.chrom = k.chrom AND pos_raw - 1 < e.end0 AND e.start0 < pos_raw - 1 + length(s.ref)) AS in_ccre,
  EXISTS (SELECT 1 FROM (SELECT chrom, CASE WHEN strand = '+' THEN min(start1) ELSE max(end1) END AS tss FROM fx_exons GROUP BY tx_id, chrom, strand) t WHERE t.chrom = k.chrom AND pos_raw - 1 < t.tss + 500 AND t.tss - 501 < pos_raw - 1 + length(s.ref)) AS in_promoter
  FROM keyed k JOIN (SELECT site_id, pos AS pos_raw, ref, alt FROM fx_sites) s USING (site_id)),
ev AS (SELECT *, coalesce(popmax > 0.03, FALSE) AS common, CASE WHEN coalesce(popmax > 0.03, FALSE) THEN '' ELSE concat_ws('&', CASE WHEN length(ref) <> length(alt) AND splice IS NULL AND intron THEN 'splice_intronic' END, CASE WHEN length(ref) <> length(alt) AND promoter IS NULL AND in_promoter THEN 'promoter' END) END AS reasons FROM al),
rt AS (SELECT *, CASE WHEN common THEN NULL WHEN in_exome THEN 'exome' WHEN splice >= 0.8 THEN 'splice' WHEN abs(promoter) >= 0.8 THEN 'promoter' WHEN in_ccre THEN 'noncoding' WHEN reasons <> '' THEN 'unscored_indel' END AS route FROM ev)"""


def evaluated(v):
    """ALTs of sites, two to a record, with what the prefilter looks at."""
    chrom = A.chromosome(F.col("chrom"))
    alts = v.sites.select("site_id", F.floor(F.col("site_id") / 2).alias("record_id"), (F.col("site_id") % 2).cast("int").alias("alt_index"), chrom.alias("chrom"), "pos", "ref", "alt", F.when(F.col("site_id") % 3 == 0, (F.col("site_id") % 200 - 100) / 100).alias("promoter"))
    notes = v.annotations.groupBy("site_id").agg(F.max("popmax").alias("popmax"), F.collect_set("consequence").alias("consequences"))
    splice = v.scores.filter("copy_no = 0").groupBy("site_id").agg((F.max("score") / 100).alias("splice"))
    alts = alts.join(notes, "site_id").join(splice, "site_id", "left")
    alts = W.flags(alts, {"in_exome": I.coding_and_splice(v.exons, pad=20), "in_ccre": v.ccre, "in_promoter": I.around(I.gene_tss(v.exons), "tss", 500)})
    return W.evaluate(alts, W.PrefilterOptions(max_popmax=0.03, min_splice=0.8))


@on_views("f08_prefilter", FLAGS, "SELECT site_id, reasons, route, route IS NOT NULL AS retain FROM rt", KEYED, ALTS)
def prefilter(v):
    return evaluated(v).select("site_id", F.array_join("reasons", "&").alias("reasons"), "route", "retain")


@on_views("f09_x11_records", FLAGS, "SELECT record_id, bool_or(route IS NOT NULL) AS retain, CASE WHEN bool_or(reasons <> '') THEN string_agg(CASE WHEN reasons = '' THEN '.' ELSE reasons END, ',' ORDER BY alt_index) END AS flag FROM rt GROUP BY record_id", KEYED, ALTS)
def records(v):
    return W.records(evaluated(v))


@on_views("x11_route_counts", FLAGS, "SELECT coalesce(route, 'dropped') AS route, count(*) AS alts FROM rt GROUP BY 1", KEYED, ALTS)
def routes(v):
    return W.route_counts(evaluated(v))


@on_views("x15_gene_scores", ("fx_sites",), """SELECT site_id, CASE WHEN reason IS NULL THEN concat_ws(':', c, pos, ref, alt, gene, CASE WHEN site_id % 7 = 0 THEN '.' ELSE (site_id % 100)::VARCHAR || 'e-2' END) ELSE reason END AS row_text
 FROM (SELECT *, CASE WHEN chrom = 'M' THEN 'MT' ELSE replace(chrom, 'chr', '') END AS c, 'ENSG' || lpad(site_id::VARCHAR, 11, '0') AS gene, CASE WHEN site_id % 31 = 0 THEN 'variant id' WHEN site_id % 37 = 0 THEN 'contig' WHEN site_id % 41 = 0 THEN 'position' WHEN length(ref) <> 1 OR length(alt) <> 1 OR ref = alt THEN 'not a single base'
   WHEN site_id % 43 = 0 THEN 'gene' WHEN site_id % 47 = 0 THEN 'score b' END AS reason FROM fx_sites)""")
def gene_scores(v):
    """Score rows with ids of four parts, withheld scores and one broken rule each."""
    n = F.col("site_id")
    allele = F.when(n % 31 == 0, "1-5-A").otherwise(F.concat_ws("-", F.when(n % 37 == 0, "chr23").otherwise(F.col("chrom")), F.when(n % 41 == 0, "0").otherwise(F.col("pos").cast("string")), F.lower("ref"), "alt"))
    gene = F.concat(F.lit("ENSG"), F.lpad(n.cast("string"), 11, "0"), F.when(n % 43 == 0, "x").when(n % 3 == 0, ".12").otherwise(""))
    a = F.when(n % 7 == 0, F.element_at(F.array(F.lit("NA"), F.lit(" "), F.lit("nan")), (n % 3 + 1).cast("int"))).otherwise(F.concat(n % 100, F.lit("e-2")))
    rows = v.sites.select("site_id", allele.alias("variant"), gene.alias("gene"), a.alias("a"), F.when(n % 47 == 0, "1.5").otherwise(".").alias("b"))
    read = S.gene_scores(rows, ["a", "b"])
    # the site comes along through the gene id, which the rows carry
    back = F.substring("gene", 5, 11).cast("int")
    text = F.when(F.col("reason").isNull(), F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt", "gene", "a")).otherwise(F.col("reason"))
    return read.select(back.alias("site_id"), text.alias("row_text"))


def sourced(v):
    """Annotations with columns of three sources, in all states of a match."""
    n, cut = F.col("site_id") + F.col("k"), F.substring_index("transcript", ".", 1)
    pick = lambda m, *texts: F.element_at(F.array(*[F.lit(t) if t is None or isinstance(t, str) else t for t in texts]), (n % m + 1).cast("int"))
    return v.annotations.withColumns({
        "hgvsp": F.concat(F.lit("p.Ala"), (1 + n % 50).cast("string"), F.lit("Gly")),
        "FuncVEP_CTI": pick(4, "0.25", "1.5", "", "."), "FuncVEP_SP": pick(3, "0.5", None, "x"), "FuncVEP_allele_available": pick(5, "yes", "0", "?", None, "TRUE"),
        "FuncVEP_match_status": pick(6, None, "Exact", "ambiguous", "other", None, "unmatched"), "FuncVEP_match": pick(7, None, "allele_gene", None, None, "x", None, None), "FuncVEP_source_gene": pick(8, "ENSG1", "ENSG2.3", "G", "", "ENSG5", "ENSG6", "ENSG7", "ENSG8"),
        "LoGoFunc_gof": pick(3, "0.75", None, "0.5"), "LoGoFunc_prediction": pick(4, "GOF", "LOF", "gof", None), "LoGoFunc_match": pick(3, "allele_transcript_protein", "exact_version", "ALLELE_TRANSCRIPT_PROTEIN"), "LoGoFunc_source_transcript": pick(5, F.col("transcript"), cut, F.lit("ENST9.1"), F.lit("NM_1"), F.lit("")),
        "LoGoFunc_source_HGVSp": F.when(n % 11 == 0, "p.Ala7Gly").otherwise(F.concat(F.lit("p.Ala"), (1 + n % 50).cast("string"), F.lit("Gly"))),
        "promoterAI": pick(3, "-0.5", "0.25", "2"), "PromoterAI_match": pick(4, "exact_version", "stable_id", "tss", None), "PromoterAI_source_transcript": pick(4, F.col("transcript"), cut, F.concat(cut, F.lit(".77")), F.lit("ENST1.1")), "PromoterAI_tss": pick(6, "100", "200", "300", "400", "500", "-"), "PromoterAI_strand": pick(5, "+", "-", "1", "?", "-1"),
    })


#: The three rules as cases over the same columns, source by source.
SOURCED = """
sn AS (SELECT site_id, k, transcript, (site_id + k) AS n, split_part(transcript, '.', 1) AS base FROM fx_annotations),
fv AS (SELECT *, CASE n % 4 WHEN 0 THEN 0.25 END AS cti, n % 4 = 1 AS bad_cti, CASE n % 3 WHEN 0 THEN 0.5 END AS sp, n % 3 = 2 AS bad_sp, CASE n % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 4 THEN TRUE END AS avail, n % 5 = 2 AS bad_avail,
  CASE n % 6 WHEN 1 THEN 'exact' WHEN 2 THEN 'ambiguous' WHEN 5 THEN 'unmatched' END AS stated, n % 6 IN (1, 2, 3, 5) AS has_stated, n % 7 IN (1, 4) AS has_match, n % 7 = 1 AS matches, n % 8 = 2 AS bad_gene, n % 8 = 3 AS no_gene FROM sn),
fs AS (SELECT *, coalesce(stated, CASE WHEN matches OR cti IS NOT NULL OR sp IS NOT NULL THEN 'exact' WHEN avail THEN 'partial' ELSE 'unmatched' END) AS s FROM fv WHERE cti IS NOT NULL OR sp IS NOT NULL OR avail IS NOT NULL OR has_stated OR has_match),
fo AS (SELECT site_id, k, 'funcvep' AS predictor, CASE WHEN bad_gene OR (s = 'exact' AND no_gene) THEN 'partial' ELSE s END AS status, FALSE AS bind, bad_gene OR (s = 'exact' AND no_gene) AS lost,
  [CASE WHEN cti IS NOT NULL THEN 'cti=0.25' END, CASE WHEN sp IS NOT NULL THEN 'sp=0.5' END] AS scores, CASE WHEN avail IS NOT NULL THEN 'allele_available=' || avail::VARCHAR END AS flag, s,
  concat_ws(',', CASE WHEN bad_avail THEN 'allele_available' END, CASE WHEN bad_cti THEN 'cti' END, CASE WHEN bad_sp THEN 'sp' END) AS invalid_metrics, CASE WHEN bad_gene THEN 'ensembl_gene' ELSE '' END AS invalid_dimensions, CASE WHEN s = 'exact' AND (no_gene OR bad_gene) THEN 'ensembl_gene' ELSE '' END AS missing_dimensions FROM fs),
f AS (SELECT site_id, k, predictor, status, bind, CASE WHEN lost THEN '' ELSE concat_ws(',', CASE WHEN s = 'exact' THEN scores[1] END, CASE WHEN s = 'exact' THEN scores[2] END, flag) END AS vals,
  concat_ws(',', CASE WHEN lost AND flag IS NOT NULL THEN 'allele_available' END, CASE WHEN (lost OR s <> 'exact') AND scores[1] IS NOT NULL THEN 'cti' END, CASE WHEN (lost OR s <> 'exact') AND scores[2] IS NOT NULL THEN 'sp' END) AS withheld, invalid_metrics, invalid_dimensions, missing_dimensions FROM fo),
lv AS (SELECT *, CASE n % 3 WHEN 0 THEN 'gof=0.75' WHEN 2 THEN 'gof=0.5' END AS gof, CASE n % 4 WHEN 0 THEN 'prediction=GOF' WHEN 1 THEN 'prediction=LOF' END AS pred, n % 3 <> 1 AS s, n % 5 = 3 AS bad_tx, n % 5 = 4 AS no_tx, n % 5 IN (0, 1) AS own_tx, NOT (n % 11 = 0 AND 1 + n % 50 <> 7) AS same_p FROM sn),
l AS (SELECT site_id, k, 'logofunc' AS predictor, CASE WHEN s AND NOT bad_tx AND NOT no_tx THEN 'exact' ELSE 'partial' END AS status, s AND own_tx AND same_p AS bind, CASE WHEN s AND NOT bad_tx AND NOT no_tx THEN concat_ws(',', gof, pred) ELSE '' END AS vals,
  CASE WHEN s AND NOT bad_tx AND NOT no_tx THEN '' ELSE concat_ws(',', CASE WHEN gof IS NOT NULL THEN 'gof' END, CASE WHEN pred IS NOT NULL THEN 'prediction' END) END AS withheld, CASE WHEN n % 4 = 2 THEN 'prediction' ELSE '' END AS invalid_metrics,
  CASE WHEN bad_tx THEN 'ensembl_transcript' ELSE '' END AS invalid_dimensions, CASE WHEN s AND (no_tx OR bad_tx) THEN 'ensembl_transcript' ELSE '' END AS missing_dimensions FROM lv),
pv AS (SELECT *, CASE n % 3 WHEN 0 THEN 'score=-0.5' WHEN 1 THEN 'score=0.25' END AS score, n % 3 = 2 AS bad_score, n % 4 IN (0, 1) AS known, n % 4 <> 3 AS has_match, n % 6 = 5 AS no_tss, n % 5 = 3 AS bad_strand FROM sn),
pc AS (SELECT *, known AND score IS NOT NULL AS s FROM pv WHERE score IS NOT NULL OR has_match),
p AS (SELECT site_id, k, 'promoterai' AS predictor, CASE WHEN s AND NOT no_tss AND NOT bad_strand THEN 'exact' ELSE 'partial' END AS status, s AND NOT no_tss AND NOT bad_strand AS bind, CASE WHEN s AND NOT no_tss AND NOT bad_strand THEN score ELSE '' END AS vals,
  CASE WHEN (NOT s OR no_tss OR bad_strand) AND score IS NOT NULL THEN 'score' ELSE '' END AS withheld, CASE WHEN bad_score THEN 'score' ELSE '' END AS invalid_metrics, CASE WHEN bad_strand THEN 'strand' ELSE '' END AS invalid_dimensions,
  CASE WHEN s THEN concat_ws(',', CASE WHEN bad_strand THEN 'strand' END, CASE WHEN no_tss THEN 'tss_position' END) ELSE '' END AS missing_dimensions FROM pc)"""


@on_views("p23_source_rules", N, "SELECT * FROM f UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p", SOURCED)
def source_rules(v):
    rows = SR.source_observations(sourced(v), SR.RULES)
    vals = F.transform("values", lambda x: F.concat_ws("=", x["metric"], F.coalesce(x["number"].cast("string"), x["text"], x["flag"].cast("string"))))
    lists = [F.array_join(c, ",").alias(c) for c in ("withheld", "invalid_metrics", "invalid_dimensions", "missing_dimensions")]
    return rows.select("site_id", "k", "predictor", "status", "bind", F.array_join(vals, ",").alias("vals"), *lists)
