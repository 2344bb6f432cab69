"""Queries on trios."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import calls as C
from varloom.operators import cohort as H
from varloom.operators import trio as Y
from varloom.plans.base import KEYED, on_views

V = ("fx_sites", "fx_calls", "fx_trios", "fx_annotations")


def _one_parent(p: str) -> dict[str, str]:
    return {
        "carrier": f"coalesce({p}gt <> '0/0', FALSE)",
        "called": f"coalesce({p}gt <> './1', FALSE)",
        "good": f"coalesce({p}gt <> './1' AND {p}dp >= 10 AND {p}gq >= 20, FALSE)",
        "ref": f"coalesce({p}gt = '0/0', FALSE)",
        "ab": f"(CASE WHEN {p}dp > 0 THEN {p}alt / {p}dp::DOUBLE END)",
    }


M, P = _one_parent("m_"), _one_parent("f_")
ROWS = """
pc AS (SELECT *, CASE WHEN dp > 0 THEN ad_alt / dp::DOUBLE END AS ab FROM fx_calls WHERE filter IN ('PASS', '.')),
tr AS (SELECT t.*, c.site_id, k.chrom, k.pos, k.variant_key, c.gt, c.dp, c.gq, c.ab, m.gt AS m_gt, m.dp AS m_dp, m.gq AS m_gq, m.ad_alt AS m_alt, f.gt AS f_gt, f.dp AS f_dp, f.gq AS f_gq, f.ad_alt AS f_alt,
  CASE WHEN k.chrom = 'MT' THEN 'mt' WHEN proband_sex = 'male' AND k.chrom = 'X' AND k.pos > 2781479 AND k.pos < 155701383 THEN 'x' END AS one
  FROM fx_trios t JOIN pc c ON c.sample_id = t.proband AND c.gt <> '0/0' JOIN keyed k USING (site_id)
  LEFT JOIN pc m ON m.sample_id = t.mother AND m.site_id = c.site_id LEFT JOIN pc f ON f.sample_id = t.father AND f.site_id = c.site_id)"""
DENOVO = f"""
dn AS (SELECT *, CASE WHEN ({M['carrier']} AND {M['good']}) OR (one IS NULL AND {P['carrier']} AND {P['good']}) THEN 'inherited'
  WHEN {M['carrier']} OR (one IS NULL AND {P['carrier']}) THEN 'possible'
  WHEN one IS NULL AND gt = '1/1' THEN 'mendelian_conflict'
  WHEN NOT (gt <> './1' AND dp >= 10 AND gq >= 20) THEN 'likely_artifact'
  WHEN ab IS NULL OR ab < 0.2 OR (one IS NULL AND ab > 0.8) THEN 'likely_artifact'
  WHEN NOT {M['called']} OR (one IS NULL AND NOT {P['called']}) THEN 'possible'
  WHEN NOT {M['ref']} OR (one IS NULL AND NOT {P['ref']}) THEN 'mendelian_conflict'
  WHEN coalesce({M['ab']} > 0.02, FALSE) OR (one IS NULL AND coalesce({P['ab']} > 0.02, FALSE)) THEN 'possible_parental_mosaicism'
  WHEN NOT {M['good']} OR {M['ab']} IS NULL OR (one IS NULL AND (NOT {P['good']} OR {P['ab']} IS NULL)) THEN 'possible'
  ELSE 'high_confidence' END AS status FROM tr)"""
ORIGIN = f"""
og AS (SELECT *, CASE WHEN {M['carrier']} AND {P['carrier']} THEN 'both' WHEN {M['carrier']} AND {P['ref']} THEN CASE WHEN {M['good']} AND {P['good']} THEN 'maternal' ELSE 'unknown' END
  WHEN {P['carrier']} AND {M['ref']} THEN CASE WHEN {M['good']} AND {P['good']} THEN 'paternal' ELSE 'unknown' END WHEN status = 'high_confidence' THEN 'de_novo' ELSE 'unknown' END AS origin FROM dn)"""
PAIRS = """
gn AS (SELECT DISTINCT site_id, gene FROM fx_annotations),
ht AS (SELECT family_id, proband, proband_sex, gene, chrom, site_id, variant_key, pos, gt, origin, CAST(FLOOR(pos / 50000.0) AS BIGINT) AS block FROM og JOIN gn USING (site_id) WHERE gt IN ('0/1', '0|1', '1|0')),
pr AS (SELECT a.family_id, a.gene, a.chrom, a.variant_key AS first_key, b.variant_key AS second_key, a.site_id AS first_site, b.site_id AS second_site,
  CASE WHEN a.proband_sex = 'male' AND a.chrom = 'X' AND ((a.pos > 2781479 AND a.pos < 155701383) OR (b.pos > 2781479 AND b.pos < 155701383)) THEN 'excluded_hemizygous'
   WHEN contains(a.gt, '|') AND contains(b.gt, '|') AND a.block = b.block THEN CASE WHEN a.gt <> b.gt THEN 'confirmed_trans_phasing' ELSE 'cis' END
   WHEN a.origin IN ('maternal', 'paternal') AND b.origin IN ('maternal', 'paternal') THEN CASE WHEN a.origin <> b.origin THEN 'confirmed_trans_inheritance' ELSE 'cis' END
   WHEN (a.origin = 'de_novo' AND b.origin IN ('maternal', 'paternal')) OR (b.origin = 'de_novo' AND a.origin IN ('maternal', 'paternal')) THEN 'possible_trans' ELSE 'phase_unknown' END AS phase
  FROM ht a JOIN ht b USING (family_id, proband, gene, chrom) WHERE a.site_id < b.site_id)"""


def rows_(v):
    """Trio rows with place and key; calls of one block of 50 kb share a phase set here."""
    sites = H.keyed_sites(v.sites).select("site_id", "chrom", "pos", "variant_key")
    calls = C.passing(v.calls).join(sites.select("site_id", F.concat_ws("-", "chrom", F.floor(F.col("pos") / 50000).cast("string")).alias("phase_set")), "site_id")
    return Y.with_parents(calls, v.trios).join(sites, "site_id")


@on_views("j16_trio_rows", V, "SELECT family_id, site_id, gt AS child_gt, m_gt AS mother_gt, f_gt AS father_gt FROM tr", KEYED, ROWS)
def trio_rows(v):
    return rows_(v).select("family_id", "site_id", F.col("child.gt").alias("child_gt"), F.col("mother_ev.gt").alias("mother_gt"), F.col("father_ev.gt").alias("father_gt"))


@on_views("x02_de_novo", V, "SELECT family_id, site_id, status FROM dn", KEYED, ROWS, DENOVO)
def de_novo(v):
    return Y.de_novo(rows_(v)).select("family_id", "site_id", "status")


@on_views("x03_parental_origin", V, "SELECT family_id, site_id, origin FROM og", KEYED, ROWS, DENOVO, ORIGIN)
def origin(v):
    return Y.origin(Y.de_novo(rows_(v))).select("family_id", "site_id", "origin")


@on_views("x04_j17_compound_pairs", V, "SELECT family_id, gene, first_key, second_key, phase FROM pr", KEYED, ROWS, DENOVO, ORIGIN, PAIRS)
def pairs(v):
    return Y.compound_pairs(Y.origin(Y.de_novo(rows_(v))), v.annotations).select("family_id", "gene", F.col("first.variant_key").alias("first_key"), F.col("second.variant_key").alias("second_key"), "phase")


@on_views("a20_trio_completeness", V, """SELECT family_id, status, count(DISTINCT site_id) AS sites, count(DISTINCT site_id) FILTER (WHERE m_gt <> './1' AND f_gt <> './1') AS with_both_parents FROM dn GROUP BY ALL""", KEYED, ROWS, DENOVO)
def completeness(v):
    return Y.completeness(Y.de_novo(rows_(v)))


@on_views("w10_representative_rows", ("fx_annotations",), "SELECT site_id, gene, k FROM (SELECT *, row_number() OVER (PARTITION BY site_id, gene ORDER BY mane DESC, picked DESC, k) AS r FROM fx_annotations) WHERE r = 1")
def representative(v):
    return Y.representative(v.annotations).select("site_id", "gene", "k")


@on_views("f06_compound_view", V, """SELECT family_id, site_id, status FROM dn SEMI JOIN (SELECT family_id, first_site AS site_id FROM pr WHERE phase <> 'cis' UNION SELECT family_id, second_site FROM pr WHERE phase <> 'cis') USING (family_id, site_id)""", KEYED, ROWS, DENOVO, ORIGIN, PAIRS)
def compound_view(v):
    rows = Y.origin(Y.de_novo(rows_(v)))
    return Y.in_view(rows, "compound", v.annotations).select("family_id", "site_id", "status")


@on_views("f06_o03_de_novo_view", V, "SELECT family_id, site_id, status FROM dn WHERE status IN ('high_confidence', 'possible', 'possible_parental_mosaicism')", KEYED, ROWS, DENOVO)
def de_novo_view(v):
    return Y.by_status(Y.in_view(Y.de_novo(rows_(v)), "de_novo"), "family_id", "site_id").select("family_id", "site_id", "status")


@on_views("a20_pair_counts", V, "SELECT family_id, gene, chrom, count(*) AS sites, count(*) * (count(*) - 1) // 2 AS pairs FROM ht GROUP BY ALL", KEYED, ROWS, DENOVO, ORIGIN, PAIRS)
def pair_counts(v):
    return Y.pair_counts(rows_(v), v.annotations)


def ped(v):
    """Pedigree text of the fixture's families, with parents outside of the family and a child whose mother isn't known."""
    n = F.col("c_custkey")
    rows = v.table("customer").select(F.concat(F.lit("F"), F.floor(n / 3).cast("string")).alias("family"), F.concat(F.lit("S"), n.cast("string")).alias("sample"),
        F.when(n % 3 == 0, F.concat(F.lit("S"), (n + 2).cast("string"))).otherwise("0").alias("father"), F.when((n % 3 == 0) & (n % 15 != 0), F.concat(F.lit("S"), (n + 1).cast("string"))).when(n % 3 == 0, ".").otherwise("-9").alias("mother"),
        F.when(n % 2 == 0, "1").otherwise("2").alias("sex"), F.when((n % 3 == 0) & (n % 2 == 0), "2").otherwise("1").alias("affected"), n.alias("line"))
    return rows


@on_views("s11_x05_trios", (), """SELECT 'F' || c_custkey // 3 AS family_id, 'S' || c_custkey AS proband, 'S' || (c_custkey + 1) AS mother, 'S' || (c_custkey + 2) AS father, 'male' AS proband_sex
 FROM c c1 WHERE c_custkey % 6 = 0 AND c_custkey % 15 <> 0 AND EXISTS (SELECT 1 FROM c c2 WHERE c2.c_custkey = c1.c_custkey + 1) AND EXISTS (SELECT 1 FROM c c2 WHERE c2.c_custkey = c1.c_custkey + 2)""", "c AS (SELECT c_custkey FROM customer)")
def trios(v):
    return Y.trios(Y.members(ped(v)))[0]


@on_views("x05_trio_warnings", ("fx_files",), """SELECT 'F' || c_custkey // 3 AS family_id, 'S' || c_custkey AS proband, 'sample not found' AS warning FROM c
 WHERE c_custkey % 6 = 0 AND c_custkey % 15 <> 0 AND (SELECT count(*) FROM fx_files f WHERE f.sample_id IN ('S' || c_custkey, 'S' || (c_custkey + 1), 'S' || (c_custkey + 2)) AND f.file_id <> 1) < 3""", "c AS (SELECT c_custkey FROM customer)")
def warnings(v):
    return Y.trios(Y.members(ped(v)), v.files.filter("file_id <> 1"))[1]
