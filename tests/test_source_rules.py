"""Rules of predictors on single rows."""

import pytest

from varloom.operators import source_rules as R


def one(spark, predictor, **row):
    base = {"site_id": 1, "k": 0, "transcript": "ENST1.2", "hgvsp": "p.Ala5Gly"} | row
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in base.items()))
    out = R.source_observations(df, tuple(r for r in R.RULES if r.predictor == predictor)).collect()
    return out[0] if out else None


def values(r):
    return {v.metric: v.number if v.number is not None else v.text if v.text is not None else v.flag for v in r["values"]}


def test_partial_gene_match_withholds_scores_only(spark):
    r = one(spark, "funcvep", FuncVEP_CTI="0.4", FuncVEP_allele_available="yes", FuncVEP_match_status="partial", FuncVEP_source_gene="ENSG1.4")
    assert (r.status, values(r), r.withheld, r.bind) == ("partial", {"allele_available": True}, ["cti"], False)
    r = one(spark, "funcvep", FuncVEP_CTI="0.4", FuncVEP_source_gene="ENSG1.4")
    assert (r.status, values(r), r.target) == ("exact", {"cti": 0.4}, {"ensembl_gene": "ENSG1.4"})
    r = one(spark, "funcvep", FuncVEP_CTI="0.4", FuncVEP_source_gene=".")
    assert (r.status, values(r), r.missing_dimensions, r.withheld) == ("partial", {}, ["ensembl_gene"], ["cti"])
    assert one(spark, "funcvep", FuncVEP_CTI="nan") is None and one(spark, "promoterai", other="1") is None


def test_binding_knows_versions(spark):
    row = {"LoGoFunc_gof": "0.5", "LoGoFunc_match": "allele_transcript_protein", "LoGoFunc_source_HGVSp": "p.Ala5Gly"}
    r = one(spark, "logofunc", **row, LoGoFunc_source_transcript="ENST1.9")
    assert (r.status, r.bind, r.target) == ("exact", True, {"ensembl_transcript": "ENST1", "protein_position": "5", "amino_acid_change": "A5G"})
    assert not one(spark, "logofunc", **row | {"LoGoFunc_source_HGVSp": "p.Ala6Gly"}, LoGoFunc_source_transcript="ENST1.9").bind
    p = {"PromoterAI_score": "-0.5", "PromoterAI_tss": "9", "PromoterAI_strand": "-", "PromoterAI_source_transcript": "ENST1.9"}
    assert one(spark, "promoterai", **p, PromoterAI_match="stable_id").bind and not one(spark, "promoterai", **p, PromoterAI_match="exact_version").bind
    r = one(spark, "promoterai", **p, PromoterAI_match="exact_version", transcript="ENST1")
    assert r.bind and r.target["ensembl_transcript"] == "ENST1.9"
    r = one(spark, "promoterai", **p | {"PromoterAI_strand": "x"}, PromoterAI_match="exact_version")
    assert (r.status, r.invalid_dimensions, values(r), r.withheld) == ("partial", ["strand"], {}, ["score"])
    r = one(spark, "promoterai", **p | {"PromoterAI_score": "7"}, PromoterAI_match="exact_version")
    assert (r.status, r.invalid_metrics, [x.value for x in r.provenance]) == ("partial", ["score"], ["exact_version"])


def test_bad_rules_are_refused():
    good = R.RULES[0]
    for change in ({"scope": "nowhere"}, {"withheld": ("nothing",)}, {"required": ("strand",)}, {"status": (("guess", (), "exact"),)}):
        with pytest.raises(ValueError):
            R.checked((R.Rule(**(good.__dict__ | change)),))
    with pytest.raises(ValueError):
        R.checked((good, good))
