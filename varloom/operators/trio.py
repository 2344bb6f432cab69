"""Families: pedigrees and trios, de novo assessment, parental origin, and phase of compound heterozygotes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import genotypes as G
from varloom.operators import transcripts as T

#: Statuses in the order in which a reviewer reads them.
STATUSES = ("high_confidence", "possible", "possible_parental_mosaicism", "mendelian_conflict", "likely_artifact", "inherited", "not_proband")


@dataclass(frozen=True)
class TrioThresholds:
    child_min_dp: float = 10
    parent_min_dp: float = 10
    min_gq: float = 20
    child_ab_min: float = 0.2
    child_ab_max: float = 0.8
    parent_ab_max: float = 0.02


DEFAULT = TrioThresholds()


def members(ped: DataFrame) -> DataFrame:
    """family, sample, father, mother, sex, affected from six text columns; 0, . and -9 name no parent. Of repeated members the first stays."""
    parent = lambda c: F.when(~F.trim(c).isin("0", ".", "-9", ""), F.trim(c))
    rows = ped.select("family", "sample", parent(F.col("father")).alias("father"), parent(F.col("mother")).alias("mother"), F.when(F.col("sex") == "1", "male").when(F.col("sex") == "2", "female").otherwise("unknown").alias("sex"), F.when(F.col("affected") == "2", "affected").when(F.col("affected") == "1", "unaffected").otherwise("unknown").alias("affected"), "line")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("family", "sample").orderBy("line"))).filter("_r = 1").drop("_r", "line")


def trios(people: DataFrame, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trios, warnings): children with two parents, affected ones only if the pedigree has any; all three different and present.

    samples: sample ids of the loaded calls; members of the pedigree if None.
    """
    children = people.filter(F.col("father").isNotNull() & F.col("mother").isNotNull())
    any_affected = children.agg(F.coalesce(F.max(F.col("affected") == "affected"), F.lit(False)).alias("_any"))  # one row
    children = children.join(F.broadcast(any_affected)).filter(~F.col("_any") | (F.col("affected") == "affected")).drop("_any")
    known = (people.select("sample") if samples is None else samples.select(F.col("sample_id").alias("sample"))).distinct()
    rows = children.withColumn("distinct_people", (F.col("sample") != F.col("father")) & (F.col("sample") != F.col("mother")) & (F.col("father") != F.col("mother")))
    for role in ("sample", "father", "mother"):
        rows = rows.join(known.select(F.col("sample").alias("_known"), F.lit(True).alias(f"_has_{role}")), F.col(role) == F.col("_known"), "left").drop("_known")
    present = F.col("_has_sample").isNotNull() & F.col("_has_father").isNotNull() & F.col("_has_mother").isNotNull()
    good = rows.filter(F.col("distinct_people") & present).select(F.col("family").alias("family_id"), F.col("sample").alias("proband"), "mother", "father", F.col("sex").alias("proband_sex"))
    bad = rows.filter(~(F.col("distinct_people") & present)).select(F.col("family").alias("family_id"), F.col("sample").alias("proband"), F.when(~F.col("distinct_people"), "not three people").otherwise("sample not found").alias("warning"))
    return good, bad


def evidence(calls: DataFrame, allele: int = 1) -> DataFrame:
    """sample_id, site_id, ev: struct of what the assessment needs of a call."""
    a, gt = F.lit(allele), F.col("gt")
    called = G.fully_called(gt)
    haplotype = F.when(G.is_phased(gt), F.array_position(G.allele_tokens(gt), a.cast("string")).cast("int") - 1)
    ev = F.struct("gt", called.alias("called"), (G.copies(gt, a) > 0).alias("carrier"), "dp", "gq", "ad_alt", (F.col("dp") - F.col("ad_alt")).alias("ad_ref"), G.allele_balance(F.col("ad_alt"), F.col("dp")).alias("ab"), G.is_phased(gt).alias("phased"), haplotype.alias("haplotype"), (F.col("phase_set") if "phase_set" in calls.columns else F.lit(None).cast("string")).alias("phase_set"))
    return calls.select("sample_id", "site_id", ev.alias("ev"))


def with_parents(calls: DataFrame, families: DataFrame) -> DataFrame:
    """A row for each trio and site that the proband carries: child, mother, father (evidence, null without a call)."""
    ev = evidence(calls)
    child = ev.filter("ev.carrier").select(F.col("sample_id").alias("proband"), "site_id", F.col("ev").alias("child"))
    rows = child.join(families, "proband")
    for role in ("mother", "father"):
        own = ev.select(F.col("sample_id").alias("_s"), F.col("site_id").alias("_site"), F.col("ev").alias(f"{role}_ev"))
        rows = rows.join(own, (F.col(role) == F.col("_s")) & (F.col("site_id") == F.col("_site")), "left").drop("_s", "_site")
    return rows


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _adequate(ev: str, dp: float, gq: float) -> Column:
    return _true(F.col(f"{ev}.called") & (F.col(f"{ev}.dp") >= dp) & (F.col(f"{ev}.gq") >= gq))


def transmission() -> Column:
    """Which parent alone transmits: x and mt the mother, y the father; null for both. X and Y count for male probands only."""
    male = F.col("proband_sex") == "male"
    outside = A.single_copy(F.col("chrom"), F.col("pos"))
    return F.when(F.col("chrom") == "MT", "mt").when(male & (F.col("chrom") == "Y"), "y").when(male & (F.col("chrom") == "X") & outside, "x")


def de_novo(rows: DataFrame, t: TrioThresholds = DEFAULT) -> DataFrame:
    """rows of `with_parents` (with chrom and pos) with `status` and `reasons`. The branches are read in order."""
    rows = rows.withColumn("_one", transmission())
    asked = {"mother": F.coalesce(F.col("_one") != "y", F.lit(True)), "father": F.coalesce(F.col("_one") == "y", F.lit(True))}
    ev = {"mother": "mother_ev", "father": "father_ev"}
    which = lambda test: F.array_compact(F.array(*[F.when(asked[p] & test(ev[p]), p) for p in ("mother", "father")]))
    any_ = lambda names: F.size(names) > 0
    carrying = which(lambda e: _true(F.col(f"{e}.carrier")))
    supported = which(lambda e: _true(F.col(f"{e}.carrier")) & _adequate(e, t.parent_min_dp, t.min_gq))
    uncalled = which(lambda e: ~_true(F.col(f"{e}.called")))
    not_ref = which(lambda e: ~(_true(F.col(f"{e}.called")) & G.is_hom_ref(F.col(f"{e}.gt"))))
    mosaic = which(lambda e: _true(F.col(f"{e}.ab") > t.parent_ab_max))
    weak = which(lambda e: ~_adequate(e, t.parent_min_dp, t.min_gq))
    no_depth = which(lambda e: F.col(f"{e}.ad_alt").isNull() | F.col(f"{e}.ad_ref").isNull() | F.col(f"{e}.ab").isNull())
    hom_child = F.col("_one").isNull() & F.col("child.gt").rlike(r"^([1-9][0-9]*)[|/]\1$")
    ab = F.col("child.ab")
    bad_ab = ab.isNull() | (ab < t.child_ab_min) | (F.col("_one").isNull() & (ab > t.child_ab_max))
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reasons"))
    say = lambda *texts: F.array(*[F.lit(x) for x in texts])
    named = lambda text, names: F.array(F.concat(F.lit(text + ": "), F.array_join(names, " and ")))
    verdict = (
        F.when(~_true(F.col("child.carrier")), out("not_proband", say("the proband doesn't carry the allele")))
        .when(any_(supported), out("inherited", named("the allele is present", supported)))
        .when(any_(carrying), out("possible", named("weak evidence of the allele", carrying)))
        .when(hom_child, out("mendelian_conflict", say("homozygous child of two reference parents")))
        .when(~_adequate("child", t.child_min_dp, t.min_gq), out("likely_artifact", say("proband DP or GQ is low")))
        .when(bad_ab, out("likely_artifact", say("proband allele balance is missing or out of range")))
        .when(any_(uncalled), out("possible", named("no call", uncalled)))
        .when(any_(not_ref), out("mendelian_conflict", say("parental genotypes don't fit")))
        .when(any_(mosaic), out("possible_parental_mosaicism", named("low-level evidence", mosaic)))
        .when(any_(weak) | any_(no_depth), out("possible", F.concat(F.when(any_(weak), named("parental DP or GQ is low", weak)).otherwise(F.array().cast("array<string>")), F.when(any_(no_depth), named("no allele depths", no_depth)).otherwise(F.array().cast("array<string>")))))
        .otherwise(out("high_confidence", say("well-supported reference parents")))
    )
    return rows.withColumn("_v", verdict).withColumns({"status": F.col("_v.status"), "reasons": F.col("_v.reasons")}).drop("_v", "_one")


def origin(rows: DataFrame, t: TrioThresholds = DEFAULT) -> DataFrame:
    """Assessed rows with `origin`: both, maternal, paternal, de_novo or unknown; both parents' calls must be adequate for a one-sided one."""
    mother, father = _true(F.col("mother_ev.carrier")), _true(F.col("father_ev.carrier"))
    solid = _adequate("mother_ev", t.parent_min_dp, t.min_gq) & _adequate("father_ev", t.parent_min_dp, t.min_gq)
    ref = lambda e: _true(F.col(f"{e}.called")) & G.is_hom_ref(F.col(f"{e}.gt"))
    side = lambda name: F.when(solid, name).otherwise("unknown")
    value = F.when(mother & father, "both").when(mother & ref("father_ev"), side("maternal")).when(father & ref("mother_ev"), side("paternal")).when(F.col("status") == "high_confidence", "de_novo").otherwise("unknown")
    return rows.withColumn("origin", value)


def representative(annotations: DataFrame) -> DataFrame:
    """One row a site and gene: MANE, then picked, then the first."""
    rank = F.row_number().over(Window.partitionBy("site_id", "gene").orderBy(F.desc("mane"), F.desc("picked"), "k"))
    return annotations.filter(~F.col("gene").isin(*T.NO_GENE)).withColumn("_r", rank).filter("_r = 1").drop("_r")


def compound_pairs(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Pairs of a proband's heterozygous sites in one gene and contig, with `phase`; rows: with origin, chrom, pos, variant_key.

    The result is the pairs themselves, so it's as large as they are: `pair_counts` tells how many to expect by gene.
    """
    genes = representative(annotations).select("site_id", "gene")
    het = rows.filter(G.is_heterozygous(F.col("child.gt"))).join(genes, "site_id")
    one = F.struct("site_id", "variant_key", "pos", "origin", "child").alias("_v")
    left = het.select("family_id", "proband", "proband_sex", "gene", "chrom", one).withColumnRenamed("_v", "first")
    right = het.select("family_id", "proband", "gene", "chrom", one).withColumnRenamed("_v", "second")
    pairs = left.join(right, ["family_id", "proband", "gene", "chrom"]).filter(F.col("first.site_id") < F.col("second.site_id"))
    return pairs.withColumn("phase", _phase())


def _phase() -> Column:
    a, b = F.col("first.origin"), F.col("second.origin")
    ca, cb = F.col("first.child"), F.col("second.child")
    one_x = (F.col("proband_sex") == "male") & (F.col("chrom") == "X") & (A.single_copy(F.col("chrom"), F.col("first.pos")) | A.single_copy(F.col("chrom"), F.col("second.pos")))
    in_phase = _true(ca["phased"] & cb["phased"] & ~ca["phase_set"].isin("", ".") & (ca["phase_set"] == cb["phase_set"]) & ca["haplotype"].isNotNull() & cb["haplotype"].isNotNull())
    sided = lambda x: x.isin("maternal", "paternal")
    return (
        F.when(one_x, "excluded_hemizygous")
        .when(in_phase, F.when(ca["haplotype"] != cb["haplotype"], "confirmed_trans_phasing").otherwise("cis"))
        .when(sided(a) & sided(b), F.when(a != b, "confirmed_trans_inheritance").otherwise("cis"))
        .when(((a == "de_novo") & sided(b)) | ((b == "de_novo") & sided(a)), "possible_trans")
        .otherwise("phase_unknown")
    )


def pair_counts(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """family_id, gene, sites, pairs that `compound_pairs` will give at most."""
    het = rows.filter(G.is_heterozygous(F.col("child.gt"))).join(representative(annotations).select("site_id", "gene"), "site_id")
    counts = het.groupBy("family_id", "gene", "chrom").agg(F.count("*").alias("sites"))
    return counts.withColumn("pairs", (F.col("sites") * (F.col("sites") - 1) / 2).cast("long"))


def completeness(rows: DataFrame) -> DataFrame:
    """family_id, status, sites, with_both_parents: how far each status rests on calls of both parents."""
    both = _true(F.col("mother_ev.called")) & _true(F.col("father_ev.called"))
    return rows.groupBy("family_id", "status").agg(F.countDistinct("site_id").alias("sites"), F.countDistinct(F.when(both, F.col("site_id"))).alias("with_both_parents"))


def by_status(rows: DataFrame, *order: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return rows.orderBy(rank, *order)


def compound_members(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """family_id, site_id of the sites with some partner that is not in cis, as `compound_pairs` would tell, without making the pairs.

    A site's partners in cis are counted from groups of its gene: those on its haplotype of its phase set, and those
    inherited from the same parent that share no phase set with it. rows: one a family, proband and site.
    """
    genes = representative(annotations).select("site_id", "gene")
    het = rows.filter(G.is_heterozygous(F.col("child.gt"))).join(genes, "site_id")
    group = ["family_id", "proband", "gene", "chrom"]
    for c in group:
        het = het.filter(F.col(c).isNotNull())
    c = F.col("child")
    placed = _true(c["phased"] & ~c["phase_set"].isin("", ".") & c["haplotype"].isNotNull())
    single = _true((F.col("proband_sex") == "male") & (F.col("chrom") == "X") & A.single_copy(F.col("chrom"), F.col("pos")))
    one = het.select(*group, "site_id", single.alias("single"), F.when(placed, c["phase_set"]).alias("set"), F.when(placed, c["haplotype"]).alias("side"), F.when(F.col("origin").isin("maternal", "paternal"), F.col("origin")).alias("parent"))
    over = lambda *more: Window.partitionBy(*group, *more)
    counts = {
        "sites": F.count("*").over(over()), "singles": F.count_if("single").over(over()), "same_side": F.count("*").over(over("set", "side")),
        "same_parent": F.count("*").over(over("parent")), "same_both": F.count("*").over(over("parent", "set")),
    }
    # each count holds the site itself; without a set, it's a partner in cis to all of its parent
    by_set = F.when(F.col("set").isNotNull(), F.col("same_side") - 1).otherwise(0)
    by_parent = F.when(F.col("parent").isNotNull(), F.when(F.col("set").isNotNull(), F.col("same_parent") - F.col("same_both")).otherwise(F.col("same_parent") - 1)).otherwise(0)
    apart = F.when(F.col("singles") > 0, F.col("sites") > 1).otherwise(F.col("sites") - 1 > by_set + by_parent)
    return one.withColumns(counts).filter(apart).select("family_id", "site_id").distinct()


def in_view(rows: DataFrame, view: str, annotations: DataFrame | None = None) -> DataFrame:
    """Rows of a view: de_novo candidates, homozygous, or those that take part in some compound pair."""
    if view == "de_novo":
        return rows.filter(F.col("status").isin("high_confidence", "possible", "possible_parental_mosaicism"))
    if view == "homozygous":
        return rows.filter(G.review_class(F.col("child.gt")).isin("homozygous_alt", "hemizygous"))
    return rows.join(compound_members(rows, annotations), ["family_id", "site_id"], "left_semi")
