"""Column expressions for genotype calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allele_tokens(gt: Column) -> Column:
    return F.split(F.coalesce(gt, F.lit("./.")), "[|/]")


def called_alleles(gt: Column) -> Column:
    """array<int> of the alleles that are called."""
    return F.transform(F.filter(allele_tokens(gt), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def copies(gt: Column, allele: Column) -> Column:
    """How many tokens are the allele, by string functions: as quick as code generation gets on hundreds of millions of calls."""
    apart = F.concat(F.lit("/"), F.replace(F.translate(F.coalesce(gt, F.lit("./.")), "|", "/"), F.lit("/"), F.lit("//")), F.lit("/"))
    token = F.concat(F.lit("/"), allele.cast("string"), F.lit("/"))
    return ((F.length(apart) - F.length(F.replace(apart, token, F.lit("")))) / F.length(token)).cast("int")


def ploidy(gt: Column) -> Column:
    whole = F.coalesce(gt, F.lit("./."))
    return F.length(whole) - F.length(F.translate(whole, "/|", "")) + 1


def fully_called(gt: Column) -> Column:
    return F.coalesce(gt.rlike(r"^[0-9]+([|/][0-9]+)*$"), F.lit(False))


def zygosity(gt: Column, allele: Column) -> Column:
    """Of the ALT with number `allele`: null for a non-carrier.

    One token: hemizygous; a token without a call: half_called; all copies: homozygous; one copy: heterozygous.
    """
    n = copies(gt, allele)
    return F.when(n == 0, F.lit(None).cast("string")).when(ploidy(gt) == 1, "hemizygous").when(~fully_called(gt), "half_called").when(n == ploidy(gt), "homozygous").when(n == 1, "heterozygous").otherwise("non_reference")


def review_class(gt: Column) -> Column:
    """The review's own classes, which leave uncalled, half-called and reference genotypes as other."""
    return F.when(~fully_called(gt) | is_hom_ref(gt), "other").when(ploidy(gt) == 1, "hemizygous").when(gt.rlike(r"^([0-9]+)([|/]\1)+$"), "homozygous_alt").otherwise("heterozygous")


def is_phased(gt: Column) -> Column:
    return gt.contains("|")


def is_heterozygous(gt: Column) -> Column:
    """Two different called alleles, 1/2 among them."""
    return F.coalesce(gt.rlike(r"^([0-9]+)[|/](?!\1$)[0-9]+$"), F.lit(False))


def is_hom_ref(gt: Column) -> Column:
    return F.coalesce(gt.rlike(r"^0([|/]0)*$"), F.lit(False))


def call_fields(fmt: Column, sample: Column) -> Column:
    """map of a sample column by its FORMAT keys; trailing fields may be missing."""
    keys, values = F.split(fmt, ":"), F.split(sample, ":")
    n = F.least(F.size(keys), F.size(values))
    return F.map_from_arrays(F.slice(keys, 1, n), F.slice(values, 1, n))


def depths(ad: Column) -> Column:
    """array<int> of allele depths; a dot is null, not zero."""
    return F.transform(F.split(ad, ","), lambda x: F.when(x.rlike("^[0-9]+$"), x.cast("int")))


def allele_balance(alt_depth: Column, total_depth: Column) -> Column:
    return F.when((total_depth > 0) & alt_depth.isNotNull(), alt_depth.cast("double") / total_depth)


def genotype(fmt: Column, sample: Column, allele: Column) -> Column:
    """struct of a call for the ALT with number `allele`: gt, carrier, copies, zygosity, phased, phase_set, dp, gq, ad_ref, ad_alt, allele_balance, ft."""
    f = call_fields(fmt, sample)
    gt = F.coalesce(F.nullif(f["GT"], F.lit("")), F.lit("./."))
    ad = depths(f["AD"])
    total = F.aggregate(ad, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    number = lambda x: F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), x.cast("double"))
    known = lambda x: F.when(~x.isin("", "."), x)
    return F.struct(
        gt.alias("gt"), (copies(gt, allele) > 0).alias("carrier"), copies(gt, allele).alias("copies"), zygosity(gt, allele).alias("zygosity"), is_phased(gt).alias("phased"),
        F.coalesce(known(f["PS"]), known(f["PID"])).alias("phase_set"), F.floor(number(f["DP"])).cast("int").alias("dp"), number(f["GQ"]).alias("gq"),
        F.get(ad, F.lit(0)).alias("ad_ref"), F.get(ad, allele).alias("ad_alt"), allele_balance(F.get(ad, allele), total).alias("allele_balance"), known(f["FT"]).alias("ft"),
    )
