"""Column expressions for chromosomes, alleles and keys. All stay within code generation; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudoautosomal bounds of GRCh38, exclusive on both sides of the single-copy part.
X_SINGLE_COPY = (2_781_479, 155_701_383)
Y_SINGLE_COPY = (2_781_479, 56_887_903)
#: The primary contigs in their numeric order.
PRIMARY_CONTIGS = [*[str(i) for i in range(1, 23)], "X", "Y", "MT"]


def chromosome(name: Column) -> Column:
    """Without a leading chr of either case, upper case, M as MT; null stays null."""
    bare = F.upper(F.regexp_replace(F.trim(name), "^(?i:chr)", ""))
    return F.when(bare == "M", "MT").otherwise(bare)


def contig_rank(chrom: Column) -> Column:
    """1 to 25 for the primary contigs, larger for others, which then go by name."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in PRIMARY_CONTIGS]), chrom).cast("int"), F.lit(0)), F.lit(len(PRIMARY_CONTIGS) + 1))


def is_sequence(allele: Column) -> Column:
    return allele.rlike("^[ACGTNacgtn]+$")


def _common(a: Column, b: Column, most: Column, at_end: bool) -> Column:
    """Length of the longest common suffix or prefix of a and b, at most `most`."""
    cut = (lambda x, k: F.substring(x, F.length(x) - k + 1, k)) if at_end else (lambda x, k: F.substring(x, F.lit(1), k))
    return F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda k: cut(a, k) == cut(b, k)))


def let(value: Column, use) -> Column:
    """use(value) with value computed once: it becomes a lambda's variable, so that expressions stay small when it is used often."""
    return F.transform(F.array(value), use)[0]


def _trimmed(ref: Column, alt: Column, keep: int) -> Column:
    """struct(ref, alt, prefix): without the shared suffix, then without the shared prefix of length `prefix`; `keep` bases stay of both."""

    def shortest(u: Column) -> Column:
        return F.least(F.length(u["ref"]), F.length(u["alt"])) - keep

    def without_suffix(u: Column) -> Column:
        return let(_common(u["ref"], u["alt"], shortest(u), at_end=True), lambda n: F.struct(F.substring(u["ref"], F.lit(1), F.length(u["ref"]) - n).alias("ref"), F.substring(u["alt"], F.lit(1), F.length(u["alt"]) - n).alias("alt")))

    def without_prefix(u: Column) -> Column:
        return let(_common(u["ref"], u["alt"], shortest(u), at_end=False), lambda n: F.struct(F.substring(u["ref"], n + 1, F.length(u["ref"])).alias("ref"), F.substring(u["alt"], n + 1, F.length(u["alt"])).alias("alt"), n.alias("prefix")))

    return let(let(F.struct(F.upper(ref).alias("ref"), F.upper(alt).alias("alt")), without_suffix), without_prefix)


def minimal(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt): the shared suffix goes first, then the shared prefix, one anchor base stays.

    Equal or non-sequence alleles are only upper-cased, as are the many that are single bases and minimal already.
    """
    plain = F.struct(pos.cast("long").alias("pos"), F.upper(ref).alias("ref"), F.upper(alt).alias("alt"))
    short = let(_trimmed(ref, alt, 1), lambda u: F.struct((pos + u["prefix"]).cast("long").alias("pos"), u["ref"].alias("ref"), u["alt"].alias("alt")))
    changes = (F.length(ref) > 1) & (F.length(alt) > 1) & is_sequence(ref) & is_sequence(alt) & (F.upper(ref) != F.upper(alt))
    return F.when(changes, short).otherwise(plain)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """CHROM:POS:REF:ALT of the minimal allele."""
    return let(minimal(pos, ref, alt), lambda m: F.concat_ws(":", chromosome(chrom), m["pos"].cast("string"), m["ref"], m["alt"]))


def vep_alt(ref: Column, alt: Column) -> Column:
    """The ALT as an annotator writes it in Allele: trimmed of all that is shared, - if nothing is left."""
    left = let(_trimmed(ref, alt, 0), lambda u: F.when(u["alt"] == "", "-").otherwise(u["alt"]))
    return F.when(is_sequence(ref) & is_sequence(alt), left).otherwise(alt)


def single_copy(chrom: Column, pos: Column) -> Column:
    """Non-pseudoautosomal X and Y of GRCh38, for a normalised chromosome."""
    x = (chrom == "X") & (pos > X_SINGLE_COPY[0]) & (pos < X_SINGLE_COPY[1])
    y = (chrom == "Y") & (pos > Y_SINGLE_COPY[0]) & (pos < Y_SINGLE_COPY[1])
    return F.coalesce(x | y, F.lit(False))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def length_change(ref: Column, alt: Column) -> Column:
    return F.length(alt) - F.length(ref)


def is_frameshift(ref: Column, alt: Column) -> Column:
    return F.pmod(length_change(ref, alt), F.lit(3)) != 0


def stable_id(identifier: Column) -> Column:
    """An identifier without its version."""
    return F.substring_index(identifier, ".", 1)


def genotype_count(ploidy: Column, alleles: Column) -> Column:
    """Number of genotypes: combinations with repetition, C(ploidy + alleles - 1, ploidy); the width of a Number=G field."""
    return F.round(F.factorial((ploidy + alleles - 1).cast("int")) / (F.factorial(ploidy.cast("int")) * F.factorial((alleles - 1).cast("int")))).cast("long")
