"""Column expressions for INFO, CSQ and multi-valued fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of a missing value.
MISSING = ("", ".", "-")
#: Groups of frequency fields in order of preference; within a group the largest value counts.
FREQUENCY_GROUPS = (
    ("gnomad_popmax", ("gnomADg_AF_popmax", "gnomADe_AF_popmax", "gnomAD_AF_popmax", "gnomAD_popmax_AF")),
    ("max_af", ("MAX_AF",)),
    ("gnomad_global", ("gnomADg_AF", "gnomADe_AF", "gnomAD_AF")),
)
#: Fields of protein-level matches, one slot an ALT.
PROTEIN_MATCH_FIELDS = (
    "ClinVar_path_aa_match", "ClinVar_path_aa_change_match", "ClinVar_path_aa_details",
    "ClinGen_path_aa_match", "ClinGen_path_aa_change_match", "ClinGen_path_aa_details",
    "GenIA_path_aa_match", "GenIA_path_aa_change_match", "GenIA_path_aa_details",
)
#: Three-letter amino acids and their letters.
AMINO_ACIDS = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Sec": "U", "Ter": "*"}


def present(value: Column) -> Column:
    """Null for the three markers of a missing value."""
    return F.when(~F.trim(value).isin(*MISSING), value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*[present(v) for v in values])


def info_map(info: Column) -> Column:
    """map of an INFO field; flags map to "1". Of a repeated key the last value stays."""
    pairs = F.filter(F.split(info, ";"), lambda x: ~x.isin("", "."))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("1").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def info_value(info: Column, key: str) -> Column:
    """One value of an INFO field, as `info_map` has it, without the others."""
    own = F.filter(F.split(info, ";"), lambda x: (x == key) | x.startswith(key + "="))
    return F.get(F.reverse(F.transform(own, lambda x: F.when(x == key, "1").otherwise(F.substring(x, len(key) + 2, 2**31 - 1)))), F.lit(0))


def percent_decoded(text: Column) -> Column:
    """%XX decoded; a plus sign is itself. Text without % is returned as it is; broken escapes leave the text alone."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)).otherwise(text)


def csq_entries(csq: Column, fields: list[str]) -> Column:
    """array<map<field, value>>: comma-separated entries, short ones padded with empty values, values percent-decoded."""
    names = F.array(*[F.lit(f) for f in fields])

    def entry(text: Column) -> Column:
        values = F.split(text, r"\|", -1)
        padded = F.slice(F.concat(values, F.array_repeat(F.lit(""), len(fields))), 1, len(fields))
        return F.map_from_arrays(names, F.transform(padded, percent_decoded))

    return F.when((csq != "") & csq.isNotNull(), F.transform(F.split(csq, ","), entry))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"), F.trim(text).cast("double"))


def numbers(text: Column, separators: str = "[,&]") -> Column:
    """array<double> of the tokens that are numbers."""
    return F.array_compact(F.transform(F.split(text, separators), _number))


def largest(text: Column) -> Column:
    return F.array_max(numbers(text))


def smallest(text: Column) -> Column:
    return F.array_min(numbers(text))


def most_extreme(text: Column) -> Column:
    """The number with the largest absolute value, its sign kept; of equal ones the positive."""
    return F.array_max(F.transform(numbers(text), lambda x: F.struct(F.abs(x).alias("size"), x.alias("x"))))["x"]


def first_number(text: Column) -> Column:
    """The first &-separated token, if it is a number."""
    return _number(F.substring_index(text, "&", 1))


def strict_decimal(text: Column) -> Column:
    """A number only if the whole text is one plain decimal."""
    return F.when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), text.cast("double"))


def per_allele(value: Column, alt_index: Column, n_alts: Column) -> Column:
    """The ALT's token of a Number=A value, null if there aren't as many tokens as ALTs. alt_index is from 0."""
    tokens = F.split(value, ",", -1)
    return F.when(F.size(tokens) == n_alts, present(F.get(tokens, alt_index)))


def _tokens_of_alt(value: Column, alt_index: Column, alts: Column, least_alts: int, fold) -> tuple[Column, Column, Column]:
    """(tokens that may belong to the ALT, whether any token names an ALT, whether there is a slot for each ALT).

    A value is a list of comma slots, each of tokens joined by &. Tokens that name their ALT before the first | decide over
    the number of slots: only without any such token does a slot for each ALT count as that ALT's.
    """
    slots = F.split(value, ",", -1)
    every = F.flatten(F.transform(slots, lambda s: F.split(s, "&", -1)))
    known = F.transform(alts, fold)
    named = F.exists(every, lambda t: t.contains("|") & F.array_contains(known, fold(percent_decoded(F.substring_index(t, "|", 1)))))
    by_slot = (F.size(slots) == F.size(alts)) & (F.size(alts) >= least_alts)
    own = F.when(~named & by_slot, F.split(F.get(slots, alt_index), "&", -1)).otherwise(every)
    return F.filter(own, lambda t: ~t.isin(*MISSING)), named, by_slot


def assertions_of_alt(value: Column, alt: Column, alt_index: Column, alts: Column) -> Column:
    """array of the assertions that belong to one ALT (alt_index from 0 in array alts); an unnamed token belongs to each."""
    own, named, by_slot = _tokens_of_alt(value, alt_index, alts, 2, lambda x: x)
    lead = lambda t: percent_decoded(F.substring_index(t, "|", 1))
    mine = lambda t: ~t.contains("|") | (lead(t) == alt) | (F.size(alts) == 1) | (~named & by_slot & ~F.array_contains(alts, lead(t)))
    return F.when(present(value).isNull(), F.array().cast("array<string>")).otherwise(F.filter(own, mine))


def records_of_alt(value: Column, alt: Column, alt_index: Column, alts: Column) -> Column:
    """array of the records that name one ALT, in either case; records without a name belong to none."""
    own, _, _ = _tokens_of_alt(value, alt_index, alts, 1, F.upper)
    mine = lambda t: t.contains("|") & (F.upper(percent_decoded(F.substring_index(t, "|", 1))) == F.upper(alt))
    return F.when(present(value).isNull(), F.array().cast("array<string>")).otherwise(F.filter(own, mine))


def prediction_info(info: Column, alt: Column, alt_index: Column, alts: Column) -> Column:
    """The INFO map with the evidence of one ALT only: protein matches by slot, assertions and records by ALT, with their numbers."""
    slot = lambda v: F.coalesce(present(F.get(F.split(v, ",", -1), alt_index)), F.lit(""))
    number = lambda a: F.when(F.size(a) > 0, F.size(a).cast("string")).otherwise("")
    assertions = assertions_of_alt(F.coalesce(info["ClinGen_ERepo"], F.lit("")), alt, alt_index, alts)
    records = records_of_alt(F.coalesce(info["GenIA"], F.lit("")), alt, alt_index, alts)
    put = [
        (info["ClinGen_ERepo"].isNotNull(), {"ClinGen_ERepo": F.array_join(assertions, ","), "ClinGen_ERepo_count": number(assertions)}),
        (info["GenIA"].isNotNull() | info["GenIA_count"].isNotNull(), {"GenIA": F.array_join(records, "&"), "GenIA_count": number(records)}),
        *[(info[k].isNotNull(), {k: percent_decoded(slot(info[k]))}) for k in PROTEIN_MATCH_FIELDS],
    ]
    own = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(k).alias("key"), v.alias("value"))) for there, values in put for k, v in values.items()]))
    changed = F.transform(own, lambda e: e["key"])
    return F.map_concat(F.map_filter(info, lambda k, v: ~F.array_contains(changed, k)), F.map_from_entries(own))


def population_frequency(values: dict[str, Column]) -> tuple[Column, Column]:
    """(value, source): the first group with a value; groups are never pooled."""
    by_group = [(name, F.array_max(F.array_compact(F.array(*[largest(values[f]) for f in fields if f in values])))) for name, fields in FREQUENCY_GROUPS if any(f in values for f in fields)]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in by_group], F.lit(""))
    return F.coalesce(*[v for _, v in by_group]), source


def subpopulation_frequencies(info: Column) -> Column:
    """map of all frequency fields of single populations."""
    return F.map_filter(info, lambda k, v: k.rlike("^gnomAD[eg]?_.*AF") & ~F.lower(k).contains("popmax"))


def attributed(allele_num: Column, allele: Column, ref: Column, alts: Column, alt_index: Column) -> Column:
    """Whether a consequence entry belongs to the ALT at alt_index (from 0) of array alts.

    The allele number decides if there is one; then the exact allele; then the minimised one, if no other ALT has it.
    """
    from .alleles import vep_alt

    own = F.get(alts, alt_index)
    short = F.transform(alts, lambda a: F.upper(vep_alt(ref, a)))
    mine = F.get(short, alt_index)
    unique = (F.upper(allele) == mine) & (F.size(F.filter(short, lambda s: s == mine)) == 1)
    return F.when(allele_num.rlike("^[0-9]+$"), allele_num.cast("int") == alt_index + 1).when(F.coalesce(allele, F.lit("")) == "", F.lit(True)).otherwise((F.upper(allele) == F.upper(own)) | unique)


def protein_change(hgvsp: Column) -> Column:
    """struct(ref, position, alt) of a substitution p.Abc123Xyz, in one-letter code; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in AMINO_ACIDS.items() for x in pair])
    pattern = r"p\.\(?([A-Z][a-z]{2})([0-9]+)([A-Z][a-z]{2})\)?$"
    ref, position, alt = (F.regexp_extract(hgvsp, pattern, k) for k in (1, 2, 3))
    out = F.struct(names[ref].alias("ref"), position.cast("int").alias("position"), names[alt].alias("alt"))
    return F.when(hgvsp.rlike(pattern) & names[ref].isNotNull() & names[alt].isNotNull(), out)


def binary_class(score: Column, threshold: float, direction: str) -> Column:
    """Whether a score counts as damaging: higher, lower or absolute; null without a score."""
    return {"higher": score >= threshold, "lower": score <= threshold, "absolute": F.abs(score) >= threshold}[direction]
