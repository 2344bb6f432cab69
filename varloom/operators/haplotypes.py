"""Frameshifts on haplotypes: which frameshifts restore each other's frame, and where a shifted frame meets a stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import genotypes as G

#: Stop codons, and the least distance of a stop to the last junction at which decay is expected.
STOPS = ("TAA", "TAG", "TGA")
DECAY_DISTANCE = 50
CONFIRMED, PARTIAL, POSSIBLE, TRANS = "FRAME_RESTORED_CONFIRMED", "FRAME_RESTORATION_PARTIAL_CONFIRMED", "FRAME_RESTORING_POSSIBLE_UNPHASED", "TRANS"


def frameshift_index(annotations: DataFrame, sites: DataFrame) -> DataFrame:
    """site_id, transcripts (sorted), change: where a site's allele shifts the frame."""
    rows = annotations.filter(F.array_contains(F.split("consequence", "&"), "frameshift_variant"))
    index = rows.groupBy("site_id").agg(F.array_sort(F.collect_set(A.stable_id(F.col("transcript")))).alias("transcripts"))
    return index.join(sites.select("site_id", A.length_change(F.col("ref"), F.col("alt")).alias("change")), "site_id").filter(F.pmod("change", F.lit(3)) != 0)


def events(containers: DataFrame, index: DataFrame) -> DataFrame:
    """event_id, transcript, members (number), restored: haplotypes with two or more frameshifts of their transcript that add up to a frame.

    containers: event_id, transcript, site_id, one row a contributing variant.
    """
    shifts = index.select("site_id", "change", F.explode("transcripts").alias("transcript"))
    rows = containers.join(shifts, ["site_id", "transcript"]).groupBy("event_id", "transcript").agg(F.count("*").alias("members"), F.sum("change").alias("change"), F.array_sort(F.collect_list("site_id")).alias("sites"))
    return rows.filter((F.col("members") >= 2) & (F.pmod("change", F.lit(3)) == 0)).drop("change")


def restorations(found: DataFrame, calls: DataFrame, allele: int = 1) -> DataFrame:
    """event_id, transcript, sample_id, status for samples that carry all members of an event.

    Homozygous members are on both haplotypes. Of the others: all on one haplotype of one phase set is confirmed; two on
    different haplotypes of one set are trans, which restores nothing; some pair in phase but not all is partial; else possible.
    """
    a, gt = F.lit(allele), F.col("gt")
    side = F.when(G.is_phased(gt), F.array_position(G.allele_tokens(gt), a.cast("string")).cast("int"))
    carried = calls.filter(G.copies(gt, a) > 0).select("sample_id", "site_id", (G.zygosity(gt, a) == "homozygous").alias("hom"), F.when(side.isNotNull() & F.col("phase_set").isNotNull(), F.struct("phase_set", side.alias("side"))).alias("place"))
    rows = found.select("event_id", "transcript", "members", F.explode("sites").alias("site_id")).join(carried, "site_id")
    per = rows.groupBy("event_id", "transcript", "members", "sample_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("hom")).alias("open"), F.count_if(~F.col("hom") & F.col("place").isNotNull()).alias("placed"),
        F.collect_set(F.when(~F.col("hom"), F.col("place"))).alias("places"), F.collect_set(F.when(~F.col("hom"), F.col("place.phase_set"))).alias("sets"),
    ).filter("n = members")
    trans = F.size("places") > F.size("sets")
    together = (F.col("placed") == F.col("open")) & (F.size("places") <= 1)
    status = F.when(F.col("open") <= 1, CONFIRMED).when(trans, TRANS).when(together, CONFIRMED).when(F.col("placed") > F.size("places"), PARTIAL).otherwise(POSSIBLE)
    return per.select("event_id", "transcript", "sample_id", status.alias("status"))


def first_stop(coding: Column) -> Column:
    """Place of the first stop codon in a sequence, counted in bases from 0; null without one. Only whole codons are read."""
    codons = F.regexp_extract_all(coding, F.lit("..."), F.lit(0))
    return (F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(codons, s), F.lit(0)) for s in STOPS]))) - 1).cast("int") * 3


def _merged(spans: Column) -> Column:
    """Sorted array<struct<start1, end1>> with overlapping and adjacent spans united; spans are those of one transcript."""
    last = lambda done: F.element_at(done, -1)

    def step(done: Column, x: Column) -> Column:
        wider = F.struct(last(done)["start1"].alias("start1"), F.greatest(last(done)["end1"], x["end1"]).alias("end1"))
        meets = (F.size(done) > 0) & (x["start1"] <= F.try_element_at(done, F.lit(-1))["end1"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start1:long,end1:long>>"), step)


def _sized(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end1"] - x["start1"] + 1)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def _coding_place(pos: Column) -> Column:
    """Place in the coding sequence, from 0, of a genomic position; null outside of it."""
    inside = F.filter("blocks", lambda b: (pos >= b["start1"]) & (pos <= b["end1"]))
    b = F.get(inside, F.lit(0))
    return b["offset"] + F.when(F.col("strand") == "+", pos - b["start1"]).otherwise(b["end1"] - pos)


def coding_models(features: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """One row a transcript that has features: what `stop_rule` needs, and `problems` (array, empty for a sound model).

    features: tx_id, version, biotype, chrom, strand, feature (exon, CDS, stop_codon, Selenocysteine), start1, end1 (closed), as a GTF
    has them. chunks: chrom, chunk, sequence of `size` bases, upper case. Columns: tx_id, version, biotype, strand, blocks of
    the coding sequence in reading direction with their offsets, coding (coding sequence and what follows it), cds_length,
    exons (number), last_junction and last_coding_junction (bases from the start codon to the last exon or coding block, the latter null
    with one block), selenocysteines (places). Blocks meet the sequence by a join on (chrom, chunk); what is grouped is one transcript.
    """
    spans = lambda *kinds: F.collect_list(F.when(F.col("feature").isin(*kinds), F.struct(F.col("start1").cast("long").alias("start1"), F.col("end1").cast("long").alias("end1"))))
    rows = features.groupBy("tx_id").agg(*[F.max(c).alias(c) for c in ("version", "biotype", "chrom", "strand")], spans("exon").alias("_e"), spans("CDS", "stop_codon").alias("_c"), spans("Selenocysteine").alias("_s"))
    rows = rows.withColumns({"_e": _merged(F.col("_e")), "_c": _merged(F.col("_c"))})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in ("_e", "_c")])
    parts = rows.select("tx_id", "chrom", F.inline(kinds)).select("tx_id", "chrom", "kind", F.inline("spans"))
    first = lambda c: F.floor((F.col(c) - 1) / size)
    parts = parts.withColumn("_n", F.explode(F.sequence(first("start1"), first("end1"))))
    own = chunks.select(F.col("chrom").alias("_chrom"), F.col("chunk").alias("_chunk"), "sequence")
    low = F.greatest(F.col("start1"), F.col("_n") * size + 1)
    high = F.least(F.col("end1"), (F.col("_n") + 1) * size)
    met = parts.join(own, (F.col("chrom") == F.col("_chrom")) & (F.col("_n") == F.col("_chunk")))
    met = met.select("tx_id", "kind", low.alias("low"), F.substring("sequence", (low - F.col("_n") * size).cast("int"), (high - low + 1).cast("int")).alias("piece"))
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("low", "piece")))), lambda x: x["piece"]), "")
    sequences = met.groupBy("tx_id").agg(text("_e").alias("_cdna"), text("_c").alias("_cds"))
    forward = F.col("strand") == "+"
    read = lambda c: F.when(forward, F.coalesce(c, F.lit(""))).otherwise(reverse_complement(F.coalesce(c, F.lit(""))))
    turned = lambda c: F.when(forward, F.col(c)).otherwise(F.reverse(F.col(c)))
    m = rows.join(sequences, "tx_id", "left").withColumns({"_cdna": read(F.col("_cdna")), "_cds": read(F.col("_cds")), "_e": turned("_e"), "_c": turned("_c")})
    head = F.get("_c", F.lit(0))
    at = F.array_position(F.transform("_e", lambda e: ((e["start1"] <= head["start1"]) & (head["start1"] <= e["end1"])) | ((e["start1"] <= head["end1"]) & (head["end1"] <= e["end1"]))), True).cast("int")
    own_exon = F.get("_e", at - 1)
    before = F.when(at > 0, _sized(F.slice("_e", 1, F.greatest(at - 1, F.lit(0)))) + F.when(forward, head["start1"] - own_exon["start1"]).otherwise(own_exon["end1"] - head["end1"]))
    m = m.withColumns({"_before": before, "_size": _sized(F.col("_c")), "_exonic": _sized(F.col("_e")), "exons": F.size("_e")})
    upto = lambda c, n: _sized(F.slice(c, 1, F.greatest(n, F.lit(0))))
    blocks = F.transform("_c", lambda b, i: F.struct(b["start1"], b["end1"], upto(F.col("_c"), i).alias("offset")))
    m = m.withColumns({
        "blocks": blocks, "cds_length": F.length("_cds"), "coding": F.concat("_cds", F.substring("_cdna", (F.col("_before") + F.length("_cds") + 1).cast("int"), F.length("_cdna"))),
        "last_junction": (upto("_e", F.col("exons") - 1) - F.col("_before")).cast("int"), "last_coding_junction": F.when(F.size("_c") > 1, upto("_c", F.size("_c") - 1)).cast("int"),
    })
    m = m.withColumn("_at", F.transform("_s", lambda x: _coding_place(F.when(forward, x["start1"]).otherwise(x["end1"]))))
    framed = lambda p: p.isNotNull() & (p % 3 == 0)
    uga = lambda p: F.substring(F.col("_cds"), (p + 1).cast("int"), F.lit(3)) == "TGA"
    m = m.withColumn("selenocysteines", F.array_sort(F.array_distinct(F.filter("_at", lambda p: framed(p) & uga(p)))))
    codons = F.regexp_extract_all(F.expr("left(_cds, length(_cds) - 3)"), F.lit("..."), F.lit(0))
    stops = F.transform(codons, lambda c, i: F.when(c.isin(*STOPS), (i * 3).cast("long")))
    fetched = (F.length("_cdna") == F.col("_exonic")) & (F.length("_cds") == F.col("_size"))
    found = {
        "cds_not_found_at_expected_cdna_position": F.substring("_cdna", (F.col("_before") + 1).cast("int"), F.length("_cds")) != F.col("_cds"),
        "cds_not_multiple_of_3": F.length("_cds") % 3 != 0, "cds_no_terminal_stop": ~F.expr("right(_cds, 3)").isin(*STOPS),
        "selenocysteine_site_outside_frame": F.exists("_at", lambda p: ~framed(p)), "selenocysteine_site_not_uga": F.exists("_at", lambda p: framed(p) & ~uga(p)),
        "cds_internal_stop": F.size(F.array_except(F.array_compact(stops), F.col("selenocysteines"))) > 0,
    }
    sound = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))
    only = lambda name: F.array(F.lit(name))
    problems = F.when(F.size("_e") == 0, only("no_exons")).when(F.size("_c") == 0, only("no_cds")).when(~fetched, only("sequence_fetch_failed")).when(F.col("_before").isNull(), only("cds_not_within_exons")).otherwise(sound)
    return m.select("tx_id", "version", "biotype", "strand", "blocks", "coding", "cds_length", "exons", "last_junction", "last_coding_junction", "selenocysteines", problems.alias("problems"))


def stop_rule(alleles: DataFrame, models: DataFrame, distance: int = DECAY_DISTANCE) -> DataFrame:
    """alleles (tx_id with or without version, pos, ref, alt, consequence) with status, ptc (codon's first base in the edited sequence, from 0),
    ptc_distance and rule to the last junction, and the same to the last coding junction: FAIL within `distance`, else PASS.

    models: as `coding_models` gives them. The allele is placed in the coding sequence, the edit made there, and the frame read
    on to its first stop. A deletion whose base before lies outside of the coding sequence is tried without that base. Refused, with
    a null rule: no model, other biotypes, faulty models, selenocysteine, lost start, another version, symbolic alleles, alleles outside
    of the coding sequence or over an exon's end, another reference, no stop. With one exon there is a stop but no rule.
    """
    own = models.withColumnRenamed("tx_id", "_model").withColumn("_known", F.lit(True))
    rows = alleles.select(*[F.col(c).alias(f"_a_{c}") for c in alleles.columns]).withColumn("_base", A.stable_id(F.col("_a_tx_id"))).join(own, F.col("_base") == F.col("_model"), "left")
    pos, ref, alt = F.col("_a_pos"), F.upper("_a_ref"), F.upper("_a_alt")
    version = F.regexp_extract("_a_tx_id", r"\.(\d+)$", 1)
    bad = (
        F.when(F.col("_known").isNull(), "no_transcript_model")
        .when(~F.col("biotype").eqNullSafe("protein_coding"), F.concat(F.lit("unsupported_transcript_biotype:"), F.coalesce("biotype", F.lit("unknown"))))
        .when(F.size("problems") > 0, F.concat(F.lit("bad_transcript_model:"), F.array_join("problems", "+")))
        .when(F.size("selenocysteines") > 0, "selenocysteine")
        .when(F.array_contains(F.split("_a_consequence", "&"), "start_lost"), "start_lost_unsupported")
        .when((version != "") & ~F.col("version").cast("string").eqNullSafe(version), "transcript_version_mismatch")
        .when(~(F.coalesce(ref, F.lit("")).rlike("^[A-Z]+$") & F.coalesce(alt, F.lit("")).rlike("^[A-Z]+$")), "unsupported_allele")
    )
    rows = rows.withColumns({"_bad": bad, "_outside": _coding_place(pos).isNull() | _coding_place(pos + F.length(ref) - 1).isNull()})
    anchored = F.col("_outside") & (F.length(alt) == 1) & (F.length(ref) > 1) & (F.substring(ref, 1, 1) == alt)
    rows = rows.withColumns({"_cut": anchored, "_p": F.when(anchored, pos + 1).otherwise(pos), "_r": F.when(anchored, F.substring(ref, F.lit(2), F.length(ref))).otherwise(ref), "_t": F.when(anchored, "").otherwise(alt)})
    c1, c2, n = _coding_place(F.col("_p")), _coding_place(F.col("_p") + F.length("_r") - 1), F.length("_r")
    read = lambda c: F.when(F.col("strand") == "+", F.col(c)).otherwise(reverse_complement(F.col(c)))
    rows = rows.withColumns({"_c1": c1, "_c2": c2, "_r": read("_r"), "_t": read("_t")}).withColumn("_at", F.least("_c1", "_c2").cast("int"))
    edited = F.concat(F.substring(F.col("coding"), F.lit(1), F.col("_at")), F.col("_t"), F.substring(F.col("coding"), F.col("_at") + n + 1, F.length("coding")))
    rows = rows.withColumn("_stop", first_stop(F.when(F.col("_bad").isNull(), edited)))
    refused = (
        F.when(F.col("_c1").isNull() | F.col("_c2").isNull(), "outside_cds").when(F.abs(F.col("_c1") - F.col("_c2")) + 1 != n, "spans_exon_boundary")
        .when(F.substring(F.col("coding"), F.col("_at") + 1, n) != F.col("_r"), "ref_mismatch").when(F.col("_stop").isNull(), "no_stop_found")
    )
    single = F.col("exons") == 1
    fine = F.when(single, "not_applicable_single_exon_transcript").when(F.col("last_junction") >= F.col("cds_length"), "ok_utr_only_terminal_exon").otherwise("ok")
    scored = F.when(F.col("_cut") & (refused.isNotNull() | single), "outside_cds").otherwise(F.coalesce(refused, fine))
    tried = rows.withColumn("_status", F.coalesce("_bad", scored)).withColumn("_ok", F.col("_status").startswith("ok"))
    gap = lambda c: F.when(F.col("_ok"), F.col(c) + F.when(F.col("_at") < F.col(c), F.length("_t") - F.length("_r")).otherwise(0) - F.col("_stop"))
    tried = tried.withColumns({"_ptc": F.when(F.col("_ok") | F.col("_status").startswith("not_applicable"), F.col("_stop")), "_last": gap("last_junction"), "_block": gap("last_coding_junction")})
    rule = lambda c: F.when(F.col(c) > distance, "PASS").when(F.col(c).isNotNull(), "FAIL")
    return tried.select(*[F.col(f"_a_{c}").alias(c) for c in alleles.columns], F.col("_status").alias("status"), F.col("_ptc").alias("ptc"), F.col("_last").alias("ptc_distance"), rule("_last").alias("rule"), F.col("_block").alias("coding_distance"), rule("_block").alias("coding_rule"))


def apply_rule(annotations: DataFrame, ruled: DataFrame) -> DataFrame:
    """annotations (site_id, transcript, lof_info) with the rule put into lof_info where there is one, rule_original, rule and rule_changed.

    ruled: site_id, tx_id, status and rule of `stop_rule`. An earlier rule_original stays, so that a second pass compares with the first
    verdict. rule_changed is null without an old or a new verdict.
    """
    key = r"(^|[,&])50_BP_RULE:([^,&]*)"
    r = ruled.select("site_id", F.col("tx_id").alias("transcript"), F.when(F.col("status").startswith("ok"), F.col("rule")).alias("rule"))
    earlier = [F.nullif("rule_original", F.lit(""))] if "rule_original" in annotations.columns else []
    old = F.coalesce(*earlier, F.nullif(F.regexp_extract("lof_info", key, 2), F.lit("")))
    out = annotations.withColumn("rule_original", old).join(r, ["site_id", "transcript"], "left")
    info = F.col("lof_info")
    put = F.when(info.rlike(key), F.regexp_replace(info, F.lit(key), F.concat(F.lit("$150_BP_RULE:"), "rule"))).otherwise(F.concat(info, F.lit("&50_BP_RULE:"), "rule"))
    return out.withColumns({"lof_info": F.when(F.col("rule").isNotNull() & (info != ""), put).otherwise(info), "rule_changed": F.col("rule_original") != F.col("rule")})


def distinct_events(rows: DataFrame) -> DataFrame:
    """One row for each variant, sample, transcript and status."""
    return rows.dropDuplicates(["site_id", "sample_id", "transcript", "status"])
