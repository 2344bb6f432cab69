"""Operators that SQL doesn't cover, and properties, on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import fields as X
from varloom.functions import genotypes as G
from varloom.functions.scratch import scratch_path
from varloom.operators import clinical as L
from varloom.operators import genes as E
from varloom.operators import haplotypes as T
from varloom.operators import intervals as I
from varloom.operators import library as B
from varloom.operators import regulatory as R
from varloom.operators import scores as S
from varloom.operators import trio as Y
from varloom.sources import tables, vcf
from varloom.streaming import intake


def loop(pos, ref, alt, keep):
    if ref == alt and keep:
        return pos, ref, alt
    while len(ref) > keep and len(alt) > keep and ref[-1:] == alt[-1:]:
        ref, alt = ref[:-1], alt[:-1]
    while len(ref) > keep and len(alt) > keep and ref[:1] == alt[:1]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


BASES = st.text("ACGT", min_size=1, max_size=6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(BASES, BASES), min_size=40, max_size=60))
def test_alleles_are_trimmed_as_by_a_loop(spark, pairs):
    rows = spark.createDataFrame([(i, r, a) for i, (r, a) in enumerate(pairs)], "pos int, ref string, alt string")
    once = rows.select("pos", "ref", "alt", A.minimal(F.col("pos"), F.col("ref"), F.col("alt")).alias("m"), A.vep_alt(F.col("ref"), F.col("alt")).alias("v")).collect()
    for r in once:
        assert tuple(r.m) == loop(r.pos, r.ref, r.alt, 1)
        assert r.v == (loop(0, r.ref, r.alt, 0)[2] or "-")
    again = spark.createDataFrame([tuple(r.m) for r in once], "pos long, ref string, alt string")
    assert all(tuple(r.m) == (r.pos, r.ref, r.alt) for r in again.select("*", A.minimal(F.col("pos"), F.col("ref"), F.col("alt")).alias("m")).collect())


def test_odd_alleles_and_chromosomes(spark):
    rows = spark.createDataFrame([("chrM", 1, "A", "<DEL>"), ("CHR1", 5, "ac", "acac"), (" x", 9, "A", "*"), (None, 2, "A", "C")], "c string, pos int, ref string, alt string")
    got = [r.k for r in rows.select(A.variant_key(F.col("c"), F.col("pos"), F.col("ref"), F.col("alt")).alias("k")).collect()]
    assert got[:3] == ["MT:1:A:<DEL>", "1:5:A:ACA", "X:9:A:*"]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_fields(spark):
    c = F.col
    assert one(spark, X.info_map(c("i")), i="DB;AC=1,2;AC=3;E=;.;X=a=b") == {"DB": "1", "AC": "3", "E": "", "X": "a=b"}
    assert one(spark, X.percent_decoded(c("i")), i="a+b%20c%2C") == "a+b c,"
    assert one(spark, X.percent_decoded(c("i")), i="100%") == "100%"
    assert one(spark, X.numbers(c("i")), i="1&.&x,-2.5e1,") == [1.0, -25.0]
    assert one(spark, X.first_number(c("i")), i=".&3") is None
    assert one(spark, X.strict_decimal(c("i")), i="1.5x") is None
    value, source = X.population_frequency({"MAX_AF": c("m"), "gnomADg_AF": c("g"), "gnomADe_AF_popmax": c("p")})
    assert one(spark, F.struct(value, source), m="0.5", g="0.1", p=".") == (0.5, "max_af")
    assert one(spark, F.struct(value, source), m="", g="", p="") == (None, "")
    entries = X.csq_entries(c("i"), ["A", "B", "C"])
    assert one(spark, entries, i="x|y%3Bz,q||r") == [{"A": "x", "B": "y;z", "C": ""}, {"A": "q", "B": "", "C": "r"}]
    assert one(spark, X.subpopulation_frequencies(X.info_map(c("i"))), i="gnomADe_AFR_AF=1;gnomADe_AF_popmax=2;AF=3") == {"gnomADe_AFR_AF": "1"}


def test_consequences_are_attributed_without_borrowing(spark):
    cases = [("2", "-", "CAA", ["C", "CA"], 1, True), ("1", "CA", "CAA", ["C", "CA"], 1, False), ("", "-", "CAA", ["C", "CA"], 0, False), ("", "ca", "CAA", ["C", "CA"], 1, True), ("", "T", "CA", ["CTA", "CT"], 0, False), ("", "G", "CA", ["CGA", "CT"], 0, True), ("", "", "A", ["C"], 0, True), ("", "G", "A", ["C", "T"], 0, False)]
    rows = spark.createDataFrame([(n, a, r, alts, i) for n, a, r, alts, i, _ in cases], "n string, a string, ref string, alts array<string>, i int")
    got = [r.x for r in rows.select(X.attributed(F.col("n"), F.col("a"), F.col("ref"), F.col("alts"), F.col("i")).alias("x")).collect()]
    assert got == [c[-1] for c in cases]


@pytest.mark.parametrize("gt,allele,want", [("0/1", 1, "heterozygous"), ("1/1", 1, "homozygous"), ("1", 1, "hemizygous"), ("./1", 1, "half_called"), ("1/2", 2, "heterozygous"), ("1|1|2", 1, "non_reference"), ("0/0", 1, None), (None, 1, None)])
def test_zygosity(spark, gt, allele, want):
    assert one(spark, G.zygosity(F.col("g"), F.lit(allele)), g=gt) == want


def test_genotype_fields(spark):
    g = one(spark, G.genotype(F.col("f"), F.col("s"), F.lit(2)), f="GT:AD:DP:GQ:PS", s="0|2:5,.,15:.:30")
    assert (g.gt, g.carrier, g.ad_ref, g.ad_alt, g.allele_balance, g.dp, g.gq, g.phase_set, g.phased) == ("0|2", True, 5, 15, 0.75, None, 30.0, None, True)


VCF = ["##fileformat=VCFv4.2", "##reference=GRCh38", '##INFO=<ID=CSQ,Number=.,Type=String,Description="x. Format: Allele|SYMBOL|ALLELE_NUM">', "##INFO=<ID=AF,Number=A,Type=Float,Description=\"f\">", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB", "chr2\t10\tr1\tA\tT,C\t5\tPASS\tCSQ=T|G1|1,C|G2|2;AF=.1,.2\tGT:DP\t0/1:9\t2|2:7", "chr10\t5\t.\tAT\tA\t.\tLowQ\tCSQ=-|G3|;OLD=1,2\tGT\t./.\t0/1", "chr1\t7\t.\tG\tC\t.\t.\tDB\tGT\t0/1"]


def test_vcf_is_read_and_written(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    open(path, "w").write("\n".join(VCF) + "\n")
    header = vcf.read_header(spark, path)
    assert header.samples == ("A", "B") and header.csq_fields == ("Allele", "SYMBOL", "ALLELE_NUM") and header.info == {"AF": "A"}
    rows = vcf.records(vcf.read_lines(spark, path)).cache()
    assert [r.pos for r in vcf.column_mismatches(rows, header).collect()] == [7]
    alts = vcf.alleles(rows.filter(F.size("samples") == 2))
    assert sorted(r.variant_key for r in alts.collect()) == ["10:5:AT:A", "2:10:A:C", "2:10:A:T"]
    calls = sorted((r.variant_key, r.sample_id, r.zygosity, r.dp) for r in vcf.genotypes(alts, header.samples).collect())
    assert calls == [("10:5:AT:A", "B", "heterozygous", None), ("2:10:A:C", "B", "homozygous", 7), ("2:10:A:T", "A", "heterozygous", 9)]
    got = sorted((r.variant_key, r.entry["SYMBOL"]) for r in vcf.consequences(alts, header.csq_fields).collect())
    assert got == [("10:5:AT:A", "G3"), ("2:10:A:C", "G2"), ("2:10:A:T", "G1")]
    new = vcf.with_info(rows, "OLD", F.when(F.col("pos") == 5, F.array(F.lit("x"), F.lit(None))).otherwise(F.array(F.lit(None).cast("string"))))
    assert {r.pos: r["info"].split(";")[-1] for r in new.collect()} == {10: "AF=.1,.2", 5: "OLD=x,.", 7: "DB"}
    out = str(tmp_path / "out")
    vcf.write(rows, header, out, partitions=1)
    assert [r.value for r in spark.read.text(out + "/header").collect()] == VCF[:5]
    assert [r.value.split("\t")[0] for r in spark.read.text(out + "/records").collect()] == ["chr1", "chr2", "chr10"]
    kept, missing = vcf.projection(rows, header.samples, ("B",), spark.createDataFrame([("2:10:A:C",), ("9:9:A:C",)], "variant_key string"))
    assert [r.samples for r in kept.collect()] == [["2|2:7"]] and [r.variant_key for r in missing.collect()] == ["9:9:A:C"]


def test_text_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bed = tables.read_bed(spark, put("a.bed", "#c\ntrack x\n1\t0\t5\tn1\n1\tx\t5\n1\t7\t7\n"), ("name",)).collect()
    assert [tuple(r) for r in bed] == [("1", 0, 5, "n1")]
    assert tables.read_table(spark, put("t.tsv", "a\tb\n1\t2\n"), ("a",)).collect() == [("1", "2")]
    with pytest.raises(ValueError):
        tables.read_table(spark, put("u.tsv", "a\ta\n1\t2\n"), ("a",))
    pre = tables.read_after_preamble(spark, put("p.tsv", "# made\nfree text\n# Gene\tMIM\nG1\t5\nbad\n"), "Gene").collect()
    assert [tuple(r) for r in pre] == [("G1", "5")]
    gtf = tables.read_gtf(spark, put("g.gtf", '1\ts\texon\t5\t9\t.\t+\t.\tgene_id "G"; tag "a"; tag "b"; level 2;\n')).first()
    assert gtf.attributes == {"gene_id": "G", "tag": "a", "level": "2"} and gtf.start1 == 5
    ped, short = tables.read_ped(spark, put("f.ped", "#x\nF1 C D M 1 2\nF1 C D M 1 2\nF1 D 0 0 1 1\nF1 M 0 . 2 1\nF1 x\n"))
    assert short.count() == 1
    good, bad = Y.trios(Y.members(ped))
    assert [tuple(r) for r in good.collect()] == [("F1", "C", "M", "D", "male")] and bad.count() == 0
    terms, edges = tables.read_obo(spark, put("c.obo", "format: 1\n\n[Term]\nid: CL:1\nname: root\n\n[Term]\nid: CL:2\nname: leaf\nis_a: CL:1 ! root\nis_a: X:9\n\n[Term]\nid: CL:3\nname: gone\nis_obsolete: true\n"))
    assert sorted(r.term for r in terms.collect()) == ["CL:1", "CL:2"] and [tuple(r) for r in edges.collect()] == [("CL:2", "CL:1")]
    rows, broken = tables.read_haplotypes(spark, put("h.json", '{"transcript_id":"T1"}\n{oops\n'), "transcript_id string")
    assert rows.count() == 1 and broken.count() == 1
    cat = tables.read_protein_catalog(spark, put("k.tsv", "G1\t5\nG2\t6\tA\tT1\tR1\n")).collect()
    assert [tuple(r) for r in cat] == [("G1", 5, None, None, None), ("G2", 6, "A", "T1", "R1")]
    con = tables.read_constraint(spark, put("c.tsv", "gene\tpli\tloeuf\tmis_z\nG\t0.9\tNA\t1\n")).first()
    assert tuple(con) == ("G", 0.9, None, 1.0)
    tables.write_tsv(spark.createDataFrame([(1, ["a", "b"], None)], "x int, y array<string>, z string"), str(tmp_path / "o"), ["y", "x", "z"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["y\tx\tz", "a,b\t1\t"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("12"), st.integers(0, 300), st.integers(1, 40)), max_size=60))
def test_merged_intervals_are_disjoint_and_cover_the_same(spark, raw):
    rows = [(c, s, s + n) for c, s, n in raw]
    df = spark.createDataFrame(rows, "chrom string, start0 int, end0 int")
    out = sorted((r.chrom, r.start0, r.end0) for r in I.merged(df).collect())
    assert {(c, i) for c, s, e in rows for i in range(s, e)} == {(c, i) for c, s, e in out for i in range(s, e)}
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(out, out[1:]))
    sites = spark.createDataFrame([(i, "1", i * 7, i * 7 + 9) for i in range(30)], "id int, chrom string, start0 int, end0 int")
    want = {(i, s, e) for i in range(30) for c, s, e in rows if c == "1" and i * 7 < e and s < i * 7 + 9}
    assert {(r.id, r.r_start0, r.r_end0) for r in I.overlaps(sites, df.distinct(), width=16).collect()} == want


def test_de_novo_branches(spark):
    def call(sample, site, gt, dp=30, gq=60, alt=15):
        return (sample, site, gt, dp, gq, alt, "PASS")

    cases = {
        1: ("high_confidence", [call("C", 1, "0/1"), call("M", 1, "0/0", alt=0), call("F", 1, "0/0", alt=0)]),
        2: ("inherited", [call("C", 2, "0/1"), call("M", 2, "0/1"), call("F", 2, "0/0", alt=0)]),
        3: ("possible", [call("C", 3, "0/1"), call("M", 3, "0/1", dp=2), call("F", 3, "0/0", alt=0)]),
        4: ("mendelian_conflict", [call("C", 4, "1/1", alt=30), call("M", 4, "0/0", alt=0), call("F", 4, "0/0", alt=0)]),
        5: ("likely_artifact", [call("C", 5, "0/1", gq=3), call("M", 5, "0/0", alt=0), call("F", 5, "0/0", alt=0)]),
        6: ("likely_artifact", [call("C", 6, "0/1", alt=2), call("M", 6, "0/0", alt=0), call("F", 6, "0/0", alt=0)]),
        7: ("possible", [call("C", 7, "0/1"), call("M", 7, "0/0", alt=0)]),
        8: ("possible_parental_mosaicism", [call("C", 8, "0/1"), call("M", 8, "0/0", alt=3), call("F", 8, "0/0", alt=0)]),
        9: ("possible", [call("C", 9, "0/1"), call("M", 9, "0/0", dp=None, alt=0), call("F", 9, "0/0", alt=0)]),
        10: ("high_confidence", [call("C", 10, "1/1", alt=30), call("M", 10, "0/0", alt=0), call("F", 10, "0/1")]),
        11: ("high_confidence", [call("C", 11, "1", alt=30), call("F", 11, "0", alt=0)]),
        12: ("inherited", [call("C", 12, "0/1"), call("M", 12, "0/1"), call("F", 12, "0/0", alt=0)]),
        13: ("mendelian_conflict", [call("C", 13, "0/1"), call("M", 13, "0/2", alt=0), call("F", 13, "0/0", alt=0)]),
    }
    place = {10: ("X", 5_000_000), 11: ("Y", 5_000_000), 12: ("MT", 100)}
    calls = spark.createDataFrame([c for _, rows in cases.values() for c in rows], "sample_id string, site_id int, gt string, dp int, gq int, ad_alt int, filter string")
    family = spark.createDataFrame([("F1", "C", "M", "F", "male")], "family_id string, proband string, mother string, father string, proband_sex string")
    sites = spark.createDataFrame([(i, *place.get(i, ("1", 100 + i)), f"k{i}") for i in cases], "site_id int, chrom string, pos int, variant_key string")
    rows = Y.origin(Y.de_novo(Y.with_parents(calls, family).join(sites, "site_id"))).cache()
    assert {r.site_id: r.status for r in rows.collect()} == {i: s for i, (s, _) in cases.items()}
    assert {r.site_id: r.origin for r in rows.collect()}[2] == "maternal"


def test_stop_rule_refuses_and_reads_on(spark):
    exons = ["CC" + "ATG" + "GCA" * 20, "CTGACC" * 8 + "TAA" + "GG"]  # the start codon at place 3 of the first exon
    gene = exons[0] + "T" * 30 + exons[1]
    other = A_reverse(gene)
    total, first, second = len(gene), (3, len(exons[0])), (len(exons[0]) + 31, len(gene) - 2)
    spans = [("exon", 1, first[1]), ("exon", second[0], total), ("CDS", *first), ("CDS", second[0], second[1] - 3), ("stop_codon", second[1] - 2, second[1])]
    features = [("P", 1, "protein_coding", "1", "+", *x) for x in spans] + [("R", None, "protein_coding", "2", "-", k, total + 1 - b, total + 1 - a) for k, a, b in spans] + [("L", 1, "protein_coding", "9", "+", *x) for x in spans] + [("E", 1, "protein_coding", "1", "+", "exon", 1, 9)]
    chunks = [(c, i // 16, s[i : i + 16]) for c, s in (("1", gene), ("2", other)) for i in range(0, total, 16)]
    models = T.coding_models(spark.createDataFrame(features, "tx_id string, version int, biotype string, chrom string, strand string, feature string, start1 long, end1 long"), spark.createDataFrame(chunks, "chrom string, chunk long, sequence string"), 16)
    found = {r.tx_id: r for r in models.collect()}
    assert {k: r.problems for k, r in found.items()} == {"P": [], "R": [], "L": ["sequence_fetch_failed"], "E": ["no_cds"]}
    assert found["P"].coding == found["R"].coding == (exons[0] + exons[1])[2:] and found["P"].last_junction == found["R"].last_coding_junction == 63
    edge = first[1]
    edits = [("P", 6, "G", "GAA"), ("P.2", 6, "G", "GAA"), ("P.1", 6, "G", None), ("P", edge - 1, gene[edge - 2 : edge + 31], "C"), ("P", edge + 5, "T", "TA"), ("P", 2, "CA", "C"), ("R", total - 6, other[total - 7], other[total - 7] + "TT"), ("L", 6, "G", "GAA"), ("E", 6, "G", "GAA"), (None, 6, "G", "GAA")]
    out = T.stop_rule(spark.createDataFrame(edits, "tx_id string, pos long, ref string, alt string").withColumn("consequence", F.lit(None).cast("string")), models).collect()
    status = {(r.tx_id, r.pos): r.status for r in out if r.alt is not None}
    assert status == {
        ("P", 6): "ok", ("P.2", 6): "transcript_version_mismatch", ("P", edge - 1): "spans_exon_boundary", ("P", edge + 5): "outside_cds", ("P", 2): "ok", ("R", total - 6): "ok",
        ("L", 6): "bad_transcript_model:sequence_fetch_failed", ("E", 6): "bad_transcript_model:no_cds", (None, 6): "no_transcript_model",
    }
    assert [r.status for r in out if r.alt is None] == ["unsupported_allele"]
    edited = {("P", 6): "ATGGAA" + "CA" + "GCA" * 19 + exons[1], ("P", 2): "TG" + "GCA" * 20 + exons[1]}
    for r in out:
        if (s := edited.get((r.tx_id, r.pos))) is not None and r.alt:
            stop = next(i for i in range(0, len(s) - 2, 3) if s[i : i + 3] in T.STOPS)
            gap = 63 + len(s) - len(found["P"].coding) - stop
            assert (r.ptc, r.ptc_distance, r.rule) == (stop, gap, "PASS" if gap > 50 else "FAIL")
    assert T.coding_models(models.sparkSession.createDataFrame([], "tx_id string, version int, biotype string, chrom string, strand string, feature string, start1 long, end1 long"), spark.createDataFrame(chunks, "chrom string, chunk long, sequence string"), 16).count() == 0


def A_reverse(bases):
    return bases[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_frame_restoration_classes(spark):
    events = spark.createDataFrame([(1, "T", 2, [1, 2])], "event_id int, transcript string, members long, sites array<int>")
    calls = [("conf", 1, "0|1", "p"), ("conf", 2, "0|1", "p"), ("trans", 1, "0|1", "p"), ("trans", 2, "1|0", "p"), ("open", 1, "0/1", None), ("open", 2, "0/1", None), ("hom", 1, "1/1", None), ("hom", 2, "0/1", None), ("one", 1, "0/1", None)]
    out = T.restorations(events, spark.createDataFrame(calls, "sample_id string, site_id int, gt string, phase_set string")).collect()
    assert {r.sample_id: r.status for r in out} == {"conf": T.CONFIRMED, "trans": T.TRANS, "open": T.POSSIBLE, "hom": T.CONFIRMED}


def test_lookup_counts_by_query_row(spark):
    queries = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, None, "x"), (3, "A", "x"), (4, "B", "x")], "site_id int, tx string, consequence string")
    scores = spark.createDataFrame([(1, "A", 5), (2, "A", 6), (3, "A", 7), (3, "A", 8), (4, "A", 9)], "site_id int, tx string, score int")
    out = S.lookup(queries, scores, S.ScoreSpec(dimensions=("tx",))).collect()
    assert sorted((r.site_id, r.status, r.match, r.score) for r in out) == [(1, "exact", "allele_tx", 5), (1, "exact", "allele_tx", 5), (2, "ambiguous", "query_target_unavailable", None), (3, "ambiguous", "multiple_exact_records", None), (4, "partial", "allele_only", None)]


def test_score_manifests_are_checked():
    import copy

    from varloom.plans.scoring import MANIFEST

    spec, names = S.spec_of(MANIFEST)
    assert spec.dimensions == ("transcript",) and spec.normal == (("transcript", "strip_version"),) and names["feature"] == "transcript"
    faults = [("table", "columns", ["chr", "chr"]), ("match", "required", ["transcript"]), ("match", "required", ["allele", "gene"]), ("applicability", "consequences", [])]
    for part, key, value in faults:
        bad = copy.deepcopy(MANIFEST)
        bad[part][key] = value
        with pytest.raises(ValueError):
            S.spec_of(bad)
    for change in ({"minimum": 2}, {"type": "string"}, {"column": "feature"}, {"column": "none"}):
        bad = copy.deepcopy(MANIFEST)
        bad["outputs"][0] |= change
        with pytest.raises(ValueError):
            S.spec_of(bad)


def test_protein_changes_compare_in_one_letter(spark):
    queries = spark.createDataFrame([(1, "ENSP1.1:p.Gly12Asp"), (2, "G12D"), (3, None)], "site_id int, change string")
    scores = spark.createDataFrame([(1, "G12D", 0.5), (2, "p.Gly12Asp", 0.25), (3, "G12D", 0.75)], "site_id int, change string, score double")
    out = S.lookup(queries, scores, S.ScoreSpec(dimensions=("change",), normal=(("change", "one_letter_protein_change"),))).collect()
    assert {r.site_id: (r.status, r.score) for r in out} == {1: ("exact", 0.5), 2: ("exact", 0.25), 3: ("ambiguous", None)}


def test_registry_is_checked():
    with pytest.raises(ValueError):
        S.checked_registry([S.Predictor("a", "x"), S.Predictor("a", "y")])
    with pytest.raises(ValueError):
        S.source_status([S.Predictor("a", "x")], [], (), required=("a",))
    assert S.source_status([S.Predictor("a", "x"), S.Predictor("b", "y")], ["x"], ("a",)) == {"a": "READY", "b": "SKIPPED_NOT_INSTALLED"}


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        R.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "term int, parent int"))


def test_fingerprints_ignore_order(spark):
    rows = [("v1", "a", "0/1", 1), ("v2", "a", "1/1", 1), ("v1", "b", "0/1", 2)]
    df = spark.createDataFrame(rows, "variant_key string, sample_id string, gt string, f int")
    one_ = sorted(map(tuple, B.fingerprint(df, "f").collect()))
    assert one_ == sorted(map(tuple, B.fingerprint(df.orderBy(F.desc("gt")).repartition(3), "f").collect()))
    other = df.withColumn("gt", F.when(F.col("variant_key") == "v2", "0/1").otherwise(F.col("gt")))
    assert one_ != sorted(map(tuple, B.fingerprint(other, "f").collect()))


def chunked(spark, sequence, size):
    return spark.createDataFrame([("1", i // size, sequence[i : i + size]) for i in range(0, len(sequence), size)], "chrom string, chunk long, sequence string")


def test_indels_move_left(spark):
    from varloom.operators import reference as P

    seq = "GGGCACACACAATTTTTTC" + "ACGT" * 20
    cases = [(9, "ACA", "A"), (16, "T", "TT"), (12, "A", "G"), (3, "G", "GC"), (17, "TT", "T"), (5, "T", "TA"), (500, "A", "AT"), (7, "CA", "CACA")]
    rows = spark.createDataFrame([(i, "1", *c) for i, c in enumerate(cases)], "id int, chrom string, pos int, ref string, alt string")
    out = {r.id: r for r in P.left_aligned(rows, chunked(spark, seq, 32), 32).collect()}

    def apply(pos, ref, alt):
        return seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]

    for i, (pos, ref, alt) in enumerate(cases):
        r = out[i]
        if pos > len(seq):
            assert r.status == "unmapped"
        elif seq[pos - 1 : pos - 1 + len(ref)] != ref:
            assert r.status == "reference_mismatch" or len(ref) == len(alt) == 1
        else:
            assert r.status == "aligned" and apply(r.pos, r.ref, r.alt) == apply(pos, ref, alt)
            if len(ref) != len(alt):
                assert not any(seq[p - 1 : p - 1 + len(r.ref)] and apply(p, seq[p - 1 : p - 1 + len(r.ref)], seq[p - 1] + (r.alt[1:] if len(r.alt) > 1 else "")) == apply(pos, ref, alt) and len(r.ref) == 1 for p in range(1, r.pos))


def test_hgvs_becomes_alleles(spark):
    from varloom.operators import reference as P

    seq = "ACGTTGCA" * 5
    cases = {"x:g.2C>G": (2, "C", "G"), "g.3_4del": (2, "CGT", "C"), "g.3del": (2, "CG", "C"), "g.4_5insAA": (4, "T", "TAA"), "g.3_4dup": (2, "C", "CGT"), "g.3_4delinsA": (2, "CGT", "CA"), "g.2A>G": (None, None, None), "c.3del": (None, None, None), "g.900del": (None, None, None)}
    rows = spark.createDataFrame([("1", h) for h in cases], "chrom string, hgvs string")
    assert {r.hgvs: (r.pos, r.ref, r.alt) for r in P.hgvs_alleles(rows, chunked(spark, seq, 16), 16).collect()} == cases


def test_contexts_are_known_beyond_ten_thousand(spark):
    ids = [f"CL:{i}" for i in range(10_050)]
    contexts = spark.createDataFrame([(i, x, 1) for i, x in enumerate(ids)], "row_index long, ontology_id string, detected int")
    sites = overlaps = spark.range(10_050).select(F.col("id").alias("site_id"), F.col("id").alias("row_index"))
    assert R.filter_contexts(sites, overlaps, contexts, ids[::40]).count() == len(ids[::40])
    assert R.filter_contexts(sites, overlaps, contexts, ids[7:8] * 2, "all").count() == 1
    with pytest.raises(ValueError):
        R.filter_contexts(sites, overlaps, contexts, [ids[0], "CL:x"])


def test_findings_have_the_tags_of_their_wording(spark):
    want = {
        "normal count, low memory B cells": (["Reduced", "Normal", "Functional / subset abnormality"], ["Other lymphocyte"]),
        "Not assessed; T cells low": (["Not assessed"], ["Other lymphocyte"]),
        "NK cells absent, monocytes/macrophages increased": (["Absent / very low", "Increased", "Variable / mixed"], ["NK / innate lymphoid", "Myeloid / phagocyte"]),
        "Low to  normal": (["Reduced", "Normal", "Variable / mixed"], ["Other cell or tissue"]),
        "severely  low platelets": (["Absent / very low", "Reduced"], ["Platelet / erythroid"]),
        "hyperplasia": (["Descriptive finding"], ["Other cell or tissue"]),
        "unknowns": (["Descriptive finding"], ["Other cell or tissue"]),
        "   ": ([], []),
        None: ([], []),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", E.finding_tags(F.col("t")).alias("tags"), E.cell_groups(F.col("t")).alias("cells"))
    assert {r.t: (r.tags, r.cells) for r in rows.collect()} == want


def test_a_clinical_record_without_position_stops_the_scan(spark):
    rows = spark.createDataFrame([("1", "x5", "a", "A", "C", "CLNSIG=Pathogenic;MC=SO:1|missense_variant")], "chrom string, pos string, id string, ref string, alt string, info string")
    with pytest.raises(Exception, match="whole number as position"):
        L.missense_scan(rows).collect()
    assert L.missense_scan(rows.withColumn("info", F.lit("CLNSIG=Benign;MC=missense_variant"))).count() == 0
    assert L.missense_scan(rows.limit(0)).count() == 0


def test_prepared_gene_scores_are_ranged_and_unique(spark):
    kind = "variant string, gene string, a string, dropped string"
    good = [("chrX-7-a-g", "ENSG00000000001.3", "0.5", "q"), ("10-5-A-C", "ENSG00000000001", "NA", "q"), ("2-9-A-C", "ENSG00000000002", "1", "q"), ("2-3-A-C", "ENSG00000000002", "0", "q"), ("M-1-A-C", "ENSG00000000002", "0", "q")]
    out = S.prepared_gene_scores(spark.createDataFrame(good, kind), ["a"], partitions=1)
    assert [tuple(r) for r in out.collect()] == [("2", 3, "A", "C", "ENSG00000000002", "0"), ("2", 9, "A", "C", "ENSG00000000002", "1"), ("10", 5, "A", "C", "ENSG00000000001", "."), ("X", 7, "A", "G", "ENSG00000000001", "0.5"), ("MT", 1, "A", "C", "ENSG00000000002", "0")]
    for bad, why in ((good + [("x-7-A-G", "ENSG00000000001.9", "0.1", "q")], "repeated"), (good + [("3-1-A-G", "ENSG1", "0.1", "q")], "invalid: gene"), (good + [("3-1-A-G", "ENSG00000000003", "inf", "q")], "invalid: score a")):
        with pytest.raises(Exception, match=why):
            S.prepared_gene_scores(spark.createDataFrame(bad, kind), ["a"]).collect()


def test_evidence_of_an_alt_by_name_and_by_slot(spark):
    alts = F.array(F.lit("C"), F.lit("G"))
    cases = [("c|x,g|y", 1, ["g|y"], ["g|y"]), ("C|x&G|y", 0, ["C|x"], ["C|x"]), ("u,v", 1, ["v"], []), ("%47|z", 1, ["%47|z"], ["%47|z"]), ("-", 0, [], []), (None, 0, [], []), ("a|1,b|2,c|3", 0, [], ["c|3"])]
    rows = spark.createDataFrame([(i, r, k) for i, (r, k, _, _) in enumerate(cases)], "i int, raw string, k int").withColumn("alt", F.when(F.col("k") == 0, "C").otherwise("G"))
    got = rows.select("i", X.assertions_of_alt(F.col("raw"), F.col("alt"), F.col("k"), alts).alias("a"), X.records_of_alt(F.col("raw"), F.col("alt"), F.col("k"), alts).alias("r")).orderBy("i").collect()
    assert [(g.a, g.r) for g in got] == [(a, r) for _, _, a, r in cases]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["1", "2"]), st.integers(0, 300), st.integers(-2, 90)), max_size=40), st.integers(0, 3), st.sampled_from([7, 40, 1000]))
def test_merged_over_bins_of_any_width(spark, rows, gap, width):
    want = []
    for c, a, b in sorted((c, a, a + n) for c, a, n in rows if n > 0):
        if want and want[-1][0] == c and a <= want[-1][2] + gap:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([c, a, b])
    df = spark.createDataFrame([(c, a, a + n) for c, a, n in rows], "chrom string, start0 long, end0 long")
    assert sorted([r.chrom, r.start0, r.end0] for r in I.merged(df, gap, width).collect()) == want


def test_order_is_checked_over_chunks(spark):
    rows = [(0, "1", 5, 9), (1, "1", 7, 8), (2, "2", 1, 2), (3, "1", 6, 9), (9, "1", 6, 7), (10, "2", 0, 3), (11, "1", 20, 20), (40, "1", 19, 22)]
    df = spark.createDataFrame(rows, "n long, chrom string, start0 long, end0 long")
    for chunk in (1, 2, 3, 100):
        assert sorted((r.n, r.violation) for r in R.ordered_violations(df, "n", chunk).collect()) == [(3, "unsorted"), (10, "unsorted"), (11, "empty"), (40, "unsorted")]
