"""Alleles against reference sequence: left alignment of indels, and alleles from genomic HGVS.

The reference is a table of chunks (chrom, chunk, sequence) of CHUNK bases; it's large, so variants meet the chunk they lie
in and those beside it by a join on both numbers, sorted, never by a broadcast, however small its files look to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.scratch import scratch_path

CHUNK = 1024


def with_window(rows: DataFrame, chunks: DataFrame, pos: str = "pos", size: int = CHUNK) -> DataFrame:
    """rows with `window`, the bases of the position's chunk, the one before and the one behind, and window_start (1-based); null without the chunk."""
    at = F.floor((F.col(pos) - 1) / size)
    out = rows.withColumn("_chunk", at)
    for name, step in (("_before", -1), ("_here", 0), ("_behind", 1)):
        own = chunks.select(F.col("chrom").alias("_c"), (F.col("chunk") - step).alias("_n"), F.col("sequence").alias(name)).hint("merge")
        out = out.join(own, (F.col("chrom") == F.col("_c")) & (F.col("_chunk") == F.col("_n")), "left").drop("_c", "_n")
    window = F.concat(F.coalesce("_before", F.lit("")), F.col("_here"), F.coalesce("_behind", F.lit("")))
    start = F.col("_chunk") * size + 1 - F.length(F.coalesce("_before", F.lit("")))
    return out.withColumns({"window": window, "window_start": F.when(F.col("_here").isNotNull(), start)}).drop("_chunk", "_before", "_here", "_behind")


def _common(a: Column, b: Column, limit: Column, bits: int) -> Column:
    """How many characters a and b begin with alike, up to limit (below 2^bits): by halves, each a comparison of two substrings."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= limit) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))


def _parts(rows: DataFrame) -> DataFrame:
    """rows with what an allele changes: unit (the bases that an indel puts in or takes out and that may move, else null), at (the first base behind the place where
    they stand), longer (whether REF is the longer one), and for all others their minimal form."""
    ref, alt = F.upper("ref"), F.upper("alt")
    n, m = F.length(ref), F.length(alt)
    least = F.least(n, m)
    back = _common(F.reverse(ref), F.reverse(alt), least, 24)
    out = rows.withColumns({"_pos": F.col("pos").cast("long"), "_ref": ref, "_alt": alt, "_s": back})
    n, m = F.length("_ref"), F.length("_alt")
    # where the shorter one is a suffix of the longer, what is in front of it moves
    out = out.withColumns({"longer": n > m, "unit": F.when((F.col("_s") == F.least(n, m)) & (n != m), F.substring(F.when(n > m, F.col("_ref")).otherwise(F.col("_alt")), F.lit(1), F.abs(n - m)))})
    cut = lambda c: F.substring(c, F.lit(1), F.greatest(F.length(c) - F.least(F.col("_s"), F.least(n, m) - 1), F.lit(1)))
    out = out.withColumns({"_r": cut("_ref"), "_a": cut("_alt")})
    front = _common(F.col("_r"), F.col("_a"), F.least(F.length("_r"), F.length("_a")) - 1, 24)
    out = out.withColumn("_p", F.when(F.col("_ref") == F.col("_alt"), 0).otherwise(front))
    rest = lambda c: F.substring(c, F.col("_p") + 1, F.length(c))
    return out.withColumns({"m_pos": F.col("_pos") + F.col("_p"), "m_ref": rest("_r"), "m_alt": rest("_a"), "at": F.col("_pos")}).drop("_s", "_r", "_a", "_p")


def _moved(rows: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """One round: rows (unit, at) as far to the left as their window shows; status is null for those that reach its edge.

    A unit moves by a base while the base in front of it is its last one, and is then turned by one. So it moves as far as the
    reference in front of it, read backwards, goes on like the unit, read backwards and repeated.
    """
    w = with_window(rows.withColumn("_near", F.greatest(F.col("at") - 1, F.lit(1))), chunks, pos="_near", size=size).drop("_near")
    first = F.greatest(F.col("window_start"), F.lit(2))  # the first base of a contig stays in front as the anchor
    shown = F.greatest(F.col("at") - first, F.lit(0)).cast("int")
    w = w.withColumns({"_shown": shown, "_left": F.reverse(F.upper(F.substring("window", (first - F.col("window_start") + 1).cast("int"), shown)))})
    times = F.ceil(F.col("_shown") / F.length("unit")).cast("int")
    w = w.withColumn("_m", _common(F.col("_left"), F.repeat(F.reverse("unit"), times), F.col("_shown"), 1 + (2 * size).bit_length()))
    turn = F.col("_m") % F.length("unit")
    unit = F.concat(F.substring("unit", F.length("unit") - turn + 1, turn), F.substring("unit", F.lit(1), F.length("unit") - turn))
    edge = (F.col("_m") == F.col("_shown")) & (F.col("window_start") > 1)
    out = w.withColumns({"unit": unit, "at": F.col("at") - F.col("_m")})
    anchor = F.upper(F.substring("window", (F.col("at") - F.col("window_start")).cast("int"), F.lit(1)))
    status = F.when(F.col("window").isNull(), "unmapped").when(~edge, "aligned")
    return out.withColumns({"status": status, "anchor": anchor}).drop("window", "window_start", "_shown", "_left", "_m")


def left_aligned(rows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """rows (chrom, pos, ref, alt) at their leftmost equal place, with status: aligned, reference_mismatch, or unmapped.

    Unmapped: there's no sequence where the allele lies or where it moves to; it's returned as it came in, as are those that the reference
    contradicts, and equal alleles. What reaches the edge of its window goes on in the window of the chunk before, for as many rounds as the
    longest repeat has chunks; others are done after the first. A change of one base for another is where it is. Of a REF
    longer than the window the part in it is compared.
    """
    others = [c for c in rows.columns if c not in ("pos", "ref", "alt")]
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    kept = rows.filter(single).select(*others, F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.lit("aligned").alias("status"))
    w = with_window(_parts(rows.filter(~single)), chunks, pos="_pos", size=size)
    here = F.upper(F.substring("window", (F.col("_pos") - F.col("window_start") + 1).cast("int"), F.length("_ref")))
    same = (F.length(here) > 0) & (here == F.substring("_ref", F.lit(1), F.length(here)))
    status = F.when(F.col("window").isNull(), "unmapped").when(~same, "reference_mismatch").when(F.col("unit").isNull(), "minimal").when(F.col("at") == 1, "start")
    state = w.withColumns({"status": status, "anchor": F.lit(None).cast("string")}).drop("window", "window_start")
    done = []
    while True:
        state = _written(state)
        done.append(state.filter("status IS NOT NULL"))
        moving = state.filter("status IS NULL")
        if moving.isEmpty():
            break
        state = _moved(moving.drop("status", "anchor"), chunks, size)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    s = F.col("status")
    long, short = F.concat("anchor", "unit"), F.col("anchor")
    as_is = s.isin("unmapped", "reference_mismatch") | (F.col("_ref") == F.col("_alt"))
    pick = lambda name, moved, start: F.when(as_is, F.col(f"_{name}")).when(s == "minimal", F.col(f"m_{name}")).when(s == "start", start).otherwise(moved)
    # at a contig's first base there's nothing in front, and the base behind is kept
    ref = pick("ref", F.when(F.col("longer"), long).otherwise(short), F.substring("_ref", F.lit(1), F.greatest(F.length("_ref") - F.length("_alt"), F.lit(0)) + 1))
    alt = pick("alt", F.when(F.col("longer"), short).otherwise(long), F.substring("_alt", F.lit(1), F.greatest(F.length("_alt") - F.length("_ref"), F.lit(0)) + 1))
    named = F.when(s.isin("unmapped", "reference_mismatch"), s).otherwise("aligned")
    return out.select(*others, pick("pos", F.col("at") - 1, F.lit(1)).cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), named.alias("status")).unionByName(kept)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "aligned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hgvs_alleles(rows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """rows (chrom, hgvs such as g.10A>G, g.10_12del, g.10_11insT, g.10_12dup, g.10_12delinsTT) with pos, ref, alt, anchored by the base before.

    Text of another form, or without sequence, gets nulls. The result isn't aligned yet: `left_aligned` does that.
    """
    text = F.regexp_extract("hgvs", r"g\.(.*)$", 1)
    pattern = r"^(\d+)(?:_(\d+))?(del|dup|ins|delins|([ACGT])>)([ACGT]*)$"
    get = lambda k: F.regexp_extract(text, pattern, k)
    known = text.rlike(pattern)
    first = F.when(known, get(1).cast("long"))
    last = F.coalesce(F.nullif(get(2), F.lit("")).cast("long"), first)
    kind = F.when(get(3).contains(">"), "sub").otherwise(get(3))
    named = rows.withColumns({"_first": first, "_last": last, "_kind": kind, "_own": get(4), "_new": get(5)})
    w = with_window(named, chunks, pos="_first", size=size)
    bases = lambda a, b: F.substring("window", (a - F.col("window_start") + 1).cast("int"), (b - a + 1).cast("int"))
    before, span = bases(F.col("_first") - 1, F.col("_first") - 1), bases(F.col("_first"), F.col("_last"))
    at = bases(F.col("_first"), F.col("_first"))
    allele = (
        F.when((F.col("_kind") == "sub") & (span == F.col("_own")), F.struct(F.col("_first").alias("pos"), span.alias("ref"), F.col("_new").alias("alt")))
        .when(F.col("_kind") == "del", F.struct((F.col("_first") - 1).alias("pos"), F.concat(before, span).alias("ref"), before.alias("alt")))
        .when(F.col("_kind") == "delins", F.struct((F.col("_first") - 1).alias("pos"), F.concat(before, span).alias("ref"), F.concat(before, F.col("_new")).alias("alt")))
        .when(F.col("_kind") == "ins", F.struct(F.col("_first").alias("pos"), at.alias("ref"), F.concat(at, F.col("_new")).alias("alt")))
        .when(F.col("_kind") == "dup", F.struct((F.col("_first") - 1).alias("pos"), before.alias("ref"), F.concat(before, span).alias("alt")))
    )
    whole = F.col("window").isNotNull() & (F.length(span) == F.col("_last") - F.col("_first") + 1)
    return w.withColumn("_a", F.when(whole, allele)).select(*rows.columns, "_a.pos", "_a.ref", "_a.alt")
