"""Operator 6, line dedup by winnowing over line hashes. DataFrame functions only.

A text is its lines that hold a word. From each line a window opens that closes as soon as it holds MIN_WORDS words.

1. Select: a window's fingerprint is its least line hash, at the last place where it occurs. Windows next to each other mostly choose the same line. Windows that
   hold the same lines choose the same one, so that a run of at least MIN_WORDS words that is repeated has a fingerprint in both places.
2. Rule out: a fingerprint that is chosen at one place of the corpus only can't belong to a repeated run; its windows go.
3. Join positions: what is left is joined with the first window (by doc_id, then position) of the same lines, all of them, and not only the chosen one: a frequent line
   chosen in a thousand places so makes one match a window and no pairs.
4. Extend: a match goes on to the right as far as both texts do, up to where the next line's window takes over; to the left the window of the line before
   is matched itself. So matches cover a repeated run from its first line to its last.
5. Delete: the lines of later windows go. Lines of a first window, as far as some later one repeats it, stay, also where they belong to
   a later window of another run, or of the same one where it overlaps itself. So each repeated window stays whole in the place where it comes first, and every deleted line
   has an equal one that is earlier.

A line is compared by two hashes and its length, without white space at its ends; a window by a hash of each of both. Rows of hot
fingerprints and passages are dealt by the split in `common.attach_stats`; what lies behind is grouped by document.

Defined cases: a null text counts as empty. Texts of fewer than MIN_WORDS words are left as they are. Runs repeated
within a text go too, but for the first. Rows repeated with the same doc_id and text count as one document and get one
result each. A null doc_id comes first. Blank lines between deleted lines go with them. A text that repeats earlier ones
as a whole becomes empty, and its row stays. An empty table gives an empty result. Extra columns are kept by `clean`, but for one
named `removed`, which it replaces. The work on a very long text grows with its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
_DOC = ["d", "h"]


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("h")]


def _lines(text: Column) -> Column:
    """array<struct<a, b, w, line>> of the lines that hold a word: hash, second hash with length, words, number in the text."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " ")).alias("x"), i.alias("line")))
    words = F.filter(every, lambda s: s["x"] != "")
    return F.transform(words, lambda s: F.struct(F.xxhash64(s["x"]).alias("a"), (F.hash(s["x"]).cast("long") * (1 << 24) + F.length(s["x"])).alias("b"), F.size(F.split(s["x"], " +")).alias("w"), s["line"].alias("line")))


def _windows(lines: Column, min_words: int) -> Column:
    """array<struct<i, j, m, p, fp, tail>>: first and last position of each window, its least line hash and that one's position, its key, and the hashes of what may follow.

    A window has at most min_words lines, as each holds a word. The tail are the lines behind it that the next line's window doesn't reach beyond.
    """

    def step(acc: Column, x: Column) -> Column:
        less = (acc["k"] == 0) | (x["a"] <= acc["m"])
        taken = F.struct((acc["n"] + x["w"]).alias("n"), (acc["k"] + 1).alias("k"), F.when(less, x["a"]).otherwise(acc["m"]).alias("m"), F.when(less, acc["k"]).otherwise(acc["p"]).alias("p"))
        return F.when(acc["n"] >= min_words, acc).otherwise(taken)

    def follow(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["w"]
        return F.when(n < min_words, F.struct(n.alias("n"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(min_words).alias("n"), acc["k"].alias("k")))

    zero = F.lit(0)
    none = F.struct(zero.alias("n"), zero.alias("k"), F.lit(0).cast("long").alias("m"), zero.alias("p"))

    def window(i: Column, x: Column, more: Column) -> Column:
        inside, j = F.slice(lines, i + 1, x["k"]), i + x["k"] - 1
        fp = F.struct(F.xxhash64(F.transform(inside, lambda s: s["a"])).alias("a"), F.hash(F.transform(inside, lambda s: s["b"])).alias("b"))
        tail = F.transform(F.slice(lines, j + 2, F.greatest(i + more - j, zero)), lambda s: F.xxhash64(s["a"], s["b"]))
        return F.struct(i.alias("i"), j.alias("j"), x["m"].alias("m"), (i + x["p"]).alias("p"), fp.alias("fp"), tail.alias("tail"))

    both = F.transform(lines, lambda _, i: F.struct(i.alias("i"), F.aggregate(F.slice(lines, i + 1, min_words), none, step).alias("x"), F.aggregate(F.slice(lines, i + 2, min_words), F.struct(zero.alias("n"), zero.alias("k")), follow)["k"].alias("more")))
    return F.transform(F.filter(both, lambda s: s["x"]["n"] >= min_words), lambda s: window(s["i"], s["x"], s["more"]))


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with in common."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(other > 0, other - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def matches(docs: DataFrame, tables: common.Tables, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, i, j of each later window and od, oh, oi, oj of the first one of its lines, both extended to the right."""
    own = docs.select(*_key(F.col("doc_id"), common.plain_text()), _lines(common.plain_text()).alias("lines"))
    marks = tables.write(own.select(*_DOC, F.inline(_windows(F.col("lines"), min_words))), "marks")
    place = F.struct(*_DOC, "p")
    chosen = marks.groupBy("m").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n"))
    repeated = tables.write(chosen.filter(F.col("lo") != F.col("hi")).select("m", "n", F.lit(True).alias("again")), "fingerprints")
    left = tables.write(common.attach_stats(marks, repeated, "m", "n", common.total_of(repeated, "n"), ["d", "i"]).filter("again").select(*_DOC, "i", "j", "fp", "tail"), "windows")
    firsts = left.groupBy("fp").agg(F.min(F.struct(*_DOC, "i", "j", "tail")).alias("origin"), F.count("*").alias("n"))
    firsts = tables.write(firsts.filter("n > 1"), "firsts")
    met = common.attach_stats(left, firsts, "fp", "n", common.total_of(firsts, "n"), ["d", "i"])
    o = F.col("origin")
    met = met.filter(o.isNotNull() & (F.struct(*_DOC, "i") != F.struct(o["d"], o["h"], o["i"])))
    more = _alike(F.col("tail"), o["tail"])
    return met.select(*_DOC, "i", (F.col("j") + more).alias("j"), o["d"].alias("od"), o["h"].alias("oh"), o["i"].alias("oi"), (o["j"] + more).alias("oj"))


def repeated_runs(docs: DataFrame, tables: common.Tables, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h (the document's key), runs: array<struct<first, last>> of positions of lines to delete; only documents with some."""
    met = tables.write(matches(docs, tables, min_words), "matches")

    def events(d: str, h: str, i: str, j: str, kind: str) -> DataFrame:
        ends = F.array(F.struct(F.col(i).alias("at"), F.lit(1).alias("v")), F.struct((F.col(j) + 1).alias("at"), F.lit(-1).alias("v")))
        rows = met.select(d, h, i, j).distinct().select(F.col(d).alias("d"), F.col(h).alias("h"), F.inline(ends))
        return rows.select("d", "h", "at", *[(F.col("v") if k == kind else F.lit(0)).alias(k) for k in ("gone", "kept")])

    both = events("d", "h", "i", "j", "gone").unionByName(events("od", "oh", "oi", "oj", "kept"))
    steps = both.groupBy(*_DOC, "at").agg(F.sum("gone").alias("gone"), F.sum("kept").alias("kept"))
    inside = Window.partitionBy(*_DOC).orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    spans = steps.select(*_DOC, "at", (F.lead("at").over(inside) - 1).alias("last"), ((F.sum("gone").over(upto) > 0) & (F.sum("kept").over(upto) == 0)).alias("go"))
    islands = spans.withColumn("island", F.sum((~F.col("go")).cast("int")).over(upto)).filter("go")
    runs = islands.groupBy(*_DOC, "island").agg(F.min("at").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated runs gone from `text`, and `removed`: the runs of lines that went, array<struct<first, last>>, by their numbers in the text."""
    tables = common.Tables(docs.sparkSession)
    runs = tables.write(repeated_runs(docs, tables, min_words), "runs", keep=True)
    tables.drop()
    d, h = _key(F.col("doc_id"), common.plain_text())
    keyed = docs.select("*", d.alias("_vl_d"), h.alias("_vl_h"))
    # a table of this size is dealt at any size that matters, so that a small one isn't broadcast either
    out = keyed.join(runs.withColumnsRenamed({"d": "_vl_rd", "h": "_vl_rh", "runs": "_vl_runs"}).hint("merge"), (F.col("_vl_d") == F.col("_vl_rd")) & (F.col("_vl_h") == F.col("_vl_rh")), "left")
    numbers = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " ")) != "", i)), lambda i: i.isNotNull())
    out = out.withColumn("_vl_n", F.when(F.col("_vl_runs").isNotNull(), numbers))
    out = out.withColumn("_vl_runs", F.transform("_vl_runs", lambda r: F.struct(F.get("_vl_n", r["first"]).alias("first"), F.get("_vl_n", r["last"]).alias("last"))))
    # line numbers that go, once each, so that a very long text isn't held against each run line by line
    gone = F.flatten(F.transform("_vl_runs", lambda r: F.sequence(r["first"], r["last"])))
    all_numbers = F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)
    left = F.transform(F.array_except(all_numbers, gone), lambda i: F.get(F.col("_vl_lines"), i))
    out = out.withColumn("_vl_lines", F.when(F.col("_vl_runs").isNotNull(), F.split("text", "\n")))
    text = F.when(F.col("_vl_runs").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    removed = F.coalesce("_vl_runs", F.array().cast("array<struct<first:int,last:int>>"))
    others = [F.col(c) for c in docs.columns if c not in ("text", "removed")]
    return out.select(*others, text.alias("text"), removed.alias("removed"))
