"""Exact dedup, mixing, URL filters, secrets and line dedup on small cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from varloom.llm import exact_dedup, line_dedup, mixing, secrets, url_filters
from varloom.llm.common import scratch_path

DOCS = "doc_id long, text string"


def index(spark, name):
    return exact_dedup.DigestIndex(spark, f"t_{name}_{random.getrandbits(40)}", buckets=4)


def test_dedup_keeps_largest_and_defines_odd_rows(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, None)]
    out = index(spark, "odd").ingest(spark.createDataFrame(rows, DOCS), "one").collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str)
    want = [(None, None, 1, True), (None, 4, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 2, False), (5, 5, 2, True)]
    assert got == sorted(want, key=str)


def test_dedup_is_incremental_and_replays(spark):
    idx = index(spark, "inc")
    first = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    second = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], DOCS)
    idx.ingest(first, "one").collect()
    for _ in range(2):
        out = {r.doc_id: (r.keep_id, r.kept) for r in idx.ingest(second, "two").collect()}
        assert out == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert idx.read().count() == 3
    again = {r.doc_id: r.kept for r in idx.ingest(first, "one").collect()}
    assert again == {1: True, 2: True}


def test_dedup_in_turn_is_one_batch_after_another(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (6, "c"), (None, "c"), (None, None), (7, "d")]
    docs, idx = spark.createDataFrame(rows, DOCS), index(spark, "turn")
    newer = F.coalesce(F.col("doc_id") > 4, F.lit(False))
    out = idx.ingest_in_turn(docs, [("newer", newer), ("older", ~newer)]).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out) == sorted([(0, 4, 3, False), (0, 6, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (7, 7, 1, True)])
    assert {(r.batch, r.keep_id) for r in idx.read().collect()} == {("newer", 5), ("newer", 6), ("newer", 7), ("older", 2), ("older", 4)}


def test_dedup_anti_join_reads_the_index_by_bucket(spark):
    idx = index(spark, "plan")
    idx.ingest(spark.createDataFrame([(1, "a")], DOCS), "one").collect()
    fresh = spark.createDataFrame([(2, "b")], DOCS).select(exact_dedup.text_digest().alias("digest")).groupBy("digest").count()
    plan = fresh.join(idx.read().hint("merge").select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_keep_first_keeps_columns_and_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (3, None, "w")], DOCS + ", digest string")
    out = exact_dedup.keep_first(docs, index(spark, "keep"), "one")
    assert out.columns == ["doc_id", "text", "digest"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert exact_dedup.keep_first(docs.limit(0), index(spark, "none"), "one").count() == 0


def test_mix_reaches_targets_to_the_word(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{min(i % 7, 3)}") for i in range(500)] + [(900, None, None), (901, "a b", None), (902, "", "empty")]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    out = mixing.mix(docs, mixing.repeating(5, 2, 1)).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        x = by.setdefault(r.source, [r.target, r.source_size, 0])
        x[2] += r.taken
    assert abs(sum(x[0] for x in by.values()) - 1.5 * total) < 1e-6
    assert all(x[0] <= 2 * x[1] and abs(x[2] - x[0]) <= 0.5 for x in by.values())
    assert sorted(out, key=str) == sorted(mixing.mix(docs.repartition(9), mixing.repeating(5, 2, 1)).collect(), key=str)


def test_mix_when_caps_or_rows_are_missing(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", "y")], DOCS + ", source string")
    full = mixing.mix(docs, mixing.repeating(1), share=9).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in full) == [(0, 2), (1, 6), (1, 6)]
    assert mixing.mix(docs.limit(0), mixing.repeating(1)).count() == 0
    again = mixing.repeat_documents(docs.withColumn("taken", F.lit(7)), mixing.repeating(1), share=9)
    assert again.columns == ["doc_id", "text", "source", "taken"] and again.count() == 6


def test_water_fill_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", rng.choice([5, 2, 1]), rng.randint(0, 1000)) for i in range(40)]
    total = 1.5 * sum(r[2] for r in rows)
    fixed, left = {}, dict((n, w) for n, w, _ in rows)
    size = {n: s for n, _, s in rows}
    while True:
        rest = total - sum(fixed.values())
        over = [n for n in left if rest / sum(left.values()) * left[n] > 2 * size[n]]
        if not over:
            break
        for n in over:
            fixed[n] = 2.0 * size[n]
            left.pop(n)
    want = fixed | {n: rest / sum(left.values()) * w for n, w in left.items()}
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, weight int, source_size long"), total, 2.0).collect()}
    assert got == pytest.approx(want)


def test_sources_are_ranked_over_partitions(spark):
    rows = spark.createDataFrame([(c,) for c in ["b", None, "é", "a", "Z", "", "c"]], "source string").repartition(5)
    got = [r.source for r in mixing.ranked(rows, "source").orderBy("rank").collect()]
    assert got == ["", "Z", "a", "b", "c", "é", None]


URLS = [("http://A.Example.org/es/x", "example.org", "/es/x"), ("x", "", ""), (None, "", ""), ("https://b.com?q", "b.com", ""), ("ftp://C.D/e?f#g", "c.d", "/e"), ("a://b://c/d", "b:", "//c/d"), ("http://É.com/", "É.com", "/")]


def test_urls_are_split(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in URLS], "url string").select("url", url_filters.host_of(F.col("url")).alias("h"), url_filters.path_of(F.col("url")).alias("p")).collect()
    for r, (u, h, p) in zip(rows, URLS):
        assert (r.h, r.p) == (h if u != URLS[0][0] else "a.example.org", p)


def test_rules_come_before_reputation(spark):
    rows = [(i, f"http://bad.net/{i}") for i in range(40)] + [(100 + i, f"http://good.net/{i}") for i in range(40)] + [(200, "http://new.net/"), (201, "http://other.io/"), (202, "http://bad.net/ok/x"), (203, None)]
    outcomes = spark.createDataFrame([(u, "good" in u) for i, u in rows[:80]], "url string, good boolean")
    out = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "bad.net/ok/")], outcomes).collect()}
    assert len(out) == len(rows)
    assert out[0].verdict == "block" and out[100].verdict == "allow" and out[202].verdict == "allow" and out[202].rule == "bad.net/ok/"
    assert out[200].verdict == "allow" and out[203].host == ""
    empty = url_filters.judge(spark.createDataFrame([], "page_id long, url string"), [])
    assert empty.count() == 0


def test_domains_by_a_suffix_table(spark):
    hosts = ["www.a.co.za", "a.co.za", "co.za", "x.y.city.kawasaki.jp", "a.b.com:8080", "1.2.3.4", "1.2.3.4:80", "[::1]:443", "local", "", "a.co.uk"]
    table = spark.createDataFrame([("za",), ("co.za",), ("CITY.kawasaki.jp",), ("jp",), ("com",)], "suffix string")
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.domain, r.suffix) for r in url_filters.with_domains(rows, table).collect()}
    assert [got[h] for h in hosts[:5]] == [("a.co.za", "co.za"), ("a.co.za", "co.za"), ("co.za", "co.za"), ("y.city.kawasaki.jp", "city.kawasaki.jp"), ("b.com", "com")]
    assert [got[h] for h in hosts[5:8]] == [("1.2.3.4", "(address)"), ("1.2.3.4", "(address)"), ("[::1]", "(address)")]
    assert [got[h] for h in hosts[8:]] == [("local", "local"), ("", ""), ("a.co.uk", "co.uk")]


def test_labelled_outcomes_reach_unseen_hosts(spark):
    """Hosts of a domain with many bad pages are blocked without a page of their own, and others are not."""
    pages = spark.createDataFrame([(1, "http://new.spam.com/x"), (2, "http://fine.org/"), (3, "http://unseen.net/"), (4, "http://new.fine.org/")], "page_id long, url string")
    seen = [(f"http://h{i}.spam.com/", False) for i in range(60) for _ in range(3)] + [(f"http://s{i}.com/", True) for i in range(60) for _ in range(3)] + [(f"http://h{i}.fine.org/", True) for i in range(60)]
    out = {r.page_id: r.verdict for r in url_filters.judge(pages, [], spark.createDataFrame(seen, "url string, good boolean")).collect()}
    assert out == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


BRUTE = {r.kind: re.compile(r.pattern) for r in secrets.RULES}


def brute_spans(text):
    spans = []
    for k, r in enumerate(secrets.RULES):
        for m in BRUTE[r.kind].finditer(text):
            if len(m.group(r.group)) >= r.least:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def test_secrets_agree_with_a_scan(spark):
    rng = random.Random(5)
    parts = ["password = hunter22", "Secret:\"abc\"", "secret=token:abcdefgh", "AKIA" + "Z" * 16, "AKIAAKIA" + "9" * 14, "AKIA", "é😀 ", "0" * 24, "deadbeef" * 3, "api_KEY='x+/y=zz'", "passwd:", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, " ", "\n", "token", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(200)] + [None, "", "password=" + "q" * 200_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], DOCS)
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "t"))
    ledger.scan(docs)
    for r in ledger.report(docs, ["doc_id"]).collect():
        assert [(x["start"], x["kind"], x["end"]) for x in r.found] == brute_spans(texts[r.doc_id] or "")


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "t"))
    a = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "0" * 30)], DOCS)
    ledger.scan(a, secrets.BASE_RULES[:2])
    ledger.scan(a, secrets.BASE_RULES)
    ledger.scan(a, secrets.BASE_RULES)
    seen = [sorted(r.rules) for r in ledger.scanned().collect()]
    assert sorted(seen) == [["access@1", "assign@1"]] * 2 + [["hex@1"]] * 2
    out = {r.doc_id: len(r.found) for r in ledger.report(a, ["doc_id"], secrets.BASE_RULES).collect()}
    assert out == {1: 1, 2: 1, 3: 1}


def test_ledger_keeps_paths_of_earlier_versions(spark):
    path = scratch_path(spark, "t")
    first, second = (spark.createDataFrame(rows, DOCS) for rows in ([(1, "token=abcdef1"), (2, "clean"), (3, "token=abcdef1"), (None, None)], [(1, "clean"), (2, "clean")]))
    ledger = secrets.BlobLedger(spark, path, 4)
    for version, docs in (("v1", first), ("v2", second), ("v1", first)):
        ledger.record(docs, "doc_id", version)
        ledger.scan(docs)
    ledger.forget()
    again = secrets.BlobLedger(spark, path, 4)
    assert again.scanned().count() == 3 and again.paths().count() == 6
    assert sorted((r.path, r.version, len(r.found)) for r in again.history().collect()) == [("1", "v1", 1), ("3", "v1", 1)]
    assert "Exchange" not in again._found(secrets.RULES)._jdf.queryExecution().executedPlan().toString()
    assert all(not r.found for r in again.report(second, ["doc_id"]).collect())



def lines_of(text):
    return [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]


def deleted_by_brute_force(docs, least=50):
    """doc -> numbers of deleted lines, blank ones aside, and all windows with their lines' numbers: every window against every earlier one."""
    windows, firsts = [], {}
    texts = {d: [(i, x.strip()) for i, x in lines_of(t)] for d, t in docs.items()}
    for d in sorted(texts):
        rows = texts[d]
        for i in range(len(rows)):
            n, j = 0, i
            while j < len(rows) and n < least:
                n, j = n + len(rows[j][1].split()), j + 1
            if n >= least:
                key = tuple(x for _, x in rows[i:j])
                windows.append((d, i, j, key))
                firsts.setdefault(key, (d, i, j))
    gone, kept = set(), set()
    for d, i, j, key in windows:
        o, oi, oj = firsts[key]
        if (o, oi) == (d, i):
            continue
        # as far as both go on alike, while the lines behind the first one stay below the least number of words
        while j < len(texts[d]) and oj < len(texts[o]) and texts[d][j][1] == texts[o][oj][1] and sum(len(x.split()) for _, x in texts[d][i + 1 : j + 1]) < least:
            j, oj = j + 1, oj + 1
        gone |= {(d, k) for k in range(i, j)}
        kept |= {(o, k) for k in range(oi, oj)}
    out = {d: {texts[d][k][0] for e, k in gone - kept if e == d} for d in texts}
    return out, windows, texts


def check_line_dedup(spark, docs, extra=()):
    rows = spark.createDataFrame([*[(d, t, 1) for d, t in docs.items()], *extra], DOCS + ", removed int")
    out = {r.doc_id: r for r in line_dedup.clean(rows).collect()}
    want, windows, texts = deleted_by_brute_force(docs)
    for d, t in docs.items():
        lines = t.split("\n")
        gone = {i for r in out[d].removed for i in range(r["first"], r["last"] + 1)}
        assert {i for i in gone if lines[i].strip()} == want[d], d
        assert out[d].text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    # each repeated window stays whole where it comes first
    times, seen = collections.Counter(w[3] for w in windows), set()
    for d, i, j, key in windows:
        assert times[key] == 1 or key in seen or not want[d] & {texts[d][k][0] for k in range(i, j)}
        seen.add(key)
    return out


def test_line_dedup_finds_every_repeated_window(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    shared = [line(20) for _ in range(4)]
    common = line(8)
    docs = {}
    for d in range(30):
        own = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))] + [common]
        at = rng.randint(0, len(own))
        docs[d] = "\n".join(own[:at] + (shared if d % 3 == 0 else []) + own[at:])
    docs[50] = docs[3]
    docs[51] = "\n".join([line(60)] * 3)
    docs[52], docs[53] = "", "   \n\n"
    out = check_line_dedup(spark, docs, [(99, None, 1)])
    assert out[99].text is None and not any(out[0].removed) and out[50].text.strip() == ""
    assert out[51].text == docs[51].split("\n")[0]
    assert line_dedup.clean(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_keeps_the_first_of_runs_that_overlap_or_chain(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    ten = [line(10) for _ in range(6)]
    same = line(10)
    docs = {1: "\n".join([same] * 60), 2: "\n".join(ten[:5]), 3: "\n".join(ten), 4: "\n".join(ten[1:])}
    out = check_line_dedup(spark, docs)
    assert out[1].text == "\n".join([same] * 5) and out[2].text == docs[2] and out[3].text == docs[4] and out[4].text == ""
    few = [rng.choice([line(n), line(n)]) for n in (1, 2, 3, 5, 8, 13, 21, 34, 55)]
    mixed = {10 + d: "\n".join(rng.choice([*few, "", " \t"]) for _ in range(rng.randint(1, 60))) for d in range(40)}
    check_line_dedup(spark, mixed)
    letters = {d: "\n".join(rng.choice(["a b c d e", "f g h i j", "k l m n o p q r s t"]) for _ in range(rng.randint(8, 30))) for d in range(25)}
    check_line_dedup(spark, letters)


def test_line_dedup_takes_very_long_texts(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    out = {r.doc_id: r for r in line_dedup.clean(spark.createDataFrame([(1, long), (2, "x\n" + long + "\ny")], DOCS)).collect()}
    assert out[1].text == long and out[2].text == "x\ny" and [tuple(r) for r in out[2].removed] == [(1, 20_000)]


def test_line_dedup_finds_passages_with_frequent_lines(spark):
    """Each passage is one window, whose least line may be the frequent one, which is first met among other lines."""
    rng = random.Random(17)
    line = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    frequent = spark.range(1000).select(F.concat(F.lit("read more "), "id").alias("x")).orderBy(F.xxhash64("x")).first().x
    passages = [[line(20), frequent, line(27)] for _ in range(12)]
    docs = {0: "\n".join([line(60), frequent, line(60)])}
    for k, p in enumerate(passages):
        docs[10 + k] = "\n".join([line(30), *p, line(30)])
        docs[40 + k] = "\n".join([line(30), "", *p, line(30), *p])
    out = {r.doc_id: [tuple(x) for x in r.removed] for r in line_dedup.clean(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert out == {d: [(2, 4), (6, 8)] if d >= 40 else [] for d in docs}


def test_line_dedup_deletes_runs_to_their_last_line(spark):
    rng = random.Random(18)
    line = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    run = [line(40), line(40), line(5), line(3)]
    rows = [(1, "\n".join([line(9), *run, line(9)])), (2, "\n".join([line(9), *run])), (2, "\n".join([line(9), *run])), (3, "\n".join(run[1:] + [line(9)]))]
    out = sorted((r.doc_id, [tuple(x) for x in r.removed]) for r in line_dedup.clean(spark.createDataFrame(rows[:2] + [rows[1], rows[3]], DOCS)).collect())
    assert out == [(1, []), (2, [(1, 4)]), (2, [(1, 4)]), (3, [])]


def test_sha_of_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c4")
