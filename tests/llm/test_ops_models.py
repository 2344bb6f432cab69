"""Near-dedup, quality, packing, WARC and Ogg on small cases, against brute force and round trips."""

import collections
import gzip
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import near_dedup, ogg_media, packing, quality, zip_warc
from varloom.llm.common import scratch_path

DOCS = "doc_id long, text string"


def words(rng, n):
    return [rng.choice("bcdfgh") + rng.choice("aeiou") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = "edit" + str(rng.randint(0, 10**6))
    return out


def frequencies(docs):
    text = F.coalesce("text", F.lit(""))
    return near_dedup.inverse_frequencies(docs.select(F.sha2(text, 256).cast("binary").alias("node"), text.alias("text")).distinct())


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(60, 300))
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(0, 4))) for _ in range(rng.randint(0, 6))]
    big = words(rng, 200)
    texts += [" ".join(edited(rng, big, rng.randint(1, 5))) for _ in range(60)]
    texts += [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)] + ["", "", "a", "a b", "A  b"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (None, texts[0])]
    docs = spark.createDataFrame(rows, DOCS)
    return rows, docs, near_dedup.classes(docs).collect(), frequencies(docs)


def test_near_classes_are_the_components_of_similar_pairs(near):
    rows, _, out, idf = near
    vectors = [near_dedup.shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(vectors[i][0]) and len(vectors[j][0]) and near_dedup.weighted_jaccard(vectors[i], vectors[j], idf) >= 0.8):
                parent[find(i)] = find(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    want = {}
    for ids in members.values():
        for d in ids:
            want[d] = (min(x for x in ids if x is not None), len(ids))
    assert {r.doc_id: (r.class_id, r.class_size) for r in out} == want


def test_near_partners_are_similar_texts_of_the_class(near):
    rows, _, out, idf = near
    of = {d: t or "" for d, t in rows}
    classes, texts = {r.doc_id: r.class_id for r in out}, {}
    for r in out:
        texts.setdefault(r.class_id, set()).add(of[r.doc_id])
    assert any(r.partner_id is not None for r in out)
    for r in out:
        assert (r.partner_id is None) == (len(texts[r.class_id]) == 1) == (r.similarity is None)
        if r.partner_id is not None:
            assert of[r.partner_id] != of[r.doc_id] and classes[r.partner_id] == r.class_id
            assert r.similarity >= 0.8 and r.similarity == near_dedup.weighted_jaccard(near_dedup.shingles(of[r.doc_id]), near_dedup.shingles(of[r.partner_id]), idf)


def test_near_family_counts_once_and_a_passage_by_its_texts(spark):
    """What is in 1,200 near copies of one text weighs as much as what is in one text; what 1,200 other texts share weighs less."""
    rng = random.Random(41)
    base, passage = words(rng, 150), words(rng, 30)
    family = [" ".join(edited(rng, base, rng.randint(1, 4))) for _ in range(1200)]
    others = [" ".join(words(rng, 120) + passage) for _ in range(1200)]
    idf = frequencies(spark.createDataFrame(list(enumerate(family + others)), DOCS))

    def of(part):
        return idf[near_dedup.idf_bucket(near_dedup.shingles(" ".join(part))[0])] / near_dedup.SCALE

    want = math.log((len(others) + near_dedup.PRIOR) / len(others)) / math.log(1 / near_dedup.RARE)
    assert (of(base) > 0.95).all()
    assert (abs(of(passage) - want) < 0.1).all()


def test_near_frequent_passages_count_less(spark):
    """All texts have the same 120 words and 80 of their own: edits of these count for more than by plain counts, and copies with an edit or two stay copies."""
    rng = random.Random(43)
    passage, own = words(rng, 120), [words(rng, 80) for _ in range(2000)]
    copies = [[w if k % (80 // n) or k == 0 else f"edit{k}" for k, w in enumerate(own[i])] for i, n in enumerate((1, 2, 4, 4))]
    copies[0][40] = "edit"
    texts = [" ".join(passage + x) for x in own + copies]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    plain, idf = np.full(near_dedup.IDF_BUCKETS, near_dedup.SCALE), frequencies(docs)
    of = lambda i, weight: near_dedup.weighted_jaccard(near_dedup.shingles(texts[i]), near_dedup.shingles(texts[2000 + i]), weight)
    assert all(of(i, plain) >= 0.8 for i in range(4))
    assert [of(i, idf) >= 0.8 for i in range(4)] == [True, True, False, False]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [got[2000 + i] == i for i in range(4)] == [True, True, False, False]
    assert all(got[i] == i for i in range(2000))


def test_near_samples_agree_by_similarity():
    rng = random.Random(4)
    base = words(rng, 3000)
    idf = np.full(near_dedup.IDF_BUCKETS, near_dedup.SCALE)
    idf[::3] = 240
    sampler = near_dedup.Sampler(idf)
    rates, true = [], []
    for n in (20, 60, 120):
        a, b = near_dedup.shingles(" ".join(base)), near_dedup.shingles(" ".join(edited(rng, base, n)))
        key, weight = np.concatenate([a[0], b[0]]), np.concatenate([near_dedup.weights(x, idf) for x in (a, b)])
        s = sampler.signatures(key, weight, np.array([0, len(a[0])]))
        rates.append((s[0] == s[1]).mean())
        true.append(near_dedup.weighted_jaccard(a, b, idf))
    assert np.abs(np.array(rates) - np.array(true)).max() < 0.2


def test_near_samples_are_unbiased():
    rng = random.Random(14)
    idf = np.full(near_dedup.IDF_BUCKETS, near_dedup.SCALE)
    rates, true = [], []
    for n in range(150):
        base = words(rng, 150)
        pair = [near_dedup.shingles(" ".join(t)) for t in (base + base[:20], edited(rng, base, n % 8))]
        s = near_dedup.Sampler(idf).signatures(np.concatenate([x[0] for x in pair]), np.concatenate([near_dedup.weights(x, idf) for x in pair]), np.array([0, len(pair[0][0])]))
        rates.append((s[0] == s[1]).mean())
        true.append(near_dedup.weighted_jaccard(*pair, idf))
    assert abs(np.mean(rates) - np.mean(true)) < 0.02
    assert np.corrcoef(rates, true)[0, 1] > 0.8


def test_near_shingles_are_those_of_the_words():
    rng = random.Random(15)
    texts = ["", " ", "a", "A  b\tc", "x" * 5000, "one two three four five", "\x0bé Éa", *[" ".join(rng.choice(["ab", "abcdefgh", "abcdefghi", "Ä" * 9, "q"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    kept = {}
    for text, bag in zip(texts, near_dedup.bags(texts), strict=True):
        w = re.split("[\t-\r ]+", text.lower().strip("\t\n\x0b\x0c\r "))
        w = [] if w == [""] else w
        runs = [" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
        assert sorted(bag[1].tolist()) == sorted(collections.Counter(runs).values())
        alone = near_dedup.shingles(text)
        assert bag[0].tolist() == alone[0].tolist()
        for r in set(runs):
            if len(set(runs)) == 1:
                assert kept.setdefault(r, int(bag[0][0])) == int(bag[0][0])
    assert len(set(kept.values())) == len(kept)


def test_near_products_are_the_similarities_of_pairs():
    rng, own = random.Random(16), np.random.default_rng(16)
    idf = own.integers(230, 257, near_dedup.IDF_BUCKETS)
    base = words(rng, 120)
    found = [near_dedup.shingles(" ".join(edited(rng, base, rng.randint(0, 8)) * rng.randint(1, 2))) for _ in range(60)]
    one, other = found[:35], found[20:]
    alike = near_dedup.all_similar(one, other, idf)
    assert alike.tolist() == [[bool(near_dedup.similar(*near_dedup._minima(a, b, idf))) for b in other] for a in one]
    assert 0 < alike.sum() < alike.size
    joined = near_dedup.joining(np.array([[1, 0, 0], [0, 1, 0], [0, 1, 1]], bool), np.array([0, 1, 2]), np.array([3, 1, 4]))
    assert sorted(joined) == [(0, 3), (1, 2), (2, 4)]
    for pair, place in (((0, 3), (0, 0)), ((1, 2), (2, 1)), ((2, 4), (2, 2))):
        assert near_dedup.joined_by(np.array([[1, 0, 0], [0, 1, 0], [0, 1, 1]], bool), np.array([0, 1, 2]), np.array([3, 1, 4]), pair) == place


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 40_000])
def test_near_classes_of_a_crowded_family_near_the_limit(spark, monkeypatch, block):
    """A family whose texts stand just above and below the limit: classes are those of all pairs by brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(31)
    base = words(rng, 150)
    texts = list({" ".join(edited(rng, base, rng.randint(2, 6))) for _ in range(300)})
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    idf = frequencies(docs)
    found = [near_dedup.shingles(t) for t in texts]
    alike = near_dedup.all_similar(found, found, idf)
    root = np.arange(len(texts))
    while True:
        low = np.where(alike, root[None, :], len(texts)).min(1)
        if (low == root).all():
            break
        root = low
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert len(set(got.values())) > 5
    assert sum(got[i] == r for i, r in enumerate(root.tolist())) >= 0.99 * len(texts)
    assert all(root[i] == root[c] for i, c in got.items())


def test_near_keeps_one_of_each_class(spark, near):
    rows, docs, out, _ = near
    kept = near_dedup.keep_one(docs.withColumn("root", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in out})
    again = docs.union(docs.filter("doc_id = 5"))
    assert near_dedup.keep_one(again).count() == len({r.class_id for r in out})
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_near_link_of_two_large_families_is_found(spark):
    """One pair links two families; hundreds of pairs just below the limit agree in more samples."""
    rng = random.Random(21)
    base = words(rng, 300)

    def put(at):
        return " ".join(f"new{at[i]}x{i}" if i in at else w for i, w in enumerate(base))

    apart = {30 + 50 * i: -1 for i in range(5)}
    edits = [(i, k) for k in range(9) for i in range(2, 298) if all(abs(i - a) > 4 for a in [*apart, 148])]
    rng.shuffle(edits)
    one = [{i: k} for i, k in edits if i < 148][:800] + [{148: 0}]
    two = [apart | {148: 0}] + [apart | {i: k} for i, k in edits if i > 148][:40]
    texts = [put(x) for x in one + two]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    idf = frequencies(docs)
    alike = lambda a, b: near_dedup.weighted_jaccard(near_dedup.shingles(texts[a]), near_dedup.shingles(texts[b]), idf) >= 0.8
    assert [(a, b) for a in range(770, 801) for b in range(801, 842) if alike(a, b)] == [(800, 801)]
    assert {(r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()} == {(0, len(texts))}


def test_components_against_union_find(spark):
    rng = random.Random(9)
    pairs = [(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] if a != b]
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def corpus(rng, n, junk):
    out = []
    for i in range(n):
        w = words(rng, rng.randint(20, 60))
        out.append(" ".join(x + "###" if junk and rng.random() < 0.5 else x for x in w))
    return out


def test_quality_learns_from_labels_that_are_not_held_out(spark):
    rng = random.Random(11)
    texts = corpus(rng, 300, False) + corpus(rng, 100, True)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, "x " * 50_000)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(5, None), (9999, 1), (None, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    out = quality.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    right = [r.predicted == int(r.doc_id < 300) for r in held if r.doc_id < 400]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.score(docs, flipped).collect(), key=str) == sorted(out, key=str)
    good = quality.keep_good(docs.withColumn("score", F.lit(1)), quality.fit(docs, labels))
    assert good.columns == ["doc_id", "text", "score"]
    assert all(r.score == 0.5 for r in quality.score(docs, labels.filter("quality = 1")).collect())
    assert quality.score(docs.limit(0), labels).count() == 0


def test_quality_on_given_labels_that_are_held_out(spark):
    """At least nine of ten of the given labels that training never saw are met, and good pages rank above bad ones."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = read("labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    rows = quality.score(read("documents").select("doc_id", "text"), read("labels")).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) >= 20 and len(bad) >= 5
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    assert np.mean([g > b for g in good for b in bad]) >= 0.9


def test_quality_scores_do_not_depend_on_company():
    rng = random.Random(12)
    texts = corpus(rng, 40, False) + ["", "a", "é" * 30]
    model = quality.Model(np.arange(quality.BUCKETS, dtype=np.int32) % 977 - 488, 7)
    alone = [model.scores([t])[0] for t in texts]
    assert list(model.scores(texts)) == alone
    for t, s in zip(texts, alone):
        f = quality.text_features(t)
        z = (int(model.margin[f].sum()) / max(len(f), 1) + model.bias) / (1 << quality.SCALE)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_packing_cuts_and_packs_every_token_once(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 50, 400, 3000])))) for i in range(60)] + [(7, "again"), (7, "again"), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = packing.pack(docs, group_tokens=20_000).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    ids = {}
    for d, t in rows:
        ids.setdefault((d, len(packing.token_ids(t or ""))), []).append(packing.token_ids(t or ""))
    assert set(ids) == set(by_doc)
    for key, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == key[1] * len(ids[key])
        for p in pieces:
            assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[key])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 57, 300):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for k in np.argsort(-sizes, kind="stable"):
            b = next((i for i, r in enumerate(room) if r >= sizes[k]), len(room))
            if b == len(room):
                room.append(100)
            want[k] = (b, 100 - room[b])
            room[b] -= sizes[k]
        assert {k: (bins[k], offsets[k]) for k in range(n)} == want


def test_ids_are_those_of_the_public_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    bits = ["a", " ", "\n", "é", "😀", "12", "don't", "<|endoftext|>", "<|endof", "text|>", "\u3000"]
    texts = ["", " a  b\n\n\tc", "Ünïcödé 😀 don't we'll 123456", "<|endoftext|>", "a <|endoftext|> b", "x" * 5000, "\u3000 　\r\n", "ab" * 3000 + " ."]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for s in texts:
        assert list(packing.token_ids(s)) == [*t.encode(s, add_special_tokens=False).ids, 1]
    t.encode_special_tokens = True
    for s in texts:
        assert list(packing.token_ids(s, special_as_text=True)) == [*t.encode(s, add_special_tokens=False).ids, 1]


def test_ids_of_long_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_000_000
    runs = [" " * n, "\n" * n, "\t" * n, " \n" * (n // 2), "\u00a0" * n, "\u3000 " * (n // 2), "\n" * n + " "]
    texts = [f"a{x}b" for x in runs] + [runs[0], "a" + runs[3], runs[1] + "<|endoftext|>" + runs[0] + "!", "x" + " " * 9_999 + "y" + " " * 10_000 + "z" + " " * 10_001 + "\n"]
    for s in texts:
        assert list(packing.token_ids(s)) == [*t.encode(s, add_special_tokens=False).ids, 1]


def test_packing_takes_long_runs_of_white_space(spark):
    out = packing.pack(spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "c")], DOCS)).collect()
    for doc in (1, 2):
        own = [r for r in out if r.doc_id == doc]
        assert own and sum(r.length for r in own) == own[0].doc_tokens


def test_warc_round_trip(spark):
    html = lambda k, n: "<p>" + k * n + "é"
    rows = [(1, "http://a/", html("x", 2000)), (9, "http://b/", html("x", 2000)), (5, None, html("x", 2000)), (2, "u", html("y", 10)), (3, "u", html("y", 10)), (4, "w\r\nX: y", None), (None, "n", html("z", 1500)), (6, "big", html("b", 300_000))]
    path = scratch_path(spark, "t")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("package", F.lit("extra"))
    packages = zip_warc.write_packages(pages.repartition(3), path, per_package=2, max_bytes=4000)
    out = {r.page_id: r for r in zip_warc.read_packages(packages).collect()}
    assert len(out) == len(rows)
    for page, _, text in rows:
        r, raw = out[page], (text or "").encode()
        assert r.payload_bytes == len(raw)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if page in (1, 5) else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert out[4].url == "w%0D%0AX:%20y" and out[5].url == "" and out[6].url == "big"
    for p in packages.collect():
        z = zipfile.ZipFile(p.package.removeprefix("file://"))
        assert z.testzip() is None and set(z.namelist()) == {zip_warc.DATA, zip_warc.INDEX}
        heads = [line.split(b" ") for line in z.read(zip_warc.INDEX).splitlines()]
        assert len(heads) == p.records and b"".join(gzip.decompress(z.read(zip_warc.DATA)[int(a) : int(a) + int(n)]) for _, a, n in heads) == gzip.decompress(z.read(zip_warc.DATA))
    some = zip_warc.read_ranges(zip_warc.read_index(packages).filter("page_id IN (6, 1)"))
    assert {(r.page_id, r.record_type) for r in some.collect()} == {(6, "response"), (1, "revisit")}
    empty = zip_warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "t"))
    assert zip_warc.read_packages(empty).count() == 0


def test_warc_reads_ranges_only():
    data = bytearray(next(zip_warc.pack([(k, "u", bytes(20) * k, "", 1) for k in range(400)], 500, 1 << 20))[1])
    asked = []

    def read(at, n):
        asked.append((at, n))
        return bytes(data[at : at + n])

    ranges = list(zip_warc.package_ranges(read, len(data)))
    assert [p for p, _, _ in ranges] == list(range(400))
    start, total = zip_warc.zip_directory(read, len(data))[zip_warc.DATA]
    assert all(at >= start + total or at + n <= start or (at, n) == asked[0] for at, n in asked)  # but for the end, nothing of the records
    at = data.index(b" 0 ", start + total)
    data[at : at + 3] = b" 9x"
    with pytest.raises(ValueError):
        list(zip_warc.package_ranges(read, len(data)))


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    members = [("a/é.txt", b"hello"), ("empty", b""), ("c", b"z" * 70_000)]
    data = zip_warc.zip_stored(members, wide)
    walk = lambda x: zip_warc.zip_directory(lambda at, n: x[at : at + n], len(x))
    found = walk(data)
    assert {n: data[s : s + k] for n, (s, k) in found.items()} == dict(members)
    assert zipfile.ZipFile(io.BytesIO(data)).read("c") == b"z" * 70_000
    with pytest.raises(ValueError):
        walk(data[:-30])
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 1000)
    with pytest.raises(ValueError):
        walk(packed.getvalue())


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_ogg_pages():
    rng = random.Random(8)
    for n in (0, 1, 255, 700):
        d = rng.randbytes(n)
        assert ogg_media.page_crc(d) == slow_crc(d)
    for n in (192, 4032, 4032 * 17, 192 * 3000):
        raw = rng.randbytes(n)
        data = ogg_media.encode(raw)
        back, ends = ogg_media.samples(data)
        assert back == raw and ends[-1] == n / ogg_media.RATE and ends == sorted(ends)
        streams = ogg_media.decode(data)
        assert set(streams) == {ogg_media.AUDIO, ogg_media.LOG}
        bad = bytearray(data)
        bad[rng.randrange(40, len(bad))] ^= 1
        with pytest.raises(ValueError):
            ogg_media.samples(bytes(bad))
        with pytest.raises((ValueError, KeyError, IndexError)):
            ogg_media.samples(data[: len(data) // 2])
    packets = [(bytes([k % 251]) * k, k) for k in (1, 254, 255, 256, 510, 70_000, 0, 3)]
    pages = b"".join(ogg_media.stream_pages(7, packets, 1))
    assert [p for p, _ in ogg_media.decode(pages)[7]] == [p for p, _ in packets]


def test_media_columns(spark):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, "é" * 100_000), (None, "x" * 192)]
    path = scratch_path(spark, "t")
    ogg_media.store(spark.createDataFrame(rows, DOCS), path)
    out = {r.doc_id: r for r in ogg_media.read_features(spark.read.parquet(path)).collect()}
    assert out[1].asDict() | {"doc_id": 0} == out[2].asDict() | {"doc_id": 0}
    assert (out[3].n_bytes, out[3].payload_bytes) == (0, 192) and (out[4].n_bytes, out[4].payload_bytes % 192) == (200_000, 0)
    assert out[None].tail_crc32 == zlib.crc32(b"x" * 16)


def test_media_features_by_a_plain_walk(spark):
    """Features, size and digest of the stored files, from a walk over their pages that shares no code with the reader."""
    rng = random.Random(19)
    rows = [(i, "".join(rng.choice("ab \n~é\x01Ø") for _ in range(n))) for i, n in enumerate([0, 1, 191, 192, 193, 4032, 4033, 70_000, 300_000])]
    path = scratch_path(spark, "t")
    ogg_media.store(spark.createDataFrame(rows, DOCS).withColumn("media", F.lit("clashes")), path)
    out = {r.doc_id: r for r in ogg_media.read_features(spark.read.parquet(path)).collect()}
    for r in spark.read.parquet(path).collect():
        data, got, raw = bytes(r.media), out[r.doc_id], rows[r.doc_id][1].encode()
        payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (got.media_bytes, got.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        times, p = set(), 0
        while p < len(data):
            laces = data[p + 27 : p + 27 + data[p + 26]]
            granule, serial, number = (int.from_bytes(data[p + a : p + b], "little", signed=a == 6) for a, b in ((6, 14), (14, 18), (18, 22)))
            if serial == 0x504D and number >= 2 and granule >= 0:
                times.add(granule)
            p += 27 + len(laces) + sum(laces)
        x = [v - 128 for v in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        assert got.feature == f"n={len(x)};mean={sum(x) * 1000 // len(x)};energy={sum(v * v for v in x) // len(x)};crossings={crossings};pages={len(times)};ms={max(times) * 1000 // 8000}"
        assert max(times) == len(payload)
