"""The corpus pipeline: each stage against brute force on its own input, and odd rows through all of them."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from varloom.llm import common, near_dedup
from varloom.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, root string, n long, _source string, removed string"


@pytest.fixture(scope="module")
def case(spark):
    """(folder, input rows, what each stage returns): the smallest documents, with copies, near copies, nulls and clashing names."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars, "r", 7, "s", "x") for d in docs]
    good = next(d.text for d in docs if d.text and 1000 < len(d.text) < 3000)
    words = good.split()
    for k in range(12):
        edited = list(words)
        edited[rng.randrange(len(edited))] = f"edit{k}"
        rows.append((10_000 + k, " ".join(edited), "en", "src0", 1, None, None, None, None))
    rows += [(None, good, None, None, None, None, None, None, None), (20_000, None, "en", None, None, None, None, None, None), (20_001, "", "en", "src1", 0, None, None, None, None), (20_002, good * 60, "en", "src0", 9, None, None, None, None)]
    rows += [(20_003, good, "en", "src0", 9, None, None, None, None)] * 3
    path = scratch_path(spark, "case")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    frame, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.common.materialize(stage(spark, frame, path), f"t-{name}")
        out.append((name, frame.columns, frame.collect()))
    return path, rows, out


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_stages_keep_the_columns_of_documents(case):
    _, _, out = case
    assert [n for n, _, _ in out] == ["quality", "exact", "near", "mixing", "packing"]
    assert all(columns == [c.split()[0] for c in COLUMNS.split(", ")] for _, columns, _ in out[:4])


def test_the_classifier_keeps_rows_whole(case):
    _, rows, out = case
    kept = bag(out[0][2])
    assert not kept - bag(rows) and 0.5 * len(rows) < sum(kept.values()) < len(rows)


def test_one_row_of_equal_texts_stays(case):
    _, _, out = case
    before, after = out[0][2], out[1][2]
    last = {}
    for r in before:
        t = r.text or ""
        last[t] = max(last.get(t, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(((r.text or ""), -1 if r.doc_id is None else r.doc_id) for r in after) == sorted(last.items())


def test_one_row_of_near_copies_stays(case):
    _, _, out = case
    before, after = out[1][2], out[2][2]
    found = [near_dedup.shingles(r.text or "") for r in before]
    n = len(before)
    texts = sorted({r.text or "" for r in before})
    bands = [list(enumerate(b)) if b is not None else [] for b in near_dedup.family_bands(texts)]
    sizes = collections.Counter(b for own in bands for b in own)
    df, total = np.zeros(near_dedup.IDF_BUCKETS), near_dedup.PRIOR
    for text, own in zip(texts, bands, strict=True):
        family = max([sizes[b] for b in own], default=1)
        np.add.at(df, near_dedup.idf_bucket(near_dedup.shingles(text)[0]), 1 / family)
        total += 1 / family
    share = np.clip((df - df.mean()) / total, near_dedup.RARE, 1)
    idf = np.rint(near_dedup.SCALE * np.maximum(near_dedup.IDF_FLOOR, np.log(1 / share) / np.log(1 / near_dedup.RARE))).astype(np.int64)
    alike = near_dedup.all_similar(found, found, idf)
    alike &= np.array([len(b[0]) > 0 for b in found])[:, None]
    root = np.arange(n)
    while True:
        low = np.where(alike, root[None, :], root[:, None]).min(1)
        if (low == root).all():
            break
        root = low
    classes = collections.defaultdict(list)
    for r, k in zip(before, root.tolist(), strict=True):
        classes[k].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(x for x in ids if x is not None) for ids in classes.values())
    assert len(after) < len(before) - 5


def test_the_mix_is_near_its_targets(case):
    _, _, out = case
    before, after = out[2][2], out[3][2]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    largest = max(size(r) for r in before)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in order)
    times, had = bag(after), bag(before)
    assert set(times) <= set(had) and all(n <= 2 * had[r] for r, n in times.items())


def test_packing_holds_every_token_of_the_mix(case):
    _, _, out = case
    before, after = out[3][2], out[4][2]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in before:
        want[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in after:
        got[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_reruns_agree(spark, case):
    path, _, out = case
    again = spark.read.parquet(f"{path}/documents.parquet").repartition(5)
    for (name, stage), (_, _, rows) in zip(corpus_pipeline.STAGES[:4], out, strict=False):
        again = corpus_pipeline.common.materialize(stage(spark, again, path), f"again-{name}")
        key = lambda r: (str(r.doc_id), hashlib.sha1((r.text or "").encode()).hexdigest())
        assert collections.Counter(map(key, again.collect())) == collections.Counter(map(key, rows)), name


def test_only_the_result_is_left_in_the_shared_folder(spark, case):
    root = "/" + common.scratch_root(spark).removeprefix("file:").lstrip("/")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, case[0])
    left = set(os.listdir(root)) - before
    assert out.count() > 0
    assert [x.rsplit("-", 1)[0] for x in left] == ["varloom-stage-packing"]


def test_an_empty_table_ends_empty(spark, case):
    path, _, _ = case
    empty = scratch_path(spark, "empty")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
