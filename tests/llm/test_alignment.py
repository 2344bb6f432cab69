"""Cross-tokenizer alignment against brute force over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from varloom.llm import alignment

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def brute(texts, both):
    """The operator's columns by its contract, from whole texts and quadratic overlaps."""
    a, b = both
    back = byte_of()
    rows, held = [], collections.Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": None}
        if text:
            data = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            of_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
            of_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(of_a) == data == b"".join(of_b):
                spans_a, spans_b = [], []
                for tokens, spans in ((of_a, spans_a), (of_b, spans_b)):
                    at = 0
                    for t in tokens:
                        spans.append((at, at + len(t)))
                        at += len(t)
                links = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (u, v) in zip(ids_b, spans_b) if s < v and u < e]
                cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
                groups, last = [], 0
                for c in cuts:
                    groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, spans) if last < e <= c) for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))))
                    last = c
                row = {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(cuts), "links": links, "groups": ";".join(groups)}
                held.update(set(links))
        rows.append(row)
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    digest = lambda g: "" if g is None else hashlib.sha256(g.encode()).hexdigest()
    return [(r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), sum(held[x] == top[x[0]] for x in r["links"]), sum(held[x] for x in r["links"]), digest(r["groups"])) for r in rows]


def texts_of(seed, n):
    rng = random.Random(seed)
    bits = ["a", " ", "  ", "\n", " \n", "\t ", "\u00e9", "\U0001f600", "12", " don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\u3000", " \u3000", "word", " word", " the", "\x1c ", "\x00", "\u4e2d\u6587", "\u0301", "zz", ".", ", "]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return out + [None, "", " ", "   ", "\n", "x ", " x", "a\u2581b", "\u2581", "word", "word", "don't stop the word", "\u4e2d" * 300, "ab" * 2000, "the word " * 400]


@pytest.mark.parametrize("block_links,fan_in", [(2_000_000, 64), (150, 2)])
def test_alignment_against_brute_force(spark, tokenizers_, block_links, fan_in):
    texts = texts_of(3, 150)
    docs = spark.createDataFrame([(None if i == 7 else i // 2, t) for i, t in enumerate(texts)], DOCS).withColumnRenamed("text", "text")
    got = sorted((r.doc_id is not None, r.doc_id or 0, *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]) for r in alignment.align(docs.repartition(5), block_links, fan_in).collect())
    want = sorted((i != 7, 0 if i == 7 else i // 2, *row) for i, row in enumerate(brute(texts, tokenizers_)))
    assert got == want


def test_words_give_the_ids_of_whole_texts(tokenizers_, monkeypatch):
    a, b = tokenizers_
    both = alignment.Aligner()
    assert both.by_words
    texts = [t for t in texts_of(11, 600) if t]
    for size in (700, 5, 1):
        monkeypatch.setattr(alignment, "WORDS", 40 * size)
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            found, doc, pairs = both.align(part)
            for k, (t, f) in enumerate(zip(part, found)):
                if f is None:
                    assert "\u2581" in t and not (doc == k).any()
                    continue
                ids = [[int(i) for g in f[3].split(";") for i in g.split("|")[side].split(",")] for side in range(2)]
                assert ids == [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)]
                assert f[:2] == (len(ids[0]), len(ids[1])) and (doc == k).sum() == f[0] + f[1] - f[2]


def test_a_long_text_and_an_empty_table(spark, tokenizers_):
    text = "x" + " " * 1_000_000 + "y the " + "word " * 100_000
    row = alignment.align(spark.createDataFrame([(1, text)], DOCS)).first()
    assert row.n_b == len(tokenizers_[1].encode(text)) and row.n_links == row.n_a + row.n_b - row.n_groups
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], DOCS)).count() == 2


def test_merging_runs():
    rng = np.random.default_rng(4)
    runs = [np.unique(rng.integers(0, 40, 60) << alignment.B_BITS | rng.integers(0, 9, 60), return_counts=True) for _ in range(7)]
    want = collections.Counter()
    for pairs, counts in runs:
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
    out = list(alignment.merged([*runs, (np.array([], np.int64), np.array([], np.int64))]))
    got = {p: n for pairs, counts in out for p, n in zip(pairs.tolist(), counts.tolist())}
    assert got == want
    ids = [int(pairs[0] >> alignment.B_BITS) for pairs, _ in out]
    assert ids == sorted(set(ids))
