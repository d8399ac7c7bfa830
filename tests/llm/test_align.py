"""Alignment of two tokenizers against the libraries on whole texts and a plain loop."""

import collections
import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from annalist.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B)


@lru_cache
def libraries():
    lib_a = Tokenizer.from_file(A)
    lib_a.encode_special_tokens = True
    return lib_a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(pair, text):
    """Both sides' (id, bytes) of a whole text by the libraries, or None."""
    if not text:
        return None
    lib_a, lib_b = libraries()
    a = [(i, pair.a_bytes[i]) for i in lib_a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, pair.b_bytes[i]) for i in lib_b.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def cut(a, b):
    """Groups by a loop over both rows of tokens."""
    ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
    both = sorted(set(ends[0]) & set(ends[1]))
    out, at = [], [0, 0]
    for end in both:
        to = [e.index(end) + 1 for e in ends]
        out.append(([i for i, _ in a[at[0]:to[0]]], [i for i, _ in b[at[1]:to[1]]]))
        at = to
    return out


def brute(pair, docs):
    found = [(doc, whole(pair, text)) for doc, text in docs]
    found = [(doc, cut(*f) if f else []) for doc, f in found]
    held = collections.Counter(p for _, gs in found for p in {(a, b) for xs, ys in gs for a in xs for b in ys})
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc, gs in found:
        links = [(a, b) for xs, ys in gs for a in xs for b in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in gs)
        out.append((doc, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "thstinnt", "onherealyti", "é", "ciónrr", "漢字", "ありがとう", "😀😃", "don't", "we'll", "12345", "x=1;", "́", "ﬁ", "Ångström", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x0A>",
             "--------", "\x00", "\x1c", " ", " ", "{\r", "aaaa", "ha" * 9, "ΑΒΓ", "вода", "﻿", "​"]
    part = [" ", " ", " ", "\n", "  ", "   ", "\t", "\r\n", "\n\n", "\n  ", " \n", " ", "\x1c ", "", " 　 "]
    prose = lambda k: "".join(rnd.choice(words) + rnd.choice(part) for _ in range(k))
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "▁", "a▁b", "a ▁ b", "▁▁", "\n a", "a\n", "a \n b", "ends with mark▁", "=" * 400, "-=" * 301, "漢" * 50, "\t\t a"]
    return texts + [prose(rnd.randrange(0, 40)) for _ in range(n)] + [prose(700), "x" * 5000 + " y"]


def test_units_do_not_change_tokens(pair):
    for text in corpus(1, 600):
        want = whole(pair, text)
        (a, b), = align.aligned(pair, [text], 50)
        a, b = (np.frombuffer(x, "<u4") & ~align.MARK for x in (a, b))
        assert (a.tolist(), b.tolist()) == (([i for i, _ in want[0]], [i for i, _ in want[1]]) if want else ([], [])), text


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_groups_of_slices(pair, size):
    texts = corpus(2, 60)
    for text, (a, b) in zip(texts, align.aligned(pair, texts, size)):
        found = whole(pair, text)
        want = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in cut(*found)) if found else ""
        assert align.written(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")).decode() == want


def test_pointers_cross_long_chains():
    rnd = random.Random(3)
    for _ in range(50):
        n = rnd.randrange(1, 400)
        ends = [np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randrange(1, min(n, 90) + 1))})) for _ in range(2)]
        both = sorted(set(ends[0]) & set(ends[1]))
        for group, own in zip(align.groups(*ends), ends):
            assert group.tolist() == np.searchsorted(both, own).tolist()
    chain = np.arange(2, 2001, 2), np.append(np.arange(1, 2000, 2), 2000)
    assert not any(g.any() for g in align.groups(*chain))
    assert [len(g) for g in align.groups(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_links_of_large_groups_are_summed(monkeypatch):
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 9, 60).astype(np.uint32), rnd.integers(0, 9, 50).astype(np.uint32)
    for x, ends in ((a, [3, 40, 59]), (b, [0, 30, 49])):
        x[ends] |= align.MARK
    wide = align.linked(a, b)
    monkeypatch.setattr(align, "LISTED", 10)
    assert all(np.array_equal(x, y) for x, y in zip(wide, align.linked(a, b)))


@pytest.mark.parametrize("block, together", [(2_000_000, 4_000_000), (300, 50)])
def test_equals_brute_force(spark, pair, monkeypatch, block, together):
    monkeypatch.setattr(align, "TOGETHER", together)
    texts = corpus(5)
    docs = list(enumerate(texts)) + [(None, texts[40]), (None, None), (30, texts[50]), (31, texts[31]), (31, texts[31])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, a int, B string").repartition(4)
    got = align.score(align.align(df, A, B), block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(pair, docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sorted((tuple(r) for r in align.measure(df, A, B, block_tokens=block).collect()), key=str) == want


def test_empty_table_and_empty_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert align.score(align.align(df.limit(0), A, B)).count() == 0
    got = align.score(align.align(df, A, B)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, 0, 0, 0, 0, ""), ("b", 0, 0, 0, 0, 0, 0, "")]


def test_tables_are_bounded(monkeypatch):
    p = align.Pair(A, B)
    monkeypatch.setattr(align, "TABLE_BYTES", 2000)
    texts = corpus(6, 40)
    assert [align.aligned(p, [t], 60)[0] for t in texts] == align.aligned(align.Pair(A, B), texts)
    assert len(p.number) < 400
