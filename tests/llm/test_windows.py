"""Removal of repeated word windows against brute force."""

import random
import re

import numpy as np
import pytest

from annalist.llm import windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(rows, width):
    """(id, text) rows -> sorted (id, n_words, n_removed, kept), by the earliest (id, start) of each window."""
    key = lambda doc, start: ((doc is not None, doc if doc is not None else 0), start)
    split = [(doc, WORDS(text or "")) for doc, text in rows]
    least = {}
    for doc, words in split:
        for k in range(len(words) - width + 1):
            w = tuple(words[k:k + width])
            least[w] = min(least.get(w, key(doc, k)), key(doc, k))
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if key(doc, k) > least[tuple(words[k:k + width])]:
                gone[k:k + width] = [True] * width
        spans, k = [], 0
        while k < len(gone):
            if gone[k]:
                lo = k
                while k < len(gone) and gone[k]:
                    k += 1
                spans.append((lo, k))
            k += 1
        out.append((doc, len(words), sum(gone), spans, " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé漢-") for _ in range(rnd.randrange(1, 5)))
    prose = lambda k: (rnd.choice([" ", "\n", " \t ", "\x0b"])).join(word() for _ in range(k))
    shared, other = prose(40), prose(9)
    texts = [None, "", " \n ", "one", "a " * 60, "b\n" * 7, shared, shared + " ", "x y z " * 9]
    for k in range(n):
        t = prose(rnd.randrange(0, 50))
        if k % 3 == 0:
            t = prose(rnd.randrange(0, 9)) + " " + " ".join(WORDS(shared)[rnd.randrange(20):]) + " " + t
        if k % 7 == 0:
            t += " " + other + "\n" + prose(2) + " " + other
        texts.append(t)
    return texts + texts[20:26] + [prose(900) + " " + shared]


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], [(s["lo"], s["hi"]) for s in r["spans"]], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, width, block, extra", [(1, 5, 8_000_000, None), (2, 8, 600, 1), (3, 20, 150, 8), (4, 2, 3000, 2)])
@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_equals_brute_force(spark, seed, width, block, extra, order):
    rows = list(enumerate(corpus(seed)))
    if order == "shuffled":
        random.Random(seed).shuffle(rows)
        rows += [(None, rows[5][1]), (None, rows[30][1]), (7, rows[40][1]), (7, rows[41][1]), rows[50], rows[50]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, BLOCK int").coalesce(3)
    assert collected(windows.dedup(df, width, block, extra=extra)) == brute(rows, width)


def test_one_id_holds_most_rows_and_ids_are_strings(spark):
    texts = corpus(9)
    rows = [("hot" if k % 2 else f"d{k}", t) for k, t in enumerate(texts)] + [(None, t) for t in texts[:40]]
    key = {None: (False, "")} | {f"d{k}": (True, f"d{k}") for k in range(len(texts))} | {"hot": (True, "hot")}
    numbers = {name: k for k, name in enumerate(sorted(key, key=key.get))}
    want = brute([(numbers[i], t) for i, t in rows], 6)
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = collected(windows.dedup(df, 6, 500))
    assert sorted(((numbers[r[0]], *r[1:]) for r in got), key=str) == want


def test_rows_in_order_are_not_dealt_again(spark, tmp_path, monkeypatch):
    rows = list(enumerate(corpus(5)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "t"))
    calls = []
    whole = windows._blocks
    monkeypatch.setattr(windows, "_blocks", lambda *a: calls.append(1) or whole(*a))
    assert collected(windows.dedup(spark.read.parquet(str(tmp_path / "t")), 5, 900)) == brute(rows, 5)
    assert len(calls) == 1


def test_large_buckets_are_sorted_in_ranges(spark, monkeypatch):
    rows = list(enumerate(corpus(6)))
    monkeypatch.setattr(windows, "TOGETHER", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(windows.dedup(df, 4, 700)) == brute(rows, 4)


def test_empty_table(spark):
    assert windows.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes():
    data = b"ab cd\xc3\xa9 " + b"z" * 3_000_000 + b" ab"
    start, stop, row = windows.word_bounds(np.frombuffer(data, np.uint8), np.array([0, 2, len(data)]))
    h = windows.word_hashes(np.frombuffer(data, np.uint8), start, stop)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3 and row.tolist() == [0, 1, 1, 1]
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 50, dtype=np.uint64)
    for width in (2, 5, 20):
        want = [sum(int(x) * windows.WORD_BASE ** (width - 1 - j) for j, x in enumerate(h[k:k + width])) % (1 << 64) for k in range(51 - width)]
        assert windows.rolled(h, width, windows.WORD_BASE).tolist() == want
    first = np.sort(rnd.integers(0, 1 << 64, 300, dtype=np.uint64, endpoint=False))
    second = rnd.integers(0, 1 << 24, 300, dtype=np.uint64)
    a, b = windows.unpacked(windows.packed(first, second, 3))
    assert (a == first).all() and (b == second).all()
    a, b = windows.unpacked(windows.packed(first[:1], second[:1], 3))
    assert a[0] == first[0] and b[0] == second[0]


def test_equal_first_hashes_are_told_apart():
    first = np.array([5, 5, 5, 9, 5], np.uint64)
    second = np.array([1, 2, 1, 7, 2], np.uint64)
    order, head, group, least, begin, beyond = windows.later(first, second, np.array([0, 0, 1, 1, 2]), np.array([3, 4, 0, 1, 0]))
    found = np.empty(5, bool)
    found[order] = beyond
    assert found.tolist() == [False, False, True, False, True] and len(head) == 3
