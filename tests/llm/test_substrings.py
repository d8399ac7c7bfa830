"""Removal of repeated strings against brute force."""

import collections
import random

import pytest

from annalist.llm import substrings


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans = []
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        ends = [0, *(x for s in spans for x in s), len(b)]
        out.append((len(b), spans, b"".join(b[x:y] for x, y in zip(ends[::2], ends[1::2]))))
    return out


def corpus(seed, rows=160):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(40)
    texts = [None, "", "x", "a" * 900, "a" * 399, "ab" * 300, "ab" * 299, passage[:100], passage]
    for k in range(rows):
        t = prose(rnd.randrange(0, 120))
        if k % 3 == 0:
            cut = rnd.randrange(0, 40)
            t = prose(rnd.randrange(0, 20)) + passage[cut:cut + rnd.randrange(50, 300)] + t
        if k % 7 == 0:
            t = t + other + prose(5) + other
        texts.append(t)
    return texts + texts[20:24] + [prose(3000)]


@pytest.mark.parametrize("length, seed, bucket, most", [(100, 1, 4_000_000, 10_000), (128, 2, 1000, 3), (400, 3, 2000, 1)])
def test_equals_brute_force(spark, length, seed, bucket, most):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], [list(s) for s in r["spans"]], bytes(r["kept"])) for r in substrings.dedup(df, length, bucket, most).collect()}
    want = brute(texts, length)
    wrong = [i for i in got if got[i] != want[i]]
    assert len(got) == len(texts) and not wrong


def test_long_rows_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    data = " ".join(str(i * 7919 % 1000) for i in range(2000)).encode()
    import numpy as np
    row, first, last, anchor = substrings.stretches(np.frombuffer(data, np.uint8), np.array([0, 4000, len(data)]), 100)
    starts = sorted((r, s) for r, a, b in zip(row, first, last) for s in range(a, b + 1))
    assert starts == [(0, s) for s in range(0, 3901)] + [(1, s) for s in range(4000, len(data) - 99)]
    assert ((first <= anchor) & (anchor <= last + 100 - 32)).all()


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(empty).count() == 0
    same = "word " * 100
    rows = substrings.dedup(spark.createDataFrame([(None, same + "1"), (None, same + "2"), (3, "short")], "doc_id long, text string"), 100).collect()
    assert sorted((r["doc_id"] is None, r["kept"]) for r in rows) == [(False, bytearray(b"short")), (True, bytearray(b"1")), (True, bytearray(b"2"))]
