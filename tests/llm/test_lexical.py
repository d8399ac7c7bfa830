"""Ranked lexical search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from annalist.llm import lexical

TERMS = re.compile(lexical.TERM).findall
LOWER = str.maketrans(lexical.UPPER, lexical.UPPER.lower())


def terms(text):
    return TERMS((text or "").translate(LOWER))


def brute(docs, items, top):
    split = [(doc, terms(text)) for doc, text in docs]
    split = [(doc, t) for doc, t in split if t]
    n_docs, length = len(split), sum(len(t) for _, t in split)
    df = collections.Counter(x for _, t in split for x in set(t))
    asked = collections.defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, t in split:
            tf = collections.Counter(t)
            m = 100 - 25 + (25 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in wanted if tf[x])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "THE", "é", "É", "Été", "x1", "漢字", "a", "b", "ab", "don", "t", "İ", "ß", "\x80", "7"] + [f"w{k}" for k in range(40)]
    part = [" ", "\n", "-", "'", "  ", ".", "\x00", "_", "\x7f", ", "]
    prose = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice(part) for _ in range(n))
    docs = [(k, prose(rnd.randrange(0, 60))) for k in range(150)] + [(150, None), (151, ""), (152, "--"), (None, "the w1 w2"), (None, "the w1 w2"), (3, "w5 w6")]
    docs += [(200 + k, docs[10][1]) for k in range(30)]
    docs.append((300, "w7" * 900 + " w7 " + prose(400)))
    items = [(k, prose(rnd.randrange(1, 12))) for k in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (None, "w1 w1 the"), (3, "w9 w9 É"), (15, "tHe")]
    return docs, items


@pytest.mark.parametrize("seed, top, block", [(1, 20, 200_000), (2, 3, 7), (3, 1000, 1)])
def test_equals_brute_force(spark, seed, top, block, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 300)
    docs, items = corpus(seed)
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    got = sorted((tuple(r) for r in lexical.search(df, asked, top, block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, spark.createDataFrame([(1, "..")], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_scanned_in_parts():
    rnd = random.Random(5)
    text = "".join(rnd.choice(["aa ", "b", " ", "aa-b ", "É "]) for _ in range(3000))
    texts = [t.encode() for t in (text, "", "b", text[:700])]
    vocabulary = ["aa", "b", "É", "bb", "never"]
    scan = lexical.automaton(vocabulary)
    for size in (1, 50, 1 << 20):
        total, doc, term, count = lexical.counted(scan, len(vocabulary), texts, size)
        assert total.tolist() == [len(terms(t.decode())) for t in texts]
        want = {(k, vocabulary.index(x)): n for k, t in enumerate(texts) for x, n in collections.Counter(terms(t.decode())).items() if x in vocabulary}
        assert {(d, t): n for d, t, n in zip(doc.tolist(), term.tolist(), count.tolist())} == want


def test_best_keeps_ties_by_id():
    best = lexical.Best(1, 2)
    for ids in ([9, 5], [7, None], [3, 5]):
        best.add(np.array(ids, object), np.array([[4]] * 2, np.int64))
    assert best.ids.tolist() == [3, 5] and best.score.tolist() == [4, 4]
