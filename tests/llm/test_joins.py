"""Joins of similar rows against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import embeddings, graph, jaccard


def component(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == component(nodes, [x for x in links if x[0] != x[1]])


def grams(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()


def documents(seed):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 200))] for _ in range(25)]
    texts = [None, "", "  ", "a", "a", "a b", "a b c d e", " ".join(["same"] * 400)]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            near = list(words)
            for _ in range(rnd.randrange(4)):
                near[rnd.randrange(len(near))] = f"x{rnd.randrange(100)}"
            texts.append(" ".join(near) + rnd.choice(["", " tail", "\n"]))
    hot = base[0] * 2
    for k in range(60):
        near = list(hot)
        near[k % len(near)] = f"y{k}"
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_jaccard_equals_all_pairs(spark, block):
    texts = documents(3)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(df, block_grams=block).collect()}
    sets = [grams(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = component(range(len(texts)), links)
    for i, s in enumerate(sets):
        assert got[i] == (classes[i] if s else None, sum(i in x for x in links)), (i, texts[i])


def test_bands_meet_the_recall():
    bands, rows = jaccard.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256
    with pytest.raises(ValueError):
        jaccard.bands_for(0.3, 0.999999, 4)


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(100))
    data = [(5, text), (3, text + " x"), (3, text + " x"), (9, "other words only here now"), (None, text), (8, None), (8, None), (10, "")]
    left = jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(3, text + " x"), (9, "other words only here now"), (None, text), (8, None), (10, "")]))
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    # id 7: a copy of class 1, a text of its own, and the representative of a class with id 9.
    data = [(1, a), (7, a + " x"), (7, b), (7, c), (9, c + " x"), (None, a), (None, a), (None, a + " x"), (None, "lone text"), (None, "lone text"), (None, None), (None, None)]
    left = jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    named = sorted(tuple(r) for r in left if r["doc_id"] is not None)
    assert named == [(1, a), (7, b), (7, c)]
    loose = [r["text"] for r in left if r["doc_id"] is None]
    assert len(loose) == 3 and {None, "lone text"} < set(loose) and set(loose) & {a, a + " x"}
    copies = [(None, a)] * 50 + [(None, b)] * 50
    assert sorted(r["text"] for r in jaccard.keep_one(spark.createDataFrame(copies, "doc_id long, text string")).collect()) == [a, b]


def test_each_set_fetches_its_own_text(spark):
    """100 rows without an id and 100 of one id: as many texts as sets, not their product."""
    texts = [(None if k < 100 else 5, f"text {k}") for k in range(200)]
    named = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text_key", jaccard.text_key(F.col("text")))
    members = named.select(F.col("doc_id").alias("least"), "text_key", F.lit(0).alias("cluster"), F.xxhash64("text").alias("set"),
                           F.lit(1).alias("copies"), F.col("text_key").alias("set_key"))
    got = [(r["set"], r["text"]) for r in jaccard.fetched(named, members).select("set", "text").collect()]
    assert len(got) == 200 == len(set(got)) and {t for _, t in got} == {t for _, t in texts}


def test_jaccard_without_ids(spark):
    """Near pairs of rows without an id, or of one id, each in a class of its own."""
    rows = [(i, " ".join(f"{i}w{k}x{j}" for j in range(60)) + tail) for i in (None, 5) for k in range(30) for tail in ("", " tail")]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(None, None, 1)] * 60 + [(5, 5, 1)] * 60, key=str)


def vectors(seed, dims=20):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(60):
        v = rng.standard_normal(dims)
        out += [(v + rng.standard_normal(dims) * 0.12, k % 3) for _ in range(rng.integers(1, 5))]
    hot = rng.standard_normal(dims)
    out += [(hot + rng.standard_normal(dims) * 0.1, 0) for _ in range(80)] + [(hot, 0)] * 7 + [(hot * 3, 0)]
    return out


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_embeddings_equal_all_pairs(spark, cell_rows):
    data = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(vectors(4))]
    n = len(data)
    bad = [(n, None, 0), (n + 1, [0.0] * 20, 0), (n + 2, [1.0, None] * 10, 0), (n + 3, [float("nan")] * 20, 0), (n + 4, data[0][1], None),
           (n + 5, [], 0), (n + 6, [float("inf")] * 20, 0), (n + 7, data[0][1][:19], data[0][2]), (n + 8, data[0][1][:3], data[0][2])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.join(df, 0.98, cell_rows).collect()}
    unit = np.array([v for _, v, _ in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine, label = unit @ unit.T, np.array([x for *_, x in data])
    links = [(int(a), int(b)) for a, b in np.argwhere(np.triu((cosine >= 0.98) & (label[:, None] == label), 1))]
    root = component(range(n), links)
    degree = np.bincount(np.array(links).ravel(), minlength=n)
    assert {i: got[i] for i in range(n)} == {i: (degree[i], root[i], root[i] == i) for i in range(n)}
    assert all(got[b[0]] == (0, b[0], True) for b in bad)
    assert embeddings.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [10, 50_000, 10_000_000, 10_000_000_000])
def test_every_ball_cell_is_touched(rows):
    rng, radius = np.random.default_rng(0), 0.07
    axes, width = embeddings.grid(rows, 2048, radius)
    for _ in range(200):
        x = rng.standard_normal(axes) * 0.12
        step = rng.standard_normal(axes)
        y = x + (step / np.linalg.norm(step) * radius * rng.random() if axes else step)
        a, b = (tuple(int(c) for c in np.floor(p / width)) for p in (x, y))
        assert a == b or (b in embeddings.touched(x, radius, width) if b > a else a in embeddings.touched(y, radius, width))
