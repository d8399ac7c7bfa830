"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import collections
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from annalist.llm import mixing, pii, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SIZE int, target string, shard int, n_entities int, _kept_0 string"


def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = []
    for k in range(120):
        text = prose(rnd.randrange(60, 160))
        if k % 6 == 1:
            text = out[-1][1] + (" tail" if k % 12 == 1 else "")
        if k % 10 == 3:
            text = f"Mail anna{k}@corp.com or call Dr. Anna Weber. " + text
        if k % 10 == 4:
            text = "spam now " * 80
        out.append((k, text))
    out += [(200, None), (201, ""), (202, "short"), (None, prose(90)), (203, "x" * 3000 + " " + prose(70)), out[8], out[8]]
    return [(i, t, "en", [None, "web", "news", "code"][k % 4] if k % 3 else "web", len(t) if t is not None else None, k, "t", 9, 5, "z") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 10 != 4), 0) for k in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        place = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(place)
        docs = spark.read.parquet(place)
        found.append((name, before, docs))
    return folder, {name: (before, after) for name, before, after in found}


def taken(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "surrogates", "mixture", "token_ids"]
    for name in list(stages[1])[:-1]:
        before, after = stages[1][name]
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_rules(spark, stages):
    before, after = stages[1]["quality_rules"]
    forest = quality.train(before, spark.read.parquet(f"{stages[0]}/labels.parquet"))
    want = collections.Counter()
    for r in before.collect():
        words = WORDS(r["text"] or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k:k + 3])] > 1}
        if len(words) >= 50 and 100 * len(inside) <= 50 * len(words):
            kept = quality.verdict([quality.statistics(r["text"])], forest, 0.7)[6][0].as_py()
            want[tuple(r)] += kept
    assert taken(after) == +want


def test_near_duplicates(stages):
    before, after = stages[1]["near_duplicates"]
    table = [tuple(r) for r in before.collect()]
    grams = [frozenset(zip(*(WORDS(r[1] or "")[k:] for k in range(5)))) for r in table]
    parent = list(range(len(table)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(table)):
        for b in range(a):
            if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                parent[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for k, r in enumerate(table):
        classes[root(k)].append(r)
    got = taken(after)
    assert not got - collections.Counter(table)
    for members in classes.values():
        ids = [r[0] for r in members if r[0] is not None]
        kept = [r for r in set(members) for _ in range(got[r])]
        assert sorted(r[0] for r in kept if r[0] is not None) == ([min(ids)] if ids else [])
        assert len([r for r in kept if r[0] is None]) == any(r[0] is None for r in members)


def test_surrogates(stages):
    before, after = stages[1]["surrogates"]
    old, new = ({r[0]: tuple(r) for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    for k, r in new.items():
        found = list(pii.entities(old[k][1]))
        assert (r[1] != old[k][1]) == bool(found)
        assert not any(form in r[1] for _, _, kind, form in found if kind == "email") and "corp.com" not in r[1]
        assert r[4] == len(r[1]) and r[:1] + r[2:4] + r[5:] == old[k][:1] + old[k][2:4] + old[k][5:]


def test_mixture(stages):
    before, after = stages[1]["mixture"]
    old, got = taken(before), taken(after)
    size = {r: len(WORDS(r[1] or "")) for r in old}
    assert not set(got) - set(old) and all(got[r] <= 2 * old[r] for r in got)
    of = collections.defaultdict(int)
    for r, n in old.items():
        of[r[3]] += size[r] * n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    targets = mixing.reshared_targets([of[s] for s in names], [float((3, 1, 2)[k % 3]) for k in range(len(names))], 1.5 * sum(of.values()))
    for name, target in zip(names, targets):
        words = sum(size[r] * n for r, n in got.items() if r[3] == name)
        assert abs(words - target) <= max(0.05 * target, max(size.values()))


def test_token_ids(stages):
    before, after = stages[1]["token_ids"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = collections.Counter()
    for r in before.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in after.collect()) == want


def test_run_on_an_empty_table(spark, stages, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{stages[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
