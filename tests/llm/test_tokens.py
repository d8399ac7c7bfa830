"""Encoding, decoding and token files against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annalist.llm import bpe, tokenfile
from annalist.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(5)
    odd = "thean'Éès 12.,!<|>ΣσςİßⅧ́ \u0085日本\x1c語ǅ"
    some = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(80))) for _ in range(150)]
    long = ["".join(rnd.choice("thinger") for _ in range(9000)), "a b " + "".join(rnd.choice("thé'inger,1") for _ in range(7000)) + "<|endoftext|>" + "x" * 5000 + " end",
            "é́" * 3000, " " * 3000, " ".join(["word"] * 30_000)]
    return [None, "", "   \n", "hello <|endoftext|> world", "ROT! rot, 'Tis they're", *some, *long]


def rows(spark, with_nulls=True):
    ids = list(range(len(texts())))
    data = [(None if with_nulls and i == 7 else 3 if i == 9 else i, t, "x", "y") for i, t in zip(ids, texts())]
    return data, spark.createDataFrame(data, "doc_id long, text string, ids string, TEXT string").repartition(4)


def test_encode_and_decode(spark, library):
    data, df = rows(spark)
    got = bpe.digests(bpe.encode(df, PATH, piece=300), PATH).collect()
    want = []
    for i, t, *_ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("size", [1, 3, 16])
def test_tree_concatenation(library, size):
    enc, rnd = bpe.encoder(PATH), random.Random(size)
    for _ in range(400):
        word = "".join(rnd.choice(rnd.choice(["ab", "the", "aaab", "thinger", "xyz"])) for _ in range(rnd.randrange(1, 150)))
        parts = [word[lo:hi] for lo, hi in bpe.halves(len(word), size)]
        assert enc.tree([enc.symbols(p, k == len(parts) - 1) for k, p in enumerate(parts)], True) == enc.symbols(word, True)


def test_small_word_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    enc = bpe.Encoder(PATH)
    for t in texts()[:60]:
        assert enc.encode([t])[0].tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n, kinds, lanes, segment, block", [(0, 5, 4, 3, 32), (1, 1, 4, 3, 32), (7, 3, 4, 2, 16), (5000, 50, 8, 5, 160), (70_000, 9000, 64, 8, 4096)])
def test_blocks_round_trip(n, kinds, lanes, segment, block):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % kinds).astype(np.uint32)
    table = tokenfile.Table.of(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))))
    assert not len(table.share) or table.share.sum() == 1 << tokenfile.PRECISION
    run, records = tokenfile.Run(3, table, block, lanes, segment), []
    for place, lo in enumerate(range(0, n, 37)):
        records += run.add(place, place, ids[lo : lo + 37])
    records += run.flush(True)
    data = b"".join(r + b"\n" for r in records)
    out = [tokenfile.ids_of(h, b, table)[0] for h, b in tokenfile.records(memoryview(data))]
    assert (np.concatenate(out) if out else ids).tolist() == ids.tolist()
    if n > 1000:
        broken = bytearray(data)
        broken[len(records[0]) // 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            list(tokenfile.records(memoryview(bytes(broken))))
        with pytest.raises(ValueError):
            list(tokenfile.records(memoryview(data[:-9])))


def test_token_files(spark, library):
    data, df = rows(spark)
    folder = new_folder(spark, "tokens")
    tokenfile.write(df, folder, PATH, block_ids=1024, lanes=16, segment=8)
    read = tokenfile.read(spark, folder, with_ids=True).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.starts(tokenfile.read(spark, folder)).collect())
    encoded = sorted((((i is not None, i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in data), key=lambda x: x[0])
    assert [g[0] for g in got] == [e[0] for e in encoded]
    at = 0
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at
        at += g[2]
    crc = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(g[2:] for g in got) == sorted(crc(ids) for _, ids in encoded)
    assert sorted(bytes(r["ids"]) for r in read) == sorted(np.array(ids, "<u4").tobytes() for _, ids in encoded)
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [e[0] for e in encoded]


def test_token_files_of_an_empty_table(spark):
    assert tokenfile.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_opened(spark, library):
    r = bpe.opened(bpe.encode(spark.createDataFrame([(1, "One two, THREE"), (2, None)], "doc_id long, text string"), PATH), PATH).orderBy(F.col("doc_id")).collect()
    ids = library.encode("One two, THREE", add_special_tokens=False).ids
    assert (r[0]["ids"], r[0]["decoded"], r[1]["ids"], r[1]["n_tokens"]) == (ids, library.decode(ids), [], 0)
