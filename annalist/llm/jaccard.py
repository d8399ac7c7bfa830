"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import discard, freed, pick, prepare, store, words_of
from annalist.llm.graph import components

MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def bands_for(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so the fewest false candidates, whose recall at ``threshold`` is at
    least ``recall`` within ``most_hashes`` hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("this recall needs more hashes")
    return best


class Shingles:
    """Sets of hashed word n-grams. A text of fewer than n words, but one at least, has one n-gram of all its words."""

    def __init__(self, n: int, table_bytes: int = 16 << 20) -> None:
        self.n, self.table_bytes, self.weight = n, table_bytes, 0
        self.hash_of: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        table = self.hash_of
        if self.weight > self.table_bytes:
            table.clear()
            self.weight = 0
        for word in set(words).difference(table):
            table[word] = xxhash.xxh64_intdigest(word)
            self.weight += 170 + 2 * len(word)
        hashed = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, np.uint64(n))
        for k in range(n):
            out = (out ^ hashed[k : len(hashed) - n + 1 + k]) * MIX[k % len(MIX)]
            out ^= out >> np.uint64(29)
        return np.unique(out)


class MinHash:
    """Band hashes of a set: the least values of ``bands x rows`` permutations of 32-bit hashes, ``rows`` to a band."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        least = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for lo in range(0, len(short), 256):
            part = short[lo : lo + 256, None] * self.a
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        band = (least.astype(np.uint64).reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64)
        band = (band ^ (band >> np.uint64(31))) + np.arange(self.bands, dtype=np.uint64) * MIX[0]
        band *= MIX[1]
        return (band ^ (band >> np.uint64(32))).view(np.int64)


def compare(a: list[tuple], b: list[tuple] | None, threshold: float) -> tuple[dict[int, int], dict[int, int]]:
    """Rows are (set number, copies, sorted n-grams). Links of every set of ``a`` with every one of ``b`` (None: within
    ``a``): the copies it links with, and a root of its group by links. Sets without a link are left out."""
    rows = a if b is None else a + b
    sizes = np.array([len(r[2]) for r in rows])
    copies = np.array([r[1] for r in rows], np.int64)
    codes = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(rows)), sizes)
    ends = sizes.cumsum()
    # Posting lists, sets of b (or all) only.
    start = 0 if b is None else len(a)
    inside = owner >= start
    order = np.argsort(codes[inside], kind="stable")
    posting, posted = owner[inside][order], codes[inside][order]
    bounds = np.searchsorted(posted, np.arange(codes.max() + 2))
    links = np.zeros(len(rows), np.int64)
    parent = np.arange(len(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(a)):
        mine = codes[ends[i] - sizes[i] : ends[i]]
        lo, count = bounds[mine], bounds[mine + 1] - bounds[mine]
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate([[0], count.cumsum()[:-1]]), count) + np.arange(total)
        common = np.bincount(posting[at], minlength=len(rows))
        first = i + 1 if b is None else start
        both = common[first:]
        found = first + np.flatnonzero((both > 0) & (both >= threshold * (sizes[i] + sizes[first:] - both) - 1e-9))
        if len(found):
            links[i] += copies[found].sum()
            links[found] += copies[i]
            mine_root = root(i)
            for j in found.tolist():
                parent[root(j)] = mine_root
    linked = np.flatnonzero(links)
    return ({rows[i][0]: int(links[i]) for i in linked}, {rows[i][0]: rows[root(i)][0] for i in linked})


def grouped(batches: Iterator[pa.RecordBatch], key: Callable[[dict], tuple]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows that stand together in a sorted stream."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = key(row)
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(row)
    if held:
        yield now, held


def text_key(text: Column) -> Column:
    """A hash of a text; null and empty texts have one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fetched(named: DataFrame, members: DataFrame) -> DataFrame:
    """The text of every member, by id and text, so that rows of one id, or of none, do not meet all sets of it."""
    found = F.col("_doc").eqNullSafe(F.col("least")) & (F.col("_text") == F.col("text_key"))
    return named.withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"}).join(members, found).select("cluster", "set", "copies", "set_key", "text")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block_grams: int = 300_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its class, and how many other rows have a Jaccard similarity of at least ``threshold`` with it.

    Rows of equal n-gram sets (so also equal texts) are one set with a number of copies. Bands of ``bands_for`` put
    sets into buckets; sets that share buckets, directly or through others, form a cluster; the full sets of a cluster
    meet once and all its pairs are compared exactly. A cluster of more than ``block_grams`` n-grams is cut into blocks
    that meet in pairs of blocks, so no task holds more than two. Only counts and the roots of linked groups leave a
    task, never pairs. The classes are the connected components of the links.

    Null and empty texts have no n-grams: class null, no links. Shorter texts have one n-gram of all their words.
    Rows of equal id count as rows of their own. Rows with a null id are linked and counted as any other; a class
    of them alone is null. Extra columns are ignored; an empty table gives no rows.

    Returns doc_id, class_id (the smallest doc_id of its class, its own for a class of one), n_links.
    """
    sketches, sets = _classed(docs, n, threshold, recall, block_grams, id_col, text_col)
    return sketches.select("doc_id", "set_key").join(sets.select("set_key", "class_id", "n_links").hint("merge"), "set_key", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _classed(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block_grams: int = 300_000,
             id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of ``join``: every row's doc_id, text_key and set_key (null without n-grams); every set's set_key, group (equal
    within a class), class_id and n_links."""
    spark = prepare(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    named = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "text_key", text_key(F.col("text")))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = Shingles(n), MinHash(bands, rows)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keys, sizes, hashes = [], [], []
                for text in part.column("text").to_pylist():
                    grams = shingles(text)
                    sizes.append(len(grams))
                    keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                    hashes.append(minhash(grams) if len(grams) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "set_key", "grams", "bands"])

    sketches = store(named.mapInArrow(freed(sketched), "doc_id long, text_key binary, set_key binary, grams long, bands array<long>"), "sketch")
    sets = store(
        sketches.where("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
        .select("set_key", F.col("at.doc_id").alias("least"), F.col("at.text_key").alias("text_key"), "copies", "grams", "bands")
        .withColumn("set", F.monotonically_increasing_id()), "sets")

    # Star of each bucket around its least set. Spark takes an exploded array for one element, and so would send tables of
    # millions of buckets through the driver; this and all joins whose sides grow with the input are by a shuffle.
    buckets = sets.select("set", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("set").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    stars = buckets.join(shared.hint("merge"), "bucket").where("set <> b").select(F.col("set").alias("a"), "b")
    clusters = components(stars).select(F.col("node").alias("set"), F.col("root").alias("cluster"))
    members = store(sets.select("set", "set_key", "least", "text_key", "copies", "grams").join(clusters.hint("merge"), "set"), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("grams") / block_grams).cast("long").alias("blocks"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of members. A row of another set, if hashes of texts should ever meet, is left out."""
        shingles = Shingles(n)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                grams = [shingles(t) for t in part.column("text").to_pylist()]
                same = [len(g) and xxhash.xxh3_128_digest(g.tobytes()) == k for g, k in zip(grams, part.column("set_key").to_pylist())]
                whole = pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("cluster", "set", "copies")), pa.array([g.tobytes() for g in grams], pa.binary())], ["cluster", "set", "copies", "held"])
                yield whole.filter(pa.array([bool(s) for s in same], pa.bool_()))

    # Always by a shuffle of the texts: a join whose way depends on the number of members costs another way at each size.
    held = fetched(named, members.hint("merge")).mapInArrow(freed(rebuilt), "cluster long, set long, copies long, held binary").join(blocks.hint("merge"), "cluster")
    mine = F.pmod(F.xxhash64("set"), F.col("blocks"))
    dealt = held.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", F.least("_mine", "_other").alias("lo"), F.greatest("_mine", "_other").alias("hi"), "_mine", "set", "copies", "held")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (_, lo, hi), group in grouped(batches, lambda r: (r["cluster"], r["lo"], r["hi"])):
            sides: tuple[dict, dict] = ({}, {})
            for r in group:  # repeated rows of an id bring a set more than once
                sides[r["_mine"] != lo][r["set"]] = (r["set"], r["copies"], np.frombuffer(r["held"], np.uint64))
            a, b = list(sides[0].values()), list(sides[1].values()) if hi > lo else None
            if not a or b == [] or (b is None and len(a) < 2):
                continue
            links, roots = compare(a, b, threshold)
            out += [(s, links[s], roots[s]) for s in links]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["set", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["set", "links", "root"])

    checked = store(dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(
        freed(verified), "set long, links long, root long"), "checked")
    discard(members)
    links = checked.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    classed = sets.select("set", "set_key", "least", "copies").join(links.hint("merge"), "set", "left").join(roots.hint("merge"), "set", "left")
    # A set without a link is a group of its own, so that these many sets are no hot key.
    ids = classed.where("root IS NOT NULL").groupBy(F.col("root").alias("group")).agg(F.min("least").alias("of_root"))
    named_sets = classed.withColumn("group", F.coalesce("root", "set")).join(ids.hint("merge"), "group", "left").select(
        "set_key", "group", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketches, named_sets


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with one row of each class, one of its smallest id, and beside it, of the rows of the class without an id,
    one. Rows without words are in no class and stay; of rows equal in id (also null) and text one stays.

    Rows are told apart by id and text: of equal ids with different texts each has the fate of its own class.
    """
    sketches, sets = _classed(docs, id_col=id_col, text_col=text_col, **options)  # type: ignore[arg-type]
    noid = F.col("doc_id").isNull().alias("noid")
    first = F.min(F.struct("doc_id", "set_key", "text_key")).alias("first")
    chosen = sketches.join(sets.select("set_key", "group").hint("merge"), "set_key").groupBy("group", noid).agg(first).select("first.doc_id", "first.text_key")
    stays = chosen.unionByName(sketches.where("set_key IS NULL").select("doc_id", "text_key").distinct()).select(
        noid.alias("_noid"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("text_key").alias("_key"))
    columns = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(columns))))
    key, text = F.col(f"_{columns.index(id_col)}").cast("long"), F.col(f"_{columns.index(text_col)}")
    # Equal rows are combined before the shuffle, so many copies without an id are no hot key.
    one = plain.groupBy(key.isNull().alias("_noid"), F.coalesce(key, F.lit(0).cast("long")).alias("_id"), text_key(text).alias("_key")).agg(
        F.first(F.struct(*plain.columns)).alias("_row"))
    return one.join(stays.hint("merge"), ["_noid", "_id", "_key"], "left_semi").select("_row.*").toDF(*columns)
