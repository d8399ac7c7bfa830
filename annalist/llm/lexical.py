"""Ranked lexical search by scanning: an automaton of all items' terms counts them in every document, without an index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import pick, prepare, store

#: A term: ASCII digits and letters, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8 to the automaton's letters: capitals in lower case, and one blank for all that parts terms.
LETTERS = bytes(ord(chr(b).lower()) if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Bytes that are scanned at once, and cells of scores that a task holds.
SCAN, CELLS = 1 << 20, 1 << 21


def lowered(column) -> F.Column:
    return F.translate(column, UPPER, UPPER.lower())


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each term between two blanks, and tells its number; -1 for the line feed that ends a document."""
    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(f" {term} ".encode().decode("latin-1"), number)
    found.add_word("\n", -1)
    found.make_automaton()
    return found


def pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text's letters, in parts that are cut before a blank. A long run of letters stays whole."""
    letters = raw.translate(LETTERS)
    at = 0
    while len(letters) - at > size:
        cut = letters.find(b" ", at + size)
        if cut < 0:
            break
        yield letters[at:cut]
        at = cut
    yield letters[at:] if at else letters


def counted(scan: ahocorasick.Automaton, terms: int, texts: list[bytes], size: int = SCAN) -> tuple[np.ndarray, ...]:
    """For texts in turn: their numbers of terms; and text, term and count of each term of the automaton that they hold."""
    total = np.zeros(len(texts), np.int64)
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    held: list[bytes] = []
    owners: list[int] = []
    weight = 0

    def flush() -> None:
        nonlocal weight
        if owners:
            line = (b" " + b" \n ".join(held) + b" \n").decode("latin-1")
            found = np.fromiter((number for _, number in scan.iter(line)), np.int64)
            ends = found < 0
            of = np.array(owners, np.int64)[(ends.cumsum() - ends)[~ends]]
            key, n = np.unique(of * terms + found[~ends], return_counts=True)
            keys.append(key)
            times.append(n)
        held.clear()
        owners.clear()
        weight = 0

    for k, raw in enumerate(texts):
        for part in pieces(raw, size):
            total[k] += len(part.split())
            held.append(part)
            owners.append(k)
            weight += len(part)
            if weight >= size:
                flush()
    flush()
    key, where = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    count = np.zeros(len(key), np.int64)
    np.add.at(count, where, np.concatenate(times) if times else np.zeros(0, np.int64))
    return total, key // max(1, terms), key % max(1, terms), count


def held_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (its terms with repeats), and numbers and counts of those of ``terms`` that it holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(terms)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                raw = part.column("text").cast(pa.binary()).to_pylist()
                total, text, term, count = counted(scan, len(terms), [r or b"" for r in raw])
                ends = pa.array(np.searchsorted(text, np.arange(len(raw) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(count))], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def frequencies(held: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term stands. A task hands on one row a term at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for term, df in held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


class Best:
    """The highest-scoring documents of each item so far: by score, then by id, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.item = top, np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, object)
        self.least = np.ones(items, np.int64)  # what a score must reach

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[doc, item]])
        owners = np.concatenate([self.ids, ids[doc]])
        place = {d: k for k, d in enumerate(sorted(set(owners.tolist()), key=lambda d: (d is None, d)))}
        order = np.lexsort((np.fromiter(map(place.__getitem__, owners.tolist()), np.int64, len(owners)), -score, item))
        item, score, owners = item[order], score[order], owners[order]
        begin = np.searchsorted(item, np.arange(len(self.least)))
        keep = np.arange(len(item)) - begin[item] < self.top
        self.item, self.score, self.ids = item[keep], score[keep], owners[keep]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) >= self.top)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def ranked(held: DataFrame, items: list, weights: np.ndarray, entries: np.ndarray, docs: int, length: int, top: int) -> DataFrame:
    """Each task's best documents of every item. ``entries`` has (term, item, repeats), in order of the term."""
    kind = held.schema["doc_id"].dataType.simpleString()
    begin = np.searchsorted(entries[:, 0], np.arange(len(weights) + 1))
    several = max(1, CELLS // max(1, len(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), top)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in (batch.slice(i, several) for i in range(0, batch.num_rows, several)):
                size = np.diff(part.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), size)
                term, times = part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy()
                m = 100 - 25 + (25 * part.column("n").to_numpy() * docs) // length
                gain = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
                order = np.argsort(term, kind="stable")
                doc, term, gain = doc[order], term[order], gain[order]
                scores = np.zeros((part.num_rows, len(items)), np.int64)
                new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
                for lo, hi in zip(new, np.append(new[1:], len(term))):
                    own = entries[begin[term[lo]] : begin[term[lo] + 1]]
                    scores[doc[lo:hi, None], own[None, :, 1]] += gain[lo:hi, None] * own[None, :, 2]
                ids = np.empty(part.num_rows, object)
                ids[:] = part.column("doc_id").to_pylist()
                best.add(ids, scores)
        if len(best.item):
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.ids.tolist(), id_type), pa.array(best.score)], ["item", "doc_id", "score"])

    return held.mapInArrow(run, f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, block_terms: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` documents of every item by a sum of weighted, saturated term counts, all in whole numbers.

    Terms are maximal runs of ASCII digits and letters and of all that is not ASCII; only A-Z is lower-cased. The items
    are a stated set of queries: they go in blocks of some ``block_terms`` different terms an item (a larger item is a
    block of its own), each with one automaton that all tasks get, and one pass over the documents. No table of the documents'
    terms is made: a document's row holds counts of the items' terms only.

    A null text has no term; documents without a term count nowhere; an item without a term, or none of whose terms is
    found, has no rows. Rows of one item_id are one item with the terms of all of them, also those of a null id.
    Documents are rows: of equal ids each ranks by itself, and null ids come last among equal scores. Extra columns are
    ignored; empty tables give no rows.

    Returns item_id, rank (from 1), doc_id, score.
    """
    prepare(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col)
    asked = pick(items, item_id=item_col, text=item_text_col)
    found = F.regexp_extract_all(lowered("text"), F.lit(f"({TERM})"))
    entries = store(asked.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats")), "item-terms")
    blocks = max(1, -(-entries.count() // block_terms))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while entries.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("of")).where((F.col("n") > 2 * block_terms) & (F.col("of") > 1)).count():
        blocks *= 2
        number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kinds = texts.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    best = []
    for block in range(blocks):
        rows = entries.where(number == block).collect()  # bounded by block_terms, or one item
        if not rows:
            continue
        terms = sorted({r["term"] for r in rows})
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        of_term, of_item = ({x: k for k, x in enumerate(xs)} for xs in (terms, ids))
        table = np.array(sorted((of_term[r["term"]], of_item[r["item_id"]], r["repeats"]) for r in rows), np.int64)
        held = store(held_terms(texts, terms).where("n > 0"), "held-terms")
        n_docs, length = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = frequencies(held, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item long, item_id {kinds[1]}")
        best.append(ranked(held, ids, weights, table, n_docs, length, top).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    if not best:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    every = best[0]
    for more in best[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
