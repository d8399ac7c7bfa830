"""Alignment of two tokenizers' tokens by pointer jumping, and how often their ids are linked over all documents."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import freed, pick, prepare, slices, store

#: Units whose tokens are aligned at once, and bytes (estimated) that a worker's table of known units may take.
SLICE, TABLE_BYTES = 1 << 17, 32 << 20
#: Tokens of a block of documents, entries that are summed at once, and links of a group that are listed one by one.
BLOCK, TOGETHER, LISTED = 1_000_000, 1_000_000, 4096
#: Ids are dealt by their remainder.
BUCKETS = 1024
#: A unit starts with a blank or line feed that follows no white space. No match of the first tokenizer's pattern has white
#: space after another character, and no piece of the second has a blank or line feed behind another character.
units = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*").findall
#: Texts whose every blank and line feed starts a unit need no pattern. Fixed value: white space, also beyond ASCII.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD = rf"{SPACE}[ \n]|^[ \n]|[ \n]$"
#: Letters that the first tokenizer's pattern leaves in one match, and marks that follow them as units of their own.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!#$%&()*+,./:;=?@[]^_`{}~-"
plain = re.compile(f"[{LETTERS}]+").fullmatch
MARK = np.uint32(1 << 31)


class Pair:
    """Both tokenizers behind a table of units: each distinct unit goes to the libraries once per table."""

    def __init__(self, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(first, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        model = spec["model"]
        self.merge = BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]).tokenize
        # The library writes each byte as a character: printable ones as themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.shown = {b: c for c, b in byte_of.items()}
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        spelled |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces with white space behind another character join units")
        mixed = " ".join(p for p in pieces if re.search(f"[{LETTERS}][{re.escape(MARKS)}]", p))
        self.marks = "".join(m for m in MARKS if not re.search(f"[{LETTERS}]{re.escape(m)}", mixed))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank, self.line = [self.b.piece_to_id("▁")], self.a.encode("\n").ids
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.reset()

    def reset(self) -> None:
        #: A unit begins with its white space; marks that follow letters begin with none. Unit 0 is empty.
        self.number: dict[str, int] = {"": 0}
        self.weight = 0
        self.flat = [np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.uint32)]
        self.ends = [np.zeros(2, np.int64), np.zeros(2, np.int64)]
        self.sound = np.ones(1, bool)

    def _first(self, unit: str) -> list[int]:
        if plain(unit[1:]) and unit[0] in " \n":
            letters = unit[1:] if unit.isascii() else unit[1:].encode().decode("latin-1").translate(self.shown)
            return [t.id for t in self.merge("Ġ" + letters)] if unit[0] == " " else self.line + [t.id for t in self.merge(letters)]
        return self.a.encode(unit, add_special_tokens=False).ids

    def _second(self, fresh: list[str]) -> list[list[int]]:
        """The model puts a blank before what it encodes, but not before an empty text. It is cut off behind a line feed;
        marks are encoded after a letter."""
        sent = [u[1:] if u[0] == " " else u if u[0] == "\n" else "a" + u for u in fresh]
        return [ids if u[0] == " " and len(u) > 1 else self.blank if u == " " else ids[1:] for u, ids in zip(fresh, self.b.encode(sent, num_threads=1))]

    def _learn(self, fresh: list[str]) -> None:
        found = [self._first(u) for u in fresh], self._second(fresh)
        raw = [u.encode() for u in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sound = np.ones(len(fresh), bool)
        for side, (ids, spelled, sizes) in enumerate(zip(found, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size))):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
            bound = np.concatenate([[0], count.cumsum()])
            so_far = np.concatenate([[0], sizes[flat].cumsum()])
            if not (np.array_equal(so_far[bound[1:]] - so_far[bound[:-1]], size) and b"".join(map(spelled.__getitem__, flat.tolist())) == b"".join(raw)):
                sound &= np.array([b"".join(map(spelled.__getitem__, x)) == r for x, r in zip(ids, raw)])
            old = self.ends[side][-1]
            if old + len(flat) > len(self.flat[side]):
                self.flat[side] = np.concatenate([self.flat[side], np.zeros(old + 2 * len(flat), np.uint32)])
            self.flat[side][old : old + len(flat)] = flat
            self.ends[side] = np.concatenate([self.ends[side], old + bound[1:]])
            self.weight += 4 * len(flat)
        self.sound = np.concatenate([self.sound, sound])
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        self.weight += 200 * len(fresh) + int(size.sum())

    def numbers(self, keys: list[str]) -> np.ndarray:
        known = self.number
        fresh = list(dict.fromkeys(k for k in keys if k not in known))
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def units_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The units of each text, behind a blank, as numbers; null and empty texts have none."""
        if self.weight > TABLE_BYTES:
            self.reset()
        texts = texts.fill_null("")
        out = [np.zeros(0, np.int64)] * len(texts)
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(some & odd):
            out[k] = self.numbers(units(" " + texts[k].as_py()))
        even = np.flatnonzero(some & ~odd)
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
        ends = np.diff(words.offsets.to_numpy()).cumsum()
        coded = words.flatten().dictionary_encode()
        different, at = coded.dictionary, coded.indices.to_numpy()
        # Marks behind letters are units of their own.
        letters = pc.utf8_rtrim(different, characters=self.marks) if self.marks else different
        marked = pc.binary_length(different).to_numpy() > pc.binary_length(letters).to_numpy()
        marked &= pc.match_substring_regex(letters, f"^\n?[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        whole = pc.if_else(pa.array(marked), letters, different).to_pylist()
        one = self.numbers([w if w[0] == "\n" else " " + w for w in whole])
        two = np.zeros(len(one), np.int64)
        marks = pc.replace_substring_regex(different.filter(pa.array(marked)), f"^\n?[{LETTERS}]+", "").dictionary_encode()
        two[marked] = self.numbers(marks.dictionary.to_pylist())[marks.indices.to_numpy()]
        both = np.empty(2 * len(at), np.int64)
        both[::2], both[1::2] = one[at], two[at]
        used = both > 0
        ends = np.concatenate([[0], used.cumsum()])[2 * ends]
        for k, part in zip(even, np.split(both[used], ends[:-1])):
            out[k] = part
        return out

    def tokens(self, parts: list[np.ndarray]) -> tuple:
        """Of parts of texts, as numbers of units: ids and their number for both sides, and whether the bytes are the parts'."""
        numbers, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], count.cumsum()])
        bad = np.concatenate([[0], (~self.sound[numbers]).cumsum()])
        out = []
        for side in range(2):
            lo, n = self.ends[side][numbers], np.diff(self.ends[side])[numbers]
            after = np.concatenate([[0], n.cumsum()])
            ids = self.flat[side][np.repeat(lo - after[:-1], n) + np.arange(after[-1])]
            out += [ids, after[bounds[1:]] - after[bounds[:-1]]]
        return (*out, bad[bounds[1:]] == bad[bounds[:-1]])


@lru_cache(maxsize=1)
def pair(first: str, second: str) -> Pair:
    """One per worker process."""
    return Pair(first, second)


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, for ends of tokens that cover the same bytes.

    Every token points to the token of the other side that overlaps it and lies farthest right: the one with its last
    byte. A token of the second side that ends where one of the first does is its group's terminal and points to itself.
    Doubling the pointers brings every token to its group's terminal.
    """
    n = len(a_end)
    to_b = np.searchsorted(b_end, a_end, side="left")
    to_a = np.searchsorted(a_end, b_end, side="left")
    ends = a_end[to_a] == b_end if len(b_end) else np.zeros(0, bool)
    pointer = np.concatenate([n + to_b, np.where(ends, n + np.arange(len(b_end)), to_a)])
    moving = np.arange(len(pointer))
    while len(moving):
        further = pointer[pointer[moving]]
        changed = further != pointer[moving]
        moving, further = moving[changed], further[changed]
        pointer[moving] = further
    label = ends.cumsum() - 1
    return label[pointer[:n] - n], label[pointer[n:] - n]


def sliced(texts: list[np.ndarray], size: int) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """Lists of (some of a text's units in turn, whether it ends there), about ``size`` units each."""
    held: list[tuple[np.ndarray, bool]] = []
    weight = 0
    for found in texts:
        at = 0
        while True:
            part = found[at : at + size - weight]
            at += len(part)
            weight += len(part)
            held.append((part, at == len(found)))
            if weight >= size:
                yield held
                held, weight = [], 0
            if at == len(found):
                break
    if held:
        yield held


def aligned(p: Pair, texts: pa.Array | list[str | None], size: int = SLICE) -> list[tuple[bytes, bytes]]:
    """Both sides' ids of each text, 32 bits each, the last of each group marked by the highest bit."""
    out: list[tuple[bytes, bytes]] = []
    open_: list[list[bytes]] = [[], []]
    good = True
    for parts in sliced(p.units_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())), size):
        a, a_n, b, b_n, sound = p.tokens([part for part, _ in parts])
        # Unsound parts leave, so that both sides cover the same bytes.
        if not sound.all():
            a, b = (x[np.repeat(sound, n)] for x, n in ((a, a_n), (b, b_n)))
            a_n, b_n = np.where(sound, a_n, 0), np.where(sound, b_n, 0)
        in_a, in_b = groups(p.a_size[a].cumsum(), p.b_size[b].cumsum())
        for ids, group in ((a, in_a), (b, in_b)):
            ids[np.append(group[1:] != group[:-1], True)[: len(group)]] |= MARK
        a_at, b_at = (np.concatenate([[0], n.cumsum()]).tolist() for n in (a_n, b_n))
        for j, (_, last) in enumerate(parts):
            good = good and bool(sound[j])
            open_[0].append(a[a_at[j] : a_at[j + 1]].tobytes())
            open_[1].append(b[b_at[j] : b_at[j + 1]].tobytes())
            if last:
                out.append((b"".join(open_[0]), b"".join(open_[1])) if good else (b"", b""))
                open_, good = [[], []], True
    return out


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, with a blank before it, by a byte-level vocabulary of the tokenizers library (``first``) and a
    sentencepiece model (``second``), special tokens being plain text, and cut both rows of tokens into the smallest
    groups that cover the same bytes.

    Null and empty texts, and texts that either side's tokens do not spell byte for byte, have no tokens. A long text's
    units go through in slices. Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.

    Returns doc_id, a, b: the ids in order, 32 bits each (little-endian), the highest bit set on the last one of a group.
    """
    rows, run, kind = _aligner(docs, first, second, id_col, text_col)
    return rows.mapInArrow(freed(run), f"doc_id {kind}, a binary, b binary")


def _aligner(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> tuple:
    """doc_id and text of ``docs``, what aligns their batches, and the type of the id."""
    context = prepare(docs.sparkSession).sparkContext
    for path in (first, second):
        context.addFile(path)
    names = os.path.basename(first), os.path.basename(second)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(*map(SparkFiles.get, names))
        try:
            for batch in batches:
                for part in slices(batch, size=4 << 20):
                    found = aligned(p, part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([f[k] for f in found], pa.binary()) for k in range(2))], ["doc_id", "a", "b"])
        finally:
            p.reset()

    return rows, run, rows.schema["doc_id"].dataType.simpleString()


@lru_cache(maxsize=2)
def decimals(n: int) -> np.ndarray:
    """Each id in decimal with a comma, a bar or a semicolon behind it, filled up with zero bytes."""
    return np.array([b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(n)])


def sizes(ends: np.ndarray) -> np.ndarray:
    """Of groups, from the places of their last tokens."""
    out = ends + 1
    out[1:] -= out[:-1].copy()
    return out


def written(a: np.ndarray, b: np.ndarray) -> bytes:
    """Marked ids as ``a1,a2|b1;a3|b2,b3``."""
    ends = [np.flatnonzero(x & MARK) for x in (a, b)]
    size = [sizes(e) for e in ends]
    place_a = np.arange(len(a)) + np.repeat(size[1].cumsum() - size[1], size[0])
    place_b = np.arange(len(b)) + np.repeat(size[0].cumsum(), size[1])
    ids_a, ids_b = (x & ~MARK for x in (a, b))
    n = 1 << max(16, int(max(ids_a.max(initial=0), ids_b.max(initial=0))).bit_length())
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = ids_a, ids_b
    code[place_a[ends[0]]] += n
    code[place_b[ends[1]]] += 2 * n
    return decimals(n)[code].tobytes().translate(None, b"\0")[:-1]


def coded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of ids as one number whose highest bits are the bucket of the first."""
    a = a.astype(np.int64)
    return (a % BUCKETS) << 53 | (a // BUCKETS) << 32 | b.astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of marked ids: groups, links, the different pairs in order, and how often each is linked.

    Pairs are listed within groups, which are a word's few tokens; of a group with very many links only its
    different ids are paired, with their numbers.
    """
    a_size, b_size = (sizes(np.flatnonzero(x & MARK)) for x in (a, b))
    a_at, b_at = a_size.cumsum() - a_size, b_size.cumsum() - b_size
    a, b = a & ~MARK, b & ~MARK
    links = a_size * b_size
    small = links <= LISTED
    many = np.repeat(np.where(small, b_size, 0), a_size)  # partners of each of the first side's tokens
    begin = np.repeat(b_at, a_size)
    after = many.cumsum()
    at = np.repeat(begin - after + many, many) + np.arange(after[-1] if len(after) else 0)
    key, n = np.unique(coded(np.repeat(a, many), b[at]), return_counts=True)
    keys, times = [key], [n]
    for g in np.flatnonzero(~small).tolist():
        x, x_n = np.unique(a[a_at[g] : a_at[g] + a_size[g]], return_counts=True)
        y, y_n = np.unique(b[b_at[g] : b_at[g] + b_size[g]], return_counts=True)
        for k, m in zip(x, x_n):
            keys.append(coded(np.full(len(y), k), y))
            times.append(m * y_n)
    if len(keys) > 1:
        key, n = summed(keys, times)
    return len(links), int(links.sum()), key, n


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's times."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[new], np.add.reduceat(n[order], new) if len(new) else n


def raw(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) if x.size else b""


def read(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def by_bucket(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, and bounds of its keys, of ascending keys."""
    bucket = key >> 53
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(key)])
    return zip(bucket[new].tolist(), new.tolist(), [*new[1:].tolist(), len(key)])


def measure(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK) -> DataFrame:
    """``score`` of what ``align`` returns, in one pass over the texts: tokens go no further than their task."""
    return _scored(*_aligner(docs, first, second, id_col, text_col), block_tokens)


def score(pairs: DataFrame, block_tokens: int = BLOCK) -> DataFrame:
    """What each document's links are worth over all documents. ``pairs`` is what ``align`` returns.

    Documents lie in blocks; a block has its different pairs of ids once, and each document refers to them. Tasks add up
    how many documents hold each pair, and hand on one sum a pair; ids meet by their remainder. The counts return to the
    blocks in the same buckets, so no row is ever made of a document and a pair. A pair's bucket has a row a block.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of those with
    its first id), count_sum (over links), groups_sha256 ('' without tokens).
    """
    return _scored(pairs.select("doc_id", "a", "b"), lambda batches: batches, pairs.schema["doc_id"].dataType.simpleString(), block_tokens)


def _scored(rows: DataFrame, align_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str, block_tokens: int) -> DataFrame:
    """Of rows whose batches ``align_batches`` turns into those of ``align``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        weight = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            size = [len(h[6]) for h in held]
            key, own, docs = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True, return_counts=True)
            first = np.concatenate([[0], np.cumsum(size)])
            steps = [np.diff(own[lo:hi], prepend=0).astype(np.int32) for lo, hi in zip(first, first[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.concatenate(x))) for x in (steps, [h[7] for h in held])]
            table = pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], id_type), *(pa.array([h[k] for h in held], pa.int64()) for k in range(1, 5)), pa.array([h[5] for h in held], pa.string()), *lists],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "steps", "times"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([len(key)], pa.int64()), *(pa.array([x], pa.binary()) for x in (raw(np.diff(key, prepend=0)), raw(docs), sink.getvalue().to_pybytes()))],
                ["block", "n", "keys", "docs", "payload"])

        for batch in align_batches(batches):
            id_type = batch.schema.field("doc_id").type
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_py(), "<u4") for c in ("a", "b"))
                n_groups, n_links, key, times = linked(a, b)
                times = times.astype(np.int32) if times.max(initial=0) < 1 << 31 else times
                sha = hashlib.sha256(written(a, b)).hexdigest() if len(a) else ""
                held.append((batch.column("doc_id")[k].as_py(), len(a), len(b), n_groups, n_links, sha, key, times))
                weight += len(a) + 50
                if weight >= block_tokens:
                    yield block()
                    held, weight = [], 0
        if held:
            yield block()

    blocks = store(rows.mapInArrow(freed(pack), "block long, n long, keys binary, docs binary, payload binary"), "alignments")

    def rows_of(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(by_bucket(key))
        for lo in range(0, len(found), 256):
            some = found[lo : lo + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _, _ in some]), pa.array([hi - lo for _, lo, hi in some]), *(pa.array([raw(v[lo:hi]) for _, lo, hi in some], pa.binary()) for v in (key, n))],
                ["bucket", "n", "keys", "docs"])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for n, k, d in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "docs"))):
                keys.append(read(k, n).cumsum())
                docs.append(read(d, n))
                if sum(map(len, keys)) > TOGETHER:
                    key, total = summed(keys, docs)
                    if len(key) > TOGETHER // 2:
                        yield from rows_of(key, total)
                        key, total = key[:0], total[:0]
                    keys, docs = [key], [total]
        yield from rows_of(*summed(keys, docs))

    def fully(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's different pairs, each one's documents, and whether it is the first id's most frequent."""
        now, keys, docs = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                key, n = summed(keys, docs)
                own = key >> 32
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                most = np.repeat(np.maximum.reduceat(n, new), np.diff(np.append(new, len(key))))
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([len(key)]), *(pa.array([raw(x)], pa.binary()) for x in (key, np.where(n == most, -n, n)))], ["bucket", "n", "keys", "docs"])

        for batch in batches:
            for bucket, n, k, d in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "keys", "docs"))):
                if bucket != now:
                    yield from out()
                    now, keys, docs = bucket, [], []
                keys.append(read(k, n))
                docs.append(read(d, n))
                if len(keys) > 64:
                    key, total = summed(keys, docs)
                    keys, docs = [key], [total]
        yield from out()

    sums = blocks.select("n", "keys", "docs").mapInArrow(freed(partly), "bucket long, n long, keys binary, docs binary")
    counts = store(sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(freed(fully), "bucket long, n long, keys binary, docs binary"), "pair-counts")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, k in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "keys"))):
                key = read(k, n).cumsum()
                for rows in rows_of(key, key[:0]):
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([block] * rows.num_rows), rows.column(1), rows.column(2), pa.array([None] * rows.num_rows, pa.binary())],
                                                     ["bucket", "block", "n", "keys", "docs"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's counts come first (no block), then each block's pairs; a block gets the counts of its pairs."""
        key = worth = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for bucket, block, n, k, d in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "keys", "docs"))):
                if block is None:
                    key, worth = read(k, n), read(d, n)
                else:
                    out.append((block, bucket, n, raw(worth[np.searchsorted(key, read(k, n))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["block", "bucket", "n", "data"])

    questions = blocks.select("block", "n", "keys").mapInArrow(freed(asked), "bucket long, block long, n long, keys binary, docs binary")
    both = questions.unionByName(counts.withColumn("block", F.lit(None).cast("long")))
    replies = both.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first()).mapInArrow(freed(answered), "block long, bucket long, n long, data binary")
    streams = replies.unionByName(blocks.select("block", F.lit(None).cast("long").alias("bucket"), "n", F.col("payload").alias("data")))
    streams = streams.repartition("block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last())

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's counts, in order of its pairs, come before it."""
        parts: list[np.ndarray] = []
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, n, data = (batch.column(c)[k].as_py() for c in ("bucket", "n", "data"))
                if bucket is not None:
                    parts.append(read(data, n))
                    continue
                worth = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                parts = []
                table = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
                steps, times = (table.column(c).flatten().to_numpy().astype(np.int64) for c in ("steps", "times"))
                size = np.diff(table.column("steps").offsets.to_numpy())
                total = steps.cumsum()
                begin = size.cumsum() - size
                ahead = np.concatenate([[0], total])[begin]
                found = worth[total - np.repeat(ahead, size)] if len(total) else worth
                best, count = np.where(found < 0, times, 0), np.abs(found) * times
                own = np.repeat(np.arange(table.num_rows), size)
                sums = []
                for x in (best, count):  # whole numbers throughout: sums by differences
                    run = np.concatenate([[0], x.cumsum()])
                    sums.append(pa.array(run[begin + size] - run[begin]))
                del own
                yield pa.RecordBatch.from_arrays([*(table.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, table.column("sha")],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return streams.mapInArrow(freed(closed), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
