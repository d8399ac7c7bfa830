"""Removal of repeated word windows: Rabin-Karp hashes of every window, counted by Spark; repeats merge into intervals.

Documents lie in blocks of ascending ids. A block hashes each of its windows with rolling polynomials of its words' hashes,
and hands on every different hash once, in sorted pieces that are dealt by the hash's range. There each hash's earliest
block is found, and the others hear of it by one bit per hash. A block then knows of all its windows whether they start
earlier anywhere, and cuts the union of those that do.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import discard, pick, prepare, store

U = np.uint64
#: Odd multipliers of the polynomials, and the finisher of the hashes.
BYTE_BASE, WORD_BASE, OTHER_BASE, FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xFF51AFD7ED558CCD
#: Bytes whose words are hashed together, and entries of a bucket that are sorted together.
SPAN, TOGETHER = 1 << 20, 4_000_000
#: Text bytes to a bucket of hashes on average, some 250,000 windows.
BUCKET_BYTES = 1_500_000

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(FINISH)
    return h ^ (h >> U(29))


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    return _powers(SPAN)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BYTE_BASE, np.uint64), np.full(n, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return up.cumprod(dtype=np.uint64), down.cumprod(dtype=np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of every word of rows that lie end to end in ``data``."""
    inside = ~WHITE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes, from differences of running sums."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(stop, start[at] + SPAN, side="right")))
        base = start[at]
        part = data[base : stop[to - 1]]
        up, down = _table() if len(part) <= SPAN else _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * up[: len(part)], dtype=np.uint64, out=total[1:])
        a, b = start[at:to] - base, stop[at:to] - base
        out[at:to] = (total[b] - total[a]) * down[a]
        at = to
    return mixed(out)


def rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp value of every ``width`` neighbours, modulo 2^64, by doubling."""
    done, covered, size, factor = None, 0, 1, base
    while size <= width and len(h):
        if width & size:
            done = h if done is None else done[: max(0, len(h) - covered)] * U(factor) + h[covered:]
            covered += size
        h = h[: max(0, len(h) - size)] * U(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    return done if done is not None and covered == width else np.zeros(0, np.uint64)


def later(first: np.ndarray, second: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group entries by their two hashes. ``rank`` must ascend. Returns an order by hash, where its groups begin, the
    group of each entry in that order, each group's least (rank, start), and the entries (in that order) beyond it."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.concatenate([[True], ~same])[: len(order)]
    head = np.flatnonzero(new)
    group = new.cumsum() - 1
    rank, start = rank[order], start[order]
    least = rank[head]
    here = rank == least[group]
    begin = np.minimum.reduceat(np.where(here, start, np.iinfo(np.int64).max), head) if len(head) else head
    return order, head, group, least, begin, ~here | (start > begin[group])


def packed(first: np.ndarray, second: np.ndarray, extra: int) -> bytes:
    """Ascending hashes as differences of as few bytes as the largest needs, and ``extra`` bytes of the second hash."""
    gaps = np.diff(first)
    wide = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return (struct.pack("<IBBQ", len(first), wide, extra, int(first[0]))
            + gaps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes() + second.view(np.uint8).reshape(-1, 8)[:, :extra].tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, extra, least = struct.unpack_from("<IBBQ", raw)
    body = np.frombuffer(raw, np.uint8, offset=14)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :wide] = body[: (n - 1) * wide].reshape(n - 1, wide)
    first = gaps.view("<u8").ravel()
    first[0] = least
    second = np.zeros((n, 8), np.uint8)
    second[:, :extra] = body[(n - 1) * wide :].reshape(n, extra)
    return first.cumsum(dtype=np.uint64), second.view("<u8").ravel()


def _key(value: object) -> tuple:
    return value is not None, value


PAYLOAD = ["doc_id", "first", "own", "lead", "last", "text"]


def _blocks(rows: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """Pack each partition's rows into blocks: neighbouring rows of ascending ids, whole texts, ``block_bytes`` of text
    or one id. Rows of the first and the last id of a run of ascending rows, and of an id larger than a block, lie in
    blocks of that id alone (``single``). A text larger than a block is cut into pieces of words, each with the
    width - 1 words before and after it; its pieces have one ``home``."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = None

    def cut(raw: bytes) -> list[tuple[int, int, int, bool, bytes]]:
        """First word, number of words, words in front, whether it is the text's last; bytes."""
        if len(raw) <= block_bytes:
            return [(0, -1, 0, True, raw)]
        start, stop, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        marks = [0]
        while marks[-1] < len(start):
            marks.append(max(marks[-1] + 1, int(np.searchsorted(stop, start[marks[-1]] + block_bytes, side="right"))))
        out = []
        for a, b in zip(marks, marks[1:]):
            lo, hi = max(0, a - width + 1), min(len(start), b + width - 1)
            out.append((a, b - a, a - lo, b == len(start), raw[start[lo] : stop[hi - 1]]))
        return out or [(0, 0, 0, True, b"")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow_id
        part = TaskContext.get().partitionId()
        made = 0

        def block(items: list[tuple], home: int | None = None) -> pa.RecordBatch:
            nonlocal made
            number = part << 32 | made
            made += 1
            ids = [i[0] for i in items]
            table = pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), *(pa.array([i[k] for i in items], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.large_binary()), 1))], PAYLOAD)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            return pa.RecordBatch.from_arrays(
                [pa.array([number if home is None else home], pa.int64()), pa.array([number], pa.int64()), pa.array([ids[0]], arrow_id), pa.array([ids[-1]], arrow_id),
                 pa.array([ids[0] == ids[-1]]), pa.array([sum(len(i[5]) for i in items)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["home", "block", "lo", "hi", "single", "bytes", "payload"])

        def alone(items: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Blocks of one id."""
            held, weight = [], 0
            for doc, raw in items:
                pieces = cut(raw)
                if held and (weight + len(raw) > block_bytes or len(pieces) > 1):
                    yield block(held)
                    held, weight = [], 0
                if len(pieces) > 1:
                    home = part << 32 | made
                    for p in pieces:
                        yield block([(doc, *p)], home)
                else:
                    held.append((doc, *pieces[0]))
                    weight += len(raw)
            if held:
                yield block(held)

        together: list[tuple] = []  # whole ids
        same: list[tuple] = []  # rows of one id
        size = same_size = 0
        first_id = spilt = True  # of the run; has the id's block been written already
        place = last = None

        def close_id(ends: bool) -> Iterator[pa.RecordBatch]:
            """The rows of an id are complete: they join the others, or stay alone at an end of the run."""
            nonlocal together, same, size, same_size, first_id, spilt
            if ends or first_id or spilt or same_size > block_bytes:
                if together:
                    yield block(together)
                together, size = [], 0
                yield from alone(same)
            else:
                if together and size + same_size > block_bytes:
                    yield block(together)
                    together, size = [], 0
                together += [(doc, 0, -1, 0, True, raw) for doc, raw in same]
                size += same_size
            same, same_size, first_id, spilt = [], 0, False, False

        for batch in batches:
            arrow_id = batch.schema.field("doc_id").type
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for doc, raw, at in zip(some.column("doc_id").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(), some.column("place").to_pylist()):
                    if last is not None and (at != place or _key(doc) < last):
                        yield from close_id(True)
                        first_id = True
                    elif last is not None and _key(doc) != last:
                        yield from close_id(False)
                    elif same_size > block_bytes:  # an id that goes on
                        if together:
                            yield block(together)
                        together, size = [], 0
                        yield from alone(same)
                        same, same_size, spilt = [], 0, True
                    place, last = at, _key(doc)
                    same.append((doc, raw))
                    same_size += len(raw)
        if last is not None:
            yield from close_id(True)

    schema = f"home long, block long, lo {id_type}, hi {id_type}, single boolean, bytes long, payload binary"
    return store(rows.mapInArrow(run, schema), "blocks")


def _mostly_ascends(rows: DataFrame) -> bool:
    """Have the runs of ascending ids, as they lie, a thousand rows on average, but for one run a partition? (Reads ids only.)"""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, cuts = None, 0, 0
        for batch in batches:
            for doc in batch.column("doc_id").to_pylist():
                cuts += last is not None and _key(doc) < last
                last = _key(doc)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([cuts])], ["n", "cuts"])

    n, cuts = rows.select("doc_id").mapInArrow(runs, "n long, cuts long").agg(F.sum("n"), F.sum("cuts")).first()
    return (cuts or 0) * 1000 <= (n or 0)


def _in_order(blocks: DataFrame) -> bool:
    """Do the blocks' ids lie apart, but for those of one id alone? Sorted by ranges; one row a range comes back."""
    kind = blocks.schema["lo"].dataType.simpleString()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = begin = None
        sound, arrow_id = True, None
        for batch in batches:
            arrow_id = batch.schema.field("lo").type
            for lo, hi, single in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "single"))):
                begin = begin or (lo, single)
                sound = sound and (before is None or _key(before[0]) < _key(lo) or (before[0] == lo and before[1] and single))
                before = hi, single
        if before:
            yield pa.RecordBatch.from_arrays([pa.array([begin[0]], arrow_id), pa.array([begin[1]]), pa.array([before[0]], arrow_id), pa.array([before[1]]), pa.array([sound])],
                                             ["lo", "lo_single", "hi", "hi_single", "sound"])

    by = blocks.select("lo", "hi", "single").repartitionByRange("lo", "hi").sortWithinPartitions("lo", "hi")
    found = by.mapInArrow(edges, f"lo {kind}, lo_single boolean, hi {kind}, hi_single boolean, sound boolean").collect()
    found.sort(key=lambda r: (_key(r["lo"]), _key(r["hi"])))
    apart = (_key(a["hi"]) < _key(b["lo"]) or (a["hi"] == b["lo"] and a["hi_single"] and b["lo_single"]) for a, b in zip(found, found[1:]))
    return all(r["sound"] for r in found) and all(apart)


class Block:
    """The windows of one block, in order of (id, start), and their groups of equal hashes."""

    def __init__(self, payload: bytes, width: int, extra: int) -> None:
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.width, self.id_type = width, table.schema.field("doc_id").type
        self.ids = table.column("doc_id").to_pylist()
        self.cut = {c: table.column(c).to_pylist() for c in ("first", "own", "lead", "last")}
        self.texts = table.column("text").to_pylist()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        start, stop, row = word_bounds(data, self.offsets)
        self.begin = np.searchsorted(row, np.arange(len(self.ids) + 1))  # each row's first word
        self.words = len(start)
        h = word_hashes(data, start, stop)
        first = rolled(h, width, WORD_BASE)
        whole = np.flatnonzero(row[: len(first)] == row[width - 1 :]) if len(first) else np.zeros(0, np.int64)
        keep = U((1 << 8 * extra) - 1)
        first = mixed(first[whole])
        second = mixed(rolled(h ^ (h >> U(17)), width, OTHER_BASE)[whole]) & keep
        rank = np.concatenate([[0], np.cumsum([a != b for a, b in zip(self.ids, self.ids[1:])])]).astype(np.int64)
        ahead = np.array(self.cut["first"], np.int64) - np.array(self.cut["lead"], np.int64) - self.begin[:-1]
        self.whole = whole
        self.order, head, self.group, _, self.start, self.later = later(first, second, rank[row[whole]], whole + ahead[row[whole]])
        self.first, self.second = first[self.order[head]], second[self.order[head]]

    def segments(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the block's hashes fall into, and the bounds of each one's hashes."""
        bucket = ((self.first >> U(32)) * U(buckets)) >> U(32)
        new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
        return bucket[new].astype(np.int64), np.append(new, len(bucket))

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """Of each word, whether a window covers it whose hash starts earlier: in another block, or here."""
        starts = np.zeros(self.words, np.int64)
        starts[self.whole[self.order[self.later | elsewhere[self.group]]]] = 1
        so_far = starts.cumsum()
        so_far[self.width :] -= so_far[: -self.width].copy()
        return so_far > 0


def dedup(docs: DataFrame, width: int = 20, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text",
          extra: int | None = None) -> DataFrame:
    """Remove every word that lies in a window of ``width`` words whose words, unchanged, also start earlier: in a
    document of smaller id, or in the same document at an earlier word. Windows are judged on the input.

    Words are runs of other characters than the six ASCII white ones. A null text has none. A null id is smaller than
    all others. Rows of equal id count as one document here: of their windows with equal words the one of earlier start
    stays, and windows of equal id and start stay both, so repeated rows have equal results, a row each. Texts shorter
    than a window stay whole. Extra columns are ignored; an empty table gives no rows.

    Rows that Spark reads in order of their ids are taken as they lie; others are first dealt by ranges of the id. Each
    block's different hashes go once to the bucket of their range. A window that very many documents hold comes once
    a block. A text longer than ``block_bytes`` goes in pieces to different blocks. Hashes have 64 bits and ``extra``
    bytes; the default follows the input's size, so that a chance meeting of two windows anywhere has a probability below 2^-16.

    Returns doc_id, n_words, n_removed, spans (maximal runs of removed words, array of (lo, hi)), kept (text, by one space).
    """
    if width < 2:
        raise ValueError("windows of two words at least")
    spark = prepare(docs.sparkSession)
    plain = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    try:
        rows = plain.withColumn("place", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    except AnalysisException:  # of several sources
        rows = plain.withColumn("place", F.lit(0).cast("long"))
    blocks = _blocks(rows, width, block_bytes) if _mostly_ascends(rows) else None
    if blocks is None or not _in_order(blocks):
        if blocks is not None:
            discard(blocks)
        dealt = plain.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
        blocks = _blocks(dealt.withColumn("place", F.lit(0).cast("long")), width, block_bytes)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    if extra is None:
        extra = min(8, max(1, math.ceil((2 * math.log2(max(2, total // 2)) + 16 - 64) / 8)))
    buckets = max(16, min(total // BUCKET_BYTES, block_bytes // 100))
    kind = blocks.schema["lo"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                block = Block(one.column("payload")[0].as_py(), width, extra)
                bucket, bounds = block.segments(buckets)
                single = one.column("single")[0].as_py()
                for at in range(0, len(bucket), 1000):
                    pairs = list(zip(bounds[at : at + 1000], bounds[at + 1 : at + 1001]))
                    size = len(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[at : at + 1000]), *(one.column(c).take(pa.array([0] * size)) for c in ("home", "block", "lo")),
                         pa.array([packed(block.first[a:b], block.second[a:b], extra) for a, b in pairs], pa.binary()),
                         pa.array([block.start[a:b].tobytes() if single else None for a, b in pairs], pa.binary())],
                        ["bucket", "home", "block", "lo", "hashes", "starts"])

    entries = blocks.select("home", "block", "lo", "single", "payload").mapInArrow(
        hashed, f"bucket long, home long, block long, lo {kind}, hashes binary, starts binary")

    def judged(held: list[tuple]) -> pa.RecordBatch | None:
        """Of one bucket's pieces, in order of lo: a bit for each hash that an earlier block has as well."""
        count = [struct.unpack_from("<I", h)[0] for _, _, _, h, _ in held]
        flags = [np.zeros(n, bool) for n in count]
        rounds = -(-sum(count) // TOGETHER)
        rank = np.concatenate([[0], np.cumsum([a[2] != b[2] for a, b in zip(held, held[1:])])]).astype(np.int64)
        least = min(struct.unpack_from("<IBBQ", h)[3] for _, _, _, h, _ in held)
        step = -(-((1 << 64) // buckets + 1) // rounds)
        for r in range(rounds):
            lows, parts = [], []
            for k, (_, _, _, raw, starts) in enumerate(held):
                first, second = unpacked(raw)
                lo, hi = (int(np.searchsorted(first, U(min((1 << 64) - 1, least + x * step)))) if 0 < x < rounds else (0 if not x else len(first)) for x in (r, r + 1))
                begin = np.frombuffer(starts, np.int64)[lo:hi] if starts is not None else np.zeros(hi - lo, np.int64)
                lows.append(lo)
                parts.append((first[lo:hi], second[lo:hi], np.full(hi - lo, rank[k]), begin))
            order, *_, beyond = later(*(np.concatenate(p) for p in zip(*parts)))
            found = np.empty(len(order), bool)
            found[order] = beyond
            ends = np.cumsum([len(p[0]) for p in parts])
            for k, (p, end) in enumerate(zip(parts, ends)):
                flags[k][lows[k] : lows[k] + len(p[0])] = found[end - len(p[0]) : end]
        hit = [k for k, f in enumerate(flags) if f.any()]
        if not hit:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([held[k][0] for k in hit], pa.int64()), pa.array([held[k][1] for k in hit], pa.int64()),
             pa.array([np.packbits(flags[k]).tobytes() for k in hit], pa.binary())], ["home", "block", "data"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            made = judged(held) if len(held) > 1 else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([*made.columns[:2], pa.array([now] * made.num_rows, pa.int64()), made.columns[2]], ["home", "block", "bucket", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "home", "block", "lo", "hashes", "starts"))):
                if row[0] != now:
                    yield from out()
                    held, now = [], row[0]
                held.append(row[1:])
        yield from out()

    replies = store(entries.repartition("bucket").sortWithinPartitions("bucket", "lo", "block").mapInArrow(counted, "home long, block long, bucket long, data binary"), "replies")
    # Each block's replies come before it, and the pieces of a long text one after the other.
    streams = replies.unionByName(blocks.select("home", "block", F.lit(None).cast("long").alias("bucket"), F.col("payload").alias("data")))
    streams = streams.repartition("home").sortWithinPartitions("home", "block", F.col("bucket").asc_nulls_last())

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, bytes] = {}
        long_text: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, data = batch.column("bucket")[k].as_py(), batch.column("data")[k].as_py()
                if bucket is not None:
                    told[bucket] = data
                    continue
                block = Block(data, width, extra)
                elsewhere = np.zeros(len(block.first), bool)
                own_buckets, bounds = block.segments(buckets)
                for b, lo, hi in zip(own_buckets.tolist(), bounds.tolist(), bounds[1:].tolist()):
                    if b in told:
                        elsewhere[lo:hi] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=hi - lo)
                told = {}
                gone = block.removed(elsewhere)
                out: list[tuple] = []
                for j, (text, doc) in enumerate(zip(block.texts, block.ids)):
                    here = gone[block.begin[j] : block.begin[j + 1]]
                    lead, own, at, last = (block.cut[c][j] for c in ("lead", "own", "first", "last"))
                    words = text.split()
                    if own >= 0:
                        words, here = words[lead : lead + own], here[lead : lead + own]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]]))) + at
                    kept = b" ".join(w for w, g in zip(words, here.tolist()) if not g) if len(edge) else b" ".join(words)
                    one = (doc, len(words), int(here.sum()), edge.tolist(), kept)
                    if last and not long_text:
                        out.append(one)
                        continue
                    long_text.append(one)
                    if last:
                        edges: list[int] = []
                        for _, _, _, found, _ in long_text:  # an interval that goes on behind a cut is one
                            edges = edges[:-1] + found[1:] if edges and found and edges[-1] == found[0] else edges + found
                        out.append((doc, sum(x[1] for x in long_text), sum(x[2] for x in long_text), edges, b" ".join(x[4] for x in long_text if x[4])))
                        long_text = []
                for lo in range(0, len(out), 512):
                    some = out[lo : lo + 512]
                    spans = [[{"lo": a, "hi": b} for a, b in zip(x[3][::2], x[3][1::2])] for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in some], block.id_type), *(pa.array([x[i] for x in some], pa.int64()) for i in (1, 2)),
                         pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array([x[4].decode() for x in some], pa.string())],
                        ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return streams.mapInArrow(cleaned, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>, kept string")
