"""Token ids in files: a static range asymmetric numeral system with shared frequencies, blocks and checkpoints.

A folder holds ``table`` (the frequencies) and ``blocks``: binary files, a sequence of records with a line feed after
each. A record is one block: a fixed header, the states of all lanes at each checkpoint, the coded 32-bit words, and
the directory of the documents that have ids in it. A block is coded by ``lanes`` interleaved coders that share one
word stream; a checkpoint holds all their states and the place in the stream, so segments decode side by side.
Blocks stand alone; ids and words have a checksum each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.bpe import encoder
from annalist.llm.common import discard, freed, new_folder, pick, prepare, slices, store

PRECISION = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
#: Record: magic, length, part, first document's place in the part, does it go on with that document, ids, lanes, steps a segment,
#: segments, words, documents, checksums of the table, of the ids and of all that follows the header.
HEADER = struct.Struct("<4sQqqBIIIIIIIII")
MAGIC = b"RAN1"


@dataclass(frozen=True)
class Table:
    """Shared frequencies: of each symbol in use its id, share of 2 ** PRECISION, and the sum of shares before it."""

    ids: np.ndarray
    share: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(counts: dict[int, int]) -> Table:
        ids = np.array(sorted(counts), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        if len(ids) > 1 << (PRECISION - 1):
            raise ValueError("too many distinct ids for this precision")
        room = (1 << PRECISION) - len(ids)
        share = 1 + np.floor(n / max(1.0, n.sum()) * room).astype(np.int64)
        if len(ids):
            share[int(np.argmax(n))] += (1 << PRECISION) - int(share.sum())
        return Table(ids, share, np.concatenate([[0], share.cumsum()[:-1]]) if len(ids) else share)

    @property
    def mark(self) -> int:
        return zlib.crc32(self.ids.astype("<i8").tobytes() + self.share.astype("<i8").tobytes())


def code_blocks(ids: np.ndarray, table: Table, lanes: int, segment: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code equal blocks at once. ``ids``: (blocks, steps x lanes) numbers of symbols. Per block: words, states
    (segments, lanes) and the word offset of each segment."""
    blocks, width = ids.shape
    steps = width // lanes
    cells = ids.reshape(blocks, steps, lanes)
    share, before = table.share.astype(np.uint64), table.before.astype(np.uint64)
    state = np.full((blocks, lanes), LOW, np.uint64)
    out: list[tuple[np.ndarray, np.ndarray]] = [None] * steps  # type: ignore[list-item]
    marks = {}
    limit, bits = np.uint64(63 - PRECISION), np.uint64(PRECISION)
    for step in range(steps - 1, -1, -1):
        now = cells[:, step]
        f = share[now]
        full = state >= (f << limit)
        out[step] = (full, state[full].astype(np.uint32))
        state = np.where(full, state >> WORD_BITS, state)
        q = state // f
        state = (q << bits) + (state - q * f) + before[now]
        if step % segment == 0:
            marks[step // segment] = state
    counts = np.stack([full.sum(axis=1) for full, _ in out])  # steps x blocks
    results = []
    for b in range(blocks):
        lo = np.concatenate([np.zeros((steps, 1), np.int64), counts.cumsum(axis=1)], axis=1)
        words = np.concatenate([w[lo[s, b] : lo[s, b + 1]] for s, (_, w) in enumerate(out)]) if steps else np.zeros(0, np.uint32)
        at = np.concatenate([[0], counts[:, b].cumsum()])
        order = sorted(marks)
        results.append((words, np.stack([marks[k][b] for k in order]), at[[k * segment for k in order]]))
    return results


def decode_block(words: np.ndarray, states: np.ndarray, offsets: np.ndarray, segment: int, steps: int, table: Table) -> np.ndarray:
    """Numbers of symbols of one block, in order. All segments walk side by side."""
    segments, lanes = states.shape
    symbol = slots(table)
    share, before = table.share.astype(np.uint64), table.before.astype(np.uint64)
    state, at = states.copy(), offsets.astype(np.int64).copy()
    out = np.zeros((segments, segment, lanes), np.uint32)
    mask, bits = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    words = np.concatenate([words.astype(np.uint64), np.zeros(1, np.uint64)])
    last = steps - (segments - 1) * segment
    live = segments
    for step in range(segment):
        if step == last:  # the last segment may be shorter
            live -= 1
            if not live:
                break
            state, at = state[:live], at[:live]
        slot = state & mask
        s = symbol[slot]
        out[:live, step] = s
        state = share[s] * (state >> bits) + slot - before[s]
        short = state < LOW
        place = at[:, None] + short.cumsum(axis=1)
        state = np.where(short, (state << WORD_BITS) | words[np.where(short, place - 1, len(words) - 1)], state)
        at = place[:, -1]
    return out.reshape(segments * segment, lanes)[:steps].reshape(-1)


_slots: dict[int, np.ndarray] = {}


def slots(table: Table) -> np.ndarray:
    if table.mark not in _slots:
        _slots.clear()
        _slots[table.mark] = np.repeat(np.arange(len(table.share), dtype=np.uint32), table.share)
    return _slots[table.mark]


class Run:
    """Documents in order, cut into blocks."""

    def __init__(self, part: int, table: Table, block_ids: int, lanes: int, segment: int, together: int = 4) -> None:
        self.part, self.table, self.block_ids, self.lanes, self.segment, self.together = part, table, block_ids, lanes, segment, together
        self.pending: list[np.ndarray] = []
        self.docs: list[list] = []  # place, id (None: null), ids still to be written
        self.have = 0
        self.split = False  # the first pending document began in an earlier block
        self.number = np.zeros(int(table.ids[-1]) + 1 if len(table.ids) else 1, np.int64)
        self.number[table.ids] = np.arange(len(table.ids))

    def add(self, place: int, doc: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append([place, doc, len(ids)])
        self.pending.append(ids)
        self.have += len(ids)
        if self.have >= self.block_ids * self.together:
            yield from self.flush(False)

    def flush(self, end: bool) -> Iterator[bytes]:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(flat) // self.block_ids
        parts = [flat[: whole * self.block_ids].reshape(whole, self.block_ids)] if whole else []
        rest = flat[whole * self.block_ids :]
        if end and len(rest):
            parts.append(rest[None])
            rest = rest[:0]
        for group in parts:
            n = group.shape[1]
            numbers = self.number[group]
            pad = -n % self.lanes
            if pad:
                numbers = np.concatenate([numbers, np.full((len(group), pad), int(np.argmax(self.table.share)))], axis=1)
            for ids, coded in zip(group, code_blocks(numbers, self.table, self.lanes, self.segment)):
                yield self.record(ids, *coded)
        self.pending, self.have = [rest] if len(rest) else [], len(rest)

    def record(self, ids: np.ndarray, words: np.ndarray, states: np.ndarray, offsets: np.ndarray) -> bytes:
        left, listed = len(ids), []
        first, split = self.docs[0][0], self.split
        while left:
            doc = self.docs[0]
            take = min(left, doc[2])
            left -= take
            listed.append((doc[1] is None, doc[1] or 0, take, take == doc[2]))
            doc[2] -= take
            if not doc[2]:
                self.docs.pop(0)
        self.split = not listed[-1][3]
        body = b"".join([
            states.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u4").tobytes(),
            np.array([x[1] for x in listed], "<i8").tobytes(), np.array([x[2] for x in listed], "<u4").tobytes(),
            np.array([x[0] + 2 * x[3] for x in listed], "<u1").tobytes()])
        return HEADER.pack(MAGIC, HEADER.size + len(body), self.part, first, split, len(ids), self.lanes, self.segment, len(states), len(words),
                           len(listed), self.table.mark, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def records(data: memoryview) -> Iterator[tuple[tuple, memoryview]]:
    """Header and body of each record of a file, checked."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("a token file ends inside a header")
        head = HEADER.unpack_from(data, at)
        if head[0] != MAGIC or at + head[1] > len(data):
            raise ValueError("not a record of a token file, or cut off")
        body = data[at + HEADER.size : at + head[1]]
        if zlib.crc32(body) != head[13]:
            raise ValueError("a block's words do not match their checksum")
        yield head, body
        at += head[1] + 1


def ids_of(head: tuple, body: memoryview, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, and its directory: document ids, counts, flags (1: null id, 2: ends here)."""
    n, lanes, segment, segments, words, docs, mark, sum_ids = head[5:13]
    if mark != table.mark:
        raise ValueError("a block was coded with another table")
    cut = np.cumsum([0, 8 * segments * lanes, 4 * segments, 4 * words, 8 * docs, 4 * docs, docs])
    states, offsets, coded, doc, count, flags = (np.frombuffer(body[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "<u4", "<u4", "<i8", "<u4", "<u1")))
    steps = -(-n // lanes)
    numbers = decode_block(coded, states.reshape(segments, lanes), offsets, segment, steps, table)[:n]
    ids = table.ids[numbers].astype("<u4")
    if zlib.crc32(ids.tobytes()) != sum_ids:
        raise ValueError("a block's ids do not match their checksum")
    return ids, doc, count, flags


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
          block_ids: int = 1 << 20, lanes: int = 1024, segment: int = 256) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of the integer id.

    Null and empty texts have the end id alone. Null ids come first; rows of equal id are ordered by a hash of
    their text, then stay as they meet. Extra columns are ignored; an empty table gives a folder without blocks.
    Documents are dealt by ranges of (id, hash), each range is one part in order. A part's ids are stored once,
    since the table of frequencies needs all counts first; counts are summed per task, then over tasks, and the driver
    gets one row per id of the vocabulary.
    """
    spark = prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(vocabulary), TaskContext.get().partitionId(), 0
        if max(enc.size, end_id + 1) > 1 << 32:
            raise ValueError("ids need 32 bits at most")
        counts = np.zeros(max(enc.size, end_id + 1), np.int64)
        small = len(counts) <= 1 << 16
        for batch in batches:
            for piece in slices(batch):
                found = [np.append(ids, np.uint32(end_id)) for ids in enc.encode(piece.column("text"))]
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
                raw = [ids.astype("<u2" if small else "<u4").tobytes() for ids in found]
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), piece.column("doc_id"), pa.array(raw, pa.binary())],
                    ["part", "place", "doc_id", "ids"])
                place += n
        enc.reset()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()),
             pa.array([used.astype("<i8").tobytes() + counts[used].astype("<i8").tobytes()], pa.binary())], ["part", "place", "doc_id", "ids"])

    width = 2 if max(encoder(vocabulary).size, end_id + 1) <= 1 << 16 else 4
    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    held = store(ordered.select("doc_id", "text").mapInArrow(freed(tokenize), "part long, place long, doc_id long, ids binary"), "ids")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                both = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(both[: len(both) // 2]), pa.array(both[len(both) // 2 :])], ["id", "n"])

    counted = held.where("place = -1").select("ids").mapInArrow(freed(unpacked), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = Table.of({r["id"]: r["n"] for r in counted.collect()})
    spark.createDataFrame([(int(i), int(s)) for i, s in zip(table.ids, table.share)], "id long, share long").coalesce(1).write.parquet(f"{folder}/table")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, next_place = None, 0

        def out(made: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for record in made:
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

        for batch in batches:
            columns = (batch.column(c) for c in ("part", "place", "doc_id", "ids"))
            for part, place, doc, raw in zip(*(c.to_pylist() for c in columns)):
                if run is None or part != run.part or place != next_place:
                    if run:
                        yield from out(run.flush(True))
                    run = Run(part, table, block_ids, lanes, segment)
                next_place = place + 1
                yield from out(run.add(place, doc, np.frombuffer(raw, f"<u{width}").astype(np.uint32)))
        if run:
            yield from out(run.flush(True))

    made = held.where("place >= 0").mapInArrow(freed(coded), "record binary")
    # The text writer puts the bytes of a string down as they are.
    made.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(f"{folder}/blocks")
    discard(held)


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = sorted(spark.read.parquet(f"{folder}/table").collect())
    ids, share = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    return Table(ids, share, np.concatenate([[0], share.cumsum()[:-1]]) if len(ids) else share)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder: part, place, doc_id, run, run_start (ids before it in its run), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), and with ``with_ids`` the ids. Raises ValueError
    in the task when a record is cut off or a checksum differs."""
    prepare(spark)
    table = read_table(spark, folder)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                before = None  # of the run: part, next place, ids so far, and of the open document: crc, ids, pieces
                for head, body in records(memoryview(content.as_buffer())):
                    ids, doc, count, flags = ids_of(head, body, table)
                    part, first, split = head[2:5]
                    if not split and (before is None or before["part"] != part or before["place"] != first):
                        before = {"part": part, "place": first, "run": first, "ids": 0, "crc": 0, "n": 0, "pieces": []}
                    if before is None or (before["part"], before["place"]) != (part, first):
                        raise ValueError("a block that goes on with a document does not follow its first block")
                    raw, at, out = ids.tobytes(), 0, []
                    for d, c, f in zip(doc.tolist(), count.tolist(), flags.tolist()):
                        piece = raw[4 * at : 4 * (at + c)]
                        at += c
                        before["crc"] = zlib.crc32(piece, before["crc"])
                        before["n"] += c
                        if with_ids:
                            before["pieces"].append(piece)
                        if f & 2:
                            row = (part, before["place"], None if f & 1 else d, before["run"], before["ids"], before["n"], before["crc"])
                            out.append(row + ((b"".join(before["pieces"]),) if with_ids else ()))
                            before |= {"place": before["place"] + 1, "ids": before["ids"] + before["n"], "crc": 0, "n": 0, "pieces": []}
                    if out:
                        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], NAMES + ["ids"] * with_ids)

    files = spark.read.format("binaryFile").load(f"{folder}/blocks").where("length > 0").select("content")
    return files.mapInArrow(freed(decoded), ", ".join(f"{n} long" for n in NAMES) + ", ids binary" * with_ids)


NAMES = ["part", "place", "doc_id", "run", "run_start", "n_tokens", "ids_crc32"]


def starts(read_rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Only one sum per run is put in order."""
    held = store(read_rows, "read")
    sums = held.groupBy("part", "run").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(bases, ["part", "run"]).select("doc_id", (F.col("_base") + F.col("run_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new shared folder and describe its documents from the files."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write(docs, folder, vocabulary)
    return starts(read(spark, folder))
