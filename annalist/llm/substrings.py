"""Removal of repeated byte strings, by a sparse suffix array over content-chosen anchors.

Every window of ``length`` bytes has one anchor: of the 32-byte grams that start in its first part, the one with the
least hash (the first such). The anchor depends on the window's bytes alone, so equal windows have their anchor at the same
place, and share at least ``lead`` bytes from it on. An anchor's windows start at neighbouring places; the bytes they
span are its stretch. Most anchors are settled by hashes of the lead and of the stretch: a stretch that occurs twice is
repeated as a whole, a lead that occurs once has no repeated window. What is left are stretches that share their lead with
different ones, at the edges of repeated passages. Those are the suffixes that are sorted and compared, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import pick, prepare, store, utf8

GRAM = 32
#: Windows looked at together; a place in them takes 24 bits.
CHUNK = 1 << 22


def reach_of(length: int) -> int:
    """Grams that compete for a window's anchor. The rest of the window, at least ``lead`` bytes, follows the anchor."""
    if length < 64:
        raise ValueError("strings of at least 64 bytes")
    return min(300, length - GRAM - 24)


def anchors(data: np.ndarray, reach: int) -> np.ndarray:
    """For each place the anchor of the window that starts there. Grams are hashed by doubling, and so are the minima."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, n = np.uint64(0x9E3779B97F4A7C15), 1
    while n < GRAM:
        h = h[:-n] * factor + h[n:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    total, n = len(low) - reach + 1, 1
    while 2 * n <= reach:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < reach:
        low = np.minimum(low[:total], low[reach - n :][:total])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window and anchor (places in ``data``) of every anchor's stretch inside one row."""
    reach = reach_of(length)
    found = []
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        own = anchors(part, reach)[: len(part) - length + 1] + at
        start = np.arange(at, at + len(own))
        row = np.searchsorted(offsets, start, side="right") - 1
        whole = start + length <= offsets[row + 1]
        start, own, row = start[whole], own[whole], row[whole]
        if len(start):
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
            first = np.flatnonzero(new)
            found.append((row[first], start[first], start[np.append(first[1:], len(start)) - 1], own[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def equal_windows(data: np.ndarray, base: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, group: np.ndarray,
                  length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the windows of stretches by multikey quicksort and tell which are equal.

    A stretch's bytes begin at ``base`` in ``data``; first, last and anchor are places in its text; stretches of equal
    ``group`` share the ``lead`` bytes from their anchor on. Windows are parted by (group, distance to the anchor), then by
    one character of 8 bytes after the other; a part that is down to one window is done. Characters that lie inside the
    lead are equal already. The outer ones come first, as differences lie there.

    Returns of every window its stretch, its start, and the number of its part (-1: equal to no other).
    """
    count = last - first + 1
    owner = np.repeat(np.arange(len(first)), count)
    start = first[owner] + np.arange(len(owner)) - np.repeat(count.cumsum() - count, count)
    place = base[owner] + start - first[owner]
    distance = anchor[owner] - start
    word = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : len(data) - 7 + k]
    live = np.lexsort((distance, group[owner]))
    head = np.concatenate([[True], (group[owner[live]][1:] != group[owner[live]][:-1]) | (distance[live][1:] != distance[live][:-1])])[: len(live)]
    places = sorted({*range(0, length - 7, 8), length - 8}, key=lambda p: min(p, length - 8 - p))
    for depth in [None, *places]:
        if depth is not None:
            inside = (depth >= distance[live]) & (depth + 8 <= distance[live] + lead)
            char = np.where(inside, np.uint64(0), word[place[live] + depth])
            part = head.cumsum() - 1
            if (char == char[np.flatnonzero(head)][part]).all():
                continue
            differs = np.zeros(part[-1] + 1, bool)
            differs[part[char != char[np.flatnonzero(head)][part]]] = True
            mixed = np.flatnonzero(differs[part])
            order = np.lexsort((char[mixed], part[mixed]))
            live[mixed] = live[mixed][order]
            char = char[mixed][order]
            head[mixed[1:]] |= (char[1:] != char[:-1]) & (np.diff(mixed) >= 0) & (part[mixed[1:]] == part[mixed[:-1]])
        alone = head & np.append(head[1:], True)
        live, head = live[~alone], head[~alone]
        if not len(live):
            break
    number = np.full(len(owner), -1, np.int64)
    number[live] = head.cumsum() - 1
    return owner, start, number


def runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts of one key, both ascending: key, first, last."""
    if not len(starts):
        return keys, starts, starts
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return keys[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def united(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching stretches of one key as one, all ascending: where each begins, its lo and its hi."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)])[: len(key)])
    return new, lo[new], hi[np.append(new[1:], len(hi)) - 1] if len(new) else hi


def dedup(docs: DataFrame, length: int = 400, bucket_bytes: int = 4_000_000, lead_stretches: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every byte that lies in a string of ``length`` bytes which also starts anywhere else, in the same text or
    another; overlaps count, and strings are judged on the input.

    Texts are their UTF-8 bytes, null ones empty; matches never cross texts; a text shorter than ``length`` stays whole;
    of equal texts long enough nothing is left, in any of them. Rows of equal or null id are rows of their own. Extra
    columns are ignored; an empty table gives no rows.

    Texts are known by 128 bits of hash. Stretches that meet in one batch count together before the shuffle; sampled
    splitters deal them by ranges of (lead, stretch), so a lead that very many share goes to many tasks. The suffixes left
    over are dealt by ranges of their leading bytes, and sorted about ``bucket_bytes`` at a time. A lead of more than
    ``lead_stretches`` different stretches is cut into parts, whose windows meet across their borders by their hashes.
    Work is proportional to the bytes of the texts.

    Returns doc_id, n_bytes, spans (array of removed (lo, hi)), kept (binary).
    """
    prepare(docs.sparkSession)
    lead = length - reach_of(length) + 1
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    names = ["kind", "k1", "k2", "lo", "hi", "anchor", "lead", "stretch", "n"]
    schema = ", ".join(f"{n} long" for n in names)
    MARK, STRETCH = 0, 1

    def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
        size = max(np.size(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(c, np.int64), size)) for c in columns], names)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            row, first, last, anchor = stretches(data, offsets, length)
            if not len(row):
                continue
            view, hashed = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
            leads = np.fromiter((hashed(view[a : a + lead]) for a in anchor.tolist()), np.uint64, len(row)).view(np.int64)
            whole = np.fromiter((hashed(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(row)).view(np.int64)
            order = np.lexsort((whole, leads))
            new = np.concatenate([[True], (leads[order][1:] != leads[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
            count = np.diff(np.append(np.flatnonzero(new), len(order)))
            seen = np.empty(len(order), np.int64)
            seen[order] = np.repeat(count, count)
            lo, hi, at = (x - offsets[row] for x in (first, last, anchor))
            twice = seen > 1
            if twice.any():
                at_row, from_, to = united(row[twice], lo[twice], hi[twice])
                own = row[twice][at_row]
                yield batch_of(MARK, k1[own], k2[own], from_, to, 0, 0, 0, 0)
            one = order[new]
            yield batch_of(STRETCH, k1[row][one], k2[row][one], lo[one], hi[one], at[one], leads[one], whole[one], np.minimum(seen[one], 2))

    first_marks = store(keyed.select("text", "k1", "k2").mapInArrow(chosen, schema), "anchors")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows in order of (lead, stretch): marks of repeated stretches, and one row of each stretch whose lead
        has another one. A lead at either end of the partition may go on elsewhere and counts as shared."""
        def handle(t: np.ndarray, head: bool, tail: bool) -> Iterator[pa.RecordBatch]:
            if not t.shape[1]:
                return
            leads, whole, n = t[6], t[7], t[8]
            new = np.concatenate([[True], (leads[1:] != leads[:-1]) | (whole[1:] != whole[:-1])])
            begin = np.flatnonzero(new)
            total = np.add.reduceat(n, begin)
            several = np.repeat(total > 1, np.diff(np.append(begin, len(n))))
            mark = several & (n == 1)
            if mark.any():
                found = t[1:5, mark]
                found = found[:, np.lexsort((found[2], found[1], found[0]))]
                text = np.concatenate([[0], ((found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])).cumsum()])
                at_text, from_, to = united(text, found[2], found[3])
                yield batch_of(MARK, found[0, at_text], found[1, at_text], from_, to, 0, 0, 0, 0)
            of_lead = leads[begin]
            fresh = np.concatenate([[True], of_lead[1:] != of_lead[:-1]])
            number = fresh.cumsum() - 1
            shared = np.bincount(number) > 1
            shared[0] |= head
            shared[-1] |= tail
            out = begin[shared[number]]
            if len(out):
                yield batch_of(STRETCH, *t[1:8, out], np.minimum(total[shared[number]], 2))

        held, head = np.zeros((len(names), 0), np.int64), True
        for batch in batches:
            t = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
            # The last stretch's rows wait for the next batch, and one earlier row of its lead tells that it is shared.
            cut = int(np.searchsorted((t[6] != t[6, -1]).astype(np.int8)[::-1], 1)) if t.shape[1] else 0
            stop = t.shape[1] - cut
            if stop or cut < 200_000:
                yield from handle(t[:, :stop], head, False)
                head, held = head and not stop, t[:, stop:]
            else:  # a lead with very many stretches: hand on all but its last stretch
                last = np.flatnonzero(t[7] != t[7, -1])
                stop = int(last[-1]) + 1 if len(last) else 0
                yield from handle(t[:, :stop], True, True)
                head, held = True, t[:, stop:]
                if held.shape[1] > 200_000:  # one stretch, more often than a batch holds: twice is all that counts
                    yield batch_of(MARK, *held[1:5, held[8] == 1], 0, 0, 0, 0)
                    held = held[:, :1].copy()
                    held[8] = 2
        yield from handle(held, head, True)

    dealt = first_marks.where(F.col("kind") == STRETCH).repartitionByRange("lead", "stretch").sortWithinPartitions("lead", "stretch")
    second_marks = store(dealt.mapInArrow(settled, schema), "stretches")

    # The bytes of what is left, from one row of each text.
    open_ = second_marks.where(F.col("kind") == STRETCH)
    common = open_.groupBy("lead").agg(F.count("*").alias("_n")).where(F.col("_n") > lead_stretches).select(
        "lead", F.ceil(F.col("_n") / lead_stretches).cast("long").alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("stretch"), F.col("parts")))
    wanted = open_.join(common, "lead", "left").withColumn("part", part).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("lo", "hi", "anchor", "lead", "stretch", "n", "part")).alias("wanted"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted"))):
                raw = text.encode()
                for lo in range(0, len(spans), 5000):
                    some = spans[lo : lo + 5000]
                    plain = [pa.array([s[c] for s in some], pa.int64()) for c in ("lo", "hi", "anchor", "lead", "stretch", "n", "part")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(some), pa.int64()) for k in (k1, k2)] + plain
                        + [pa.array([raw[s["lo"] : s["hi"] + length] for s in some], pa.binary()),
                           pa.array([raw[s["anchor"] : s["anchor"] + lead] for s in some], pa.binary())],
                        ["k1", "k2", "lo", "hi", "anchor", "lead", "stretch", "n", "part", "bytes", "suffix"])

    left = texts.mapInArrow(suffixes, "k1 long, k2 long, lo long, hi long, anchor long, lead long, stretch long, n long, part long, bytes binary, suffix binary")
    border = ["kind", "k1", "k2", "lo", "hi", "h1", "h2", "part"]
    OPEN, SEEN = 1, 2

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of windows that are equal to another of the bucket's; and of leads that are in parts, the hashes of
        all their different windows."""
        def batch_out(*columns: object) -> pa.RecordBatch:
            size = max(np.size(c) for c in columns)
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(c, np.int64), size)) for c in columns], border)

        def handle(held: list[dict]) -> Iterator[pa.RecordBatch]:
            held = list({(r["lead"], r["stretch"]): r for r in held}.values())
            if not held:
                return
            col = {c: np.array([r[c] for r in held], np.int64) for c in ("k1", "k2", "lo", "hi", "anchor", "n", "part")}
            size = np.array([len(r["bytes"]) for r in held])
            data = np.frombuffer(b"".join(r["bytes"] for r in held) + bytes(8), np.uint8)
            leads: dict[tuple, int] = {}
            group = np.array([leads.setdefault((r["suffix"], r["part"]), len(leads)) for r in held])
            base = size.cumsum() - size
            owner, start, number = equal_windows(data, base, col["lo"], col["hi"], col["anchor"], group, length, lead)
            mark = (number >= 0) & (col["n"][owner] == 1)
            key, lo, hi = runs(owner[mark], start[mark])
            if len(key):
                yield batch_out(MARK, col["k1"][key], col["k2"][key], lo, hi, 0, 0, 0)
            edge = np.flatnonzero(col["part"][owner] >= 0)
            _, one = np.unique(np.where(number[edge] >= 0, number[edge], len(owner) + edge), return_index=True)
            edge = edge[one]  # of equal windows, one
            waits = (number[edge] < 0) & (col["n"][owner[edge]] == 1)
            for lo in range(0, len(edge), 50_000):
                e, w = edge[lo : lo + 50_000], waits[lo : lo + 50_000]
                at = (base[owner[e]] + start[e] - col["lo"][owner[e]]).tolist()
                view = memoryview(data)
                found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a : a + length]) for a in at), "<i8").reshape(-1, 2)
                yield batch_out(np.where(w, OPEN, SEEN), col["k1"][owner[e]], col["k2"][owner[e]], start[e], start[e], found[:, 0], found[:, 1], col["part"][owner[e]])

        held, weight, now = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["suffix"], row["part"]) != now and weight > bucket_bytes:
                    yield from handle(held)
                    held, weight = [], 0
                now = row["suffix"], row["part"]
                held.append(row)
                weight += len(row["bytes"])
        yield from handle(held)

    bucketed = left.repartitionByRange("suffix", "part").sortWithinPartitions("suffix", "part", "stretch")
    third = store(bucketed.mapInArrow(compared, ", ".join(f"{n} long" for n in border)), "windows")
    waiting = third.where(F.col("kind") > MARK)
    across = waiting.groupBy("h1", "h2").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select("h1", "h2")
    met = waiting.where(F.col("kind") == OPEN).join(across, ["h1", "h2"], "left_semi")

    spans = ["k1", "k2", "lo", "hi"]
    marks = (first_marks.where(F.col("kind") == MARK).select(*spans).unionByName(second_marks.where(F.col("kind") == MARK).select(*spans))
             .unionByName(third.where(F.col("kind") == MARK).select(*spans)).unionByName(met.select(*spans)))
    # Copies of a text bring equal marks.
    by_text = marks.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sizes, removed, kept = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                    raw = text.encode()
                    union: list[list[int]] = []
                    for lo, hi in sorted((m["lo"], m["hi"] + length) for m in found or ()):
                        if union and lo <= union[-1][1]:
                            union[-1][1] = max(union[-1][1], hi)
                        else:
                            union.append([lo, hi])
                    ends = [0, *(x for u in union for x in u), len(raw)]
                    sizes.append(len(raw))
                    removed.append([{"lo": lo, "hi": hi} for lo, hi in union])
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return keyed.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(
        cleaned, f"doc_id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")
