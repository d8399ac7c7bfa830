"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import pick, prepare, store
from annalist.llm.graph import components
from annalist.llm.jaccard import grouped

#: Dimensions of a block.
WIDTH = 8


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix: it spreads what two vectors differ in over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(lo, min(dims, lo + WIDTH)) for lo in range(0, dims, WIDTH)]


def grid(rows: int, per_cell: int, radius: float) -> tuple[int, float]:
    """Leading coordinates of a block that make its grid, and the width of its cells: more and narrower cells for
    labels of more rows."""
    wanted = math.log2(max(1.0, rows / per_cell))
    if wanted <= WIDTH:
        return math.ceil(wanted), 4 * radius
    return min(WIDTH, math.ceil(wanted / 1.6)), 2 * radius


def touched(point: np.ndarray, radius: float, width: float) -> list[tuple[int, ...]]:
    """Cells other than its own, and after it in order, that the ball around a point reaches."""
    cells: list[tuple[tuple[int, ...], float]] = [((), 0.0)]
    own = tuple(int(c) for c in np.floor(point / width))
    for x, c in zip(point.tolist(), own):
        inner = x - c * width
        steps = [(c, 0.0)]
        steps += [(c - k, (inner + (k - 1) * width) ** 2) for k in range(1, math.ceil(radius / width) + 1)]
        steps += [(c + k, (k * width - inner) ** 2) for k in range(1, math.ceil(radius / width) + 1)]
        cells = [(cell + (step,), far + d) for cell, far in cells for step, d in steps if far + d <= radius * radius * (1 + 1e-6) + 1e-12]
    return [cell for cell, _ in cells if cell > own]


def near(own: np.ndarray, rows: np.ndarray, block: int, limit: float, threshold: float, budget: list[float],
         left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right, i < j where both hold the same places) within the block's budget whose cosine is at
    least ``threshold``, each in the first block alone whose budget it meets. One of the two must be the cell's own."""
    parts = blocks_of(rows.shape[1])
    lo, hi = parts[block]
    inner = np.ascontiguousarray(rows[:, lo:hi])
    squares = (inner * inner).sum(axis=1)
    for at in range(0, len(left), 512):
        mine = left[at : at + 512]
        far = squares[mine, None] + squares[right] - 2 * inner[mine] @ inner[right].T
        i, j = np.nonzero(far <= limit * (1 + 1e-6) + 1e-9)
        i, j = mine[i], right[j]
        fit = (own[i] | own[j]) & ((i < j) if left is right else True)
        i, j = i[fit], j[fit]
        for lo_pair in range(0, len(i), 50_000):
            a, b = i[lo_pair : lo_pair + 50_000], j[lo_pair : lo_pair + 50_000]
            apart = (rows[a] - rows[b]) ** 2
            met = np.stack([apart[:, x:y].sum(axis=1) <= t * (1 + 1e-9) + 1e-12 for (x, y), t in zip(parts, budget)], axis=1)
            first = met[:, block] & ~met[:, :block].any(axis=1)
            a, b = a[first], b[first]
            good = np.einsum("ij,ij->i", rows[a], rows[b]) >= threshold
            yield a[good], b[good]


def join(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``threshold``, and find the components of the links.

    Unit vectors u, v have |u - v|^2 = 2 - 2 cos. Rotated and cut into blocks of eight dimensions, a linked pair is
    within its share of that budget in one block at least. Each block is a range join: a grid over its leading
    coordinates, a vector in its own cell and in the later cells its ball reaches. A cell compares its vectors in that
    block, and checks the full cosine, in double precision, of all pairs within the budget. A pair counts in the first
    such block only. Labels of more rows get finer grids; a cell of more than ``cell_rows`` rows is cut into parts that
    meet in pairs of parts. A cell hands on counts and roots, not pairs. Equal vectors are one, with a number of copies.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; nor do rows without a
    label, or vectors of different lengths. A row of a repeated id counts as one of its own. Null ids are linked and
    counted, but never name a component, unless it has no other. Extra columns are ignored; an empty table gives no rows.

    Returns vec_id, n_links, component_id (the smallest id of the component), kept (vec_id = component_id).
    """
    prepare(vectors.sparkSession)
    limit = 2 - 2 * threshold
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rotated unit vectors, as bytes."""
        for batch in batches:
            out = []
            for v in batch.column("vector").to_pylist():
                x = np.array(v)
                x = x / np.abs(x).max()
                out.append((rotation(len(x)) @ (x / np.linalg.norm(x))).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("vector_key"), batch.column("least"), batch.column("copies"), pa.array(out, pa.binary())],
                                             ["label", "vector_key", "least", "copies", "turned"])

    # Equal vectors are equal in all their components; -0.0 counts as 0.0.
    keyed = store(rows.withColumn("vector_key", F.when(sound, F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256))), "vectors")
    unique = keyed.where("vector_key IS NOT NULL").groupBy("label", "vector_key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    turned_rows = store(
        unique.mapInArrow(turned, "label string, vector_key string, least long, copies long, turned binary").withColumn("set", F.monotonically_increasing_id()), "turned")
    sizes = turned_rows.groupBy("label").agg(F.count("*").alias("of_label"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dims", "block", "cell", "own", "set", "copies", "turned"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for label, of_label, item, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "of_label", "set", "copies", "turned"))):
                x = np.frombuffer(raw, "<f8")
                for k, (lo, hi) in enumerate(blocks_of(len(x))):
                    radius = math.sqrt(limit * (hi - lo) / len(x))
                    axes, width = grid(of_label, cell_rows, radius)
                    point = x[lo : min(hi, lo + axes)]
                    own = tuple(int(c) for c in np.floor(point / width))
                    for cell in [own, *touched(point, radius, width)]:
                        out.append((label, len(x), k, ",".join(map(str, cell)), cell == own, item, copies, raw))
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    cells = turned_rows.join(sizes, "label").select("label", "of_label", "set", "copies", "turned").mapInArrow(
        spread, "label string, dims long, block long, cell string, own boolean, set long, copies long, turned binary")
    key = ["label", "dims", "block", "cell"]
    parts = cells.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * cell_rows).select(
        *key, F.ceil(F.col("_n") / cell_rows).cast("long").alias("parts"))
    sided = cells.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn(
        "mine", F.pmod(F.xxhash64("set"), F.col("parts")))
    dealt = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        *key, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "own", "set", "copies", "turned")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (_, dims, block, _, lo, hi), group in grouped(batches, lambda r: (r["label"], r["dims"], r["block"], r["cell"], r["lo"], r["hi"])):
            if len(group) < 2:
                continue
            group.sort(key=lambda r: (r["mine"], r["set"]))
            x = np.frombuffer(b"".join(r["turned"] for r in group), "<f8").reshape(len(group), dims)
            own, copies = (np.array([r[c] for r in group]) for c in ("own", "copies"))
            budget = [limit * (b - a) / dims for a, b in blocks_of(dims)]
            left = np.flatnonzero(np.array([r["mine"] == lo for r in group]))
            right = left if lo == hi else np.flatnonzero(np.array([r["mine"] == hi for r in group]))
            links, parent = np.zeros(len(group), np.int64), np.arange(len(group))
            for a, b in near(own, x, block, budget[block], threshold, budget, left, right):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                # Roots hook on to the least root they are linked with, until both ends of every link agree.
                while len(a) and (parent[a] != parent[b]).any():
                    least = np.minimum(parent[a], parent[b])
                    np.minimum.at(parent, parent[a], least)
                    np.minimum.at(parent, parent[b], least)
                    while (parent != parent[parent]).any():
                        parent = parent[parent]
            out += [(group[i]["set"], int(links[i]), group[parent[i]]["set"]) for i in np.flatnonzero(links)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["set", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["set", "links", "root"])

    order = [*key, "lo", "hi"]
    found = store(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(compared, "set long, links long, root long"), "near")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    classed = turned_rows.drop("turned").join(links, "set", "left").join(roots, "set", "left")
    least = classed.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("of_root"))
    sets = classed.join(least, "root", "left").select(
        "label", "vector_key", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return keyed.select("vec_id", "label", "vector_key").join(sets, ["label", "vector_key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
