"""Quality rules: fixed rules first, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_sample, freed, pick, prepare, slices, words_of

BLANKS = " \t\n\v\f\r"
SYMBOLS = str.maketrans("", "", "#*$%&|<>")

#: Statistics that the trees see, and the way each may move the score of being poor: 1 only up, 0 freely.
FEATURES = {
    "symbols_per_char": 1, "dup_line_share": 1, "repeat_share": 1, "shouted_share": 1, "top_word_share": 1, "log_words": 0,
}


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text, and its features."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if len(set(zip(words, words[1:], words[2:]))) < n - 2:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        reach = 0  # the first word not yet counted
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeat += at + 3 - max(at, reach)
                reach = at + 3
    top = Counter(words).most_common(1)[0][1] if n else 0
    features = [
        symbols / max(1, chars), dup / max(1, len(lines)), repeat / max(1, n), sum(map(str.isupper, words)) / max(1, n),
        # A word that is frequent in a short text says nothing: at least 20 words count.
        top / max(20, n), float(np.log1p(n)),
    ]
    return n, chars, symbols, dup, repeat, features


@dataclass
class Forest:
    """Trees as flat node arrays: a node has a feature (-1: leaf), a threshold (at most: left), children and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    edges: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows walk one tree together, level by level."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2,
        bins: int = 64, least_rows: int = 20, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` regression trees on the logistic loss of ``y`` (1: poor), over histograms of ``bins`` bins.

    A split on a feature of sign s is taken only if s x (right value - left value) >= 0, and its middle value bounds
    both subtrees from then on, so that the sum of trees is monotonic in that feature everywhere.
    """
    rows, cols = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(cols)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(cols)], axis=1)
    rate0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    odds = np.full(rows, base)
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}

    def add(value: float) -> int:
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            nodes[name].append(v)
        return len(nodes["value"]) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(min(max(-g / (h + ridge), low), high))

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = p - y, p * (1 - p)

        def grow(index: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[index].sum(), hess[index].sum()
            here = add(rate * weight(g, h, low, high))
            if level == depth or len(index) < 2 * least_rows:
                odds[index] += nodes["value"][here]
                return here
            best = None
            for j in range(cols):
                k = len(edges[j]) + 1
                b = binned[index, j]
                gs, hs = np.bincount(b, grad[index], k).cumsum(), np.bincount(b, hess[index], k).cumsum()
                ns = np.bincount(b, minlength=k).cumsum()
                for cut in np.flatnonzero((ns[:-1] >= least_rows) & (ns[:-1] <= len(index) - least_rows)):
                    gl, hl, gr, hr = gs[cut], hs[cut], g - gs[cut], h - hs[cut]
                    vl, vr = weight(gl, hl, low, high), weight(gr, hr, low, high)
                    if signs[j] * (vr - vl) < 0:
                        continue
                    gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g * g / (h + ridge)
                    if best is None or gain > best[0]:
                        best = (gain, j, cut, vl, vr)
            if best is None or best[0] < 1e-6:
                odds[index] += nodes["value"][here]
                return here
            _, j, cut, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            goes = binned[index, j] <= cut
            nodes["feature"][here], nodes["threshold"][here] = j, float(edges[j][cut])
            nodes["left"][here] = grow(index[goes], level + 1, *bounds[0])
            nodes["right"][here] = grow(index[~goes], level + 1, *bounds[1])
            return here

        roots.append(grow(np.arange(rows), 0, -np.inf, np.inf))
    return Forest(*(np.array(nodes[n]) for n in ("feature", "threshold", "left", "right", "value")), np.array(roots), base, edges)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """Fit on at most ``sample_rows`` labelled documents, those of the smallest keyed hash of their id (all, if fewer).

    A document that carries several labels counts for each. Labels without a quality or a document are left out.
    Without both a good and a poor document there is no forest (None), and the fixed rules decide alone.
    """
    prepare(docs.sparkSession)
    marked = pick(labels, _id=id_col, _quality="quality").where("_id IS NOT NULL AND _quality IS NOT NULL")
    sample = bounded_sample(marked, sample_rows, "_id", "_quality")
    known = pick(docs, _doc=id_col, _text=text_col).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t)[5] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").cast(pa.int64()), batch.column("_quality").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                ["doc", "quality", "features"])

    # Repeated ids could bring more rows than labels; the bound holds for what the driver gets.
    rows = sorted(known.mapInArrow(freed(measured), "doc long, quality int, features array<double>").limit(4 * sample_rows).collect())
    if not rows:
        return None
    x = np.array([r["features"] for r in rows])
    y = np.array([1.0 if r["quality"] <= 0 else 0.0 for r in rows])
    return fit(x, y, list(FEATURES.values())) if 0 < y.sum() < len(y) else None


def judge(docs: DataFrame, forest: Forest | None, poor_above: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row, over its whole text.

    A text of fewer than 50 words, or with more than half of its words inside repeated three-word windows, fails the
    base rules. Of the others, those whose score of being poor exceeds ``poor_above`` are not kept. Null and empty
    texts have no words and fail the base rules; repeated rows are judged alike; a null id stays null; extra columns
    are ignored; an empty table gives no rows. Narrow work on one row: nothing is shuffled.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, poor.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *verdict(found, forest, poor_above)], NAMES)

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(freed(run), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean, poor double")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "poor"]


def verdict(found: list[tuple], forest: Forest | None, poor_above: float) -> list[pa.Array]:
    base = np.array([f[:5] for f in found], np.int64).reshape(-1, 5)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    x = np.array([f[5] for f in found]).reshape(-1, len(FEATURES))
    poor = 1 / (1 + np.exp(-forest.score(x))) if forest else np.zeros(len(x))
    return [*(pa.array(base[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (poor <= poor_above)), pa.array(poor)]


def keep(docs: DataFrame, forest: Forest | None, poor_above: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with all their columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 512):
                found = [statistics(t) for t in part.column(at).to_pylist()]
                yield part.filter(verdict(found, forest, poor_above)[6])

    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(freed(run), plain.schema).toDF(*docs.columns)
