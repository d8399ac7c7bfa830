"""BPE encoding and decoding with a vocabulary of the tokenizers library; long unsplit text by tree concatenation."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import freed, pick, prepare, slices, words_of

#: Texts with a run of this many characters without white space are cut there and joined again.
PIECE = 2048
#: Entries, and bytes (estimated), of a worker's table of known words; it starts anew when full, and ends with its task.
KNOWN, TABLE_BYTES = 300_000, 48 << 20
#: Words whose ids are gathered together.
TOGETHER = 1 << 17
#: Fixed value: how vocabularies of this kind split a text into words.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that lower one to one and stand alone in every normal form, and marks of which no added token is made.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!#$%&()*+,./:;=?@[]^_`{}~-"


class Column:
    """A growing array."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values: list[int]) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(self.n + len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """The library's tokenizer behind a table of words.

    White space never takes part in a token of this kind of vocabulary, and no normalisation step reaches across it,
    so a text's ids are those of its words in turn. Words are split and told apart in Arrow; each different run of
    letters, of marks, or other word goes to the library once per table.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = json.dumps(spec["pre_tokenizer"])
        if spec["model"]["type"] != "BPE" or spec["normalizer"]["type"] != "Sequence" or '"Removed"' not in pre:
            raise ValueError("a BPE vocabulary that drops white space is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        #: Merges symbols of a word's inside: no suffix on the last one.
        self.inner = BPE(model["vocab"], merges)
        self.closing = BPE(model["vocab"], merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.token_of = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.size = max(self.token_of) + 1
        # The library writes each byte as a character: printable ones as themselves, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(hidden)}
        lowers = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.simple = lowers and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        self.reset()

    def reset(self) -> None:
        """Forget all words."""
        #: Runs of characters that the library leaves in one piece, and words behind a blank; run 0 has no ids.
        self.runs: dict[str, int] = {"": 0}
        self.flat, self.ends = Column(np.uint32), Column(np.int64)
        self.ends.extend([0])
        self.weight = 0

    def _numbers(self, runs: list[str], whole: bool = False) -> np.ndarray:
        """The numbers of different runs, or of whole words, after new ones are encoded."""
        known = self.runs
        keys = [" " + r for r in runs] if whole else runs
        fresh = [k for k in keys if k not in known]
        if fresh:
            flat: list[int] = []
            ends: list[int] = []
            base = self.flat.n
            if whole:
                for e in self.library.encode_batch([k[1:] for k in fresh], add_special_tokens=False):
                    flat.extend(e.ids)
                    ends.append(base + len(flat))
            else:
                merge, shown = self.closing.tokenize, self.shown
                for k in fresh:
                    flat.extend([t.id for t in merge(k if k.isascii() else k.encode().decode("latin-1").translate(shown))])
                    ends.append(base + len(flat))
            known.update(zip(fresh, range(self.ends.n, self.ends.n + len(fresh))))
            self.flat.extend(flat)
            self.ends.extend(ends)
            self.weight += sum(map(len, fresh)) + 180 * len(fresh) + 4 * len(flat)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def _runs_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of different words: the numbers of one or two runs each."""
        one, two = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = np.zeros(len(words), bool)
        if self.simple:
            letters = pc.utf8_rtrim(words, characters=MARKS)
            plain = pc.match_substring_regex(letters, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
            marked = np.flatnonzero(plain & (pc.binary_length(words).to_numpy() > pc.binary_length(letters).to_numpy()))
            for into, at, runs in ((one, np.flatnonzero(plain), pc.utf8_lower(letters.filter(pa.array(plain)))),
                                   (two, marked, pc.replace_substring_regex(words.take(pa.array(marked)), f"^[{LETTERS}]+", ""))):
                coded = runs.dictionary_encode()
                if len(at):
                    into[at] = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        other = np.flatnonzero(~plain & (pc.binary_length(words).to_numpy() > 0))
        for lo in range(0, len(other), 5_000):
            some = other[lo : lo + 5_000]
            one[some] = self._numbers(words.take(pa.array(some)).to_pylist(), True)
        return one, two

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null: none. For texts without very long words. Only different words leave Arrow."""
        if self.weight > TABLE_BYTES or len(self.runs) > KNOWN:
            self.reset()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # White space is the six characters that are ASCII, and nothing else.
        words = pc.ascii_split_whitespace(column.fill_null(""))
        size = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        one, two = self._runs_of(coded.dictionary)
        numbers = coded.indices.to_numpy()
        lengths = np.diff(self.ends.held[: self.ends.n], prepend=0)
        bounds = np.concatenate([[0], (lengths[one] + lengths[two])[numbers].cumsum()])
        ids = np.empty(bounds[-1], np.uint32)
        for lo in range(0, len(numbers), TOGETHER):
            some = numbers[lo : lo + TOGETHER]
            run = np.empty(2 * len(some), np.int64)
            run[::2], run[1::2] = one[some], two[some]
            run = run[run > 0]
            count = lengths[run]
            after = count.cumsum()
            at = np.repeat(self.ends.held[run] - after, count) + np.arange(after[-1] if len(after) else 0)
            ids[bounds[lo] : bounds[lo + len(some)]] = self.flat.held[at]
        ends = bounds[np.concatenate([[0], size.cumsum()])]
        return [ids[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]

    # Long unsplit text.

    def split(self, text: str) -> list[str]:
        """The library's words of a text that holds no added token, as strings of the model's symbols."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def symbols(self, word: str, closes: bool) -> list[int]:
        return [t.id for t in (self.closing if closes else self.inner).tokenize(word)] if word else []

    def spelled(self, ids: list[int]) -> str:
        """The model's symbols that ``ids`` stand for, without the mark of a word's end."""
        return "".join(self.token_of[i].removesuffix(self.suffix) if self.suffix else self.token_of[i] for i in ids)

    def join(self, left: list[int], right: list[int], closes: bool, window: int = 4) -> list[int]:
        """The ids of two neighbouring pieces' common text.

        A window of ids around the join is encoded again, and grows until its outermost ids on both sides agree with
        what stands there already. Every neighbouring pair of ids is then a pair that the merges themselves make, and
        a row of ids whose pairs all are so is the encoding of its text. A window that has reached the end of a side
        needs no agreement there.
        """
        if not left or not right:
            return left + right
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            middle = self.symbols(self.spelled(left[-a:] + right[:b]), closes and b == len(right))
            at_left = a == len(left) or middle[0] == left[-a]
            at_right = b == len(right) or middle[-1] == right[b - 1]
            if at_left and at_right and (len(middle) > 1 or (a == len(left) and b == len(right))):
                return left[: len(left) - a] + middle + right[b:]
            window *= 2

    def tree(self, pieces: list[list[int]], closes: bool) -> list[int]:
        """Join neighbouring pieces in pairs, level by level."""
        while len(pieces) > 1:
            last = len(pieces) - 2
            pieces = [self.join(pieces[i], pieces[i + 1], closes and i >= last) if i + 1 < len(pieces) else pieces[i]
                      for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> list[str]:
    """Each id's token, from the file alone."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    token_of = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    return [token_of.get(i, "") for i in range(max(token_of) + 1)]


def decode(ids: np.ndarray, path: str) -> str:
    """The library's text for ids of a vocabulary without a decoder: tokens with blanks between, special ones too."""
    tokens = tokens_of(path)
    return " ".join(map(tokens.__getitem__, ids.tolist()))


def halves(n: int, piece: int) -> list[tuple[int, int]]:
    """Cut [0, n) in halves until no part is longer than ``piece``."""
    parts = [(0, n)]
    while parts and parts[0][1] - parts[0][0] > piece:
        parts = [p for lo, hi in parts for p in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    return parts


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The ids of every whole text: doc_id and ids (little-endian unsigned 32-bit).

    Texts without a run of ``piece`` characters free of white space are encoded word by word where they lie. The
    others are split as the library splits them; each very long word becomes pieces by halving, which are encoded in
    different tasks, and joined by ``Encoder.join`` in a tree. Null and empty texts give no ids. Repeated rows
    give repeated results; a null id stays null; extra columns are ignored; an empty table gives no rows.
    A text's added tokens (their literal strings) are taken as the library takes them.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[docs.columns.index(id_col)].dataType.simpleString()
    rows = pick(docs, doc_id=id_col, text=text_col)
    unsplit = F.coalesce(F.col("text").rlike(rf"(^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{{{piece + 1}}}"), F.lit(False))

    def simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        try:
            for part in chain.from_iterable(map(slices, batches)):
                ids = [x.astype("<u4").tobytes() for x in enc.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        finally:
            enc.reset()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a text in order: ids that are ready, or one piece of a long word."""
        enc = encoder(vocabulary)
        added = [enc.token_of[i] for i in enc.library.get_added_tokens_decoder()]
        for batch in batches:
            for row, doc, text in zip(batch.column("_row").to_pylist(), batch.column("doc_id"), batch.column("text").to_pylist()):
                out: list[tuple[int, int, str | None, bytes | None, bool]] = [(-1, 0, None, b"", True)]  # a row at least
                for segment, chunk in segments(text, added, piece):
                    if not segment:
                        ids = enc.encode([chunk])[0]
                        out.append((len(out), 0, None, ids.astype("<u4").tobytes(), True))
                        continue
                    for word in enc.split(chunk):
                        parts = halves(len(word), piece)
                        at = len(out)
                        out += [(at, k, word[lo:hi], None, k == len(parts) - 1) for k, (lo, hi) in enumerate(parts)]
                for lo in range(0, len(out), 1024):
                    some = out[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([doc.as_py()] * len(some), batch.schema.field("doc_id").type),
                         *(pa.array([s[j] for s in some], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())))],
                        ["_row", "doc_id", "word", "part", "text", "ids", "closes"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            text, ids, closes = (batch.column(c).to_pylist() for c in ("text", "ids", "closes"))
            done = [i if t is None else np.array(enc.symbols(t, c), "<u4").tobytes() for t, i, c in zip(text, ids, closes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "doc_id", "word", "part")), pa.array(done, pa.binary())],
                                             ["_row", "doc_id", "word", "part", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document: its segments' ids, in order."""
        enc = encoder(vocabulary)
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                parts = sorted(parts or [], key=lambda p: (p["word"], p["part"]))
                ids: list[np.ndarray] = []
                lo = 0
                while lo < len(parts):
                    hi = lo
                    while hi < len(parts) and parts[hi]["word"] == parts[lo]["word"]:
                        hi += 1
                    have = [np.frombuffer(p["ids"], "<u4") for p in parts[lo:hi]]
                    ids.append(have[0] if hi - lo == 1 else np.array(enc.tree([h.tolist() for h in have], True), "<u4"))
                    lo = hi
                out.append(b"".join(x.tobytes() for x in ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    plain = rows.where(~unsplit).mapInArrow(freed(simple), f"doc_id {kind}, ids binary")
    numbered = rows.where(unsplit).withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.mapInArrow(freed(cut), f"_row long, doc_id {kind}, word long, part long, text string, ids binary, closes boolean")
    done = spread.repartition("_row", "word", "part").mapInArrow(freed(pieces), f"_row long, doc_id {kind}, word long, part long, ids binary")
    gathered = done.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("word", "part", "ids")).alias("parts"))
    long = gathered.select("doc_id", "parts").mapInArrow(freed(joined), f"doc_id {kind}, ids binary")
    return plain.unionByName(long)


def segments(text: str, added: list[str], piece: int) -> list[tuple[bool, str]]:
    """Cut a text into (long, string): runs longer than ``piece`` without white space and without an added token
    stand alone, and all else stays together. Added tokens are taken out first, as the library does."""
    out: list[tuple[bool, str]] = []
    rest: list[str] = []
    for word in words_of(text):
        if len(word) <= piece:
            rest.append(word)
            continue
        spans = [word]
        for token in sorted(added, key=len, reverse=True):
            spans = [s for span in spans for k, x in enumerate(span.split(token)) for s in ([token, x] if k else [x])] if token in word else spans
        for span in spans:
            if len(span) <= piece:
                if span:
                    rest.append(span)
                continue
            if rest:
                out.append((False, " ".join(rest)))
                rest = []
            out.append((True, span))
    if rest:
        out.append((False, " ".join(rest)))
    return out


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows; the text is decoded from the ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i) for i in range(len(tokens_of(vocabulary)))]
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u4")
                count.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(decode(ids, vocabulary).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(freed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def opened(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded (string) of encoded rows."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                rows = [np.frombuffer(raw, "<u4") for raw in part.column("ids").to_pylist()]
                flat = np.concatenate(rows).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array([decode(r, vocabulary) for r in rows], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(freed(run), f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")
