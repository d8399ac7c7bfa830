"""Sentence segments of articles and the predicates inside them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist import vocab
from annalist.session import ship

UNIT = T.StructType([T.StructField("text", T.StringType()), T.StructField("paragraph", T.IntegerType()), T.StructField("list_boundary", T.BooleanType())])
LEXICON = vocab.Lexicon()


_BREAKS, _INDEX, _DATE = re.compile("[\\r\\n]+"), re.compile(vocab.INDEX_LINE, re.ASCII), re.compile(vocab.INLINE_DATE)
_INDEX_WORD = "活动更多>>"


def units_of(text: str, sentences: re.Pattern[str]) -> list[tuple[str, int, bool]]:
    """(text, paragraph, list_boundary) of the segments of one text, in order. Most sentences hold no list entry."""
    out = []
    for number, paragraph in enumerate(_BREAKS.split(text)):
        for sentence in sentences.findall(" ".join(paragraph.split())):
            sentence = sentence.strip(" ")
            if _INDEX_WORD not in sentence and " 20" not in sentence:
                if len(sentence) >= vocab.MIN_SEGMENT:
                    out.append((sentence, number, False))
                continue
            for line in _INDEX.split(sentence):
                for k, part in enumerate(_DATE.split(line)):
                    part = part.strip(" ")
                    if len(part) >= vocab.MIN_SEGMENT:
                        out.append((part, number, k > 0 or part != sentence))
    return out


def unit_array(content: Column, lexicon: vocab.Lexicon = LEXICON) -> Column:
    """Segments of one text in order: paragraphs, then sentences, then flattened list entries; none of a null text.

    All of a document's segments are one array, so the place of a segment is its array index. The function is called for
    every row it is selected in, whatever stands around it, so callers give a null text where they need no segments.
    """
    pattern = f"[^{lexicon.sentence_end}]*(?:[{lexicon.sentence_end}][{vocab.CLOSING_QUOTE}]?|$)"

    @F.arrow_udf(T.ArrayType(UNIT))
    def units(texts: pa.Array) -> pa.Array:
        sentences = re.compile(pattern)
        ends, rows = [0], []
        for text in texts:
            rows += units_of(text.as_py() or "", sentences)
            ends.append(len(rows))
        fields = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.bool_()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, UNIT.names))

    return units(content)


def segments(docs: DataFrame, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """One row per segment with its neighbours' texts; ``continues`` marks a segment that follows
    another one of the same paragraph and starts no list entry."""
    keep = [c for c in docs.columns if c != "content_text"]

    def with_neighbours(us: Column) -> Column:
        return F.transform(us, lambda u, i: F.struct(
            u["text"].alias("text"), u["paragraph"].alias("paragraph"), u["list_boundary"].alias("list_boundary"),
            F.get(us, i - 1)["text"].alias("prev_text"), F.get(us, i + 1)["text"].alias("next_text"),
            F.coalesce((F.get(us, i - 1)["paragraph"] == u["paragraph"]) & ~u["list_boundary"], F.lit(False)).alias("continues")))

    ship(docs.sparkSession)
    # dealt out always: segmenting costs far more than a shuffle of the input, and files and row groups differ in size
    if "document_id" in docs.columns:
        docs = docs.repartition("document_id")
    units = docs.select(*keep, unit_array(F.col("content_text"), lexicon).alias("units"))
    return units.select(*keep, F.posexplode(with_neighbours(F.col("units"))).alias("seg_idx", "u")).select(*keep, "seg_idx", "u.*")


def places_of(text: str, words: Sequence[str]) -> set[int]:
    """Offsets at which any of the words begins, in one another's midst too."""
    found = set()
    for word in words:
        at = text.find(word)
        while at >= 0:
            found.add(at)
            at = text.find(word, at + 1)
    return found


def predicate_positions(text: Column, lexicon: vocab.Lexicon = LEXICON) -> Column:
    """A struct with the ascending offsets of each type's words (``p_<type>``); a quotation counts as a statement."""
    words = {t: sorted({w.lower() for w in lexicon.words(t)}) for t in vocab.EVENT_TYPES}
    quoted = lexicon.quote
    kinds = T.StructType([T.StructField(f"p_{t}", T.ArrayType(T.IntegerType())) for t in vocab.EVENT_TYPES])

    @F.arrow_udf(kinds)
    def positions(texts: pa.Array) -> pa.Array:
        quote = re.compile(quoted)
        ends: dict[str, list[int]] = {t: [0] for t in words}
        found: dict[str, list[int]] = {t: [] for t in words}
        for given in texts:
            text = given.as_py() or ""
            low = text.lower()
            for t, own in words.items():
                places = places_of(low, own)
                if t == "statement":
                    places.update(m.start() for m in quote.finditer(text))
                found[t] += sorted(places)
                ends[t].append(len(found[t]))
        lists = [pa.ListArray.from_arrays(pa.array(ends[t], pa.int32()), pa.array(found[t], pa.int32())) for t in words]
        return pa.StructArray.from_arrays(lists, kinds.names)

    return positions(text)


def with_predicates(rows: DataFrame, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """Add one offset array per event type (``p_<type>``)."""
    ship(rows.sparkSession)
    return rows.withColumn("p_", predicate_positions(F.col("text"), lexicon)).select(*rows.columns, "p_.*")


def has_predicate() -> Column:
    return (F.size("p_itinerary") > 0) | (F.size("p_statement") > 0) | (F.size("p_other") > 0)


def predicates(rows: DataFrame, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """One row per (segment, type, offset)."""
    typed = with_predicates(rows, lexicon)
    keep = [c for c in ("document_id", "seg_idx") if c in typed.columns]
    return typed.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(t).alias("event_type"), F.col(f"p_{t}").alias("at")) for t in vocab.EVENT_TYPES])).alias("e")).select(
        *keep, "e.event_type", F.explode("e.at").alias("position"))
