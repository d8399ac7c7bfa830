"""Text expressions. All of them are plain Spark columns evaluated in the JVM.

Java's regex classes are ASCII unless ``(?U)`` is set, so every pattern that meets free text sets it.
Positions are 0-based code-point offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "(?U)[\\s\\x1c-\\x1f]+"
EDGE_SPACES = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
SPANS = "array<struct<start:int,hit:string>>"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``c`` bound to a name: a long expression that is read several times is computed
    once per row and stays small in the plan."""
    return F.get(F.transform(F.array(c), body), 0)


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and trim."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), EDGE_SPACES, "")


def head(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all of them without an ``n``."""
    return c if n is None else F.substring(c, 1, n)


def from_pos(c: Column, start: Column) -> Column:
    """The tail of ``c`` from a 0-based offset."""
    return F.substring(c, start + 1, F.length(c))


def pos(c: Column, needle: Column | str) -> Column:
    """0-based offset of the first occurrence, -1 when absent."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.call_function("instr", c, needle) - 1


def holds_any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def count_held(c: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))


def first_of(c: Column, words: Sequence[str]) -> Column:
    """Smallest 0-based offset of any of the words, NULL when none occurs."""
    hits = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.call_function("instr", c, w))
    return F.array_min(F.filter(hits, lambda p: p > 0)) - 1


def spans(c: Column, pattern: str) -> Column:
    """All non-overlapping matches of a pattern that never matches the empty text, with offsets.

    The texts between the matches come from ``split``; walking both arrays once gives the offsets.
    """
    return let(c, lambda bound: _spans(bound, pattern))


def _spans(c: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.split(c, pattern, -1)
    walked = F.aggregate(
        F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), s["found"]).otherwise(F.concat(
                s["found"],
                F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), x["hit"].alias("hit"))),
            )).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(F.size(hits) == 0, F.array().cast(SPANS)).otherwise(walked)


def starts(c: Column, words: Sequence[str]) -> Column:
    """Ascending offsets at which any of the words begins. ``c`` and the words must share one case.

    A look-ahead split cuts the text in front of every hit, so overlapping words of different kinds
    are all found in one pass over the text.
    """
    pattern = "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
    return let(c, lambda bound: _starts(bound, pattern))


def _starts(c: Column, pattern: str) -> Column:
    pieces = F.split(c, "(?=" + pattern + ")", -1)
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"),
                              F.concat(s["found"], F.array(s["at"])).alias("found")),
        lambda s: s["found"],
    )
    # the first piece starts at 0 whether or not a word does
    leading = F.regexp_like(c, F.lit("^" + pattern))
    inner = F.filter(walked, lambda p: p > 0)
    return F.when(leading, F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def core_text(c: Column, patterns: Sequence[str]) -> Column:
    """The text without its dateline, reporter credit and leading day; the whole text if nothing is left."""
    def core(whole: Column) -> Column:
        rest = whole
        for pattern in patterns:
            rest = F.regexp_replace(rest, "(?U)" + pattern, "")
        return F.coalesce(F.nullif(rest, F.lit("")), whole)

    return let(squeeze(c), core)
