"""Similarity of two event texts: containment natively, the gestalt ratio on Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from annalist import vocab
from annalist.functions import text as tx

KEY_PATTERNS = (vocab.DATELINE, vocab.REPORTER, vocab.LEADING_DAY)


def normal_core(c: Column) -> Column:
    """Letters, digits and CJK of the core text in lower case."""
    return F.lower(F.regexp_replace(tx.core_text(c, KEY_PATTERNS), vocab.NOT_CORE, ""))


def dedup_key(person_id: Column, event_type: Column, start_at: Column, text: Column,
              limits: vocab.Limits = vocab.ALL) -> Column:
    day = F.coalesce(F.date_format(start_at, "yyyy-MM-dd"), F.lit(""))
    return F.sha2(F.concat_ws("|", person_id.cast("string"), event_type, day,
                              tx.head(normal_core(text), limits.key)), 256)


def _common_length(a: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence, one machine word operation per character of ``a``."""
    open_bits = full = (1 << size) - 1
    for char in a:
        hit = open_bits & places.get(char, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return size - open_bits.bit_count()


def pair_score(a: str, b: str, limits: vocab.Limits = vocab.ALL) -> float:
    """The similarity of one pair in Python, for state processors: as ``settled_similarity``, then ``gestalt_ratio``."""
    if not a or not b:
        return 0.0
    if a == b or (min(len(a), len(b)) >= vocab.CONTAINED_CHARS and (a in b or b in a)):
        return 1.0
    a, b = a[: limits.similar], b[: limits.similar]
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) < vocab.SIMILAR_ENOUGH * total or 2 * sum((Counter(a) & Counter(b)).values()) < vocab.SIMILAR_ENOUGH * total:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, argument order (incoming, stored), or 0 where it cannot reach the threshold.

    Matching blocks form a common subsequence, so 2 * its greatest length / total bounds the ratio;
    that bound is far cheaper than the ratio itself. Only meant for blocked pairs.
    """
    known: dict[str, dict[str, int]] = {}
    out = []
    for x, y in zip(a, b):
        places = known.get(y)
        if places is None:
            places = known[y] = {}
            for i, char in enumerate(y):
                places[char] = places.get(char, 0) | (1 << i)
        bound = 2.0 * _common_length(x, places, len(y)) / (len(x) + len(y))
        out.append(SequenceMatcher(None, x, y).ratio() if bound >= vocab.SIMILAR_ENOUGH else 0.0)
    return pd.Series(out, dtype="float64")


def settled_similarity(a: Column, b: Column, limits: vocab.Limits = vocab.ALL) -> Column:
    """The score where it needs no ratio: empty, contained, equal, or too different in length to
    reach the threshold. NULL means that the ratio decides.

    With n and m characters the ratio is at most 2*min(n,m)/(n+m), an exact bound.
    """
    n, m = F.length(a), F.length(b)
    cut_n, cut_m = (c if limits.similar is None else F.least(c, F.lit(limits.similar)) for c in (n, m))
    bound = 2 * F.least(cut_n, cut_m) / (cut_n + cut_m)
    return (
        F.when((n == 0) | (m == 0), F.lit(0.0))
        .when((F.least(n, m) >= vocab.CONTAINED_CHARS) & (F.contains(a, b) | F.contains(b, a)), F.lit(1.0))
        .when(a == b, F.lit(1.0))
        .when(bound < vocab.SIMILAR_ENOUGH, F.lit(0.0))
    )


def ratio_of(a: Column, b: Column, limits: vocab.Limits = vocab.ALL) -> Column:
    return gestalt_ratio(tx.head(a, limits.similar), tx.head(b, limits.similar))
