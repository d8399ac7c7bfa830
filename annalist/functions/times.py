"""Publication times. Everything is a TIMESTAMP in a UTC session, cut to seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx
from annalist.functions import urls

_ISO = (
    "^\\s*(\\d{4}-\\d{2}-\\d{2})(?:[Tt ](\\d{2}:\\d{2})(:\\d{2})?(?:[.,]\\d+)?\\s*(Z|z|[+-]\\d{2}:?\\d{2})?)?\\s*$"
)
_COMPACT = "^\\s*(\\d{4})(\\d{2})(\\d{2})(?:T(\\d{2})(\\d{2})(\\d{2})?(Z|[+-]\\d{2}:?\\d{2})?)?\\s*$"
_MAIL = (
    "(?i)^\\s*(?:[a-z]{3,9},?\\s+)?(\\d{1,2})[\\s-]+([a-z]{3})[a-z]*[\\s-]+(\\d{4})\\s+(\\d{1,2}):(\\d{2})(?::(\\d{2}))?"
    "\\s*([+-]\\d{4}|[a-z]{1,4})?\\s*(?:\\(.*\\))?\\s*$"
)
# fixed values: month names and named zones of RFC 2822
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ZONES = {"est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00",
          "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}


def _zone(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    return (
        F.when(F.regexp_like(c, F.lit("^[+-]\\d{4}$")), F.concat(F.substring(c, 1, 3), F.lit(":"), F.substring(c, 4, 2)))
        .when(F.regexp_like(c, F.lit("^[+-]\\d{2}:\\d{2}$")), c)
        .otherwise(F.coalesce(F.element_at(named, F.lower(c)), F.lit("+00:00")))
    )


def _stamp(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).try_cast("timestamp")


def to_utc_seconds(c: Column) -> Column:
    """ISO 8601 or RFC 2822 text as a time; no zone means UTC; anything else is NULL."""
    def g(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    def or_zero(x: Column) -> Column:
        return F.when(x == "", "00").otherwise(x)

    iso = _stamp(g(_ISO, 1), "T", F.when(g(_ISO, 2) == "", "00:00").otherwise(g(_ISO, 2)),
                 F.when(g(_ISO, 3) == "", ":00").otherwise(g(_ISO, 3)), _zone(g(_ISO, 4)))
    compact = _stamp(g(_COMPACT, 1), "-", g(_COMPACT, 2), "-", g(_COMPACT, 3), "T", or_zero(g(_COMPACT, 4)), ":",
                     or_zero(g(_COMPACT, 5)), ":", or_zero(g(_COMPACT, 6)), _zone(g(_COMPACT, 7)))
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(g(_MAIL, 2)))
    mail = _stamp(g(_MAIL, 3), "-", F.lpad(month.cast("string"), 2, "0"), "-", F.lpad(g(_MAIL, 1), 2, "0"), "T",
                  F.lpad(g(_MAIL, 4), 2, "0"), ":", g(_MAIL, 5), ":", or_zero(g(_MAIL, 6)), _zone(g(_MAIL, 7)))
    return (
        F.when(F.regexp_like(c, F.lit(_ISO)), iso)
        .when(F.regexp_like(c, F.lit(_COMPACT)), compact)
        .when(F.regexp_like(c, F.lit(_MAIL)), mail)
    )


def _day_at(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    two = lambda x: F.lpad(x, 2, "0")
    return _stamp(year, "-", two(month), "-", two(day), "T", two(hour), ":", two(minute), ":00+08:00")


_PLAUSIBLE_DAY = "^20\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])$"


def url_published_at(url: Column) -> tuple[Column, Column]:
    """(a publish day is present in the URL path, its time). The first pattern with a plausible day wins."""
    place = urls.path(url)
    digits = [F.regexp_replace(F.regexp_extract(place, pattern, 0), "\\D", "") for pattern in vocab.URL_DATES]
    first = F.coalesce(*[F.when(F.regexp_like(d, F.lit(_PLAUSIBLE_DAY)), d) for d in digits])
    day = F.regexp_replace(first, "^(....)(..)(..)$", "$1-$2-$3")
    return first.isNotNull(), _stamp(day, "T00:00:00+08:00")


def body_published_at(body: Column, limits: vocab.Limits = vocab.ALL) -> Column:
    """First full date of the text that is not announced as a future one."""
    return tx.let(tx.head(F.coalesce(body, F.lit("")), limits.dated), _first_past_date)


def _first_past_date(window: Column) -> Column:
    value = F.lit(None).cast("timestamp")
    for pattern in reversed(vocab.BODY_DATES):
        full = "(?U)" + pattern

        def is_past(s: Column) -> Column:
            after = F.substring(window, s["start"] + F.length(s["hit"]) + 1, F.lit(10))
            lead = F.greatest(s["start"] - 8, F.lit(0))
            before = F.substring(window, lead + 1, s["start"] - lead)
            return ~(tx.holds_any(after, vocab.FUTURE_AFTER) | tx.holds_any(before, vocab.FUTURE_BEFORE))

        def dated(hit: Column, later: Column = value, full: str = full) -> Column:
            part = [F.regexp_extract(hit, full, i) for i in range(1, 6)]
            zero = [F.when(p == "", "0").otherwise(p) for p in part[3:]]
            return F.when(hit.isNotNull(), _day_at(part[0], part[1], part[2], *zero)).otherwise(later)

        hit = F.get(F.filter(tx.spans(window, full), is_past), 0)["hit"]
        value = tx.let(hit, lambda h: dated(h))
    return value


def infer_published_at(url: Column, body: Column, limits: vocab.Limits = vocab.ALL) -> Column:
    """Publish time from the URL path, else from the body."""
    found, value = url_published_at(F.coalesce(url, F.lit("")))
    return F.when(found, value).otherwise(body_published_at(body, limits))


def local_text(ts: Column, zone: str = vocab.LOCAL_ZONE) -> Column:
    """Display form in local time; a missing time is labelled."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm"), F.lit(vocab.TIME_UNKNOWN))


def local_text_of(raw: Column, zone: str = vocab.LOCAL_ZONE) -> Column:
    """The same for a text column; a text that is no time is shown as it is."""
    return F.when(raw.isNull() | (raw == ""), F.lit(vocab.TIME_UNKNOWN)).otherwise(
        F.coalesce(F.date_format(F.from_utc_timestamp(to_utc_seconds(raw), zone), "yyyy-MM-dd HH:mm"), raw))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def seconds_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
