"""URL expressions. Parts are taken with the RFC 3986 split, since stored URLs may hold raw blanks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx

_PARTS = "(?s)^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    """Lower-case host without user info, port and outer dots."""
    return F.regexp_extract(F.lower(authority(url)), "^(?:.*@)?\\.*([^:]*?)\\.*(?::.*)?$", 1)


def on_domain(host_col: Column, domains: Sequence[str]) -> Column:
    """Host equals one of the domains or is below one."""
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host_col == domain) | F.endswith(host_col, F.lit("." + domain))
    return hit


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    # the JVM form encoder differs from the wanted one on these two characters only
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(q: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda x: x != ""),
        lambda x: F.struct(
            _decoded(F.substring_index(x, "=", 1)).alias("k"),
            _decoded(F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1))
                     .otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit(vocab.TRACKING_PREFIX))
                    & ~F.lower(p["k"]).isin(*vocab.TRACKING_KEYS))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Key form of a URL: lower-case scheme and authority, no fragment, no tracking parameters."""
    return tx.let(tx.strip(url), lambda raw: tx.let(_without_gateway(raw), _canonical))


def _without_gateway(raw: Column) -> Column:
    gateway = (host(raw) == vocab.GATEWAY_HOST) & F.startswith(path(raw), F.lit(vocab.GATEWAY_PATH))
    return F.when(gateway, F.concat(F.lit(vocab.GATEWAY_TARGET),
                                    F.regexp_replace(path(raw), "^" + vocab.GATEWAY_PATH, ""))).otherwise(raw)


def _canonical(raw: Column) -> Column:
    site = F.lower(authority(raw))
    place = F.when(path(raw) == "", F.lit("/")).otherwise(path(raw))
    kept = tx.let(_clean_query(query(raw)), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    out = F.concat(
        F.when(scheme(raw) == "", F.lit("")).otherwise(F.concat(scheme(raw), F.lit(":"))),
        F.when(site == "", F.lit("")).otherwise(F.concat(F.lit("//"), site)),
        place,
        F.when(query(raw) == "", F.lit("")).otherwise(kept),
    )
    return F.when(raw == "", F.lit("")).otherwise(out)


def resolve(href: Column, base: Column) -> Column:
    """A link seen on a page as an absolute URL (RFC 3986 reference resolution with dot segments)."""
    return tx.let(tx.strip(href), lambda bound: _resolve(bound, base))


def _resolve(href: Column, base: Column) -> Column:
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    tail = F.regexp_extract(href, "(?s)^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(href, F.lit("/")), path(href)).otherwise(F.concat(folder, path(href)))
    parts = F.split(F.regexp_replace(joined, "^/", ""), "/")
    folded = F.aggregate(
        F.filter(parts, lambda p: p != "."), F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    ends_open = F.regexp_like(joined, F.lit("(^|/)\\.\\.?$"))
    walked = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(ends_open & (F.size(folded) > 0), "/").otherwise(""))
    return (
        F.when(scheme(href) != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(href == "", base)
        .when(path(href) == "", F.concat(origin, F.when(path(base) == "", F.lit("/")).otherwise(path(base)), tail))
        .otherwise(F.concat(origin, walked, tail))
    )


def site_key(host_col: Column) -> Column:
    """Registrable part of a host: two labels, three under the listed second-level zones."""
    labels = F.split(host_col, "\\.")
    last_two = F.substring_index(host_col, ".", -2)
    return F.when((F.size(labels) >= 3) & last_two.isin(*vocab.SECOND_LEVEL), F.substring_index(host_col, ".", -3)) \
        .otherwise(last_two)


def allowed_hosts(root_host: Column) -> Column:
    """Hosts that count as the root's own site: the listed site profiles, else the site key."""
    out = F.array(site_key(root_host))
    for suffix, hosts, _ in reversed(vocab.SITE_PROFILES):
        out = F.when(F.endswith(root_host, F.lit(suffix)), F.array(*[F.lit(h) for h in hosts])).otherwise(out)
    return out


def looks_like_navigation(url: Column, label: Column) -> Column:
    """Home, channel and list pages, judged by path and link text alone."""
    return tx.let(F.lower(path(url)), lambda place: _navigation_path(place, label))


def _navigation_path(place: Column, label: Column) -> Column:
    leaf = F.substring_index(F.regexp_replace(place, "/+$", ""), "/", -1)
    is_article = F.lit(False)
    for suffix in vocab.ARTICLE_SUFFIXES:
        is_article = is_article | F.endswith(place, F.lit(suffix))
    return (
        F.when(leaf.isin(*vocab.NAVIGATION_LEAVES), True)
        .when(F.endswith(place, F.lit("/")),
              tx.holds_any(F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), place)), vocab.NAVIGATION))
        .when(is_article, False)
        .otherwise(tx.holds_any(place, vocab.NAVIGATION_PATHS))
    )


def skipped_file(url: Column) -> Column:
    place = F.lower(path(url))
    hit = F.lit(False)
    for suffix in vocab.SKIPPED_SUFFIXES:
        hit = hit | F.endswith(place, F.lit(suffix))
    return hit


def percent_encoded(c: Column) -> Column:
    """Text as part of an address: UTF-8 bytes in percent form, but for letters, digits and ``_.-~/``."""
    out = F.url_encode(c)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def search_template(root_host: Column) -> Column:
    """The search address of a listed site, '' for others."""
    out = F.lit("")
    for suffix, _, template in reversed(vocab.SITE_PROFILES):
        out = F.when(F.endswith(root_host, F.lit(suffix)), F.lit(template)).otherwise(out)
    return out
