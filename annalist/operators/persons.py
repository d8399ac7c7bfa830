"""Person names, the persons in scope of a source, and where names occur in texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from annalist.functions import text as tx
from annalist.session import ship


def is_live() -> Column:
    return F.col("enabled") & F.col("deleted_at").isNull()


def name_table(persons: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All names of all persons: the name first, then enabled aliases in id order.

    ``anchor`` is the opening pair of characters, the key by which texts and names meet;
    ``border`` marks names that can overlap themselves.
    """
    named = persons.select("person_id", is_live().alias("live"), F.lit(-1).cast("bigint").alias("rank"), F.col("name").alias("raw"))
    if aliases is not None:
        extra = aliases.where("enabled").join(persons.select("person_id", is_live().alias("live")), "person_id")
        named = named.unionByName(extra.select("person_id", "live", F.col("alias_id").cast("bigint").alias("rank"),
                                               F.col("alias").alias("raw")))
    name = tx.strip(F.col("raw"))
    rows = named.select("person_id", "live", "rank", name.alias("name"), F.lower(name).alias("lname")).where(F.length("name") > 0)
    inner = F.filter(F.sequence(F.lit(1), F.length("lname")), lambda k: k < F.length("lname"))
    return rows.withColumn("anchor", F.substring("lname", 1, 2)).withColumn(
        "border", F.exists(inner, lambda k: F.substring(F.col("lname"), F.lit(1), k)
                           == F.substring(F.col("lname"), -k, k)))


@dataclass
class GroupLinks:
    """Links of sources and persons by a group that each belongs to, (source_id, group_id) and (person_id, group_id), each id once.

    The pairs grow with the product of both sides, so they are listed only where a result lists them.
    """

    sources: DataFrame
    persons: DataFrame

    def of(self, persons: DataFrame) -> GroupLinks:
        return GroupLinks(self.sources, self.persons.join(persons.select("person_id"), "person_id", "left_semi"))

    def pairs(self) -> DataFrame:
        return self.sources.join(self.persons, "group_id").select("source_id", "person_id")

    def counts(self) -> DataFrame:
        """(source_id, n): linked persons of sources that have any, from the sizes of the groups."""
        sizes = self.persons.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        return self.sources.join(sizes, "group_id").select("source_id", "n")

    def spread(self, rows: DataFrame) -> DataFrame:
        """``rows`` (person_id and more) for each source of the person; they meet the persons first, which are far fewer than pairs."""
        own = rows.join(self.persons, "person_id")
        return own.join(self.sources, "group_id").select("source_id", *rows.columns)


def link_counts(links: DataFrame | GroupLinks) -> DataFrame:
    """(source_id, n) of pairs (source_id, person_id) or groups."""
    return links.counts() if isinstance(links, GroupLinks) else links.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Scope:
    """Which persons count for which source: the live linked ones, or every live person if there is none."""

    names: DataFrame
    linked: DataFrame
    live_count: int
    groups: GroupLinks | None = None

    @cached_property
    def known(self) -> list[Row] | None:
        return known_names(self.names)

    @property
    def linked_sources(self) -> DataFrame:
        return self.linked.select("source_id").distinct()

    def sizes(self, source_ids: DataFrame) -> DataFrame:
        """(source_id, scope_size) without listing the pairs of unlinked sources."""
        counted = link_counts(self.linked if self.groups is None else self.groups)
        return source_ids.select("source_id").distinct().join(counted, "source_id", "left").select(
            "source_id", F.coalesce("n", F.lit(self.live_count)).alias("scope_size"), F.col("n").isNull().alias("unlinked"))

    def restrict(self, rows: DataFrame, target: str | None = None) -> DataFrame:
        """Keep (source_id, person_id) rows in scope; the ``target`` column names a person always in scope."""
        flagged = (
            rows.join(self.linked_sources.withColumn("has_links", F.lit(True)), "source_id", "left")
            .join(self.linked.withColumn("is_linked", F.lit(True)), ["source_id", "person_id"], "left")
        )
        inside = F.col("live") & (F.col("has_links").isNull() | F.col("is_linked").isNotNull())
        if target is not None:
            inside = inside | (F.col("person_id") == F.col(target))
        return flagged.where(inside).drop("has_links", "is_linked")


def make_scope(persons: DataFrame, aliases: DataFrame | None, source_persons: DataFrame | GroupLinks | None, overlapping: bool = False) -> Scope:
    """With ``overlapping``, a name that overlaps itself ("thathat") owns predicates from all its places, not only from those
    that a search which goes on behind each hit finds."""
    live = persons.where(is_live())
    groups = source_persons.of(live) if isinstance(source_persons, GroupLinks) else None
    if groups is not None:
        linked = groups.pairs()
    elif source_persons is None:
        linked = persons.select(F.lit(None).cast("bigint").alias("source_id"), "person_id").limit(0)
    else:
        linked = source_persons.select("source_id", "person_id").join(live.select("person_id"), "person_id", "left_semi").distinct() \
            .select("source_id", "person_id")
    names = name_table(persons, aliases)
    if overlapping:
        names = names.withColumn("border", F.lit(False))
    return Scope(names, linked, live.count(), groups)


def persons_for_source(scope: Scope) -> DataFrame:
    """(source_id, person_id, names) of linked sources; rows with a NULL source_id are the fallback
    scope that every other source shares."""
    names = scope.names.where("live").groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("n")).select(
        "person_id", F.transform("n", lambda x: x["name"]).alias("names"))
    shared = names.select(F.lit(None).cast("bigint").alias("source_id"), "person_id", "names")
    told = scope.linked.join(names, "person_id") if scope.groups is None else scope.groups.spread(names)
    return told.select("source_id", "person_id", "names").unionByName(shared)


def name_lengths(names: DataFrame) -> tuple[int, int]:
    """Shortest and longest name; one small aggregate over the name dimension."""
    shortest, longest = names.agg(F.min(F.length("lname")), F.max(F.length("lname"))).first()
    return shortest or 2, longest or 2


#: Anchors are known by the slot of their hash, so the driver holds this many numbers at most, however many names there are.
SLOTS = 16_384


def slot_of(anchor: Column) -> Column:
    return F.pmod(F.xxhash64(anchor), F.lit(SLOTS)).cast("int")


def anchor_slots(names: DataFrame) -> list[int]:
    """The slots of the names' anchors. Positions of a text whose slot is not among them need no row."""
    return sorted(r[0] for r in names.select(slot_of(F.col("anchor"))).distinct().collect())


# ---- names by an automaton --------------------------------------------------------------------------

#: So many names, of some dozen characters each, go to every task as one automaton; more of them meet the texts in a join.
MOST_NAMES = 200_000
MENTIONED = ("person_id", "rank", "name", "live", "border")


def known_names(names: DataFrame, most: int | None = None) -> list[Row] | None:
    """The rows of a name table, if they are no more than ``most``."""
    most = MOST_NAMES if most is None else most
    rows = names.select(*MENTIONED, "lname").limit(most + 1).collect()
    return rows if len(rows) <= most else None


@lru_cache(maxsize=2)
def _automaton(lnames: tuple[str, ...]) -> ahocorasick.Automaton:
    """One per worker and table of names."""
    found = ahocorasick.Automaton()
    for number, name in enumerate(lnames):
        found.add_word(name, number)
    found.make_automaton()
    return found


def mentions(names: DataFrame, known: list[Row]) -> Callable[[Column], Column]:
    """A function of a text: the array of all places of all names in it in lower case, (person_id, rank, name, live, border, pos).

    One automaton of all names reads an Arrow batch of texts, each character once, so the work is that of the texts' length and
    of the hits; the text does not leave its row, and nothing is shuffled.
    """
    lnames = tuple(sorted({r["lname"] for r in known}))
    place = {name: k for k, name in enumerate(lnames)}
    owners: list[list[int]] = [[] for _ in lnames]
    for k, r in enumerate(known):
        owners[place[r["lname"]]].append(k)
    fields = [names.schema[c] for c in MENTIONED]
    columns = [[r[f.name] for r in known] for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.ArrayType(T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("pos", T.IntegerType())]))

    @F.arrow_udf(schema)
    def found(texts: pa.Array) -> pa.Array:
        scan = _automaton(lnames) if lnames else None
        rows: list[int] = []
        places: list[int] = []
        ends = [0]
        for text in texts.to_pylist():
            if text and scan is not None:
                for end, number in scan.iter(text.lower()):
                    own = owners[number]
                    rows += own
                    places += [end + 1 - len(lnames[number])] * len(own)
            ends.append(len(rows))
        at = pa.array(rows, pa.int64())
        parts = [pa.array(c, k).take(at) for c, k in zip(columns, kinds)] + [pa.array(places, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, [*MENTIONED, "pos"]))

    return found


def find_names(rows: DataFrame, keys: list[str], names: DataFrame, text: str = "text", known: list[Row] | None = None) -> DataFrame:
    """Every occurrence of every name: keys + person_id, rank, name, live, border, pos.

    ``known`` are the names' rows where the caller has them. Very many names are not sent to all tasks: see ``join_names``.
    """
    known = known_names(names) if known is None else known
    if known is None:
        return join_names(rows, keys, names, text)
    ship(rows.sparkSession)
    hits = rows.select(*keys, F.explode(mentions(names, known)(F.col(text))).alias("m"))
    return hits.select(*keys, "m.*")


def join_names(rows: DataFrame, keys: list[str], names: DataFrame, text: str = "text") -> DataFrame:
    """As ``find_names``, for any number of names: texts and names meet in an equi-join on two opening characters and are
    then compared in full. Positions that no anchor's slot (see ``anchor_slots``) admits are dropped inside the row, before they
    become rows; only the few characters a name can need travel with each position.
    """
    shortest, longest = name_lengths(names)
    low = rows.select(*keys, F.lower(F.col(text)).alias("low"))
    chars = low.select(*keys, "low", F.regexp_extract_all("low", F.lit("(?s)."), F.lit(0)).alias("chars"))
    # the characters ahead come from the array, not from the text, which would be walked again for every position

    def ahead(i: Column) -> Column:
        return F.array_join(F.slice("chars", i + 1, F.lit(longest)), "")

    pairs = F.zip_with("chars", F.slice("chars", 2, F.greatest(F.size("chars"), F.lit(1))),
                       lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    if shortest < 2:
        placed = F.flatten(F.transform(pairs, lambda g, i: F.array_distinct(F.array(
            F.struct(i.alias("pos"), g.alias("anchor")), F.struct(i.alias("pos"), F.substring(g, 1, 1).alias("anchor"))))))
    else:
        placed = F.transform(pairs, lambda g, i: F.struct(i.alias("pos"), g.alias("anchor")))
    slots = anchor_slots(names)
    placed = F.filter(placed, lambda g: slot_of(g["anchor"]).isin(slots) if slots else F.lit(False))
    placed = F.transform(placed, lambda g: F.struct(g["pos"].alias("pos"), g["anchor"].alias("anchor"), ahead(g["pos"]).alias("ahead")))
    spread = chars.select(*keys, F.explode_outer(placed).alias("g")).where(F.col("g").isNotNull()).select(*keys, "g.*")
    return spread.join(names, "anchor").where(F.startswith("ahead", "lname")).select(*keys, *MENTIONED, "pos")


def hit_rows(rows: DataFrame, keys: list[str], terms: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (source_id, keys) whose text contains a term (source_id, term) of the row's own source."""
    wanted = terms.select("source_id", F.lower(tx.strip(F.col("term"))).alias("term")).where(F.length("term") > 0).distinct()
    names = wanted.select(F.col("term").alias("name")).distinct().select(
        F.lit(0).alias("person_id"), F.lit(0).alias("rank"), F.lit(True).alias("live"), "name", F.col("name").alias("lname"),
        F.substring("name", 1, 2).alias("anchor"), F.lit(False).alias("border"))
    carried = ["source_id", *[k for k in keys if k != "source_id"]]
    found = find_names(rows, carried, names, text).select(*carried, F.col("name").alias("term")).distinct()
    return found.join(wanted, ["source_id", "term"], "left_semi").select(*carried).distinct()
