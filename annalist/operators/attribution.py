"""Who owns a predicate: subject attribution of segments and of stored evidence.

A person owns a predicate if their latest mention before it stands in the same clause, close enough,
is no background mention, and nobody else is mentioned in between. All tests of one segment are array
expressions on one row, and so is the search for names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx
from annalist.operators.persons import Scope, find_names, mentions
from annalist.operators.segments import LEXICON, has_predicate, segments, unit_array, with_predicates
from annalist.session import ship

VERDICT = "array<struct<person_id:bigint,event_type:string,valid:boolean>>"
MENTION = "array<struct<person_id:bigint,rank:bigint,name:string,border:boolean,pos:int>>"


def _without_overlaps(found: Column) -> Column:
    """Left-to-right, non-overlapping occurrences of names that can overlap themselves."""
    def free(acc: Column, x: Column) -> Column:
        return ~F.exists(acc, lambda y: (y["person_id"] == x["person_id"]) & (y["rank"] == x["rank"])
                         & (x["pos"] < y["pos"] + F.length(y["name"])))

    walked = F.aggregate(F.array_sort(found), F.array().cast(MENTION),
                         lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.when(F.exists(found, lambda x: x["border"]), walked).otherwise(found)


def _clause_start(text: Column, at: Column, marks: str) -> Column:
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), at), f"(?s)^.*[{marks}]", 0))


def _is_background(text: Column, name: Column, mention: Column, start: Column, at: Column, patterns: tuple[str, ...]) -> Column:
    """The mention lies inside the first match of a background pattern in the clause before the predicate."""
    context = F.substring(text, start + 1, at - start)
    quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))

    def inside(pattern: str) -> Column:
        head, *rest = pattern.split("{name}")
        full = F.concat(F.lit("(?siu)^(.*?)(" + head), quoted, *[F.lit(p) for p in rest], F.lit(")"))
        lead = F.length(F.call_function("regexp_extract", context, full, F.lit(1)))
        hit = F.length(F.call_function("regexp_extract", context, full, F.lit(2)))
        return (hit > 0) & (mention - start >= lead) & (mention - start <= lead + hit)

    return reduce(lambda a, b: a | b, [inside(p) for p in patterns], F.lit(False))


def _owns(text: Column, own: Column, rivals: Column, predicates: Column, lexicon: vocab.Lexicon) -> Column:
    """Some predicate has ``own``'s latest mention before it as its subject."""
    def best(p: Column) -> Column:
        # on one position the earlier-ranked name wins
        return F.array_max(F.transform(F.filter(own, lambda x: x["pos"] < p), lambda x: F.struct(
            x["pos"].alias("pos"), (-x["rank"]).alias("order"), x["name"].alias("name"))))

    placed = F.transform(predicates, lambda p: F.struct(
        p.alias("at"), best(p).alias("m"), _clause_start(text, p, lexicon.clause_marks).alias("start")))

    def fits(z: Column) -> Column:
        m = z["m"]
        return (
            m.isNotNull() & (m["pos"] >= z["start"]) & (z["at"] - m["pos"] - F.length(m["name"]) <= vocab.SUBJECT_GAP)
            & ~F.exists(rivals, lambda r: (r["pos"] > m["pos"]) & (r["pos"] < z["at"]))
            & ~_is_background(text, m["name"], m["pos"], z["start"], z["at"], lexicon.background)
        )

    return F.exists(placed, lambda z: F.coalesce(fits(z), F.lit(False)))


def with_mentions(rows: DataFrame, keys: list[str], scope: Scope, target: str | None = None) -> DataFrame:
    """``rows`` with the in-scope mentions of all persons in one array ``found``, bounded by the text's length.

    The names are found in the row, and only the lists of linked persons, one a source, meet the rows. With too many names for
    that, mentions come from a join and are gathered by key.
    """
    if scope.known is None:
        carried = [*keys, "source_id"] + ([target] if target else [])
        told = scope.restrict(find_names(rows.select(*carried, "text"), carried, scope.names), target)
        gathered = told.groupBy(*keys).agg(F.collect_list(F.struct(
            "person_id", "rank", "name", "border", F.col("pos").cast("int").alias("pos"))).cast(MENTION).alias("found"))
        return rows.join(gathered, keys, "left").withColumn("found", F.coalesce("found", F.array().cast(MENTION)))
    ship(rows.sparkSession)
    lists = scope.linked.groupBy("source_id").agg(F.collect_list("person_id").alias("linked"))
    told = rows.withColumn("found", mentions(scope.names, scope.known)(F.col("text"))).join(lists, "source_id", "left")

    def inside(m: Column) -> Column:
        counts = m["live"] & (F.col("linked").isNull() | F.array_contains("linked", m["person_id"]))
        return counts if target is None else counts | F.coalesce(m["person_id"] == F.col(target), F.lit(False))

    own = F.transform(F.filter("found", inside), lambda m: F.struct(*[m[c].alias(c) for c in ("person_id", "rank", "name", "border", "pos")]))
    return told.withColumn("found", own.cast(MENTION)).drop("linked")


def judged_rows(rows: DataFrame, keys: list[str], scope: Scope, lexicon: vocab.Lexicon = LEXICON,
                target: str | None = None) -> DataFrame:
    """Rows that mention someone in scope or start with a pronoun, with their verdicts in one array.

    ``rows`` carry the keys, source_id, text, led and the predicate arrays. ``verdicts`` holds, for each
    mentioned person and each type with predicates, whether the person is the subject (a statement
    that starts with a pronoun has no explicit one); ``owner`` is the only person with a valid verdict.
    """
    joined = with_mentions(rows, keys, scope, target).where((F.size("found") > 0) | F.col("led"))
    joined = joined.withColumn("found", _without_overlaps(F.col("found")))
    people = F.array_distinct(F.transform("found", lambda x: x["person_id"]))
    sides = F.transform(people, lambda p: F.struct(
        p.alias("person_id"), F.filter("found", lambda x: x["person_id"] == p).alias("own"),
        F.filter("found", lambda x: x["person_id"] != p).alias("rivals")))
    joined = joined.withColumn("sides", sides)
    per_type = []
    for t in vocab.EVENT_TYPES:
        at, led = F.col(f"p_{t}"), F.col("led") if t == "statement" else F.lit(False)
        judged = F.transform("sides", lambda z: F.struct(
            z["person_id"].alias("person_id"), F.lit(t).alias("event_type"),
            (~led & _owns(F.col("text"), z["own"], z["rivals"], at, lexicon)).alias("valid")))
        per_type.append(F.when(F.size(at) > 0, judged).otherwise(F.array().cast(VERDICT)))
    joined = joined.withColumn("verdicts", F.concat(*per_type).cast(VERDICT)).drop("sides", "found")
    owners = F.array_distinct(F.transform(F.filter("verdicts", lambda v: v["valid"]), lambda v: v["person_id"]))
    return joined.withColumn("owner", F.when(F.size(owners) == 1, F.get(owners, 0)))


def _named() -> Column:
    return F.array_distinct(F.transform("verdicts", lambda v: v["person_id"]))


def unique_owner(rows: DataFrame, keys: list[str], scope: Scope, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """Texts owned by exactly one person: keys + person_id."""
    return judged_rows(with_marks(rows, lexicon), keys, scope, lexicon).where(F.col("owner").isNotNull()).select(
        *keys, F.col("owner").alias("person_id"))


# ---- documents ---------------------------------------------------------------------------------

def with_marks(rows: DataFrame, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """Predicate offsets and pronoun marks of texts."""
    return with_predicates(rows, lexicon).withColumn("pronoun", F.regexp_like("text", F.lit(lexicon.pronoun_lead))).withColumn(
        "led", F.regexp_like("text", F.lit(lexicon.dated_pronoun_lead)))


def scored_segments(docs: DataFrame, lexicon: vocab.Lexicon = LEXICON) -> DataFrame:
    """Segments that hold some predicate, with offsets and pronoun marks."""
    return with_marks(segments(docs, lexicon), lexicon).where(has_predicate())


KEYS = ["document_id", "seg_idx"]


def attribute(judged: DataFrame, scope: Scope) -> DataFrame:
    """Verdict per candidate: document_id, seg_idx, person_id, event_type, valid, reason, n.

    ``judged`` are the judged segments of documents. A segment that starts with a pronoun makes every
    person in scope a candidate; those it does not name are counted in one row with a NULL person and
    ``n`` > 1, so they are never listed.
    """
    owners = judged.where(F.col("owner").isNotNull()).select("document_id", (F.col("seg_idx") + 1).alias("seg_idx"), "owner")
    led = judged.where("led").drop("owner").join(owners, KEYS, "left").withColumn(
        "owner", F.when(F.col("continues"), F.col("owner")))
    plain = judged.where(~F.col("led")).withColumn("owner", F.lit(None).cast("bigint"))
    told = plain.select(*KEYS, "led", "owner", "verdicts").unionByName(led.select(*KEYS, "led", "owner", "verdicts"))
    told = told.select(*KEYS, "led", "owner", F.explode("verdicts").alias("v")).select(*KEYS, "led", "owner", "v.*")
    by_pronoun = F.col("led") & (F.col("event_type") == "statement")
    continued = F.coalesce(F.col("owner") == F.col("person_id"), F.lit(False))
    named = told.select(
        *KEYS, "person_id", "event_type", F.when(by_pronoun, continued).otherwise(F.col("valid")).alias("valid"),
        F.when(by_pronoun, F.when(continued, "pronoun_continuation").otherwise("pronoun_ambiguous"))
        .when(F.col("valid"), "explicit_subject").otherwise("target_not_subject").alias("reason"),
        F.lit(1).cast("bigint").alias("n"))
    # pronoun segments: the owner who is not named, and everyone else in one counted row
    pure = led.where("pronoun").withColumn("named", _named()).join(
        scope.sizes(led).select("source_id", "scope_size"), "source_id")
    pure = pure.withColumn("absent_owner", F.col("owner").isNotNull() & ~F.array_contains("named", F.col("owner")))
    types = F.array_compact(F.array(*[F.when(F.size(f"p_{t}") > 0, F.lit(t)) for t in vocab.EVENT_TYPES]))
    pure = pure.withColumn("event_type", F.explode(types))
    statement = F.col("event_type") == "statement"
    rest = F.col("scope_size") - F.size("named") - F.col("absent_owner").cast("int")
    others = F.array(
        F.struct(F.when(F.col("absent_owner"), F.col("owner")).alias("person_id"), (statement & F.col("absent_owner")).alias("valid"),
                 F.when(statement, "pronoun_continuation").otherwise("target_not_mentioned").alias("reason"),
                 F.col("absent_owner").cast("bigint").alias("n")),
        F.struct(F.lit(None).cast("bigint").alias("person_id"), F.lit(False).alias("valid"),
                 F.when(statement, "pronoun_ambiguous").otherwise("target_not_mentioned").alias("reason"),
                 rest.cast("bigint").alias("n")))
    others = pure.select(*KEYS, "event_type", F.explode(others).alias("o")).select(*KEYS, "event_type", "o.*").where("n > 0")
    return named.unionByName(others)


def attribution_stats(verdicts: DataFrame) -> DataFrame:
    """Counts per document and over all (NULL document): candidates, accepted, and one column per reason."""
    return verdicts.rollup("document_id").agg(*_counted())


def document_stats(verdicts: DataFrame) -> DataFrame:
    """The same counts per document alone: one row a document, so that a join that reads none of them can be left out."""
    return verdicts.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(*_counted())


def _counted() -> list[Column]:
    reasons = ("evidence_empty", "predicate_missing", "pronoun_ambiguous", "target_not_mentioned", "target_not_subject",
               "schema_or_person_invalid", "evidence_not_in_document")
    return [
        F.sum("n").alias("candidates"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("valid"), 0).otherwise(F.col("n"))).alias("rejected"),
        *[F.sum(F.when(~F.col("valid") & (F.col("reason") == r), F.col("n")).otherwise(0)).alias(r) for r in reasons]]


# ---- stored or external evidence ---------------------------------------------------------------

def locate(evidence: Column, units: Column) -> Column:
    """Index of the first segment that contains the evidence or is contained in it; NULL if none."""
    marked = F.transform(units, lambda u, i: F.when(
        F.contains(u["text"], evidence) | F.contains(evidence, u["text"]), i))
    return F.array_min(F.array_compact(marked))


def needs_place(evidence: Column, event_type: Column, lexicon: vocab.Lexicon = LEXICON) -> Column:
    """Does the evidence need its place in the text? Only a statement that starts with a pronoun does."""
    return F.coalesce(F.regexp_like(tx.squeeze(evidence), F.lit(lexicon.dated_pronoun_lead)) & (event_type == "statement"), F.lit(False))


def judge_evidence(rows: DataFrame, keys: list[str], scope: Scope, lexicon: vocab.Lexicon = LEXICON,
                   force_target: bool = False) -> DataFrame:
    """Re-run attribution for given evidence: keys + valid, reason.

    ``rows`` carry the keys, source_id, content_text (read only where ``needs_place`` says so), evidence_text, person_id and event_type. With
    ``force_target`` the row's person is in scope even if the source is not linked to them.
    """
    base = rows.select(*keys, "source_id", F.col("person_id").alias("target"), "event_type",
                       tx.squeeze(F.col("evidence_text")).alias("text"), F.col("evidence_text").alias("raw"), "content_text")
    # only a statement that starts with a pronoun needs its place in the text
    lead = F.regexp_like("text", F.lit(lexicon.dated_pronoun_lead)) & (F.col("event_type") == "statement")
    ship(rows.sparkSession)
    base = base.withColumn("units", unit_array(F.when(lead, F.col("content_text")), lexicon)).drop("content_text")
    base = base.withColumn("at", locate(F.col("raw"), F.col("units")))
    here, before = F.get("units", F.col("at")), F.get("units", F.col("at") - 1)
    follows = (before["paragraph"] == here["paragraph"]) & ~here["list_boundary"]
    # the evidence itself and, for pronoun statements, the segment before it are judged together
    texts = F.array_compact(F.array(
        F.struct(F.lit(False).alias("earlier"), F.col("text")),
        F.when(F.col("at").isNotNull() & follows, F.struct(F.lit(True).alias("earlier"), before["text"].alias("text")))))
    parts = base.select(*keys, "source_id", "target", "event_type", F.explode(texts).alias("t")).select(
        *keys, "source_id", "target", "event_type", "t.*")
    parts = with_marks(parts, lexicon)
    judged = judged_rows(parts, [*keys, "earlier"], scope, lexicon, "target" if force_target else None)
    own = F.get(F.filter("verdicts", lambda v: (v["person_id"] == F.col("target")) & (v["event_type"] == F.col("event_type"))), 0)
    named = F.array_contains(_named(), F.col("target"))
    of_type = F.lit(0)
    for t in vocab.EVENT_TYPES:
        of_type = F.when(F.col("event_type") == t, F.size(f"p_{t}")).otherwise(of_type)
    states = parts.where(~F.col("earlier")).select(
        *keys, "target", (F.col("led") & (F.col("event_type") == "statement")).alias("by_pronoun"),
        (F.col("text") == "").alias("blank"), of_type.alias("predicates"))
    verdicts = judged.where(~F.col("earlier")).select(*keys, named.alias("named"), own["valid"].alias("valid"))
    owners = judged.where(F.col("earlier")).select(*keys, "owner")
    both = states.join(verdicts, keys, "left").join(owners, keys, "left")
    reason = (
        F.when(F.col("blank"), "evidence_empty").when(F.col("predicates") == 0, "predicate_missing")
        .when(F.col("by_pronoun"), F.when(F.coalesce(F.col("owner") == F.col("target"), F.lit(False)), "pronoun_continuation")
              .otherwise("pronoun_ambiguous"))
        .when(~F.coalesce("named", F.lit(False)), "target_not_mentioned")
        .when(F.col("valid"), "explicit_subject").otherwise("target_not_subject")
    )
    return both.select(*keys, reason.alias("reason")).withColumn(
        "valid", F.col("reason").isin("pronoun_continuation", "explicit_subject"))
