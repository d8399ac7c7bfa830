"""Surrogates for personal data: keyed, of the same type and shape, distinct for distinct entities."""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import names as given_names
from annalist.llm.common import freed, pick, prepare, store

# Titles by gender, syllables of made-up surnames by script. Given names are a table.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora"], "": ["Dr", "Prof"]}
SYLLABLES = {
    "latin": "ba bel cor dan del fen gar hol kar lin mor nel par quin ros sel tar ven wel zan".split(),
    "cyrillic": "ба вел гор дан ков лен мар нов пет рос сел тар".split(),
    "greek": "βα γιαν δακ θεο καλ λαμ μαν παπ ραλ σαρ ταν".split(),
}
#: Leading digits of card numbers, shortest first.
CARDS = regex.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35|30[0-5]|3[68]|6011|65").match

# A capitalised name without the 's of a genitive, so that all mentions have one form.
_CAP = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!(?<=['’])[sS](?!\p{L})))+"
_PLAIN_TITLES = [t for group in TITLES.values() for t in group]
_TITLE = "|".join(dict.fromkeys(_PLAIN_TITLES + [t.upper() for t in _PLAIN_TITLES]))
_CAPITAL = regex.compile(rf"(?<!\p{{L}}){_CAP}").finditer
_JOINTS = regex.compile(r"(['’-])").split
_PARTS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xoxb)[_-][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9\p{L}])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}


def any_of(words: set[str]) -> str:
    """A regular expression of ``words`` by shared beginnings, so that a place that begins none is left at its first letter."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def arms(node: dict) -> str:
        out = "|".join(re.escape(c) + arms(node[c]) for c in sorted(node) if c)
        return f"(?:{out}){'?' if '' in node else ''}" if out else ""

    return arms(tree)


class Given:
    """Given names by script and gender, and the patterns that find persons by them. ``rows``: (name, gender)."""

    def __init__(self, rows: tuple[tuple[str, str], ...]) -> None:
        self.rows, self.group_of, self.order_of = rows, {}, {}
        for name, gender in rows:
            self.group_of.setdefault(name, (script_of(name), gender))
        self.place = {n: (group, n) for n, group in self.group_of.items()}
        self.place = {n.upper(): v for n, v in self.place.items()} | self.place
        names = any_of(set(self.place)) or "(?!)"
        person = rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? {_CAP}(?: {_CAP})?|{names} {_CAP})"
        self.find = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in (_PARTS | {"person": person}).items())).finditer
        #: What every text with a person holds; Java and Python both read it. Every other entity holds a digit or an @.
        #: The class of the first letters comes first, as few characters pass it.
        told = set(self.place) | set(_TITLE.split("|"))
        self.named = rf"(?=[{''.join(sorted({re.escape(n[0]) for n in told}))}]){any_of(told)}\.? [^\x00-@\[-\x7f]"
        self.told = re.compile(f"[0-9@]|{self.named}").search

    def order(self, key: bytes, group: tuple[str, str]) -> dict[str, str]:
        """The names of a group, each with the one that follows it in a keyed order. The default names of the group take
        part, so that a short table gives no name back."""
        if (key, group) not in self.order_of:
            every = {n for n, g in self.group_of.items() if g == group} | {n for n, g in given_names.ROWS if (script_of(n), g) == group}
            row = sorted(every, key=lambda n: (hmac.new(key, n.encode(), hashlib.sha256).digest(), n))
            self.order_of[key, group] = dict(zip(row, row[1:] + row[:1]))
        return self.order_of[key, group]


TITLED = regex.compile(rf"(?:(?P<title>{_TITLE})\.? )?(?P<names>.*)").fullmatch


@functools.lru_cache(4)
def given(rows: tuple[tuple[str, str], ...] = given_names.ROWS) -> Given:
    return Given(rows)


def luhn(digits: str) -> int:
    """The sum that a card number must have as a multiple of ten."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(name: str) -> str:
    return "greek" if "Ͱ" <= name[-1] <= "Ͽ" else "cyrillic" if "Ѐ" <= name[-1] <= "ӿ" else "latin"


PLACE = given().place


def entities(text: str, names: Given | None = None) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of every entity, left to right. All mentions of one entity have one form.
    No entity crosses a line, so only lines that hold a digit, an @ or a name are read closely; but a name that a text
    holds is then found wherever a capitalised word of that text is it."""
    names = names or given()
    found = list(_by_shape(text, names))
    forms = {names.place[form][1].lower() if kind == "given" else form: (kind, names.place[form][1] if kind == "given" else form)
             for _, _, kind, form in found if kind in ("given", "name")}
    yield from _merged(found, _again(text, forms)) if forms else found


def _by_shape(text: str, names: Given) -> Iterator[tuple[int, int, str, str]]:
    """The entities that show by themselves. They hold every form that a text has."""
    at = 0
    for line in text.split("\n"):
        if names.told(line):
            for lo, hi, kind, form in _of_line(line, names):
                yield at + lo, at + hi, kind, form
        at += len(line) + 1


def _again(text: str, forms: dict[str, tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Every capitalised word, or part of one between hyphens and apostrophes, that is one of ``forms``; the longest first."""
    longest = max(len(_JOINTS(f)) for f in forms)
    for m in _CAPITAL(text):
        parts, k, at = _JOINTS(m.group()), 0, m.start()
        while k < len(parts):
            n = min(longest, len(parts) - k)
            while n > 1 and "".join(parts[k : k + n]).lower() not in forms:
                n -= 1
            word = "".join(parts[k : k + n])
            if word[:1].isupper() and word.lower() in forms:
                yield at, at + len(word), *forms[word.lower()]
            at += len(word)
            k += n


def _merged(found: list[tuple], more: Iterator[tuple]) -> Iterator[tuple]:
    """``found``, and of ``more`` what does not meet any of them, left to right."""
    j = 0
    for entity in more:
        while j < len(found) and found[j][1] <= entity[0]:
            yield found[j]
            j += 1
        if j == len(found) or entity[1] <= found[j][0]:
            yield entity
    yield from found[j:]


def _of_line(text: str, given: Given) -> Iterator[tuple[int, int, str, str]]:
    at = 0
    while True:
        m = next(given.find(text, at), None)
        if m is None:
            return
        kind, found, at = m.lastgroup, m.group(), m.end()
        if kind == "email":
            yield m.start(), m.end(), kind, found.lower()
        elif kind == "secret":
            yield m.start(), m.end(), kind, found
        elif kind == "iban":
            groups, at = found.split(" "), m.start() + 1
            while groups:  # words in capitals may follow
                plain = "".join(groups)
                if 15 <= len(plain) <= 34 and iban_rest(plain) == 1:
                    at = m.start() + len(" ".join(groups))
                    yield m.start(), at, kind, plain
                    break
                groups.pop()
        elif kind == "ipv4":
            parts = found.split(".")
            if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts):
                yield m.start(), m.end(), kind, found
        elif kind == "card":
            number = digits_of(found)
            if luhn(number) % 10 == 0 and CARDS(number):
                yield m.start(), m.end(), kind, number
        elif kind == "ssn":
            yield m.start(), m.end(), kind, digits_of(found)
        elif kind == "phone":
            yield m.start(), m.end(), kind, ("+" if found[0] == "+" else "") + digits_of(found)
        else:
            start = m.start() + (len(found) - len(TITLED(found)["names"]))
            for name in TITLED(found)["names"].split(" "):
                yield start, start + len(name), "given" if name in given.place else "name", name if name in given.place else name.lower()
                start += len(name) + 1


class Stream:
    """Numbers from a keyed hash of an entity."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.round, self.left = key, "\x00".join(map(str, what)).encode(), 0, 0
        self.room = 1

    def below(self, n: int) -> int:
        if self.room < n << 64:
            block = hmac.new(self.key, self.what + self.round.to_bytes(4, "big"), hashlib.sha256).digest()
            self.left, self.room, self.round = int.from_bytes(block, "big"), 1 << 256, self.round + 1
        self.left, out = divmod(self.left, n)
        self.room //= n
        return out


def shaped(s: Stream, text: str) -> str:
    """Digits for digits, letters of the same script and case for letters; everything else stays."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(s.below(10)))
        elif c.isalpha():
            low, n = (0x3B1, 17) if "Ͱ" <= c <= "Ͽ" else (0x430, 32) if "Ѐ" <= c <= "ӿ" else (0x61, 26)
            new = chr(low + s.below(n))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form of the entity that stands in for ``form``; another one for each attempt."""
    s = Stream(key, kind, form, attempt)
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        labels = domain.split(".")
        top = labels[-1] if labels[-1] in ("com", "net", "org") else ("com", "net", "org")[s.below(3)]
        more = "".join(chr(0x61 + s.below(26)) for _ in range(max(0, attempt - 2)))
        return ".".join([shaped(s, local) + more + "@" + shaped(s, labels[0]), *(shaped(s, x) for x in labels[1:-2]), "example", top]) if len(labels) > 2 \
            else f"{shaped(s, local)}{more}@example.{top}"
    if kind == "secret":
        if regex.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form):
            letters = "0123456789ABCDEF" if form == form.upper() else "0123456789abcdef"
            return "".join(letters[s.below(16)] for _ in form)
        head = regex.match(r"(?:AKIA|ASIA)|[a-z]+[_-]", form).group()
        return head + shaped(s, form[len(head):])
    if kind == "iban":
        body = form[:2] + "00" + shaped(s, form[4:])
        return form[:2] + f"{98 - iban_rest(body):02d}" + body[4:]
    if kind == "ipv4":
        if attempt > 8:  # no room in this shape
            return ".".join(str(s.below(256)) for _ in range(4))
        room = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        return ".".join(str(room[len(p)][0] + s.below(room[len(p)][1])) for p in form.split("."))
    if kind == "card":
        head = CARDS(form).group()
        body = head + "".join(str(s.below(10)) for _ in range(len(form) - len(head) - 1))
        return body + str(-luhn(body + "0") % 10)
    if kind == "ssn":
        return "".join(str(s.below(10)) for _ in form)
    if kind == "phone":
        keep = (2 if form[1] in "17" else 3) if form[0] == "+" else 0
        return form[:keep] + "".join(str(s.below(10)) for _ in form[keep:])
    script = script_of(form)
    parts = SYLLABLES[script]
    return "".join(parts[s.below(len(parts))] for _ in range(max(3, (len(form) + 2) // 3) + attempt // 2))


def given_name(key: bytes, name: str, names: Given | None = None) -> str:
    """Another given name of the same script and gender: names in a keyed order, each replaced by the next."""
    names = names or given()
    group, plain = names.place[name]
    return names.order(key, group)[plain]


def rendered(kind: str, mention: str, new: str) -> str:
    """A surrogate in the form of a mention: its separators, its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        fill = iter(new.removeprefix("+"))
        return "".join(next(fill) if c.isascii() and c.isalnum() else c for c in mention)
    if kind in ("name", "given"):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    return new.upper() if kind == "email" and mention == mention.upper() else new


def replaced(text: str, known: dict[tuple[str, str], str], key: bytes, names: Given | None = None) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for lo, hi, kind, form in entities(text, names):
        new = given_name(key, form, names) if kind == "given" else known[kind, form]
        out += [text[at:lo], rendered(kind, text[lo:hi], new)]
        at, n = hi, n + 1
    return "".join([*out, text[at:]]), n


def assign(found: DataFrame, key: bytes, most_attempts: int = 64) -> DataFrame:
    """``found``: distinct (kind, form). Returns kind, form, surrogate: no two forms of a kind share a surrogate, and none
    is itself a form that occurs. Rounds: all open forms draw; of those that draw alike the one of the least hash keeps
    its draw, if nobody had it before and no real entity is called so; the others draw again."""
    def drawn(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [surrogate(key, k, f, attempt) for k, f in zip(batch.column("kind").to_pylist(), batch.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("form"), pa.array(new, pa.string())], ["kind", "form", "surrogate"])
        return run

    schema = "kind string, form string, surrogate string"
    real = store(found, "forms")
    pending, done = real, None
    for attempt in range(most_attempts):
        draws = store(pending.mapInArrow(drawn(attempt), schema).withColumn("place", F.xxhash64("form")), "draws")
        least = draws.groupBy("kind", "surrogate").agg(F.min(F.struct("place", "form")).alias("least"))
        first = draws.join(least, ["kind", "surrogate"]).where(F.struct("place", "form") == F.col("least")).select("kind", "form", "surrogate")
        first = first.join(real.select("kind", F.col("form").alias("surrogate")), ["kind", "surrogate"], "left_anti").select("kind", "form", "surrogate")
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti").select("kind", "form", "surrogate")
        new = store(first, "surrogates")
        done = new if done is None else done.unionByName(new)
        pending = draws.select("kind", "form").join(new.select("kind", "form"), ["kind", "form"], "left_anti")
        if pending.isEmpty():
            return done
    raise ValueError(f"no room for distinct surrogates after {most_attempts} attempts")


def replace(docs: DataFrame, key: bytes, text_col: str = "text", given_table: DataFrame | None = None) -> DataFrame:
    """``docs`` with every entity of every whole text replaced: all columns as they are, but for the text, and a column
    n_entities at the end (a column of that name must not exist).

    Types: e-mail and IPv4 addresses, card numbers (brand prefix and Luhn sum), IBANs (check digits), social security
    and phone numbers, tokens and keys, and persons (a title, also in capitals, or a known given name, then capitalised
    names; and each of these names wherever it stands in the same text as a capitalised word of its own). The known given
    names are those of ``given_table`` (name, gender: "f" or "m"), which the driver reads, or of ``names.ROWS``. A
    surrogate keeps type, script, shape, separators and case, a card or IBAN its check, a given name its gender; all
    mentions of an entity get the same one in the whole table, different entities different ones. E-mail
    surrogates lie in reserved domains. Numbers that only look like cards stay.

    Null and empty texts stay as they are with no entity; equal texts get equal results; ids are not used, and may be
    null or repeated; an empty table gives none. Texts without a digit, an @ or a name are passed on as they are;
    only the others are read for entities, and shuffled. Forms are distinct before the shuffle, so a common one is no hot key.
    """
    prepare(docs.sparkSession)
    rows = given_names.ROWS if given_table is None else tuple(sorted(
        {(r["name"], r["gender"]) for r in pick(given_table, "name", "gender").where("name <> '' AND gender IS NOT NULL").collect()}))
    columns = docs.columns
    if any(c.lower() == "n_entities" for c in columns):
        raise ValueError("rename the column n_entities first")
    plain = docs.toDF(*(f"_{i}" for i in range(len(columns))))
    text = f"_{columns.index(text_col)}"
    hit = F.coalesce(F.contains(text, F.lit("@")) | F.col(text).rlike("[0-9]") | F.col(text).rlike(given(rows).named), F.lit(False))
    marked = plain.where(hit).withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(7), text))

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given(rows)
        for batch in batches:
            told = {(k1, k2, kind, form) for k1, k2, t in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")))
                    for _, _, kind, form in _by_shape(t, names) if kind != "given"}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in told], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["k1", "k2", "kind", "form"])

    mentions = store(marked.select("k1", "k2", F.col(text).alias("text")).mapInArrow(freed(mentioned), "k1 long, k2 long, kind string, form string"), "mentions")
    known = assign(mentions.select("kind", "form").distinct(), key)
    by_text = mentions.distinct().join(known, ["kind", "form"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("known"))
    joined = marked.join(by_text, ["k1", "k2"], "left").drop("k1", "k2")
    at = columns.index(text_col)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given(rows)
        for batch in batches:
            pairs = zip(batch.column(at).to_pylist(), batch.column("known").to_pylist())
            new = [replaced(t, {(x["kind"], x["form"]): x["surrogate"] for x in k or ()}, key, names) for t, k in pairs]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array([x[0] for x in new], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] for x in new], pa.int64())], [f"_{i}" for i in range(len(columns))] + ["n_entities"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    clean = plain.where(~hit).withColumn("n_entities", F.lit(0).cast("long"))
    return joined.mapInArrow(freed(rewritten), f"{kinds}, n_entities long").unionByName(clean).toDF(*columns, "n_entities")
