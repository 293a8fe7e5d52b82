"""Personal information in free text: finding it and replacing it (problem 5).

Detectors for emails, identity numbers, phones, street addresses and person names run in that order on the text that
the ones before left over. Names are recognised by their place (titles, salutations, signatures, introductions, labelled
fields) or as a known given name before a known family name. A signature of two words is settled by a join with the family
names that stand in unmistakable places of the whole corpus.

Every entity is replaced by a keyed stand-in that is the same for all its mentions: a placeholder that names the type
(default), or a surrogate of the same type, script and format. People are resolved before: inside a thread (or record) a
lone given or family name and the parts of an email address belong to the one full name that has them. A surrogate person
has a given name of the same gender and script, and each mention takes its part of it. Stand-ins of different entities are
kept distinct: those that collide are drawn again, until none do.

Defined results: null, empty and blank contents have no entities and stay as they are. Rows delivered again give the
same rows, which ``found`` lists once. Where a part of a name fits two people of a thread, the mention stays a person of
its own.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.session import cut

#: Bound of the given table of name parts, which tasks hold; a larger table is refused, not cut.
MAX_NAME_PARTS = 50_000
#: How often a family name must stand in unmistakable places of the corpus.
LEAST_MENTIONS = 2

# ---- fixed values: how each type is written ----
_AT = r"(?:@|＠| ?[(\[{]at[)\]}] ?| @ )"
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?)"
EMAIL = regex.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])"
    r"|(?<![\w.+%-])[A-Za-z0-9][\w.+%-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{2,}\b",
    regex.I,
)
_ID_LABEL = (
    r"(?:SSN|soc(?:ial|\.) sec(?:urity|\.) (?:number|no\.?)|N(?:ational )?I(?:nsurance)? (?:number|no\.?)"
    r"|passport(?: (?:number|no\.?))?|(?:national )?ID card(?: (?:number|no\.?))?|(?:resident )?identity (?:card|number)(?: (?:number|no\.?))?"
    r"|Steuer-?ID(?:entifikationsnummer)?|tax (?:identification|id)(?: (?:number|no\.?))?|身份证号?码?|护照号?码?)"
)
ID_NUMBER = regex.compile(
    rf"(?<![A-Za-z0-9]){_ID_LABEL}\s*(?:is|lautet|:|：|-|–|=|是|为)?\s*"
    r"(?P<v>\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,8}|\d{17}[\dX]|\d{2} \d{3} \d{3} \d{3}|\d{8,12})(?![\w]|-\d)",
    regex.I,
)
#: An international account number; its check digits decide.
IBAN = regex.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Digits alone are a phone where a word says so.
SAID_PHONE = regex.compile(
    r"(?<!\w)(?:call|phone|tel(?:ephone)?\.?|mobile|cell|fax|whatsapp|text|telefon|tél\.?|móvil|手机|电话)(?: (?:me|us|number|no\.?))?(?: (?:at|on|under|is))?\s?[:：]?\s?"
    r"(?P<v>\+?\d{9,14})(?!\w|[-.,]\d)",
    regex.I,
)
PHONE = regex.compile(
    r"(?<![\w+/.\-])(?:\+\d{2} \(0\)\d{2,4} \d{3,6}(?: \d{2,4})?|\+\d{2} \d(?: \d{2}){4}|\+\d{2} \d \d{4} \d{4}|\+1 \d{3} \d{3} \d{4}"
    r"|\+\d{2} \d{4} \d{6}|\+\d{2} \d{2} \d{5}-\d{3}|\+\d{2} \d{2} \d{4} \d{4}|\+\d{9,14}|00\d{2} \d{4} \d{3} \d{3}|0\d(?: \d{2}){4}"
    r"|\(0\d{1,4}\) \d{3,4} \d{3,4}|\(\d{3}\) \d{3}-\d{4}|0\d{2} \d{4} \d{4}|0\d{2} \d{5} \d{3}|0\d{4} \d{6}|1-\d{3}-\d{3}-\d{4}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|\+\d{1,3}(?:[ .-]\(?\d{2,5}\)?){2,5})(?!\w|[-.]\d)"
)
_WAY = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Terrace|Close|Court|Ct|Crescent|Place|Square|Boulevard|Blvd|Row|Walk|Mews|Gardens)"
ADDRESS = regex.compile(
    rf"(?<![\w.,-])\d{{1,4}}[A-Za-z]? (?:[A-Z][\p{{L}}'’]*[.]? ){{1,3}}?{_WAY}(?!\w)"
    r"|(?<![\w.,-])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours)"
    r"(?: (?:de la|du|des|de|de l['’]|d['’]))? ?[A-ZÀ-Þ][\p{L}'’-]+"
    r"|(?<!\w)[A-ZÄÖÜ][\p{L}-]+ (?:Str\.|Straße|Strasse|Weg|Platz|Allee|Gasse) \d{1,4}[A-Za-z]?(?!\w)"
    r"|(?<!\w)[A-ZÄÖÜ]\p{Ll}+(?:stieg|weg|straße|strasse|str\.|gasse|platz|allee|ufer) \d{1,4}[A-Za-z]?(?![\w%]|[.,]\d)"
    r"|(?<!\w)(?:Am|An der|Auf der|Zum|Zur|Unter den) [A-ZÄÖÜ][\p{L}-]+ \d{1,3}[A-Za-z]?(?![\w%]|[.,]\d)"
    r"|\p{Han}{1,4}?(?:大道|路|街|巷)\d{1,5}号"
)
_W = r"\p{L}[\p{L}'’]+"
_WORD = rf"{_W}(?:-{_W})*"
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|de la|de|del|da|di|du|ten|ter|bin|al) )?"
_FULL = rf"(?:{_PARTICLE[:-1]}{_WORD}, {_WORD}(?: \p{{L}}\.)*|{_WORD}(?: \p{{L}}\.)* {_PARTICLE}{_WORD}|{_WORD}, {_WORD}(?: \p{{L}}\.)*)"
_HAN_NAME = r"\p{Han}{2,4}"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?"
#: A word that must be in the lower-case text for the place to occur, and the place.
NAME_PLACES = [
    (cue, regex.compile(p, regex.I))
    for cue, p in (
        ("cc", rf"(?<!\w)cc:? (?P<n>{_FULL})(?=\s*[<,;\n]|$)"),
        ("", rf"(?<!\w){_TITLE} (?P<n>{_FULL})(?!\w)"),
        ("my name is", rf"(?<!\w)my name is (?P<n>{_FULL})(?!\w)"),
        ("jointly with", rf"(?<!\w)jointly with (?P<n>{_FULL})(?!\w)"),
        ("this is", rf"(?<!\w)this is (?P<n>{_FULL})(?= from\b| speaking\b| at\b)"),
        ("m ", rf"(?<!\w)I['’]m (?P<n>{_FULL})(?=,)"),
        ("i asked", rf"(?<!\w)I asked (?P<n>{_FULL})(?= to\b)"),
        ("ask ", rf"(?<!\w)ask (?P<n>{_FULL})(?= about\b| to\b| for\b)"),
        ("owner", rf"(?<!\w)owner\"?\s*[=:]\s*\"?(?P<n>{_FULL})(?=[\";\n]|$)"),
        ("account holder", rf"(?<!\w)account holder is (?P<n>{_FULL})(?=[,.;(]|$)"),
        ("beneficiary", rf"(?<!\w)beneficiary: (?P<n>{_FULL})(?=\s*[(,.;\n]|$)"),
        ("goes to", rf"(?<!\w)goes to (?P<n>{_FULL})(?=,)"),
        ("人", rf"(?:收件人|联系人)[:：]?\s*(?P<n>{_HAN_NAME}|{_FULL})(?=[，。,.;；\s]|$)"),
        ("我叫", rf"我叫\s*(?P<n>{_HAN_NAME}|{_FULL})(?=[，。,.;；\s]|$)"),
    )
]
_TITLES = regex.compile(rf"(?<!\w){_TITLE} ", regex.I)
_CAP = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_CAPITALS = rf"{_CAP}(?: \p{{Lu}}\.)* {_PARTICLE}{_CAP}"
# How people say who they are, in several languages.
INTRODUCTION = regex.compile(
    rf"(?<!\w)(?i:mein name ist|ich hei(?:ß|ss)e|je m['’]appelle|mon nom est|mi nombre es|me llamo|mi chiamo|meu nome é) (?P<n>{_CAPITALS}|{_CAP})(?!\w)"
)
#: A word for a person before a name that begins with a known given name.
ROLE = regex.compile(
    rf"(?<!\w)(?i:customer|client|tenant|patient|colleague|policyholder|shareholder|borrower|employee|contact(?: person)?|attn\.?|attention|signed by|witness|caller|kundin|kunde|cliente)"
    rf":? (?P<n>(?P<g>{_CAP})(?: \p{{Lu}}\.)* {_PARTICLE}{_CAP})(?!\w)"
)
_KNOWN_PAIR = regex.compile(rf"(?<![\w'’.-])(?P<n>(?P<g>{_CAP})(?: \p{{Lu}}\.)* {_PARTICLE}(?P<f>{_CAP}))(?![\w'’])", regex.V0)
_CLOSERS = ("regards", "thank", "best", "cheers", "sincerely", "yours", "cordialement", "grüße", "gruß", "saludos")
_INFORMAL = ("thank", "cheers", "best")
BLOCK_NAME = regex.compile(rf"(?<![\w'’-])(?P<n>{_FULL})(?=\n\0)")
CLOSING = regex.compile(
    rf"(?<!\w)(?:(?:kind |best |warm )?regards|thanks|thank you|best|cheers|sincerely|yours|cordialement|grüße|gruß|saludos),?[ ]*\n+(?P<g>{_WORD})"
    rf"(?=(?P<r>(?: \p{{L}}\.)* {_PARTICLE}{_WORD}|, {_WORD})?)",
    regex.I,
)
# What must be in a text for a detector to find something; the check runs in the JVM over all rows. Together these are a
# superset of the detectors. Most begin a word, and are only tried where one begins.
#: Words without regard to case: labels of numbers and places of names, as patterns that begin with a letter.
CUES = [
    "ssn", r"soc(?:ial|\.) sec", "ni n", "n i n", "n insurance n", "national i", "passport", "id card", "identity", "resident identity", "steuer", "tax i",
    "regards", "thank", r"best,? *\n", "cheers", "sincerely", "yours", "cordialement", "gr[uü][sß]", "saludos", "cc[ :]", "my name", "jointly with", "this is ", "i['’]m ", "ask(?:ed)? ",
    "i asked", "owner", "account holder", "beneficiary", "goes to", *[rf"{t}\b\.? " for t in "mr mrs ms miss dr prof herr frau mme mlle sr sra".split()],
    "mein name", "ich hei", "je m['’]", "mon nom", "mi nombre", "me llamo", "mi chiamo", "meu nome",
    *[
        rf"{w}:? (?-i:\p{{Lu}})"
        for w in r"customer|client|tenant|patient|colleague|policyholder|shareholder|borrower|employee|contact|contact person|attn\.?|attention|signed by|witness|caller|kundin|kunde|cliente".split("|")
    ],
]
#: Capitalised words of addresses, and what an account number looks like.
CAPITALS = [
    *[rf"{w}\b" for w in "Street St Road Rd Avenue Ave Lane Ln Drive Dr Way Terrace Close Court Ct Crescent Place Square Boulevard Blvd Row Walk Mews Gardens".split()],
    *[f"{w} [A-ZÄÖÜ]" for w in ("Am", "An der", "Auf der", "Zum", "Zur", "Unter den")], r"[A-Z]{2}\d{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}",
]
DIGITS = [r"00\d{2} ", r"0\d{1,4} \d", r"1-\d{3}-", r"\d{3}[-.]\d{3}[-.]", r"0\d{4} ", r"\d{9}"]


def _by_letter(patterns: list[str]) -> str:
    """Alternatives grouped by the letter they begin with, so that a word is only tried by those of its own letter."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        groups.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(groups.items()))


def hints(given: frozenset[str] = frozenset()) -> str:
    """The pattern of all hints (for the JVM), with known given names before another capital."""
    plain = [c for c in CAPITALS if not c.startswith("[")] + [f"{re.escape(g)} \\p{{L}}" for g in sorted(given) if g[:1].isupper()]
    begins = (
        rf"(?=\d)(?:{'|'.join(DIGITS)})|(?=\p{{Lu}})(?:{_by_letter(plain)}|{'|'.join(c for c in CAPITALS if c.startswith('['))})"
        rf"|(?i:{_by_letter(CUES)})|(?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours) ?(?:d|[A-ZÀ-Þ])"
    )
    return (
        r"[@＠号]|\+\d|[(\[{](?:(?i:at)[)\]}]|0?\d{1,4}\) ?\d)| (?:(?i:dot) |\d(?<=(?:Str\.|tr\.|traße|trasse|[Ww]eg|latz|llee|asse|tieg|fer) \d))"
        rf"|(?=[收联我身护])(?:收件人|联系人|我叫|身份证|护照)|(?<![A-Za-z0-9])(?:{begins})"
    )


HINTS = hints()
TYPES = ("email", "id_number", "phone", "street_address", "person_name")
_ENTITIES = T.ArrayType(
    T.StructType().add("pii_type", "string").add("start", "integer").add("stop", "integer").add("long_stop", "integer").add("family", "string")
)


class Parts(NamedTuple):
    """Known parts of names: given names as written, family names in lower case (the last word of each)."""

    given: frozenset[str] = frozenset()
    families: frozenset[str] = frozenset()


def known_parts(name_parts: DataFrame) -> Parts:
    """The given table of name parts. It is a small fixed table; more than ``MAX_NAME_PARTS`` rows are refused."""
    rows = name_parts.where(F.col("name_part").isNotNull()).select("name_part", "part_kind").distinct().limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"more than {MAX_NAME_PARTS} name parts")
    of = lambda kind: [r["name_part"] for r in rows if r["part_kind"] == kind]
    return Parts(frozenset(of("given")), frozenset(n.split(" ")[-1].lower() for n in of("family")))


_DIGIT = regex.compile(r"\d")
_DIGITS = regex.compile(r"\d[\d ().-]{5,}\d|[A-Za-z]\d{6}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}")
_ID_HINT = regex.compile(r"ssn|soc|number|passport|card|steuer|tax|ni n|n i n|national i|证|护照")


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def spans(text: str | None, parts: Parts = Parts()) -> list[tuple[str, int, int, int | None, str | None]]:
    """(type, start, stop, long_stop, family) of the entities of ``text``, in order.

    A signature that may have a second word has ``long_stop`` and the ``family`` (lower case) that has to be known for it.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, int | None, str | None]] = []
    rest = text

    def take(kind: str, start: int, stop: int, long_stop: int | None = None, family: str | None = None) -> None:
        nonlocal rest
        found.append((kind, start, stop, long_stop, family))
        end = long_stop or stop
        rest = rest[:start] + "\0" * (end - start) + rest[end:]

    low = text.lower()
    if "@" in text or "＠" in text or "at" in low:
        for m in list(EMAIL.finditer(rest)):
            take("email", *m.span())
    if _DIGITS.search(text):
        if _ID_HINT.search(low):
            for m in list(ID_NUMBER.finditer(rest)):
                take("id_number", *m.span("v"))
        for m in list(IBAN.finditer(rest)):
            if _is_iban(m[0]):
                take("id_number", *m.span())
        for m in list(PHONE.finditer(rest)):
            take("phone", *m.span())
        for m in list(SAID_PHONE.finditer(rest)):
            take("phone", *m.span("v"))
    if _DIGIT.search(text):
        for m in list(ADDRESS.finditer(rest)):
            take("street_address", *m.span())
    for cue, pattern in NAME_PLACES:
        if cue in low and (cue or _TITLES.search(text)):
            for m in list(pattern.finditer(rest)):
                if "\0" not in m["n"]:
                    take("person_name", *m.span("n"))
    for m in list(INTRODUCTION.finditer(rest)):
        take("person_name", *m.span("n"))
    if "\n\0" in rest:
        for m in list(BLOCK_NAME.finditer(rest)):
            if "\0" not in m["n"]:
                take("person_name", *m.span("n"))
    if any(c in low for c in _CLOSERS):
        for m in list(CLOSING.finditer(rest)):
            stop, long_stop, family = m.end("g"), None, None
            if m["r"] and "\0" not in m["r"]:
                # After an informal closing a second word belongs to the name only if it ends the line.
                ends = not m[0].lower().startswith(_INFORMAL) or rest[m.end("r") : m.end("r") + 1] in ("", "\n")
                if m["r"].startswith(",") and m["g"].isupper():
                    stop = m.end("r")
                elif ends:
                    long_stop, family = m.end("r"), regex.split(r"[ ,]+", m["r"])[-1].lower()
            if "\0" not in rest[m.start("g") : stop]:
                take("person_name", m.start("g"), stop, long_stop, family)
    for m in list(ROLE.finditer(rest)):
        if m["g"] in parts.given or m["g"] in FEMALE_GIVEN or m["g"] in MALE_GIVEN:
            take("person_name", *m.span("n"))
    if parts.given and parts.families:
        for m in list(_KNOWN_PAIR.finditer(rest, overlapped=True)):
            if m["g"] in parts.given and m["f"].lower() in parts.families and "\0" not in rest[m.start("n") : m.end("n")]:
                take("person_name", *m.span("n"))
    return sorted(found, key=lambda e: e[1])


def detect(text: str | None, families: frozenset[str] = frozenset(), parts: Parts = Parts()) -> list[tuple[str, int, int, str]]:
    """(type, start, stop, text) of the entities of one text. ``families``: known family names, lower case."""
    settled = [(k, a, long if family in families else b) for k, a, b, long, family in spans(text, parts)]
    return [(k, a, b, text[a:b]) for k, a, b in settled]


def contents(events: DataFrame, memories: DataFrame) -> DataFrame:
    """origin, record_id, scope and content of both tables, rows with content. Names are resolved inside a scope: the
    thread of an event, the record of a memory."""

    def rows(df: DataFrame, origin: str, record: str, inside: list[str]) -> DataFrame:
        held = [c for c in inside if c in df.columns]
        scope = F.concat_ws("\0", *held) if len(held) == len(inside) else F.col(record)
        return df.select(F.lit(origin).alias("origin"), F.col(record).alias("record_id"), F.concat(F.lit(origin + "\0"), F.coalesce(scope, F.lit(""))).alias("scope"), "content")

    events_ = rows(events, "conversation_events", "event_id", ["tenant_id", "user_id", "thread_id"])
    memories_ = rows(memories, "personal_memories", "memory_id", ["memory_id"])
    return events_.unionByName(memories_).where(F.col("content").isNotNull())


def _might_hold(content: Column, parts: Parts = Parts()) -> Column:
    return content.rlike(hints(parts.given))


def learned_families(rows: DataFrame, name_parts: DataFrame | None = None) -> DataFrame:
    """family: family names in lower case, those given and those that stand in unmistakable places of the corpus."""
    word = r"\p{L}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)*"
    cue = r"(?<![A-Za-z0-9])(?i:my name is|jointly with|cc|(?:Mr|Mrs|Ms|Dr|Frau|Herr)\.?|account holder is|owner=|\"owner\":\")"
    place = rf"{cue}\s*({word}(?: \p{{L}}\.)* (?:(?:van der|van den|van|von|de la|de|da|di) )?{word})"
    learned = (
        rows.where(F.col("content").rlike(cue))
        .select(F.explode(F.regexp_extract_all("content", F.lit(place), F.lit(1))).alias("name"))
        .select(F.lower(F.element_at(F.split("name", " "), -1)).alias("family"))
        .groupBy("family")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_MENTIONS)
        .select("family")
    )
    if name_parts is None:
        return learned
    given = name_parts.where("part_kind = 'family' AND name_part IS NOT NULL").select(F.lower(F.element_at(F.split("name_part", " "), -1)).alias("family"))
    return learned.unionByName(given).distinct()


def _family_frame(rows: DataFrame, families: DataFrame | frozenset[str]) -> DataFrame:
    return families if isinstance(families, DataFrame) else rows.sparkSession.createDataFrame([(f,) for f in sorted(families)], "family string")


def entities(rows: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """Add ``entities``, an array of what ``spans`` gives, to the rows that hold any hint."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf(_ENTITIES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            yield pd.Series([[{"pii_type": k, "start": a, "stop": b, "long_stop": c, "family": f} for k, a, b, c, f in spans(text, known)] for text in batch])

    return rows.where(_might_hold(F.col("content"), parts)).withColumn("entities", find("content"))


def mentions(marked: DataFrame, families: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, pii_type, start, stop and pii_text of every entity of ``entities``; doubtful signatures take their second
    word if a join finds its family name."""
    listed = marked.select(*keys, "content", F.explode("entities").alias("e")).select(
        *keys,
        "e.pii_type",
        "e.start",
        "e.stop",
        "e.long_stop",
        "e.family",
        F.col("content").substr(F.col("e.start") + 1, F.coalesce("e.long_stop", "e.stop") - F.col("e.start")).alias("text"),
    )
    known = families.select(F.col("family").alias("__known"), F.lit(True).alias("__is"))
    # Rows without a doubt meet no key; salted, so that they don't gather in one task.
    key = F.coalesce("family", F.concat(F.lit("\0"), (F.xxhash64("text") % 997).cast("string")))
    stop = F.when(F.col("__is"), F.col("long_stop")).otherwise(F.col("stop"))
    return listed.join(known, key == F.col("__known"), "left").select(
        *keys, "pii_type", "start", stop.alias("stop"), F.substring("text", F.lit(1), stop - F.col("start")).alias("pii_text")
    )


def found(events: DataFrame, memories: DataFrame, name_parts: DataFrame) -> DataFrame:
    """Every piece of personal information as written: origin, record_id, pii_type, pii_text; distinct rows."""
    rows = contents(events, memories)
    marked = entities(rows, known_parts(name_parts))
    return mentions(marked, learned_families(rows, name_parts), ["origin", "record_id"]).select("origin", "record_id", "pii_type", "pii_text").distinct()


# ---- replacing ----


def entity_key(kind: Column, text: Column) -> Column:
    """One key for all ways of writing an entity: case, disguise, order of names and separators don't count."""
    lower = F.lower(text)
    plain = F.regexp_replace(F.regexp_replace(lower, r" ?[(\[{]at[)\]}] ?| @ | at |＠", "@"), r" ?[(\[{]dot[)\]}] ?| dot ", ".")
    digits = F.regexp_replace(F.regexp_replace(text, r"\(0\)", ""), r"[^\d+]", "")
    turned = F.regexp_replace(lower, r"^([^,]+), (.+)$", "$2 $1")
    return (
        F.when(kind == "email", plain)
        .when(kind == "phone", F.regexp_replace(digits, r"^00", "+"))
        .when(kind == "id_number", F.regexp_replace(lower, r"[^\p{L}\d]", ""))
        .when(kind == "person_name", F.regexp_replace(turned, r" \p{L}\. ", " "))
        .otherwise(F.regexp_replace(lower, r"[^\p{L}\d]+", " "))
    )


_SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
# Given names for women and for men, and the beginnings and ends that family names are put together from.
FEMALE_GIVEN = (
    "Alice Amelia Anna Beatrice Camille Caroline Charlotte Clara Daniela Diana Edith Elena Elisabeth Emma Eva Fatima Frances Grace Hannah Helen Ines Irene Isabel Jane Joan "
    "Julia Karen Laura Leonie Lucy Margaret Maria Marie Martha Mary Nadia Nina Olivia Paula Rachel Rosa Ruth Sarah Sofia Susan Teresa Ursula Vera Victoria Yvonne"
).split()
MALE_GIVEN = (
    "Adam Albert Andrew Anton Arthur Benjamin Bruno Carlos Charles Daniel David Diego Edward Emil Eric Felix Francis Frank George Harry Henry Hugo Isaac Jack James Jean "
    "John Joseph Karl Kevin Leo Louis Lukas Marco Martin Michael Nicolas Oliver Oscar Paul Peter Philip Ralph Robert Samuel Simon Steve Thomas Victor Walter"
).split()
FAMILY_STARTS = "Ash Beck Birch Black Brad Brook Clay Cross Dun East Elm Fair Field Green Hart Hazel Hill Holt Kings Lang Lin Mill North Oak Rad Red Stan Thorn West Win".split()
FAMILY_ENDS = "berg bourne bridge brook bury by combe cott croft dale den feld ford gate grove ham hurst land ley ling man mere more son stead stein ton ward well wood worth".split()
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹"
HAN_FEMALE, HAN_MALE = "芳娜敏静丽艳娟霞秀玲燕萍雪琳婷颖梅莉洁倩", "伟强磊军勇杰涛明超刚平辉鹏飞斌波浩宇峰健"
_FEMALE_END = ("a", "ie", "elle", "ette", "ine", "ise", "yn", "een", "eth")


def is_female(given: str) -> bool:
    """Gender of a given name: by the lists, by the letters of Chinese names, or by the usual ending."""
    name = given.capitalize()
    if name in FEMALE_GIVEN or name in MALE_GIVEN:
        return name in FEMALE_GIVEN
    if regex.match(r"\p{Han}", given):
        return any(c in HAN_FEMALE + "若棠岚瑶雅婉淑芷萱妍" for c in given)
    return given.lower().endswith(_FEMALE_END)


_HAN_SYLLABLES = "安柏辰丹恩凡歌涵嘉可兰铭宁沛琪然诗棠维希言逸云知"
_STREET_WORD = regex.compile(r"(?<!\p{L})[A-ZÀ-Þ][\p{L}'’]++")
# Words of an address that are no part of the street's name.
_STREET_KIND = regex.compile(rf"{_WAY}|Str|Straße|Strasse|Weg|Platz|Allee|Gasse|Am|An|Auf|Zum|Zur|Unter")


def _code(secret: str, length: int = 64) -> Column:
    """A placeholder for pii_type and entity; at full length no two share one."""
    digest = F.substring(F.sha2(F.concat_ws("\0", F.lit(secret), "pii_type", "entity"), 256), 1, length)
    return F.concat(F.lit("["), F.upper("pii_type"), F.lit("_"), digest, F.lit("]"))


def _stream(secret: bytes, key: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        digest = hmac.new(secret, f"{key}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        yield from digest
        block += 1


def split_name(text: str) -> tuple[str, str]:
    """Given and family name as written, without initials and particles; a lone name is a given name."""
    if regex.fullmatch(r"\p{Han}+", text):
        return (text[1:], text[0]) if len(text) > 1 else (text, "")
    turned = text.split(",", 1)
    words = [w for w in regex.findall(r"[\p{L}'’]+(?:-[\p{L}'’]+)*", " ".join(reversed(turned)) if len(turned) == 2 else text) if len(w) > 1]
    return (words[0], words[-1] if len(words) > 1 else "") if words else (text, "")


def person(text: str, key: str, secret: bytes, attempt: int = 0) -> tuple[str, str]:
    """Given and family name of a surrogate person: of the same gender and script."""
    draw = _stream(secret, f"person_name\0{key}", attempt)
    given, family = split_name(text)
    pick = lambda names: names[(next(draw) * 256 + next(draw)) % len(names)]
    if regex.match(r"\p{Han}", text):
        letters = HAN_FEMALE if is_female(given) else HAN_MALE
        return "".join(pick(letters) for _ in range(max(1, len(given)) + attempt // 6)), pick(HAN_FAMILY)
    if not regex.match(r"\p{Latin}", text):  # letters of the same script
        alphabet = [c for c in map(chr, range(ord(text[0].lower()) & ~0x1F, (ord(text[0].lower()) | 0x1F) + 1)) if c.isalpha() and c == c.lower()] or [text[0]]
        made = ["".join(pick(alphabet) for _ in w).capitalize() for w in (given, family)]
        return made[0], made[1]
    name = pick(FEMALE_GIVEN if is_female(given) else MALE_GIVEN)
    last = pick(FAMILY_STARTS) + pick(FAMILY_ENDS)
    return name, last + ("-" + pick(FAMILY_STARTS) + pick(FAMILY_ENDS) if attempt > 1 else "")


def written_like(text: str, given: str, family: str, part: str | None = None) -> str:
    """A surrogate person's name in the form of ``text``: order, initials and capitals; ``part`` ('given' or 'family') for
    a mention of one part."""
    like = lambda name, sample: name.upper() if sample.isupper() and len(sample) > 1 else name.lower() if sample.islower() else name
    if regex.fullmatch(r"\p{Han}+", text):
        return given if part == "given" else family if part == "family" else family + given
    if part is not None or not regex.search(r"[\s,]", text):
        return like(family if part == "family" else given, text)
    old_given, old_family = split_name(text)
    initials = "".join(f" {c}" for c in regex.findall(r"(?<=\s)\p{L}\.", text))
    first = like(given, old_given) + (f" {given[0]}." if initials else "")
    return f"{like(family, old_family)}, {first}" if "," in text else f"{first} {like(family, old_family)}"


def surrogate(kind: str, text: str, key: str, secret: bytes, attempt: int = 0) -> str:
    """A stand-in of the same type, script and format: letters keep their case, separators and lengths stay.

    People get a name of the same gender and script (``person``). Digits become other digits behind an international or
    trunk prefix. Emails get a reserved domain.
    """
    draw = _stream(secret, f"{kind}\0{key}", attempt)

    def word(like: str) -> str:
        made = ""
        while len(made) < max(2, len(like)):
            made += _SYLLABLES[next(draw) % len(_SYLLABLES)]
        made = made[: max(2, len(like))]
        return made.upper() if like.isupper() and len(like) > 1 else made.capitalize() if like[:1].isupper() else made

    if kind == "person_name":
        return written_like(text, *person(text, key, secret, attempt))
    if kind == "email":
        return word("x" * 7).lower() + str(next(draw) % 90 + 10) + "@example.invalid"
    if kind == "street_address":
        if regex.search(r"\p{Han}", text):
            return "".join(_HAN_SYLLABLES[next(draw) % len(_HAN_SYLLABLES)] for _ in range(2)) + f"路{next(draw) % 200 + 1}号"
        named = _STREET_WORD.sub(lambda m: m[0] if _STREET_KIND.fullmatch(m[0]) else word(m[0]), text)
        return regex.sub(r"\d+", lambda m: "".join(str(next(draw) % 9 + 1) for _ in m[0]), named)
    keep = 0
    if kind == "phone":
        m = regex.match(r"(?:\+|00)\d{1,2}|\(?0", text)
        keep = m.end() if m else 0
    return text[:keep] + "".join(
        str(next(draw) % 10) if c.isdigit() else (chr(next(draw) % 26 + 65) if c.isupper() else c) for c in text[keep:]
    )


def stand_ins(found_entities: DataFrame, secret: str, style: str = "placeholder") -> DataFrame:
    """pii_type, entity (its key) and stand_in, with no stand-in shared by two entities of a type.

    ``found_entities`` has pii_type and pii_text, and the entity where that is resolved already; people are sampled by their
    longest mention and come out as 'Given Family'. Colliding stand-ins are drawn again with more rounds or letters until
    none is left; each round joins by the stand-in, so nothing is gathered in one place. Entities that twelve rounds did not
    settle, as short words have few surrogates, get a placeholder with the whole digest.
    """
    key = F.col("entity") if "entity" in found_entities.columns else entity_key(F.col("pii_type"), F.col("pii_text"))
    distinct = (
        found_entities.select("pii_type", "pii_text", key.alias("entity"))
        .groupBy("pii_type", "entity")
        .agg(F.min_by("pii_text", F.struct(-F.length("pii_text"), F.col("pii_text"))).alias("sample"))
    )

    @F.pandas_udf("string")
    def made(kind: pd.Series, text: pd.Series, key: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series(
            [
                " ".join(person(t, e, secret.encode(), int(a))).strip() if k == "person_name" else surrogate(k, t, e, secret.encode(), int(a))
                for k, t, e, a in zip(kind, text, key, attempt, strict=True)
            ]
        )

    def propose(df: DataFrame, attempt: int) -> DataFrame:
        if style == "surrogate":
            return df.withColumn("stand_in", made("pii_type", "sample", "entity", F.lit(attempt)))
        return df.withColumn("stand_in", _code(secret, 8 + 4 * attempt))

    settled, open_, attempt = None, cut(propose(distinct, 0)), 0
    while attempt < 12:
        twice = open_.groupBy("pii_type", "stand_in").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1")
        if settled is not None:
            taken = settled.select("pii_type", "stand_in").withColumn("first", F.lit(None).cast("string"))
            twice = twice.select("pii_type", "stand_in", "first").unionByName(
                open_.select("pii_type", "stand_in").join(taken, ["pii_type", "stand_in"], "left_semi").withColumn("first", F.lit(None).cast("string"))
            ).groupBy("pii_type", "stand_in").agg(F.when(F.count("*") == F.count("first"), F.min("first")).alias("first"))  # none may keep a taken one
        else:
            twice = twice.select("pii_type", "stand_in", "first")
        again = open_.join(twice, ["pii_type", "stand_in"]).where(~F.col("entity").eqNullSafe(F.col("first")))
        again = cut(again.select("pii_type", "entity", "sample"))
        good = open_.join(again.select("pii_type", "entity"), ["pii_type", "entity"], "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        if again.isEmpty():
            break
        attempt += 1
        settled, open_ = cut(settled), cut(propose(again, attempt))
    else:
        settled = settled.unionByName(open_.withColumn("stand_in", _code(secret)))
    return settled.select("pii_type", "entity", "stand_in")


def resolved(listed: DataFrame) -> DataFrame:
    """Add ``entity``, ``part`` and ``person`` to mentions that have a scope, pii_type and pii_text.

    The parts of the full names of a scope that belong to one person there resolve the lone names and the words before the
    @ of an email in the same scope. ``part`` says which part of the person a lone name is, ``person`` whose an email is.
    """
    keyed = listed.withColumn("entity", entity_key(F.col("pii_type"), F.col("pii_text")))
    is_name, is_email = F.col("pii_type") == "person_name", F.col("pii_type") == "email"
    words = F.split("entity", " ")
    full = keyed.where(is_name & (F.size(words) > 1)).select("scope", "entity", words.alias("w"))
    held = full.select(
        "scope",
        "entity",
        F.explode(F.array(F.struct(F.element_at("w", 1).alias("word"), F.lit("given").alias("part")), F.struct(F.element_at("w", -1).alias("word"), F.lit("family").alias("part")))).alias("x"),
    )
    parts = (
        held.groupBy("scope", F.col("x.word").alias("word"))
        .agg(F.min("entity").alias("owner"), F.max("entity").alias("__other"), F.min("x.part").alias("part"))
        .where(F.col("owner") == F.col("__other"))
        .select(F.col("scope").alias("__scope"), "word", "owner", F.col("part").alias("__part"))
    )
    local = F.filter(F.split(F.regexp_extract("entity", "^([^@]+)@", 1), r"[^\p{L}]+"), lambda x: F.length(x) > 2)
    at = ["origin", "record_id", "h", "start"]
    asked = keyed.where((is_name & (F.size(words) == 1) & ~F.col("entity").rlike(r"^\p{IsHan}")) | is_email).select(
        *at, "scope", is_email.alias("mail"), F.explode(F.when(is_email, local).otherwise(words)).alias("word")
    )
    met = (
        asked.join(parts, (asked["scope"] == parts["__scope"]) & (asked["word"] == parts["word"]))
        .groupBy(*at)
        .agg(F.min("owner").alias("owner"), F.max("owner").alias("__other"), F.min("__part").alias("part"), F.bool_or("mail").alias("mail"))
        .where(F.col("owner") == F.col("__other"))
        .drop("__other")
    )
    return keyed.join(met, at, "left").select(
        *[c for c in keyed.columns if c != "entity"],
        F.coalesce(F.when(~F.col("mail"), F.col("owner")), F.col("entity")).alias("entity"),
        F.when(~F.col("mail"), F.col("part")).alias("part"),
        F.when(F.col("mail"), F.col("owner")).alias("person"),
    )


@F.pandas_udf(T.StringType())
def _rendered(kind: pd.Series, text: pd.Series, stand_in: pd.Series, part: pd.Series, owner: pd.Series) -> pd.Series:
    """The surrogate of a mention: people in the form of the mention, an email with the names of its person."""

    def one(k: str, t: str, made: str, p: str | None, who: str | None) -> str:
        if k == "person_name" and not made.startswith("["):
            given, _, family = made.partition(" ")
            return written_like(t, given, family, p)
        if k == "email" and who and not made.startswith("["):
            return ".".join(who.lower().split(" ")) + "." + made
        return made

    return pd.Series([one(k, t, s, None if pd.isna(p) else p, None if pd.isna(o) else o) for k, t, s, p, o in zip(kind, text, stand_in, part, owner, strict=True)], dtype=object)


def redact(
    rows: DataFrame, families: DataFrame | frozenset[str], secret: str, style: str = "placeholder", parts: Parts = Parts()
) -> DataFrame:
    """origin, record_id and content with every entity replaced by its stand-in; all other text unchanged.

    Repeated (origin, record_id, content) rows come out once.
    """
    keyed = rows.dropDuplicates(["origin", "record_id", "content"]).withColumn("h", F.xxhash64("content"))
    marked = cut(entities(keyed, parts).where(F.size("entities") > 0))
    listed = resolved(cut(mentions(marked, _family_frame(rows, families), ["origin", "record_id", "h", "scope"])))
    listed = cut(listed)
    chosen = stand_ins(listed.select("pii_type", "pii_text", "entity"), secret, style)
    placed = listed.join(chosen, ["pii_type", "entity"], "left").withColumn("stand_in", F.coalesce("stand_in", _code(secret)))  # never left in clear
    if style == "surrogate":
        people = chosen.where("pii_type = 'person_name'").select(F.col("entity").alias("person"), F.col("stand_in").alias("__owner"))
        # Salted: mentions without a person must not gather in one task.
        owner = F.coalesce("person", F.concat(F.lit("\0"), (F.col("h") % 997).cast("string")))
        placed = (
            placed.withColumn("person", owner)
            .join(people, "person", "left")
            .withColumn("stand_in", _rendered("pii_type", "pii_text", "stand_in", "part", "__owner"))
        )
    replaced = placed.groupBy("origin", "record_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "stand_in"))).alias("spans"))
    changed = (
        marked.join(replaced, ["origin", "record_id", "h"])
        .withColumn(
            "done",
            F.aggregate(
                "spans",
                F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
                lambda acc, s: F.struct(
                    F.concat(
                        acc["text"],
                        F.substring(F.col("content"), acc["at"] + 1, s["start"] - acc["at"]),
                        s["stand_in"],
                    ).alias("text"),
                    s["stop"].alias("at"),
                ),
            ),
        )
        .select("origin", "record_id", "content", F.concat("done.text", F.expr("substring(content, done.at + 1)")).alias("redacted"))
    )
    same = keyed.join(changed.select("origin", "record_id", "content"), ["origin", "record_id", "content"], "left_anti")
    return changed.select("origin", "record_id", F.col("redacted").alias("content")).unionByName(same.select("origin", "record_id", "content"))
