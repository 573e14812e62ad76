"""Personal data: detection, and keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise, text_of

#: Entities with a later attempt that are broadcast; more are joined to their documents.
BROADCAST = 200_000
#: Attempts after which a surrogate also grows by digits, so that small formats cannot run out.
GROW_AFTER = 6

# Titles of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Doktor", "Professor", "Docteur", "Доктор")
# Syllable parts and name endings (male, female, surname) by script.
SCRIPTS = {
    "LATIN": ("bdfgklmnprstvz", "aeiou", ("n", "s", "r"), ("a", "ia", "e"), ("er", "os", "in")),
    # a Slavic surname in -а or -я is a woman's and gets the last two endings
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", ("н", "р", "й"), ("а", "я", "ия"), ("ко", "ов", "ук", "ова", "ина")),
    "GREEK": ("βγδζκλμνπρστ", "αεηιο", ("ος", "ης", "ας"), ("α", "η", "ια"), ("ου", "ακη", "ιδη")),
}

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){0,4}(?![\w-])")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[.-]\d{1,2}[.-]\d{4}")
_PERSON = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, (*MALE, *FEMALE, *NEUTRAL))) + r")\.? ([^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[ -][^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+){0,2})")


def _luhn(digits: str) -> int:
    """Check digit of the digits before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _iban_rest(text: str) -> int:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, kind, canonical value), not overlapping, by start.

    Canonical values make mentions of one entity equal: e-mail in lower case, digits of numbers without
    separators, and each name for itself, so that `Ms Ada Byron` and `Mrs Byron` share the surname.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if re.search(r"\d", text):
        for m in _IP.finditer(text):
            if all(int(p) < 256 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip", ".".join(str(int(p)) for p in m[0].split("."))))
        for m in _IBAN.finditer(text):
            if _iban_rest(m[0]) == 1:
                found.append((m.start(), m.end(), "iban", m[0].replace(" ", "")))
        found += [(m.start(), m.end(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)]
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if len(digits) == 16 or _luhn(digits[:-1]) == int(digits[-1]):
                found.append((m.start(), m.end(), "card", digits))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15 and ("+" in m[0] or "(" in m[0] or len(re.findall(r"[ .-]", m[0])) >= 2) and not _DATE.fullmatch(m[0]):
                found.append((m.start(), m.end(), "phone", digits))
    for m in _PERSON.finditer(text):
        gender = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "n"
        names = [(n.start() + m.start(2), n.end() + m.start(2), n[0]) for n in re.finditer(r"[^\W\d_]+", m[2])]
        surname = m.start(2) + m[2].rfind(" ") + 1
        for start, end, name in names:
            found.append((start, end, f"name_{gender if start < surname else 's'}", name.casefold()))
    # an earlier kind wins where spans overlap
    order = {"email": 0, "ip": 1, "iban": 2, "ssn": 3, "card": 4, "phone": 5}
    starts: list[int] = []
    kept: list[tuple[int, int, str, str]] = []
    for own in sorted(found, key=lambda x: (order.get(x[2], 6), x[0])):
        at = bisect(starts, own[0])
        if (at == 0 or kept[at - 1][1] <= own[0]) and (at == len(kept) or own[1] <= kept[at][0]):
            starts.insert(at, own[0])
            kept.insert(at, own)
    return kept


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        number, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return number % n


def _shape(text: str, draw: _Stream) -> str:
    """Keyed letters for letters, keeping their case, and digits for digits."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            new = "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _script(text: str) -> str:
    for c in text:
        script = unicodedata.name(c, "").split(" ")[0]
        if script in SCRIPTS:
            return script
    return "LATIN"


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical replacement of a canonical value: valid for its kind, and the same wherever the value stands."""
    draw = _Stream(key, kind, value, attempt)
    grow = "".join(str(draw.below(10)) for _ in range(max(0, attempt - GROW_AFTER)))
    if kind == "email":
        local, domain = value.split("@", 1)
        labels = domain.split(".")
        return f"{_shape(local, draw)}{grow}@{_shape(labels[0], draw)}.example.{labels[-1]}"
    if kind == "ip":
        return ".".join(["10", *(str(draw.below(256)) for _ in range(3))])
    if kind == "iban":
        body = _shape(value[4:], draw)
        return value[:2] + f"{98 - _iban_rest(value[:2] + '00' + body):02d}" + body
    if kind == "card":
        body = value[0] + _shape(value[1:-1], draw)
        valid = _luhn(value[:-1]) == int(value[-1])
        return body + str((_luhn(body) + (0 if valid else 1 + draw.below(9))) % 10)
    if kind == "ssn":
        return f"9{draw.below(100):02d}{draw.below(100):02d}{draw.below(10000):04d}"
    if kind == "phone":
        keep = max(1, min(3, len(value) - 7))
        return value[:keep] + "".join(str(draw.below(10)) for _ in value[keep:])
    consonants, vowels, male, female, family = SCRIPTS[_script(value)]
    endings = {"name_m": male, "name_f": female, "name_s": family}.get(kind, (*male, *female))
    if kind == "name_s" and len(endings) > 3:
        endings = endings[3:] if value[-1] in "ая" else endings[:3]
    stem = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(max(2, len(value) // 2) + max(0, attempt - GROW_AFTER)))
    return stem[:-1] + endings[draw.below(len(endings))]


def dress(kind: str, made: str, mention: str) -> str:
    """A canonical surrogate in the format of a mention: its separators, its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        symbols = iter(made)
        return "".join(next(symbols, "") if c.isalnum() else c for c in mention)
    if kind.startswith("name_"):
        return made.upper() if mention.isupper() else made[:1].upper() + made[1:]
    return made


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    """Text with surrogates, and the entities with their places in the text before and their surrogates."""
    out, at, entities = [], 0, []
    for start, end, kind, value in find(text):
        new = dress(kind, surrogate(key, kind, value, attempts.get((kind, value), 0)), text[start:end])
        out += [text[at:start], new]
        at = end
        entities.append({"kind": kind, "start": start, "end": end, "surrogate": new})
    return "".join([*out, text[at:]]), entities


def settle(entities: DataFrame, key: bytes, max_rounds: int = 40) -> DataFrame:
    """`entities` (kind, value, distinct) with the attempt at which surrogates are distinct and none is a real value.

    Each round makes all surrogates and gives the next attempt to those that are also an original's value or
    another's surrogate; of equals, the one at the lowest attempt, then of smallest value, stays.  Names are checked across all
    name kinds.
    """

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=["kind", "value", "attempt", "made"])

    family = F.when(F.col("kind").startswith("name_"), "name").otherwise(F.col("kind")).alias("family")
    originals = entities.select(family, F.col("value").alias("made"), F.lit(True).alias("real")).distinct()
    now = entities.select("kind", "value", F.lit(0).alias("attempt"))
    for _ in range(max_rounds):
        made = now.mapInArrow(make, "kind string, value string, attempt int, made string").withColumn("family", family)
        order = F.row_number().over(Window.partitionBy("family", "made").orderBy("attempt", "value", "kind"))
        checked = materialise(made.withColumn("place", order).join(originals, ["family", "made"], "left").select("kind", "value", "attempt", (F.col("real").isNotNull() | (F.col("place") > 1)).alias("clash")))
        now = checked.select("kind", "value", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
        if checked.where("clash").isEmpty():
            return now
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text", entities: str = "entities", broadcast: int = BROADCAST) -> DataFrame:
    """`docs` with personal data replaced in `text`, and a column of what was replaced.

    One pass lists the distinct entities, whose surrogates are checked for collisions over the whole
    corpus; a second pass replaces.  As surrogates follow from the key and the value, only entities that needed a later attempt
    must be known there: they are broadcast up to a bound, and beyond it joined to the documents they stand in.
    Null texts stay null, texts without entities stay as they are; other columns pass through, and one named as `entities` is refused.
    """
    if entities in docs.columns:
        raise ValueError(f"the input has a column {entities}")

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen = {(kind, value) for body in batch.column(0).to_pylist() for _, _, kind, value in find(body)}
            if seen:
                kinds, values = zip(*sorted(seen), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["kind", "value"])

    known = materialise(docs.select(text_of(text).alias("t")).mapInArrow(listed, "kind string, value string").distinct())
    later = materialise(settle(known, key).where("attempt > 0"))
    few = later.count() <= broadcast
    attempts = {(r.kind, r.value): r.attempt for r in later.collect()} if few else {}
    extra = docs.withColumn("__later", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>")) if few else _with_later(docs, later, id_col, text)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, lists = [], []
            for body, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                new, found = (None, []) if body is None else replace(body, key, {(x["kind"], x["value"]): x["attempt"] for x in own} if own else attempts)
                texts.append(new)
                lists.append(found)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind)], names=[*batch.schema.names[:-1], entities])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return extra.mapInArrow(step, f"{fields}, `{entities}` array<struct<kind:string,start:int,end:int,surrogate:string>>")


def _with_later(docs: DataFrame, later: DataFrame, id_col: str, text: str) -> DataFrame:
    """Each document with the later attempts of its own entities."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mentions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(i, k, v) for i, body in enumerate(batch.column(1).to_pylist()) for k, v in sorted({(k, v) for _, _, k, v in find(body)})]
            if rows:
                at, kinds, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kinds), pa.array(values)], names=["__id", "kind", "value"])

    found = docs.select(id_col, text_of(text).alias("t")).mapInArrow(mentions, f"__id {kind}, kind string, value string")
    lists = found.join(later, ["kind", "value"]).groupBy("__id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("__later"))
    return docs.join(lists, docs[id_col].eqNullSafe(lists["__id"]), "left").select(*docs.columns, "__later")


def digest(docs: DataFrame, key: bytes = b"surrogates-1") -> DataFrame:
    found = pseudonymise(docs.select("doc_id", "text"), key)
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), spans.alias("entities"), "text")
