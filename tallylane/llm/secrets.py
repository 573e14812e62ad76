"""Secret scans by one combined automaton (see automaton.py)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylane.llm import automaton
from tallylane.llm.shared import buffers, in_arrow, text_of


@dataclass(frozen=True)
class Rule:
    """`pattern` finds matches, leftmost first; those with fewer than `least` bytes in `group` are dropped.

    `trigger` is what the automaton looks for: it must match inside every match that is kept, and it
    decides only which pieces of text the exact check reads, or with `whole`, which rows it reads from end to end.
    """

    kind: str
    pattern: bytes
    trigger: bytes
    group: int = 0
    least: int = 1
    whole: bool = False


#: A private key from its BEGIN line to its END line, with anything but five dashes between; where END is missing, to the
#: end of its header and base64 lines (runs of 16 and more, and a shorter last line), line breaks escaped or not.
_BREAK = rb"(?:[\x20\t\r\n]|\\[nr])"
_PEM = (rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END (?:[A-Z]+ )?PRIVATE KEY-----"
        rb"|(?:" + _BREAK + rb"*(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:" + _BREAK + rb"*[A-Za-z0-9+/]{16,}={0,2})+(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}\r?(?m:$))?)?)")
#: Base rules first, in the order that decides ties.
RULES = (
    Rule("assign", rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", 2, 8),
    Rule("access", rb"AKIA[A-Z0-9]+", rb"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", rb"[0-9a-f]+", rb"[0-9a-f]{32}", 0, 32),
    Rule("pem", _PEM, rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", whole=True),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", rb"gh[pousr]_[A-Za-z0-9]{6}", 0, 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", rb"xox[abprs]-[A-Za-z0-9-]{6}", 0, 15),
    Rule("stripe", rb"sk_live_[0-9A-Za-z]+", rb"sk_live_[0-9A-Za-z]{6}", 0, 24),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", 0, 40),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int>>"


@lru_cache(4)
def _compiled(rules: tuple[Rule, ...]) -> automaton.Automaton:
    return automaton.compile_rules([r.trigger for r in rules])


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...], auto: automaton.Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """Row number to its spans (start, end, rule number) in code points, by start, then rule."""
    starts, ends = automaton.lanes(data, offsets, auto)
    masks = automaton.scan(data, starts, ends, auto)
    spans: dict[int, list[tuple[int, int, int]]] = {}
    rows_whole: set[tuple[int, int]] = set()

    def check(row: int, i: int, piece: bytes, shift: int) -> None:
        for m in re.finditer(rules[i].pattern, piece):
            if len(m[rules[i].group]) >= rules[i].least:
                spans.setdefault(row, []).append((m.start() + shift, m.end() + shift, i))

    for lane in np.flatnonzero(masks):
        row = int(np.searchsorted(offsets, starts[lane], side="right")) - 1
        piece, shift = data[starts[lane] : ends[lane]].tobytes(), int(starts[lane] - offsets[row])
        for i, rule in enumerate(rules):
            if masks[lane] >> i & 1:
                if rule.whole:
                    rows_whole.add((row, i))
                else:
                    check(row, i, piece, shift)
    for row, i in rows_whole:
        check(row, i, data[offsets[row] : offsets[row + 1]].tobytes(), 0)
    for row, own in spans.items():
        text = data[offsets[row] : offsets[row + 1]]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        spans[row] = sorted((int(points[s]), int(points[e]), i) for s, e, i in own)
    return spans


def scan_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, spans: str = "secret_spans") -> DataFrame:
    """`docs` with a column of secret spans: kind, start and end in code points, end exclusive.

    All rules are compiled into one minimal automaton on the driver; a task runs it over the bytes of a
    whole batch of texts, thousands of pieces in lockstep, and pieces in which a rule fires (for private keys, whole
    rows) are checked by that rule's pattern.  Narrow: no shuffle, memory bounded by a batch.  Null and empty texts have no
    spans; repeated rows are scanned each; other columns pass through.  A column named as `spans` is refused.
    """
    if spans in docs.columns:
        raise ValueError(f"the input has a column {spans}")
    rules = tuple(rules)
    auto = _compiled(rules)
    kinds = np.array([r.kind for r in rules], dtype=object)
    at = docs.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        if column.null_count:
            column = column.fill_null("")
        found = find(*buffers(column), rules, auto)
        lists = [[{"kind": kinds[i], "start": s, "end": e} for s, e, i in found.get(row, ())] for row in range(batch.num_rows)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, kind)], names=[*batch.schema.names, spans])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_arrow(docs, step, f"{fields}, `{spans}` {SPANS}")


def redact(docs: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """Replace each span by `<kind>`; where spans overlap, the first one by start is named and all are removed."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, span: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        mark = F.when(span["start"] >= acc["at"], F.concat(F.lit("<"), span["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    done = F.aggregate(F.col(spans), zero, add, rest)
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).drop(spans)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, SHA-256 of their spans, and all spans, per document."""
    found = scan_secrets(docs.select("doc_id", text_of("text").alias("text"))).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def _kind_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    found = f"(SELECT *, regexp_extract_all(t, {quoted}) AS m FROM d)"
    return f"SELECT doc_id, {number} AS k, '{kind}' AS kind, m, regexp_extract_all(t, {quoted}, {group}) AS v, string_split_regex(t, {quoted}) AS gaps, {least} AS least FROM {found} WHERE len(m) > 0"


def oracle_sql() -> str:
    """The digest in SQL: a match begins behind the gaps and the matches before it.

    Where a kind is one run of a class behind a fixed head, its least length stands in the pattern, so that
    short runs need not be listed.
    """
    by_kind = {r.kind: (r.pattern.decode(), r.group, r.least) for r in RULES}
    folded = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "stripe": r"sk_live_[0-9A-Za-z]{16,}"}
    kinds = [_kind_sql(i, kind, *((folded[kind], 0, 1) if kind in folded else by_kind[kind])) for i, kind in enumerate(by_kind)]
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nf AS (" + "\nUNION ALL ".join(kinds) + """),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, k, kind, list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS a, len(m[i]) AS n FROM u WHERE strlen(v[i]) >= least),
j AS (SELECT doc_id, k, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM s),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
""")
