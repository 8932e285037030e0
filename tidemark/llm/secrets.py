"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams (three bytes, ASCII
letters folded). Each run of rows is a segment with its own inverted index, restricted to the
trigrams that the queries name: postings are intersected and united, and only the rows that are
left are verified by the expression itself. A rule without mandatory trigrams scans every row.
Segments need no shuffle, so neither a frequent trigram nor a hot source gathers rows in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

parser = re._parser


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` (0: the whole match) are needed; shorter matches are dropped
    after the leftmost non-overlapping matches have been taken."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    """ASCII letters in either case, without the Unicode folds of re.IGNORECASE."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE_RULES = (
    Rule("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"
MARK = "[secret]"

_MOST = 64  # strings that are followed at once before they are turned into a clause


def _folded(text: str) -> str:
    """ASCII letters in lower case, as the index has them; others as they are."""
    return "".join(c.lower() if c < "\x80" else c for c in text)


def _clause(strings: set[str]):
    """Some string of the set occurs; True if that says nothing about trigrams."""
    folded = {_folded(s) for s in strings}
    if any(len(s.encode()) < 3 for s in folded):
        return True
    ways = {frozenset(s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)) for s in folded}
    return ("or", sorted((tuple(sorted(w)) for w in ways if not any(o < w for o in ways)), key=str))


def _walk(seq) -> tuple[set[str] | None, list]:
    """The exact strings of ``seq`` (None if there are too many) and the clauses all matches meet."""
    now, exact, clauses = {""}, True, []

    def flush():
        nonlocal now, exact
        if (c := _clause(now)) is not True:
            clauses.append(c)
        now, exact = {""}, False

    def append(strings: set[str]):
        nonlocal now
        if len(now) * len(strings) > _MOST:
            flush()
        now = {a + b for a in now for b in strings}

    for op, arg in seq:
        name = str(op)
        if name == "LITERAL":
            append({chr(arg)})
        elif name == "IN" and (chars := _members(arg)) and len(chars) <= 8:
            append(chars)
        elif name == "SUBPATTERN" and arg[1] & re.IGNORECASE:
            flush()  # other characters may match, too
        elif name == "SUBPATTERN":
            strings, more = _walk(arg[-1])
            if strings is None:
                flush()
                clauses += more
            else:
                append(strings)
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                append(set().union(*(s for s, _ in parts)))
            else:
                flush()
                each = [more + [c for c in [_clause(s)] if s is not None and c is not True] if s is not None else more for s, more in parts]
                if all(each):
                    clauses.append(("any", each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            strings, more = _walk(sub)
            if low == 0 and int(high) == 1 and strings is not None:
                append(strings | {""})
            elif low == 0:
                flush()
            elif strings is not None:
                append(strings)
                if int(high) > 1:
                    flush()
            else:
                flush()
                clauses += more
        elif name != "AT":
            flush()
    if not exact:
        flush()
        return None, clauses
    return now, clauses


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < 64:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    folded = {_folded(c) for c in out}
    return folded if all(ord(c) < 128 for c in folded) else None


def trigram_query(pattern: str) -> list:
    """Clauses that every match's text meets, each ``("or", [trigrams that occur together, ...])``
    or ``("any", [clauses, ...])``; an empty list means that the rule scans fully, as one that ignores case does."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return []
    strings, clauses = _walk(parsed)
    if strings is not None and (c := _clause(strings)) is not True:
        clauses = [*clauses, c]
    return clauses


def _named(clauses) -> set[bytes]:
    out: set[bytes] = set()
    for how, ways in clauses:
        for w in ways:
            out |= set(w) if how == "or" else _named(w)
    return out


def _hits(clauses, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows of the segment that meet all clauses: intersections of postings, united."""
    rows = np.ones(n, bool)
    for how, ways in clauses:
        some = np.zeros(n, bool)
        for w in ways:
            some |= np.logical_and.reduce([postings[t] for t in w]) if how == "or" else _hits(w, postings, n)
        rows &= some
    return rows


class _Scanner:
    def __init__(self, rules):
        self.rules = [(k, r, re.compile(r.pattern), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        named = sorted(set().union(*(_named(q) for *_, q in self.rules)))
        self.named = named
        self.slot = np.zeros(1 << 24, np.uint8 if len(named) < 255 else np.uint16)
        for i, t in enumerate(named):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        """The segment's inverted index: for each trigram of the queries the rows that hold it."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        b = self.fold[np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)].astype(np.uint32)
        found = self.slot[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(r) + 2 for r in raw])
        table = np.zeros((len(self.named) + 1, len(texts)), bool)
        table[found[at], np.searchsorted(ends, at, "right")] = True
        return {t: table[i + 1] for i, t in enumerate(self.named)}

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        index = self.postings(texts)
        for k, rule, regex, query in self.rules:
            for i in np.flatnonzero(_hits(query, index, len(texts))):
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, rule.kind, m.end()))
        return [[(kind, a, z) for a, _, kind, z in sorted(f)] for f in found]


def _spans_of(rules, text_at: int, replace: bool):
    def run(batches):
        scanner = _Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for start, end in text_slices(b.column(text_at)):
                part = b.slice(start, end - start)
                kept = part.column(text_at).to_pylist()
                spans = scanner.scan([t or "" for t in kept])
                if replace:
                    new = pa.array([t and _masked(t, s) for t, s in zip(kept, spans, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([new if i == text_at else c for i, c in enumerate(part.columns)], names=part.schema.names)
                else:
                    rows = [[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in spans]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])
    return run


def _masked(text: str, spans) -> str:
    out, at = [], 0
    for _, a, z in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, z)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points; by start, then rule order) per row.

    Whole texts are read. A null or empty text has no spans; a null doc_id and repeated rows stay as
    they are; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _spans_of(rules, 1, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """The same rows and columns with each span of ``text`` replaced by ``[secret]`` (null stays null);
    overlapping spans become one mark."""
    return docs.mapInArrow(_spans_of(rules, docs.columns.index("text"), True), docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *(count(k) for k in kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Each document's secrets, counted and as spans."""
    return digest_columns(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _op10_sql() -> str:
    """Matches of each rule in order, their places from the lengths of what stands between them."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'k': length(k[i])}})) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS k, string_split_regex(t, '{p}') AS g FROM d) WHERE len(m) > 0""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, kind, rank, CAST(x.s AS BIGINT) AS a, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) AS w FROM f WHERE x.k >= CASE kind {least} END),
g AS (SELECT doc_id, {counts}, string_agg(w, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base, string_agg(w, ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP10_SQL = _op10_sql()
