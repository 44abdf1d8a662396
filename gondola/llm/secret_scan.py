"""Secrets in text: three fixed patterns, and assignments read as name-literal pairs.

Source and configuration text is cut into tokens, and a reader of assignments goes over
them (``assignments``): it pairs names with literals, puts constants in their place as long
as their block lasts, and joins the pieces of a literal. A literal is scored by how sensitive
the names are that it reaches, times how much it looks like a random string. Under a strongly
sensitive name any quoted literal of eight characters or more counts, passphrases too, but for
addresses and for names that end in what tells of a secret without being one
(``password_field``, ``token_url``). Literals over the threshold add spans of kind ``literal``,
one for each piece; the spans of the fixed patterns are always kept. All of it takes time in
proportion to the text.

Null texts count as empty and have no span. Repeated rows and repeated or null keys give
one row each. An empty table gives an empty result. Extra columns are ignored. Texts of
any length are scanned whole; places are counted in code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.assignments import Reader
from gondola.llm.texts import id_and_text, replaced, slices

#: The three patterns, the least length of each, and the order of kinds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a part of a name makes what is assigned to it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0,
    "accesskey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "authkey": 1.0,
    "bearer": 0.8, "auth": 0.7, "jwt": 0.8, "salt": 0.6, "key": 0.6,
}
THRESHOLD = 0.5
#: Least weight of a name under which a quoted literal need not look random.
STRONG = 0.9
#: Last parts of names that tell of a secret but hold none.
ABOUT = frozenset(
    "url uri endpoint field fields name names path file filename type label input box id "
    "ids prefix suffix header headers regex pattern hint placeholder length min max size "
    "expiry expires ttl policy count limit format algorithm scope scopes column param "
    "parameter env var variable title text message error page form reset".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", re.ASCII)
LOGIN_IN_ADDRESS = re.compile(r"://[^/@\s:]*+:[^/@\s]++@")
#: Every sensitive name holds one of these.
PIECES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "jwt", "salt")


def sensitivity(name: str) -> float:
    """The weight of the most sensitive part, or two parts together, of a name."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def randomness(literal: str) -> float:
    """From 0 to 1: length, entropy and mixture of characters of a literal."""
    if len(literal) < 8 or literal[0] in "<$%{" or " " in literal.strip():
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = (any(c.isdigit() for c in literal) + any(c.islower() for c in literal)
             + any(c.isupper() for c in literal) + any(not c.isalnum() for c in literal))
    if kinds < 2 or not any(c.isdigit() for c in literal):
        return 0.0
    return min(1.0, entropy / 3.0) * (0.75 if kinds == 2 else 1.0)


def score_of(literal: str, name: str, weight: float, quoted: bool) -> float:
    """The score of a literal under the most sensitive name it reaches."""
    if "://" in literal and not LOGIN_IN_ADDRESS.search(literal):
        return 0.0
    last = [p.lower() for p in NAME_PART.findall(name)][-1:]
    if last and last[0] in ABOUT:
        mixed = all(any(test(c) for c in literal) for test in (str.isdigit, str.islower, str.isupper))
        return weight * randomness(literal) if mixed and len(literal) >= 16 else 0.0
    # A quoted literal that begins like a placeholder is none of the secrets.
    sure = weight >= STRONG and quoted and len(literal.strip()) >= 8 and literal[0] not in "<$%{"
    return weight * (1.0 if sure else randomness(literal))


def assigned_literals(text: str) -> list[tuple[int, int, str, float]]:
    """Spans of literals with the most sensitive name each reaches, and its score."""
    lowered = text.lower()
    if not any(piece in lowered for piece in PIECES):
        return []
    reader = Reader(text, sensitivity)
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for spans, (weight, name) in reader.reached.items():
        score = score_of("".join(text[s:e] for s, e in spans), name, weight, spans in reader.quoted)
        if score >= THRESHOLD:
            for span in spans:
                found[span] = max(found.get(span, (0.0, "")), (score, name))
    return [(start, end, name, score) for (start, end), (score, name) in found.items()]


def _covered(spans: list) -> Callable[[int, int], bool]:
    """Whether one of the spans holds a stretch; by search, for texts with very many."""
    starts, ends, furthest = [], [], 0
    for start, end, *_ in sorted(spans, key=lambda x: x[:2]):
        furthest = max(furthest, end)
        starts.append(start)
        ends.append(furthest)

    def inside(start: int, end: int) -> bool:
        at = bisect_right(starts, start) - 1
        return at >= 0 and ends[at] >= end
    return inside


def spans_of(text: str) -> list[tuple[int, int, str, str | None, float]]:
    """All spans by start, then kind: start, end, kind, name, score."""
    found: list[tuple[int, int, str, str | None, float]] = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign", m[1], 1.0) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access", None, 1.0) for m in ACCESS.finditer(text)
                  if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex", None, 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        inside = _covered(found)
        found += [(s, e, "literal", name, score) for s, e, name, score in assigned_literals(text)
                  if not inside(s, e)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPAN = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def find_secrets(docs: DataFrame, **columns: str) -> DataFrame:
    """Per document its ``spans``, by start and then kind: kind, start, end, the name
    assigned to (if any) and the score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                   ("end", pa.int32()), ("name", pa.string()),
                                   ("score", pa.float64())]))
        for batch in slices(batches):
            rows = [[{"kind": k, "start": s, "end": e, "name": name, "score": score}
                     for s, e, k, name, score in spans_of(text)]
                    for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return id_and_text(docs, **columns).mapInArrow(run, f"doc_id long, spans {SPAN}")


def secret_digests(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts per fixed pattern, a digest of their spans, and all spans as text."""
    spans = F.col("spans")

    def written(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] != "literal")
    return find_secrets(docs, **columns).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        count("literal").alias("n_literal"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", text_column: str = "text",
           count_column: str = "n_chars") -> DataFrame:
    """The table with every secret in the texts replaced by ``mark``.

    All columns stay; a ``count_column``, if there is one, follows the new lengths of
    the texts that changed. Null texts stay null.
    """
    schema = docs.schema
    counted = count_column in docs.columns

    def cleaned(text: str | None) -> str | None:
        spans = spans_of(text) if text else []
        if not spans:
            return text
        out, upto = [], 0
        for start, end, *_ in spans:
            if start >= upto:
                out += [text[upto:start], mark]
            upto = max(upto, end)
        return "".join([*out, text[upto:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            before = batch.column(text_column).to_pylist()
            after = [cleaned(t) for t in before]
            if counted:
                counts = [n if a is b or a == b else len(a) for n, a, b in zip(
                    batch.column(count_column).to_pylist(), after, before)]
                kind = batch.schema.field(count_column).type
                batch = replaced(batch, count_column, pa.array(counts, pa.int64()).cast(kind))
            yield replaced(batch, text_column, pa.array(after, pa.string()))

    return docs.mapInArrow(run, schema)
