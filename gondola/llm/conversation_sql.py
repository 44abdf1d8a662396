"""Repair of conversations as DuckDB SQL: least cost and edits by a recursive query.

Each step takes one row and carries, for every place in the pattern, the least pair of
cost and edit string that leads there, with the repaired text. Equal costs and places
mean that no edit string is the start of another, so the least string so far is the start
of the least string in the end.
"""

# crc32 by its bits: eight halvings for each of a key's characters, all of them ASCII.
_CRC = """
list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)),
        lambda r, x: xor(r >> 1, 3988292384 * (r & 1)))))
"""

_NONE = "{c: 1000000::BIGINT, e: '', t: ''}"


def _add(state: str, cost: str, letter: str, row: str | None) -> str:
    text = f"{state}.t" if row is None else (
        f"{state}.t || (CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END) || {row}")
    return f"{{c: {state}.c + {cost}, e: {state}.e || '{letter}', t: {text}}}"


def _step(raw: dict[str, str]) -> str:
    """Columns p0 to p3 from raw lists of candidates, then the inserts (user, assistant, user)."""
    return ", ".join(f"list_min([{candidates}]) AS {place}" for place, candidates in raw.items())


_KEEP = "r.role || ':' || r.text"
_USER, _ASSISTANT = "'user:' || r.text", "'assistant:' || r.text"


def _kept(state: str, initial: str) -> str:
    return (f"CASE WHEN r.free AND r.initial = '{initial}' THEN {_add(state, 'r.cut', 'K', _KEEP)} "
            f"ELSE {_NONE} END")


def _reroled(state: str, row: str) -> str:
    return f"CASE WHEN r.free THEN {_add(state, '3 + r.cut', 'R', row)} ELSE {_NONE} END"


_RAW = _step({
    "q0": _add("s.p0", "4", "D", None),
    "q1": ", ".join([_add("s.p1", "4", "D", None), _kept("s.p0", "s")]),
    "q2": ", ".join([_add("s.p2", "4", "D", None)]
                    + [x for p in ("s.p0", "s.p1", "s.p3") for x in (_kept(p, "u"), _reroled(p, _USER))]),
    "q3": ", ".join([_add("s.p3", "4", "D", None), _kept("s.p2", "a"), _reroled("s.p2", _ASSISTANT)]),
})


def _inserted(q: str) -> str:
    """Places 2 and 3 once empty rows may follow: at most two of them are of use."""
    user, assistant = "'user:'", "'assistant:'"
    to2 = [f"{q}2"] + [_add(f"{q}{p}", "3", "I", user) for p in (0, 1, 3)]
    x2 = f"list_min([{', '.join(to2)}])"
    return f"{q}0 AS p0, {q}1 AS p1, {x2} AS p2, {q}3 AS r3"


CONVERSATION_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
fated AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(sha256(text)), copy) AS n,
         left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail
  FROM damaged),
judged AS (
  SELECT *, tail = '' AS blank,
         tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         CASE WHEN right(tail, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut
  FROM placed),
faulted AS (
  SELECT *, NOT blank AND NOT again AS free,
         initial IS NOT NULL AND lag(initial) OVER o || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
steps AS (
  SELECT conv_id, 0::BIGINT AS n, {{c: 0::BIGINT, e: '', t: ''}} AS p0, {_NONE} AS p1,
         {{c: 3::BIGINT, e: 'I', t: 'user:'}} AS p2,
         {{c: 6::BIGINT, e: 'II', t: 'user:' || chr(10) || 'assistant:'}} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, p0, p1, list_min([p2, {_add("x3", "3", "I", "'user:'")}]) AS p2, x3 AS p3
  FROM (SELECT *, list_min([r3, {_add("p2", "3", "I", "'assistant:'")}]) AS x3
        FROM (SELECT conv_id, n, {_inserted("q")}
              FROM (SELECT s.conv_id, r.n, {_RAW}
                    FROM steps s JOIN faulted r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1)))),
best AS (
  SELECT conv_id, list_min([p0, p3]) AS b
  FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
         count(*) FILTER (free AND cut = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulted GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, b.c AS cost, b.e AS audit, sha256(b.t) AS repaired_sha256
FROM best LEFT JOIN counted ON best.conv_id IS NOT DISTINCT FROM counted.conv_id
"""
