"""The longer SQL texts (DuckDB) for queries of this subpackage."""

from __future__ import annotations



def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text."""
    byte = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT), lambda c, b: {byte}), 4294967295)"


def _tree(leaves: str, name: str, levels: int) -> str:
    """CTEs of a tree over `leaves` (g, r, d, n): name0 to nameN (g, r, d, n), and nameSk with each node's siblings on level k."""
    out = [f"{name}0 AS (SELECT g, r, d, n FROM {leaves})"]
    for k in range(1, levels + 1):
        last = f"{name}{k - 1}"
        out.append(f"{name}{k} AS (SELECT g, r // 8 AS r, CASE WHEN any_value(n) > {8 ** (k - 1)} THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d, any_value(n) AS n FROM {last} GROUP BY g, r // 8)")
        run = "PARTITION BY g, r // 8 ORDER BY r"
        out.append(
            f"{name}S{k - 1} AS (SELECT g, r, n > {8 ** (k - 1)} AS there, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,"
            f" coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {last})"
        )
    return ",\n".join(out)


def _climb(name: str, levels: int, rank: str, group: str, of: str) -> str:
    """CTEs that take rows of `of` (own, proof, ...) up a tree, a level each."""
    out, last = [], of
    for k in range(levels):
        at = f"{of}_{k + 1}"
        out.append(f"{at} AS (SELECT x.* REPLACE (CASE WHEN s.there THEN sha256(s.lft || x.own || s.rgt) ELSE x.own END AS own, CASE WHEN s.there THEN x.proof || s.lft || s.rgt ELSE x.proof END AS proof) FROM {last} x JOIN {name}S{k} s ON s.g = x.{group} AND s.r = x.{rank} // {8 ** k})")
        last = at
    return ",\n".join(out)


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Trees of up to 8 ** 7 documents a language and 8 ** 3 languages.
DEPTH, LANGUAGES = 7, 3
MERKLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('text')} AS d,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS t FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM docs),
{_tree('leaves', 'a', DEPTH)},
subs AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS r, d, count(*) OVER () AS n FROM a{DEPTH}),
{_tree('subs', 'b', LANGUAGES)},
up AS (SELECT l.doc_id, l.d AS leaf, l.g, l.r, '' AS top, s.r AS sr, s.d AS subroot, coalesce(l.t, l.d) AS own, '' AS proof FROM leaves l JOIN subs s ON s.name = l.g),
{_climb('a', DEPTH, 'r', 'g', 'up')},
{_climb('b', LANGUAGES, 'sr', 'top', f'up_{DEPTH}')}
SELECT doc_id, leaf, subroot, (SELECT d FROM b{LANGUAGES}) AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = (SELECT d FROM b{LANGUAGES}) AS verified
FROM up_{DEPTH}_{LANGUAGES}
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _ways(*arcs: tuple[str, str, str, str, str]) -> str:
    """SQL for the least (cost, labels, text) of arcs (condition, cost, label, the row it writes or '', the struct after it)."""

    def one(condition: str, cost: str, label: str, writes: str, then: str) -> str:
        text = f"{{'l': {then}.l}}.l"
        rest = f"CASE WHEN len({then}.t) > 0 THEN chr(10) || {then}.t ELSE '' END"
        return f"CASE WHEN {condition} THEN {{'c': {then}.c + {cost}, 'l': '{label}' || {text}, 't': {writes + ' || ' + rest if writes else then + '.t'}}} END"

    return f"list_min(list_filter([{', '.join(one(*a) for a in arcs)}], lambda w: w IS NOT NULL))"


_DELETE = lambda q: ("true", "3", "D", "", f"v.{q}")
_KEEP = lambda initial, then: (f"NOT forced AND left(role, 1) = '{initial}'", "cut", "K", "role || ':' || text", f"v.{then}")
_REROLE = lambda role, then: ("NOT forced", "2 + cut", "R", f"'{role}:' || text", f"v.{then}")
_INSERT = lambda role, of, then: ("true", "2", "I", f"'{role}:'", f"{of}.{then}")
_BASE = {
    "b": (_DELETE("b"), _KEEP("s", "s"), _KEEP("u", "u"), _REROLE("user", "u")),
    "s": (_DELETE("s"), _KEEP("u", "u"), _REROLE("user", "u")),
    "u": (_DELETE("u"), _KEEP("a", "a"), _REROLE("assistant", "a")),
    "a": (_DELETE("a"), _KEEP("u", "u"), _REROLE("user", "u")),
}
_THEN = {"b": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}


def _round(of: str) -> str:
    """The four states' ways with one insertion more than those of `of`."""
    return "{" + ", ".join(f"'{q}': {_ways(('true', '0', '', '', 'w.' + q), _INSERT(role, of, then))}" for q, (role, then) in _THEN.items()) + "}"


_END = "{'b': {'c': 0, 'l': '', 't': ''}, 's': {'c': 4, 'l': 'II', 't': 'user:' || chr(10) || 'assistant:'}, 'u': {'c': 2, 'l': 'I', 't': 'assistant:'}, 'a': {'c': 0, 'l': '', 't': ''}}"
CONVERSATIONS = f"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM lots WHERE lot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {_SPACE}) AS body FROM damaged),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS forced, (fault = 'truncated')::INT AS cut FROM marked),
back AS (
  SELECT conv_id, n AS i, {_END} AS v FROM rows_ WHERE i = n
  UNION ALL
  SELECT conv_id, i - 1, {_round('y')} FROM (
    SELECT conv_id, i, w, {_round('w')} AS y FROM (
      SELECT r.conv_id, r.i, {{{', '.join(f"'{q}': {_ways(*arcs)}" for q, arcs in _BASE.items())}}} AS w
      FROM back b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i))),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, coalesce(b.v.b.c, 0)::BIGINT AS cost, coalesce(b.v.b.l, '') AS audit, sha256(coalesce(b.v.b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0
"""
