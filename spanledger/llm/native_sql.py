"""SQL counterparts of the operators that SQL can express."""

from __future__ import annotations

import re

from spanledger.llm import conversation_repair as R
from spanledger.llm import curriculum as C
from spanledger.llm import line_dedup as L
from spanledger.llm import quality_rules as Q

LINE_DEDUP = f"""
WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '{L.HOST}', 1)), '') AS host, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY ALL),
l AS (SELECT DISTINCT page_id, host, unnest(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)))) AS line FROM p),
b AS (SELECT host, line FROM l JOIN t USING (host) WHERE line <> '' GROUP BY ALL HAVING count(*) > 1 AND count(*) > {L.RATIO} * any_value(pages)),
g AS (SELECT host, list(line) AS gone FROM b GROUP BY ALL),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM p LEFT JOIN g USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k"""

_CELLS = ", ".join(f"('{r}', {i}, {c})" for r in Q.RULES for i, c in enumerate(Q.GRID))
_RATIO = " ".join(f"WHEN '{r}' THEN 1000 * {a} > cutoff * {b}" for r, (a, b) in Q.RULES.items())
_N = len(Q.RULES)
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM documents),
w AS (SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
v AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM v) GROUP BY ALL),
f AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(body) - length(regexp_replace(body, '{Q.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  (length(body) - length(regexp_replace(body, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_capitals,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT} * n_words AS base_failed FROM f),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND md5(doc_id::VARCHAR)[1] NOT IN ('0', '1', '2') GROUP BY ALL),
h AS (SELECT j.*, quality FROM j JOIN m USING (doc_id) WHERE NOT base_failed),
s AS (SELECT stratum, count(*) FILTER (WHERE quality = 1) AS n FROM h GROUP BY ALL),
i AS (SELECT stratum, n, unnest(range(0, floor(n * {Q.RISK / _N})::BIGINT + 1)) AS k FROM s WHERE n > 0),
c AS (SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({Q.RISK / _N}) + (n - k) * ln(1 - {Q.RISK / _N}))) OVER (PARTITION BY stratum ORDER BY k) AS p FROM i),
a AS (SELECT stratum, max(k) AS allowed FROM c WHERE p <= {Q.ERROR / _N} / (SELECT count(*) FROM s) GROUP BY ALL),
g AS (SELECT * FROM (VALUES {_CELLS}) AS t(rule, level, cutoff)),
x AS (SELECT stratum, rule, level, cutoff, count(*) FILTER (WHERE quality = 0 AND hit) AS bad, count(*) FILTER (WHERE quality = 1 AND hit) AS good
  FROM (SELECT h.*, g.*, CASE rule {_RATIO} END AS hit FROM h, g) GROUP BY ALL),
y AS (SELECT x.*, max(CASE WHEN good > coalesce(allowed, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY level) AS stop FROM x LEFT JOIN a USING (stratum)),
z AS (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {Q.COST} * good DESC, level) AS place FROM y WHERE stop = 0),
q AS (SELECT stratum, rule, cutoff FROM z WHERE place = 1 AND bad > {Q.COST} * good),
u AS (SELECT DISTINCT doc_id FROM j JOIN q USING (stratum) WHERE CASE rule {_RATIO} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND u.doc_id IS NULL AS kept FROM j LEFT JOIN u USING (doc_id)"""


#: Weights over the time of the training, for the sources in turn: first much and then less, more and more, always the same. Their integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (0.5, 4.0), (1.0, 0.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))
_WEIGHTS = ", ".join(str(C.integral(s)) for s in SCHEDULES)
_TIME = re.sub(r"(\d)D\b", r"\1::DOUBLE", C.time_of(SCHEDULES, "kind", "(a / goal)"))
CURRICULUM = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> ''))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
k AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(SCHEDULES)} AS kind FROM o),
w AS (SELECT *, list_extract([{_WEIGHTS}]::DOUBLE[], kind::INT + 1) AS weight FROM k),
-- Sources stop in the order of words / weight: the first number of stopped ones that leaves none of the others above its bound.
c AS (SELECT *, coalesce(sum(2.0 * words) OVER s, 0) AS gone, sum(weight) OVER () - coalesce(sum(weight) OVER s, 0) AS left_weight, 1.5 * sum(words) OVER () AS total, row_number() OVER (ORDER BY words / weight, source NULLS LAST) AS m FROM w
  WINDOW s AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - gone) / left_weight, m) FILTER (WHERE (total - gone) / left_weight * weight <= 2.0 * words) AS level FROM c),
t AS (SELECT w.*, least(level * weight, 2.0 * words) AS target, floor(least(level * weight, 2.0 * words) + 0.5) AS goal FROM w, l),
g AS (SELECT source, h, max(size) AS size, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT g.*, sum(n * size) OVER (PARTITION BY source ORDER BY h) - n * size AS b FROM g),
v AS (SELECT b.source, h, n, size, kind, words, target, goal, b + p * words AS a, p FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS x(p)),
y AS (SELECT *, (greatest(0, least(goal - a, n * size))::BIGINT // n)::BIGINT AS x FROM v),
z AS (SELECT source, h, max(words)::BIGINT AS source_size, max(target) AS target, sum(x)::BIGINT AS taken,
  max(CASE WHEN x > 0 THEN {_TIME} END) FILTER (WHERE p = 0) AS position, max(CASE WHEN x > 0 THEN {_TIME} END) FILTER (WHERE p = 1) AS again FROM y GROUP BY ALL)
SELECT doc_id, d.size, source_size, target, taken, position, again FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.h = z.h"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM r a JOIN r x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER n ::INT AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW n AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER n <= 5"""


def _repair_sql() -> str:
    """The least of the cheapest edits by recursion from the last turn to the first, with whole audits and texts kept for every state."""
    states = dict(enumerate("esua"))

    def put(cost: str, way: str, line: str, rest: str) -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{way}' || {rest}.a, 'l': list_concat([{line}]::VARCHAR[], {rest}.l)}}"

    def settled(own: str) -> str:
        """Insertions before the next turn; ``own`` is a struct of the best of every state."""
        for _ in range(2):
            own = "struct_pack(" + ", ".join(
                f"{q} := list_sort([o.{q}, " + put(str(R.INSERT), "I", f"'{R.NAMES[R.NEXT[i]]}:'", f"o.{states[R.NEXT[i]]}") + "])[1]" for i, q in states.items()) + f") FOR o IN [{own}]"
            own = f"([{own}])[1]"
        return own

    ways = []
    for i, q in states.items():
        to = states[R.NEXT[i]]
        kept = " ".join(f"WHEN initial = '{role}' THEN " + put("stays", "K", "role || ':' || text", f"b.{states[z]}") for role, z in R.MOVES[i].items())
        moved = put(f"{R.REROLE} + stays", "R", f"'{R.NAMES[R.NEXT[i]]}:' || text", f"b.{to}")
        deleted = put(str(R.DELETE), "D", "", f"b.{q}")
        ways.append(f"{q} := list_sort(CASE WHEN gone THEN [{deleted}] ELSE list_filter([{deleted}, {moved}, CASE {kept} END], lambda x: x IS NOT NULL) END)[1]")
    none = "{'c': 1000000000, 'a': '', 'l': []::VARCHAR[]}"
    end = "{'c': 0, 'a': '', 'l': []::VARCHAR[]}"
    last = settled(f"struct_pack(e := {end}, s := {none}, u := {none}, a := {end})")
    step = settled(f"struct_pack({', '.join(ways)})")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {space}) AS body, substr(role, 1, 1) AS initial FROM d),
f AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS later, NOT right(body, 1) IN ('.', '!', '?') AS cut FROM n),
g AS (SELECT *, blank OR later AS gone, CASE WHEN cut THEN {R.TRUNCATED} ELSE 0 END AS stays, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM f),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE later AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut AND NOT blank AND NOT later) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY ALL),
r AS (SELECT conv_id, n AS i, {last} AS b FROM facts
  UNION ALL SELECT r.conv_id, r.i - 1, {step} FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.e.c, 0)::BIGINT AS cost, coalesce(b.e.a, '') AS audit, sha256(coalesce(array_to_string(b.e.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON c.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN (SELECT * FROM r WHERE i = 0) z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""


CONVERSATION_REPAIR = _repair_sql()
