"""Wide rows without columns: dictionaries and sparse rows over high-cardinality keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.catalog.export_queries import _QUESTIONS
from spanledger.catalog.registry import query
from spanledger.operators import answers as Q, collapse as C, sparse as S
from spanledger.sources.adapters import Tables

_COLUMNS = ["l_returnflag", "part", "supplier"]
_LINES = """x AS (SELECT l_orderkey, l_linenumber, l_returnflag, 'p' || l_partkey AS part, CASE WHEN l_linenumber <> 3 THEN 's' || l_suppkey END AS supplier FROM lineitem),
t AS (SELECT DISTINCT feature, value FROM (SELECT 'l_returnflag' AS feature, l_returnflag AS value FROM x UNION ALL SELECT 'part', part FROM x
 UNION ALL SELECT 'supplier', supplier FROM x) WHERE value IS NOT NULL)"""


def _lines(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.concat(F.lit("p"), "l_partkey").alias("part"),
                             F.when(F.col("l_linenumber") != 3, F.concat(F.lit("s"), "l_suppkey")).alias("supplier"))


def _flat(rows, *keys: str):
    return rows.select(*keys, "size", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"),
                       F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("ordinal_wide", f"""WITH {_LINES}, v AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value))::INT AS code FROM t)
SELECT l_orderkey, l_linenumber, a.code AS l_returnflag, b.code AS part, coalesce(c.code, -1) AS supplier FROM x JOIN v a ON a.feature = 'l_returnflag' AND a.value = l_returnflag
 JOIN v b ON b.feature = 'part' AND b.value = part LEFT JOIN v c ON c.feature = 'supplier' AND c.value = supplier""")
def ordinal_wide(t: Tables):
    rows = _lines(t)
    return S.ordinal_wide(rows, _COLUMNS, C.vocabulary(rows, _COLUMNS))


@query("onehot_sparse", f"""WITH {_LINES}, d AS (SELECT feature, value, row_number() OVER (ORDER BY feature, value) - 1 AS place FROM t),
c AS (SELECT DISTINCT l_orderkey, place FROM x JOIN d ON (feature = 'l_returnflag' AND value = l_returnflag) OR (feature = 'part' AND value = part) OR (feature = 'supplier' AND value = supplier))
SELECT l_orderkey, (SELECT count(*) FROM t)::BIGINT AS size, string_agg(place::VARCHAR, ',' ORDER BY place) AS indices, count(*)::DOUBLE AS total FROM c GROUP BY 1""")
def onehot_sparse(t: Tables):
    rows = _lines(t)
    return _flat(S.onehot_sparse(rows, ["l_orderkey"], _COLUMNS, S.dictionary(S.terms_of(rows, _COLUMNS))), "l_orderkey")


@query("questionnaire_sparse", _QUESTIONS + """,
k AS (SELECT question, bool_and(regexp_full_match(answer, '[0-9]+')) AS num FROM l GROUP BY 1),
c AS (SELECT client, question, CASE WHEN NOT num THEN CASE WHEN answer = '0' THEN 'Unknown' ELSE answer END END AS value, CASE WHEN num THEN answer::DOUBLE ELSE 1 END AS x FROM l JOIN k USING (question)),
d AS (SELECT question, value, row_number() OVER (ORDER BY question, value NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT question, value FROM c))
SELECT client AS "ClientID", (SELECT count(*) FROM d)::BIGINT AS size, coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (WHERE x <> 0), '') AS indices, sum(x)::DOUBLE AS total
FROM c JOIN d ON d.question = c.question AND d.value IS NOT DISTINCT FROM c.value GROUP BY 1""")
def questionnaire_sparse(t: Tables):
    last = Q.last_answers(*Q.question_roots(Q.question_subst(Q.answers_asof(t.answers(), "2024-01-24 00:00:00"))))
    cells = S.answer_cells(last, Q.answer_types(last))
    return _flat(S.sparse_rows(cells, ["ClientID"], S.dictionary(cells)), "ClientID")
