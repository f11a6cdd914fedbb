"""op13: each language's phrases that occur more often than their parts would by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.collocations import collocations


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM s),
f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f
  FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
x AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, e.f AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(h.f AS HUGEINT) * e.f) AS BIGINT) AS score
  FROM c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1:c.k], ' ')
    JOIN f e ON e.lang = c.lang AND e.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')
    JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
y AS (
  SELECT lang, f AS outer_f, string_split(phrase, ' ') AS ws, m, unnest(range(2, m)) AS part FROM f WHERE m >= 3),
z AS (SELECT *, unnest(range(1, m - part + 2)) AS i FROM y),
v AS (SELECT lang, array_to_string(ws[i:i + part - 1], ' ') AS phrase, max(outer_f) AS outer_f FROM z GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
  phrase, a, l, r, n, score
FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.lang = b.lang AND v.phrase = b.phrase AND 100 * v.outer_f >= 100 * b.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": SQL}
