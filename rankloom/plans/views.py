"""Input views the queries run on, built from the given tables.

Every view is one SQL text that both Spark and DuckDB accept, with ``{table}`` slots for its inputs;
the few lines that differ between the two engines are slots as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

#: Requests name this share of constraints by case; every part row gives one request.
_REQUEST_TEXT = """
SELECT p_partkey AS request_id,
  CONCAT('Need ', LOWER(p_type),
    CASE p_partkey % 5 WHEN 0 THEN ' with more than ' WHEN 1 THEN ' with less than '
      WHEN 2 THEN ' with at least ' WHEN 3 THEN ' between 5 and ' ELSE ' only ' END,
    CAST(p_size AS STRING), ' years',
    CASE p_partkey % 3 WHEN 0 THEN ' for budget of ' WHEN 1 THEN ' under ' ELSE ' around ' END,
    CAST(CAST(FLOOR(p_retailprice) AS INT) AS STRING),
    CASE p_partkey % 7 WHEN 0 THEN ' not in mumbai' WHEN 1 THEN ' in delhi and pune'
      WHEN 2 THEN ' from chennai, kolkata' WHEN 3 THEN ' based in jaipur' ELSE '' END,
    CASE p_partkey % 11 WHEN 0 THEN ' specializing in family law or tax law'
      WHEN 1 THEN ' without civil law' WHEN 2 THEN ' not criminal law'
      WHEN 3 THEN ' expert in cyber law' WHEN 4 THEN ' handling property law cases'
      WHEN 5 THEN ' practicing divorce law, avoid tax law' ELSE '' END) AS text,
  p_partkey % (SELECT COUNT(*) FROM {embeddings}) AS vec_id
FROM {part}
"""

VIEWS: dict[str, str] = {
    "catalog": """
SELECT p_partkey AS item_id, p_name AS name, p_type AS domain, p_size AS experience,
  p_retailprice AS price, CAST(COALESCE(s.settlements, 0) AS BIGINT) AS settlements,
  CAST(COALESCE(CAST(FLOOR(s.q * 2 / s.n) AS INT), 0) AS DOUBLE) / 10 AS satisfaction
FROM {part} LEFT JOIN (
  SELECT l_partkey, SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS settlements,
    SUM(l_quantity) AS q, COUNT(*) AS n FROM {lineitem} GROUP BY l_partkey) s ON l_partkey = p_partkey
""",
    "directory": """
SELECT c_custkey AS id, c_name AS name, CONCAT(CAST(c_custkey % 31 AS STRING), ' Years') AS experience,
  CONCAT(n_name, ', ', r_name) AS location, COALESCE(t.spec, '') AS specialization
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
LEFT JOIN (
  SELECT o_custkey, {joined_types} AS spec
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey
  WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' GROUP BY o_custkey) t ON o_custkey = c_custkey
""",
    "baskets": """
SELECT DISTINCT l_orderkey AS basket_id, p_type AS item FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
""",
    "item_vec": """
SELECT item_id, embedding FROM (
  SELECT p_partkey AS item_id, p_partkey % (SELECT COUNT(*) FROM {embeddings}) AS of_vec FROM {part}) p
JOIN {embeddings} ON vec_id = of_vec
""",
    "requests": _REQUEST_TEXT,
    "folders": """
SELECT CONCAT('folder_', CAST(conv_id % 5 AS STRING)) AS folder, conv_id
FROM (SELECT DISTINCT conv_id FROM {conversations}) t UNION ALL SELECT 'folder_0', -1
""",
}

_SPARK_SLOTS = {"joined_types": "array_join(array_sort(collect_set(p_type)), ',')"}
_DUCKDB_SLOTS = {"joined_types": "string_agg(DISTINCT p_type, ',' ORDER BY p_type)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input view as a lazy DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for slot, value in _SPARK_SLOTS.items():
        text = text.replace("{" + slot + "}", value)
    return spark.sql(text, **used)


@cache
def duckdb_view(name: str) -> str:
    text = VIEWS[name]
    for slot, value in {**{t: t for t in TABLES}, **_DUCKDB_SLOTS}.items():
        text = text.replace("{" + slot + "}", value)
    return text.strip()


def oracle(views: Iterable[str], body: str, extra: str = "") -> str:
    """DuckDB text: the named views as CTEs, further CTEs in ``extra``, then ``body``."""
    ctes = [f"{v} AS MATERIALIZED ({duckdb_view(v)})" for v in views]
    if extra.strip():
        ctes.append(extra.strip())
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body.strip()
