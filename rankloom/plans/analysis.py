"""Queries over pattern mining, distributions, clustering and Pareto selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import clean, cluster, mining, portfolio, skyline, stats
from rankloom.operators.ordered import global_rank
from rankloom.operators.parse import domains_in_order
from rankloom.plans.profiles import DIRECTORY_CTE, prepared_directory
from rankloom.plans import recommend
from rankloom.plans.ranking import cos_sql
from rankloom.plans.views import oracle, table, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(col: str, out: str | None = None) -> Column:
    return F.round(col, 6).alias(out or col)


# --- aggregations and mining -----------------------------------------------------------------


@query("h1_domains_in_order", oracle(["catalog"], """
SELECT domain, first_id, ROW_NUMBER() OVER (ORDER BY first_id) AS place FROM (
  SELECT domain, MIN(item_id) AS first_id FROM catalog GROUP BY domain)"""))
def h1(spark, sf):
    return global_rank(domains_in_order(view(spark, sf, "catalog")), "first_id", "place")


@query("h2_basket_matrix", oracle(["baskets"], "SELECT basket_id, " + ", ".join(
    f"MAX(CASE WHEN item = '{t}' THEN 1 ELSE 0 END) AS {t}" for t in "ECONOMY LARGE MEDIUM PROMO SMALL STANDARD".split()
) + " FROM baskets GROUP BY basket_id"))
def h2(spark, sf):
    return mining.basket_matrix(view(spark, sf, "baskets"))


# Item sets as bit masks: each distinct basket mask is counted once, then every set is checked against it.
ITEMSETS_CTE = """
items AS (SELECT item, ROW_NUMBER() OVER (ORDER BY item) - 1 AS bit FROM (SELECT DISTINCT item FROM baskets)),
masks AS (SELECT mask, COUNT(*) AS n FROM (
  SELECT basket_id, SUM(1 << bit)::BIGINT AS mask FROM baskets JOIN items USING (item) GROUP BY basket_id) GROUP BY mask),
sets AS (SELECT UNNEST(range(1, 1 << (SELECT COUNT(*) FROM items)::INT))::BIGINT AS s),
found AS (SELECT s, SUM(n)::BIGINT AS freq FROM sets JOIN masks ON (mask & s) = s GROUP BY s),
named AS (SELECT s, freq, freq / (SELECT SUM(n) FROM masks)::DOUBLE AS support,
  string_agg(item, '|' ORDER BY item) AS items, COUNT(*) AS n_items
  FROM found JOIN items ON (s & (1 << bit)) <> 0 GROUP BY s, freq)
"""


def _itemsets(spark: SparkSession, sf: str, support: float) -> DataFrame:
    return mining.frequent_itemsets(view(spark, sf, "baskets"), support)


@query("h3_frequent_itemsets", oracle(["baskets"], """
SELECT items, n_items, freq, ROUND(support, 6) AS support FROM named WHERE support >= 0.1""", ITEMSETS_CTE))
def h3(spark, sf):
    found = _itemsets(spark, sf, 0.1)
    return found.select(F.array_join("items", "|").alias("items"), F.col("n_items").cast("bigint"), "freq", r6("support"))


THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 11)]
_THRESHOLD_SQL = "(SELECT UNNEST([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold)"


@query("h4_itemset_curve", oracle(["baskets"], f"""
SELECT threshold, COUNT(s) AS n_itemsets FROM {_THRESHOLD_SQL} LEFT JOIN named ON support >= threshold GROUP BY threshold""", ITEMSETS_CTE))
def h4(spark, sf):
    return mining.itemset_curve(_itemsets(spark, sf, THRESHOLDS[0]), THRESHOLDS)


@query("f5_top_itemsets", oracle(["baskets"], """
SELECT items, ROUND(support, 6) AS support FROM named WHERE support >= 0.1 ORDER BY freq DESC, n_items, items LIMIT 10""", ITEMSETS_CTE))
def f5(spark, sf):
    named = _itemsets(spark, sf, 0.1).withColumn("items", F.array_join("items", "|"))
    return named.orderBy(F.desc("freq"), "n_items", "items").limit(10).select("items", r6("support"))


@query("h5_summary_metrics", oracle(["catalog"], """
SELECT COUNT(*) AS n, ROUND(AVG(experience), 6) AS mean_experience, ROUND(AVG(settlements), 6) AS mean_settlements,
  ROUND(AVG(satisfaction), 6) AS mean_satisfaction, MIN(price) AS min_price, MAX(price) AS max_price FROM catalog"""))
def h5(spark, sf):
    m = stats.summary_metrics(view(spark, sf, "catalog"), ["experience", "settlements", "satisfaction"], "price")
    return m.select("n", r6("mean_experience"), r6("mean_settlements"), r6("mean_satisfaction"), "min_price", "max_price")


FRONT_CTE = """
pts AS (SELECT *, price AS f1, 10 - satisfaction AS f2 FROM catalog),
front AS (SELECT * FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)))
"""
_HIST = """
SELECT bin, ROUND(lo + bin * (hi - lo) / {n}, 6) AS bin_from, ROUND(lo + (bin + 1) * (hi - lo) / {n}, 6) AS bin_to, COUNT(x) AS n{more}
FROM (SELECT UNNEST(range(0, {n})) AS bin), (SELECT MIN(x)::DOUBLE AS lo, MAX(x)::DOUBLE AS hi FROM vals)
LEFT JOIN vals ON bin = LEAST(FLOOR((x - lo) / (hi - lo) * {n}), {n} - 1) GROUP BY bin, lo, hi"""


@query("h6_histogram", oracle(["catalog"], _HIST.format(n=10, more=""), "vals AS (SELECT experience AS x FROM catalog)"))
def h6(spark, sf):
    return stats.histogram(view(spark, sf, "catalog"), "experience", 10).select("bin", r6("bin_from"), r6("bin_to"), "n")


@query("h6_trade_off_histogram", oracle(["catalog"], _HIST.format(n=30, more=", COUNT(CASE WHEN on_front THEN 1 END) AS n_subset"),
       FRONT_CTE + ", vals AS (SELECT f1 * f2 AS x, item_id IN (SELECT item_id FROM front) AS on_front FROM pts)"))
def h6_trade(spark, sf):
    flagged = skyline.dominated_flag_2d(_points(spark, sf), "price", "f2").withColumn("trade_off", F.col("price") * F.col("f2"))
    found = stats.histogram(flagged, "trade_off", 30, subset=~F.col("dominated"))
    return found.select("bin", r6("bin_from"), r6("bin_to"), "n", "n_subset")


_BOX = """
SELECT {by} n, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  MIN(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
  MAX(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
  COUNT(CASE WHEN x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM (SELECT {by} x, COUNT(*) OVER w AS n, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.5) OVER w AS median,
  quantile_cont(x, 0.75) OVER w AS q3 FROM vals WINDOW w AS ({part})) GROUP BY {by} n, q1, median, q3"""


@query("h7_box_price", oracle(["catalog"], _BOX.format(by="", part=""), "vals AS (SELECT price AS x FROM catalog)"))
def h7(spark, sf):
    box = stats.box_stats(view(spark, sf, "catalog"), "price")
    return box.select("n", r6("q1"), r6("median"), r6("q3"), "whisker_low", "whisker_high", "n_outliers")


@query("h7_box_by_domain", oracle(["catalog"], _BOX.format(by="domain,", part="PARTITION BY domain"),
       "vals AS (SELECT domain, satisfaction AS x FROM catalog)"))
def h7_by(spark, sf):
    box = stats.box_stats(view(spark, sf, "catalog"), "satisfaction", ["domain"])
    return box.select("domain", "n", r6("q1"), r6("median"), r6("q3"), "whisker_low", "whisker_high", "n_outliers")


@query("h8_correlation", oracle(["catalog"], """
SELECT domain, COUNT(*) AS n, ROUND(corr(experience, price), 6) AS correlation FROM catalog GROUP BY domain"""))
def h8(spark, sf):
    return stats.correlation_by(view(spark, sf, "catalog"), "experience", "price", "domain").select("domain", "n", r6("correlation"))


_BINNED = """SELECT {by} LEAST(FLOOR((experience - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, COUNT(*) AS n, AVG({y}) AS m
FROM catalog, (SELECT MIN(experience)::DOUBLE AS lo, MAX(experience)::DOUBLE AS hi FROM catalog) GROUP BY ALL"""


@query("h8_binned_means", oracle(["catalog"], "SELECT domain, bin, n, ROUND(m, 6) AS mean_price FROM (" + _BINNED.format(by="domain,", y="price") + ")"))
def h8_binned(spark, sf):
    found = stats.binned_means(view(spark, sf, "catalog"), "experience", "price", "domain")
    return found.select("domain", "bin", "n", r6("mean_price"))


# --- clustering, scaling, reduction ----------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return clean.spec_score(prepared_directory(spark, sf), "experience_years").select(
        "id", "name", "city", "specialization", F.col("experience_years").alias("experience"), "spec_count", "score"
    )


REQUEST = "more than 5 years, not in nation_3 and nation_7, handles economy, without promo"


def _directory(spark: SparkSession, sf: str) -> DataFrame:
    """The directory as the ready-made chains take it: years as a number, a vector per row."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = prepared_directory(spark, sf).drop("experience").withColumnRenamed("experience_years", "experience")
    return rows.withColumn("vec_id", F.col("id") % n).join(vectors, "vec_id").drop("vec_id")


def _cities(spark: SparkSession, sf: str) -> list[str]:
    """The city vocabulary of the parser: the nations' names, a fixed-size table."""
    return [r[0] for r in table(spark, sf, "nation").select(F.lower("n_name")).collect()]


Z = ["z_experience", "z_spec_count"]
FEATURES_CTE = DIRECTORY_CTE + """,
feats AS (SELECT id, specialization, experience_years AS experience, len(specs) AS spec_count, experience_years + len(specs) AS score FROM prepared)
"""


def z_cte(source: str, keep: str = "id") -> str:
    return f"""
z AS (SELECT {keep}, (experience - me) / CASE WHEN se = 0 THEN 1 ELSE se END AS zx, (spec_count - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END AS zy
  FROM {source}, (SELECT AVG(experience) AS me, stddev_pop(experience) AS se, AVG(spec_count) AS ms, stddev_pop(spec_count) AS ss FROM {source}))"""


def lloyd_cte(rounds: int, keep: str = "id") -> str:
    """k-means rounds spelled out: seeds on the diagonal, then assign and average."""
    out = ["""
m0 AS (SELECT j AS c, x0 + (j + 0.5) / 3 * (x1 - x0) AS cx, y0 + (j + 0.5) / 3 * (y1 - y0) AS cy
  FROM (SELECT UNNEST(range(0, 3)) AS j), (SELECT MIN(zx) AS x0, MAX(zx) AS x1, MIN(zy) AS y0, MAX(zy) AS y1 FROM z))"""]
    for i in range(rounds + 1):
        out.append(f"""
a{i} AS (SELECT {keep}, zx, zy, arg_min(c, (ROUND((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy), 9), c)) AS c FROM z, m{i} GROUP BY {keep}, zx, zy)""")
        if i < rounds:
            out.append(f"""
m{i + 1} AS (SELECT row_number() OVER (ORDER BY {'cx, cy' if i == rounds - 1 else 'c'}) - 1 AS c, cx, cy FROM (
  SELECT m{i}.c, COALESCE(AVG(zx), ANY_VALUE(m{i}.cx)) AS cx, COALESCE(AVG(zy), ANY_VALUE(m{i}.cy)) AS cy
  FROM m{i} LEFT JOIN a{i} USING (c) GROUP BY m{i}.c))""")
    return ",".join(out)


@query("i1_zscores", oracle(["directory"], "SELECT id, ROUND(zx, 6) AS z_experience, ROUND(zy, 6) AS z_spec_count FROM z",
                            FEATURES_CTE + "," + z_cte("feats")))
def i1(spark, sf):
    return cluster.zscores(_features(spark, sf), ["experience", "spec_count"]).select("id", r6("z_experience"), r6("z_spec_count"))


@query("i2_lloyd_rounds", oracle(["directory"], "SELECT id, c AS cluster FROM a3", FEATURES_CTE + "," + z_cte("feats") + "," + lloyd_cte(3)))
def i2(spark, sf):
    scaled = cluster.zscores(_features(spark, sf), ["experience", "spec_count"])
    return cluster.lloyd_rounds(scaled, Z).select("id", F.col("cluster").cast("bigint"))


@query("i2_kmeans")
def i2_full(spark, sf):
    scaled = cluster.zscores(_features(spark, sf), ["experience", "spec_count"])
    return cluster.kmeans(scaled, Z).select("id", "cluster")


@query("i3_silhouette", oracle(["directory"], """
SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN own > 1 THEN (b - a) / GREATEST(a, b) ELSE 0 END), 6) AS silhouette FROM (
  SELECT id, MAX(CASE WHEN same THEN m END) AS own, MAX(CASE WHEN same THEN total / NULLIF(m - 1, 0) END) AS a, MIN(CASE WHEN NOT same THEN total / m END) AS b
  FROM (SELECT p.id, p.c = q.c AS same, q.c, COUNT(*) AS m, SUM(SQRT((p.zx - q.zx) * (p.zx - q.zx) + (p.zy - q.zy) * (p.zy - q.zy))) AS total
    FROM a3 p, a3 q GROUP BY p.id, p.c, q.c) GROUP BY id)""", FEATURES_CTE + "," + z_cte("feats") + "," + lloyd_cte(3)))
def i3_one(spark, sf):
    scaled = cluster.zscores(_features(spark, sf), ["experience", "spec_count"])
    return cluster.silhouette(cluster.lloyd_rounds(scaled, Z), Z).select("n", r6("silhouette"))


def curve_cte(rounds: int) -> str:
    """k-means rounds for k = 2..10 over distinct rows, and the silhouette of each: ends in ``curve``."""
    out = ["""
zc AS MATERIALIZED (SELECT zx, zy, COUNT(*)::DOUBLE AS n FROM z GROUP BY zx, zy),
km0 AS (SELECT k, j AS c, x0 + (j + 0.5) / k * (x1 - x0) AS cx, y0 + (j + 0.5) / k * (y1 - y0) AS cy
  FROM (SELECT k, UNNEST(range(0, k)) AS j FROM range(2, 11) r(k)), (SELECT MIN(zx) AS x0, MAX(zx) AS x1, MIN(zy) AS y0, MAX(zy) AS y1 FROM zc))"""]
    for i in range(rounds + 1):
        out.append(f"""
ka{i} AS MATERIALIZED (SELECT k, zx, zy, ANY_VALUE(n) AS n, arg_min(c, (ROUND((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy), 9), c)) AS c
  FROM zc, km{i} GROUP BY k, zx, zy)""")
        if i < rounds:
            out.append(f"""
km{i + 1} AS (SELECT m.k, m.c, COALESCE(SUM(zx * n) / SUM(n), ANY_VALUE(m.cx)) AS cx, COALESCE(SUM(zy * n) / SUM(n), ANY_VALUE(m.cy)) AS cy
  FROM km{i} m LEFT JOIN ka{i} a ON a.k = m.k AND a.c = m.c GROUP BY m.k, m.c)""")
    out.append(f"""
sums AS (SELECT p.k, p.zx, p.zy, p.n, p.c = q.c AS same, SUM(q.n) AS m, SUM(q.n * SQRT((p.zx - q.zx) * (p.zx - q.zx) + (p.zy - q.zy) * (p.zy - q.zy))) AS total
  FROM ka{rounds} p JOIN ka{rounds} q ON q.k = p.k GROUP BY p.k, p.zx, p.zy, p.n, p.c, q.c),
near AS (SELECT k, zx, zy, n, MAX(CASE WHEN same THEN total / NULLIF(m - 1, 0) END) AS a, MIN(CASE WHEN NOT same THEN total / m END) AS b FROM sums GROUP BY k, zx, zy, n),
curve AS (SELECT k, SUM(n * COALESCE((b - a) / NULLIF(GREATEST(a, b), 0), 0)) / SUM(n) AS silhouette FROM near GROUP BY k)""")
    return ",".join(out)


def _curve(spark: SparkSession, sf: str, method: str) -> DataFrame:
    scaled = cluster.zscores(_features(spark, sf), ["experience", "spec_count"])
    return cluster.silhouette_curve(scaled, Z, range(2, 11), method)


@query("i3_silhouette_curve", oracle(["directory"], "SELECT k, ROUND(silhouette, 6) AS silhouette FROM curve",
                                     FEATURES_CTE + "," + z_cte("feats") + "," + curve_cte(3)))
def i3(spark, sf):
    return _curve(spark, sf, "rounds").select("k", r6("silhouette"))


@query("i3_silhouette_curve_ml")
def i3_ml(spark, sf):
    return _curve(spark, sf, "ml")


def _itemset_positions(spark: SparkSession, sf: str) -> DataFrame:
    counts = mining.itemset_curve(_itemsets(spark, sf, THRESHOLDS[0]), THRESHOLDS)
    at = F.array_position(F.array(*[F.lit(t) for t in THRESHOLDS]), F.col("threshold")) - 1
    return counts.withColumn("position", at)


@query("i4_combined_curve", oracle(["baskets", "catalog"], f"""
SELECT position, ROUND(n / MAX(n) OVER () + m / MAX(m) OVER (), 6) AS combined FROM (
  SELECT ROW_NUMBER() OVER (ORDER BY threshold) - 1 AS position, COUNT(s)::DOUBLE AS n
  FROM {_THRESHOLD_SQL} LEFT JOIN named ON support >= threshold GROUP BY threshold)
JOIN (SELECT bin AS position, m FROM ({_BINNED.format(by='', y='satisfaction')})) USING (position)""", ITEMSETS_CTE))
def i4(spark, sf):
    """Itemset counts against a second curve of the same length, here mean satisfaction per experience bin."""
    catalog = view(spark, sf, "catalog").withColumn("all", F.lit(1))
    curve = stats.binned_means(catalog, "experience", "satisfaction", "all").select(
        F.col("bin").alias("position"), F.col("mean_satisfaction").alias("silhouette")
    )
    return cluster.combined_curve(_itemset_positions(spark, sf), curve).select("position", r6("combined"))


@query("i4_itemsets_silhouettes", oracle(["baskets", "directory"], f"""
SELECT position, ROUND(n / top + silhouette / best, 6) AS combined FROM (
  SELECT *, MAX(n) OVER () AS top FROM (SELECT ROW_NUMBER() OVER (ORDER BY threshold) - 1 AS position, COUNT(s)::DOUBLE AS n
    FROM {_THRESHOLD_SQL} LEFT JOIN named ON support >= threshold GROUP BY threshold))
JOIN (SELECT k - 2 AS position, silhouette, MAX(silhouette) OVER () AS best FROM curve) USING (position)""",
    ITEMSETS_CTE.rstrip() + "," + FEATURES_CTE.lstrip(", \n") + "," + z_cte("feats") + "," + curve_cte(3)))
def i4_silhouettes(spark, sf):
    """Itemset counts per threshold against silhouettes per k, by position; the shorter curve decides the length."""
    curve = _curve(spark, sf, "rounds").select((F.col("k") - 2).alias("position"), "silhouette")
    return cluster.combined_curve(_itemset_positions(spark, sf), curve).select("position", r6("combined"))


@query("i5_principal_components")
def i5(spark, sf):
    return cluster.principal_components(table(spark, sf, "embeddings"), "vec_id", "embedding")


_UNIT = "list_transform({v}, lambda e: e / sqrt(list_dot_product({v}, {v})))"


@query("i5_component_rounds", f"""
WITH RECURSIVE flat AS (SELECT vec_id, UNNEST(range(0, len(embedding))) AS pos, UNNEST(embedding)::DOUBLE AS v FROM embeddings),
x AS (SELECT vec_id, pos, v - AVG(v) OVER (PARTITION BY pos) AS v FROM flat),
wide AS (SELECT vec_id, list(v ORDER BY pos) AS v FROM x GROUP BY vec_id),
scatter AS (SELECT list(line ORDER BY i) AS s FROM (SELECT i, list(v ORDER BY j) AS line FROM (
  SELECT a.pos AS i, b.pos AS j, SUM(a.v * b.v) AS v FROM x a JOIN x b USING (vec_id) GROUP BY a.pos, b.pos) GROUP BY i)),
seeds AS (SELECT list(sin(pos + 1) ORDER BY pos) AS v1, list(sin(2 * (pos + 1)) ORDER BY pos) AS v2 FROM (SELECT DISTINCT pos FROM x)),
rounds AS (SELECT 0 AS r, {_UNIT.format(v='v1')} AS v1, {_UNIT.format(v='v2')} AS v2 FROM seeds
  UNION ALL SELECT r, q1, {_UNIT.format(v='w')} FROM (
    SELECT r, q1, list_transform(list_zip(y2, q1), lambda p: p[1] - along * p[2]) AS w FROM (
      SELECT r, q1, y2, list_dot_product(y2, q1) AS along FROM (
        SELECT r, {_UNIT.format(v='y1')} AS q1, y2 FROM (
          SELECT r + 1 AS r, list_transform(s, lambda l: list_dot_product(l, v1)) AS y1, list_transform(s, lambda l: list_dot_product(l, v2)) AS y2
          FROM rounds, scatter WHERE r < 20))))),
done AS (SELECT v1, v2, list_aggregate(list_transform(v1, lambda e: abs(e)), 'max') AS t1, list_aggregate(list_transform(v2, lambda e: abs(e)), 'max') AS t2
  FROM rounds WHERE r = 20)
SELECT vec_id, ROUND(list_dot_product(v, v1) * CASE WHEN list_contains(v1, t1) THEN 1 ELSE -1 END, 6) AS pc1,
  ROUND(list_dot_product(v, v2) * CASE WHEN list_contains(v2, t2) THEN 1 ELSE -1 END, 6) AS pc2 FROM wide, done""")
def i5_rounds(spark, sf):
    found = cluster.component_rounds(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", r6("pc1"), r6("pc2"))


@query("f3_hybrid_filter", oracle(["directory"], """
SELECT id, cluster, score FROM (SELECT id, c AS cluster, score FROM a3 JOIN feats USING (id)) ORDER BY cluster, score DESC, id LIMIT 5""",
       FEATURES_CTE + ", pool AS (SELECT * FROM feats WHERE contains(LOWER(specialization), 'econ') AND experience >= 10),"
       + z_cte("pool") + "," + lloyd_cte(3)))
def f3(spark, sf):
    """Filter form of the hybrid ranking: filter, score, scale, cluster, first rows by cluster and score."""
    found = recommend.recommend_hybrid(_directory(spark, sf), "Econ", 10, method="rounds")
    return found.select("id", F.col("cluster").cast("bigint"), F.col("score").cast("bigint"))


@query("f3_hybrid_query")
def f3_query(spark, sf):
    """Query form: one request's full parse as filters, similarity and years inside k-means clusters."""
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first().embedding
    found = recommend.recommend_by_request(_directory(spark, sf), REQUEST, vector, cities=_cities(spark, sf))
    return found.select("id", "name", "cluster", "rank_specs")


@query("f3_plain_request", oracle(["directory"], f"""
SELECT id, ROUND({cos_sql('embedding', 'q')} + experience_years / 50.0::DOUBLE, 6) AS rank
FROM prepared JOIN embeddings ON vec_id = id % (SELECT COUNT(*) FROM embeddings), (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
WHERE experience_years >= 6 AND city NOT IN ('nation_3', 'nation_7')
  AND len(list_filter(specs, lambda s: contains(s, 'economy') OR contains('economy', s))) > 0
  AND NOT len(list_filter(specs, lambda s: contains(s, 'promo') OR contains('promo', s))) > 0
ORDER BY {cos_sql('embedding', 'q')} + experience_years / 50.0::DOUBLE DESC, id LIMIT 5""", DIRECTORY_CTE))
def f3_plain(spark, sf):
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first().embedding
    found = recommend.recommend_by_request(_directory(spark, sf), REQUEST, vector, cities=_cities(spark, sf), clusters=False)
    return found.select("id", r6("rank_experience", "rank"))


# Requests over the directory's own words: years, places and specialties by the number of the request.
_LISTED_REQUESTS = """
SELECT p_partkey AS request_id, p_partkey % (SELECT COUNT(*) FROM {embeddings}) AS vec_id,
  CONCAT(CASE p_partkey % 4 WHEN 0 THEN 'more than ' WHEN 1 THEN 'less than ' WHEN 2 THEN 'only ' ELSE 'about ' END, CAST(p_size % 31 AS STRING), ' years',
    CASE p_partkey % 3 WHEN 0 THEN ', not in nation_3 and nation_7' WHEN 1 THEN ', in nation_1, nation_12 and nation_20' ELSE '' END,
    CASE p_partkey % 5 WHEN 0 THEN ', handles economy or small' WHEN 1 THEN ', without promo' WHEN 2 THEN ', handles large, without medium' ELSE '' END) AS text
FROM {part}
"""


def _listed_sql() -> str:
    years = "CAST(p_size % 31 AS BIGINT)"
    return f"""
asked AS (SELECT p_partkey AS request_id, p_partkey % (SELECT COUNT(*) FROM embeddings) AS vec_id,
  CASE p_partkey % 4 WHEN 0 THEN {years} + 1 END AS lo, CASE p_partkey % 4 WHEN 1 THEN {years} - 1 END AS hi, CASE p_partkey % 4 WHEN 2 THEN {years} END AS eq,
  CASE p_partkey % 3 WHEN 1 THEN ['nation_1', 'nation_12', 'nation_20'] ELSE []::VARCHAR[] END AS inc,
  CASE p_partkey % 3 WHEN 0 THEN ['nation_3', 'nation_7'] ELSE []::VARCHAR[] END AS exc,
  CASE p_partkey % 5 WHEN 0 THEN ['economy', 'small'] WHEN 2 THEN ['large'] ELSE []::VARCHAR[] END AS want,
  CASE p_partkey % 5 WHEN 1 THEN ['promo'] WHEN 2 THEN ['medium'] ELSE []::VARCHAR[] END AS avoid FROM part),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


@query("f3_plain_requests", oracle(["directory"], """
SELECT request_id, id, rank FROM (
  SELECT request_id, id, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ROUND(list_cosine_similarity(a.v, b.v) + experience_years / 50.0::DOUBLE, 9) DESC, id) AS rank
  FROM prepared JOIN vecs b ON b.vec_id = id % (SELECT COUNT(*) FROM embeddings), asked JOIN vecs a ON a.vec_id = asked.vec_id
  WHERE CASE WHEN eq IS NOT NULL THEN experience_years = eq ELSE COALESCE(experience_years >= lo, TRUE) AND COALESCE(experience_years <= hi, TRUE) END
    AND (len(inc) = 0 OR list_contains(inc, city)) AND NOT list_contains(exc, city)
    AND (len(want) = 0 OR len(list_filter(specs, lambda s: len(list_filter(want, lambda t: contains(s, t) OR contains(t, s))) > 0)) > 0)
    AND len(list_filter(specs, lambda s: len(list_filter(avoid, lambda t: contains(s, t) OR contains(t, s))) > 0)) = 0)
WHERE rank <= 5""", DIRECTORY_CTE + "," + _listed_sql()))
def f3_plain_requests(spark, sf):
    """Every request of a table, parsed, matched with the whole directory and ranked in one plan."""
    asked = spark.sql(_LISTED_REQUESTS, embeddings=table(spark, sf, "embeddings"), part=table(spark, sf, "part"))
    requests = asked.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    return recommend.recommend_by_requests(_directory(spark, sf), requests, _cities(spark, sf)).select("request_id", "id", "rank")


def keyed_lloyd_cte(rounds: int) -> str:
    """k-means rounds of every request's pool, over the distinct feature rows of ``pool``; ends in centres and assignments."""
    out = ["""
st AS (SELECT request_id, AVG(experience) AS me, stddev_pop(experience) AS se, AVG(spec_count) AS ms, stddev_pop(spec_count) AS ss FROM pool GROUP BY request_id),
z AS (SELECT request_id, experience, spec_count, COUNT(*) AS n, ANY_VALUE((experience - me) / CASE WHEN se = 0 THEN 1 ELSE se END) AS zx,
    ANY_VALUE((spec_count - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END) AS zy
  FROM pool JOIN st USING (request_id) GROUP BY request_id, experience, spec_count),
m0 AS (SELECT request_id, j AS c, x0 + (j + 0.5) / 3 * (x1 - x0) AS cx, y0 + (j + 0.5) / 3 * (y1 - y0) AS cy
  FROM (SELECT UNNEST(range(0, 3)) AS j), (SELECT request_id, MIN(zx) AS x0, MAX(zx) AS x1, MIN(zy) AS y0, MAX(zy) AS y1 FROM z GROUP BY request_id))"""]
    for i in range(rounds + 1):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT request_id, experience, spec_count, ANY_VALUE(n) AS n, ANY_VALUE(zx) AS zx, ANY_VALUE(zy) AS zy,
    arg_min(c, (ROUND((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy), 9), c)) AS c FROM z JOIN m{i} USING (request_id) GROUP BY request_id, experience, spec_count)""")
        if i < rounds:
            out.append(f"""
m{i + 1} AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY {'ROUND(cx, 9) + 0, ROUND(cy, 9) + 0, cx, cy' if i == rounds - 1 else 'c'}) - 1 AS c, cx, cy FROM (
  SELECT m{i}.request_id, m{i}.c, COALESCE(SUM(zx * n) / SUM(n), ANY_VALUE(m{i}.cx)) AS cx, COALESCE(SUM(zy * n) / SUM(n), ANY_VALUE(m{i}.cy)) AS cy
  FROM m{i} LEFT JOIN a{i} USING (request_id, c) GROUP BY m{i}.request_id, m{i}.c))""")
    return ",".join(out)


@query("f3_hybrid_requests", oracle(["directory"], """
SELECT request_id, id, cluster, ROUND(score, 6) AS score, rank FROM (
  SELECT request_id, id, c AS cluster, score, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY c, score DESC, id) AS rank FROM (
    SELECT request_id, id, c, ROUND(list_cosine_similarity(a.v, b.v) + experience / 50.0::DOUBLE + spec_count / 10.0::DOUBLE, 9) AS score
    FROM pool JOIN a3 USING (request_id, experience, spec_count) JOIN vecs a ON a.vec_id = asked_vec
      JOIN vecs b ON b.vec_id = id % (SELECT COUNT(*) FROM embeddings)))
WHERE rank <= 5""", DIRECTORY_CTE + "," + _listed_sql() + """,
pool AS MATERIALIZED (SELECT request_id, asked.vec_id AS asked_vec, id, experience_years AS experience, len(specs) AS spec_count FROM prepared, asked
  WHERE CASE WHEN eq IS NOT NULL THEN experience_years = eq ELSE COALESCE(experience_years >= lo, TRUE) AND COALESCE(experience_years <= hi, TRUE) END
    AND (len(inc) = 0 OR list_contains(inc, city)) AND NOT list_contains(exc, city)
    AND (len(want) = 0 OR len(list_filter(want, lambda t: contains(LOWER(specialization), t))) > 0)
    AND len(list_filter(avoid, lambda t: contains(LOWER(specialization), t))) = 0),""" + keyed_lloyd_cte(3)))
def f3_hybrid_requests(spark, sf):
    """Every request of a table through the clustered query form: its own pool, its own clusters, one plan for all."""
    found = recommend.recommend_hybrid_requests(_directory(spark, sf), _listed_requests(spark, sf, _LISTED_REQUESTS), _cities(spark, sf))
    return found.select("request_id", "id", "cluster", r6("score"), "rank")


# Requests of the bounds form: years, a place, specialties and wishes by the number of the request.
_PREFERENCE_REQUESTS = """
SELECT p_partkey AS request_id, p_partkey % (SELECT COUNT(*) FROM {embeddings}) AS vec_id,
  CONCAT(CASE p_partkey % 4 WHEN 0 THEN 'more than ' WHEN 1 THEN 'less than ' WHEN 2 THEN 'at least ' ELSE 'about ' END, CAST(p_size % 31 AS STRING), ' years',
    CASE p_partkey % 3 WHEN 0 THEN ', located in asia' WHEN 1 THEN ', located in america' ELSE '' END,
    CASE p_partkey % 5 WHEN 0 THEN ', handling economy law' WHEN 1 THEN ', avoid promo law' WHEN 2 THEN ', handling large law, avoid medium law' ELSE '' END) AS text
FROM {part}
"""


def _listed_requests(spark: SparkSession, sf: str, text: str) -> DataFrame:
    asked = spark.sql(text, embeddings=table(spark, sf, "embeddings"), part=table(spark, sf, "part"))
    return asked.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


@query("f3_preferences_requests", oracle(["directory"], """
SELECT request_id, id, cluster, ROUND(score, 6) AS score, rank FROM (
  SELECT request_id, id, c AS cluster, score, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY c, score DESC, id) AS rank FROM (
    SELECT request_id, id, c, ROUND(list_cosine_similarity(a.v, b.v) + bonus + (experience + spec_count) / 10.0::DOUBLE, 9) AS score
    FROM pool JOIN a3 USING (request_id, experience, spec_count) JOIN vecs a ON a.vec_id = asked_vec
      JOIN vecs b ON b.vec_id = id % (SELECT COUNT(*) FROM embeddings)))
WHERE rank <= 3""", DIRECTORY_CTE + "," + """
asked AS (SELECT p_partkey AS request_id, p_partkey % (SELECT COUNT(*) FROM embeddings) AS vec_id,
  CASE WHEN p_partkey % 4 IN (0, 2) THEN CAST(p_size % 31 AS BIGINT) + 1 END AS lo, CASE p_partkey % 4 WHEN 1 THEN CAST(p_size % 31 AS BIGINT) - 1 END AS hi,
  CASE p_partkey % 3 WHEN 0 THEN 'asia' WHEN 1 THEN 'america' END AS spot,
  CASE p_partkey % 5 WHEN 0 THEN 'economy law' WHEN 2 THEN 'large law' END AS required,
  CASE p_partkey % 5 WHEN 1 THEN 'promo' WHEN 2 THEN 'medium' END AS bad FROM part),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pool AS MATERIALIZED (SELECT request_id, asked.vec_id AS asked_vec, id, experience_years AS experience, len(specs) AS spec_count,
    (CASE WHEN contains(LOWER(specialization), required) THEN 0.2 ELSE 0 END - CASE WHEN contains(LOWER(location), bad) THEN 0.2 ELSE 0 END
      - CASE WHEN contains(LOWER(specialization), bad || ' law') THEN 0.2 ELSE 0 END)::DOUBLE AS bonus
  FROM prepared, asked WHERE COALESCE(experience_years >= lo, TRUE) AND COALESCE(experience_years <= hi, TRUE)
    AND (spot IS NULL OR contains(LOWER(location), spot))),""" + keyed_lloyd_cte(3)))
def f3_preferences_requests(spark, sf):
    """Every request of a table through the bounds form."""
    found = recommend.recommend_preferences_requests(_directory(spark, sf), _listed_requests(spark, sf, _PREFERENCE_REQUESTS))
    return found.select("request_id", "id", "cluster", r6("score"), "rank")


@query("h2_basket_cells", oracle(["baskets"], "SELECT basket_id, item, 1 AS present FROM baskets"))
def h2_cells(spark, sf):
    """The basket matrix in long form, for any number of items."""
    return mining.basket_cells(view(spark, sf, "baskets"))


REQUEST_CTE = DIRECTORY_CTE + f""",
pool AS (SELECT id, experience_years AS experience, len(specs) AS spec_count, {cos_sql('embedding', 'q')} AS similarity
  FROM prepared JOIN embeddings ON vec_id = id % (SELECT COUNT(*) FROM embeddings), (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
  WHERE experience_years >= 6 AND city NOT IN ('nation_3', 'nation_7')
    AND contains(LOWER(specialization), 'economy') AND NOT contains(LOWER(specialization), 'promo'))
"""


@query("f3_hybrid_query_rounds", oracle(["directory"], """
SELECT id, c AS cluster, ROUND(similarity + experience / 50.0::DOUBLE + spec_count / 10.0::DOUBLE, 6) AS rank FROM a3 JOIN pool USING (id)
ORDER BY c, similarity + experience / 50.0::DOUBLE + spec_count / 10.0::DOUBLE DESC, id LIMIT 5""", REQUEST_CTE + "," + z_cte("pool") + "," + lloyd_cte(3)))
def f3_query_rounds(spark, sf):
    """The query form with k-means of set rounds, whose result does not depend on a random start."""
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first().embedding
    found = recommend.recommend_by_request(_directory(spark, sf), REQUEST, vector, cities=_cities(spark, sf), method="rounds")
    return found.select("id", F.col("cluster").cast("bigint"), r6("rank_specs", "rank"))


PREFERENCES = "handling economy law, more than 3 years, located in asia, avoid promo law"


@query("f3_preferences_rounds", oracle(["directory"], """
SELECT id, c AS cluster, ROUND(final + score / 10.0::DOUBLE, 6) AS rank FROM a3 JOIN pool USING (id)
ORDER BY c, final + score / 10.0::DOUBLE DESC, id LIMIT 3""", DIRECTORY_CTE + f""",
pool AS (SELECT id, experience_years AS experience, len(specs) AS spec_count, experience_years + len(specs) AS score,
    {cos_sql('embedding', 'q')} + CASE WHEN contains(LOWER(specialization), 'economy law') THEN 0.2 ELSE 0 END::DOUBLE
      - CASE WHEN contains(LOWER(location), 'promo') THEN 0.2 ELSE 0 END::DOUBLE
      - CASE WHEN contains(LOWER(specialization), 'promo law') THEN 0.2 ELSE 0 END::DOUBLE AS final
  FROM prepared JOIN embeddings ON vec_id = id % (SELECT COUNT(*) FROM embeddings), (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
  WHERE experience_years >= 4 AND contains(LOWER(location), 'asia'))""" + "," + z_cte("pool") + "," + lloyd_cte(3)))
def f3_preferences_rounds(spark, sf):
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first().embedding
    found = recommend.recommend_by_preferences(_directory(spark, sf), PREFERENCES, vector, method="rounds")
    return found.select("id", F.col("cluster").cast("bigint"), r6("rank_score", "rank"))


@query("f3_preferences")
def f3_preferences(spark, sf):
    """Bounds form: the place filters, preferences move the similarity, score decides inside clusters."""
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first().embedding
    found = recommend.recommend_by_preferences(_directory(spark, sf), PREFERENCES, vector)
    return found.select("id", "name", "cluster", "rank_score")


# --- multi-objective selection ---------------------------------------------------------------


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "catalog").withColumn("f2", 10 - F.col("satisfaction"))


@query("g7_dominated", oracle(["catalog"], "SELECT item_id, item_id NOT IN (SELECT item_id FROM front) AS dominated FROM pts", FRONT_CTE))
def g7(spark, sf):
    return skyline.dominated_flag_2d(_points(spark, sf), "price", "f2").select("item_id", "dominated")


@query("j1_pareto_front_2d", oracle(["catalog"], "SELECT item_id, price, satisfaction FROM front", FRONT_CTE))
def j1(spark, sf):
    return skyline.pareto_front_2d(_points(spark, sf), "price", "f2").select("item_id", "price", "satisfaction")


FOUR_CTE = """
four AS (SELECT item_id, -experience::DOUBLE AS a, -settlements::DOUBLE AS b, -satisfaction AS c, price AS d FROM catalog)
"""


@query("j2_pareto_front", oracle(["catalog"], """
SELECT item_id FROM four p WHERE NOT EXISTS (SELECT 1 FROM four q WHERE q.a <= p.a AND q.b <= p.b AND q.c <= p.c AND q.d <= p.d
  AND (q.a < p.a OR q.b < p.b OR q.c < p.c OR q.d < p.d))""", FOUR_CTE))
def j2(spark, sf):
    pts = skyline.objective_columns(view(spark, sf, "catalog"), ["price"], ["experience", "settlements", "satisfaction"])
    return skyline.pareto_front(pts, portfolio.OBJECTIVES).select("item_id")


def ranks_cte(fronts: int) -> str:
    out, rest = ["pts AS (SELECT *, price AS f1, 10 - satisfaction AS f2 FROM catalog)"], "pts"
    for i in range(fronts):
        out.append(f"""front{i} AS MATERIALIZED (SELECT *, {i} AS front FROM {rest} a WHERE NOT EXISTS (
  SELECT 1 FROM {rest} b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)))""")
        out.append(f"rest{i} AS MATERIALIZED (SELECT * FROM {rest} WHERE item_id NOT IN (SELECT item_id FROM front{i}))")
        rest = f"rest{i}"
    union = " UNION ALL ".join(f"SELECT item_id, f1, f2, front FROM front{i}" for i in range(fronts))
    return ", ".join(out) + f", ranked AS ({union})"


CROWD_CTE = ranks_cte(3) + """,
lens AS (SELECT front, item_id, 1 AS o, f1 AS v FROM ranked UNION ALL SELECT front, item_id, 2, f2 FROM ranked),
gaps AS (SELECT front, item_id, LAG(v) OVER w AS p, LEAD(v) OVER w AS q, MIN(v) OVER g AS lo, MAX(v) OVER g AS hi
  FROM lens WINDOW w AS (PARTITION BY front, o ORDER BY v, item_id), g AS (PARTITION BY front, o)),
crowd AS (SELECT front, item_id, SUM(CASE WHEN p IS NULL OR q IS NULL THEN 1e9 WHEN hi > lo THEN (q - p) / (hi - lo) ELSE 0 END) AS c
  FROM gaps GROUP BY front, item_id),
finite AS (SELECT front, item_id, CASE WHEN c >= 1e9 THEN -1.0::DOUBLE ELSE ROUND(c, 6) END AS crowding, ROUND(LEAST(c, 1e9), 9) AS c FROM crowd)
"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return skyline.front_ranks_2d(_points(spark, sf), "price", "f2", 3)


def _crowded(spark: SparkSession, sf: str) -> DataFrame:
    found = skyline.crowding_distance(_ranked(spark, sf), "front", ["price", "f2"], "item_id")
    return found.withColumn("crowding", F.round("crowding", 9))


def _finite() -> Column:
    return F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding")


@query("j3_front_ranks", oracle(["catalog"], "SELECT item_id, front FROM ranked", ranks_cte(3)))
def j3(spark, sf):
    return _ranked(spark, sf).select("item_id", "front")


@query("j4_crowding", oracle(["catalog"], "SELECT front, item_id, crowding FROM finite", CROWD_CTE))
def j4(spark, sf):
    return _crowded(spark, sf).select("front", "item_id", _finite())


@query("j5_truncate_archive", oracle(["catalog"], "SELECT front, item_id FROM finite ORDER BY front, c DESC, item_id LIMIT 12", CROWD_CTE))
def j5(spark, sf):
    return skyline.truncate_archive(_crowded(spark, sf), 12, "item_id").select("front", "item_id")


@query("j5_update_archive", oracle(["catalog"], "SELECT front, item_id FROM finite ORDER BY front, c DESC, item_id LIMIT 25",
       CROWD_CTE.replace(ranks_cte(3), ranks_cte(8).replace("FROM catalog)", "FROM catalog WHERE price <= 980 OR satisfaction >= 5)"))))
def j5_update(spark, sf):
    pts = _points(spark, sf).select("item_id", "price", "f2", "satisfaction")
    archive, fresh = pts.where("price <= 980"), pts.where("satisfaction >= 5")
    return skyline.update_archive(archive, fresh, "price", "f2", "item_id", 25).select("front", "item_id")


@query("j6_front_by_trade_off", oracle(["catalog"], """
SELECT item_id, name, domain, price, satisfaction, ROUND(f1 * f2, 6) AS trade_off FROM front ORDER BY f1 * f2, item_id LIMIT 10""", FRONT_CTE))
def j6(spark, sf):
    return recommend.recommend_pareto(view(spark, sf, "catalog"), 10).select("item_id", "name", "domain", "price", "satisfaction", r6("trade_off"))


_AREA = """
SELECT {by} ROUND(SUM((r1 - f1) * (COALESCE(p, r2) - f2)), 6) AS hypervolume, COUNT(*) AS front_points
FROM (SELECT {by} f1, f2, LAG(f2) OVER ({part} ORDER BY f1) AS p FROM (SELECT DISTINCT {by} f1, f2 FROM {src})),
  (SELECT MAX(f1) * 1.1 AS r1, MAX(f2) * 1.1 AS r2 FROM pts) {group}"""


def _reference(points: DataFrame) -> tuple[Column, Column]:
    far = points.agg(F.struct((F.max("price") * 1.1).alias("r1"), (F.max("f2") * 1.1).alias("r2")).alias("r")).scalar()
    return far["r1"], far["r2"]


@query("j7_hypervolume_2d", oracle(["catalog"], _AREA.format(by="", part="", src="front", group=""), FRONT_CTE))
def j7(spark, sf):
    pts = _points(spark, sf)
    return skyline.hypervolume_2d(pts, "price", "f2", *_reference(pts)).select(r6("hypervolume"), "front_points")


@query("j14_front_progress", oracle(["catalog"], """
SELECT v.step, hypervolume, archive_size FROM (""" + _AREA.format(by="step,", part="PARTITION BY step", src="stepped", group="GROUP BY step") + """) v
JOIN (SELECT step, COUNT(*) AS archive_size FROM stepped GROUP BY step) s ON s.step = v.step""", """
pts AS (SELECT item_id, item_id % 5 AS batch, price AS f1, 10 - satisfaction AS f2 FROM catalog),
steps AS (SELECT UNNEST(range(0, 5)) AS step),
stepped AS (SELECT step, a.* FROM steps JOIN pts a ON a.batch <= step WHERE NOT EXISTS (
  SELECT 1 FROM pts b WHERE b.batch <= step AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)))"""))
def j14(spark, sf):
    pts = _points(spark, sf).withColumn("batch", F.col("item_id") % 5)
    found = skyline.front_progress(pts, "batch", "item_id", "price", "f2", 5, *_reference(pts))
    return found.select("step", r6("hypervolume"), "archive_size")


# --- portfolios ------------------------------------------------------------------------------

N_SOLUTIONS = 20


def solutions(spark: SparkSession, sf: str) -> DataFrame:
    """Weight vectors of 20 solutions from 4 seeds over the whole catalog."""
    pool = view(spark, sf, "catalog").select("item_id")
    rows = pool.withColumn("sol_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(N_SOLUTIONS).cast("bigint"))))
    w = ((F.col("item_id") * 7919 + F.col("sol_id") * 104729) % 1000).cast("double") / 1000
    return rows.select("sol_id", (F.col("sol_id") % 4).alias("seed"), "item_id", w.alias("w"))


def solutions_cte(where: str = "TRUE") -> str:
    return f"""
solutions AS (SELECT sol_id, sol_id % 4 AS seed, item_id, CAST((item_id * 7919 + sol_id * 104729) % 1000 AS DOUBLE) / 1000 AS w
  FROM (SELECT item_id, UNNEST(range(1, {N_SOLUTIONS + 1})) AS sol_id FROM catalog WHERE {where})),
objs AS (SELECT seed, sol_id, -SUM(w * experience) / (SUM(w) + 1e-6) AS a, -SUM(w * settlements) / (SUM(w) + 1e-6) AS b,
  -SUM(w * satisfaction) / (SUM(w) + 1e-6) AS c, SUM(w * price) / (SUM(w) + 1e-6) AS d
  FROM solutions JOIN catalog USING (item_id) GROUP BY seed, sol_id),
reps AS (SELECT sol_id, arg_max(item_id, (w, -item_id)) AS item_id FROM solutions GROUP BY sol_id),
best AS (SELECT * FROM objs p WHERE NOT EXISTS (SELECT 1 FROM objs q WHERE q.a <= p.a AND q.b <= p.b AND q.c <= p.c AND q.d <= p.d
  AND (q.a < p.a OR q.b < p.b OR q.c < p.c OR q.d < p.d)))
"""


SOLUTIONS_CTE = solutions_cte()
_OBJ_SQL = "ROUND(a, 6) AS obj_experience, ROUND(b, 6) AS obj_settlements, ROUND(c, 6) AS obj_satisfaction, ROUND(d, 6) AS obj_price"


@query("g6_solution_product", oracle(["catalog"], """
SELECT sol_id, ROUND(SUM(w * experience), 6) AS experience, ROUND(SUM(w * price), 6) AS price
FROM solutions JOIN catalog USING (item_id) GROUP BY sol_id""", SOLUTIONS_CTE))
def g6(spark, sf):
    joined = portfolio.with_profiles(solutions(spark, sf), view(spark, sf, "catalog"))
    return joined.groupBy("sol_id").agg(*[F.round(F.sum(F.col("w") * F.col(c)), 6).alias(c) for c in ("experience", "price")])


@query("j9_solution_objectives", oracle(["catalog"], f"SELECT sol_id, {_OBJ_SQL} FROM objs", SOLUTIONS_CTE))
def j9(spark, sf):
    found = portfolio.solution_objectives(solutions(spark, sf), view(spark, sf, "catalog"))
    return found.select("sol_id", *[r6(c) for c in portfolio.OBJECTIVES])


@query("j10_representatives", oracle(["catalog"], "SELECT sol_id, item_id FROM reps", SOLUTIONS_CTE))
def j10(spark, sf):
    return portfolio.representatives(solutions(spark, sf))


@query("j11_select_portfolio", oracle(["catalog"], """
SELECT item_id, name, price, ROUND(d, 6) AS price_objective FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY sol_id) AS rn FROM best JOIN reps USING (sol_id) JOIN catalog USING (item_id))
WHERE rn = 1""", solutions_cte("domain = 'ECONOMY' AND price <= 950")))
def j11(spark, sf):
    chosen = recommend.recommend_portfolio(view(spark, sf, "catalog"), solutions(spark, sf), "ECONOMY", 950)
    return chosen.select("item_id", "name", "price", r6("obj_price", "price_objective"))


@query("j12_merge_solutions", oracle(["catalog"], """
SELECT item_id, name, seed, sol_id, ROUND(-a, 6) AS experience_score, ROUND(-b, 6) AS settlements_score,
  ROUND(-c, 6) AS satisfaction_score, ROUND(d, 6) AS price_objective FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY seed, sol_id) AS rn FROM objs JOIN reps USING (sol_id) JOIN catalog USING (item_id))
WHERE rn = 1""", SOLUTIONS_CTE))
def j12(spark, sf):
    merged = portfolio.merge_solutions(solutions(spark, sf), view(spark, sf, "catalog"))
    return merged.select("item_id", "name", "seed", "sol_id", r6("experience_score"), r6("settlements_score"),
                         r6("satisfaction_score"), r6("price_objective"))


@query("j12_merged_metrics", oracle(["catalog"], """
SELECT COUNT(*) AS n, ROUND(AVG(-a), 6) AS mean_experience_score, ROUND(AVG(-b), 6) AS mean_settlements_score,
  ROUND(AVG(-c), 6) AS mean_satisfaction_score, MIN(price) AS min_price, MAX(price) AS max_price FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY seed, sol_id) AS rn FROM objs JOIN reps USING (sol_id) JOIN catalog USING (item_id))
WHERE rn = 1""", SOLUTIONS_CTE))
def j12_metrics(spark, sf):
    merged = portfolio.merge_solutions(solutions(spark, sf), view(spark, sf, "catalog"))
    m = stats.summary_metrics(merged, ["experience_score", "settlements_score", "satisfaction_score"], "price")
    return m.select("n", r6("mean_experience_score"), r6("mean_settlements_score"), r6("mean_satisfaction_score"), "min_price", "max_price")


# The oracle cuts space into the grid of all solution coordinates and sums the dominated cells.
@query("j8_hypervolume_4d", oracle(["catalog"], """
SELECT ROUND(SUM((an - a) * (bn - b) * (cn - c) * (dn - d)), 4) AS hypervolume, (SELECT COUNT(*) FROM best) AS front_points
FROM ga, gb, gc, gd WHERE EXISTS (SELECT 1 FROM best p WHERE p.a <= ga.a AND p.b <= gb.b AND p.c <= gc.c AND p.d <= gd.d)""",
       SOLUTIONS_CTE + "," + ",".join(f"""
g{x} AS (SELECT {x}, COALESCE(LEAD({x}) OVER (ORDER BY {x}), {ref}) AS {x}n FROM (SELECT DISTINCT {x} FROM best))""" for x, ref in zip("abcd", (0, 0, 0, 50000)))))
def j8(spark, sf):
    objs = portfolio.solution_objectives(solutions(spark, sf), view(spark, sf, "catalog"))
    found = skyline.hypervolume_4d(objs, portfolio.OBJECTIVES, [0, 0, 0, 50000])
    return found.select(F.round("hypervolume", 4).alias("hypervolume"), "front_points")
