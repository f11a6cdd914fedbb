"""Queries over matching, scoring, ranking, ranking quality and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.vectors import cosine, mean_pool
from rankloom.operators import clean, match, score, stats, text_similarity
from rankloom.plans import recommend
from rankloom.plans.profiles import BASIC_CTE, DIRECTORY_CTE, DOMAIN_CTE, prepared_directory
from rankloom.plans.views import oracle, table, view
from rankloom.sources.documents import results_json

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


# --- inputs shared by several queries --------------------------------------------------------


def items_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "catalog").join(view(spark, sf, "item_vec"), "item_id")


def requests_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "requests").join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


def parsed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with parsed constraints, detected domain and vector."""
    return recommend.match_requests(requests_with_vectors(spark, sf), view(spark, sf, "catalog"))


def ranked_requests(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return match.top_k(parsed_requests(spark, sf), items_with_vectors(spark, sf), k)


def mean_vector(spark: SparkSession, sf: str) -> Column:
    """The mean of all vectors, standing in for one request's vector."""
    return mean_pool(table(spark, sf, "embeddings"), [], "embedding", "mean").scalar()


def items_by_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with its similarity to the mean vector, at ranking precision."""
    scored = items_with_vectors(spark, sf).withColumn("_q", mean_vector(spark, sf))
    return scored.withColumn("similarity", F.round(cosine("embedding", "_q"), match.RANK_DECIMALS)).drop("_q")


def scored_directory(spark: SparkSession, sf: str) -> DataFrame:
    """The directory with similarity, preference score, spec count and score."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    base = prepared_directory(spark, sf).withColumn("vec_id", F.col("id") % n).join(vectors, "vec_id")
    base = base.withColumn("_q", mean_vector(spark, sf)).withColumn("similarity", cosine("embedding", "_q"))
    scored = score.preference_score(base, "promo", ["asia", "africa"], ["economy"])
    return clean.spec_score(scored, "experience_years").drop("experience").withColumnRenamed("experience_years", "experience")


MEAN_CTE = """
long AS (SELECT UNNEST(range(1, len(embedding) + 1)) AS pos, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings),
mean_vec AS (SELECT list(m ORDER BY pos) AS q FROM (SELECT pos, AVG(v) AS m FROM long GROUP BY pos))
"""
_COS = ("list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / SQRT(list_dot_product(CAST({a} AS DOUBLE[]), "
        "CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))")


def cos_sql(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


SIMILAR_CTE = MEAN_CTE + f""",
similar_items AS (SELECT catalog.*, embedding, ROUND({cos_sql('embedding', 'q')}, 9) AS similarity
  FROM catalog JOIN item_vec USING (item_id), mean_vec)
"""
SCORED_CTE = DIRECTORY_CTE + "," + MEAN_CTE + f""",
scored AS (SELECT p.* EXCLUDE (experience, experience_years), experience_years AS experience, {cos_sql('embedding', 'q')} AS similarity,
    CASE WHEN contains(LOWER(specialization), 'promo') THEN 0.2 ELSE 0.0 END::DOUBLE AS spec_bonus,
    CASE WHEN contains(LOWER(location), 'asia') OR contains(LOWER(location), 'africa') THEN -0.2 ELSE 0.0 END::DOUBLE AS location_penalty,
    CASE WHEN contains(LOWER(specialization), 'economy') THEN -0.2 ELSE 0.0 END::DOUBLE AS spec_penalty,
    len(specs) AS spec_count, experience_years + len(specs) AS score
  FROM prepared p JOIN embeddings ON vec_id = id % (SELECT COUNT(*) FROM embeddings), mean_vec)
"""
PAIRS_CTE = BASIC_CTE + "," + DOMAIN_CTE + f""",
pairs AS (SELECT request_id, c.item_id, name, c.domain, experience, price, satisfaction,
    ROUND({cos_sql('e.embedding', 'i.embedding')}, 9) AS similarity
  FROM parsed LEFT JOIN detected d USING (request_id) JOIN embeddings e USING (vec_id)
  JOIN catalog c ON (d.domain IS NULL OR LOWER(d.domain) = LOWER(c.domain))
    AND (exp_op IS NULL OR (exp_op = 'less' AND experience < exp_years) OR (exp_op = 'more' AND experience > exp_years))
    AND (budget IS NULL OR price <= budget)
  JOIN item_vec i USING (item_id)),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY similarity DESC, item_id) AS rank FROM pairs)
"""
PAIR_VIEWS = ["requests", "catalog", "item_vec"]

# --- matching --------------------------------------------------------------------------------


@query("g1_batch_match", oracle(PAIR_VIEWS, "SELECT request_id, COUNT(*) AS n_matches FROM pairs GROUP BY request_id", PAIRS_CTE))
def g1(spark, sf):
    return match.match_stats(parsed_requests(spark, sf), items_with_vectors(spark, sf)).select("request_id", "n_matches")


@query("e2_filtered_similarity", oracle(PAIR_VIEWS, """
SELECT request_id, COUNT(*) AS n_matches, ROUND(AVG(similarity), 6) AS mean_similarity, ROUND(MAX(similarity), 6) AS best_similarity
FROM pairs GROUP BY request_id""", PAIRS_CTE))
def e2(spark, sf):
    found = match.match_stats(parsed_requests(spark, sf), items_with_vectors(spark, sf))
    return found.select("request_id", "n_matches", r6("mean_similarity"), r6("best_similarity"))


@query("f1_top_items", oracle(PAIR_VIEWS, """
SELECT request_id, rank, item_id, ROUND(similarity, 6) AS similarity FROM placed WHERE rank <= 5""", PAIRS_CTE))
def f1(spark, sf):
    return ranked_requests(spark, sf, 5).select("request_id", "rank", "item_id", r6("similarity"))


@query("f1_recommend", oracle(PAIR_VIEWS, """
SELECT request_id, rank, name, domain, CAST(experience AS VARCHAR) || ' years' AS experience,
  '₹' || CAST(CAST(round_even(price, 0) AS BIGINT) AS VARCHAR) AS price, CAST(satisfaction AS VARCHAR) || '/10' AS satisfaction
FROM placed WHERE rank <= 5""", PAIRS_CTE))
def f1_recommend(spark, sf):
    """Requests to display-ready top items: parse, match, score, rank, format."""
    chosen = recommend.recommend_by_text(requests_with_vectors(spark, sf), items_with_vectors(spark, sf))
    return chosen.select("request_id", "rank", "name", "domain", "experience", "price", "satisfaction")


@query("a6_results_json", oracle(PAIR_VIEWS, """
SELECT request_id, COUNT(rank) AS n_items, string_agg(name, '|' ORDER BY rank) AS names,
  CASE WHEN COUNT(rank) = 0 THEN '⚠️ No lawyers found!' END AS message
FROM requests LEFT JOIN (SELECT request_id, rank, name FROM placed WHERE rank <= 5) USING (request_id) GROUP BY request_id""", PAIRS_CTE))
def a6(spark, sf):
    chosen = clean.display_format(ranked_requests(spark, sf, 5).join(view(spark, sf, "catalog"), "item_id"))
    docs = results_json(view(spark, sf, "requests"), chosen, ["name", "domain", "experience", "price", "satisfaction"])
    names = F.from_json("document", "lawyers array<struct<name string>>, message string")
    read = docs.withColumn("d", names)
    return read.select("request_id", "n_items", F.nullif(F.array_join("d.lawyers.name", "|"), F.lit("")).alias("names"), "d.message")


@query("g2_top_semi", oracle(["catalog", "item_vec"], """
SELECT item_id, name, domain FROM catalog WHERE name IN (
  SELECT name FROM similar_items ORDER BY similarity DESC, item_id LIMIT 10)""", SIMILAR_CTE))
def g2(spark, sf):
    top = items_by_similarity(spark, sf).orderBy(F.desc("similarity"), "item_id").limit(10)
    return view(spark, sf, "catalog").join(top.select("name").distinct(), "name", "left_semi").select("item_id", "name", "domain")


@query("g3_expected_rank", oracle(PAIR_VIEWS, """
SELECT request_id, rank, ROUND(similarity, 6) AS similarity FROM requests
LEFT JOIN (SELECT * FROM placed WHERE item_id = request_id) USING (request_id)""", PAIRS_CTE))
def g3(spark, sf):
    """The place of the expected item (here the one of the request's own number) in the whole ranking, null if it is not allowed."""
    requests = requests_with_vectors(spark, sf)
    expected = requests.select("request_id", F.col("request_id").alias("item_id"))
    found = match.expected_ranks(recommend.match_requests(requests, items_with_vectors(spark, sf)), items_with_vectors(spark, sf), expected)
    return view(spark, sf, "requests").select("request_id").join(found, "request_id", "left").select("request_id", "rank", r6("similarity"))


# --- vectors and scores ----------------------------------------------------------------------


@query("e1_cosine", f"""
WITH long AS (SELECT label, UNNEST(range(1, len(embedding) + 1)) AS pos, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings),
centre AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, AVG(v) AS m FROM long GROUP BY label, pos) GROUP BY label)
SELECT vec_id, label, ROUND({cos_sql('embedding', 'c')}, 6) AS similarity FROM embeddings JOIN centre USING (label)""")
def e1(spark, sf):
    vectors = table(spark, sf, "embeddings")
    joined = vectors.join(mean_pool(vectors, ["label"], "embedding", "centre"), "label")
    return joined.select("vec_id", "label", F.round(cosine("embedding", "centre"), 6).alias("similarity"))


@query("e3_mean_pool", """
SELECT label, pos, ROUND(AVG(v), 6) AS mean FROM (
  SELECT label, UNNEST(range(0, len(embedding))) AS pos, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, pos""")
def e3(spark, sf):
    pooled = mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding", "mean")
    return pooled.select("label", F.posexplode("mean").alias("pos", "m")).select("label", F.col("pos").cast("bigint"), r6("m", "mean"))


TFIDF_CTE = """
WITH toks AS (SELECT doc_id, UNNEST(regexp_extract_all(LOWER(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM toks GROUP BY doc_id, term),
idf AS (SELECT term, LN((1 + (SELECT COUNT(*) FROM documents)) / CAST(1 + COUNT(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY term),
vec AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, COUNT(*) AS n_terms, SQRT(SUM(w * w)) AS norm FROM vec GROUP BY doc_id)
"""


@query("e4_text_vectors", TFIDF_CTE + "SELECT doc_id, n_terms, ROUND(norm, 6) AS norm FROM norms")
def e4_vectors(spark, sf):
    vectors = text_similarity.text_vectors(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return text_similarity.vector_norms(vectors, "doc_id").select("doc_id", "n_terms", r6("norm"))


@query("e4_similar_texts", TFIDF_CTE + """,
qtf AS (SELECT item_id, term, COUNT(*) AS tf FROM (
  SELECT item_id, UNNEST(regexp_extract_all(LOWER(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY item_id, term),
qvec AS (SELECT item_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qnorms AS (SELECT item_id, SQRT(SUM(w * w)) AS norm FROM qvec GROUP BY item_id),
dots AS (SELECT item_id, doc_id, SUM(q.w * v.w) AS dot FROM qvec q JOIN vec v USING (term) GROUP BY item_id, doc_id),
sims AS (SELECT item_id, doc_id, ROUND(dot / (q.norm * n.norm), 9) AS similarity FROM dots JOIN qnorms q USING (item_id) JOIN norms n USING (doc_id))
SELECT item_id, doc_id, ROUND(similarity, 6) AS similarity, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM sims) WHERE rank <= 5""")
def e4_similar(spark, sf):
    docs, queries = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    found = text_similarity.similar_texts(queries, "item_id", docs, "doc_id", 5)
    return found.select("item_id", "doc_id", r6("similarity"), "rank")


@query("e5_preference_score", oracle(["directory"], """
SELECT id, spec_bonus, location_penalty, spec_penalty,
  ROUND(similarity + spec_bonus + location_penalty + spec_penalty, 6) AS final_score FROM scored""", SCORED_CTE))
def e5(spark, sf):
    return scored_directory(spark, sf).select("id", "spec_bonus", "location_penalty", "spec_penalty", r6("final_score"))


@query("e6_rank_blends", oracle(["directory"], """
SELECT id, ROUND(similarity + experience / 50.0::DOUBLE, 6) AS rank_experience,
  ROUND(similarity + experience / 50.0::DOUBLE + spec_count / 10.0::DOUBLE, 6) AS rank_specs,
  ROUND(similarity + spec_bonus + location_penalty + spec_penalty + score / 10.0::DOUBLE, 6) AS rank_score FROM scored""", SCORED_CTE))
def e6(spark, sf):
    blends = score.rank_blends(scored_directory(spark, sf))
    return blends.select("id", r6("rank_experience"), r6("rank_specs"), r6("rank_score"))


FITNESS_CTE = """
lim AS (SELECT MIN(experience) AS e0, MAX(experience) AS e1, MIN(settlements) AS s0, MAX(settlements) AS s1,
  MIN(satisfaction) AS c0, MAX(satisfaction) AS c1 FROM catalog),
fit AS (SELECT catalog.*, 0.3::DOUBLE * ((experience - e0) / (e1 - e0 + 1e-6)) + 0.3::DOUBLE * ((settlements - s0) / (s1 - s0 + 1e-6))
  + 0.2::DOUBLE * ((satisfaction - c0) / (c1 - c0 + 1e-6))
  + 0.2::DOUBLE * (CASE WHEN price <= 950 THEN 1 - (950 - price) / (950 + 1e-6) ELSE 0 END) AS fitness FROM catalog, lim)
"""


@query("e7_weighted_fitness", oracle(["catalog"], "SELECT item_id, ROUND(fitness, 6) AS fitness FROM fit", FITNESS_CTE))
def e7(spark, sf):
    catalog = view(spark, sf, "catalog")
    return score.weighted_fitness(catalog, catalog, 950).select("item_id", r6("fitness"))


@query("e8_trade_off", oracle(["catalog"], "SELECT item_id, ROUND(price * (10 - satisfaction), 6) AS trade_off FROM catalog"))
def e8(spark, sf):
    return view(spark, sf, "catalog").select("item_id", F.round(score.trade_off(), 6).alias("trade_off"))


@query("j13_weighted_candidates", oracle(["catalog"], """
SELECT item_id, name, price, ROUND(fitness, 6) AS fitness FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY fitness DESC, price, item_id) AS rn
  FROM fit WHERE domain = 'ECONOMY' AND price <= 950) WHERE rn = 1""", FITNESS_CTE))
def j13(spark, sf):
    best = recommend.recommend_weighted(view(spark, sf, "catalog"), "ECONOMY", 950)
    return best.select("item_id", "name", "price", r6("fitness"))


# --- sorts, limits, dedupe -------------------------------------------------------------------


@query("f2_top_experience", oracle(["directory"], """
SELECT id, years FROM (SELECT id, NULLIF(experience_years, 0) AS years FROM prepared
  WHERE contains(LOWER(location), 'asia') OR contains(LOWER(specialization), 'asia')) ORDER BY years DESC NULLS LAST, id LIMIT 5""", DIRECTORY_CTE))
def f2(spark, sf):
    df = prepared_directory(spark, sf).withColumn("years", F.nullif("experience_years", F.lit(0)))
    hit = df.where(F.lower("location").contains("asia") | F.lower("specialization").contains("asia"))
    return hit.orderBy(F.desc_nulls_last("years"), "id").limit(5).select("id", "years")


@query("f2_place_or_specialty", oracle(["directory"], """
SELECT id, name, array_to_string(list_transform(string_split(LOWER(location), ' '), lambda w: UPPER(w[1]) || w[2:]), ' ') AS location,
  UPPER(specialization[1]) || LOWER(specialization[2:]) AS specialization, CAST(experience_years AS VARCHAR) || ' years' AS experience
FROM prepared WHERE contains(LOWER(location), 'asia') OR contains(LOWER(specialization), 'asia') ORDER BY experience_years DESC, id LIMIT 5""", DIRECTORY_CTE))
def f2_display(spark, sf):
    directory = prepared_directory(spark, sf).drop("experience").withColumnRenamed("experience_years", "experience")
    return recommend.recommend_by_term(directory, "Asia")


@query("f4_first_per_name", oracle(["catalog"], """
SELECT item_id, name, price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY price, item_id) AS rn FROM catalog) WHERE rn = 1"""))
def f4(spark, sf):
    order = [F.col("price"), F.col("item_id")]
    return score.first_per(view(spark, sf, "catalog"), ["name"], order).orderBy(*order).select("item_id", "name", "price")


@query("f6_full_ranking", oracle(["catalog", "item_vec"], "SELECT item_id, ROUND(similarity, 6) AS similarity FROM similar_items", SIMILAR_CTE))
def f6(spark, sf):
    ranked = items_by_similarity(spark, sf).orderBy(F.desc("similarity"), "item_id")
    return ranked.select("item_id", r6("similarity"))


@query("f8_seeded_sample", oracle(["catalog"], """
SELECT item_id, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY item_id) AS rn FROM catalog)
WHERE rn = 1 ORDER BY md5(CAST(item_id AS VARCHAR) || ':42'), item_id LIMIT 30"""))
def f8(spark, sf):
    unique = score.first_per(view(spark, sf, "catalog"), ["name"], [F.col("item_id")])
    return score.seeded_sample(unique, "item_id", 30).select("item_id", "name")


# --- ranking quality -------------------------------------------------------------------------


@query("h9_mean_similarity", oracle(PAIR_VIEWS, """
SELECT COUNT(*) AS n_requests, ROUND(AVG(m), 6) AS mean_similarity FROM (
  SELECT AVG(similarity) AS m FROM placed WHERE rank <= 20 GROUP BY request_id)""", PAIRS_CTE))
def h9(spark, sf):
    return stats.mean_similarity_at(ranked_requests(spark, sf, 20), 20).select("n_requests", r6("mean_similarity"))


@query("h10_accuracy_at", oracle(PAIR_VIEWS, """
SELECT k, COUNT(*) AS n_requests, ROUND(AVG(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM requests LEFT JOIN (SELECT * FROM placed WHERE item_id = request_id) USING (request_id), (SELECT UNNEST(range(1, 6)) AS k) GROUP BY k""", PAIRS_CTE))
def h10(spark, sf):
    requests = view(spark, sf, "requests").select("request_id", F.col("request_id").alias("expected"))
    return stats.accuracy_at(requests, "expected", ranked_requests(spark, sf, 5), 5).select("k", "n_requests", r6("accuracy"))


@query("i6_heat_map", oracle(["catalog", "item_vec"], """
SELECT rank, UNNEST(range(0, len(embedding))) AS dim, ROUND(CAST(UNNEST(embedding) AS DOUBLE), 6) AS value FROM (
  SELECT embedding, ROW_NUMBER() OVER (ORDER BY similarity DESC, item_id) AS rank FROM similar_items) WHERE rank <= 10""", SIMILAR_CTE))
def i6(spark, sf):
    top = items_by_similarity(spark, sf).orderBy(F.desc("similarity"), "item_id").limit(10)
    # Ten rows: their position is a property of the sorted array.
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "item_id", "embedding"))).alias("t"))
    ranked = rows.select(F.posexplode("t").alias("p", "r"))
    cells = ranked.select((F.col("p") + 1).cast("bigint").alias("rank"), F.posexplode("r.embedding").alias("dim", "v"))
    return cells.select("rank", F.col("dim").cast("bigint"), F.round(F.col("v").cast("double"), 6).alias("value"))


# --- set operations --------------------------------------------------------------------------


@query("s1_union_distinct", oracle(["catalog"], """
SELECT item_id, domain FROM catalog WHERE price <= 910 UNION SELECT item_id, domain FROM catalog WHERE satisfaction >= 5.5"""))
def s1(spark, sf):
    catalog = view(spark, sf, "catalog").select("item_id", "domain", "price", "satisfaction")
    archive = catalog.where("price <= 910").select("item_id", "domain")
    return archive.union(catalog.where("satisfaction >= 5.5").select("item_id", "domain")).distinct()


@query("s2_list_union", oracle(["directory"], """
SELECT id, array_to_string(list_sort(list_distinct(list_concat(specs, ['promo', 'large']))), '|') AS terms FROM prepared""", DIRECTORY_CTE))
def s2(spark, sf):
    merged = F.array_union("specs", F.array(F.lit("promo"), F.lit("large")))
    return prepared_directory(spark, sf).select("id", F.array_join(F.array_sort(merged), "|").alias("terms"))


@query("s3_repeat_to", oracle(["catalog"], """
SELECT item_id, copy FROM (SELECT item_id, copy, ROW_NUMBER() OVER (ORDER BY copy, item_id) AS rn
  FROM catalog, (SELECT UNNEST(range(1, 4)) AS copy)) WHERE rn <= (SELECT COUNT(*) * 5 // 2 FROM catalog)"""))
def s3(spark, sf):
    catalog = view(spark, sf, "catalog").select("item_id")
    return score.repeat_to(catalog, catalog.count() * 5 // 2, "item_id").withColumn("copy", F.col("copy").cast("bigint"))
