"""Ready-made chains: from requests or arguments to recommendations, on the caller's tables.

Catalog tables carry ``item_id, name, domain, experience, price, settlements, satisfaction`` and, where a
chain ranks by similarity, ``embedding``. Directory tables carry ``id, name, experience`` (years),
``specialization``, ``specs``, ``location``, ``city`` and ``embedding``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.functions.vectors import cosine
from rankloom.operators import clean, cluster, filters, hybrid, match, parse, portfolio, score, skyline

FEATURES = ["experience", "spec_count"]
SCALED = ["z_experience", "z_spec_count"]


def prepare_directory(listings: DataFrame) -> DataFrame:
    """Scraped listings to a directory: years, rating by tier, specialty list, city; gaps read ``Unknown``."""
    years = clean.experience_years("experience")
    return clean.fill_missing(listings, fixed.UNKNOWN).withColumns({
        "experience_years": years,
        "rating_by_years": clean.tier_rating(years),
        "specs": clean.split_multi("specialization", lower=True),
        "city": clean.primary_city("location"),
    })


def match_requests(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Constraints of ``requests(request_id, text, embedding)`` parsed from their texts."""
    return match.request_constraints(parse.detect_domain(parse.parse_basic(requests), catalog))


def recommend_by_text(requests: DataFrame, catalog: DataFrame, k: int = 5, currency: str = "₹") -> DataFrame:
    """The ``k`` most similar items that meet each request's text, ready for display."""
    ranked = match.top_k(match_requests(requests, catalog), catalog, k)
    chosen = ranked.join(catalog.drop("embedding"), "item_id")
    return clean.display_format(chosen, currency)


def _clustered(df: DataFrame, method: str) -> DataFrame:
    scaled = cluster.zscores(df, FEATURES)
    return cluster.kmeans(scaled, SCALED) if method == "kmeans" else cluster.lloyd_rounds(scaled, SCALED)


def recommend_hybrid(directory: DataFrame, domain: str | None = None, min_exp: int | None = None, max_exp: int | None = None,
                     top_n: int = 5, method: str = "kmeans") -> DataFrame:
    """Filter form: specialty and years, then the first rows by cluster and score."""
    test = filters.experience_range(min_exp, max_exp)
    if domain:
        test = test & filters.contains_ci("specialization", domain)
    grouped = _clustered(clean.spec_score(directory.where(test)), method)
    return grouped.orderBy("cluster", F.desc("score"), "id").limit(top_n)


def recommend_by_request(directory: DataFrame, text: str, vector: Sequence[float], cities: Sequence[str] = fixed.CITIES,
                         top_n: int = 5, clusters: bool = True, method: str = "kmeans") -> DataFrame:
    """Query form: one request's full parse filters, similarity and years rank, optionally inside clusters."""
    spark = directory.sparkSession
    want = parse.parse_full(spark.createDataFrame([(text,)], "text string"), cities=cities).first()
    test = filters.experience_range(want.min_exp, want.max_exp, want.exact_exp)
    # The clustered form looks for the terms in the raw text, the plain one compares lists both ways.
    specialties = filters.specialty_contains if clusters else filters.specialty_lists
    test = test & specialties(want.include_specs, want.exclude_specs)
    if want.include_cities:
        test = test & F.col("city").isin(want.include_cities)
    if want.exclude_cities:
        test = test & ~F.col("city").isin(want.exclude_cities)
    query = F.array(*[F.lit(float(v)) for v in vector])
    pool = clean.spec_score(directory.where(test)).withColumn("similarity", cosine("embedding", query))
    pool = score.rank_blends(pool.withColumn("final_score", F.col("similarity")))
    if not clusters:
        return pool.orderBy(F.desc("rank_experience"), "id").limit(top_n)
    return _clustered(pool, method).orderBy("cluster", F.desc("rank_specs"), "id").limit(top_n)


def recommend_by_requests(directory: DataFrame, requests: DataFrame, cities: Sequence[str] = fixed.CITIES, top_n: int = 5) -> DataFrame:
    """The plain query form for a table ``requests(request_id, text, embedding)``: each request's full parse filters,
    similarity and years rank, the first ``top_n`` rows of every request in one plan."""
    return match.top_k_listed(parse.parse_full(requests, cities=cities), directory, top_n)


def recommend_hybrid_requests(directory: DataFrame, requests: DataFrame, cities: Sequence[str] = fixed.CITIES, top_n: int = 5) -> DataFrame:
    """The clustered query form for a table ``requests(request_id, text, embedding)``: every request's pool is clustered
    on its own, all of them in one plan. Gives (request_id, id, cluster, score, rank)."""
    return hybrid.top_k_clustered(parse.parse_full(requests, cities=cities), clean.spec_score(directory), hybrid.QueryFilters, top_n)


def recommend_preferences_requests(directory: DataFrame, requests: DataFrame, top_n: int = 3) -> DataFrame:
    """The bounds form for a table ``requests(request_id, text, embedding)``, clustered like the query form."""
    return hybrid.top_k_clustered(parse.parse_bounds(requests), clean.spec_score(directory), hybrid.PreferenceFilters, top_n)


def recommend_by_preferences(directory: DataFrame, text: str, vector: Sequence[float], top_n: int = 3, method: str = "kmeans") -> DataFrame:
    """Bounds form: years and place filter, preferences move the similarity, score decides inside clusters."""
    spark = directory.sparkSession
    want = parse.parse_bounds(spark.createDataFrame([(text,)], "text string")).first()
    test = filters.experience_range(want.min_exp, want.max_exp)
    if want.place:
        test = test & filters.contains_ci("location", want.place)
    if want.wanted_specs:
        test = test & filters.any_term("specialization", want.wanted_specs)
    query = F.array(*[F.lit(float(v)) for v in vector])
    pool = clean.spec_score(directory.where(test)).withColumn("similarity", cosine("embedding", query))
    pool = score.preference_score(pool, want.required_spec, want.excluded_places, want.excluded_specs)
    grouped = _clustered(score.rank_blends(pool), method)
    return grouped.orderBy("cluster", F.desc("rank_score"), "id").limit(top_n)


def recommend_by_term(directory: DataFrame, term: str, top_n: int = 5) -> DataFrame:
    """Rows whose place or specialty contains the term, the most experienced first, ready for display."""
    found = directory.where(filters.place_or_specialty(term)).orderBy(F.desc_nulls_last("experience"), "id").limit(top_n)
    years = F.concat(F.col("experience").cast("string"), F.lit(" years"))
    return found.select(
        "id", "name", clean.title_case("location").alias("location"), clean.title_case("specialization").alias("specialization"),
        F.coalesce(years, F.lit(fixed.UNKNOWN)).alias("experience"),
    )


def recommend_weighted(catalog: DataFrame, domain: str, budget: float) -> DataFrame:
    """Candidates of a domain within budget by weighted fitness; one row per name."""
    return score.weighted_candidates(catalog, domain, budget)


def recommend_pareto(catalog: DataFrame, top_n: int = 10) -> DataFrame:
    """The exact price/satisfaction front by trade-off."""
    points = skyline.objective_columns(catalog, minimise=["price"], complement={"satisfaction": 10})
    front = skyline.pareto_front_2d(points, "obj_price", "obj_satisfaction").withColumn("trade_off", score.trade_off())
    return front.orderBy("trade_off", "item_id").limit(top_n)


def recommend_portfolio(catalog: DataFrame, weights: DataFrame, domain: str, budget: float) -> DataFrame:
    """Non-dominated weight vectors over a domain within budget, as their representative items."""
    pool = catalog.where((F.col("domain") == domain) & (F.col("price") <= budget))
    return portfolio.select_portfolio(weights.join(pool.select("item_id"), "item_id", "left_semi"), pool)
