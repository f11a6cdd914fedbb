"""Queries over sources, cleaning, request parsing and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import clean, filters, parse
from rankloom.operators.skyline import objective_columns
from rankloom.plans.views import oracle, table, view
from rankloom.session import work_path
from rankloom.sources import profiles

BASE_URL = "https://directory.example"
LIST_LAYOUT = {
    "base_url": BASE_URL,
    "block": "<li>",
    "fields": {"name": "(?s)^(.*?)</li>", "rating": '(?s)^<b class="rating">(.*?)</b>'},
    "link": '^<a[^>]*href="([^"]*)"',
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def joined(col: str) -> Column:
    return F.array_join(col, "|").alias(col)


def prepared_directory(spark: SparkSession, sf: str) -> DataFrame:
    """The directory with its cleaned columns."""
    return view(spark, sf, "directory").withColumns({
        "experience_years": clean.experience_years("experience"),
        "specs": clean.split_multi("specialization", lower=True),
        "city": clean.primary_city("location"),
    })


DIRECTORY_CTE = """
prepared AS (SELECT *, COALESCE(TRY_CAST(regexp_extract(experience, '([0-9]+)', 1) AS INT), 0) AS experience_years,
  list_transform(string_split(LOWER(specialization), ','), lambda x: TRIM(x)) AS specs,
  LOWER(TRIM(split_part(location, ',', 1))) AS city FROM directory)
"""

# --- sources ---------------------------------------------------------------------------------


@query("a1_scan_catalog", oracle(["catalog"], "SELECT * FROM catalog"))
def a1(spark, sf):
    path = work_path(spark, "catalog")
    profiles.sink_csv(view(spark, sf, "catalog").select(profiles.CATALOG.names), path)
    return profiles.scan_catalog(spark, path)


@query("a2_normalise_columns", oracle(["catalog"], "SELECT item_id, name, domain, price FROM catalog"))
def a2(spark, sf):
    df = view(spark, sf, "catalog").select("item_id", "name", "domain", "price")
    padded = df.toDF(*[f"  {c.upper()} " for c in df.columns])
    return clean.normalise_columns(padded, ["item_id", "name", "domain", "price"], lower=True)


@query("a3_extract_listings", """
SELECT page_id, pos, TRIM(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(regexp_replace(block, '<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS name,
  'No rating' AS rating, 'https://directory.example' || regexp_extract(block, '^<a[^>]*href="([^"]*)"', 1) AS profile_url
FROM (SELECT page_id, UNNEST(range(1, len(blk) + 1)) AS pos, UNNEST(blk) AS block
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS blk FROM pages))
""")
def a3(spark, sf):
    return profiles.extract_listings(table(spark, sf, "pages"), **LIST_LAYOUT)


@query("a4_page_requests", """
SELECT UNNEST(range(1, n + 1)) AS page, 'https://directory.example/search?page=' || CAST(UNNEST(range(1, n + 1)) AS VARCHAR) AS url
FROM (SELECT COUNT(*) AS n FROM pages)
""")
def a4(spark, sf):
    return profiles.page_requests(spark, f"{BASE_URL}/search?page=", table(spark, sf, "pages").count())


@query("a4_pages_to_fetch", """
WITH seen AS (SELECT DISTINCT regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages WHERE url IS NOT NULL),
bases AS (SELECT DISTINCT regexp_extract(url, '^([^:/]+://[^/]+/(?:[^/]+/)*)', 1) AS base FROM seen),
wanted AS (SELECT base, page, base || CAST(page AS VARCHAR) AS url FROM bases, (SELECT UNNEST(range(1, 1001)) AS page) WHERE base <> '')
SELECT base, page, wanted.url, seen.url IS NOT NULL AS stored FROM wanted LEFT JOIN seen ON seen.url = wanted.url
""")
def a4_fetch(spark, sf):
    """The numbered pages below every folder of the stored urls, and which of them are stored already."""
    return profiles.pages_to_fetch(table(spark, sf, "pages"), 1000)


_LISTED_ROW = """
CONCAT('<div class="bs-box"><a href="/p/', CAST(id AS STRING), '"><div class="custom-value-name"> ', REPLACE(name, '#', '&amp;'), ' </div></a>',
  '<div class="custom-label">Experience</div><div>', experience, '</div><div class="custom-label">Specialization</div><div><b>', specialization, '</b></div>',
  '<div class="custom-label">Location</div> <div> ', location, ' </div>',
  CASE WHEN id % 3 = 0 THEN '' ELSE CONCAT('<div class="rating-tag">', CAST(id % 5 AS STRING), '.5</div>') END, '</div>')
"""


@query("a3_directory_listings", oracle(["directory"], """
SELECT id // 25 AS page_id, ROW_NUMBER() OVER (PARTITION BY id // 25 ORDER BY id) AS pos, REPLACE(name, '#', '&') AS name, experience, specialization,
  location, CASE WHEN id % 3 = 0 THEN 'No rating' ELSE CAST(id % 5 AS VARCHAR) || '.5' END AS rating, 'https://directory.example/p/' || CAST(id AS VARCHAR) AS profile_url
FROM directory"""))
def a3_listings(spark, sf):
    """The directory laid out as listing pages of 25 rows, with ratings present and absent, and read back."""
    blocks = view(spark, sf, "directory").select(F.expr("id div 25").alias("page_id"), "id", F.expr(_LISTED_ROW).alias("block"))
    rows = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "block"))).alias("rows"))  # 25 a page
    html = F.concat(F.lit("<html>"), F.array_join("rows.block", "\n"), F.lit("</html>"))
    return profiles.extract_listings(rows.select("page_id", html.alias("html")), BASE_URL)


@query("a5_sink_csv", oracle(["directory"], "SELECT id, name, experience, location, specialization FROM directory"))
def a5(spark, sf):
    df = view(spark, sf, "directory").select("id", "name", "experience", "location", "specialization")
    path = work_path(spark, "directory")
    profiles.sink_csv(df, path)
    # CSV does not tell empty text from missing; both read back as null.
    return clean.fill_missing(spark.read.schema(df.schema).option("header", True).csv(path), "")


@query("a9_load_split", "SELECT doc_id, source, n_chars, LENGTH(text) AS text_length FROM documents WHERE lang = 'en'")
def a9(spark, sf):
    path = work_path(spark, "splits")
    profiles.write_splits(table(spark, sf, "documents"), F.col("lang"), path)
    return profiles.load_split(spark, path, "en").select(
        "doc_id", "source", "n_chars", F.length("text").cast("bigint").alias("text_length")
    )


# --- cleaning --------------------------------------------------------------------------------


@query("b1_experience_years", oracle(["directory"], "SELECT id, experience_years FROM prepared", DIRECTORY_CTE))
def b1(spark, sf):
    return prepared_directory(spark, sf).select("id", "experience_years")


@query("b2_fill_missing", oracle(["directory"], """
SELECT id, COALESCE(NULLIF(specialization, ''), 'Unknown') AS specialization,
  COALESCE(CAST(o.n AS BIGINT), 0) AS urgent_orders, COALESCE(o.latest, 'none') AS latest
FROM directory LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, MAX(o_orderstatus) AS latest FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON o_custkey = id"""))
def b2(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("urgent_orders"), F.max("o_orderstatus").alias("latest")
    )
    df = view(spark, sf, "directory").select("id", F.nullif("specialization", F.lit("")).alias("specialization"))
    return clean.fill_missing(df.join(urgent, "id", "left"), "Unknown", {"urgent_orders": 0, "latest": "none"})


@query("b3_tier_rating", oracle(["directory"], """
SELECT id, CAST(CASE WHEN experience_years >= 20 THEN 5.0 WHEN experience_years >= 15 THEN 4.5 WHEN experience_years >= 10 THEN 4.0
  WHEN experience_years >= 5 THEN 3.0 ELSE 2.0 END AS DOUBLE) AS rating FROM prepared""", DIRECTORY_CTE))
def b3(spark, sf):
    return prepared_directory(spark, sf).select("id", clean.tier_rating("experience_years").alias("rating"))


@query("b4_summary_text", oracle(["catalog"], """
SELECT item_id, name || ' is a lawyer specializing in ' || domain || ' with ' || CAST(experience AS VARCHAR)
  || ' years of experience. Charges approximately ₹' || CAST(CAST(round_even(price, 0) AS BIGINT) AS VARCHAR)
  || ' and has a client satisfaction rating of ' || CAST(satisfaction AS VARCHAR) || '/10.' AS summary FROM catalog"""))
def b4(spark, sf):
    return view(spark, sf, "catalog").select("item_id", clean.summary_text().alias("summary"))


@query("b5_split_multi", oracle(["directory"], """
SELECT id, UNNEST(range(0, len(specs))) AS pos, UNNEST(specs) AS spec FROM prepared""", DIRECTORY_CTE))
def b5(spark, sf):
    rows = prepared_directory(spark, sf).select("id", F.posexplode("specs").alias("pos", "spec"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("b6_primary_city", oracle(["directory"], "SELECT id, city FROM prepared", DIRECTORY_CTE))
def b6(spark, sf):
    return prepared_directory(spark, sf).select("id", "city")


@query("b7_project_rename", oracle(["catalog"], "SELECT name AS profile, domain AS specialization, experience AS years, price AS fee FROM catalog"))
def b7(spark, sf):
    return clean.project_rename(
        view(spark, sf, "catalog"), {"name": "profile", "domain": "specialization", "experience": "years", "price": "fee"}
    )


@query("b8_display_format", oracle(["catalog"], """
SELECT item_id, name, domain, CAST(experience AS VARCHAR) || ' years' AS experience,
  '₹' || format('{:,}', CAST(round_even(price, 0) AS BIGINT)) AS price, CAST(satisfaction AS VARCHAR) || '/10' AS satisfaction
FROM catalog"""))
def b8(spark, sf):
    return clean.display_format(view(spark, sf, "catalog"), thousands=True).drop("settlements")


@query("b9_spec_score", oracle(["directory"], """
SELECT id, len(specs) AS spec_count, experience_years + len(specs) AS score FROM prepared""", DIRECTORY_CTE))
def b9(spark, sf):
    df = clean.spec_score(prepared_directory(spark, sf), "experience_years")
    return df.select("id", F.col("spec_count").cast("bigint"), F.col("score").cast("bigint"))


@query("b10_objective_columns", oracle(["catalog"], """
SELECT item_id, price AS obj_price, ROUND(10 - satisfaction, 6) AS obj_satisfaction, CAST(-experience AS DOUBLE) AS obj_experience FROM catalog"""))
def b10(spark, sf):
    df = objective_columns(view(spark, sf, "catalog"), minimise=["price"], maximise=["experience"], complement={"satisfaction": 10})
    return df.select("item_id", "obj_price", F.round("obj_satisfaction", 6).alias("obj_satisfaction"), "obj_experience")


@query("b11_item_text", oracle(["directory"], """
SELECT id, name || ' ' || CAST(experience_years AS VARCHAR) || ' years ' || specialization || ' ' || location AS text FROM prepared""", DIRECTORY_CTE))
def b11(spark, sf):
    df = prepared_directory(spark, sf)
    return df.select("id", clean.item_text("name", "experience_years", "specialization", "location").alias("text"))


@query("b11_item_sentence", oracle(["directory"], """
SELECT id, name || ' ' || CAST(experience_years AS VARCHAR) || ' years experience in ' || specialization || ' at ' || location AS text FROM prepared""", DIRECTORY_CTE))
def b11_sentence(spark, sf):
    df = prepared_directory(spark, sf)
    return df.select("id", clean.item_sentence("name", "experience_years", "specialization", "location").alias("text"))


# --- request parsing -------------------------------------------------------------------------

BASIC_CTE = r"""
parsed AS (SELECT *, NULLIF(regexp_extract(LOWER(text), '(less|more) than ([0-9]+)\s*years?', 1), '') AS exp_op,
  TRY_CAST(NULLIF(regexp_extract(LOWER(text), '(less|more) than ([0-9]+)\s*years?', 2), '') AS BIGINT) AS exp_years,
  TRY_CAST(NULLIF(regexp_extract(LOWER(text), '(?:budget of|under|below)\s*₹?([0-9]+)', 1), '') AS BIGINT) AS budget FROM requests)
"""
DOMAIN_CTE = """
domains AS (SELECT domain, MIN(item_id) AS first_id FROM catalog GROUP BY domain),
detected AS (SELECT request_id, arg_min(domain, first_id) AS domain
  FROM requests JOIN domains ON contains(LOWER(text), LOWER(domain)) GROUP BY request_id)
"""


@query("c1_parse_basic", oracle(["requests"], "SELECT request_id, exp_op, exp_years, budget FROM parsed", BASIC_CTE))
def c1(spark, sf):
    return parse.parse_basic(view(spark, sf, "requests")).select("request_id", "exp_op", "exp_years", "budget")


@query("c2_detect_domain", oracle(["requests", "catalog"],
       "SELECT request_id, domain FROM requests LEFT JOIN detected USING (request_id)", DOMAIN_CTE))
def c2(spark, sf):
    found = parse.detect_domain(view(spark, sf, "requests"), view(spark, sf, "catalog"))
    return found.select("request_id", "domain")


ALIASED = ("REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(text, 'crime section', 'criminal law'), 'crime', 'criminal law'), "
           "'divorce', 'family law'), 'property', 'real estate law'), 'cyber', 'cyber law')")


@query("c3_normalise_aliases", oracle(["requests"], f"SELECT request_id, {ALIASED} AS text FROM requests"))
def c3(spark, sf):
    return view(spark, sf, "requests").select("request_id", parse.normalise_aliases(F.col("text")).alias("text"))


@query("c4_parse_bounds", oracle(["requests"], r"""
SELECT request_id,
  TRY_CAST(NULLIF(regexp_extract(t, '(?i)(?:more than|at least|min(?:imum)?) ([0-9]+) years?', 1), '') AS BIGINT) + 1 AS min_exp,
  TRY_CAST(NULLIF(regexp_extract(t, '(?i)(?:less than|max(?:imum)?) ([0-9]+) years?', 1), '') AS BIGINT) - 1 AS max_exp,
  array_to_string(regexp_extract_all(t, '(?i)(?:not in|except|avoid) (\w+)', 1), '|') AS excluded_places,
  TRIM(NULLIF(regexp_extract(t, '(?i)(?:practicing|having|specializing in|handling|working on|doing) ([\w\s]+ law)', 1), '')) AS required_spec,
  array_to_string(regexp_extract_all(t, '(?i)(?:not|avoid|except|without) ([\w\s]+ law)', 1), '|') AS excluded_specs,
  NULLIF(regexp_extract(t, '(?i)(?:in|located in|based in|from) (\w+)', 1), '') AS place,
  array_to_string(regexp_extract_all(t, '(?i)(?:focus on|expert in|handles|deals with) ([\w\s]+ law)', 1), '|') AS wanted_specs
FROM cleaned""", f"cleaned AS (SELECT request_id, {ALIASED} AS t FROM requests)"))
def c4(spark, sf):
    df = parse.parse_bounds(view(spark, sf, "requests"))
    return df.select("request_id", "min_exp", "max_exp", joined("excluded_places"), "required_spec",
                     joined("excluded_specs"), "place", joined("wanted_specs"))


_CITY = "(?:" + "|".join(parse.fixed.CITIES) + ")"
_CITY_BLOCK = rf"(?:in|from|not in|not) {_CITY}(?:\s*(?:and|,)\s*{_CITY})*"
_SQL_CLEAN = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_SQL_CITIES = _SQL_CLEAN.format(
    r"flatten(list_transform(list_filter(blocks, lambda b: {} starts_with(b, 'not')), "
    r"lambda g: string_split_regex(regexp_replace(g, '^(?:not in|not|in|from) ', ''), '\s*,\s*|\s+and\s+')))")


@query("c5_parse_full", oracle(["requests"], rf"""
SELECT request_id,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(t, 'more than ([0-9]+)', 1), '') AS BIGINT) + 1,
    TRY_CAST(NULLIF(regexp_extract(t, 'between ([0-9]+)\s*(?:years?)?\s*(?:and|to)\s*([0-9]+)\s*(?:years?)?', 1), '') AS BIGINT)) AS min_exp,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(t, 'less than ([0-9]+)', 1), '') AS BIGINT) - 1,
    TRY_CAST(NULLIF(regexp_extract(t, 'between ([0-9]+)\s*(?:years?)?\s*(?:and|to)\s*([0-9]+)\s*(?:years?)?', 2), '') AS BIGINT)) AS max_exp,
  TRY_CAST(NULLIF(regexp_extract(t, 'only ([0-9]+) years?', 1), '') AS BIGINT) AS exact_exp,
  array_to_string({_SQL_CITIES.replace('{}', 'NOT')}, '|') AS include_cities,
  array_to_string({_SQL_CITIES.replace('{}', '')}, '|') AS exclude_cities,
  array_to_string({_SQL_CLEAN.format(r"string_split_regex(regexp_replace(regexp_extract(t, '(?:specializing in|only|do|handles|focus(?: on)?) ([a-z\s]+(?: or [a-z\s]+)*)', 1), 'not in .*', ''), '\s+or\s+')")}, '|') AS include_specs,
  array_to_string({_SQL_CLEAN.format(r"list_concat(list_concat(regexp_extract_all(t, 'not in ([a-z\s]+) specialization', 1), regexp_extract_all(t, 'without ([a-z\s]+)', 1)), regexp_extract_all(t, 'not ([a-z\s]+ law)', 1))")}, '|') AS exclude_specs
FROM cut""", rf"cut AS (SELECT request_id, LOWER(text) AS t, regexp_extract_all(LOWER(text), '{_CITY_BLOCK}') AS blocks FROM requests)"))
def c5(spark, sf):
    df = parse.parse_full(view(spark, sf, "requests"))
    return df.select("request_id", "min_exp", "max_exp", "exact_exp", joined("include_cities"), joined("exclude_cities"),
                     joined("include_specs"), joined("exclude_specs"))


# --- filters ---------------------------------------------------------------------------------


@query("d1_experience_than", oracle(["catalog"], """
SELECT item_id, experience < 10 AS junior, experience > 20 AS senior FROM catalog WHERE experience < 10 OR experience > 20"""))
def d1(spark, sf):
    less, more = filters.experience_than("less", 10), filters.experience_than("more", 20)
    return view(spark, sf, "catalog").where(less | more).select("item_id", less.alias("junior"), more.alias("senior"))


@query("d2_within_budget", oracle(["catalog"], "SELECT item_id, price FROM catalog WHERE price <= 950"))
def d2(spark, sf):
    return view(spark, sf, "catalog").where(filters.within_budget(950)).select("item_id", "price")


@query("d3_domain_is", oracle(["catalog"], "SELECT item_id, domain, domain = 'promo' AS exact FROM catalog WHERE LOWER(domain) = LOWER('Promo')"))
def d3(spark, sf):
    exact = filters.domain_is("promo", ignore_case=False).alias("exact")
    return view(spark, sf, "catalog").where(filters.domain_is("Promo")).select("item_id", "domain", exact)


@query("d4_filter_directory", oracle(["directory"], """
SELECT id, name, experience_years FROM prepared
WHERE contains(LOWER(location), 'asia') AND experience_years >= 10 AND contains(LOWER(specialization), 'econ')""", DIRECTORY_CTE))
def d4(spark, sf):
    found = filters.filter_directory(prepared_directory(spark, sf), "Asia", 10, "Econ")
    return found.select("id", "name", "experience_years")


@query("d5_place_or_specialty", oracle(["directory"], """
SELECT id, location, specialization FROM directory WHERE contains(LOWER(location), 'america') OR contains(LOWER(specialization), 'america')"""))
def d5(spark, sf):
    return view(spark, sf, "directory").where(filters.place_or_specialty("America")).select("id", "location", "specialization")


@query("d6_any_term", oracle(["directory"], """
SELECT id, specialization FROM directory WHERE contains(LOWER(specialization), 'promo') OR contains(LOWER(specialization), 'small')"""))
def d6(spark, sf):
    return view(spark, sf, "directory").where(filters.any_term("specialization", ["Promo", "small"])).select("id", "specialization")


def _region_cities(spark, sf, region):
    places = table(spark, sf, "nation").join(table(spark, sf, "region").where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.select(F.col("n_name").alias("city"))


_CITY_SQL = """SELECT id, city FROM prepared WHERE city {} (SELECT LOWER(n_name) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE')"""


@query("d7_city_in", oracle(["directory"], _CITY_SQL.format("IN"), DIRECTORY_CTE))
def d7(spark, sf):
    return filters.city_in(prepared_directory(spark, sf), _region_cities(spark, sf, "EUROPE")).select("id", "city")


@query("d7_city_not_in", oracle(["directory"], _CITY_SQL.format("NOT IN"), DIRECTORY_CTE))
def d7_not(spark, sf):
    return filters.city_in(prepared_directory(spark, sf), _region_cities(spark, sf, "EUROPE"), negate=True).select("id", "city")


_LAP = "len(list_filter(specs, lambda s: len(list_filter({}, lambda t: contains(s, t) OR contains(t, s))) > 0)) > 0"


@query("d8_specialty_lists", oracle(["directory"], f"""
SELECT id, specialization FROM prepared
WHERE ({_LAP.format("['promo sale', 'small']")}) AND NOT ({_LAP.format("['econ', 'large']")})""", DIRECTORY_CTE))
def d8(spark, sf):
    test = filters.specialty_lists(["promo sale", "small"], ["econ", "large"])
    return prepared_directory(spark, sf).where(test).select("id", "specialization")


@query("d8_specialty_contains", oracle(["directory"], """
SELECT id, specialization FROM directory WHERE contains(LOWER(specialization), 'promo') AND NOT contains(LOWER(specialization), 'large')"""))
def d8_one(spark, sf):
    test = filters.specialty_contains(["promo"], ["large"])
    return view(spark, sf, "directory").where(test).select("id", "specialization")


@query("d9_experience_range", oracle(["catalog"], """
SELECT item_id, experience BETWEEN 10 AND 20 AS in_range, experience = 15 AS is_exact, experience >= 40 AS open_end FROM catalog"""))
def d9(spark, sf):
    return view(spark, sf, "catalog").select(
        "item_id", filters.experience_range(10, 20).alias("in_range"),
        filters.experience_range(10, 20, 15).alias("is_exact"), filters.experience_range(40).alias("open_end"),
    )


@query("d10_domain_contains", oracle(["catalog"], "SELECT item_id, domain FROM catalog WHERE contains(LOWER(domain), 'stand')"))
def d10(spark, sf):
    return view(spark, sf, "catalog").where(filters.contains_ci("domain", "Stand")).select("item_id", "domain")
