import pytest

from rankloom.operators import parse


def parsed(spark, fn, text, **kw):
    return fn(spark.createDataFrame([(text,)], "text string"), **kw).first().asDict()


@pytest.mark.parametrize("text, op, years, budget", [
    ("Need a tax lawyer with more than 10 years of experience and budget of 20000", "more", 10, 20000),
    ("criminal lawyer under ₹50000 with less than 5 years", "less", 5, 50000),
    ("Family Law BELOW 3000", None, None, 3000),
    ("budget of 20,000", None, None, 20),
    ("at least 5 years", None, None, None),
    ("more than 5years", "more", 5, None),
    ("", None, None, None),
])
def test_basic(spark, text, op, years, budget):
    got = parsed(spark, parse.parse_basic, text)
    assert (got["exp_op"], got["exp_years"], got["budget"]) == (op, years, budget)


def test_digits_are_ascii(spark):
    assert parsed(spark, parse.parse_basic, "more than ٥ years")["exp_years"] is None


@pytest.mark.parametrize(("listed", "size"), [(1000, 0), (1, 1 << 20), (1, 0)])
def test_domain_in_catalog_order(spark, listed, size):
    catalog = spark.createDataFrame([(1, "Tax Law"), (0, "Civil Law"), (2, "Law")], "item_id bigint, domain string")
    texts = spark.createDataFrame([("tax law and civil law",), ("some LAW",), ("none",)], "text string")
    got = {r.text: r.domain for r in parse.detect_domain(texts, catalog, max_listed=listed, max_bytes=size).collect()}
    assert got == {"tax law and civil law": "Civil Law", "some LAW": "Law", "none": None}


def test_many_domains_equal_a_search(spark):
    names = [f"Name {i * 37 % 5000} é" for i in range(5000)] + ["name 7 É", "7"]
    catalog = spark.createDataFrame(list(enumerate(names)), "item_id long, domain string")
    texts = ["about NAME 7 É and name 12 é", "17 and 7", "", None, "name 4999 é name 4998 é", "nothing"]
    got = {r.text: r.domain for r in parse.detect_domain(spark.createDataFrame([(t,) for t in texts], "text string"), catalog).collect()}
    assert got == {t: None if t is None else next((n for n in names if n.lower() in t.lower()), None) for t in texts}
    empty = spark.createDataFrame([(5, ""), (3, "law")], "item_id long, domain string")
    got = parse.detect_domain(spark.createDataFrame([("law",), ("x",), (None,)], "text string"), empty, max_listed=1).collect()
    assert {r.text: r.domain for r in got} == {"law": "law", "x": "", None: None}


def test_domain_of_an_empty_catalog(spark):
    catalog = spark.createDataFrame([], "item_id bigint, domain string")
    assert parse.detect_domain(spark.createDataFrame([("x",)], "text string"), catalog).first().domain is None


def test_bounds(spark):
    got = parsed(spark, parse.parse_bounds, "someone handling divorce cases in law, at least 5 years, not in Mumbai, avoid tax law")
    assert got["min_exp"] == 6 and got["excluded_places"] == ["Mumbai", "tax"]
    assert got["excluded_specs"] == ["tax law"]
    loose = parsed(spark, parse.parse_bounds, "at least 5 years", strict=False)
    assert loose["min_exp"] == 5
    assert parsed(spark, parse.parse_bounds, "more than 5 years", strict=False)["min_exp"] == 6
    assert parsed(spark, parse.parse_bounds, "max 7 years")["max_exp"] == 6


def test_not_in_also_sets_the_place(spark):
    got = parsed(spark, parse.parse_bounds, "not in Delhi")
    assert got["place"] == "Delhi" and got["excluded_places"] == ["Delhi"]


def test_aliases_apply_in_order(spark):
    got = parsed(spark, parse.parse_bounds, "focus on crime section matters and cyber crime law")
    assert got["wanted_specs"] == ["criminal law matters and cyber law criminal law law"]


def test_full(spark):
    got = parsed(spark, parse.parse_full, "between 5 and 10 years, from Mumbai and Pune, not in delhi, without civil law")
    assert (got["min_exp"], got["max_exp"], got["exact_exp"]) == (5, 10, None)
    assert got["include_cities"] == ["mumbai", "pune"] and got["exclude_cities"] == ["delhi"]
    assert got["exclude_specs"] == ["civil law"]


def test_full_overrides_and_exact(spark):
    got = parsed(spark, parse.parse_full, "between 5 to 10 years more than 7 only 9 years")
    assert (got["min_exp"], got["max_exp"], got["exact_exp"]) == (8, 10, 9)


def test_or_and_and_cut_only_between_words(spark):
    got = parsed(spark, parse.parse_full, "specializing in corporate law or labour law")
    assert got["include_specs"] == ["corporate law", "labour law"]
    assert parsed(spark, parse.parse_full, "in chandigarh and pune")["include_cities"] == ["chandigarh", "pune"]


def test_every_city_of_a_group_counts(spark):
    assert parsed(spark, parse.parse_full, "in mumbai, chennai and new delhi")["include_cities"] == ["mumbai", "chennai", "new delhi"]
