import pytest
from pyspark.sql import functions as F

from rankloom.operators import clean, filters
from rankloom.sources import profiles


def values(df, col):
    return [r[col] for r in df.select(col).collect()]


def test_experience(spark):
    df = spark.createDataFrame([("12 Years",), ("none",), (None,), ("7-9",), ("99999999999",)], "t string")
    assert [r[0] for r in df.select(clean.experience_years("t")).collect()] == [12, 0, 0, 7, 0]


def test_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 4, 5, 9, 10, 14, 15, 19, 20, 60)], "y int")
    assert [r[0] for r in df.select(clean.tier_rating("y")).collect()] == [2.0, 2.0, 3.0, 3.0, 4.0, 4.0, 4.5, 4.5, 5.0, 5.0]


def test_summary_rounds_half_to_even(spark):
    df = spark.createDataFrame([("A", "Tax", 3, 2.5, 7.0)], "name string, domain string, experience int, price double, satisfaction double")
    assert df.select(clean.summary_text()).first()[0] == (
        "A is a lawyer specializing in Tax with 3 years of experience. Charges approximately ₹2 and has a client satisfaction rating of 7.0/10."
    )


def test_display_unknown(spark):
    df = spark.createDataFrame([(None, None, None, None)], "domain string, experience int, price double, satisfaction double")
    assert set(clean.display_format(df).first()) == {"Unknown"}


def test_normalise_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["  Name ", "Age"])
    assert clean.normalise_columns(df, ["name"], lower=True).columns == ["name", "age"]
    with pytest.raises(ValueError, match="Fee"):
        clean.normalise_columns(df, ["Fee"])


def test_split_keeps_one_empty_item(spark):
    df = spark.createDataFrame([("",), ("A,  b ,C",)], "t string")
    assert [r[0] for r in df.select(clean.split_multi("t", lower=True)).collect()] == [[""], ["a", "b", "c"]]


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "location string")
    assert values(df.where(filters.contains_ci("location", "A.B")), "location") == ["a.b"]


def test_empty_specialty_overlaps_everything(spark):
    df = spark.createDataFrame([(["" ],), (["tax law"],), (["family"],)], "specs array<string>")
    assert values(df.where(filters.specialty_lists(["tax"])), "specs") == [[""], ["tax law"]]


def test_range_precedence(spark):
    df = spark.createDataFrame([(n,) for n in range(6)], "experience int")
    assert values(df.where(filters.experience_range(1, 2, 4)), "experience") == [4]
    assert values(df.where(filters.experience_range(None, 2)), "experience") == [0, 1, 2]


def test_missing_catalog_is_empty(spark):
    df = profiles.scan_catalog(spark, "/tmp/no-such-folder-for-catalog")
    assert df.schema == profiles.CATALOG and df.count() == 0


LISTING = """<html><div class="bs-box"><a href="/p/1"><div class="custom-value-name"> Ann &amp; Co </div></a>
<div class="custom-label">Experience</div><div> 12 Years </div>
<div class="custom-label">Specialization</div><div>Tax,<b>Civil</b></div>
<div class="custom-label">Location</div><div>Pune, MH</div><div class="rating-tag">4.5</div></div>
<div class="bs-box other"><a href="/p/2"><div class="custom-value-name">Bob</div></a>
<div class="custom-label">Experience</div><div>3 Years</div><div class="custom-label">Specialization</div><div></div>
<div class="custom-label">Location</div><div>Delhi</div></div></html>"""


def test_listing_blocks(spark):
    pages = spark.createDataFrame([(1, LISTING)], "page_id bigint, html string")
    rows = [r.asDict() for r in profiles.extract_listings(pages, "https://site.example").orderBy("pos").collect()]
    assert rows[0] == {"page_id": 1, "pos": 1, "name": "Ann & Co", "experience": "12 Years", "specialization": "Tax,Civil",
                       "location": "Pune, MH", "rating": "4.5", "profile_url": "https://site.example/p/1"}
    assert (rows[1]["name"], rows[1]["specialization"], rows[1]["rating"]) == ("Bob", "", "No rating")


def test_split_reads_only_its_files(spark, tmp_path):
    df = spark.range(20)
    profiles.write_splits(df, F.when(F.col("id") < 15, "train").otherwise("test"), f"{tmp_path}/d")
    part = profiles.load_split(spark, f"{tmp_path}/d", "test")
    assert part.count() == 5
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()
