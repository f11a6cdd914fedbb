"""Cleaning and derived columns of profile tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_columns(df: DataFrame, required: Sequence[str] = (), lower: bool = False) -> DataFrame:
    """Strip (and optionally lower-case) column names; raise if a required one is missing."""
    names = [c.strip().lower() if lower else c.strip() for c in df.columns]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df.toDF(*names)


def experience_years(text: Column | str) -> Column:
    """First run of digits as a number; 0 when there is none."""
    digits = F.regexp_extract(_col(text).cast("string"), "([0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def fill_missing(df: DataFrame, default: str | None = None, per_column: Mapping[str, object] | None = None) -> DataFrame:
    """Fill nulls: a default for all string columns and a value per named column."""
    if per_column:
        df = df.na.fill(dict(per_column))
    return df.na.fill(default) if default is not None else df


def tier_rating(years: Column | str) -> Column:
    rating: Column | None = None
    for least, value in fixed.RATING_TIERS:
        hit = _col(years) >= least
        rating = F.when(hit, F.lit(value)) if rating is None else rating.when(hit, F.lit(value))
    return rating.otherwise(F.lit(fixed.RATING_FLOOR))


def whole_number(value: Column | str) -> Column:
    """Rounded half to even, as text without decimals."""
    return F.bround(_col(value), 0).cast("bigint").cast("string")


def summary_text(role: str = "lawyer", currency: str = "₹") -> Column:
    """One sentence per profile, from the catalog's columns."""
    slots = {
        "name": F.col("name"), "domain": F.col("domain"), "experience": F.col("experience").cast("string"),
        "price": whole_number("price"), "satisfaction": F.col("satisfaction").cast("string"),
    }
    text = fixed.SUMMARY_TEMPLATE.replace("{role}", role).replace("{currency}", currency)
    parts: list[Column] = []
    for piece in text.split("{"):
        slot, closed, tail = piece.partition("}")
        parts += [slots[slot], F.lit(tail)] if closed else [F.lit(piece)]
    return F.concat(*parts)


def split_multi(text: Column | str, lower: bool = False) -> Column:
    """Comma-separated text to a trimmed list; ``lower`` also folds case."""
    value = F.lower(_col(text)) if lower else _col(text)
    return F.transform(F.split(value, ","), lambda x: F.trim(x))


def primary_city(location: Column | str) -> Column:
    return F.lower(F.trim(F.split_part(_col(location), F.lit(","), F.lit(1))))


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select the mapping's source columns under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def title_case(text: Column | str) -> Column:
    return F.initcap(_col(text))


def display_format(df: DataFrame, currency: str = "₹", thousands: bool = False, titled: bool = False) -> DataFrame:
    """Display texts for experience, price, satisfaction and domain; null gives ``Unknown``.

    The domain stays as it is unless ``titled``, the form of the directory listing.
    """
    amount = F.format_number(F.bround("price", 0), 0) if thousands else whole_number("price")
    shown = {
        "experience": F.concat(F.col("experience").cast("string"), F.lit(" years")),
        "price": F.concat(F.lit(currency), amount),
        "satisfaction": F.concat(F.col("satisfaction").cast("string"), F.lit("/10")),
        "domain": title_case("domain") if titled else F.col("domain"),
    }
    return df.withColumns({c: F.coalesce(v, F.lit(fixed.UNKNOWN)) for c, v in shown.items()})


def spec_score(df: DataFrame, experience: str = "experience", specs: str = "specs") -> DataFrame:
    """Add ``spec_count`` and ``score`` = experience + spec_count."""
    return df.withColumn("spec_count", F.size(specs)).withColumn("score", F.col(experience) + F.col("spec_count"))


def item_sentence(name: str, years: str, specs: str, place: str) -> Column:
    """The profile as one sentence for an encoder; missing parts are left empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(part(name), F.lit(" "), part(years), F.lit(" years experience in "), part(specs), F.lit(" at "), part(place))


def item_text(*cols: str) -> Column:
    """Profile text for an encoder: name, years, specialties, place."""
    name, years, specs, place = cols
    return F.concat_ws(" ", F.col(name), F.concat(F.col(years).cast("string"), F.lit(" years")), F.col(specs), F.col(place))
