"""Predicates over profile tables, as columns. A null or empty argument asks for nothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lit(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def contains_ci(column: str, term: str | Column) -> Column:
    """Literal, case-insensitive containment."""
    return F.contains(F.lower(column), F.lower(_lit(term)))


def experience_than(op: str, years: int, column: str = "experience") -> Column:
    return F.col(column) < years if op == "less" else F.col(column) > years


def within_budget(budget: float, column: str = "price") -> Column:
    return F.col(column) <= budget


def domain_is(domain: str, column: str = "domain", ignore_case: bool = True) -> Column:
    return F.lower(column) == domain.lower() if ignore_case else F.col(column) == domain


def filter_directory(df: DataFrame, city: str | None = None, min_experience: int = 0, specialization: str | None = None) -> DataFrame:
    tests = [F.col("experience_years") >= min_experience]
    if city:
        tests.append(contains_ci("location", city))
    if specialization:
        tests.append(contains_ci("specialization", specialization))
    return df.where(reduce(lambda a, b: a & b, tests))


def place_or_specialty(term: str) -> Column:
    return contains_ci("location", term) | contains_ci("specialization", term)


def any_term(column: str, terms: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(column), t))


def city_in(df: DataFrame, cities: DataFrame, column: str = "city", negate: bool = False) -> DataFrame:
    """Rows whose city is (or is not) in the table ``cities(city)``."""
    wanted = cities.select(F.lower("city").alias(column)).distinct()
    return df.join(wanted, column, "left_anti" if negate else "left_semi")


def overlaps(items: Column, terms: Column) -> Column:
    """Some item contains some term or the other way round; an empty item is contained in any term."""
    return F.exists(items, lambda s: F.exists(terms, lambda t: F.contains(s, t) | F.contains(t, s)))


def specialty_lists(include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "specs") -> Column:
    test = F.lit(True)
    if include:
        test = test & overlaps(F.col(column), F.array(*[F.lit(x) for x in include]))
    if exclude:
        test = test & ~overlaps(F.col(column), F.array(*[F.lit(x) for x in exclude]))
    return test


def specialty_contains(include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "specialization") -> Column:
    """One-directional form on the raw text."""
    test = F.lit(True)
    if include:
        test = test & any_term(column, include)
    if exclude:
        test = test & ~any_term(column, exclude)
    return test


def experience_range(min_exp: object = None, max_exp: object = None, exact: object = None, column: str = "experience") -> Column:
    """Inclusive range; an exact value takes precedence. Arguments are numbers or columns."""
    x, lo, hi, eq = F.col(column), _lit(min_exp), _lit(max_exp), _lit(exact)
    ranged = F.coalesce(x >= lo.cast("bigint"), F.lit(True)) & F.coalesce(x <= hi.cast("bigint"), F.lit(True))
    return F.when(eq.isNotNull(), x == eq.cast("bigint")).otherwise(ranged)
