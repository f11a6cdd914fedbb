"""Score columns: bonuses, blends, weighted fitness; and single-request rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.operators.filters import any_term, contains_ci
from rankloom.operators.ordered import global_rank


def preference_score(df: DataFrame, required_spec: str | None = None, excluded_places: Sequence[str] = (),
                     excluded_specs: Sequence[str] = (), similarity: str = "similarity") -> DataFrame:
    """Add ``spec_bonus``, ``location_penalty``, ``spec_penalty`` and their sum with the similarity."""
    step = fixed.PREFERENCE_STEP

    def when(test: Column | None, value: float) -> Column:
        return F.lit(0.0) if test is None else F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    df = df.withColumns({
        "spec_bonus": when(contains_ci("specialization", required_spec) if required_spec else None, step),
        "location_penalty": when(any_term("location", excluded_places) if excluded_places else None, -step),
        "spec_penalty": when(any_term("specialization", excluded_specs) if excluded_specs else None, -step),
    })
    total = F.col(similarity) + F.col("spec_bonus") + F.col("location_penalty") + F.col("spec_penalty")
    return df.withColumn("final_score", total)


def rank_blends(df: DataFrame) -> DataFrame:
    """Add the three blended ranks built on similarity, experience, spec_count, final_score and score."""
    rank = F.col("similarity") + F.col("experience") / 50
    return df.withColumns({
        "rank_experience": rank,
        "rank_specs": rank + F.col("spec_count") / 10,
        "rank_score": F.col("final_score") + F.col("score") / 10,
    })


def weighted_fitness(candidates: DataFrame, catalog: DataFrame, budget: float) -> DataFrame:
    """Add ``fitness``: weighted min-max scores over the whole catalog plus closeness to the budget."""
    cols = ["experience", "settlements", "satisfaction"]
    lim = catalog.agg(
        F.struct(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).alias("lim")
    ).scalar()
    tiny = fixed.TINY
    terms = [
        F.lit(fixed.FITNESS_WEIGHTS[c]) * ((F.col(c) - lim[f"lo_{c}"]) / (lim[f"hi_{c}"] - lim[f"lo_{c}"] + tiny))
        for c in cols
    ]
    near = F.when(F.col("price") <= budget, 1 - (F.lit(float(budget)) - F.col("price")) / (budget + tiny)).otherwise(0.0)
    terms.append(F.lit(fixed.FITNESS_WEIGHTS["price"]) * near)
    return candidates.withColumn("fitness", reduce(lambda a, b: a + b, terms))


def trade_off(price: str = "price", satisfaction: str = "satisfaction") -> Column:
    return F.col(price) * (10 - F.col(satisfaction))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order. Spark limits each group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    return df.withColumn(out, rn).where(F.col(out) <= k)


def weighted_candidates(catalog: DataFrame, domain: str, budget: float) -> DataFrame:
    """Candidates of a domain within budget by fitness, then price; the best row per name."""
    pool = catalog.where((F.col("domain") == domain) & (F.col("price") <= budget))
    scored = weighted_fitness(pool, catalog, budget)
    best = [F.desc("fitness"), F.col("price"), F.col("item_id")]
    return first_per(scored, ["name"], best).orderBy(*best)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows, in hash order of the key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def repeat_to(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """The table repeated until it has ``size`` rows, in id order; adds the ``copy`` number.

    Only the last, partial copy needs positions, and these come from a blocked scan.
    """
    rows = df.count()
    whole, rest = divmod(size, rows) if rows else (0, 0)
    full = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)) if whole else F.array().cast("array<int>")))
    part = global_rank(df, id_col, "_pos").where(F.col("_pos") <= rest).drop("_pos")
    return full.unionByName(part.withColumn("copy", F.lit(whole + 1)))
