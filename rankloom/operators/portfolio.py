"""Weight-vector solutions over a catalog: objective values, representatives, merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.operators.score import first_per
from rankloom.operators.skyline import MAX_SENT_BYTES, pareto_front
from rankloom.session import cut_lineage

OBJECTIVES = ["obj_experience", "obj_settlements", "obj_satisfaction", "obj_price"]


def _clipped() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w")))


def with_profiles(weights: DataFrame, catalog: DataFrame) -> DataFrame:
    """Weights with their items' columns. Both sides are shuffled: Spark takes a table of weights that are made of the
    items themselves for as small as these, however many solutions there are, and would collect all of it for a broadcast."""
    return weights.join(catalog.hint("merge"), "item_id")


def solution_objectives(weights: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("sol_id",)) -> DataFrame:
    """Objective vector per solution: clipped weights, normalised by their sum, times the profiles.

    One equi-join and one partial aggregate; gains are negated so that all objectives are minimised.
    """
    w, total = _clipped(), F.sum(_clipped()) + fixed.TINY
    joined = with_profiles(weights, catalog.select("item_id", "experience", "settlements", "satisfaction", "price"))
    return joined.groupBy(*keys).agg(
        *[(-F.sum(w * F.col(c)) / total).alias(f"obj_{c}") for c in ("experience", "settlements", "satisfaction")],
        (F.sum(w * F.col("price")) / total).alias("obj_price"),
    )


def representatives(weights: DataFrame, keys: Sequence[str] = ("sol_id",)) -> DataFrame:
    """The item with the largest weight per solution, the first one on ties.

    Two passes with buffers of fixed width, which are hashed: one over (weight, item) pairs would sort all weights of a task.
    """
    top = cut_lineage(weights.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(_clipped()).alias("_top")))
    small = top.count() * 16 * len(top.columns) <= MAX_SENT_BYTES
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    best = weights.join(F.broadcast(top) if small else top.hint("merge"), same & (_clipped() == F.col("_top")))
    return best.groupBy(*keys).agg(F.min("item_id").alias("item_id"))


def select_portfolio(weights: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("sol_id",)) -> DataFrame:
    """Non-dominated solutions, each as its representative item; the first solution of each name, by price objective."""
    front = pareto_front(solution_objectives(weights, catalog, keys), OBJECTIVES)
    chosen = front.join(representatives(weights, keys), list(keys)).join(catalog, "item_id")
    return first_per(chosen, ["name"], [F.col(k) for k in keys]).orderBy("obj_price", "item_id")


def merge_solutions(weights: DataFrame, catalog: DataFrame) -> DataFrame:
    """Solutions of several seeds as their representatives, with gains given as positive scores."""
    keys = ["seed", "sol_id"]
    found = solution_objectives(weights, catalog, keys).join(representatives(weights, keys), keys).join(catalog, "item_id")
    scored = found.withColumns({
        "experience_score": -F.col("obj_experience"), "settlements_score": -F.col("obj_settlements"),
        "satisfaction_score": -F.col("obj_satisfaction"), "price_objective": F.col("obj_price"),
    }).drop(*OBJECTIVES)
    return first_per(scored, ["name"], [F.col("seed"), F.col("sol_id")]).orderBy("price_objective", "item_id")
