"""Frequent attribute sets and the basket matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage


def basket_matrix(baskets: DataFrame, items: Sequence[str] | None = None) -> DataFrame:
    """One row per basket, one 0/1 column per item. Wide output, so the item list is bounded."""
    if items is None:
        most = int(baskets.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        rows = baskets.select("item").distinct().orderBy("item").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} items; use basket_cells")
        items = [r[0] for r in rows]
    wide = baskets.groupBy("basket_id").pivot("item", list(items)).agg(F.max(F.lit(1)))
    return wide.na.fill(0)


def basket_cells(baskets: DataFrame) -> DataFrame:
    """The same matrix in long form, (basket_id, item, present): any number of items, cells of 0 left out."""
    return baskets.where(F.col("item").isNotNull()).select("basket_id", "item", F.lit(1).alias("present")).distinct()


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.1, n_baskets: int | None = None) -> DataFrame:
    """Itemsets of every size with support of at least ``min_support``, by parallel FP-growth.

    ``n_baskets`` is the denominator where baskets without any item count too.
    """
    lists = cut_lineage(baskets.groupBy("basket_id").agg(F.collect_set("item").alias("items")))
    present = lists.count()
    total = present if n_baskets is None else n_baskets
    # FP-growth counts against the baskets it sees; scale the threshold to the full denominator.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * total / max(present, 1)))
    found = model.fit(lists).freqItemsets
    return found.select(
        F.array_sort("items").alias("items"),
        F.size("items").alias("n_items"),
        F.col("freq").cast("bigint").alias("freq"),
        (F.col("freq") / F.lit(float(total))).alias("support"),
    ).where(F.col("support") >= min_support - 1e-12)  # where the scaled threshold had to be cut at 1


def itemset_curve(itemsets: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Itemsets per support threshold, from one mining run at the smallest threshold.

    Itemsets are counted per highest threshold reached, then summed downwards over the few thresholds.
    """
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.filter(levels, lambda t: F.col("support") >= t - 1e-12)
    per = itemsets.select(F.explode(reached).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
    spark = itemsets.sparkSession
    grid = spark.range(1).select(F.explode(levels).alias("threshold"))
    return grid.join(F.broadcast(per), "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_itemsets"))
