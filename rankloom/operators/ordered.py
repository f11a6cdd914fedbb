"""Ordered scans (prefix sums, row numbers, neighbours) without one task per key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and a window without
``partitionBy`` sends the whole table there. Here the order column is cut into blocks first: the
window runs inside (key, block), a small table with one row per (key, block) carries sums and border
rows from block to block, and both meet in an equi-join on (key, block). The large side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankloom.session import block_count, cut_lineage

BLOCK = "_block"
KEY = "_key"


def value_blocks(df: DataFrame, col: str, blocks: int | None = None) -> DataFrame:
    """Add a block number, monotone in ``col``, cut at approximate quantiles of its values.

    The cut points, at most ``MAX_BLOCKS`` numbers, come from one mergeable sketch. They enter the plan as
    constants, so that both sides of a later join, and tasks run again, use the very same cuts.
    Rows with equal values share a block, so callers with heavy ties group by value first.
    """
    n = blocks or block_count(df.sparkSession)
    if isinstance(df.schema[col].dataType, StringType):
        return _text_blocks(df, col, n)
    cuts = [i / n for i in range(1, n)]
    value = F.col(col).cast("double")
    endless = value.isin(float("inf"), float("-inf"))
    found = df.agg(F.percentile_approx(F.when(~F.isnan(value) & ~endless, value), cuts, 4 * n)).first()[0]
    bounds = sorted(set(found or []))
    inner = F.lit(1)
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        df = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(df.withColumn("_at", value))
        inner = F.col("_bucket").cast("int") + 1
    # Blocks in the order of values: minus infinity, the cut range, infinity, NaN, and missing values last.
    last = len(bounds) + 2
    block = (
        F.when(value.isNull(), last + 2).when(F.isnan(value), last + 1).when(value == float("inf"), last)
        .when(value == float("-inf"), 0).otherwise(inner)
    )
    return df.withColumn(BLOCK, block.cast("int")).drop("_at", "_bucket")


def _text_blocks(df: DataFrame, col: str, n: int) -> DataFrame:
    """Blocks along text values: cut at values of a bounded sample of the rows, chosen by hash."""
    share = F.pmod(F.xxhash64(col), F.lit(1_000_003)) / 1_000_003.0
    rows = df.where(F.col(col).isNotNull())
    size = rows.count()
    sample = rows.select(col).where(share < 64.0 * n / max(size, 1)).distinct().limit(256 * n)
    found = sorted(r[0] for r in sample.collect())
    bounds = sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []
    cells = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    return df.withColumn(BLOCK, F.when(F.col(col).isNull(), len(bounds) + 1).otherwise(_places_below(cells, F.col(col), len(bounds))).cast("int"))


def _places_below(cells: Column, value: Column, n: int) -> Column:
    """How many of ``n`` sorted values are at most ``value``, by halving."""
    at = F.lit(0)
    for k in reversed(range(n.bit_length())):
        ahead = at + (1 << k)
        at = F.when((ahead <= n) & (F.get(cells, ahead - 1) <= value), ahead).otherwise(at)
    return at


def value_range(df: DataFrame, col: str) -> tuple[float, float]:
    """Smallest and largest value; (0, 0) where there are none."""
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    return (0.0, 0.0) if lo is None else (lo, hi)


def equal_width_bin(col: str, lo: float, hi: float, bins: int) -> Column:
    """Bin number 0..bins-1 of ``col`` between ``lo`` and ``hi``."""
    if not hi > lo:
        return F.lit(0)
    return F.least(F.floor((F.col(col) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def step_blocks(df: DataFrame, col: str, width: int) -> DataFrame:
    """Add a block number for a whole-number position unique within its key: ``width`` positions each."""
    return df.withColumn(BLOCK, F.expr(f"`{col}` div {int(width)}"))


def with_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The key columns as one struct, which also groups and joins rows whose key is missing."""
    return (df.withColumn(KEY, F.struct(*by)), [KEY]) if by else (df, [])


def join_cells(df: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the table of one row per (key, block) to the rows."""
    if not by:
        return df.join(F.broadcast(cells), BLOCK)  # one row per block, at most MAX_BLOCKS + 1
    return df.join(cells, [KEY, BLOCK])


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, str | None]],
) -> DataFrame:
    """Add columns computed along ``order`` within each ``by`` key; ``df`` must carry ``_block``.

    ``specs`` maps an output name to ``(kind, column)`` with kind one of ``row_number``,
    ``sum_before``, ``prev``, ``next``, ``first``, ``last`` and ``total`` (sum over the key).
    """
    columns = [c for c in df.columns if c != BLOCK]
    df, key = with_key(df, by)
    # Plain columns where possible: then the partial aggregate below hashes instead of sorting.
    sort_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inner = Window.partitionBy(*key, BLOCK).orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    over_cells = Window.partitionBy(*key).orderBy(BLOCK)
    cells_before = over_cells.rowsBetween(Window.unboundedPreceding, -1)
    whole_key = over_cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    cell_aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    carried: list[Column] = []
    local: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for out, (kind, col) in specs.items():
        cell, carry, part = f"_c_{out}", f"_k_{out}", f"_l_{out}"
        if kind == "row_number":
            carried.append(F.coalesce(F.sum("_n").over(cells_before), F.lit(0)).alias(carry))
            local[part] = F.row_number().over(inner)
            final[out] = (F.col(carry) + F.col(part)).cast("bigint")
        elif kind == "sum_before":
            cell_aggs.append(F.sum(col).alias(cell))
            carried.append(F.coalesce(F.sum(cell).over(cells_before), F.lit(0)).alias(carry))
            local[part] = F.coalesce(F.sum(col).over(before), F.lit(0))
            final[out] = F.col(carry) + F.col(part)
        elif kind == "total":
            cell_aggs.append(F.sum(col).alias(cell))
            carried.append(F.sum(cell).over(whole_key).alias(carry))
            final[out] = F.col(carry)
        elif kind in ("first", "last"):
            pick = F.min_by if kind == "first" else F.max_by
            cell_aggs.append(pick(col, sort_key).alias(cell))
            take = F.first if kind == "first" else F.last
            carried.append(take(cell).over(whole_key).alias(carry))
            final[out] = F.col(carry)
        elif kind in ("prev", "next"):
            pick = F.max_by if kind == "prev" else F.min_by
            shift = F.lag if kind == "prev" else F.lead
            cell_aggs.append(pick(col, sort_key).alias(cell))
            carried.append(shift(cell).over(over_cells).alias(carry))
            local[part] = shift(col).over(inner)
            # Tells a neighbour without a value from the block's border.
            local[f"_has_{kind}"] = shift(F.lit(1)).over(inner)
            final[out] = F.when(F.col(f"_has_{kind}").isNotNull(), F.col(part)).otherwise(F.col(carry))
        else:
            raise ValueError(f"unknown kind {kind!r}")

    keys = [*key, BLOCK]
    cells = df.groupBy(*keys).agg(*cell_aggs).select(*keys, *carried)
    joined = join_cells(df.withColumns(local) if local else df, cells, by)
    return joined.select(*columns, *[expr.alias(out) for out, expr in final.items()])


def global_rank(df: DataFrame, order_col: str, out: str) -> DataFrame:
    """1-based position of each row along a unique ``order_col`` over the whole table."""
    return ordered_scan(value_blocks(df, order_col), [], [order_col], {out: ("row_number", None)})


def counted_quantiles(
    counted: DataFrame, by: Sequence[str], col: str, count: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per ``by`` key, by rank selection on counted distinct values.

    Since equal values are one row, a hot key or value costs no single task.
    """
    ranked = ordered_scan(
        value_blocks(counted, col), by, [col], {"_below": ("sum_before", count), "_total": ("total", count)}
    )
    upto = F.col("_below") + F.col(count)
    picks, outs = [F.max("_total").alias("n")], []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_below") <= rank) & (rank < upto)
            picks.append(F.max(F.when(hit, F.col(col).cast("double"))).alias(f"_{name}_{tag}"))
        frac = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (frac - F.floor(frac))).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, "n", *outs)


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a column per ``by`` key."""
    counted = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_cnt"))
    return counted_quantiles(cut_lineage(counted), by, col, "_cnt", probs)
