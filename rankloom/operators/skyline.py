"""Pareto fronts, front ranks, crowding, archive truncation and hypervolume. All objectives are minimised."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordered import BLOCK, join_cells, ordered_scan, value_blocks, with_key
from rankloom.session import cut_lineage

#: Most vectors one task compares against another chunk of the same size.
PAIR_CHUNK = 20_000
#: Bytes of front values (and, below, few rows of any kind) sent to every task; more are joined by shuffle.
MAX_SENT_BYTES = 8 << 20


def objective_columns(df: DataFrame, minimise: Sequence[str] = (), maximise: Sequence[str] = (),
                      complement: dict[str, float] | None = None) -> DataFrame:
    """Add one ``obj_<column>`` per objective: as is, sign-flipped, or ``ceiling - value``."""
    cols = {f"obj_{c}": F.col(c).cast("double") for c in minimise}
    cols |= {f"obj_{c}": -F.col(c).cast("double") for c in maximise}
    cols |= {f"obj_{c}": F.lit(float(top)) - F.col(c) for c, top in (complement or {}).items()}
    return df.withColumns(cols)


def _drop_below_earlier_blocks(df: DataFrame, by: Sequence[str], f2: str) -> DataFrame:
    """Drop points that some point of an earlier block (smaller first objective) dominates."""
    df, key = with_key(df, by)
    earlier = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*key, BLOCK]
    cells = df.groupBy(*keys).agg(F.min(f2).alias("_m")).select(*keys, F.min("_m").over(earlier).alias("_floor"))
    return join_cells(df, cells, by).where(F.col("_floor").isNull() | (F.col(f2) < F.col("_floor"))).drop("_floor", *key)


def front_values_2d(df: DataFrame, f1: str, f2: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct (f1, f2) pairs no other pair of the same ``by`` key dominates.

    Points are reduced to one row per f1. Blocks of f1, cut at quantiles, discard nearly all of them with codegen
    arithmetic and one small join; what is left is cut at quantiles again and swept by a running minimum inside each block. No step holds a whole key in one task.
    """
    pts = df.select(*by, f1, f2).where(F.col(f1).isNotNull() & F.col(f2).isNotNull())
    # Of equal f1 only the best f2 can be on a front. Written, so that what ``df`` is made of runs once for all steps below.
    best = cut_lineage(pts.groupBy(*by, f1).agg(F.min(f2).alias(f2)))
    # Cut at quantiles, so that a few outliers cannot put all other points into one block.
    left = cut_lineage(_drop_below_earlier_blocks(value_blocks(best, f1), by, f2))  # few rows
    fine = _drop_below_earlier_blocks(value_blocks(left, f1), by, f2)
    sweep = Window.partitionBy(*by, BLOCK).orderBy(f1).rowsBetween(Window.unboundedPreceding, -1)
    return (
        fine.withColumn("_best", F.min(f2).over(sweep))
        .where(F.col("_best").isNull() | (F.col(f2) < F.col("_best")))
        .select(*by, f1, f2)
    )


def pareto_front_2d(df: DataFrame, f1: str, f2: str, by: Sequence[str] = ()) -> DataFrame:
    """All rows of ``df`` on the front, duplicates of a front point included."""
    return df.join(_small(front_values_2d(df, f1, f2, by)), [*by, f1, f2], "left_semi")


def _small(values: DataFrame) -> DataFrame:
    """A table of values, written and counted: sent to every task if it is small, so that the rows it meets stay put."""
    written = cut_lineage(values)
    return F.broadcast(written) if written.count() * 16 * len(written.columns) <= MAX_SENT_BYTES else written


def dominated_flag_2d(df: DataFrame, f1: str, f2: str) -> DataFrame:
    """Every row with a flag telling whether another row dominates it."""
    front = _small(front_values_2d(df, f1, f2).withColumn("_on_front", F.lit(True)))
    return df.join(front, [f1, f2], "left").select(
        *df.columns, F.col("_on_front").isNull().alias("dominated")
    )


def _dominated_by(cand: np.ndarray, against: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(cand), dtype=bool)
    for lo in range(0, len(cand), 256):
        part = cand[lo:lo + 256, None, :]
        for at in range(0, len(against), 4096):
            other = against[None, at:at + 4096, :]
            hit[lo:lo + 256] |= ((other <= part).all(-1) & (other < part).any(-1)).any(-1)
    return hit


def _front_of(points: np.ndarray) -> np.ndarray:
    # Sorted distinct rows: in lexicographic order a dominating vector always comes first.
    points = np.unique(points, axis=0)
    kept = points[:0]
    for lo in range(0, len(points), 512):
        part = points[lo:lo + 512]
        part = part[~_dominated_by(part, kept)]
        kept = np.concatenate([kept, part[~_dominated_by(part, part)]])
    return kept


def front_values(df: DataFrame, objectives: Sequence[str], pair_chunk: int = PAIR_CHUNK) -> DataFrame:
    """Distinct non-dominated vectors for any number of objectives.

    Each partition drops what it dominates itself, before anything is shuffled. The survivors are cut into
    chunks and every chunk is checked against every chunk, one task per pair, so no task sees more than two.
    """
    cols = list(objectives)
    schema = ", ".join(f"{c} double" for c in cols)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty((0, len(cols)))
        for pdf in batches:
            best = _front_of(np.concatenate([best, pdf[cols].to_numpy(dtype=float)]))
        yield pd.DataFrame(best, columns=cols)

    def losers(pdf: pd.DataFrame) -> pd.DataFrame:
        cand = pdf.loc[pdf["_cand"], cols].to_numpy(dtype=float)
        against = pdf.loc[~pdf["_cand"], cols].to_numpy(dtype=float)
        return pd.DataFrame(cand[_dominated_by(cand, against)], columns=cols)

    vectors = reduce(lambda d, c: d.where(F.col(c).isNotNull()), cols, df.select(*cols))
    left = cut_lineage(vectors.mapInPandas(local, schema).distinct())
    size, turn = left.count(), 0
    while size > pair_chunk:
        # Regroup the survivors into fewer partitions and prune again, as long as that pays.
        turn += 1
        spread = left.repartition(-(-size // pair_chunk), F.xxhash64(*cols, F.lit(turn)))
        left, before = cut_lineage(spread.mapInPandas(local, schema)), size
        size = left.count()
        if size > 0.8 * before:
            break
    chunks = -(-size // pair_chunk) or 1
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    mine = F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int")
    tagged = left.withColumn("_mine", mine).withColumn("_other", other)
    sides = tagged.select(*cols, F.col("_mine").alias("_i"), F.col("_other").alias("_j"), F.lit(True).alias("_cand"))
    sides = sides.unionByName(
        tagged.select(*cols, F.col("_other").alias("_i"), F.col("_mine").alias("_j"), F.lit(False).alias("_cand"))
    )
    dominated = sides.groupBy("_i", "_j").applyInPandas(losers, schema).distinct()
    return left.join(dominated, cols, "left_anti")


def pareto_front(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """All rows of ``df`` whose objective vector no other vector dominates."""
    return df.join(_small(front_values(df, objectives)), list(objectives), "left_semi")


def front_ranks_2d(df: DataFrame, f1: str, f2: str, fronts: int | None = None, rows: int | None = None) -> DataFrame:
    """Rows of the first fronts with their ``front`` number, peeling one front per round.

    Stops after ``fronts`` rounds, or once ``rows`` rows are ranked, or when none are left. The rows are read once
    and reduced to distinct pairs with their counts; the rounds peel what is left of that table, and the
    ranks meet the rows in one join.
    """
    if fronts is None and rows is None:
        raise ValueError("give a number of fronts or of rows")
    pairs = df.where(F.col(f1).isNotNull() & F.col(f2).isNotNull()).groupBy(f1, f2).agg(F.count(F.lit(1)).alias("_n"))
    rest, found, ranked = cut_lineage(pairs), [], 0
    while (fronts is None or len(found) < fronts) and (rows is None or ranked < rows):
        values = _small(front_values_2d(rest, f1, f2))
        if rows is not None:
            more = rest.join(values, [f1, f2], "left_semi").agg(F.sum("_n")).first()[0] or 0
            if not more and found:
                break
            ranked += more
        found.append(values.withColumn("front", F.lit(len(found))))
        if rows is not None and not more:
            break
        rest = cut_lineage(rest.join(values, [f1, f2], "left_anti"))
    levels = reduce(DataFrame.unionByName, found)
    return df.join(_small(levels), [f1, f2])


def update_archive(archive: DataFrame, candidates: DataFrame, f1: str, f2: str, id_col: str, size: int) -> DataFrame:
    """The best ``size`` rows of archive and candidates together: whole fronts, the last one by crowding."""
    merged = archive.unionByName(candidates).distinct()
    ranked = front_ranks_2d(merged, f1, f2, rows=size)
    return truncate_archive(crowding_distance(ranked, "front", [f1, f2], id_col), size, id_col)


def crowding_distance(df: DataFrame, front: str, objectives: Sequence[str], id_col: str) -> DataFrame:
    """Add ``crowding`` per front: sum of neighbour gaps over the objective's range, infinite at the ends.

    Equal values are ordered by id. Neighbours are looked up once per distinct value, so no task meets
    all rows of a frequent value.
    """
    lens = df.select(
        front, id_col,
        F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(o).alias("v")) for o in objectives])).alias("e"),
    ).select(front, id_col, "e.o", "e.v")
    # Objectives differ in scale, so block each on its own position between its smallest and largest value.
    spread = lens.groupBy(front, "o").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    values = (
        lens.groupBy(front, "o", "v").agg(F.min(id_col).alias("id_lo"), F.max(id_col).alias("id_hi"))
        .join(spread, [front, "o"])
        .withColumn("pos", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    )
    values = cut_lineage(values)  # read three times below
    values = ordered_scan(
        value_blocks(values, "pos"), [front, "o"], ["v"], {"pv": ("prev", "v"), "nv": ("next", "v")}
    ).drop("pos")
    # Among equal values only the first and the last id have a neighbour at a distance; the rest add 0.
    first_right = F.when(F.col("id_lo") == F.col("id_hi"), F.col("nv")).otherwise(F.col("v"))
    ends = F.array_distinct(F.array(
        F.struct(F.col("id_lo").alias("id"), F.col("pv").alias("left"), first_right.alias("right")),
        F.struct(F.col("id_hi").alias("id"), F.when(F.col("id_lo") == F.col("id_hi"), F.col("pv")).otherwise(F.col("v")).alias("left"), F.col("nv").alias("right")),
    ))
    near = values.select(front, "lo", "hi", F.explode(ends).alias("e")).select(front, "lo", "hi", "e.*")
    gap = (
        F.when(F.col("left").isNull() | F.col("right").isNull(), F.lit(float("inf")))
        .when(F.col("hi") > F.col("lo"), (F.col("right") - F.col("left")) / (F.col("hi") - F.col("lo")))
        .otherwise(0.0)
    )
    scores = near.groupBy(front, F.col("id").alias(id_col)).agg(F.sum(gap).alias("_c"))
    return df.join(scores, [front, id_col], "left").withColumn("crowding", F.coalesce("_c", F.lit(0.0))).drop("_c")


def truncate_archive(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """Keep ``size`` rows: whole fronts first, the last one by falling crowding, then id."""
    return df.orderBy("front", F.desc("crowding"), id_col).limit(size)


def hypervolume_2d(df: DataFrame, f1: str, f2: str, ref1: Column, ref2: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area between the front of ``df`` and the reference point, per ``by`` key, with the front size."""
    values = cut_lineage(front_values_2d(df, f1, f2, by))
    steps = ordered_scan(value_blocks(values, f1), by, [f1], {"_prev": ("prev", f2)})
    area = (ref1 - F.col(f1)) * (F.coalesce(F.col("_prev"), ref2) - F.col(f2))
    return steps.withColumn("_area", area).groupBy(*by).agg(
        F.sum("_area").alias("hypervolume"), F.count(F.lit(1)).alias("front_points")
    )


def front_progress(df: DataFrame, batch: str, id_col: str, f1: str, f2: str, batches: int,
                   ref1: Column, ref2: Column) -> DataFrame:
    """Front size and hypervolume after each cumulative batch 0..t.

    Only each batch's own front values are copied to the later steps, not the rows.
    """
    per_batch = front_values_2d(df, f1, f2, [batch])
    upto = per_batch.withColumn("step", F.explode(F.sequence(F.col(batch), F.lit(batches - 1).cast("bigint"))))
    upto = cut_lineage(upto.select("step", f1, f2).distinct())
    values = cut_lineage(front_values_2d(upto, f1, f2, ["step"]))
    # Copies are counted of front points only.
    on_front = df.join(_small(values.select(f1, f2).distinct()), [f1, f2], "left_semi")
    counts = on_front.groupBy(batch, f1, f2).agg(F.count(id_col).alias("copies"))
    archive = (
        values.join(counts, [f1, f2]).where(F.col(batch) <= F.col("step"))
        .groupBy("step").agg(F.sum("copies").alias("archive_size"))
    )
    volume = hypervolume_2d(upto, f1, f2, ref1, ref2, ["step"]).select("step", "hypervolume")
    return volume.join(archive, "step")


def _area_3d(points: np.ndarray, ref: np.ndarray) -> float:
    """Volume dominated by 3-D points: sweep the third axis, keeping a 2-D staircase."""
    points = points[np.argsort(points[:, 2], kind="stable")]
    volume, stairs = 0.0, np.empty((0, 2))
    for i, p in enumerate(points):
        stairs = np.concatenate([stairs, p[None, :2]])
        stairs = stairs[np.lexsort((stairs[:, 1], stairs[:, 0]))]
        low = np.minimum.accumulate(stairs[:, 1])
        stairs = stairs[np.concatenate([[True], stairs[1:, 1] < low[:-1]])]
        top = points[i + 1, 2] if i + 1 < len(points) else ref[2]
        heights = np.concatenate([[ref[1]], stairs[:-1, 1]]) - stairs[:, 1]
        volume += float(((ref[0] - stairs[:, 0]) * heights).sum()) * (top - p[2])
    return volume


def hypervolume_4d(df: DataFrame, objectives: Sequence[str], ref: Sequence[float]) -> DataFrame:
    """Exact 4-D hypervolume to ``ref``: slices along the last objective, groups of slices per task.

    A slice needs every front point at or below it, so a task gets the front below its last slice;
    rows of ``df`` off the front, or not below ``ref``, never leave the first step.
    """
    a, b, c, d = objectives
    inside = reduce(lambda x, y: x & y, [F.col(o) < F.lit(float(r)) for o, r in zip(objectives, ref)])
    front = cut_lineage(front_values(df.where(inside), objectives))
    levels = ordered_scan(value_blocks(front.select(d).distinct(), d), [], [d], {"upper": ("next", d)})
    slices = value_blocks(levels, d)
    grouped = slices.groupBy(BLOCK).agg(F.array_sort(F.collect_list(F.struct(d, "upper"))).alias("_slices"))
    last_block = F.lit(slices.agg(F.max(BLOCK)).first()[0])
    # A point lies in its own slice's block and counts for every later one.
    copies = front.join(slices.select(d, BLOCK), d).withColumn(BLOCK, F.explode(F.sequence(F.col(BLOCK), last_block)))
    share = copies.join(grouped, BLOCK)
    ref_arr = np.array(ref, dtype=float)

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[[a, b, c, d]].to_numpy(dtype=float)
        total = 0.0
        for item in pdf["_slices"].iloc[0]:
            low, up = item[d], item["upper"]
            up = ref_arr[3] if up is None or np.isnan(up) else up
            total += _area_3d(pts[pts[:, 3] <= low][:, :3], ref_arr[:3]) * (up - low)
        return pd.DataFrame({"v": [total]})

    parts = share.groupBy(BLOCK).applyInPandas(volume, "v double")
    return parts.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("hypervolume")).select(
        "hypervolume", front.agg(F.count(F.lit(1)).alias("n")).scalar().alias("front_points")
    )
