"""Ordered scans and Pareto operators against brute force, with ties and hot keys."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import skyline
from rankloom.operators.ordered import exact_quantiles, global_rank, ordered_scan, value_blocks


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows belong to one key, and a third carry one value."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 1 / 3, 5.0, np.round(rng.exponential(10, n), 2))
    return pd.DataFrame({"key": key, "value": value, "id": np.arange(n), "w": rng.integers(0, 9, n)})


def test_ordered_scan_matches_plain_windows(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ordered_scan(value_blocks(df, "value"), ["key"], ["value", "id"], {
        "rn": ("row_number", None), "before": ("sum_before", "w"), "tot": ("total", "w"), "nx": ("next", "id"),
        "pv": ("prev", "id"), "fst": ("first", "id"), "lst": ("last", "id"),
    }).toPandas().sort_values("id").reset_index(drop=True)
    want = skewed.sort_values(["key", "value", "id"])
    g = want.groupby("key")
    want = want.assign(
        rn=g.cumcount() + 1, before=g.w.cumsum() - want.w, tot=g.w.transform("sum"), nx=g.id.shift(-1), pv=g.id.shift(1),
        fst=g.id.transform("first"), lst=g.id.transform("last"),
    ).sort_values("id").reset_index(drop=True)
    for c in ("rn", "before", "tot", "nx", "pv", "fst", "lst"):
        assert np.array_equal(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c


def test_null_neighbour_is_not_skipped(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c")], "k int, p bigint, v string").withColumn("_block", F.col("p"))
    got = ordered_scan(df, ["k"], ["p"], {"nx": ("next", "v")}).orderBy("p").collect()
    assert [r.nx for r in got] == [None, "c", None]


def test_missing_keys_and_values_are_kept(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), (None, 2.0)]
    df = value_blocks(spark.createDataFrame(rows, "k string, v double"), "v", 2)
    got = ordered_scan(df, ["k"], ["v"], {"rn": ("row_number", None)}).collect()
    assert sorted((r.k or "", r.v or 0.0, r.rn) for r in got) == [("", 1.0, 1), ("", 2.0, 2), ("", 3.0, 3), ("a", 0.0, 2), ("a", 2.0, 1)]


def test_global_rank(spark, skewed):
    got = global_rank(spark.createDataFrame(skewed), "id", "r").toPandas()
    assert (got["r"] == got["id"] + 1).all()


def test_exact_quantiles(spark, skewed):
    got = exact_quantiles(spark.createDataFrame(skewed), ["key"], "value", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("key")
    for key, part in skewed.groupby("key"):
        want = np.quantile(part["value"], [0.25, 0.5, 0.9])
        assert np.allclose(got.loc[key, ["a", "b", "c"]].to_numpy(float), want)


def brute(points):
    keep = []
    for i, p in enumerate(points):
        if not any(all(a <= b for a, b in zip(q, p)) and q != p for q in points):
            keep.append(i)
    return keep


@pytest.mark.parametrize("shape", ["random", "anti", "ties", "one", "same"])
def test_front_2d(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.random(400).round(2)
    y = {"random": rng.random(400).round(2), "anti": (1 - x).round(2), "ties": np.full(400, 0.5), "one": x, "same": x}[shape]
    pts = [(1.0, 2.0)] if shape == "one" else [(3.0, 3.0)] * 50 if shape == "same" else list(zip(x.tolist(), y.tolist()))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, a double, b double")
    got = sorted(r.id for r in skyline.pareto_front_2d(df, "a", "b").collect())
    assert got == brute(pts)


def test_front_2d_per_key_and_outlier(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3 == 0), float(rng.random()), float(rng.random())) for i in range(300)] + [(999, 1, 1e12, 5.0)]
    df = spark.createDataFrame(rows, "id int, k int, a double, b double")
    got = sorted(r.id for r in skyline.pareto_front_2d(df, "a", "b", ["k"]).collect())
    want = []
    for k in (0, 1):
        part = [r for r in rows if r[1] == k]
        want += [part[i][0] for i in brute([r[2:] for r in part])]
    assert got == sorted(want)


def test_empty_front(spark):
    df = spark.createDataFrame([], "id int, a double, b double")
    assert skyline.pareto_front_2d(df, "a", "b").count() == 0


@pytest.mark.parametrize("dims, chunk", [(3, 20_000), (3, 7), (4, 25)])
def test_front_any_dimension(spark, dims, chunk):
    rng = np.random.default_rng(dims)
    pts = [tuple(p) for p in rng.random((300, dims)).round(1).tolist()]
    cols = [f"o{i}" for i in range(dims)]
    df = spark.createDataFrame(pts, cols).repartition(6)
    got = sorted(tuple(r) for r in skyline.front_values(df, cols, pair_chunk=chunk).collect())
    assert got == sorted({pts[i] for i in brute(pts)})


def test_front_ranks(spark):
    rng = np.random.default_rng(1)
    pts = [tuple(p) for p in rng.random((200, 2)).round(2).tolist()]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, a double, b double")
    got = {r.id: r.front for r in skyline.front_ranks_2d(df, "a", "b", 4).collect()}
    rest, want = dict(enumerate(pts)), {}
    for level in range(4):
        ids = list(rest)
        for i in brute([rest[j] for j in ids]):
            want[ids[i]] = level
        rest = {i: p for i, p in rest.items() if i not in want}
    assert got == want


def test_front_ranks_until_enough_rows(spark):
    df = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], "id int, a double, b double")
    got = skyline.front_ranks_2d(df, "a", "b", rows=4)
    assert {r.front: r.n for r in got.groupBy("front").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 2, 2: 3}
    assert skyline.front_ranks_2d(df, "a", "b", rows=99).count() == 16
    assert skyline.front_ranks_2d(df.where("id < 0"), "a", "b", rows=5).count() == 0
    with pytest.raises(ValueError):
        skyline.front_ranks_2d(df, "a", "b")


def test_update_archive(spark):
    df = spark.createDataFrame([(0, 0.0, 4.0), (1, 1.0, 3.0), (2, 2.0, 2.0), (3, 4.0, 0.0), (4, 9.0, 9.0)], "id int, a double, b double")
    got = skyline.update_archive(df.where("id < 3"), df.where("id > 0"), "a", "b", "id", 3)
    assert sorted(r.id for r in got.collect()) == [0, 2, 3]


def test_crowding(spark):
    rows = [(0, 0, 1.0, 9.0), (0, 1, 2.0, 5.0), (0, 2, 2.0, 5.0), (0, 3, 6.0, 1.0), (1, 4, 3.0, 3.0), (1, 5, 3.0, 3.0), (1, 6, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "front int, id int, a double, b double")
    got = {r.id: r.crowding for r in skyline.crowding_distance(df, "front", ["a", "b"], "id").collect()}
    inf = math.inf
    assert {i: got[i] for i in (0, 3, 4, 6)} == {0: inf, 3: inf, 4: inf, 6: inf} and got[5] == 0.0
    assert got[1] == pytest.approx(1 / 5 + 4 / 8) and got[2] == pytest.approx(4 / 5 + 4 / 8)


def test_hypervolume_2d(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 2.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double")
    got = skyline.hypervolume_2d(df, "a", "b", F.lit(5.0), F.lit(5.0)).first()
    assert got.hypervolume == pytest.approx(4 * 1 + 3 * 2) and got.front_points == 2


def test_hypervolume_4d(spark):
    rng = np.random.default_rng(11)
    pts = rng.integers(0, 6, (25, 4)).astype(float)
    ref = [6.0, 6.0, 6.0, 5.0]
    got = skyline.hypervolume_4d(spark.createDataFrame(pts.tolist(), ["a", "b", "c", "d"]), ["a", "b", "c", "d"], ref).first()
    inside = pts[(pts < ref).all(1)]
    cells = sum(any((inside <= cell).all(1)) for cell in itertools.product(range(6), range(6), range(6), range(5)))
    assert got.hypervolume == pytest.approx(cells)


def test_hypervolume_4d_without_points(spark):
    df = spark.createDataFrame([(9.0, 9.0, 9.0, 9.0)], ["a", "b", "c", "d"])
    got = skyline.hypervolume_4d(df, ["a", "b", "c", "d"], [1, 1, 1, 1]).first()
    assert (got.hypervolume, got.front_points) == (0.0, 0)
