"""Matching, text search, mining, clustering and streams."""

import itertools
import math
import os
import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom.functions.vectors import cosine, mean_pool, with_vectors
from rankloom.operators import cluster, match, mining, score, stats, text_similarity
from rankloom.streaming import jobs


def items_and_requests(spark, n_items=400, n_requests=60):
    rng = np.random.default_rng(2)
    domain = np.where(np.arange(n_items) % 3 == 0, "Tax", rng.choice(["Civil", "Family"], n_items))
    items = pd.DataFrame({
        "item_id": np.arange(n_items), "experience": rng.integers(0, 40, n_items), "price": rng.integers(1, 100, n_items).astype(float),
        "domain": domain, "embedding": [v.tolist() for v in rng.integers(-2, 3, (n_items, 4)).astype(float)],
    })
    requests = pd.DataFrame({
        "request_id": np.arange(n_requests), "above": np.where(np.arange(n_requests) % 2 == 0, 10.0, np.nan),
        "below": np.where(np.arange(n_requests) % 5 == 0, 30.0, np.nan), "budget": np.where(np.arange(n_requests) % 3 == 0, 50.0, np.nan),
        "domain": [[None, "tax", "civil", "nowhere"][i % 4] for i in range(n_requests)],
        "embedding": [v.tolist() for v in rng.integers(-2, 3, (n_requests, 4)).astype(float)],
    })
    schema = "request_id bigint, above double, below double, budget double, domain string, embedding array<float>"
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in requests.itertuples(index=False)]
    return items, requests, spark.createDataFrame(items, "item_id bigint, experience int, price double, domain string, embedding array<float>").repartition(5), spark.createDataFrame(rows, schema)


def brute_pairs(items, requests):
    for r in requests.itertuples():
        for i in items.itertuples():
            if ((math.isnan(r.above) or i.experience > r.above) and (math.isnan(r.below) or i.experience < r.below)
                    and (math.isnan(r.budget) or i.price <= r.budget) and (r.domain is None or r.domain == i.domain.lower())):
                a, b = np.array(r.embedding), np.array(i.embedding)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                yield r.request_id, i.item_id, round(float(a @ b / size), 9) + 0.0 if size else 0.0


@pytest.mark.parametrize("shipped", [1000, 7])
def test_top_k_both_ways(spark, shipped):
    items, requests, item_df, request_df = items_and_requests(spark)
    got = sorted((r.request_id, r["rank"], r.item_id, r.similarity) for r in match.top_k(request_df, item_df, 5, shipped).collect())
    want = []
    for rid, rows in itertools.groupby(brute_pairs(items, requests), key=lambda t: t[0]):
        best = sorted(rows, key=lambda t: (-t[2], t[1]))[:5]
        want += [(rid, n + 1, i, pytest.approx(s, abs=1e-9)) for n, (_, i, s) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("shipped", [1000, 7])
def test_match_stats_both_ways(spark, shipped):
    items, requests, item_df, request_df = items_and_requests(spark)
    got = {r.request_id: (r.n_matches, r.best_similarity) for r in match.match_stats(request_df, item_df, shipped).collect()}
    pairs = pd.DataFrame(brute_pairs(items, requests), columns=["r", "i", "s"]).groupby("r").s
    assert {k: v[0] for k, v in got.items()} == pairs.count().to_dict()
    assert all(got[k][1] == pytest.approx(v) for k, v in pairs.max().items())


def test_top_k_without_requests(spark):
    _, _, item_df, request_df = items_and_requests(spark)
    assert match.top_k(request_df.limit(0), item_df, 5).count() == 0


def test_missing_values_and_vectors(spark):
    items = spark.createDataFrame(
        [(1, None, None, None, [1.0, 0.0]), (2, 5, 10.0, "Tax", None), (3, 5, 10.0, "Tax", [1.0, 1.0])],
        "item_id bigint, experience int, price double, domain string, embedding array<float>")
    requests = spark.createDataFrame(
        [(1, None, None, None, None, [1.0, 0.0]), (2, 1.0, None, None, None, [1.0, 0.0]), (3, None, None, None, "tax", None)],
        "request_id bigint, above double, below double, budget double, domain string, embedding array<float>")
    got = sorted((r.request_id, r["rank"], r.item_id, round(r.similarity, 3)) for r in match.top_k(requests, items, 5).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 3, 0.707), (1, 3, 2, 0.0), (2, 1, 3, 0.707), (2, 2, 2, 0.0), (3, 1, 2, 0.0), (3, 2, 3, 0.0)]


def test_top_k_limits_groups_before_the_shuffle(spark):
    _, _, item_df, request_df = items_and_requests(spark)
    plan = match.top_k(request_df, item_df, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_task_code_travels_by_value(tmp_path):
    (tmp_path / "code").write_bytes(cloudpickle.dumps((match._TopK, text_similarity._Best)))
    run = "import pickle, sys; print(pickle.load(open('code', 'rb'))[0].schema, 'rankloom' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [*match._TopK.schema.split(), "False"]


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(cosine("a", "b")).first()[0] == 0.0


def test_mean_pool_and_encoder(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, v array<float>")
    assert {r.k: r.m for r in mean_pool(df, ["k"], "v", "m").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}

    @F.pandas_udf("array<float>")
    def encoder(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t))])

    assert with_vectors(spark.createDataFrame([("abc",)], "t string"), "t", encoder).first().embedding == [3.0]


def texts(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["the"] * int(rng.integers(0, 4)) + rng.choice(words, rng.integers(1, 30)).tolist())) for i in range(120)]
    queries = [(i, " ".join(rng.choice(words, 5).tolist()) + " the unseen") for i in range(23)]
    return docs, queries, spark.createDataFrame(docs, "d bigint, text string"), spark.createDataFrame(queries, "q bigint, text string")


@pytest.mark.parametrize("shipped", [2_000_000, 30])
def test_similar_texts(spark, shipped):
    docs, queries, doc_df, query_df = texts(spark)
    got = sorted((r.q, r["rank"], r.d) for r in text_similarity.similar_texts(query_df, "q", doc_df, "d", 4, max_shipped=shipped).collect())
    counts = [{t: d.split().count(t) for t in set(d.split())} for _, d in docs]
    df = {t: sum(t in c for c in counts) for t in set().union(*counts)}
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vec(c):
        return {t: n * idf[t] for t, n in c.items() if t in idf}

    def size(v):
        return math.sqrt(sum(x * x for x in v.values()))

    vecs, want = [vec(c) for c in counts], []
    for q, text in queries:
        qv = vec({t: text.split().count(t) for t in set(text.split())})
        sims = [(-round(sum(w * v.get(t, 0) for t, w in qv.items()) / (size(qv) * size(v)), 9), d) for d, v in enumerate(vecs)]
        want += [(q, n + 1, d) for n, (s, d) in enumerate(sorted(x for x in sims if x[0] < 0)[:4])]
    assert got == sorted(want)


def test_running_best_is_the_same_when_settled_often(monkeypatch):
    monkeypatch.setattr(text_similarity, "HELD_SCORES", 1)
    rng = np.random.default_rng(12)
    block = text_similarity._QueryBlock(pd.DataFrame({"q": [5, 5, 9], "term": ["a", "b", "b"], "weight": [1.0, 2.0, 1.0]}))
    docs = pd.DataFrame({
        "d": np.arange(50), "norm": 3.0, "terms": [np.array(["b", "x", "a"], dtype=object)] * 50, "w": [rng.random(3) for _ in range(50)],
    })
    often = text_similarity._Best(block, 3)
    often.add(docs, "d")
    monkeypatch.setattr(text_similarity, "HELD_SCORES", 10**6)
    once = text_similarity._Best(block, 3)
    once.add(docs, "d")
    assert often.rows("q", "d").equals(once.rows("q", "d")) and len(once.rows("q", "d")) == 6


def test_weights_join_beyond_the_broadcast_bound(spark):
    _, _, doc_df, _ = texts(spark)
    counts, weights = text_similarity.term_counts(doc_df, "d", "text"), text_similarity.term_weights(doc_df, "text")
    small = sorted(map(tuple, text_similarity.weigh(counts, weights).select("d", "term", "tf", "idf").collect()))
    large = sorted(map(tuple, text_similarity.weigh(counts, weights, 0).select("d", "term", "tf", "idf").collect()))
    assert small == large


def test_itemsets_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(b, f"i{i}") for b in range(60) for i in rng.choice(7, rng.integers(1, 6), replace=False)]
    got = {tuple(r["items"]): r.freq for r in mining.frequent_itemsets(spark.createDataFrame(rows + rows[:20], "basket_id bigint, item string"), 0.2).collect()}
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    names = sorted({i for _, i in rows})
    want = {}
    for n in range(1, 8):
        for s in itertools.combinations(names, n):
            freq = sum(set(s) <= b for b in baskets.values())
            if freq >= 0.2 * 60:
                want[s] = freq
    assert got == want


def test_empty_baskets_count_in_the_denominator(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "basket_id bigint, item string")
    got = {tuple(r["items"]): r.support for r in mining.frequent_itemsets(df, 0.5, n_baskets=4).collect()}
    assert got == {("a",): 0.5}


def test_zscore_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [tuple(r)[2:] for r in cluster.zscores(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def inertia(pdf, cols):
    return sum(((g[cols] - g[cols].mean()) ** 2).to_numpy().sum() for _, g in pdf.groupby("cluster"))


def test_kmeans(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (0, 5, 9)])
    df = spark.createDataFrame(pts.tolist(), ["x", "y"])
    full, step = cluster.kmeans(df, ["x", "y"]).toPandas(), cluster.lloyd_rounds(df, ["x", "y"]).toPandas()
    assert set(full["cluster"]) == {0, 1, 2}
    assert inertia(full, ["x", "y"]) <= inertia(step, ["x", "y"]) + 1e-9
    assert full.groupby("cluster")["x"].mean().is_monotonic_increasing
    assert set(cluster.kmeans(df.limit(1), ["x", "y"]).toPandas()["cluster"]) == {0}
    assert cluster.kmeans(df.limit(0), ["x", "y"]).count() == 0
    for method in ("rounds", "ml"):
        curve = cluster.silhouette_curve(df, ["x", "y"], [2, 3], method).toPandas()
        assert curve["silhouette"].between(-1, 1).all() and curve["silhouette"].idxmax() == 1
        squared = cluster.silhouette_curve(df, ["x", "y"], [2, 3], method, metric="squaredEuclidean").toPandas()
        assert (squared["silhouette"] > curve["silhouette"]).all()


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_silhouette_against_brute_force(spark, chunk):
    rng = np.random.default_rng(13)
    pts = np.concatenate([rng.integers(0, 6, (40, 2)), [[50, 50]]]).astype(float)
    labels = np.r_[rng.integers(0, 3, 40), 9]
    df = spark.createDataFrame([(float(x), float(y), int(c)) for (x, y), c in zip(pts, labels)], "x double, y double, cluster int")
    dist, want = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)), []
    for i, c in enumerate(labels):
        own = (labels == c).sum()
        a = dist[i, labels == c].sum() / max(own - 1, 1)
        b = min(dist[i, labels == o].mean() for o in set(labels) - {c})
        want.append((b - a) / max(a, b) if own > 1 else 0.0)
    got = cluster.silhouette(df, ["x", "y"], pair_chunk=chunk).first()
    assert got.n == 41 and got.silhouette == pytest.approx(np.mean(want))


@pytest.mark.parametrize("chunk", [20_000, 9])
def test_curve_equals_one_silhouette_per_k(spark, chunk):
    rng = np.random.default_rng(21)
    pts = np.concatenate([rng.integers(0, 8, (60, 2)), [[90, 90]], [[90, 90]], [[-40, 3]]]).astype(float)
    df = spark.createDataFrame(pts.tolist(), ["x", "y"])
    ks = [2, 3, 5, 30]
    got = {r.k: r.silhouette for r in cluster.silhouette_curve(df, ["x", "y"], ks, pair_chunk=chunk).collect()}
    want = {k: cluster.silhouette(cluster.lloyd_rounds(df, ["x", "y"], k), ["x", "y"]).first()["silhouette"] for k in ks}
    assert got == pytest.approx(want)


def test_curve_of_odd_tables(spark):
    schema = "x double, y double"
    assert cluster.silhouette_curve(spark.createDataFrame([], schema), ["x", "y"], [2, 3]).count() == 0
    same = spark.createDataFrame([(1.0, 2.0)] * 5, schema)
    for method in ("rounds", "ml"):
        assert {tuple(r) for r in cluster.silhouette_curve(same, ["x", "y"], [2], method).collect()} == {(2, 0.0)}
    one_each = spark.createDataFrame([(0.0, 0.0), (9.0, 9.0)], schema)
    assert cluster.silhouette_curve(one_each, ["x", "y"], [2]).first()["silhouette"] == 0.0


def test_component_rounds_reach_the_components(spark):
    rng = np.random.default_rng(9)
    mat = rng.normal(0, 1, (200, 5)) * [9, 3, 0.8, 0.3, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "id int, v array<double>").repartition(6)
    got = cluster.component_rounds(df, "id", "v").toPandas().set_index("id").sort_index()
    want = cluster.principal_components(df, "id", "v").toPandas().set_index("id").sort_index()
    assert np.allclose(got[["pc1", "pc2"]], want[["pc1", "pc2"]], atol=1e-6)
    flat = spark.createDataFrame([(i, [1.0, 2.0 * i, 5.0]) for i in range(4)], "id long, v array<double>")
    rows = cluster.component_rounds(flat, "id", "v").orderBy("id").toPandas()
    assert np.allclose(rows["pc1"], [-3, -1, 1, 3]) and np.allclose(rows["pc2"], 0)
    assert cluster.component_rounds(flat.limit(0), "id", "v").count() == 0


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    mat = rng.normal(0, 1, (200, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "id int, v array<double>")
    got = cluster.principal_components(df, "id", "v").toPandas()
    assert abs(got[["pc1", "pc2"]].mean()).max() < 1e-9 and got["pc1"].var() > got["pc2"].var()
    top = np.linalg.eigvalsh(np.cov(mat.T))[::-1][:2]
    assert np.allclose([got["pc1"].var(), got["pc2"].var()], top)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 5, 10, 10)], "x double")
    assert [r.n for r in stats.histogram(df, "x", 4).orderBy("bin").collect()] == [2, 0, 1, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.n for r in stats.histogram(flat, "x", 2).orderBy("bin").collect()] == [2, 0]


def test_box_outliers(spark):
    vals = [float(v) for v in (1, 2, 3, 4, 5, 6, 7, 100, 100)]
    got = stats.box_stats(spark.createDataFrame([(v,) for v in vals], "x double"), "x").first()
    assert (got.q1, got.median, got.q3, got.whisker_low, got.whisker_high, got.n_outliers) == (3, 5, 7, 1, 7, 2)
    rough = stats.approx_box_stats(spark.createDataFrame([(v,) for v in vals], "x double"), "x").first()
    assert rough["median"] == 5


def test_fitness_uses_the_whole_catalog_and_budget(spark):
    cat = spark.createDataFrame([(0, 0, 0, 0.0, 10.0), (1, 10, 10, 10.0, 20.0)], "item_id bigint, experience int, settlements bigint, satisfaction double, price double")
    got = {r.item_id: r.fitness for r in score.weighted_fitness(cat, cat, 15).collect()}
    assert got[0] == pytest.approx(0.2 * (1 - 5 / 15), abs=1e-5) and got[1] == pytest.approx(0.8, abs=1e-5)


def test_repeat_to(spark):
    df = spark.range(3).withColumnRenamed("id", "item_id")
    got = sorted((r.copy, r.item_id) for r in score.repeat_to(df, 7, "item_id").collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    assert score.repeat_to(df, 2, "item_id").count() == 2


# --- streams ---------------------------------------------------------------------------------


def event(i, minute, kind="click", user=1):
    return (i, datetime(2024, 1, 1) + timedelta(minutes=minute), user, kind, 1.0, "{}")


def test_event_stream_drops_duplicates_and_late_rows(spark, tmp_path):
    src = f"{tmp_path}/in"
    batches = [
        [event(1, 0), event(2, 10), event(2, 10)],
        [event(3, 600), event(1, 5)],  # repeated id within the watermark
        [event(6, 601)],  # the watermark reaches late-row checks one batch on
        [event(4, 20)],  # ten hours late
        [event(5, 590, "view")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(f"{src}/b={n}")
        for f in (tmp_path / "in" / f"b={n}").glob("*.parquet"):

            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = jobs.stream_files(spark, f"{src}/*", jobs.EVENTS, files_per_batch=1)
    got = jobs.run_event_counts(stream, f"{tmp_path}/out", f"{tmp_path}/state", window="1 hour", late="1 hour")
    hours = {(int(r.window_start.timestamp() // 3600) % 24, r.event_type): r.n_events for r in got.collect()}
    assert hours == {(0, "click"): 2, (10, "click"): 2, (9, "view"): 1}


def test_page_stream_reads_new_files_once(spark, sf, tmp_path):
    from rankloom.plans.profiles import LIST_LAYOUT
    from rankloom.sources.profiles import extract_listings

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    src, out, state = (f"{tmp_path}/{n}" for n in ("pages", "out", "state"))

    def run():
        jobs.ingest_listings(jobs.stream_files(spark, src, jobs.PAGES, 1), out, state, **LIST_LAYOUT).awaitTermination()
        return spark.read.parquet(out)

    pages.where("page_id < 20").repartition(3).write.parquet(src)
    assert run().count() == extract_listings(pages.where("page_id < 20"), **LIST_LAYOUT).count()
    pages.where("page_id >= 20").write.mode("append").parquet(src)
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, extract_listings(pages, **LIST_LAYOUT).collect()))


def test_event_log_over_runs(spark, tmp_path):
    files, root = f"{tmp_path}/files", f"{tmp_path}/log"

    def run(rows):
        if rows is not None:
            spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(files)
        jobs.run_event_log(spark, files, root, window="1 hour", late="1 hour")
        kept = {(r.window_start.strftime("%d-%H"), r.user_id, r.event_type): r.n_events for r in jobs.event_snapshot(spark, root).collect()}
        return kept, {r.event_id for r in jobs.late_events(spark, root).collect()}

    spark.createDataFrame([], jobs.EVENTS).write.parquet(files)
    assert run(None) == ({}, set())
    # No row is late in the first batch, however old; a repeated id counts once.
    assert run([event(1, 10), event(2, 200), event(2, 200), event(3, 190, "view")]) == (
        {("01-00", 1, "click"): 1, ("01-03", 1, "click"): 1, ("01-03", 1, "view"): 1}, set())
    # Newest so far is minute 200: minute 140 is an hour older and late, 141 is not; an open window goes on; no time, no window.
    second = [event(4, 140), event(5, 141), event(6, 201), event(2, 200), (7, None, 1, "click", 1.0, "{}")]
    want = {("01-00", 1, "click"): 1, ("01-02", 1, "click"): 1, ("01-03", 1, "click"): 2, ("01-03", 1, "view"): 1}
    assert run(second) == (want, {4, 7})
    snapshots = spark.read.parquet(f"{root}/current")
    before = snapshots.count()
    assert run(None) == (want, {4, 7}) and len(jobs.event_snapshot(spark, root).inputFiles()) >= 1
    # A run with late rows alone leaves the counts; the mark does not go back.
    assert run([event(8, 0), event(9, 139)]) == (want, {4, 7, 8, 9})
    assert run([event(10, 900)])[0] == want | {("01-15", 1, "click"): 1}
    assert spark.read.parquet(f"{root}/current").count() > before
    path = spark.read.parquet(f"{root}/current").orderBy("upto", ascending=False).first().path
    assert all(path in name for name in jobs.event_snapshot(spark, root).inputFiles())


def test_event_log_repeats_a_broken_run(spark, tmp_path, monkeypatch):
    files, root = f"{tmp_path}/files", f"{tmp_path}/log"
    spark.createDataFrame([event(i, i) for i in range(30)], jobs.EVENTS).coalesce(1).write.parquet(files)

    def broken(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "_fold", broken)
        with pytest.raises(RuntimeError):
            jobs.run_event_log(spark, files, root)
    assert jobs.event_snapshot(spark, root).count() == 0
    spark.createDataFrame([event(i, i) for i in range(30, 40)], jobs.EVENTS).coalesce(1).write.mode("append").parquet(files)
    for _ in range(2):
        jobs.run_event_log(spark, files, root)
        assert jobs.event_snapshot(spark, root).agg({"n_events": "sum"}).first()[0] == 40
