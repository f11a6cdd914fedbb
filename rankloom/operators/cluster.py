"""Scaling, k-means, silhouette and principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

#: Most distinct rows one task compares against another chunk of the same size.
PAIR_CHUNK = 20_000


def zscores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``z_<col>``: centred, divided by the population deviation (by 1 where that is 0)."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).alias("s")).scalar()
    return df.withColumns({
        f"z_{c}": (F.col(c) - stats[f"m_{c}"]) / F.when(stats[f"s_{c}"] == 0, F.lit(1.0)).otherwise(stats[f"s_{c}"])
        for c in cols
    })


def _nearest(cols: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre; the lower index wins a tie."""
    def squared(centre: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(cols, centre)])

    near = F.array_min(F.array(*[F.struct(F.round(squared(m), 9).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centres)]))
    return near["i"]


def _counted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct feature rows with their count; all fitting below works on these, by weight."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n"))


def lloyd_rounds(df: DataFrame, cols: Sequence[str], k: int = 3, rounds: int = 3) -> DataFrame:
    """k-means from fixed seeds on the diagonal of the value range, with a set number of rounds.

    Each round is one aggregate; only the ``k`` centres pass through the driver. Clusters are numbered
    by centre order.
    """
    rows = _counted(df, cols).persist()
    try:
        centres = _lloyd_centres(rows, cols, k, rounds)
    finally:
        rows.unpersist()
    return df.withColumn("cluster", _nearest(cols, sorted(centres)) if centres else F.lit(0))


def _lloyd_centres(counted: DataFrame, cols: Sequence[str], k: int, rounds: int) -> list[list[float]]:
    lim = counted.agg(*[f(c).cast("double") for c in cols for f in (F.min, F.max)]).first()
    if lim[0] is None:
        return []
    spans = [(lim[2 * i], lim[2 * i + 1]) for i in range(len(cols))]
    centres = [[lo + (j + 0.5) / k * (hi - lo) for lo, hi in spans] for j in range(k)]
    for _ in range(rounds):
        near = counted.groupBy(_nearest(cols, centres).alias("c"))
        means = near.agg(*[F.sum(F.col(c) * F.col("_n")) / F.sum("_n") for c in cols]).collect()
        moved = {r["c"]: [float(v) for v in r[1:]] for r in means}
        centres = [moved.get(j, old) for j, old in enumerate(centres)]
    return centres


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Add ``cluster``: Spark ML k-means with at most ``k`` clusters, numbered by centre order."""
    n = min(k, len(df.select(*cols).limit(k).take(k)))
    if n <= 1:
        return df.withColumn("cluster", F.lit(0))
    pack = VectorAssembler(inputCols=list(cols), outputCol="_x")
    model = KMeans(featuresCol="_x", predictionCol="_p", weightCol="_n", k=n, seed=seed).fit(pack.transform(_counted(df, cols)))
    centres = [tuple(map(float, c)) for c in model.clusterCenters()]
    place = {old: new for new, old in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    renumber = F.array(*[F.lit(place[i]) for i in range(len(centres))])
    return model.transform(pack.transform(df)).withColumn("cluster", F.get(renumber, F.col("_p"))).drop("_x", "_p")


def silhouette(df: DataFrame, cols: Sequence[str], label: str = "cluster", pair_chunk: int = PAIR_CHUNK) -> DataFrame:
    """Mean Euclidean silhouette of labelled rows, one row with ``n`` and ``silhouette``.

    Distinct rows are cut into chunks, and a task sums the distances from one chunk to another per cluster,
    so no pair leaves a task. The work grows with the square of the distinct feature rows.
    """
    rows = df.groupBy(F.col(label).cast("bigint").alias("c"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = cut_lineage(rows.agg(F.count(F.lit(1)).cast("double").alias("n")))
    return _silhouette(rows, len(cols), -(-rows.count() // pair_chunk) or 1)


def _silhouette(rows: DataFrame, dims: int, chunks: int) -> DataFrame:
    """The same for distinct rows ``c, x0.., n`` in a given number of chunks."""
    names = [f"x{i}" for i in range(dims)]
    mine = F.pmod(F.xxhash64("c", *names), F.lit(chunks)).cast("int")
    tagged = rows.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    here = tagged.withColumn("_from", F.lit(True))
    there = tagged.select("c", *names, "n", F.col("_j").alias("_i"), F.col("_i").alias("_j"), F.lit(False).alias("_from"))

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_from"]], pdf[~pdf["_from"]]
        own, out = left[names].to_numpy(), []
        for c, part in right.groupby("c"):
            other, weight, total = part[names].to_numpy(), part["n"].to_numpy(), np.zeros(len(own))
            for at in range(0, len(own), 512):
                for lo in range(0, len(other), 4096):
                    gap = own[at:at + 512, None, :] - other[None, lo:lo + 4096, :]
                    total[at:at + 512] += np.sqrt((gap * gap).sum(-1)) @ weight[lo:lo + 4096]
            out.append(left[["c", *names, "n"]].assign(to=c, total=total, weight=weight.sum()))
        return pd.concat(out) if out else left[["c", *names, "n"]].assign(to=0, total=0.0, weight=0.0)

    doubles = ", ".join(f"{x} double" for x in names)
    sums = here.unionByName(there).groupBy("_i", "_j").applyInPandas(
        distances, f"c bigint, {doubles}, n double, to bigint, total double, weight double"
    ).groupBy("c", *names, "n", "to").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    inside, own = F.col("to") == F.col("c"), F.col("own_weight") - 1
    points = sums.groupBy("c", *names, "n").agg(
        F.max(F.when(inside, F.col("total"))).alias("own_total"), F.max(F.when(inside, F.col("weight"))).alias("own_weight"),
        F.min(F.when(~inside, F.col("total") / F.col("weight"))).alias("b"),
    )
    near = F.when(own > 0, F.col("own_total") / own)
    value = F.when(own > 0, F.coalesce(F.try_divide(F.col("b") - near, F.greatest(near, F.col("b"))), F.lit(0.0))).otherwise(0.0)
    return points.agg(F.sum("n").cast("bigint").alias("n"), (F.sum(value * F.col("n")) / F.sum("n")).alias("silhouette"))


def silhouette_curve(df: DataFrame, cols: Sequence[str], ks: Sequence[int], method: str = "rounds", rounds: int = 3, seed: int = 42,
                     metric: str = "euclidean", pair_chunk: int = PAIR_CHUNK) -> DataFrame:
    """Mean silhouette of k-means for every k: (k, silhouette).

    ``rounds`` moves the centres of all k together, from seeds on the diagonal, one pass per round; ``ml`` fits Spark ML's
    k-means per k. Either way a distinct row carries its cluster for every k, and one pass over pairs of chunks sums the
    distances to the clusters of all of them: a distance is computed once, whatever the number of k. That work grows with the
    square of the distinct rows; with the metric ``squaredEuclidean`` it is linear. One cluster alone has silhouette 0, as has a cluster's only row; without rows there is no curve.
    """
    names, ks = [f"x{i}" for i in range(len(cols))], [int(k) for k in ks]
    rows = cut_lineage(_counted(df, cols).select(*[F.col(c).cast("double").alias(x) for c, x in zip(cols, names)], F.col("_n").alias("n")))
    size = rows.count()
    if not size or not ks:
        return df.sparkSession.createDataFrame([], "k bigint, silhouette double")
    # Distinct rows are often few; many near-empty tasks per round would cost more than the rounds.
    rows = rows.coalesce(-(-size // pair_chunk))
    labels = _round_labels(rows, names, ks, rounds) if method == "rounds" else _ml_labels(rows, names, ks, seed, size)
    rows = cut_lineage(labels)
    if metric == "euclidean":
        return _silhouettes(rows, names, ks, -(-size // pair_chunk))
    judge = ClusteringEvaluator(featuresCol="_x", predictionCol="_p", weightCol="n", distanceMeasure=metric)
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    held = {k: data.withColumn("_p", F.col("labels")[i].cast("double")) for i, k in enumerate(ks)}
    found = [(k, float(judge.evaluate(marked)) if marked.select("_p").distinct().count() > 1 else 0.0) for k, marked in held.items()]
    return df.sparkSession.createDataFrame(found, "k bigint, silhouette double")


def _round_labels(rows: DataFrame, names: Sequence[str], ks: Sequence[int], rounds: int) -> DataFrame:
    """Add ``labels``, the cluster for every k. In a round a task adds up its rows per cluster of every k and hands on one row
    for each; only these sums over all tasks pass through the driver."""
    dims = len(names)
    lim = rows.agg(*[f(x) for x in names for f in (F.min, F.max)]).first()
    lo, hi = np.array(lim[0::2]), np.array(lim[1::2])
    centres = {k: lo + (np.arange(k)[:, None] + 0.5) / k * (hi - lo) for k in ks}
    slots, total = [(k, c) for k in centres for c in range(k)], [f"s{i}" for i in range(dims + 1)]

    def nearest(points: np.ndarray) -> dict[int, np.ndarray]:
        return {k: np.round(((points[:, None] - at[None]) ** 2).sum(-1), 9).argmin(1) for k, at in centres.items()}

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((k, dims + 1)) for k in centres}
        for batch in batches:
            points, n = batch[list(names)].to_numpy(), batch["n"].to_numpy()
            for k, near in nearest(points).items():
                np.add.at(sums[k], near, np.c_[points * n[:, None], n])
        yield pd.DataFrame(slots, columns=["k", "c"]).join(pd.DataFrame(np.concatenate(list(sums.values())), columns=total))

    doubles = ", ".join(f"{x} double" for x in total)
    for _ in range(rounds):
        moved = rows.mapInPandas(shares, f"k int, c int, {doubles}").groupBy("k", "c").agg(*[F.sum(x) for x in total]).collect()
        held = [(r[0], r[1], np.array(r[2:])) for r in moved if r[-1] > 0]
        centres = {k: at.copy() for k, at in centres.items()}
        for k, c, sums in held:
            centres[k][c] = sums[:-1] / sums[-1]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = nearest(batch[list(names)].to_numpy())
            yield batch.assign(labels=list(np.stack([near[k] for k in ks], 1)))

    return rows.mapInPandas(label, ", ".join([*[f"{x} double" for x in names], "n double", "labels array<int>"]))


def _ml_labels(rows: DataFrame, names: Sequence[str], ks: Sequence[int], seed: int, size: int) -> DataFrame:
    if size == 1:  # Spark's k-means needs two distinct rows
        return rows.withColumn("labels", F.array(*[F.lit(0)] * len(ks)))
    data = VectorAssembler(inputCols=list(names), outputCol="_x").transform(rows).persist()
    try:
        models = [KMeans(featuresCol="_x", predictionCol=f"_p{k}", weightCol="n", k=min(k, size), seed=seed, maxIter=10).fit(data) for k in ks]
    finally:
        data.unpersist()
    marked = reduce(lambda marked, model: model.transform(marked), models, data)
    return marked.select(*names, "n", F.array(*[F.col(f"_p{k}").cast("int") for k in ks]).alias("labels"))


def _silhouettes(rows: DataFrame, names: Sequence[str], ks: Sequence[int], chunks: int) -> DataFrame:
    """(k, silhouette) of distinct rows ``names, n, labels`` with one label per k, in a given number of chunks."""
    begin = np.r_[0, np.cumsum(ks)].tolist()  # cluster c of the i-th k has slot begin[i] + c
    held = rows.select("n", F.posexplode("labels").alias("i", "c")).groupBy("i", "c").agg(F.sum("n")).collect()
    weight = {begin[i] + c: float(n) for i, c, n in held}
    mine = F.pmod(F.xxhash64(*names), F.lit(chunks)).cast("int")
    tagged = rows.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    here = tagged.withColumn("_from", F.lit(True))
    there = tagged.withColumns({"_i": F.col("_j"), "_j": F.col("_i"), "_from": F.lit(False)})

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_from"]], pdf[~pdf["_from"]]
        if left.empty or right.empty:
            return left[[*names, "n", "labels"]].assign(totals=[np.zeros(begin[-1])] * len(left))
        own, other, totals = left[list(names)].to_numpy(), right[list(names)].to_numpy(), np.zeros((len(left), begin[-1]))
        slots = np.stack(right["labels"].to_list()) + begin[:-1]
        for lo in range(0, len(other), 4096):
            part = slots[lo:lo + 4096]
            member = np.zeros((len(part), begin[-1]))
            np.put_along_axis(member, part, right["n"].to_numpy()[lo:lo + 4096, None], 1)
            for at in range(0, len(own), 512):
                gap = own[at:at + 512, None, :] - other[None, lo:lo + 4096, :]
                totals[at:at + 512] += np.sqrt((gap * gap).sum(-1)) @ member
        return left[[*names, "n", "labels"]].assign(totals=list(totals))

    doubles = ", ".join(f"{x} double" for x in names)
    parts = here.unionByName(there).groupBy("_i", "_j").applyInPandas(distances, f"{doubles}, n double, labels array<int>, totals array<double>")
    # Distinct rows are keyed by their features; labels go with them.
    sums = parts.groupBy(*names).agg(F.first("n").alias("n"), F.first("labels").alias("labels"),
                                     *[F.sum(F.get("totals", F.lit(s))).alias(f"t{s}") for s in sorted(weight)])
    curve = []
    for i, k in enumerate(ks):
        own, slots = F.get("labels", F.lit(i)), [s for s in sorted(weight) if begin[i] <= s < begin[i + 1]]
        at = lambda values: F.array_max(F.array(*[F.when(own == s - begin[i], v) for s, v in zip(slots, values)]))  # noqa: E731, B023
        others = at([F.lit(weight[s]) for s in slots]) - 1
        near = F.when(others > 0, at([F.col(f"t{s}") for s in slots]) / others)
        far = F.array_min(F.array(*[F.when(own != s - begin[i], F.col(f"t{s}") / F.lit(weight[s])) for s in slots]))
        value = F.coalesce(F.try_divide(far - near, F.greatest(near, far)), F.lit(0.0))
        curve.append(F.struct(F.lit(k).cast("bigint").alias("k"), (F.sum(value * F.col("n")) / F.sum("n")).alias("silhouette")))
    return sums.agg(F.array(*curve).alias("curve")).select(F.inline("curve"))


def combined_curve(counts: DataFrame, curve: DataFrame) -> DataFrame:
    """Zip itemset counts and silhouettes by position and add their shares of the maximum."""
    top = counts.agg(F.max("n_itemsets")).scalar()
    best = curve.agg(F.max("silhouette")).scalar()
    return counts.join(curve, "position").select(
        "position", (F.col("n_itemsets") / top + F.col("silhouette") / best).alias("combined")
    )


def principal_components(df: DataFrame, id_col: str, vector: str, k: int = 2) -> DataFrame:
    """First ``k`` components of the centred vectors; signs fixed by the largest loading."""
    dims = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("means")).scalar()
    centred = df.withColumn("_m", means).select(
        id_col, array_to_vector(F.zip_with(vector, "_m", lambda x, m: x.cast("double") - m)).alias("_x")
    )
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(centred)
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    y = vector_to_array("_y")
    return model.transform(centred).select(id_col, *[(y[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])


def component_rounds(df: DataFrame, id_col: str, vector: str, k: int = 2, rounds: int = 20) -> DataFrame:
    """(id, pc1..pck): centred vectors on their first ``k`` components after a set number of orthogonal iterations.

    A round multiplies the directions by the scatter matrix without forming it: a task adds up its rows' shares and hands on
    one row, and ``width x k`` sums pass through the driver, which makes them orthonormal. So width is not bound by a square
    matrix. Direction j starts at sin(j), sin(2j), ..., which constant positions do not make orthogonal to the rows. Signs are fixed by the largest loading. A direction
    without variance left gives 0. Vectors have one width and no missing values.
    """
    flat = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = np.array([r.m for r in flat.orderBy("pos").collect()])
    rows = cut_lineage(df.select(id_col, F.col(vector).cast("array<double>").alias("_x")))
    at = _orthonormal(np.sin(np.outer(np.arange(1, len(mean) + 1), np.arange(1, k + 1))))
    for _ in range(rounds if len(mean) else 0):
        at = _orthonormal(_scatter(rows, mean, at))
    load = at * np.where(at[np.abs(at).argmax(0), np.arange(k)] < 0, -1.0, 1.0) if len(mean) else at

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (np.stack(batch["_x"].to_list()) - mean) @ load if len(batch) else np.zeros((0, k))
            yield batch[[id_col]].assign(**{f"pc{j + 1}": found[:, j] for j in range(k)})

    kept = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"
    return rows.mapInPandas(project, ", ".join([kept, *[f"pc{j + 1} double" for j in range(k)]]))


def _scatter(rows: DataFrame, mean: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The scatter matrix of the centred rows times the directions ``at``."""
    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(at.shape)
        for batch in batches:
            if len(batch):
                centred = np.stack(batch["_x"].to_list()) - mean
                total += centred.T @ (centred @ at)
        yield pd.DataFrame({"share": [total.ravel()]})

    sums = rows.select("_x").mapInPandas(shares, "share array<double>").select(F.posexplode("share").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    out = np.zeros(at.size)
    for pos, v in sums.collect():
        out[pos] = v
    return out.reshape(at.shape)


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    """Each column less its parts along the ones before, at length 1; zero where nothing is left."""
    out = np.zeros(columns.shape)
    for j in range(columns.shape[1]):
        left = columns[:, j].copy()
        for before in range(j):
            left -= (left @ out[:, before]) * out[:, before]
        length = np.sqrt(left @ left)
        out[:, j] = left / length if length > 0 else 0.0
    return out
