"""Toxicity by class-conditional Kneser-Ney models of toxic and of ordinary text.

Texts are read as UTF-8 bytes in lower case, every run of ASCII characters that are neither letters nor
digits as one blank. From a bounded sample of labelled rows, ``per_class`` documents of each class chosen by
a hash of the id, equal texts once, the documents with each window of ``order`` bytes are counted in Spark
(documents, not occurrences, so that no long text speaks for its class). Each class has an interpolated model with
absolute discount ``D``: ``P(b|c) = max(n(c,b) - D, 0) / n(c) + D * t(c) / n(c) * S(b|c')``, where ``t`` counts distinct
continuations. ``S``, shared by the classes, is the Kneser-Ney chain of all shorter windows over the counts of
both classes together (numbers of distinct bytes in front), so an expression too rare to be known is no
evidence for either class. A text's figure is the sum over its bytes of ``log P_toxic - log P_ordinary`` over the
root of its length, by which the sum of many small chance differences grows. A
logistic curve, fitted on the third of the sample that was not counted and weighed to the classes' shares
among all labels, turns it into a score from 0 to 1.

The models hold at most what ``2 * per_class`` documents contain and are sent to the tasks as one broadcast
variable. Scoring is one narrow pass over whole texts, so no key can be hot.

Defined cases: null and empty texts have figure 0; null labels are not learned from, labels without document
neither; without examples of both classes every text scores the share of label 1; equal texts get equal
scores; a table without rows gives none. Input columns are kept, the added ones replace those of equal name.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm.common import giving_back, map_batches

#: Close to 1, so that a window of one document alone counts for little.
DISCOUNT = 0.95
#: Bytes of a window: the predicted one and those before it.
ORDER = 4
_U = np.uint64
#: Lower case for A-Z, one blank for everything in ASCII that is neither letter nor digit.
_FOLD = np.array([ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FOLD[128:] = np.arange(128, 256)


def windows(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``order`` bytes as numbers, one for each byte of the folded texts, and the texts' bounds."""
    raw, bounds = A.utf8(column)
    data = _FOLD[raw]
    # Latin capitals beyond ASCII: 0xC3 0x80..0x9E, the multiplication sign aside.
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    data[capital] += 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    sizes = np.diff(kept_before[bounds])
    first = np.concatenate([[0], np.cumsum(sizes)])
    # Every text begins after order - 1 blanks.
    at = np.arange(first[-1]) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    line = np.full(first[-1] + len(sizes) * (order - 1), 32, np.uint8)
    line[at] = data[keep]
    found = np.zeros(len(at), np.uint64)
    for k in range(order):
        found = (found << _U(8)) | line[at - (order - 1 - k)]
    return found, first


def _counts():
    def step(batch):
        for part in A.slices(batch, "text"):
            found, first = windows(part.column("text"))
            of_text = np.repeat(np.arange(part.num_rows), np.diff(first))
            order = np.lexsort((of_text, found))
            found, of_text = found[order], of_text[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (of_text[1:] != of_text[:-1])
            label = np.asarray(part.column("label"))[of_text]
            for value in (0, 1):
                keys, n = np.unique(found[new & (label == value)], return_counts=True)
                yield {"label": np.full(len(n), value, np.int32), "key": keys.view(np.int64), "n": n}

    return step


def choose(labels: DataFrame, learn_from: Column, per_class: int, id_col: str, label_col: str, counts: dict[int, int]) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the smallest hashes of the id: (id, label, place).

    With the classes' ``counts`` of ids only hashes that can be among the smallest are ordered, so no class fills a task.
    """
    pool = labels.where(learn_from & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    share = F.lit(1.0)
    for label, n in counts.items():
        # A quarter more than wanted, and some for small numbers; ids in this share of the hashes are far above per_class.
        share = F.when(F.col("label") == label, min(1.0, (1.25 * per_class + 100) / max(n, 1))).otherwise(share)
    near = pool.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).where(F.col("at") <= share)
    order = Window.partitionBy("label").orderBy("at", "id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).select("id", "label", "place")


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their values, and the number of their rows."""
    found, index, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, np.bincount(index, values, len(found)), n


def build(label: np.ndarray, keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> dict[str, Any]:
    """From counted windows: the log ratio of every known window, and of every known context for an unknown byte."""
    every = np.unique(keys)
    # The shared chain, from single bytes up: each window of k bytes counts by its distinct bytes in front.
    longer = every
    suffixes = []
    for k in range(order - 1, 0, -1):
        suffix = longer & _U((1 << 8 * k) - 1)
        longer, fronts = np.unique(suffix, return_counts=True)
        suffixes.append((longer, fronts.astype(float)))
    lower_keys, lower = np.zeros(1, np.uint64), np.full(1, 1 / 257.0)
    for k, (found, fronts) in zip(range(1, order), reversed(suffixes), strict=True):
        context = found >> _U(8)
        _, index = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(index, fronts)[index], np.bincount(index)[index]
        below = lower[np.searchsorted(lower_keys, found & _U((1 << 8 * (k - 1)) - 1))] if k > 1 else lower[0]
        lower_keys, lower = found, np.maximum(fronts - DISCOUNT, 0) / total + DISCOUNT * kinds / total * below
    shared = lower[np.searchsorted(lower_keys, every & _U((1 << 8 * (order - 1)) - 1))]
    contexts, of_context = np.unique(every >> _U(8), return_inverse=True)
    logs, rest = [], []
    for c in (0, 1):
        mine = label == c
        seen, counted, _ = _sums(keys[mine], n[mine])
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, seen)] = counted
        total = np.bincount(of_context, counts)
        kinds = np.bincount(of_context, counts > 0)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[of_context] + back[of_context] * shared))
        rest.append(np.log(back))
    return {"window": _Table(every, logs[1] - logs[0]), "context": _Table(contexts, rest[1] - rest[0])}


class _Table:
    """Values by key: a slot per hash where only one key has it, the sorted keys where more do."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, np.append(values, 0.0)
        self.shift = _U(64 - max(10, min(23, len(keys).bit_length() + 2)))
        slot = self._slot(keys)
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[slot] = np.arange(len(keys))
        self.slots[np.bincount(slot, minlength=len(self.slots)) > 1] = -2

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 without one, and which keys are known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = self.slots[self._slot(keys)]
        shared = np.flatnonzero(at == -2)
        at[shared] = np.minimum(np.searchsorted(self.keys, keys[shared]), len(self.keys) - 1)
        known = (at >= 0) & (self.keys[at] == keys)
        return np.where(known, self.values[at], 0.0), known


def figures(model: dict[str, Any], column: pa.Array) -> np.ndarray:
    """Difference of each text's two log-likelihoods over the root of its length."""
    found, first = windows(column)
    out = np.zeros(len(first) - 1)
    if not len(found):
        return out
    value, known = model["window"].find(found)
    unknown = np.flatnonzero(~known)
    value[unknown] = model["context"].find(found[unknown] >> _U(8))[0]
    sizes = np.diff(first)
    out[sizes > 0] = np.add.reduceat(value, first[:-1][sizes > 0]) / np.sqrt(sizes[sizes > 0])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a little shrinkage."""
    scale = float(np.abs(x).max()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta * np.array([1, 0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    return float(beta[0] / scale), float(beta[1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 2400,
) -> dict[str, Any]:
    """Both models and the curve. ``learn_from``: which rows of ``labels`` may be used (all if None).

    Each class gives ``per_class`` documents at most; about a third of them, by a hash, is kept for the curve.
    """
    learn_from = F.lit(True) if learn_from is None else learn_from
    pool = labels.where(learn_from & F.col(label_col).isin(0, 1))
    shares = {r[0]: r[1] for r in pool.groupBy(F.col(label_col).cast("int")).agg(F.countDistinct(id_col)).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    model: dict[str, Any] = {"slope": 0.0, "offset": math.log(prior / (1 - prior))}
    if len(shares) < 2:
        return model
    chosen = choose(labels, learn_from, per_class, id_col, label_col, shares)
    # At most 2 * per_class rows of three numbers.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["label", "text"])
    for_curve = F.abs(F.xxhash64("text") % 3) == 0
    counted = (
        map_batches(sample.where(~for_curve).select("label", "text"), _counts, "label int, key long, n long")
        .groupBy("label", "key").agg(F.sum("n").alias("n")).toArrow()
    )
    label, key, n = (counted[c].to_numpy() for c in ("label", "key", "n"))
    if len(np.unique(label)) < 2:
        return model
    model |= build(label, key.view(np.uint64), n.astype(float))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure():
        def step(batch):
            for part in A.slices(batch, "text"):
                yield {"label": part.column("label"), "x": figures(sent.value, part.column("text"))}

        return step

    rows = map_batches(sample.where(for_curve).select("label", "text"), measure, "label int, x double").toArrow()
    y, x = (rows[c].to_numpy().astype(float) for c in ("label", "x"))
    if len(np.unique(y)) < 2:
        return model
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y)
    model["slope"], model["offset"] = logistic(x, y, weight)
    return model


def with_toxicity(docs: DataFrame, model: dict[str, Any], text_col: str = "text") -> DataFrame:
    """All rows with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= 0.5``)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in A.slices(batch, text_col):
                x = figures(known, part.column(text_col)) if "window" in known else np.zeros(part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(known["slope"] * x + known["offset"], -700, 700)))
                new = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *new], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(giving_back(run), schema)
