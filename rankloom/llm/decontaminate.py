"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded: lower case, every run of characters that are neither letters nor digits as one blank. A
benchmark item is searched whole if it has at most ``window`` characters, else by windows of that size. They begin
every ``quote - window + 1`` characters, so that every stretch of ``quote`` characters of the item holds a whole one:
a quote of that length is found wherever in the item it begins; shorter quotes are found only if they hold a window.
A window of ``w`` characters occurs in a document if some stretch of it is within ``k = floor(error * w)`` edits.
An item of fewer than ``q`` characters has no q-gram: it occurs where a document holds it exactly, as whole words.

By the q-gram lemma such a stretch shares at least ``w - q + 1 - k * q`` q-grams with the window, on diagonals
(document place less window place) at most ``k`` apart. The filter counts shared q-grams per window in
diagonal bands of ``2 * (k + 1)`` that overlap by half, so every range of ``k + 1`` diagonals lies inside one band, and
keeps the bands that reach the bound. Kept regions are verified by an alignment restricted to the band, free at
both ends of the document. The filter loses no window; the alignment decides.

The benchmark is folded and cut into pieces of whole windows; tasks sort the q-grams of at most ``BLOCK_POINTS``
characters of pieces into one packed index, which is broadcast (16 bytes a character) and read in place. Documents
are read once, in one narrow step; a worker holds one index at a time and, with several, runs a few texts through each
in turn. No document is shuffled, and a passage that a third of all documents hold costs only its own alignments.

Defined cases: null and empty texts match nothing; an item without letters and digits, or null, is not searched;
equal items are all reported, an item with a null id under that; rows of one item id count as one item, equal
rows once; repeated documents are judged alike; an empty table, on either side, gives no match. Input columns
are kept, whatever their names; ``matches`` replaces one of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import arrays as A
from rankloom.llm.common import arrow_schema, columns, giving_back
from rankloom.session import cut_lineage

#: Characters of benchmark text in one index, which takes 16 bytes for each and a table of at most 64 MB.
BLOCK_POINTS = 4 << 20
#: Bytes of documents that a worker runs through one index after the other, where there are several.
HELD_BYTES = 32 << 20
#: Regions that are aligned in one step.
ALIGNED = 1 << 16
_FOLD = re.compile(r"[\W_]+")
_U = np.uint64
MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("windows", T.IntegerType()), T.StructField("of_windows", T.IntegerType()), T.StructField("at", T.LongType()),
]))
_ARROW_MATCHES = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("edits", pa.int32()), ("windows", pa.int32()), ("of_windows", pa.int32()), ("at", pa.int64()),
]))
_PIECES = "item long, points binary, n long"
#: Arrays of an index, as one row of bytes and lists.
_PACKED = "keys binary, place binary, points binary, start binary, size binary, owner binary, items array<long>, totals array<long>"


def fold(text: str | None) -> np.ndarray:
    """Code points of the folded text."""
    found = _FOLD.sub(" ", (text or "").lower()).strip()
    return np.frombuffer(found.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` characters from each place on."""
    n = max(0, len(points) - q + 1)
    wide, h = points.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _U(0x9E3779B97F4A7C15) + (wide[j : j + n] + _U(1)) * _U(0xBF58476D1CE4E5B9)
    return A.mix(h)


def window_starts(n: int, window: int, step: int) -> np.ndarray:
    """Where the windows of a text of ``n`` characters begin: every ``step``, and one that ends with it."""
    last = max(0, n - window)
    return np.append(np.arange(0, last, step), last)


def pieces(points: np.ndarray, window: int, step: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Cut a folded item into parts of about ``most`` characters that hold its windows, each in one, and their number."""
    starts = window_starts(len(points), window, step)
    run = max(1, (most - window) // step + 1)
    for a in range(0, len(starts), run):
        part = starts[a : a + run]
        yield points[part[0] : part[-1] + window], len(part)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the number of the count and the place within it, for everything counted."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def pack(parts: list[tuple[int | None, np.ndarray, int]], q: int, window: int, step: int) -> dict[str, Any]:
    """The index of some pieces, given as item id, characters and the number of the item's windows in all pieces."""
    totals = {item: total for item, _, total in parts}
    items = sorted(totals, key=lambda i: (i is not None, i))
    number = {item: k for k, item in enumerate(items)}
    length = np.array([len(p) for _, p, _ in parts], np.int64)
    base = np.cumsum(length) - length
    points = np.concatenate([p for _, p, _ in parts]) if parts else np.zeros(0, np.uint32)
    starts = [window_starts(n, window, step) for n in length.tolist()]
    count = np.array([len(s) for s in starts], np.int64)
    start = np.concatenate(starts) + np.repeat(base, count) if parts else np.zeros(0, np.int64)
    size = np.minimum(np.repeat(length, count), window)
    owner = np.repeat(np.array([number[i] for i, _, _ in parts], np.int64), count)
    keys = qgrams(points, q)
    # q-grams that reach into the next piece are none.
    place = np.flatnonzero(np.arange(len(keys)) + q <= np.repeat(base + length, length)[: len(keys)])
    place = place[np.argsort(keys[place], kind="stable")]
    return {
        "keys": keys[place].tobytes(), "place": place.astype(np.uint32).tobytes(), "points": points.tobytes(),
        "start": start.astype(np.uint32).tobytes(), "size": size.astype(np.uint32).tobytes(),
        "owner": owner.astype(np.uint32).tobytes(), "items": items, "totals": [totals[i] for i in items],
    }


class Index:
    """The windows of some pieces, and where each of their q-grams stands. Reads packed arrays in place."""

    def __init__(self, packed: dict[str, Any], q: int, window: int, error: float):
        self.q, self.window, self.items, self.totals = q, window, packed["items"], packed["totals"]
        self.keys = np.frombuffer(packed["keys"], np.uint64)
        self.place, self.points, start, size, owner = (
            np.frombuffer(packed[name], np.uint32) for name in ("place", "points", "start", "size", "owner")
        )
        self.start, self.size, self.owner = start.astype(np.int64), size.astype(np.int64), owner.astype(np.int64)
        # The last place at which a window has a q-gram. Like the starts, these never fall.
        self.last = self.start + self.size - q
        # The bound stays positive: fewer edits where a window is too short for the error rate.
        self.edits = np.maximum(np.minimum((self.size * error).astype(np.int64), (self.size - q) // q), 0)
        self.bound = np.maximum(self.size - q + 1 - self.edits * q, 1)
        self.stride = int(self.edits.max(initial=0)) + 1
        bits = max(16, min(26, len(self.keys).bit_length() + 4))
        self.shift = _U(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.keys >> self.shift).astype(np.int64)] = True
        self.short = {n: np.flatnonzero(self.size == n) for n in np.unique(self.size[self.size < q]).tolist() if n}

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], q: int, window: int, error: float, quote: int | None = None) -> Index:
        """The index of a few items, whole. Without a shortest quote, windows overlap by half."""
        step = window // 2 if quote is None else quote - window + 1
        folded = [(item, fold(text)) for item, text in items]
        totals: dict[int | None, int] = {}
        for item, p in folded:
            totals[item] = totals.get(item, 0) + len(window_starts(len(p), window, step))
        return cls(pack([(item, p, totals[item]) for item, p in folded if len(p)], q, window, step), q, window, error)

    def matches(self, texts: list[str | None]) -> list[list[dict[str, int]]]:
        """For each text the items found in it: fewest edits, windows found, and where the best one begins."""
        found: list[list[dict[str, int]]] = [[] for _ in texts]
        if not len(self.owner):
            return found
        folded = [fold(t) for t in texts]
        gap = np.zeros(self.window + 4 * self.stride, np.uint32)
        line = np.concatenate([part for f in folded for part in (gap, f)] + [gap])
        begins = np.cumsum([len(gap) + len(f) for f in folded]) - [len(f) for f in folded]
        near, exact = self._near(line), self._exact(line)
        window, edits, where = (np.concatenate(x) for x in zip(near, exact, strict=True))
        document = np.maximum(np.searchsorted(begins, where, "right") - 1, 0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[tuple[int, int], set[int]] = {}
        for w, e, p, d in zip(window.tolist(), edits.tolist(), where.tolist(), document.tolist(), strict=True):
            key = (d, int(self.owner[w]))
            best[key] = min(best.get(key, (e, p)), (e, p))
            parts.setdefault(key, set()).add(w)
        for (d, item), (e, p) in sorted(best.items()):
            found[d].append({
                "item_id": self.items[item], "edits": e, "windows": len(parts[d, item]),
                "of_windows": self.totals[item], "at": max(0, p - int(begins[d])),
            })
        return found

    def _near(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows within their edits of a stretch of ``line``, those edits, and about where the stretch begins."""
        nothing = np.zeros(0, np.int64)
        if not len(self.keys):
            return nothing, nothing, nothing
        h = qgrams(line, self.q)
        hits = np.flatnonzero(self.known[(h >> self.shift).astype(np.int64)])
        # A region that reaches the lowest bound has that many hits around each of its hits.
        reach = self.window + self.stride
        around = np.searchsorted(hits, hits + reach, "right") - np.searchsorted(hits, hits - reach, "left")
        hits = hits[around >= self.bound[self.size >= self.q].min()]
        first = np.searchsorted(self.keys, h[hits])
        which, step = spread(np.searchsorted(self.keys, h[hits], "right") - first)
        place = self.place[first[which] + step].astype(np.int64)
        # The windows that hold the q-gram at that place.
        lowest = np.searchsorted(self.last, place)
        again, step = spread(np.searchsorted(self.start, place, "right") - lowest)
        window = lowest[again] + step
        diagonal = hits[which][again] - (place[again] - self.start[window])
        band = diagonal // self.stride
        bands = len(line) // self.stride + 2
        key, count = np.unique(np.concatenate([window * bands + band, window * bands + np.maximum(band - 1, 0)]), return_counts=True)
        window, band = key // bands, key % bands
        keep = count >= self.bound[window]
        window, low = window[keep], band[keep] * self.stride
        edits, where = self.align(line, window, low)
        good = edits <= self.edits[window]
        return window[good], edits[good], where[good]

    def _exact(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items without a q-gram that ``line`` holds as whole words."""
        window, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.short:
            border = (line == 0) | (line == 32)
            begins = np.flatnonzero(border[:-1] & ~border[1:]) + 1
        for n, owners in self.short.items():
            at = begins[begins + n < len(line)]
            at = at[border[at + n] & ~border[at + n - 1]]
            steps = np.arange(n)
            mine, theirs = qgrams_at(line, at, n), qgrams_at(self.points, self.start[owners], n)
            order = np.argsort(theirs, kind="stable")
            first = np.searchsorted(theirs[order], mine)
            which, step = spread(np.searchsorted(theirs[order], mine, "right") - first)
            w, p = owners[order[first[which] + step]], at[which]
            same = (line[p[:, None] + steps] == self.points[self.start[w][:, None] + steps]).all(axis=1)
            window.append(w[same])
            where.append(p[same])
        w, p = np.concatenate(window), np.concatenate(where)
        return w, np.zeros(len(w), np.int64), p

    def align(self, line: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each window along the diagonals of its band, and where that alignment about begins."""
        edits, where = np.full(len(window), 1 << 20, np.int64), low.copy()
        padded = np.concatenate([line, np.zeros(self.window + 6 * self.stride, np.uint32)])
        width = 4 * self.stride
        steps = np.arange(width)
        for size in np.unique(self.size[window]):
            whole = np.flatnonzero(self.size[window] == size)
            for group in (whole[a : a + ALIGNED] for a in range(0, len(whole), ALIGNED)):
                # Half the margin to each side: an alignment may leave the q-grams' diagonals at its ends.
                start = np.maximum(low[group] - self.stride, 0)
                text = self.points[self.start[window[group]][:, None] + np.arange(size)]
                cost = np.zeros((len(group), width), np.int64)
                for i in range(size):
                    beside = padded[start[:, None] + steps + i] != text[:, i : i + 1]
                    step = cost + beside
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(step - steps, axis=1) + steps
                edits[group] = cost.min(axis=1)
                where[group] = start + cost.argmin(axis=1)
        return edits, where


def qgrams_at(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` characters from each given place on."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * _U(0x9E3779B97F4A7C15) + points[at + j].astype(np.uint64) + _U(1)
    return A.mix(h)


def merge(found: list[dict[str, int]]) -> list[dict[str, int]]:
    """The matches of one document from several indexes, one per item: windows added, fewest edits."""
    items: dict[int | None, dict[str, int]] = {}
    for m in found:
        old = items.get(m["item_id"])
        if old is not None:
            e, p = min((old["edits"], old["at"]), (m["edits"], m["at"]))
            m = {**m, "edits": e, "at": p, "windows": old["windows"] + m["windows"]}
        items[m["item_id"]] = m
    return [items[i] for i in sorted(items, key=lambda i: (i is not None, i))]


def indexes(benchmark: DataFrame, id_col: str, text_col: str, q: int, window: int, step: int) -> DataFrame:
    """The benchmark as packed indexes, one per row, each of about ``BLOCK_POINTS`` characters at most."""
    most = BLOCK_POINTS
    part_schema, packed_schema = arrow_schema(_PIECES), arrow_schema(_PACKED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = fold(text)
                for part, n in pieces(points, window, step, max(1, most // 4)) if len(points) else ():
                    yield pa.RecordBatch.from_pylist([{"item": item, "points": part.tobytes(), "n": n}], part_schema)

    def build(block: pa.Table) -> pa.Table:
        held, size, out = [], 0, []
        for item, total, raw in zip(*(block.column(c).to_pylist() for c in ("item", "total", "points")), strict=True):
            points = np.frombuffer(raw, np.uint32)
            if held and size + len(points) > most:
                out.append(pack(held, q, window, step))
                held, size = [], 0
            held.append((item, points, total))
            size += len(points)
        return pa.Table.from_pylist([*out, pack(held, q, window, step)], packed_schema)

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    parts = cut_lineage(rows.where(F.col("text").isNotNull()).mapInArrow(cut, _PIECES).distinct())
    size = parts.agg(F.sum(F.octet_length("points"))).first()[0] or 0
    totals = parts.groupBy(F.col("item").alias("of_item")).agg(F.sum("n").alias("total"))
    # Blocks are half full on average, so that most make one index, however many partitions hold them.
    n = 1 if size <= 4 * most else 1 + int(size // (2 * most))
    counted = parts.join(totals, F.col("item").eqNullSafe(F.col("of_item"))).select(
        F.pmod(F.xxhash64("item", "points"), F.lit(n)).alias("block"), "item", "points", "total"
    )
    return cut_lineage(counted.groupBy("block").applyInArrow(build, _PACKED))


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = 12,
    window: int = 64,
    error: float = 0.06,
    quote: int = 80,
) -> DataFrame:
    """All documents with ``matches``: the benchmark items found in each (empty if none). ``quote``: the shortest part
    of an item, in folded characters, that is found wherever it begins."""
    if quote < window:
        raise ValueError("a quote must be able to hold a window")
    kept = [c for c in docs.columns if c != "matches"]
    packed = indexes(benchmark, item_col, item_text_col, q, window, quote - window + 1)
    sc = docs.sparkSession.sparkContext
    # One index at a time passes through the driver.
    sent = [sc.broadcast(row.asDict()) for row in packed.toLocalIterator()]
    # The text goes last, where the scan puts the matches.
    rows = docs.select(*columns(kept, neutral=True), columns([text_col])[0].cast("string").alias("text"))
    if not sent:
        return rows.withColumn("text", F.array().cast(MATCHES)).toDF(*kept, "matches")
    schema = T.StructType([*rows.schema[:-1], T.StructField("matches", MATCHES)])
    return rows.mapInArrow(giving_back(_scan(sent, (q, window, error))), schema).toDF(*kept, "matches")


def _scan(sent: list[Any], settings: tuple[int, int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent[0].value, *settings) if len(sent) == 1 else None

        def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [part.column(part.num_columns - 1).to_pylist() for part in parts]
            found = [[[] for _ in t] for t in texts]
            for one in sent:
                now = index or Index(one.value, *settings)
                for of, t in zip(found, texts, strict=True):
                    for all_, new in zip(of, now.matches(t), strict=True):
                        all_.extend(new)
                if index is None:
                    # The worker would keep what it has read of every broadcast variable.
                    del now
                    vars(one).pop("_value", None)
            for part, of in zip(parts, found, strict=True):
                matches = pa.array([merge(m) for m in of], _ARROW_MATCHES)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], matches], names=[*part.schema.names[:-1], "matches"])

        held, size = [], 0
        for batch in batches:
            for part in A.slices(batch, batch.num_columns - 1):
                held.append(part)
                size += part.nbytes
                if index is not None or size >= HELD_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        if held:
            yield from judged(held)

    return run
