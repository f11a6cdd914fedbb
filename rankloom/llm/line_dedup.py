"""Line deduplication: hashes of lines in one range order, and a keep bitmap per document instead of its text.

Every line becomes a row (hash, document, position) without its text. Rows are range-partitioned and sorted by all of
it, so occurrences of a line stand together in the order of documents and positions, and a line that a third of
all documents hold is simply several partitions long. One pass over each partition counts documents line by line and
hands on only the rows to drop. What a partition cannot decide alone, lines at its two borders with too few
documents on its side, is settled by a table of at most two rows per partition.

A document's dropped positions come back as one compressed bitmap. ``apply_bitmaps`` lays it over the text.

Defined cases: a null text counts as empty; an empty text has one empty line; lines whose key has no character are
never dropped; documents are told apart by id (null is an id like any other), so rows that repeat an id count as one
document, and equal ids with different texts have a bitmap each; a line repeated within one document counts it
once, yet all its rows are dropped; an empty table gives an empty result. Only the id and the text are read, so
further columns do not matter. Two different keys count as one with a chance of 2**-128 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_schema, map_batches
from rankloom.session import work_path

BLANKS = " \t\n\x0b\x0c\r"
#: Kinds of rows that a pass over a partition gives: a line to drop, one to drop if its border says so, a border.
DROP, PENDING, BORDER = 0, 1, 2
_FIELDS = ("h", "g", "unknown", "id", "text_hash", "pos")
_EVENT = "kind int, part int, h long, g long, unknown boolean, id long, text_hash long, pos int, lead boolean, docs long, last_unknown boolean, last_id long"


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_lines, keys): the 128-bit hash of each line's key; null where the key is empty."""
    upper = "".join(map(chr, range(65, 91)))

    def key_hash(line: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("line"), key).alias("g")))

    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("text_hash"), F.transform(lines, key_hash).alias("keys"))
    return rows.select("id", "text_hash", F.size("keys").cast("long").alias("n_lines"), "keys")


class _Pass:
    """One partition's rows, batch by batch, in order. At most one line's undecided rows are held: those of fewer
    than ``min_docs`` documents."""

    def __init__(self, part: int, min_docs: int, keep_first: bool) -> None:
        self.part, self.min_docs, self.keep_first = part, min_docs, keep_first
        self.held: dict[str, np.ndarray] | None = None  # rows of the line at hand, while it is undecided
        self.line: tuple[int, int] | None = None
        self.first_line, self.lead_done = True, False
        self.docs, self.first_doc, self.last_doc = 0, None, None
        self.last_row: tuple | None = None

    def rows(self, kind: int, c: dict[str, np.ndarray], lead: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(c["h"])
        columns = {**c, "kind": np.full(n, kind), "part": np.full(n, self.part), "lead": np.zeros(n, bool) if lead is None else lead,
                   "docs": np.zeros(n, np.int64), "last_unknown": np.zeros(n, bool), "last_id": np.zeros(n, np.int64)}
        schema = arrow_schema(_EVENT)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def border(self) -> pa.RecordBatch:
        (h, g), (u, i), (lu, li) = self.line, self.first_doc, self.last_doc
        row = {"kind": BORDER, "part": self.part, "h": h, "g": g, "unknown": u, "id": i, "text_hash": 0, "pos": 0, "lead": False,
               "docs": self.docs, "last_unknown": lu, "last_id": li}
        return pa.RecordBatch.from_pylist([row], schema=arrow_schema(_EVENT))

    def out(self, c: dict[str, np.ndarray], decided: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the line at hand. Its first row stays if first occurrences do; at the partition's beginning
        only the border table knows whether it is the first one."""
        lead = np.zeros(len(c["h"]), bool)
        if len(lead) and not self.lead_done:
            lead[0], self.lead_done = True, True
        if not self.keep_first:
            lead[:] = False
        sure = ~lead if decided else np.zeros(len(lead), bool)
        if sure.any():
            yield self.rows(DROP, {f: a[sure] for f, a in c.items()})
        ask = ~sure if not decided or self.first_line else np.zeros(len(lead), bool)
        if ask.any():
            yield self.rows(PENDING, {f: a[ask] for f, a in c.items()}, lead[ask])

    def line_end(self, at_border: bool) -> Iterator[pa.RecordBatch]:
        """The line at hand has no more rows in this partition."""
        if at_border or self.first_line:
            if self.held is not None:
                yield from self.out(self.held, False)
            yield self.border()
        self.held, self.first_line = None, False

    def step(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in _FIELDS}
        if not batch.num_rows:
            return
        # Rows of documents that are there several times, id and text, are equal and stand together: one of each stays.
        row = tuple(x[-1] for x in c.values())
        other = np.ones(batch.num_rows, bool)
        other[1:] = np.any([x[1:] != x[:-1] for x in c.values()], axis=0)
        other[0] = tuple(x[0] for x in c.values()) != self.last_row
        self.last_row, c = row, {f: x[other] for f, x in c.items()}
        n = len(c["h"])
        if not n:
            return
        new_line = np.ones(n, bool)
        new_line[1:] = (c["h"][1:] != c["h"][:-1]) | (c["g"][1:] != c["g"][:-1])
        new_doc = new_line.copy()
        new_doc[1:] |= (c["id"][1:] != c["id"][:-1]) | (c["unknown"][1:] != c["unknown"][:-1])
        starts = np.flatnonzero(new_line)
        ends = np.append(starts[1:], n)
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        # The first line of the batch may go on from the one before, the last one may go on in the next: by hand.
        # Those between are whole.
        for k in dict.fromkeys((0, len(starts) - 1)):
            if k and k > 1:
                yield from self.line_end(False)
                yield from self.inner(c, starts[1:k], ends[1:k], docs[1:k])
            elif k:
                yield from self.line_end(False)
            a, b = int(starts[k]), int(ends[k])
            line, doc = (int(c["h"][a]), int(c["g"][a])), (bool(c["unknown"][a]), int(c["id"][a]))
            if line != self.line:
                if self.line is not None and not k:
                    yield from self.line_end(False)
                self.line, self.docs, self.first_doc, self.last_doc, self.lead_done = line, 0, doc, None, False
                self.held = {f: a_[:0] for f, a_ in c.items()}
            self.docs += int(docs[k]) - (self.last_doc == doc)
            self.last_doc = (bool(c["unknown"][b - 1]), int(c["id"][b - 1]))
            rows = {f: x[a:b] for f, x in c.items()}
            if self.held is not None:
                rows = {f: np.concatenate([self.held[f], x]) for f, x in rows.items()}
            if self.docs >= self.min_docs:
                self.held = None
                yield from self.out(rows, True)
            else:
                self.held = rows

    def inner(self, c: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        drop = np.repeat(docs >= self.min_docs, ends - starts)
        if self.keep_first:
            drop[starts - starts[0]] = False
        if drop.any():
            yield self.rows(DROP, {f: x[starts[0] : ends[-1]][drop] for f, x in c.items()})


def keep_bitmaps(
    docs: DataFrame, min_docs: int = 2, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_hash, n_lines, n_dropped, keep): one row per document and text, ``keep`` its compressed bitmap.

    A line whose key at least ``min_docs`` documents hold is dropped everywhere, or, with ``keep_first``, everywhere
    but at its first occurrence by document and position.
    """
    spark = docs.sparkSession
    hashed = work_path(spark, "line-hashes")
    line_rows(docs, id_col, text_col).write.parquet(hashed)
    held = spark.read.parquet(hashed)
    rows = held.select("id", "text_hash", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull())
    rows = rows.select("key.h", "key.g", F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Pass(TaskContext.get().partitionId(), min_docs, keep_first)
        for batch in batches:
            yield from state.step(batch)
        if state.line is not None:
            yield from state.line_end(True)

    found = work_path(spark, "line-drops")
    rows.repartitionByRange(*_FIELDS).sortWithinPartitions(*_FIELDS).mapInArrow(run, _EVENT).write.parquet(found)
    events = spark.read.parquet(found)

    # Borders: at most two rows per partition. A document that ends one partition and begins the next counts once.
    along = Window.partitionBy("h", "g").orderBy("part")
    first, last = F.struct("unknown", "id"), F.struct(F.col("last_unknown").alias("unknown"), F.col("last_id").alias("id"))
    borders = events.where(F.col("kind") == BORDER).withColumn("again", F.coalesce((F.lag(last).over(along) == first).cast("int"), F.lit(0)))
    borders = borders.groupBy("h", "g").agg(F.sum(F.col("docs") - F.col("again")).alias("all_docs"), F.min("part").alias("begins"))
    pending = events.where(F.col("kind") == PENDING).drop("docs").join(borders, ["h", "g"])
    settled = pending.where((F.col("all_docs") >= min_docs) & (~F.col("lead") | (F.col("part") > F.col("begins"))))
    where = [F.when(~F.col("unknown"), F.col("id")).alias("id"), "text_hash", F.lit(0).cast("long").alias("n_lines"), "pos"]
    drops = events.where(F.col("kind") == DROP).select(*where).unionByName(settled.select(*where))

    every = held.select("id", "text_hash", "n_lines", F.lit(None).cast("int").alias("pos")).unionByName(drops)
    per_doc = every.groupBy("id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    schema = "id long, text_hash long, n_lines long, n_dropped long, keep binary"

    def make():
        squeeze = zstandard.ZstdCompressor(level=3)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            dropped, n_dropped, keep = batch.column("dropped"), [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), dropped, strict=True):
                bits = np.ones(n, np.uint8)
                bits[places.values.to_numpy()] = 0
                n_dropped.append(len(places.values))
                keep.append(squeeze.compress(np.packbits(bits).tobytes()))
            yield {"id": batch.column("id"), "text_hash": batch.column("text_hash"), "n_lines": batch.column("n_lines"), "n_dropped": n_dropped, "keep": keep}

        return step

    return map_batches(per_doc, make, schema)


def bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    """The bits of a compressed bitmap: whether each line stays."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), np.uint8)
    return np.unpackbits(raw, count=n_lines).astype(bool)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): every document's kept lines, joined again."""
    key = lambda i, t: F.struct(i.alias("id"), t.alias("t"))  # noqa: E731 - a struct also joins null ids
    texts = docs.select(key(F.col(id_col).cast("long"), text_hash(text_col)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = bitmaps.select(key(F.col("id"), F.col("text_hash")).alias("k"), "n_lines", "n_dropped", "keep")
    both = texts.join(marks, "k").select("k.id", "text", "n_lines", "n_dropped", "keep")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            kept = []
            columns = (batch.column(f).to_pylist() for f in ("text", "n_lines", "n_dropped", "keep"))
            for text, n, dropped, keep in zip(*columns, strict=True):
                if dropped:
                    lines = text.split("\n")
                    text = "\n".join([lines[i] for i in np.flatnonzero(bitmap(keep, n)).tolist()])
                kept.append(text)
            yield {"id": batch.column("id"), "n_lines": batch.column("n_lines"), "n_dropped": batch.column("n_dropped"), "kept": kept}

        return step

    return map_batches(both, make, "id long, n_lines long, n_dropped long, kept string")
