"""Document fingerprints by content-defined chunking with a normalised gear hash.

A gear hash runs over the UTF-8 bytes of a text; at each byte it depends on the last 32 bytes only. A chunk
ends where the hash meets a mask: a strict one while the chunk is shorter than ``NORMAL`` bytes, a loose one
after that, never before ``LEAST`` bytes and at the latest after ``MOST``. Boundaries therefore follow the
content: an insertion moves those near it and leaves the rest. The fingerprint is the set of chunk digests,
each with its length. The likeness of one to another is containment weighted by length: the bytes of its
chunks that the other holds too, over the bytes of all its chunks.

``with_neighbours`` brings each row the text that follows it along descending ids. Ids are cut into blocks of a
range each; one shuffle brings a block's rows together, and the first row of each block goes to the block
before it as well, so no window runs over the whole table. The cut points come from one mergeable sketch.

Defined cases: null texts count as empty; an empty text has the empty fingerprint, alike (1.0) to another empty
one and to nothing else (0.0); equal texts have equal fingerprints; a chunk that repeats within a text counts
once; null ids stand last; rows with equal ids are ordered by a hash of their text; the row after the last is
the first, and a single row follows itself; an empty table gives an empty result. Only the id and the text are
read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm.common import arrow_schema
from rankloom.session import block_count

#: Bytes of a chunk: least, before the mask loosens, most.
LEAST, NORMAL, MOST = 12, 32, 128
#: Chance of a boundary per byte: 1 in 64 while a chunk is short, 1 in 16 after that.
_STRICT, _LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)
#: Code points per step of the scan; a longer text is a step of its own.
STEP = 1 << 20
_GAP = bytes(32)

Fingerprint = tuple[np.ndarray, np.ndarray]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 32 bytes' numbers, each doubled once per byte since."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        later = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[:0]
        h[len(h) - len(later) :] = later
    return h


def chunk_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of many texts within ``data``, and the number of chunks of each text."""
    h = gear(data)
    loose = np.flatnonzero((h & _LOOSE) == 0) + 1
    firm, easy = loose[(h[loose - 1] & _STRICT) == 0].tolist(), loose.tolist()
    ends: list[int] = []
    counts = np.zeros(len(starts), np.int64)
    for t, (at, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        before = len(ends)
        while at < stop:
            cut = min(at + MOST, stop)
            i = bisect_left(firm, at + LEAST)
            if i < len(firm) and firm[i] < at + NORMAL:
                cut = min(cut, firm[i])
            else:
                j = bisect_left(easy, at + NORMAL)
                if j < len(easy):
                    cut = min(cut, easy[j])
            ends.append(cut)
            at = cut
        counts[t] = len(ends) - before
    return np.array(ends, np.int64), counts


def fingerprints(texts: list[bytes]) -> Iterator[Fingerprint]:
    """Sorted chunk digests and their lengths, for each text."""
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= STEP:
            size += len(texts[upto])
            upto += 1
        # Zero bytes before each text, so that no hash reaches into another one.
        data = np.frombuffer(b"".join(part for t in texts[at:upto] for part in (_GAP, t)), np.uint8)
        stops = np.cumsum([len(_GAP) + len(t) for t in texts[at:upto]])
        begins = stops - [len(t) for t in texts[at:upto]]
        ends, counts = chunk_ends(data, begins, stops)
        first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        starts[first[:-1][counts > 0]] = begins[counts > 0]
        digests = A.span_hash(A.prefix_hash(data, A.EXACT), starts, ends)
        lengths = ends - starts
        for i in range(upto - at):
            own, where = np.unique(digests[first[i] : first[i + 1]], return_index=True)
            yield own, lengths[first[i] : first[i + 1]][where]
        at = upto


def likeness(one: Fingerprint, other: Fingerprint) -> float:
    """Share of the first's bytes that lie in chunks of the other too."""
    total = int(one[1].sum())
    if not total:
        return 1.0 if not len(other[0]) else 0.0
    shared = np.isin(one[0], other[0], assume_unique=True)
    return float(one[1][shared].sum()) / total


def as_text(print_: Fingerprint) -> str:
    """The fingerprint as hexadecimal text: 16 digits of digest and 2 of length per chunk, in order."""
    rows = np.zeros((len(print_[0]), 9), np.uint8)
    rows[:, :8] = print_[0].astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8] = print_[1]
    return rows.tobytes().hex()


def from_text(text: str) -> Fingerprint:
    rows = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 9)
    return np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64), rows[:, 8].astype(np.int64)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, place, id, text): rows in blocks along descending ids; every block ends with the row after its last one.

    That border row has ``place`` 1, the block's own rows 0; a block's rows are in one partition, in order.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    n = block_count(docs.sparkSession)
    # As many numbers as blocks, from a sketch; null ids form the last block.
    cuts = sorted(set(rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 8 * n)).first()[0] or []))
    placed = rows.withColumn("at", F.col("id").cast("double")).withColumn("bucket", F.lit(0))
    if cuts:
        above = Bucketizer(splits=[float("-inf"), *map(float, cuts), float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
        placed = above.transform(placed.drop("bucket"))
    # The bucketizer puts missing ids after the last bucket; blocks count from the highest ids down.
    block = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(len(cuts) - F.col("bucket").cast("int"))
    placed = placed.select("id", "text", "h", block.alias("block"))
    # The complement of an id falls as the id rises, for every whole number.
    order = F.struct(F.col("id").isNull().alias("last"), F.bitwise_not("id").alias("down"), "h")
    # One row per block: which row comes first in it. The block before takes that row as its border.
    firsts = [r[0] for r in placed.groupBy("block").agg(F.min(order).alias("first")).orderBy("block").select(F.struct("block", "first.down", "first.h")).collect()]
    if not firsts:
        return placed.select("block", F.lit(0).alias("place"), "id", "text", "h")
    spark = docs.sparkSession
    into = spark.createDataFrame(
        [(firsts[i - 1].block, f.block, f.down, f.h) for i, f in enumerate(firsts)], "block int, of int, down long, first_h long"
    )
    # At most one row per block, so at most MAX_BLOCKS rows.
    border = (
        placed.withColumnRenamed("block", "of").join(F.broadcast(into), "of")
        .where(F.col("h").eqNullSafe(F.col("first_h")) & F.bitwise_not("id").eqNullSafe(F.col("down")))
        .select("block", F.lit(1).alias("place"), "id", "text", "h")
    )
    every = placed.select("block", F.lit(0).alias("place"), "id", "text", "h").unionByName(border)
    return every.repartition(F.col("block")).sortWithinPartitions("block", "place", F.col("id").desc_nulls_last(), "h")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third of its characters replaced by as many
    first ones of the next document) and the likeness to the edited and to the next text."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_chunks long"
    )
    out = arrow_schema(schema)

    def measure(group: list[tuple]) -> pa.RecordBatch:
        """All rows of ``group`` but the last, which is only the follower of the one before."""
        texts = [text or "" for _, text in group]
        edited = []
        for text, follower in zip(texts, texts[1:], strict=False):
            n = len(text) // 3
            edited.append(text[: len(text) - n] + follower[:n])
        raw = [t.encode() for t in edited]
        prints = list(fingerprints([t.encode() for t in texts]))
        changed = list(fingerprints(raw))
        own, following = prints[:-1], prints[1:]
        columns = {
            "doc_id": [i for i, _ in group[:-1]],
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
            "fingerprint": list(map(as_text, own)),
            "edited_fingerprint": list(map(as_text, changed)),
            "near_edited": list(map(likeness, own, changed)),
            "near_next": list(map(likeness, own, following)),
            "n_chunks": [len(p[0]) for p in own],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, block = 0, None
        for batch in batches:
            for key, place, id_, text in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "id", "text")), strict=True):
                if key != block:
                    held, size, block = [], 0, key
                elif place and held and held[-1] is None:
                    continue  # a repeated border row
                held.append((id_, text))
                size += len(text or "")
                if place or size >= STEP:
                    if len(held) > 1:
                        yield measure(held)
                    held, size = ([None], 0) if place else ([held[-1]], len(text or ""))

    return with_neighbours(docs, id_col, text_col).select("block", "place", "id", "text").mapInArrow(run, schema)
