"""Counts of hashed keys over the whole corpus, asked for and answered in packed blocks.

A block is what one task holds of the corpus at a time: its distinct keys, sorted, with their counts. Each block
sends its keys to the parts of the key space they fall in, one packed row per block and part that meet. A part
adds up all blocks' counts of a key and answers every block with the sums of the keys it asked for, in its
order. So counts are combined before the shuffle, a key that fills a third of the corpus is one entry per
block, and what travels is a few bytes per distinct key and block instead of a row per occurrence. The number
of parts follows the number of keys, which bounds what a part holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm import arrays as A
from rankloom.llm.common import arrow_schema

#: Entries (key and block) a part should hold.
PART_ENTRIES = 1_500_000
REQUEST = "space int, part int, block long, kind int, keys binary, counts binary"
ANSWER = "space int, part int, block long, kind int, total binary, marked binary, known long, tokens long, marked_tokens long"
#: The block number of a part's own summary row.
SUMMARY = -1
_U = np.uint64


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers as packed differences."""
    return A.pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(A.unpack(packed).astype(np.uint64), dtype=np.uint64)


def parts_for(entries: int) -> int:
    return max(1, -(-int(entries) // PART_ENTRIES))


def request(space: int, block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[dict]:
    """Rows that ask for the counts of a block's sorted distinct keys."""
    of = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    present, first = np.unique(of, return_index=True)
    for part, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield {"space": space, "part": part, "block": block, "kind": kind,
               "keys": pack_sorted(keys[a:b]), "counts": A.pack(counts[a:b].astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32))}


def rows_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(schema))


def _answer(group: pa.Table) -> pa.Table:
    """Sums for one part. Counts of kind 0 and 1 are added; those of kind 1 are given separately too; others only ask."""
    group = group.combine_chunks()
    space, part = group["space"][0].as_py(), group["part"][0].as_py()
    keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
    sizes = np.array([len(k) for k in keys])
    kinds = np.repeat(group["kind"].to_numpy(), sizes)
    counts = np.concatenate([A.unpack(x) for x in group["counts"].to_pylist()]).astype(np.float64)
    found, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, counts * (kinds <= 1), len(found)).astype(np.int64)
    marked = np.bincount(index, counts * (kinds == 1), len(found)).astype(np.int64)
    ends = np.cumsum(sizes)
    rows = [
        {"space": space, "part": part, "block": block, "kind": kind, "total": A.pack(total[index[a:b]]), "marked": A.pack(marked[index[a:b]])}
        for block, kind, a, b in zip(group["block"].to_pylist(), group["kind"].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True)
    ]
    rows.append({"space": space, "part": part, "block": SUMMARY, "kind": SUMMARY, "known": int((total > 0).sum()),
                 "tokens": int(total.sum()), "marked_tokens": int(marked.sum())})
    return pa.Table.from_pylist(rows, schema=arrow_schema(ANSWER))


def answer(requests: DataFrame) -> DataFrame:
    """One row per request, in the request's order of keys, and one summary row per part."""
    return requests.groupBy("space", "part").applyInArrow(_answer, ANSWER)


def collected(answers: pa.Table, space: int, column: str) -> np.ndarray:
    """A block's sums over all parts, in the order of its keys."""
    picked = sorted((p, x) for s, p, x in zip(answers["space"].to_pylist(), answers["part"].to_pylist(), answers[column].to_pylist(), strict=True) if s == space)
    return np.concatenate([A.unpack(x).astype(np.int64) for _, x in picked]) if picked else np.zeros(0, np.int64)
