"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import arrays as A


def split_number(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def columns(names: list[str], neutral: bool = False) -> list[Column]:
    """Columns by their whole names, in which dots and backticks mean nothing; ``neutral``: called ``_c0``, ``_c1``, ..."""
    found = [F.col("`" + name.replace("`", "``") + "`") for name in names]
    return [c.alias(f"_c{i}") for i, c in enumerate(found)] if neutral else found


def arrow_type(name: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.list_(plain[name[6:-1]]) if name.startswith("array<") else plain[name]


def arrow_schema(schema: str) -> pa.Schema:
    """An Arrow schema from Spark's ``name type, ...``."""
    return pa.schema([pa.field(n, arrow_type(t)) for n, t in (x.split() for x in schema.split(","))])


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, after which the worker hands what it no longer needs back to the system: it waits for tasks of later stages,
    and would hold the largest amount that any task before has taken."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        A.forget_powers()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim is not None:
            trim(0)

    return wrapped


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once per task and gives a function from a batch to columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out = make(), arrow_schema(schema)
        for batch in batches:
            for columns in step(batch):
                arrays = [columns[f.name] for f in out]
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, out, strict=True)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return df.mapInArrow(giving_back(run), schema)
