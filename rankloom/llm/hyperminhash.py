"""MinHash near-deduplication with HyperMinHash registers.

A document is the set of its distinct shingles of ``SHINGLE`` words (64-bit hashes). The top bits of a hash choose
one of ``BUCKETS`` buckets; of the smallest hash in a bucket the register keeps the number of leading zeros and the
``MANTISSA`` bits after the first one, 16 bits in all. Empty registers borrow from a fixed random order of
buckets, so equal positions agree with the probability of the sets' Jaccard similarity. ``BANDS`` bands of
``ROWS`` registers give the candidate keys: a pair at similarity 0.85 shares none with a chance of about 2e-9.

Equal sets are one node. The exact way from candidates to components:

1. Nodes that share a band key with another node are candidates. A shingle that no other candidate holds cannot
   be shared, so with ``u`` such shingles of ``n`` two nodes share at most ``min(n1 - u1, n2 - u2)`` and unite at
   least ``max(n1 + u2, n2 + u1)``. Nodes whose own bound is below the threshold are left out: they link to nothing.
2. In each band key every node meets the key's hub, the node with the smallest share of such shingles. Pairs are
   compared once: by the collision-corrected estimate from the registers, and, unless that lies far below the
   threshold, on the full sets. Verified links give components.
3. Pairs of one key that are still in different components are tested where they meet with two bounds, the one
   above and one from parity bits: each node has ``PARITY`` bits, each the parity of its shingles that hash to it. Two
   nodes differ in at least as many shingles as bits, and at the threshold they may differ in at most
   ``(n1 + n2) * (100 - percent) / (100 + percent)``. What both bounds allow, which is little more than true links,
   is compared like the others, and the components are taken again. Both bounds are exact: no link is lost.

Sets are built from whole texts inside tasks; full sets are written for the remaining candidates only. Equal
texts, however many, are one node from the first sum on.

Defined cases: null and empty texts have no shingles and link with nothing; with fewer than ``SHINGLE`` words
the whole sequence is one shingle; null ids are kept and never name a component unless all its ids are null;
repeated rows share a component; an empty table gives an empty result. Only id and text are read, so further
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm import exchange as X
from rankloom.llm.common import arrow_schema, giving_back, map_batches
from rankloom.llm.components import connected_components
from rankloom.session import cut_lineage, work_path

SHINGLE = 5
BUCKETS, BANDS, ROWS, MANTISSA = 256, 42, 6, 10
_U = np.uint64
_BUCKET_BITS = BUCKETS.bit_length() - 1
_ORDER = np.stack([np.random.Generator(np.random.PCG64([7, j])).permutation(BUCKETS) for j in range(BUCKETS)])
_BAND_SALT = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | _U(1)
#: Standard errors that an estimate may fall short of the threshold before a pair is given up.
SLACK = 6.0
#: Words of 64 parity bits of a set.
PARITY = 16
#: Shingles in a block that asks for counts.
BLOCK_SHINGLES = 1 << 20


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = A.word_hashes(column)
    sizes = np.diff(first)
    rolled = np.zeros(len(words), np.uint64)
    whole = max(0, len(words) - SHINGLE + 1)
    for j in range(SHINGLE):
        rolled[:whole] = rolled[:whole] * _U(0x9E3779B97F4A7C15) + words[j : j + whole]
    rolled = A.mix(rolled)
    sets = []
    for start, n in zip(first[:-1].tolist(), sizes.tolist(), strict=True):
        if n >= SHINGLE:
            sets.append(np.unique(rolled[start : start + n - SHINGLE + 1]))
        elif n:
            h = _U(n)
            for w in words[start : start + n]:
                h = A.mix(np.array([h ^ w]))[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compressed registers of a sorted non-empty set, and which buckets hold a shingle of their own."""
    bucket = (shingles >> _U(64 - _BUCKET_BITS)).astype(np.int64)
    own, first = np.unique(bucket, return_index=True)
    # Sorted, so the first hash in a bucket is its smallest.
    rest = (shingles[first] << _U(_BUCKET_BITS)) | _U((1 << _BUCKET_BITS) - 1)
    top = np.floor(np.log2(np.maximum(rest >> _U(11), _U(1)).astype(np.float64))).astype(np.int64) + 11
    zeros = np.minimum(63 - top, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    registers = np.zeros(BUCKETS, np.uint16)
    registers[own] = ((zeros + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    filled = np.zeros(BUCKETS, bool)
    filled[own] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        registers[empty] = registers[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return registers, filled


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, for many sketches at once."""
    grouped = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    return A.mix((A.mix(grouped + _BAND_SALT) * _BAND_SALT).sum(2, dtype=np.uint64))


def estimate(one: np.ndarray, other: np.ndarray, own1: np.ndarray, own2: np.ndarray, n1: int, n2: int) -> tuple[float, int]:
    """Jaccard similarity from registers, less the chance agreement of truncated registers, and the buckets used."""
    used = own1 | own2
    m = int(used.sum())
    agree = int((own1 & own2 & (one == other)).sum())
    # Expected chance agreements of disjoint sets of these sizes in BUCKETS registers.
    chance = 0.1699 * BUCKETS / 2**MANTISSA * 4 * n1 * n2 / (n1 + n2) ** 2
    rate = min(0.5, chance / BUCKETS)
    return max(0.0, (agree / m - rate) / (1 - rate)), m


def similar(a: dict, b: dict, percent: int) -> bool:
    """The estimate first, then the full sets: 100 * shared >= percent * united."""
    one, other = a["set"], b["set"]
    jaccard, m = estimate(a["registers"], b["registers"], a["own"], b["own"], len(one), len(other))
    limit = percent / 100
    if jaccard < limit - SLACK * np.sqrt(limit * (1 - limit) / m) - 1.0 / m:
        return False
    shared = len(one) + len(other) - len(np.union1d(one, other))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _measure():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in A.slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            node = np.array([A.mix(s * _U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) ^ _U(len(s)) for s in sets], np.uint64)
            yield {
                "id": part.column("id"), "row": part.column("row"), "n": np.array([len(s) for s in sets], np.int64),
                "node": pa.array(_signed(A.mix(node)), mask=np.array([not len(s) for s in sets])),
                "registers": pa.array([sketch(s)[0].tobytes() if len(s) else None for s in sets], pa.binary()),
            }

    return step


def _bands():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        yield {"node": np.repeat(np.asarray(batch.column("node")), BANDS), "key": _signed(band_keys(registers).ravel())}

    return step


def _request_sets(parts: int):
    """Blocks of candidate sets: their members, and the request for how many candidates hold each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, sizes = 0, np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_SHINGLES, "right")))
                sets = [X.unpack_sorted(x) for x in batch.column("shingles").slice(at, upto - at).to_pylist()]
                number += 1
                keys, counts = np.unique(np.concatenate(sets), return_counts=True)
                block = (task << 32) + number
                rows = list(X.request(0, block, 0, keys, counts, parts))
                for row, node, s in zip(range(len(sets)), batch.column("node").slice(at, upto - at).to_pylist(), sets, strict=True):
                    rows.append({"space": -1, "part": row, "block": block, "kind": len(s), "keys": X.pack_sorted(s), "counts": int(node).to_bytes(8, "little", signed=True)})
                yield X.rows_batch(rows, X.REQUEST)
                at = upto

    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each of ``64 * PARITY`` hash places, as ``PARITY`` numbers."""
    place = (A.mix(shingles) >> _U(64 - (64 * PARITY).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def _unshared(_: tuple, members: pa.Table, answers: pa.Table) -> pa.Table:
    """Per member of a block: its shingles that no other candidate holds, and its parity bits."""
    if not members.num_rows:
        return arrow_schema(_BOUNDS).empty_table()
    sets = [X.unpack_sorted(x) for x in members["keys"].to_pylist()]
    keys = np.unique(np.concatenate(sets))
    total = X.collected(answers, 0, "total")
    u = [int((total[np.searchsorted(keys, s)] == 1).sum()) for s in sets]
    nodes = [int.from_bytes(x, "little", signed=True) for x in members["counts"].to_pylist()]
    bits = pa.array([parity(s).tolist() for s in sets], pa.list_(pa.int64()))
    return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "u": pa.array(u, pa.int64()), "bits": bits})


_BOUNDS = "node long, n long, u long, bits array<long>"


def _compare(percent: int):
    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            held: dict[int, dict] = {}

            def of(node: int, packed: bytes) -> dict:
                if node not in held:
                    if len(held) > 64:
                        held.clear()
                    s = X.unpack_sorted(packed)
                    registers, own = sketch(s)
                    held[node] = {"set": s, "registers": registers, "own": own}
                return held[node]

            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b")), strict=True)
            found = [(a, b) for a, b, x, y in rows if similar(of(a, x), of(b, y), percent)]
            yield {"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())}

        return step

    return make


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b"), _compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per document: ``id``, ``row`` (a hash of id and text), ``n_shingles``, ``component`` (smallest id that links of
    at least ``percent`` % reach) and ``root`` (a number of the component; null for texts without shingles)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = work_path(spark, "near-sketches")
    hashed = texts.withColumn("row", F.xxhash64("id", "text"))
    map_batches(hashed, _measure, "id long, row long, n long, node long, registers binary").write.parquet(path)
    sketches = spark.read.parquet(path)
    members = sketches.select("id", "row", "n", "node")

    # One row per distinct set; the registers of equal sets are equal.
    nodes = sketches.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("registers").alias("registers"))
    path = work_path(spark, "near-bands")
    map_batches(nodes, _bands, "node long, key long").write.parquet(path)
    bands = spark.read.parquet(path)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
    groups = cut_lineage(bands.join(shared, "key"))
    candidates = groups.select("node").distinct()

    # Full sets of the candidates, one document of each.
    one_of = members.join(candidates, "node").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("f"), F.max("n").alias("n"))
    sets = _full_sets(texts, one_of.select("node", "n", F.col("f.id").alias("id")))
    path = work_path(spark, "near-sets")
    sets.write.parquet(path)
    sets = spark.read.parquet(path)
    entries = sets.agg(F.sum("n")).first()[0] or 0
    path = work_path(spark, "near-requests")
    sets.mapInArrow(giving_back(_request_sets(X.parts_for(entries))), X.REQUEST).write.parquet(path)
    asked = spark.read.parquet(path)
    answers = X.answer(asked.where(F.col("space") == 0)).where(F.col("block") != X.SUMMARY)
    bounds = asked.where(F.col("space") == -1).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_unshared, _BOUNDS)
    able = cut_lineage(bounds.where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")))
    able_sets = cut_lineage(sets.select("node", "shingles").join(able.select("node"), "node"))
    groups = cut_lineage(groups.join(able.drop("bits"), "node"))

    def allowed(left: str, right: str):
        n1, u1, n2, u2 = (F.col(f"{t}{c}") for t in (left, right) for c in ("n", "u"))
        return 100 * F.least(n1 - u1, n2 - u2) >= percent * F.greatest(n1 + u2, n2 + u1)

    # Every node of a key meets the key's hub.
    hubs = groups.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), F.col("node").alias("a"), F.col("n").alias("hub_n"), F.col("u").alias("hub_u"))).alias("h"))
    meets = groups.join(hubs.select("key", "h.*"), "key").where((F.col("a") != F.col("node")) & allowed("hub_", ""))
    first = cut_lineage(verified(meets.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), able_sets, percent))
    roots = connected_components(first)

    # What shares a key and is still apart.
    rooted = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    rooted = cut_lineage(rooted.join(apart, "key").join(able.select("node", "bits"), "node"))

    def side(tag: str, node: str):
        bits = [F.col("bits")[i].alias(f"{tag}b{i}") for i in range(PARITY)]
        return rooted.select("key", F.col("node").alias(node), F.col("root").alias(f"{tag}root"), F.col("n").alias(f"{tag}n"), F.col("u").alias(f"{tag}u"), *bits)

    differing = sum((F.bit_count(F.col(f"l_b{i}").bitwiseXOR(F.col(f"r_b{i}"))) for i in range(PARITY)), F.lit(0))
    close = differing * (100 + percent) <= (F.col("l_n") + F.col("r_n")) * (100 - percent)
    rest = side("l_", "a").join(side("r_", "b"), "key").where((F.col("l_root") < F.col("r_root")) & allowed("l_", "r_") & close)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # The hub's pairs were compared already.
    done = meets.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    second = cut_lineage(verified(rest.join(done, ["a", "b"], "left_anti"), able_sets, percent))
    if second.limit(1).count():
        roots = connected_components(first.unionByName(second))

    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("smallest"))
    return named.join(least, "root", "left").select(
        "id", "row", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component"), "root",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id (of equal ids one), and
    every text without shingles; repeated rows of one id and text stay once."""
    found = near_duplicates(docs, id_col, text_col, percent)
    order = F.struct(F.col("id").isNull(), "id", "row")
    best = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min_by("row", order).alias("_row")).select("_row")
    alone = found.where(F.col("root").isNull()).select(F.col("row").alias("_row"))
    keyed = docs.withColumn("_row", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    return keyed.join(best.unionByName(alone).distinct(), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles) for the wanted documents; where ids repeat, the row with the wanted set is taken."""
    rows = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"])).select(wanted["node"], texts["text"])

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in A.slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                own = np.array([A.mix(s * _U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) ^ _U(len(s)) for s in sets], np.uint64)
                fits = np.flatnonzero((_signed(A.mix(own)) == np.asarray(part.column("node"))))
                yield {
                    "node": np.asarray(part.column("node"))[fits], "n": np.array([len(sets[i]) for i in fits], np.int64),
                    "shingles": pa.array([X.pack_sorted(sets[i]) for i in fits], pa.binary()),
                }

        return step

    found = map_batches(rows, make, "node long, n long, shingles binary")
    return found.dropDuplicates(["node"])
