"""Phrases that occur often and more often than their parts would by chance, per language.

Finding the frequent n-grams takes two passes over blocks of texts held as packed word numbers.

* First pass: every n-gram of a language is a key in a hash space that is cut into partitions of a fixed mass (n-gram
  occurrences). A block sends each partition its counted keys there; a partition merges them into a Misra-Gries summary
  with more counters than its mass / threshold, so all that is ever taken off a key is less than the threshold, and a
  key whose counter plus what was taken off stays below the threshold is infrequent for sure. Keys that reach the
  threshold within one block are set aside as frequent. So every n-gram that occurs often enough survives; a partition
  answers each block with the surviving keys among those that the block sent.
* Second pass: blocks count the n-grams behind surviving keys exactly, by their words, and send each partition one row
  of phrases and counts per language; a partition adds them up, about a million phrases at a time.

A very common n-gram is one counter per block. What is sent is two to six bytes per different n-gram of a block.

Defined cases: a null text counts as empty; a null language is ``und``, like the language of that name; rows that repeat
an id count each; empty texts, empty tables and texts without frequent phrases give no rows; ties in score go to
the more frequent phrase, then to the first in byte order; one phrase in two languages is two phrases. Only the text
and the language are read, so further columns do not matter. Words count as one if their 64-bit hashes agree. A piece
between two punctuation marks is held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm.common import arrow_schema, map_batches
from rankloom.session import work_path

#: Words of a block.
BLOCK_WORDS = 1 << 19
#: N-gram occurrences that a partition of the hash space should hold at most, and bits of a key within it.
PART_MASS, PART_BITS = 1 << 23, 26
#: Counters of a summary, as a multiple of mass / threshold.
SLACK = 8
_U = np.uint64
_FILL = 0xFFFF
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATES = _ENDS_PIECE.copy()
_SEPARATES[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLOCK = "block long, n_words long, mass long, langs array<string>, texts binary, lang_of binary, ids binary, lengths binary, lang_words array<long>"
_PIECE = "part long, block long, wide boolean, ones binary, more binary, counts binary"
_ANSWER = "part long, block long, keys binary, taken long"


def mass_of(lengths: np.ndarray, longest: int) -> int:
    """N-grams of 1 to ``longest`` words in pieces of these lengths."""
    return int(sum(np.maximum(lengths - n + 1, 0).sum() for n in range(1, longest + 1)))


class _Block:
    """Texts' words, as numbers into a table of (language, word), with the lengths of the pieces."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.table: dict[int, int] = {}
        self.texts: list[bytes] = []
        self.lang_of: list[int] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.n_words = 0

    def add(self, lang: np.ndarray, hashes: np.ndarray, word: Callable[[int], bytes], names: list[str], lengths: np.ndarray) -> None:
        keyed = hashes ^ A.mix(lang.astype(np.uint64) + _U(1))
        _, first, number = np.unique(keyed, return_index=True, return_inverse=True)
        own = np.zeros(len(first), np.int64)
        for k, at in enumerate(first.tolist()):
            name = names[lang[at]]
            code = self.langs.setdefault(name, len(self.langs))
            key = (code, int(hashes[at]))
            if key not in self.table:
                self.table[key] = len(self.table)
                self.texts.append(word(at))
                self.lang_of.append(code)
            own[k] = self.table[key]
        self.ids.append(own[number])
        self.lengths.append(lengths)
        self.n_words += len(hashes)

    def row(self, block: int, longest: int) -> dict:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(ids, minlength=len(self.texts)), kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        ids, lang_of = number[ids], np.array(self.lang_of, np.int64)[order]
        return {
            "block": [block], "n_words": [len(ids)], "mass": [mass_of(lengths, longest)], "langs": [list(self.langs)],
            "texts": [zstandard.compress(b"\n".join([self.texts[i] for i in order.tolist()]))], "lang_of": [A.pack(lang_of)],
            "ids": [A.pack(ids)], "lengths": [A.pack(lengths)], "lang_words": [np.bincount(lang_of[ids], minlength=len(self.langs)).tolist()],
        }


def text_blocks(docs: DataFrame, text_col: str, lang_col: str, longest: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of words of whole pieces, of ``block_words`` or little more."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    schema = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId() << 31, 0, _Block()
        to_batch = lambda row: pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in schema], schema=schema)
        for batch in batches:
            for part in A.slices(batch, "text"):
                data, bounds = A.utf8(part.column("text"))
                starts, ends, first = A.words(data, bounds, _SEPARATES)
                if not len(starts):
                    continue
                hashes = A.span_hash(A.prefix_hash(data, A.FOLDED), starts, ends)
                of_text = np.repeat(np.arange(part.num_rows), np.diff(first))
                marks = np.concatenate([[0], np.cumsum(_ENDS_PIECE[data])])[starts]
                begins = np.ones(len(starts), bool)
                begins[1:] = (marks[1:] != marks[:-1]) | (of_text[1:] != of_text[:-1])
                at = np.flatnonzero(begins)
                coded = part.column("lang").dictionary_encode()
                names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                lower = _LOWER[data].tobytes()
                # Cut between pieces, where the block at hand is full.
                i = 0
                while i < len(at):
                    j = int(np.searchsorted(at, at[i] + max(block_words - block.n_words, 1), "left"))
                    j = max(j, i + 1)
                    a, b = int(at[i]), int(at[j]) if j < len(at) else len(starts)
                    word = lambda k, a=a: lower[starts[a + k] : ends[a + k]]
                    block.add(lang[of_text[a:b]], hashes[a:b], word, names, np.diff(np.append(at[i:j], b)))
                    if block.n_words >= block_words:
                        yield to_batch(block.row(task + made, longest))
                        made, block = made + 1, _Block()
                    i = j
        if block.n_words:
            yield to_batch(block.row(task + made, longest))

    return rows.mapInArrow(run, _BLOCK)


class Words:
    """A block read back."""

    def __init__(self, row: dict) -> None:
        joined = zstandard.decompress(row["texts"])
        self.block, self.langs, self.texts = row["block"], row["langs"], joined.split(b"\n")
        self.lang_of, self.ids, lengths = (A.unpack(row[c]).astype(np.int64) for c in ("lang_of", "ids", "lengths"))
        salt = np.array([_hash64(x) for x in self.langs], np.uint64)
        data = np.frombuffer(joined, np.uint8)
        ends = np.append(np.flatnonzero(data == 0x0A), len(data))
        hashes = A.span_hash(A.prefix_hash(data, A.FOLDED), np.append(0, ends[:-1] + 1), ends)
        self.hash = A.mix(hashes ^ salt[self.lang_of])[self.ids]
        #: Words from each one to the end of its piece, itself included.
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.ids))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: where n-grams begin and their 64-bit hashes."""
        at, h = np.arange(len(self.ids)), self.hash
        yield 1, at, h
        for n in range(2, longest + 1):
            fits = self.left[at] >= n
            at = at[fits]
            h = A.mix(h[fits] * _U(0x9E3779B97F4A7C15) + self.hash[at + n - 1] + _U(n))
            yield n, at, h


def _hash64(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(A.span_hash(A.prefix_hash(data, A.EXACT), np.array([0]), np.array([len(data)]))[0])


def key_bits(mass: int) -> int:
    """Bits of a key: those within a partition and as many as the partitions take."""
    parts = max(1, -(-mass // PART_MASS))
    return PART_BITS + (parts - 1).bit_length()


def keep_largest(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: take the (capacity + 1)-th largest count off all counters and keep the positive ones."""
    if len(counts) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stays = counts > off
    return keys[stays], counts[stays] - off, off


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def pack_keys(keys: np.ndarray, wide: bool) -> bytes:
    """Sorted keys of a partition: plain, or as steps of two bytes where 65535 only moves on."""
    if wide:
        return keys.astype(np.uint32).tobytes()
    steps = np.diff(keys.astype(np.int64), prepend=0)
    fills = steps // _FILL
    out = np.full(len(keys) + int(fills.sum()), _FILL, np.uint16)
    out[np.cumsum(fills) + np.arange(len(keys))] = (steps - fills * _FILL).astype(np.uint16)
    return out.tobytes()


def unpack_keys(packed: bytes, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(packed, np.uint32)
    steps = np.frombuffer(packed, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != _FILL].astype(np.uint32)


def block_keys(blocks: DataFrame, longest: int, bits: int, min_count: int) -> DataFrame:
    """A row per block and partition of the hash space: the block's keys there, those of one occurrence apart from the
    others, whose counts go up to ``min_count``."""
    width = np.uint8 if min_count < 256 else np.uint32

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for i in range(batch.num_rows):
                words = Words(batch.slice(i, 1).to_pylist()[0])
                keys = np.concatenate([h >> _U(64 - bits) for _, _, h in words.grams(longest)])
                keys.sort()
                first = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
                counts = np.diff(np.append(first, len(keys))).clip(max=min_count)
                keys = keys[first]
                present, begin = np.unique(keys >> _U(PART_BITS), return_index=True)
                low = (keys & _U((1 << PART_BITS) - 1)).astype(np.uint32)
                for p, i, j in zip(present.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
                    # Steps of two bytes pay while keys stand close.
                    wide, one = (1 << PART_BITS) > 2 * _FILL * (j - i), counts[i:j] == 1
                    yield {"part": [p], "block": [words.block], "wide": [wide], "ones": [pack_keys(low[i:j][one], wide)],
                           "more": [pack_keys(low[i:j][~one], wide)], "counts": [counts[i:j][~one].astype(width).tobytes()]}

        return step

    return map_batches(blocks, make, _PIECE)


class Summary:
    """A Misra-Gries summary that others, or counted keys, are merged into."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        added = add_up(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.keys, self.counts, off = keep_largest(*added, self.capacity)
        self.taken += taken + off

    def may_reach(self, count: int) -> np.ndarray:
        """The keys that can occur ``count`` times."""
        return self.keys[self.counts + self.taken >= count]


def answer_part(pieces: list[dict], min_count: int) -> Iterator[dict]:
    """Merge a partition's pieces and answer each block with its surviving keys."""
    width = np.uint8 if min_count < 256 else np.uint32
    opened = lambda p: (unpack_keys(p["ones"], p["wide"]), unpack_keys(p["more"], p["wide"]), np.frombuffer(p["counts"], width).astype(np.int64))
    mass = sum(len(ones) + int(counts[counts < min_count].sum()) for ones, _, counts in map(opened, pieces))
    summary = Summary(SLACK * mass // min_count + 1)
    sure: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (ones, more, counts) in enumerate(map(opened, pieces)):
        sure.append(more[counts >= min_count])
        waiting += [(ones, np.ones(len(ones), np.int64)), (more[counts < min_count], counts[counts < min_count])]
        if i + 1 == len(pieces) or sum(len(k) for k, _ in waiting) >= summary.capacity:
            summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
            waiting = []
    alive = np.union1d(summary.may_reach(min_count), np.concatenate(sure))
    for piece in pieces:
        ones, more, _ = opened(piece)
        own = np.sort(np.concatenate([ones, more]))
        own = own[alive[np.minimum(np.searchsorted(alive, own), len(alive) - 1)] == own] if len(alive) else own[:0]
        yield {"part": piece["part"], "block": piece["block"], "keys": A.pack(np.diff(own.astype(np.int64), prepend=0)), "taken": summary.taken}


def surviving_keys(sent: DataFrame, min_count: int) -> DataFrame:
    """Partitions one after the other in a task, each held in packed form: a few bytes per key of a bounded mass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def answers() -> Iterator[pa.RecordBatch]:
            rows = list(answer_part(held, min_count))
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=arrow_schema(_ANSWER))

        for batch in batches:
            for piece in batch.to_pylist():
                if held and piece["part"] != held[0]["part"]:
                    yield from answers()
                    held = []
                held.append(piece)
        if held:
            yield from answers()

    return sent.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, _ANSWER)


class Counted(NamedTuple):
    """A block's surviving n-grams: number of the language, partition, phrase and count of each."""

    lang: np.ndarray
    part: np.ndarray
    phrases: list[bytes]
    counts: np.ndarray


def count_block(words: Words, keys: np.ndarray, longest: int, bits: int) -> Iterator[Counted]:
    """For n = 1, 2, ...: the block's n-grams whose key survived, counted by their words.

    An n-gram goes on from two of n - 1 words that survived, as a frequent one does.
    """
    number = np.full(len(words.ids) + 1, -1)  # of the (n-1)-gram that begins at a word
    spelt: list[bytes] = []
    for n, at, h in words.grams(longest):
        if n > 1:
            near = (number[at] >= 0) & (number[at + 1] >= 0)
            at, h = at[near], h[near]
        key = h >> _U(64 - bits)
        place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
        at, key = at[hit], key[hit]
        whole = words.ids[at] if n == 1 else number[at] * len(words.texts) + words.ids[at + n - 1]
        _, first, of, counts = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        before = spelt
        last = [words.texts[i] for i in words.ids[at[first] + n - 1].tolist()]
        spelt = last if n == 1 else [before[i] + b" " + w for i, w in zip(number[at[first]].tolist(), last, strict=True)]
        yield Counted(words.lang_of[words.ids[at[first]]], (key[first] >> _U(PART_BITS)).astype(np.int64), spelt, counts)
        number = np.full(len(words.ids) + 1, -1)
        number[at] = of


_COUNTED = "part long, lang string, phrases binary, counts binary"
_SUMMED = "lang string, phrase string, f long"
#: Phrases that wait to be added up.
WAITING = 1 << 20


def packed_counts(words: Words, keys: np.ndarray, longest: int, bits: int) -> Iterator[dict]:
    """A row per language and partition with all of the block's phrases there."""
    orders = list(count_block(words, keys, longest, bits))
    lang, part, counts = (np.concatenate([getattr(o, f) for o in orders]) for f in ("lang", "part", "counts"))
    phrases = [p for o in orders for p in o.phrases]
    by_text = np.array(sorted(range(len(phrases)), key=phrases.__getitem__), np.int64)
    if not len(by_text):
        return
    # Phrases in order within their row: most begin like the one before, which packs well.
    order = by_text[np.lexsort((part[by_text], lang[by_text]))]
    cell = np.stack([lang[order], part[order]])
    begin = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0)))
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        own = order[i:j]
        yield {"part": int(part[own[0]]), "lang": words.langs[lang[own[0]]], "phrases": zstandard.compress(b"\n".join([phrases[k] for k in own.tolist()])), "counts": A.pack(counts[own])}


def add_phrases(rows: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f): the counts of each partition's phrases added up, those of ``min_count`` at least."""
    out = arrow_schema(_SUMMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, size = None, [], 0

        def added() -> pa.Table:
            total = pa.concat_tables(waiting).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            return total.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

        def finished() -> list[pa.RecordBatch]:
            total = added()
            return total.filter(pc.greater_equal(total["f"], min_count)).cast(out).to_batches(1 << 16)

        for batch in batches:
            parts = batch.column("part").to_numpy()
            if not len(parts):
                continue
            begin = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(parts)], strict=True):
                if part != parts[i] and waiting:
                    yield from finished()
                    waiting, size = [], 0
                part, own = parts[i], batch.slice(i, j - i)
                for lang, phrases, counts in zip(*(own.column(c).to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
                    phrases = pa.array(zstandard.decompress(phrases).split(b"\n"), pa.binary()).cast(pa.string())
                    counts = pa.array(A.unpack(counts).astype(np.int64))
                    waiting.append(pa.table([pa.array([lang] * len(phrases), pa.string()), phrases, counts], ["lang", "phrase", "f"]))
                    size += len(phrases)
                if size >= WAITING:
                    waiting = [added()]
                    size = 0
        if waiting:
            yield from finished()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, _SUMMED)


def exact_counts(blocks: DataFrame, answers: DataFrame, longest: int, bits: int, min_count: int) -> DataFrame:
    """(lang, phrase, n_words, f): all phrases of up to ``longest`` words that occur ``min_count`` times, counted exactly."""
    schema = arrow_schema(_COUNTED)

    def count(block: pa.Table, answered: pa.Table) -> pa.Table:
        rows = sorted(zip(answered["part"].to_pylist(), answered["keys"].to_pylist(), strict=True))
        # A partition's keys come as steps from one to the next.
        keys = [np.cumsum(A.unpack(k), dtype=np.uint64) + (_U(p) << _U(PART_BITS)) for p, k in rows]
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        return pa.Table.from_pylist([x for row in block.to_pylist() for x in packed_counts(Words(row), keys, longest, bits)], schema=schema)

    asked = answers.select(F.col("block").alias("of_block"), "part", "keys")
    counted = blocks.groupBy("block").cogroup(asked.groupBy("of_block")).applyInArrow(count, _COUNTED)
    n_words = F.size(F.split("phrase", " "))
    return add_phrases(counted, min_count).select("lang", "phrase", n_words.alias("n_words"), "f")


def frequent_phrases(
    docs: DataFrame, min_count: int, longest: int = 5, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of frequent phrases of 1 to ``longest`` words, and (lang, n) with all words' number."""
    spark = docs.sparkSession
    held, summed, counted = (work_path(spark, f"phrase-{x}") for x in ("blocks", "words", "counts"))
    text_blocks(docs, text_col, lang_col, longest, block_words).write.parquet(held)
    blocks = spark.read.parquet(held)
    of = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("of"))
    # Written, so that Spark knows its size before it chooses a join.
    of.groupBy(F.col("of.langs").alias("lang")).agg(F.sum("of.lang_words").alias("n")).write.parquet(summed)
    bits = key_bits(blocks.agg(F.sum("mass")).first()[0] or 0)
    answers = surviving_keys(block_keys(blocks, longest, bits, min_count), min_count)
    exact_counts(blocks, answers, longest, bits, min_count).write.parquet(counted)
    return spark.read.parquet(counted), spark.read.parquet(summed)


def _exact(col: str, digits: int) -> Column:
    return F.col(col).cast(f"decimal({digits},0)")


def collocations(
    docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, inside_percent: int = 100,
    text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    The score is 1000 a n / (l r), rounded down, at the cut of the phrase where it is lowest. A phrase inside a longer
    one that occurs ``inside_percent`` % as often is left out. Counts up to 10**15 are computed without rounding.
    """
    counts, totals = frequent_phrases(docs, min_count, longest, text_col, lang_col, block_words)
    words = F.split("phrase", " ")
    some = counts.where(F.col("n_words") >= 2).select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))
    # Every cut of a phrase, with the counts of both parts: they are at least as frequent, so they are there.
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = some.select("lang", "phrase", "n_words", "a", "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    rated = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    rated = rated.withColumn("top", F.lit(1000).cast("decimal(4,0)") * _exact("a", 15) * _exact("n", 15)).withColumn("low", _exact("l", 15) * _exact("r", 15))
    rated = rated.withColumn("score", F.expr("top div low"))
    best = rated.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")
    ).select("lang", "phrase", "cut.*")
    # If a longer phrase covers one, so does every phrase between them: the two one word shorter suffice.
    longer = some.where(F.col("n_words") >= 3)
    inner = longer.select("lang", F.col("a").alias("outer"), F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), F.col("n_words") - 1), " "),
        F.array_join(F.slice("words", F.lit(2), F.col("n_words") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    covered = F.coalesce(F.lit(100) * F.col("outer") >= F.lit(inside_percent) * F.col("a"), F.lit(False))
    left = best.join(inner, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
