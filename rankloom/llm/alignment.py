"""Alignment of the tokens of two tokenizers through sparse matrices.

A token's row in an incidence matrix has a one in the column of every byte that it covers (or in that of the group
that it belongs to). With A's and B's matrices over the same bytes, the row products of A and B transposed, by
Gustavson's rule, link every pair of overlapping tokens with the number of bytes that they share; the product of the group
matrices links all pairs that share a group. Groups are what the offsets where tokens of both end cut out. Matrices
are compressed rows of plain integer arrays, built here.

Texts are cut before a single blank between two visible characters. No token of either tokenizer reaches over
such a place (A's pattern starts a piece there; B's vocabulary is searched for a piece with a blank behind another
character, and if it has one texts stay whole), so a text's tokens are those of its parts one after the other. A task
encodes and aligns each different part once, many of them strung together with blanks, while they fit a bounded memory
that starts anew when it is full; two parts count as one with a chance of 2**-64 per pair.

Corpus-wide counts: a block has one row per different pair of ids. Sums go back to the blocks by a join on the
pair, so what is shuffled grows with the blocks and a pair that every text holds is one row per block.

Defined cases: texts that are null or empty, or whose tokens do not spell a blank and the text, have no tokens: zeros
and the empty string; rows are judged one by one, so repeated ids and rows stay; an empty table gives an empty
result. Only the id and the text are read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm.common import arrow_schema, map_batches
from rankloom.session import work_path

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Characters that are encoded at once and bytes that one matrix product covers, about; parts that a task remembers.
STRING, SPAN, MEMORY = 1 << 16, 1 << 17, 400_000
#: Parts that are aligned at once.
STEP = 1 << 14
#: A pair of ids as one number: A's id times this plus B's.
PAIR = 1 << 24


class Csr(NamedTuple):
    """A sparse matrix by compressed rows."""

    start: np.ndarray  # where each row's entries begin, one more at the end
    column: np.ndarray
    value: np.ndarray
    n_columns: int

    @property
    def row(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def from_entries(row: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, n_columns: int) -> Csr:
    """Entries in any order; those of one cell are added up."""
    cell = row.astype(np.int64) * max(n_columns, 1) + column
    if len(cell) > 1 and not (cell[1:] > cell[:-1]).all():
        cell, where = np.unique(cell, return_inverse=True)
        value = np.bincount(where, value, len(cell)).astype(np.int64)
    row = cell // max(n_columns, 1)
    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
    return Csr(start, cell - row * max(n_columns, 1), value, n_columns)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.column, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(m.column, minlength=m.n_columns))])
    return Csr(start, m.row[order], m.value[order], len(m.start) - 1)


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every run, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def product(a: Csr, b: Csr) -> Csr:
    """Row by row: each entry of a row of ``a`` scales the row of ``b`` that its column names, and they are added up."""
    length = np.diff(b.start)[a.column]
    picked = runs(b.start[a.column], length)
    return from_entries(np.repeat(a.row, length), b.column[picked], np.repeat(a.value, length) * b.value[picked], len(a.start) - 1, b.n_columns)


def byte_incidence(ends: np.ndarray) -> Csr:
    """Tokens that stand one after the other, by the bytes that they cover."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(total), np.ones(total, np.int64), total)


def group_incidence(ends: np.ndarray, common: np.ndarray) -> Csr:
    """Tokens by their group: the one that the first common end at or after theirs closes."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(common, ends), np.ones(len(ends), np.int64), len(common))


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: the number of bytes that they share."""
    return product(byte_incidence(ends_a), transposed(byte_incidence(ends_b)))


def group_links(ends_a: np.ndarray, ends_b: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: one where they share a group."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return product(group_incidence(ends_a, common), transposed(group_incidence(ends_b, common)))


def end_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The overlap links whose two tokens end at the same byte. No link reaches over an end that both have, so the
    product is taken between such ends, about ``SPAN`` bytes at a time."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    stops = common[np.unique(np.searchsorted(common, np.arange(SPAN, int(common[-1]) + SPAN, SPAN)).clip(max=len(common) - 1))] if len(common) else common
    rows, columns, low, i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0, 0
    for stop in stops.tolist():
        upto_a, upto_b = int(np.searchsorted(ends_a, stop, "right")), int(np.searchsorted(ends_b, stop, "right"))
        own_a, own_b = ends_a[i:upto_a] - low, ends_b[j:upto_b] - low
        links = overlap_links(own_a, own_b)
        row = links.row
        same = own_a[row] == own_b[links.column]
        rows.append(row[same] + i)
        columns.append(links.column[same] + j)
        low, i, j = stop, upto_a, upto_b
    return np.concatenate(rows), np.concatenate(columns)


class Vocabularies(NamedTuple):
    """The two tokenizers as their files' contents, so that tasks need no file."""

    byte_level: str
    pieces: bytes


def read_vocabularies(folder: str, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> Vocabularies:
    return Vocabularies(Path(folder, byte_level).read_text("utf-8"), Path(folder, pieces).read_bytes())


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell visible Latin-1 bytes as themselves and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens(NamedTuple):
    """Tokens of parts one after the other; parts that are not sound have none."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Encoders:
    """Both tokenizers in a task: encode parts of texts, each with a blank before it, to ids and token bytes."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.pieces)
        byte, special = _byte_of_character(), {t["content"] for t in json.loads(vocabularies.byte_level)["added_tokens"]}
        self.bytes_a = {i: t.encode() if t in special else bytes(byte[c] for c in t) for t, i in self.a.get_vocab().items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.length_b = np.array(list(map(len, self.bytes_b)))
        #: Whether texts may be cut at blanks: no piece has a blank behind another character.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def spell(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of a blank and the text; nothing if they do not spell it."""
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def encode(self, parts: list[str], plain: np.ndarray) -> Tokens:
        """Both tokenizers over parts, each with a blank before it. ``plain`` parts begin and end with visible characters,
        so that they can be strung together."""
        n_a, n_b = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        sound, all_a, all_b = np.zeros(len(parts), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def take(i: int, j: int) -> None:
            coded = self.spell(" ".join(parts[i:j]))
            if coded is None:
                for k in range(i, j) if j - i > 1 else ():
                    take(k, k + 1)
                return
            bounds = np.cumsum([len(p.encode()) + 1 for p in parts[i:j]])
            for ids, length, n, out in ((coded[0], self.length_a, n_a, all_a), (coded[1], self.length_b, n_b, all_b)):
                n[i:j] = np.diff(np.searchsorted(np.cumsum(length[ids]), bounds, "right"), prepend=0)
                out.append(ids)
            sound[i:j] = True

        i = 0
        while i < len(parts):
            j, size = i + 1, len(parts[i])
            while plain[i] and j < len(parts) and plain[j] and size < STRING:
                j, size = j + 1, size + len(parts[j])
            take(i, j)
            i = j
        return Tokens(sound, n_a, n_b, np.concatenate(all_a), np.concatenate(all_b))


def visible(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte begins, and whether it ends, a visible character: ASCII, or a Latin letter of two bytes."""
    plain = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xC9)
    ends = plain.copy()
    ends[1:] |= lead[:-1]
    return plain | lead, ends


def part_starts(data: np.ndarray, bounds: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each text's parts, and the number of each text's first part (one more at the end).

    A part begins after a blank that stands between two visible characters.
    """
    n = len(data)
    texts = np.flatnonzero(np.diff(bounds))
    starts, ends = bounds[:-1][texts], bounds[1:][texts]
    if cut and n > 2:
        begins, ends_one = visible(data)
        blank = np.flatnonzero((data[1:-1] == 0x20) & ends_one[:-2] & begins[2:]) + 1
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        # The blank and both neighbours belong to one text.
        blank = blank[~edge[blank] & ~edge[blank + 1]]
        starts, ends = np.sort(np.concatenate([starts, blank + 1])), np.sort(np.concatenate([ends, blank]))
    return starts, ends, np.searchsorted(starts, bounds)


class Parts(NamedTuple):
    """Different parts, aligned: counts, spelt groups, and the links by part."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    n_links: np.ndarray
    links: np.ndarray  # pairs of ids, part by part


def align_parts(encoders: Encoders, parts: list[str], plain: np.ndarray) -> Parts:
    """All parts laid end to end, so that matrix products cover many at once."""
    sound, n_a, n_b, a, b = encoders.encode(parts, plain)
    ends_a, ends_b = np.cumsum(encoders.length_a[a]), np.cumsum(encoders.length_b[b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = group_incidence(ends_a, common), group_incidence(ends_b, common)
    of_part = np.repeat(np.arange(len(parts)), n_a)
    per_group = np.zeros(len(common), np.int64)
    per_group[group_a.column] = of_part
    n_groups = np.bincount(per_group, minlength=len(parts))
    # The spelt groups: ids of A and of B by the group's column.
    spelt = []
    for m, ids in ((transposed(group_a), a), (transposed(group_b), b)):
        names = list(map(str, ids[m.column].tolist()))
        spelt.append([names[i] if j == i + 1 else ",".join(names[i:j]) for i, j in zip(m.start[:-1].tolist(), m.start[1:].tolist(), strict=True)])
    both = [f"{x}|{y}" for x, y in zip(*spelt, strict=True)]
    upto = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    row, column = end_links(ends_a, ends_b)
    n_links = np.bincount(of_part[row], minlength=len(parts))
    return Parts(sound, n_a, n_b, n_groups, [";".join(both[i:j]) for i, j in zip(upto, upto[1:], strict=False)], n_links, a[row] * PAIR + b[column])


def different_parts(batch: pa.RecordBatch, column: str, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The number of each text's first part, each part's number among the different ones, and of these the hashes, the
    texts, and whether they begin and end with visible characters."""
    firsts, starts, ends, hashes, plain, at = [np.zeros(1, np.int64)], [], [], [], [], 0
    for piece in A.slices(batch, column):
        data, bounds = A.utf8(piece.column(column))
        start, end, first = part_starts(data, bounds, cut)
        firsts.append(first[1:] + firsts[-1][-1])
        hashes.append(A.span_hash(A.prefix_hash(data, A.EXACT), start, end))
        begins, ends_one = visible(data)
        plain.append(begins[start] & ends_one[end - 1] & cut)
        starts.append(start + at)
        ends.append(end + at)
        at += len(data)
    join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
    every, where, number = np.unique(join(hashes, np.uint64), return_index=True, return_inverse=True)
    raw, bounds = A.utf8(batch.column(column))[0].tobytes(), zip(join(starts, np.int64)[where].tolist(), join(ends, np.int64)[where].tolist(), strict=True)
    return np.concatenate(firsts), number, every, [raw[i:j].decode() for i, j in bounds], join(plain, bool)[where]


class Memory:
    """What a task has aligned, by the parts' hashes."""

    def __init__(self, encoders: Encoders) -> None:
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        zero = np.zeros(0, np.int64)
        self.known = Parts(np.zeros(0, bool), zero, zero, zero, [], zero, zero)

    def look_up(self, hashes: np.ndarray, parts: list[str], plain: np.ndarray) -> tuple[np.ndarray, Parts]:
        """Where each part stands among the known ones."""
        if len(self.hashes) + len(hashes) > MEMORY:
            self.forget()
        new = np.flatnonzero(~np.isin(hashes, self.hashes, assume_unique=True))
        new = new[np.argsort(~plain[new], kind="stable")]  # those that can be strung together side by side
        found = [self.known]
        for i in range(0, len(new), STEP):
            own = new[i : i + STEP]
            found.append(align_parts(self.encoders, [parts[k] for k in own.tolist()], plain[own]))
        if len(new):
            self.known = Parts(*[[y for x in column for y in x] if isinstance(column[0], list) else np.concatenate(column) for column in zip(*found, strict=True)])
            self.place = np.concatenate([self.place, len(self.place) + np.arange(len(new))])
            self.hashes = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(self.hashes)
            self.hashes, self.place = self.hashes[order], self.place[order]
        return self.place[np.searchsorted(self.hashes, hashes)], self.known


_DOC = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"
_BLOCK = f"{_DOC}, pairs array<long>, counts array<long>"


def _block_rows(memory: Memory, block: int, batch: pa.RecordBatch) -> dict:
    """A row per text and one for the block with its pairs and their counts."""
    first, number, *found = different_parts(batch, "text", memory.encoders.cuts)
    place, known = memory.look_up(*found)
    n = batch.num_rows
    of_text = np.repeat(np.arange(n), np.diff(first))
    at = place[number]
    sound = (np.diff(first) > 0) & (np.bincount(of_text, ~known.sound[at], n) == 0)
    total = lambda per_part: np.where(sound, np.bincount(of_text, per_part[at], n), 0).astype(np.int64)
    # Texts by parts times parts by pairs of ids: the pairs that each sound text links.
    n_links = known.n_links[place]
    picked = runs((np.cumsum(known.n_links) - known.n_links)[place], n_links)
    pairs, pair = np.unique(known.links[picked], return_inverse=True)
    linked = from_entries(np.repeat(np.arange(len(place)), n_links), pair, np.ones(len(pair), np.int64), len(place), len(pairs))
    own = sound[of_text]
    held = from_entries(of_text[own], number[own], np.ones(int(own.sum()), np.int64), n, len(place))
    links = product(held, linked)
    digests = []
    for ok, i, j in zip(sound.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        digests.append(hashlib.sha256(";".join([known.groups[k] for k in at[i:j].tolist()]).encode()).hexdigest() if ok else "")
    cuts = list(zip(links.start[:-1].tolist(), links.start[1:].tolist(), strict=True))
    counts = np.bincount(links.column, links.value, len(pairs)).astype(np.int64)
    seen = counts > 0  # pairs of texts that turned out unsound count nowhere
    column = (np.cumsum(seen) - 1)[links.column]
    row = lambda per_text: [*per_text.tolist(), 0]
    return {
        "block": [block] * (n + 1), "doc_id": [*batch.column("doc_id").to_pylist(), None],
        "n_a": row(total(known.n_a)), "n_b": row(total(known.n_b)), "n_groups": row(total(known.n_groups)),
        "n_links": row(total(known.n_links)), "groups_sha256": [*digests, ""],
        "links": [A.pack(column[i:j]) for i, j in cuts] + [b""], "times": [A.pack(links.value[i:j]) for i, j in cuts] + [b""],
        "pairs": [None] * n + [pairs[seen]], "counts": [None] * n + [counts[seen]],
    }


def _score(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """A block's texts with the corpus-wide figures of its pairs."""
    n_best, count_sum = [], []
    if sums.num_rows:
        order = np.argsort(sums["place"].to_numpy())
        total, top = sums["total"].to_numpy()[order], sums["top"].to_numpy()[order]
    for links, times in zip(docs["links"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, many = A.unpack(links).astype(np.int64), A.unpack(times).astype(np.int64)
        n_best.append(int((top[at] * many).sum()) if len(at) else 0)
        count_sum.append(int((total[at] * many).sum()) if len(at) else 0)
    same = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return same.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def align_documents(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts of tokens, groups and links, how many links are among the best of their B id, the sum of their
    corpus-wide counts, and the digest of the groups."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabularies)  # two vocabulary files, 3 MB

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        memory = Memory(Encoders(sent.value))
        numbers = iter(range(1 << 31))
        task = TaskContext.get().partitionId() << 31

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for piece in A.slices(batch, "text", BLOCK_BYTES):
                yield _block_rows(memory, task + next(numbers), piece)

        return step

    path = work_path(spark, "token-links")
    map_batches(_rows(docs, id_col, text_col), make, _BLOCK).write.parquet(path)
    held = spark.read.parquet(path)
    pairs = held.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "of"))
    pairs = pairs.select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % PAIR)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    ranked = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("top"))
    sums = pairs.select(F.col("block").alias("of_block"), "place", "pair").join(ranked, "pair").select("of_block", "place", "total", "top")
    texts = held.where(F.col("pairs").isNull()).select(*[f.split()[0] for f in _DOC.split(", ")])
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(sums.groupBy("of_block")).applyInArrow(_score, out)


#: Ways to link tokens of a text: bytes that they share, a group that they share, ends in common.
LINKS = {"overlap": overlap_links, "group": group_links}


def token_links(docs: DataFrame, vocabularies: Vocabularies, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the ids of both tokenizers and the links between their places, each with its weight (the shared bytes, or
    one for a shared group); empty lists for texts without tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)
    schema = "doc_id long, a array<int>, b array<int>, a_place array<int>, b_place array<int>, weight array<int>"

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        encoders = Encoders(sent.value)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for piece in A.slices(batch, "text"):
                first, number, _, parts, plain = different_parts(piece, "text", encoders.cuts)
                sound, n_a, n_b, a, b = encoders.encode(parts, plain)
                begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
                rows: dict[str, list] = {f.name: [] for f in arrow_schema(schema)}
                rows["doc_id"] = piece.column("doc_id").to_pylist()
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = number[i:j] if sound[number[i:j]].all() else number[:0]
                    own_a, own_b = a[runs(begin_a[own], n_a[own])], b[runs(begin_b[own], n_b[own])]
                    links = LINKS[kind](np.cumsum(encoders.length_a[own_a]), np.cumsum(encoders.length_b[own_b]))
                    for name, values in (("a", own_a), ("b", own_b), ("a_place", links.row), ("b_place", links.column), ("weight", links.value)):
                        rows[name].append(values.astype(np.int32))
                yield rows

        return step

    return map_batches(_rows(docs, id_col, text_col), make, schema)
