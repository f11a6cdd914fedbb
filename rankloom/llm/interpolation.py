"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

Training documents are counted whole. A share of them is deleted from the counts in turn: maximum-likelihood
estimates ``f(w|v) = c(v,w) / c(v)`` and ``f(w) = c(w) / N`` are taken from the rest, and the weights that mix them
with ``1 / (V + 1)`` are learned by expectation-maximisation on the deleted part's counts. There is one set of
weights for each bucket of contexts, by the power of two of the context's count. The model then uses the
counts of all training documents. It gives every known word and one unknown word a probability; they sum to 1.

Tokens are runs of bytes other than ASCII white space, A-Z in lower case, then one end per text; tokens and
bigrams are 64-bit hashes. Tasks hold the corpus in blocks of a few MB; counts travel as described in
``exchange``: each block sends its distinct tokens and bigrams once and gets their sums over the whole corpus
back. EM runs on counts of the deleted tokens by (bucket, ratio of each estimate to the uniform one in quarter
octaves): all tokens, and a table whose size does not depend on the corpus.

Defined cases: null texts count as empty (one token, the end); null ids are kept; repeated rows are separate
texts; without training rows every token has probability 1; without deleted rows the weights are equal; an
empty table gives an empty result. Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm import exchange as X
from rankloom.llm.common import arrow_schema
from rankloom.session import work_path

#: Bytes of text in a block.
BLOCK_BYTES = 10 << 20
#: What a row of the corpus is for: counted, counted and deleted in turn, only scored.
RETAINED, DELETED, SCORED = 0, 1, 2
_U = np.uint64
START, END = _U(0x53544152545F5F5F), _U(0x454E445F5F5F5F5F)
#: Steps per octave and offset of the ratios' bins; bin 0 is an estimate of zero.
_STEPS, _OFFSET = 4, 400
BLOCK = "block long, kind int, ids array<long>, sizes binary, words binary, codes binary, n_words long, n_tokens long"
SCORE = "id long, kind int, n_tokens long, n_known long, base_score double, score double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one kind, tokenised, as blocks: distinct token hashes, and every token as its place among them."""
    task, number = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {kind: [0, [], [], []] for kind in (RETAINED, DELETED, SCORED)}

    def flush(kind: int) -> pa.RecordBatch:
        nonlocal number
        _, ids, sizes, tokens = held[kind]
        held[kind] = [0, [], [], []]
        line = np.concatenate(tokens)
        words, codes = np.unique(line, return_inverse=True)
        number += 1
        return X.rows_batch([{
            "block": (task << 32) + number, "kind": kind, "ids": ids, "sizes": A.pack(np.concatenate(sizes)),
            "words": X.pack_sorted(words), "codes": A.pack(codes.astype(np.uint32)), "n_words": len(words), "n_tokens": len(line),
        }], BLOCK)

    for batch in batches:
        for part in A.slices(batch, "text"):
            h, first = A.word_hashes(part.column("text"))
            sizes = np.diff(first) + 1
            kinds = np.asarray(part.column("kind"))
            line = np.empty(sizes.sum(), np.uint64)
            last = np.zeros(len(line), bool)
            last[np.cumsum(sizes) - 1] = True
            line[~last], line[last] = h, END
            of = np.repeat(kinds, sizes)
            ids = part.column("id").to_pylist()
            lengths = np.diff(A.utf8(part.column("text"))[1])
            for kind in held:
                mine = kinds == kind
                if mine.any():
                    box = held[kind]
                    box[0] += int(lengths[mine].sum()) + int(mine.sum())
                    box[1].extend(i for i, m in zip(ids, mine.tolist(), strict=True) if m)
                    box[2].append(sizes[mine])
                    box[3].append(line[of == kind])
                    if box[0] >= BLOCK_BYTES:
                        yield flush(kind)
    for kind in held:
        if held[kind][1]:
            yield flush(kind)


def _open(row: dict[str, Any]) -> dict[str, Any]:
    """A block's tokens: places of their words, their bigrams' hashes, and the bounds of the texts."""
    words, codes = X.unpack_sorted(row["words"]), A.unpack(row["codes"])
    sizes = A.unpack(row["sizes"]).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    line = words[codes]
    before = np.empty_like(line)
    before[1:] = line[:-1]
    before[first] = START
    pairs = A.mix(before * _U(0x2545F4914F6CDD1D) + line)
    return {"words": words, "codes": codes, "sizes": sizes, "first": first, "pairs": pairs}


def _ask(word_parts: int, pair_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _open(row)
                counts = np.bincount(block["codes"], minlength=len(block["words"]))
                pairs, n = np.unique(block["pairs"], return_counts=True)
                yield X.rows_batch(list(X.request(0, row["block"], row["kind"], block["words"], counts, word_parts)), X.REQUEST)
                yield X.rows_batch(list(X.request(1, row["block"], row["kind"], pairs, n, pair_parts)), X.REQUEST)

    return run


def _counts(row: dict[str, Any], answers: pa.Table, retained: bool) -> dict[str, np.ndarray]:
    """For each token of a block the counts of its word, of the word before (documents at a text's start) and of both."""
    block = _open(row)
    _, of_pair = np.unique(block["pairs"], return_inverse=True)
    word, pair = (X.collected(answers, s, "total") for s in (0, 1))
    if retained:
        word, pair = word - X.collected(answers, 0, "marked"), pair - X.collected(answers, 1, "marked")
    of_token = word[block["codes"]]
    context = np.empty_like(of_token)
    context[1:] = of_token[:-1]
    # A text starts as often as one ends.
    context[block["first"]] = word[np.searchsorted(block["words"], END)]
    return block | {"word": of_token, "context": context, "pair": pair[of_pair]}


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _bin(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.rint(np.log2(np.where(ratio > 0, ratio, 1.0)) * _STEPS).astype(np.int64) + _OFFSET, 0)


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = 100) -> dict[int, np.ndarray]:
    """EM per bucket on (bucket, bigram bin, unigram bin, count): weights of the bigram, unigram and uniform estimate."""
    if not cells:
        return {}
    table = np.array(cells, np.int64)
    ratio = lambda b: np.where(b > 0, 2.0 ** ((b - _OFFSET) / _STEPS), 0.0)
    values = np.stack([ratio(table[:, 1]), ratio(table[:, 2]), np.ones(len(table))], 1)
    n = table[:, 3].astype(float)

    def em(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = values[rows] * weights
            share /= share.sum(1, keepdims=True)
            weights = (share * n[rows, None]).sum(0) + prior
            weights /= weights.sum()
        return weights

    pooled = em(np.arange(len(table)), np.full(3, 1.0))
    return {-1: pooled} | {int(b): em(np.flatnonzero(table[:, 0] == b), pooled) for b in np.unique(table[:, 0])}


def _weight_table(learned: dict[int, np.ndarray]) -> np.ndarray:
    """Weights by bucket. An unseen context has no bigram estimate, so its weights are shared by the other two."""
    table = np.tile(learned.get(-1, np.full(3, 1 / 3)), (66, 1))
    for bucket, weights in learned.items():
        if bucket >= 0:
            table[bucket] = weights
    table[0, 0] = 0.0
    table[0] /= table[0].sum()
    return table


def score_texts(
    docs: DataFrame, train: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``id``, ``trained``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams) and ``score``, both log10 probabilities of the whole text. ``train``: the rows to learn from;
    ``deleted``: which of these the weights are learned on."""
    spark = docs.sparkSession
    kind = F.when(~train, SCORED).when(deleted, DELETED).otherwise(RETAINED)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), kind.cast("int").alias("kind"))
    blocks_path, answers_path = work_path(spark, "lm-blocks"), work_path(spark, "lm-counts")
    rows.mapInArrow(_blocks, BLOCK).write.parquet(blocks_path)
    blocks = spark.read.parquet(blocks_path)
    entries = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    asked = blocks.mapInArrow(_ask(X.parts_for(entries[0] or 0), X.parts_for((entries[1] or 0) * 2 // 3)), X.REQUEST)
    X.answer(asked).write.parquet(answers_path)
    answers = spark.read.parquet(answers_path)
    total = answers.where((F.col("block") == X.SUMMARY) & (F.col("space") == 0)).agg(F.sum("known"), F.sum("tokens"), F.sum("marked_tokens")).first()
    distinct, tokens, held = (int(x or 0) for x in total)
    uniform = 1.0 / (distinct + 1)

    def cells(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            c = _counts(row, right, retained=True)
            pair = c["pair"] / np.maximum(c["context"], 1) / uniform
            word = c["word"] / max(1, tokens - held) / uniform
            key = np.stack([_bucket(c["context"]), _bin(pair), _bin(word)], 1)
            keys, n = np.unique(key[:, 0] << 40 | key[:, 1] << 20 | key[:, 2], return_counts=True)
            found.append((keys, n))
        keys, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"cell": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    part = lambda k: blocks.where(F.col("kind") == k).groupBy("block").cogroup(answers.where(F.col("kind") == k).groupBy("block"))
    counted = part(DELETED).applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    mask = (1 << 20) - 1
    weights = _weight_table(learn_weights(sorted((r.cell >> 40, (r.cell >> 20) & mask, r.cell & mask, r.n) for r in counted)))

    def score(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            c = _counts(row, right, retained=False)
            w = weights[_bucket(c["context"])]
            p = w[:, 0] * (c["pair"] / np.maximum(c["context"], 1)) + w[:, 1] * (c["word"] / max(1, tokens)) + w[:, 2] * uniform
            p = np.log10(p if tokens else np.ones(len(p)))
            base = np.log10((c["word"] + 1) / (tokens + distinct + 1))
            add = lambda x: np.add.reduceat(x, c["first"])  # noqa: B023, E731
            parts.append(pa.table({
                "id": pa.array(row["ids"], pa.int64()), "kind": pa.array(np.full(len(c["sizes"]), row["kind"]), pa.int32()),
                "n_tokens": pa.array(c["sizes"]), "n_known": pa.array(add((c["word"] > 0).astype(np.int64))),
                "base_score": pa.array(add(base)), "score": pa.array(add(p)),
            }))
        return pa.concat_tables(parts) if parts else arrow_schema(SCORE).empty_table()

    scored = blocks.groupBy("block").cogroup(answers.where(F.col("block") != X.SUMMARY).groupBy("block")).applyInArrow(score, SCORE)
    return scored.select(
        "id", (F.col("kind") != SCORED).alias("trained"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
