"""TF-IDF vectors of texts and exact top-k cosine search over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import block_count, cut_lineage

#: So many terms are broadcast (about 100 MB), the most frequent ones first; the others are joined by shuffle.
MAX_SHIPPED_TERMS = 2_000_000
#: Tasks that count the terms of one split of the texts (by default 128 MB in Parquet); postings take far more memory.
TASKS_PER_SPLIT = 4
#: Most query postings shipped to every executor (about 60 MB).
MAX_SHIPPED_POSTINGS = 2_000_000
#: Scores a task holds before it keeps only the best of them.
HELD_SCORES = 2_000_000


def terms_of(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, of any script, of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf). Texts are spread by id once; counting and later sums per id need no further shuffle.

    The number of tasks is set by the texts, as a task that Spark merges by the size of the texts would spill their postings."""
    rows = df.select(id_col, text)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_SPLIT * rows.rdd.getNumPartitions())
    rows = rows.repartition(tasks, id_col)
    return rows.select(id_col, F.explode(terms_of(text)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(df: DataFrame, text: str) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1, written out once.

    Each text's distinct terms are counted where the text lies, so only partial counts are shuffled.
    """
    n = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    found = df.select(F.explode(F.array_distinct(terms_of(text))).alias("term"))
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return cut_lineage(counted.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1))


def weigh(counts: DataFrame, weights: DataFrame, max_shipped: int = MAX_SHIPPED_TERMS) -> DataFrame:
    """Postings with the columns of ``weights``; terms without weights drop out.

    A vocabulary beyond the bound is split by frequency: as many of the most frequent terms as fit are broadcast, so that nearly
    all postings stay where their texts are, and only those of the rare terms meet their weights in a shuffle join.
    """
    if weights.count() <= max_shipped:
        return counts.join(F.broadcast(weights), "term")
    least, sent = None, 0
    # Different frequencies are few: at most the root of twice the postings.
    for row in sorted(weights.groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["df"]):
        sent += row["n"]
        if sent > max_shipped:
            break
        least = row["df"]
    # If more terms than fit share the highest frequency, none of them is frequent.
    often = F.col("df") >= least if least is not None else F.lit(False)
    few = F.broadcast(weights.where(often))
    # The sides of the second join look small to Spark, whatever their size.
    rest = counts.join(few, "term", "left_anti").join(weights.where(~often).hint("merge"), "term")
    return counts.join(few, "term").unionByName(rest)


def text_vectors(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Sparse TF-IDF rows (id, term, tf, weight) of a table of texts."""
    found = weigh(term_counts(df, id_col, text), term_weights(df, text))
    return found.select(id_col, "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def vector_norms(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )


def similar_texts(queries: DataFrame, query_id: str, docs: DataFrame, doc_id: str, k: int, text: str = "text",
                  max_shipped: int = MAX_SHIPPED_POSTINGS) -> DataFrame:
    """The ``k`` documents most similar to each query text: (query, doc, similarity, rank).

    Weights come from the documents. Each document's postings are scored against a block of query vectors,
    and a task hands on ``k`` documents per query, not pairs. Queries are shipped to the documents while their
    postings fit the checked bound; beyond it blocks of both meet in a co-group.
    """
    spark = docs.sparkSession
    weights = term_weights(docs, text)
    query_rows = weigh(term_counts(queries, query_id, text), weights).select(
        F.col(query_id).alias("q"), "term", (F.col("tf") * F.col("idf")).alias("weight")
    )
    asked = query_rows.select("term").distinct().withColumn("asked", F.lit(True))
    w = F.col("tf") * F.col("idf")
    doc_rows = weigh(term_counts(docs, doc_id, text), cut_lineage(weights.join(asked, "term", "left"))).groupBy(doc_id).agg(
        F.sqrt(F.sum(w * w)).alias("norm"),
        F.collect_list(F.when(F.col("asked"), F.struct("term", w.alias("w")))).alias("_hits"),
    ).where(F.size("_hits") > 0).select(doc_id, "norm", F.col("_hits.term").alias("terms"), F.col("_hits.w").alias("w"))
    schema = f"{query_id} bigint, {doc_id} bigint, similarity double"

    head = query_rows.limit(max_shipped + 1).toPandas()
    if len(head) <= max_shipped:
        shipped = spark.sparkContext.broadcast({c: head[c].to_list() for c in head.columns})

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(_QueryBlock(pd.DataFrame(shipped.value)), k)
            for batch in batches:
                best.add(batch, doc_id)
            yield best.rows(query_id, doc_id)

        tasks = max(block_count(spark), 2 * spark.sparkContext.defaultParallelism)
        found = doc_rows.coalesce(tasks).mapInPandas(scan, schema)
    else:
        chunks, parts = -(-query_rows.count() // max_shipped), block_count(spark)
        keys = ["_chunk", "_part"]
        left = query_rows.withColumn("_chunk", F.pmod(F.xxhash64("q"), F.lit(chunks))).withColumn("_part", _upto(parts))
        right = doc_rows.withColumn("_part", F.pmod(F.xxhash64(doc_id), F.lit(parts))).withColumn("_chunk", _upto(chunks))

        def pair(query_pdf: pd.DataFrame, doc_pdf: pd.DataFrame) -> pd.DataFrame:
            best = _Best(_QueryBlock(query_pdf), k)
            best.add(doc_pdf, doc_id)
            return best.rows(query_id, doc_id)

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), doc_id)
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


class _QueryBlock:
    """A block of query vectors, compressed by term."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        row, self.terms = pd.factorize(pdf["term"])
        self.ids, col = np.unique(pdf["q"].to_numpy(dtype=np.int64), return_inverse=True)
        weight = pdf["weight"].to_numpy(dtype=float)
        self.norms = np.sqrt(np.bincount(col, weights=weight**2, minlength=len(self.ids)))
        order = np.argsort(row, kind="stable")
        self.col, self.weight = col[order], weight[order]
        self.start = np.r_[0, np.cumsum(np.bincount(row, minlength=len(self.terms)))]

    def dots(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot product of one sparse document, by term positions, with every query."""
        width = self.start[at + 1] - self.start[at]
        source = np.repeat(np.arange(len(at)), width)
        cell = self.start[at][source] + np.arange(len(source)) - np.repeat(np.cumsum(width) - width, width)
        return np.bincount(self.col[cell], weights=weights[source] * self.weight[cell], minlength=len(self.ids))


class _Best:
    """Running best ``k`` documents per query of a block."""

    def __init__(self, block: _QueryBlock, k: int) -> None:
        self.block, self.k = block, k
        self.place = pd.Index(block.terms)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.least = np.zeros(len(block.ids))  # k-th best so far per query
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, docs: pd.DataFrame, doc_id: str) -> None:
        if not len(docs) or not len(self.block.ids):
            return
        ends = np.cumsum(docs["terms"].map(len).to_numpy())
        at = self.place.get_indexer(np.concatenate(docs["terms"].to_list()))
        weight = np.concatenate(docs["w"].to_list()).astype(float)
        for doc, norm, lo, hi in zip(docs[doc_id], docs["norm"], np.r_[0, ends[:-1]], ends):
            known = at[lo:hi] >= 0
            dots = self.block.dots(at[lo:hi][known], weight[lo:hi][known])
            sims = np.round(dots / (self.block.norms * norm), 9)
            hit = np.flatnonzero((sims > 0) & (sims >= self.least))
            self.held.append((hit, np.full(len(hit), doc, dtype=np.int64), sims[hit]))
            self.size += len(hit)
            if self.size > max(HELD_SCORES, 2 * self.k * len(self.block.ids)):
                self._settle()

    def _settle(self) -> None:
        self.best, self.held, self.size = _best_of(self.best, self.held, self.k), [], 0
        full = np.bincount(self.best[0], minlength=len(self.block.ids)) >= self.k
        low = np.full(len(self.block.ids), np.inf)
        np.minimum.at(low, self.best[0], self.best[2])
        self.least = np.where(full, low, 0.0)

    def rows(self, query_id: str, doc_id: str) -> pd.DataFrame:
        self._settle()
        rows, docs, sims = self.best
        return pd.DataFrame({query_id: self.block.ids[rows], doc_id: docs, "similarity": sims})


def _best_of(best: tuple, held: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, docs, sims = (np.concatenate(parts) for parts in zip(best, *held))
    order = np.lexsort((docs, -sims, q))
    q, docs, sims = q[order], docs[order], sims[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], docs[keep], sims[keep]
