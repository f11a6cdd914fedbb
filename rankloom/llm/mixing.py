"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target number of words. A document of a source with target ``T`` and size ``S`` is
wanted ``T / S`` times on average: the whole part is allocated as certain copies, and the words that are still wanted
come from a Pareto sample with unequal probabilities. A document's inclusion probability ``p`` follows its size class
(the power of two below its size): ``p = min(1, rate * class)``, with the source's rate such that the expected words are
the wanted ones; what classes at 1 leave is shared by the others. Long documents are likelier, so fewer of them make up
the words, and the sum is steadier than with equal odds.

Documents are ranked by random odds over inclusion odds, ``q = (u / (1 - u)) / (p / (1 - p))``, with ``u`` from a hash of
the id, and the first are taken until the size, fixed in words, is reached: the last document enters if that brings the
sum nearer to the target. The rank is kept as ``q / (1 + q)``, which is between 0 (``p = 1``, always in) and 1 (``p = 0``,
never in).

Sizes meet in sums per (source, size class), then per (source, block of the rank), so a source with a third of all rows
costs a few rows. Only the block in which a source's sample closes is ordered row by row; near the middle, where samples
close, ranks are no denser than ``u`` is. What comes back to the documents is one row per source and class, sent to every
task while the counted sources are at most ``MAX_SENT_SOURCES``, so that texts are not shuffled; beyond that it is a
join that Spark can split.

Defined cases: null text or size counts 0 words, and such a document is taken 0 times words; a null source
is a source of its own, the last one; a null id hashes like an empty one; rows that are equal are separate
documents with equal rank, ordered by size; an empty table gives an empty result. Columns of the input are
kept in a struct until the end, so any names may occur; the added columns replace input columns of equal name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import columns
from rankloom.session import cut_lineage

#: Runs of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of the rank that sums are kept for.
BLOCKS = 4096
#: Sources up to which their limits (a name and ten numbers for each of a few size classes) are sent to every task.
MAX_SENT_SOURCES = 5_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_of(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest; the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Target words per source: shares of ``share`` times all words by weight, none above ``cap`` times its source.

    ``sources`` has one row per source (``source``, ``source_size``). The level ``l`` at which ``weight * l`` uses
    up the words that capped sources leave is found from prefix sums along ``source_size / weight``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    weighed = sources.withColumn("weight", F.array(*[F.lit(int(w)) for w in weights])[place].cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("source_size").over(below), F.lit(0)) * F.lit(float(cap))
    ) / F.sum("weight").over(rest)
    placed = weighed.withColumn("level", level).withColumn(
        "capped", F.col("level") * F.col("weight") > F.col("source_size") * F.lit(float(cap))
    )
    final = F.min_by(
        F.when(~F.col("capped"), F.col("level")),
        F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")),
    ).over(everything)
    target = F.when(F.col("capped"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * F.col("final"))
    return placed.withColumn("final", final).select("source", "source_size", target.alias("target"))


def inclusion_rates(cells: DataFrame) -> DataFrame:
    """Inclusion probability per source and size class.

    ``cells`` has one row per (``source``, ``class``) with the class's ``words`` and the source's ``wanted`` words. The
    rate at which the expected words are the wanted ones, with the largest classes at 1, is found from prefix sums along
    the class: a source has as many rows as its sizes have bits.
    """
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    above, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    weight = F.col("words").cast("decimal(20,0)") * F.col("class").cast("decimal(17,0)")
    left = F.col("wanted") - F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")
    tried = cells.withColumn("_rate", F.try_divide(left, F.sum(weight).over(rest).cast("double")))
    full = F.coalesce(F.col("_rate") * F.col("class") >= 1, F.lit(False))
    # The largest class that is not full sets the rate of all below it.
    rate = F.max_by(F.when(~full, F.greatest("_rate", F.lit(0.0))), F.when(~full, F.col("class"))).over(Window.partitionBy("source"))
    return tried.withColumn("p", F.when(full, 1.0).otherwise(F.least(F.coalesce(rate, F.lit(0.0)) * F.col("class"), F.lit(1.0)))).drop("_rate")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    size_col: str | None = None,
    with_p: bool = False,
) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (``copies * size`` words).

    ``size_col``: words counted before, then texts are not read. ``with_p``: also ``p``, the inclusion probability of the
    copy that is not certain.
    """
    u = F.col("_u")
    the = dict(zip(("id", "source", "size"), columns([id_col, source_col, size_col or text_col]), strict=True))
    size = F.coalesce(the["size"].cast("long"), F.lit(0).cast("long")) if size_col else word_count(the["size"])
    rows = docs.select(
        F.struct("*").alias("_doc"), the["source"].alias("_source"), the["id"].alias("_id"), size.alias("_size"), random_of(the["id"], seed).alias("_u"),
    ).withColumn("_class", F.when(F.col("_size") > 0, F.expr("shiftleft(1L, length(bin(_size)) - 1)")).otherwise(F.lit(0).cast("long")))

    # Sizes are counted once for all that follows but the last step, which reads the documents themselves.
    sizes = cut_lineage(rows.select("_source", "_id", "_size", "_class", "_u"))
    cells = cut_lineage(sizes.groupBy(F.col("_source").alias("source"), F.col("_class").alias("class")).agg(F.sum("_size").alias("words")))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        source_targets(sources, weights, share, cap)
        .withColumn("certain", F.floor(copies))
        .withColumn("wanted", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "p_source")
    )
    rates = cut_lineage(
        inclusion_rates(cells.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source"))
    )
    # One row per source and class. Sent to every task while sources are few, so that nothing is shuffled for it.
    few = sources.limit(MAX_SENT_SOURCES + 1).count() <= MAX_SENT_SOURCES

    def with_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
        return df.join(F.broadcast(limits) if few else limits, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_class") == F.col("class")))

    p, rank = F.col("p"), F.col("_rank")
    odds_share = (u * (1 - p)) / (u * (1 - p) + p * (1 - u))
    ranked = with_limits(sizes, rates).withColumn("_rank", odds_share).withColumn("_block", F.floor(rank * BLOCKS).cast("int"))
    # Documents at p = 1 are in and those at 0 are out; the others are taken in order up to the words still wanted.
    open_rows = ranked.where((p > 0) & (p < 1))
    blocks = cut_lineage(open_rows.groupBy("_source", "_block").agg(F.sum("_size").alias("words")))
    open_words = (
        rates.groupBy(F.col("source").alias("o_source"))
        .agg((F.first("wanted") - F.coalesce(F.sum(F.when(p >= 1, F.col("words"))), F.lit(0)).cast("double")).alias("open"))
    )
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # The block in which the sample closes, and the words before it.
    closing = cut_lineage(
        blocks.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(open_words, F.col("_source").eqNullSafe(F.col("o_source")))
        .where((F.col("_before") < F.col("open")) & (F.col("_before") + F.col("words") >= F.col("open")))
        .select("o_source", F.col("_block").alias("c_block"), "_before", "open")
    )
    key = F.struct(rank.alias("rank"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("id"), F.col("_size").alias("size"))
    along = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    cutoff = (
        open_rows.select("_source", "_id", "_size", "_rank", "_block")
        .join(closing, F.col("_source").eqNullSafe(F.col("o_source")) & (F.col("_block") == F.col("c_block")))
        .withColumn("_key", key)
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(along), F.lit(0)))
        .where(2 * F.col("_start") + F.col("_size") <= 2 * F.col("open"))
        .groupBy(F.col("o_source").alias("k_source")).agg(F.max("_key").alias("last"))
    )
    limits = cut_lineage(
        rates.join(closing.select("o_source", "c_block"), F.col("source").eqNullSafe(F.col("o_source")), "left")
        .drop("o_source")
        .join(cutoff, F.col("source").eqNullSafe(F.col("k_source")), "left")
        .select("source", "class", "source_size", "target", "certain", "p", "c_block", "last")
    )
    # Without a closing block the open documents together do not reach what is wanted, or nothing is.
    chosen = (
        F.when(p >= 1, True).when(p <= 0, False).when(F.col("c_block").isNull(), True)
        .when(F.floor(rank * BLOCKS) != F.col("c_block"), F.floor(rank * BLOCKS) < F.col("c_block"))
        .otherwise(F.coalesce(key <= F.col("last"), F.lit(False)))
    )
    found = with_limits(rows, limits).withColumn("_rank", odds_share).withColumn("_copies", F.col("certain") + chosen.cast("long"))
    added = {
        "size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"),
        "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size"),
    }
    if with_p:
        added["p"] = p
    kept = [c for c in docs.columns if c not in added]
    return found.select(*[F.col("_doc").getField(c) for c in kept], *added.values()).toDF(*kept, *added)
