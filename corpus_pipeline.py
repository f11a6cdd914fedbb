"""The corpus pipeline: stages over documents, each written and read again by the next.

language -> toxicity -> near-dedup -> decontamination -> mixing. Every stage sees all rows that the one before
it kept, and learns only from those. All but the last return the columns of their input, whatever their names;
the last adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` and leaves out documents of which the mix
takes no copy. Defined cases: texts without letters are rejected as of no language; without labels of both
classes no document is rejected as toxic; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.decontaminate import with_matches
from rankloom.llm.hyperminhash import one_of_each
from rankloom.llm.language import learn_dictionaries, with_language
from rankloom.llm.mixing import mix
from rankloom.llm.toxicity import learn, with_toxicity
from rankloom.session import cut_lineage, work_path

#: Jaccard similarity of five-word shingles, in percent, from which the near-dedup stage links documents.
NEAR_PERCENT = 80


def _kept(docs: DataFrame, judge: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """The rows that ``judge`` keeps. It sees the columns under neutral names, so that none clashes with its own."""
    names = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    rows = judge(docs.select(*[F.col(f"`{name}`").alias(short) for name, short in names.items()]), names)
    return rows.select(*[F.col(short).alias(name) for name, short in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin."""

    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        learned = learn_dictionaries(rows, F.lit(True), c["text"], c["lang"])
        return with_language(rows, learned, c["text"]).where(~F.col("rejected"))

    return _kept(docs, judge)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models do not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        # Labels of documents that are here: others would use up places among those the models learn from.
        here = labels.join(rows.select(F.col(c["doc_id"]).alias("doc_id")), "doc_id", "left_semi")
        renamed = cut_lineage(here.select(F.col("doc_id").alias(c["doc_id"]), "toxic"))
        model = learn(rows, renamed, None, c["doc_id"], c["text"], "toxic")
        return with_toxicity(rows, model, c["text"]).where(F.col("predicted") == 0)

    return _kept(docs, judge)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. A link takes a similarity of
    ``NEAR_PERCENT`` % or more."""
    return _kept(docs, lambda rows, c: one_of_each(rows, c["doc_id"], c["text"], NEAR_PERCENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda rows, c: with_matches(rows, benchmark, c["text"]).where(F.size("matches") == 0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the copies and words it takes of each."""
    return mix(docs).where(F.col("copies") > 0)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: SQL cannot express the learned stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
