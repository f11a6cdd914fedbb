"""Prompts, generated-text cleaning, markup and preparation of tuning text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.operators.chatlog import paired_turns, strip
from rankloom.operators.ordered import ordered_scan, value_blocks


def split_valid(df: DataFrame, text: str, reason: str = fixed.NO_QUESTION) -> tuple[DataFrame, DataFrame]:
    """Rows with text, and the rejected rest with a ``reason``."""
    blank = F.coalesce(strip(text) == "", F.lit(True))
    return df.where(~blank), df.where(blank).withColumn("reason", F.lit(reason))


def build_prompt(question: Column | str, system: str | None = None) -> Column:
    """An instruction prompt; with a system text the question follows it."""
    q = F.col(question) if isinstance(question, str) else question
    if system is not None:
        q = F.concat(F.lit(system + "\n\nUser question: "), q)
    return F.concat(F.lit(f"{fixed.SEQUENCE_OPEN}{fixed.INSTRUCTION_OPEN} "), q, F.lit(f" {fixed.INSTRUCTION_CLOSE}"))


def system_prompt(assistant: str = "an assistant") -> str:
    return fixed.SYSTEM_PROMPT.replace("{assistant}", assistant)


def clean_generated(text: Column | str, marker: str = "first") -> Column:
    """Text after the first (or last) closing marker, without marker tokens and long blank runs."""
    t = F.col(text) if isinstance(text, str) else text
    close = fixed.INSTRUCTION_CLOSE
    if marker == "last":
        return strip(F.substring_index(t, close, -1))
    at = F.locate(close, t)
    t = strip(F.when(at > 0, F.substring(t, at + F.lit(len(close)), F.length(t))).otherwise(t))
    for token in fixed.DROPPED_MARKERS:
        t = F.replace(t, F.lit(token), F.lit(""))
    return F.regexp_replace(strip(t), r"\n{3,}", "\n\n")


def markup_to_html(text: Column | str) -> Column:
    """Light markup to HTML, by ordered rewrite rules."""
    t = F.col(text) if isinstance(text, str) else text
    for pattern, new in fixed.MARKUP_RULES:
        t = F.regexp_replace(t, pattern, new)
    return strip(F.coalesce(t, F.lit("")))


def instruction_pairs(messages: DataFrame) -> DataFrame:
    """Tuning text per answered question: prompt, answer and closing marker."""
    text = F.concat(build_prompt("question"), F.lit(" "), F.col("answer"), F.lit(f" {fixed.SEQUENCE_CLOSE}"))
    return paired_turns(messages).select("conv_id", "turn", text.alias("text"))


def words(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_windows(df: DataFrame, text: str, max_length: int, pad: str = fixed.SEQUENCE_CLOSE, tokenize=words) -> DataFrame:
    """Add ``tokens`` cut or right-padded to ``max_length``, with the full and kept counts."""
    toks = tokenize(F.col(text))
    kept = F.slice("_t", 1, max_length)
    return (
        df.withColumn("_t", toks)
        .withColumn("n_tokens", F.size("_t").cast("bigint"))
        .withColumn("n_kept", F.least(F.col("n_tokens"), F.lit(max_length)).cast("bigint"))
        .withColumn("tokens", F.concat(kept, F.array_repeat(F.lit(pad), F.lit(max_length) - F.size(kept))))
        .drop("_t")
    )


def hash_order(id_col: str, seed: int) -> Column:
    """A repeatable pseudo-random whole number per id."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def length_batches(df: DataFrame, id_col: str, length: str, batch: int = 4, mega: int = 50, seed: int = 42) -> DataFrame:
    """Batches of similar length: shuffled rows in runs of ``batch * mega``, each sorted by falling length.

    The shuffled position comes from a blocked scan, so no task orders the whole table.
    """
    size = batch * mega
    shuffled = df.withColumn("_h", hash_order(id_col, seed))
    ranked = ordered_scan(value_blocks(shuffled, "_h"), [], ["_h", id_col], {"_pos": ("row_number", None)})
    runs = ranked.withColumn("mega", F.floor((F.col("_pos") - 1) / size).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("mega").orderBy(F.desc(length), id_col)) - 1
    return runs.withColumn("_i", place).select(
        *df.columns, "mega", F.floor(F.col("_i") / batch).cast("bigint").alias("batch"),
        (F.col("_i") % batch).cast("bigint").alias("slot"),
    )
