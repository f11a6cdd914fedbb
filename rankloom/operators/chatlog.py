"""Chat logs: append, search, pairing, export and folders.

Messages are rows ``(conv_id, turn, role, text)`` with ``turn`` a whole number unique per conversation;
folders are rows ``(folder, conv_id)``. A conversation may be arbitrarily long: ordered steps run in
blocks of ``TURNS`` turns, and documents are written in parts of that many turns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.operators.ordered import BLOCK, global_rank, ordered_scan, step_blocks, value_blocks
from rankloom.operators.score import top_per
from rankloom.session import cut_lineage

TURNS = 1024


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tail_messages(messages: DataFrame, n: int = 80) -> DataFrame:
    """The last ``n`` messages of every conversation."""
    return top_per(messages, ["conv_id"], [F.desc("turn")], n, "_rn").drop("_rn")


def append_messages(messages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add ``incoming(msg_id, conv_id, role, text, ts)`` after the last turn of known conversations.

    Messages for unknown conversations are ignored; ``ts`` is a number and kept where ``messages`` has it, ties go by
    ``msg_id``. Rows are cut into blocks by time and, as a bulk load may bear one time, by the message's id within it.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    known = _time_blocks(incoming).join(last, "conv_id")
    placed = ordered_scan(known, ["conv_id"], ["ts", "msg_id"], {"_n": ("row_number", None)})
    kept = ["role", "text", *(["ts"] if "ts" in messages.columns else [])]
    return messages.unionByName(placed.select("conv_id", (F.col("_last") + F.col("_n")).alias("turn"), *kept))


def _time_blocks(incoming: DataFrame) -> DataFrame:
    """Blocks in the order of (ts, msg_id): blocks of times, each cut by blocks of ids where it holds one time only."""
    by_time = value_blocks(incoming, "ts").withColumnRenamed(BLOCK, "_t")
    both = value_blocks(by_time, "msg_id").withColumnRenamed(BLOCK, "_m")
    # At most one row per block of times.
    single = by_time.groupBy("_t").agg(F.min("ts").eqNullSafe(F.max("ts")).alias("_one"))
    wide = F.col("_t").cast("bigint") * F.lit(1 << 20)
    joined = both.join(F.broadcast(single), "_t")
    return joined.withColumn(BLOCK, wide + F.when(F.col("_one"), F.col("_m")).otherwise(0)).drop("_t", "_m", "_one")


def ensure_conversations(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the wanted ids that are missing from ``conversations(conv_id, title)``, titled ``Chat n``."""
    fresh = cut_lineage(wanted.select("conv_id").distinct().join(conversations, "conv_id", "left_anti"))
    have = conversations.agg(F.count(F.lit(1)).alias("n")).scalar()
    titled = global_rank(fresh, "conv_id", "_n").select(
        "conv_id", F.concat(F.lit("Chat "), (have + F.col("_n")).cast("string")).alias("title")
    )
    return conversations.unionByName(titled)


def _literal(term: str) -> str:
    return "(?iu)" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def search_messages(messages: DataFrame, term: str, role: str | None = None) -> DataFrame:
    """Messages containing the literal term, any case, with their match count and highlighted text."""
    if role:
        messages = messages.where(F.col("role") == role)
    if not term.strip():
        return messages.where(F.lit(False)).withColumns({"n_matches": F.lit(0), "highlighted": F.col("text")})
    pattern = _literal(term)
    return (
        messages.withColumn("n_matches", F.regexp_count("text", F.lit(pattern)))
        .where(F.col("n_matches") > 0)
        .withColumn("highlighted", F.regexp_replace("text", pattern, fixed.HIGHLIGHT))
    )


def match_counts(messages: DataFrame, term: str, role: str | None = None) -> DataFrame:
    """Matches per conversation, 0 where there are none."""
    counted = F.regexp_count("text", F.lit(_literal(term)))
    if role:
        counted = F.when(F.col("role") == role, counted).otherwise(0)
    return messages.groupBy("conv_id").agg(F.sum(counted).cast("bigint").alias("n_matches"))


def match_cycle(messages: DataFrame, term: str, role: str | None = None) -> DataFrame:
    """Messages with matches, their first match's position, and the next/previous such message, cyclic."""
    # Written once, so that the texts are searched once.
    found = cut_lineage(search_messages(messages, term, role).select("conv_id", "turn", "n_matches"))
    scanned = ordered_scan(step_blocks(found, "turn", TURNS), ["conv_id"], ["turn"], {
        "before": ("sum_before", "n_matches"), "n_total": ("total", "n_matches"),
        "_next": ("next", "turn"), "_prev": ("prev", "turn"), "_first": ("first", "turn"), "_last": ("last", "turn"),
    })
    return scanned.select(
        "conv_id", "turn", "n_matches", (F.col("before") + 1).cast("bigint").alias("first_match"),
        F.col("n_total").cast("bigint").alias("n_total"),
        F.coalesce("_next", "_first").alias("next_turn"), F.coalesce("_prev", "_last").alias("prev_turn"),
    )


def transcript_lines(messages: DataFrame, time: Column, user: str = "user", bot: str = "assistant") -> DataFrame:
    """One ``[Sender @ time]: text`` line per message that is not blank."""
    sender = F.when(F.col("role") == user, "User").when(F.col("role") == bot, "Bot").otherwise("System")
    text = strip("text")
    line = F.concat(F.lit("["), sender, F.lit(" @ "), time, F.lit("]: "), text)
    return messages.where(text != "").select("conv_id", "turn", line.alias("line"))


def transcripts(lines: DataFrame, header: str = "=== Chat Transcript ===", turns: int = TURNS) -> DataFrame:
    """Transcript texts in parts of ``turns`` turns; the parts in order are the whole transcript."""
    parts = step_blocks(lines, "turn", turns).groupBy("conv_id", F.col(BLOCK).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("_l")
    )
    body = F.array_join(F.transform("_l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    head = F.when(F.col("part") == 0, F.lit(header + "\n\n")).otherwise("")
    return parts.select("conv_id", "part", F.size("_l").cast("bigint").alias("n_lines"), F.concat(head, body).alias("transcript"))


def write_transcripts(parts: DataFrame, path: str) -> None:
    """Text files below one folder per conversation and part; meant for a choice of conversations."""
    text = F.regexp_replace("transcript", r"\n\z", "")  # the writer ends every row with a newline
    parts.select("conv_id", "part", text.alias("value")).write.partitionBy("conv_id", "part").text(path)


def paired_turns(messages: DataFrame, user: str = "user", bot: str = "assistant") -> DataFrame:
    """Each user message with the bot message right after it."""
    scanned = ordered_scan(step_blocks(messages, "turn", TURNS), ["conv_id"], ["turn"], {
        "_role": ("next", "role"), "answer": ("next", "text"),
    })
    return scanned.where((F.col("role") == user) & (F.col("_role") == bot)).select(
        "conv_id", "turn", F.col("text").alias("question"), "answer"
    )


# --- folders ---------------------------------------------------------------------------------


def folder_titles(folders: DataFrame, conversations: DataFrame) -> DataFrame:
    """Titles of the conversations in each folder; ids without a conversation are skipped."""
    return folders.join(conversations.select("conv_id", "title"), "conv_id").select("folder", "conv_id", "title")


def folder_counts(folders: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Ids per folder, dangling ones included; with ``names(folder)``, 0 for folders without any."""
    counted = folders.groupBy("folder").agg(F.count("conv_id").alias("n_ids"))
    if names is None:
        return counted
    return names.select("folder").distinct().join(counted, "folder", "left").select("folder", F.coalesce("n_ids", F.lit(0)).cast("bigint").alias("n_ids"))


def delete_conversations(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop the rows of any table keyed by ``conv_id`` that belong to deleted conversations."""
    return table.join(doomed.select("conv_id"), "conv_id", "left_anti")


def create_folders(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """The table of folder names, ``names(folder)``, with those of ``wanted(folder)`` that are absent; blank ones are
    ignored. It stands beside the memberships, so a folder without any id is kept."""
    trimmed = wanted.select(F.nullif(F.trim("folder"), F.lit("")).alias("folder")).where(F.col("folder").isNotNull())
    return names.select("folder").unionByName(trimmed).distinct()


def rename_folders(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(folder, new_name)``; an existing target is merged, blank names change nothing."""
    named = changes.select("folder", F.nullif(F.trim("new_name"), F.lit("")).alias("_new"))
    renamed = folders.join(named, "folder", "left").select(F.coalesce("_new", "folder").alias("folder"), "conv_id")
    return renamed.distinct()


def assign_folders(folders: DataFrame, flags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Apply ``flags(folder, conv_id, member)``: add where true, remove where false; unknown folders ignored.

    A folder is known if it has an id, or stands in ``names(folder)`` where that is given.
    """
    kept = folders.join(flags.select("folder", "conv_id"), ["folder", "conv_id"], "left_anti")
    known = (folders if names is None else names).select("folder").distinct()
    added = flags.where("member").join(known, "folder", "left_semi")
    return kept.unionByName(added.select("folder", "conv_id")).distinct()


def rename_conversations(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(conv_id, seq, title)``, the last one per conversation; a blank title keeps the old."""
    last = changes.groupBy("conv_id").agg(F.max_by("title", "seq").alias("_t"))
    title = F.coalesce(F.nullif(F.trim("_t"), F.lit("")), F.col("title"))
    return conversations.join(last, "conv_id", "left").select("conv_id", title.alias("title"))
