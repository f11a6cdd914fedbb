"""JSON documents: ranked results and stored conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import fixed
from rankloom.operators.chatlog import TURNS
from rankloom.operators.ordered import BLOCK, step_blocks

MESSAGE = T.StructType([
    T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("ts", T.LongType()),
])
#: Ids are texts; numbers read as their digits.
STORE = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("msgs", T.ArrayType(MESSAGE)),
]))
FOLDERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def results_json(requests: DataFrame, ranked: DataFrame, fields: list[str], key: str = "lawyers", role: str = "lawyer") -> DataFrame:
    """One JSON document per request: its top items in rank order, or an empty list with a message.

    ``ranked`` holds the top k per request, so a list has at most k entries.
    """
    lists = ranked.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_r"))
    entry = F.transform("_r", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    message = F.lit(fixed.NO_MATCH_MESSAGE.replace("{role}", role))
    doc = F.when(
        F.col("_r").isNull(), F.to_json(F.struct(F.array().cast("array<string>").alias(key), message.alias("message")))
    ).otherwise(F.to_json(F.struct(entry.alias(key))))
    return requests.select("request_id").join(lists, "request_id", "left").select(
        "request_id", F.coalesce(F.size("_r"), F.lit(0)).cast("bigint").alias("n_items"), doc.alias("document")
    )


def conversations_to_json(messages: DataFrame, titles: DataFrame | None = None, turns: int = TURNS) -> DataFrame:
    """Store documents ``[{id, title, msgs: [...]}]`` in parts of ``turns`` turns per conversation.

    Times go in where ``messages`` has ``ts``. ``titles(conv_id, title)`` adds titles, and conversations without any
    message as one part with an empty list.
    """
    msg = F.struct("turn", "role", "text", *(["ts"] if "ts" in messages.columns else []))
    nested = step_blocks(messages, "turn", turns).groupBy("conv_id", F.col(BLOCK).alias("part")).agg(
        F.array_sort(F.collect_list(msg)).alias("msgs")
    )
    fields = [F.col("conv_id").alias("id")]
    if titles is not None:
        nested = titles.select("conv_id", "title").join(nested, "conv_id", "full").withColumns({
            "part": F.coalesce("part", F.lit(0)), "msgs": F.coalesce("msgs", F.array().cast(nested.schema["msgs"].dataType)),
        })
        fields.append(F.col("title"))
    return nested.select(
        "conv_id", "part", F.size("msgs").cast("bigint").alias("n_msgs"),
        F.to_json(F.array(F.struct(*fields, "msgs"))).alias("document"),
    )


def _stored(docs: DataFrame, column: str) -> DataFrame:
    convs = F.coalesce(F.from_json(column, STORE, {"mode": "PERMISSIVE"}), F.array().cast(STORE))
    return docs.select(F.explode(convs).alias("c")).where(F.col("c.id").isNotNull())


def conversations_from_json(docs: DataFrame, column: str = "document") -> DataFrame:
    """Messages of stored documents; a malformed or empty document counts as an empty store."""
    rows = _stored(docs, column).select(F.col("c.id").alias("conv_id"), F.col("c.title").alias("title"), F.posexplode("c.msgs").alias("pos", "m"))
    return rows.select(
        "conv_id", "title", F.coalesce("m.turn", F.col("pos").cast("bigint")).alias("turn"), "m.role", "m.text", "m.ts"
    )


def titles_from_json(docs: DataFrame, column: str = "document") -> DataFrame:
    """(conv_id, title) of every stored conversation, those without messages too, one row per id."""
    rows = _stored(docs, column).select(F.col("c.id").alias("conv_id"), F.col("c.title").alias("title"))
    return rows.groupBy("conv_id").agg(F.max("title").alias("title"))


def folders_to_json(names: DataFrame, members: DataFrame) -> DataFrame:
    """(folder, document): ``{folder: [ids]}`` for each of ``names(folder)``, empty folders too, from ``members(folder, conv_id)``."""
    ids = members.groupBy("folder").agg(F.array_sort(F.collect_set(F.col("conv_id").cast("string"))).alias("ids"))
    every = names.select("folder").distinct().join(ids, "folder", "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return every.select("folder", F.to_json(F.create_map(F.col("folder"), listed)).alias("document"))


def folders_from_json(docs: DataFrame, column: str = "document") -> DataFrame:
    """Folder rows (folder, conv_id) of stored ``{folder: [ids]}`` documents; malformed ones give none."""
    stored = F.from_json(column, FOLDERS, {"mode": "PERMISSIVE"})
    return docs.select(F.explode(stored).alias("folder", "_ids")).select("folder", F.explode("_ids").alias("conv_id"))


def folder_names_from_json(docs: DataFrame, column: str = "document") -> DataFrame:
    """Names of all stored folders, empty ones too."""
    return docs.select(F.explode(F.map_keys(F.from_json(column, FOLDERS, {"mode": "PERMISSIVE"}))).alias("folder")).distinct()
