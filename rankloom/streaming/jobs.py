"""Structured Streaming jobs: page ingest and windowed event counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.profiles import extract_listings

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of files. Without a bound, all files present at a trigger are one batch, so that neither their number
    nor their order decides which rows are late; set a bound only for files that come in time order."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def ingest_listings(pages: DataFrame, out: str, checkpoint: str, **layout) -> StreamingQuery:
    """Append the listings of new page files; runs until all files present have been read."""
    return (
        extract_listings(pages, **layout).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per user, type and tumbling window; duplicates are dropped, and rows more than ``late`` older than the
    newest row of any earlier batch."""
    # Read the zone-less time as UTC whatever the session's zone is.
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    timed = events.withColumn("ts", F.timestamp_micros(micros)).withWatermark("ts", late)
    return (
        timed.dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", window).alias("w"), "user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "user_id", "event_type", "n_events")
    )


def run_event_counts(events: DataFrame, out: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Run the counts over all files present and return the latest state per key.

    Every micro-batch overwrites its own folder, so a replayed batch changes nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        event_counts(events, window, late).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    keys = ["window_start", "user_id", "event_type"]
    return events.sparkSession.read.parquet(out).groupBy(*keys).agg(F.max_by("n_events", "epoch").alias("n_events"))


def run_event_log(spark: SparkSession, files: str, root: str, window: str = "1 day", late: str = "1 hour",
                  files_per_batch: int | None = None) -> None:
    """Take in all event files present since the last run below ``root`` and bring the log's tables up to date.

    Two streams with checkpoints of their own follow each other, so that a run may stop anywhere and be repeated:

    * The first sets rows aside that are ``late`` or more older than the newest row of any earlier batch, and those
      without a time, which have no window. Every batch overwrites its own folder of ``accepted``, ``late`` and ``newest``, so
      a batch that is repeated changes nothing.
    * The second counts accepted rows, with Spark's state of open windows and seen ids. It starts when the first has committed
      all its batches, so folders it has read are never written again, and it is never ahead of the first, so it drops no row.
      Each batch writes the counts that changed.

    Changed counts are then folded into one new snapshot, and a row that names it is appended to ``current``: readers see the
    old snapshot or the new one. A fold rewrites as many rows as there are counts, once per run, not per batch.
    """
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")

    def route(batch: DataFrame, epoch: int) -> None:
        before = spark.read.parquet(f"{root}/newest/epoch={epoch - 1}").first().at if epoch else None
        rows = batch.withColumn("_at", micros)
        newest = rows.agg(F.max("_at").alias("at")).select(F.greatest("at", F.lit(before).cast("bigint")).alias("at"))
        newest.write.mode("overwrite").parquet(f"{root}/newest/epoch={epoch}")
        # Spark's own mark has milliseconds.
        mark = F.timestamp_millis(F.floor(F.lit(before).cast("bigint") / 1000)) - F.expr(f"INTERVAL {late}")
        gone = F.col("_at").isNull() | F.coalesce(F.timestamp_micros("_at") <= mark, F.lit(False))
        rows.where(~gone).drop("_at").write.mode("overwrite").parquet(f"{root}/accepted/epoch={epoch}")
        rows.where(gone).drop("_at").write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")

    def changed(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changed/epoch={epoch}")

    def run(rows: DataFrame, mode: str, each, state: str) -> None:
        rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{root}/{state}").trigger(availableNow=True).start().awaitTermination()

    run(stream_files(spark, files, EVENTS, files_per_batch), "append", route, "state-route")
    if _table(spark, f"{root}/accepted") is not None:
        # Accepted rows of any number of batches may be one batch here.
        run(event_counts(stream_files(spark, f"{root}/accepted/epoch=*", EVENTS), window, late), "update", changed, "state-counts")
        _fold(spark, root)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _fold(spark: SparkSession, root: str) -> None:
    """Make one snapshot of the current one and the counts that changed since."""
    keys, changes, pointer = ["window_start", "user_id", "event_type"], _table(spark, f"{root}/changed"), _table(spark, f"{root}/current")
    if changes is None:
        return
    now = pointer.orderBy(F.desc("upto")).first() if pointer is not None else None
    new = changes.where(F.col("epoch") > F.lit(now.upto)) if now else changes
    upto = new.agg(F.max("epoch")).first()[0]
    if upto is None:
        return
    new = new.select(*keys, "n_events", F.col("epoch").cast("bigint").alias("epoch"))
    if now:
        new = new.unionByName(spark.read.parquet(now.path).withColumn("epoch", F.lit(now.upto)))
    path = f"{root}/snapshots/{uuid.uuid4().hex}"
    new.groupBy(*keys).agg(F.max_by("n_events", "epoch").alias("n_events")).write.parquet(path)
    spark.createDataFrame([(int(upto), path)], "upto bigint, path string").coalesce(1).write.mode("append").parquet(f"{root}/current")


def event_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Counts per window, user and type as of the last finished run; reads one snapshot. Empty before there is one."""
    pointer = _table(spark, f"{root}/current")
    if pointer is None:
        return spark.createDataFrame([], "window_start timestamp, user_id bigint, event_type string, n_events bigint")
    return spark.read.parquet(pointer.orderBy(F.desc("upto")).first().path)


def late_events(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came too late, or without a time, with the batch they came in."""
    found = _table(spark, f"{root}/late")
    return spark.createDataFrame([], T.StructType([*EVENTS, T.StructField("epoch", T.IntegerType())])) if found is None else found
