"""Queries over chat logs, folders, prompts, tuning text and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import fixed
from rankloom.operators import chatlog, prompts
from rankloom.plans.profiles import LIST_LAYOUT, ORACLES as PROFILE_ORACLES
from rankloom.plans.views import oracle, table, view
from rankloom.session import work_path
from rankloom.sources import documents
from rankloom.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation, titled by its number of messages."""
    counted = messages(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("conv_id", F.concat(F.lit("Talk of "), F.col("n").cast("string")).alias("title"))


TITLED = "titled AS (SELECT conv_id, 'Talk of ' || CAST(COUNT(*) AS VARCHAR) AS title FROM conversations GROUP BY conv_id)"
TERM = "en"

# --- store documents -------------------------------------------------------------------------


@query("a7_conversations_from_json", "SELECT conv_id, turn, role, text FROM conversations")
def a7(spark, sf):
    """Stored documents read back, among malformed ones that count as empty stores."""
    good = documents.conversations_to_json(messages(spark, sf)).select("document")
    broken = table(spark, sf, "benchmark").select(F.concat(F.lit('[{"id": '), F.col("text")).alias("document"))
    read = documents.conversations_from_json(good.unionByName(broken))
    return read.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")


STORED_SQL = f"""
WITH {TITLED} SELECT 'c' || CAST(conv_id AS VARCHAR) AS conv_id, title, turn, role, text, turn * 1000 AS ts FROM conversations JOIN titled USING (conv_id)
UNION ALL SELECT DISTINCT 'new' || CAST(item_id AS VARCHAR), 'New Chat', NULL, NULL, NULL, NULL FROM benchmark"""


@query("a8_store_round_trip", STORED_SQL)
def a8_round_trip(spark, sf):
    """Text ids, titles, times and conversations without a message, written as documents and read back."""
    as_text = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id")
    log = messages(spark, sf).select(as_text, "turn", "role", "text", (F.col("turn") * 1000).alias("ts"))
    fresh = table(spark, sf, "benchmark").select(F.concat(F.lit("new"), F.col("item_id").cast("string")).alias("conv_id"), F.lit("New Chat").alias("title"))
    docs = documents.conversations_to_json(log, titled(spark, sf).select(as_text, "title").unionByName(fresh.distinct()), turns=2).select("document")
    read = documents.conversations_from_json(docs).select("conv_id", "turn", "role", "text", "ts")
    return documents.titles_from_json(docs).join(read, "conv_id", "left")


@query("a8_folders_round_trip", oracle(["folders"], """
SELECT folder, CAST(conv_id AS VARCHAR) AS conv_id FROM folders UNION ALL SELECT DISTINCT 'empty ' || role, NULL FROM conversations"""))
def a8_folders(spark, sf):
    """Folders with and without ids, written as documents and read back."""
    members = view(spark, sf, "folders")
    empty = messages(spark, sf).select(F.concat(F.lit("empty "), "role").alias("folder")).distinct()
    docs = documents.folders_to_json(chatlog.create_folders(members.select("folder").distinct(), empty), members).select("document")
    return documents.folder_names_from_json(docs).join(documents.folders_from_json(docs), "folder", "left")


@query("a8_conversations_to_json", """
SELECT conv_id, turn // 1024 AS part, COUNT(*) AS n_msgs,
  CAST(to_json([{'id': conv_id, 'msgs': list({'turn': turn, 'role': role, 'text': text} ORDER BY turn)}]) AS VARCHAR) AS document
FROM conversations GROUP BY conv_id, part""")
def a8(spark, sf):
    return documents.conversations_to_json(messages(spark, sf))


# --- log operations --------------------------------------------------------------------------


@query("f7_tail_messages", """
SELECT conv_id, turn, role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""")
def f7(spark, sf):
    return chatlog.tail_messages(messages(spark, sf), 3).select("conv_id", "turn", "role")


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages for the conversation of their user; some users have none."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("msg_id"), F.col("user_id").alias("conv_id"), F.lit("user").alias("role"),
        F.col("event_type").alias("text"), micros.alias("ts"),
    )


@query("k1_append_messages", """
SELECT conv_id, turn, role, md5(text) AS digest FROM conversations UNION ALL
SELECT conv_id, last + ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY ts, event_id), 'user', md5(event_type)
FROM (SELECT conv_id, MAX(turn) AS last FROM conversations GROUP BY conv_id) JOIN events ON user_id = conv_id""")
def k1(spark, sf):
    log = chatlog.append_messages(messages(spark, sf), _incoming(spark, sf))
    return log.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("k2_ensure_conversations", f"""
WITH {TITLED} SELECT * FROM titled UNION ALL
SELECT user_id, 'Chat ' || CAST((SELECT COUNT(*) FROM titled) + ROW_NUMBER() OVER (ORDER BY user_id) AS VARCHAR)
FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT conv_id FROM titled)""")
def k2(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"))
    return chatlog.ensure_conversations(titled(spark, sf), wanted)


@query("k3_search_messages", f"""
SELECT conv_id, turn, len(regexp_extract_all(text, '(?i){TERM}')) AS n_matches,
  regexp_replace(text, '(?i){TERM}', '<mark class="hl">\\0</mark>', 'g') AS highlighted
FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '(?i){TERM}')""")
def k3(spark, sf):
    found = chatlog.search_messages(messages(spark, sf), TERM, role="assistant")
    return found.select("conv_id", "turn", F.col("n_matches").cast("bigint"), "highlighted")


@query("h12_match_counts", f"""
SELECT conv_id, CAST(SUM(CASE WHEN role = 'user' THEN len(regexp_extract_all(text, '(?i){TERM}')) ELSE 0 END) AS BIGINT) AS n_matches
FROM conversations GROUP BY conv_id""")
def h12(spark, sf):
    return chatlog.match_counts(messages(spark, sf), TERM, role="user")


@query("k6_match_cycle", f"""
WITH hits AS (SELECT conv_id, turn, len(regexp_extract_all(text, '(?i){TERM}')) AS n FROM conversations)
SELECT conv_id, turn, n AS n_matches, CAST(COALESCE(SUM(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_match,
  CAST(SUM(n) OVER (PARTITION BY conv_id) AS BIGINT) AS n_total,
  COALESCE(LEAD(turn) OVER w, MIN(turn) OVER (PARTITION BY conv_id)) AS next_turn,
  COALESCE(LAG(turn) OVER w, MAX(turn) OVER (PARTITION BY conv_id)) AS prev_turn
FROM hits WHERE n > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def k6(spark, sf):
    return chatlog.match_cycle(messages(spark, sf), TERM).withColumn("n_matches", F.col("n_matches").cast("bigint"))


_LINE_SQL = r"""
lines AS (SELECT conv_id, turn, '[' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Bot' ELSE 'System' END
  || ' @ turn ' || CAST(turn AS VARCHAR) || ']: ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS line
  FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
"""


@query("k4_transcripts", f"""
WITH {_LINE_SQL} SELECT conv_id, turn // 1024 AS part, COUNT(*) AS n_lines,
  CASE WHEN turn // 1024 = 0 THEN '=== Chat Transcript ===' || chr(10) || chr(10) ELSE '' END
    || string_agg(line || chr(10), '' ORDER BY turn) AS transcript
FROM lines GROUP BY conv_id, turn // 1024""")
def k4(spark, sf):
    time = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return chatlog.transcripts(chatlog.transcript_lines(messages(spark, sf), time))


PAIRS = """
paired AS (SELECT conv_id, turn, text AS question, answer FROM (
  SELECT *, LEAD(role) OVER w AS next_role, LEAD(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')
"""


@query("k5_paired_turns", f"WITH {PAIRS} SELECT * FROM paired")
def k5(spark, sf):
    return chatlog.paired_turns(messages(spark, sf))


# --- folders and titles ----------------------------------------------------------------------


@query("g4_folder_titles", oracle(["folders"], "SELECT folder, conv_id, title FROM folders JOIN titled USING (conv_id)", TITLED))
def g4(spark, sf):
    return chatlog.folder_titles(view(spark, sf, "folders"), titled(spark, sf))


_DOOMED_SQL = "SELECT conv_id FROM conversations WHERE role = 'system'"


def _doomed(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where("role = 'system'").select("conv_id").distinct()


@query("g5_delete_conversations", f"SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN ({_DOOMED_SQL})")
def g5(spark, sf):
    return chatlog.delete_conversations(messages(spark, sf), _doomed(spark, sf)).select("conv_id", "turn")


@query("g5_delete_folder_entries", oracle(["folders"], f"SELECT folder, conv_id FROM folders WHERE conv_id NOT IN ({_DOOMED_SQL})"))
def g5_folders(spark, sf):
    return chatlog.delete_conversations(view(spark, sf, "folders"), _doomed(spark, sf)).select("folder", "conv_id")


@query("h11_folder_counts_named", oracle(["folders"], """
SELECT folder, COUNT(conv_id) AS n_ids FROM (SELECT folder, conv_id FROM folders WHERE conv_id NOT IN (SELECT conv_id FROM folders WHERE folder = 'folder_1'))
RIGHT JOIN (SELECT DISTINCT folder FROM folders) USING (folder) GROUP BY folder"""))
def h11_named(spark, sf):
    """Counts after all conversations of one folder are deleted: the folder stays, with 0."""
    folders = view(spark, sf, "folders")
    left = chatlog.delete_conversations(folders, folders.where("folder = 'folder_1'").select("conv_id"))
    return chatlog.folder_counts(left, folders.select("folder"))


@query("h11_folder_counts", oracle(["folders"], "SELECT folder, COUNT(*) AS n_ids FROM folders GROUP BY folder"))
def h11(spark, sf):
    return chatlog.folder_counts(view(spark, sf, "folders"))


@query("k7_rename_folders", oracle(["folders"], """
SELECT DISTINCT CASE folder WHEN 'folder_1' THEN 'folder_0' WHEN 'folder_2' THEN 'archive' ELSE folder END AS folder, conv_id FROM folders"""))
def k7(spark, sf):
    changes = view(spark, sf, "folders").select("folder").distinct().withColumn(
        "new_name",
        F.when(F.col("folder") == "folder_1", "folder_0").when(F.col("folder") == "folder_2", " archive ").otherwise("  "),
    )
    return chatlog.rename_folders(view(spark, sf, "folders"), changes)


_FLAGS_SQL = """
flags AS (SELECT 'folder_3' AS folder, conv_id, MAX(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS member FROM conversations GROUP BY conv_id
  UNION ALL SELECT DISTINCT 'folder_9', conv_id, TRUE FROM conversations)
"""


@query("k8_assign_folders", oracle(["folders"], """
SELECT folder, conv_id FROM folders f WHERE NOT EXISTS (SELECT 1 FROM flags g WHERE g.folder = f.folder AND g.conv_id = f.conv_id)
UNION SELECT folder, conv_id FROM flags WHERE member AND folder IN (SELECT folder FROM folders)""", _FLAGS_SQL))
def k8(spark, sf):
    log = messages(spark, sf)
    one = log.groupBy("conv_id").agg((F.max(F.when(F.col("role") == "system", 1).otherwise(0)) == 1).alias("member"))
    flags = one.select(F.lit("folder_3").alias("folder"), "conv_id", "member")
    unknown = log.select("conv_id").distinct().select(F.lit("folder_9").alias("folder"), "conv_id", F.lit(True).alias("member"))
    return chatlog.assign_folders(view(spark, sf, "folders"), flags.unionByName(unknown))


@query("k9_rename_conversations", f"""
WITH {TITLED}, changes AS (SELECT conv_id, turn AS seq, CASE WHEN role = 'assistant' THEN '  ' ELSE role || ' ' || CAST(turn AS VARCHAR) END AS title FROM conversations),
latest AS (SELECT conv_id, arg_max(title, seq) AS t FROM changes GROUP BY conv_id)
SELECT conv_id, COALESCE(NULLIF(TRIM(t), ''), title) AS title FROM titled LEFT JOIN latest USING (conv_id)""")
def k9(spark, sf):
    text = F.when(F.col("role") == "assistant", F.lit("  ")).otherwise(F.concat_ws(" ", "role", F.col("turn").cast("string")))
    changes = messages(spark, sf).select("conv_id", F.col("turn").alias("seq"), text.alias("title"))
    return chatlog.rename_conversations(titled(spark, sf), changes)


# --- prompts and tuning text -----------------------------------------------------------------

_SYSTEM = prompts.system_prompt("a guide")
_SYSTEM_SQL = "'" + _SYSTEM.replace("\n", "' || chr(10) || '") + "'"


@query("k10_build_prompts", f"""
SELECT conv_id, turn, '<s>[INST] ' || text || ' [/INST]' AS plain,
  '<s>[INST] ' || {_SYSTEM_SQL} || chr(10) || chr(10) || 'User question: ' || text || ' [/INST]' AS guided
FROM conversations WHERE role = 'user'""")
def k10(spark, sf):
    asked = messages(spark, sf).where("role = 'user'")
    return asked.select("conv_id", "turn", prompts.build_prompt("text").alias("plain"), prompts.build_prompt("text", _SYSTEM).alias("guided"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ECHO = "'<s>[INST] ' || question || ' [/INST] ' || chr(10) || answer || chr(10) || chr(10) || chr(10) || chr(10) || '[/INST] ' || answer || ' </s>'"
_DROP = "REPLACE(REPLACE(REPLACE(REPLACE({}, '<s>', ''), '</s>', ''), '[INST]', ''), '</INST>', '')"
_FIRST = "substr(raw, instr(raw, '[/INST]') + 7)"


@query("k11_clean_generated", f"""
WITH {PAIRS}, echoed AS (SELECT conv_id, turn, {_ECHO} AS raw FROM paired)
SELECT conv_id, turn, regexp_replace({_STRIP.format(_DROP.format(_STRIP.format(_FIRST)))}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g') AS first_cut,
  {_STRIP.format("string_split(raw, '[/INST]')[-1]")} AS last_cut FROM echoed""")
def k11(spark, sf):
    """Generated texts that echo their prompt, built from answered questions."""
    pairs = chatlog.paired_turns(messages(spark, sf))
    raw = F.concat(prompts.build_prompt("question"), F.lit(" \n"), F.col("answer"), F.lit("\n\n\n\n[/INST] "), F.col("answer"), F.lit(" </s>"))
    return pairs.withColumn("raw", raw).select(
        "conv_id", "turn", prompts.clean_generated("raw").alias("first_cut"), prompts.clean_generated("raw", "last").alias("last_cut")
    )


_MARKED_SQL = ("'# ' || role || chr(10) || '## Summary' || chr(10) || '### Part' || chr(10) || '**bold** and *soft* ' || text || chr(10) || '- one' "
               "|| chr(10) || '2. two' || chr(10) || chr(10) || chr(10) || chr(10) || 'next actions: go' || chr(10)")


def _markup_sql() -> str:
    sql = "marked"
    for pattern, new in fixed.MARKUP_RULES:
        swap = new.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''").replace("\n", "' || chr(10) || '")
        sql = f"regexp_replace({sql}, '{pattern}', '{swap}', 'g')"
    return _STRIP.format(sql)


@query("k12_markup_to_html", f"SELECT conv_id, turn, {_markup_sql()} AS html FROM (SELECT conv_id, turn, {_MARKED_SQL} AS marked FROM conversations)")
def k12(spark, sf):
    marked = F.concat(
        F.lit("# "), F.col("role"), F.lit("\n## Summary\n### Part\n**bold** and *soft* "), F.col("text"),
        F.lit("\n- one\n2. two\n\n\n\nnext actions: go\n"),
    )
    return messages(spark, sf).select("conv_id", "turn", prompts.markup_to_html(marked).alias("html"))


@query("k13_split_valid", r"""
SELECT conv_id, turn, CASE WHEN q IS NULL OR q = '' THEN 'No question provided' END AS reason
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN role = 'system' THEN ' ' END AS t,
  regexp_replace(t, '^\s+|\s+$', '', 'g') AS q FROM conversations)""")
def k13(spark, sf):
    asked = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", F.lit(" \n"))
    valid, rejected = prompts.split_valid(messages(spark, sf).withColumn("question", asked), "question")
    keep = ["conv_id", "turn", "reason"]
    return valid.withColumn("reason", F.lit(None).cast("string")).select(keep).unionByName(rejected.select(keep))


MAX_TOKENS = 512


@query("k14_token_windows", rf"""
SELECT doc_id, len(t) AS n_tokens, LEAST(len(t), {MAX_TOKENS}) AS n_kept,
  array_to_string(list_concat(t[1:{MAX_TOKENS}], list_transform(range(0, GREATEST({MAX_TOKENS} - len(t), 0)), lambda i: '</s>')), ' ') AS tokens
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS t FROM documents)""")
def k14(spark, sf):
    cut = prompts.token_windows(table(spark, sf, "documents"), "text", MAX_TOKENS)
    return cut.select("doc_id", "n_tokens", "n_kept", F.array_join("tokens", " ").alias("tokens"))


@query("k15_length_batches", """
WITH shuffled AS (SELECT doc_id, n_chars, ROW_NUMBER() OVER (ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 12) AS BIGINT), doc_id) AS pos FROM documents),
placed AS (SELECT *, (pos - 1) // 200 AS mega, ROW_NUMBER() OVER (PARTITION BY (pos - 1) // 200 ORDER BY n_chars DESC, doc_id) - 1 AS i FROM shuffled)
SELECT doc_id, n_chars, mega, i // 4 AS batch, i % 4 AS slot FROM placed""")
def k15(spark, sf):
    return prompts.length_batches(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


@query("k16_instruction_pairs", f"""
WITH {PAIRS} SELECT conv_id, turn, '<s>[INST] ' || question || ' [/INST] ' || answer || ' </s>' AS text FROM paired""")
def k16(spark, sf):
    return prompts.instruction_pairs(messages(spark, sf))


# --- streams ---------------------------------------------------------------------------------


@query("t1_stream_listings", PROFILE_ORACLES["a3_extract_listings"])
def t1(spark, sf):
    out, checkpoint = work_path(spark, "listings"), work_path(spark, "listings-state")
    pages = jobs.stream_files(spark, f"{sf}/page[s].parquet", jobs.PAGES)
    jobs.ingest_listings(pages, out, checkpoint, **LIST_LAYOUT).awaitTermination()
    return spark.read.parquet(out)


@query("t2_stream_event_counts", """
SELECT epoch_us(ts) // 86400000000 AS day, user_id, event_type, COUNT(*) AS n_events FROM events GROUP BY ALL""")
def t2(spark, sf):
    out, checkpoint, files = work_path(spark, "events"), work_path(spark, "events-state"), work_path(spark, "event-files")
    # Several files that are in no order of time: the counts do not depend on their number.
    table(spark, sf, "events").repartition(7, "event_id").write.parquet(files)
    counts = jobs.run_event_counts(jobs.stream_files(spark, files, jobs.EVENTS), out, checkpoint)
    day = F.floor(F.unix_micros("window_start") / F.lit(86_400_000_000)).cast("bigint")
    return counts.select(day.alias("day"), "user_id", "event_type", "n_events")


@query("t2_event_log", """
WITH marked AS (SELECT *, event_id % 3 = 0 AND ts <= (SELECT MAX(ts) FROM events WHERE event_id % 3 <> 0) - INTERVAL 5 DAY AS late FROM events)
SELECT epoch_us(ts) // 86400000000 AS day, user_id, event_type, COUNT(*) FILTER (NOT late) AS n_events, COUNT(*) FILTER (late) AS n_late FROM marked GROUP BY ALL""")
def t2_log(spark, sf):
    """The log after two runs: a third of the events comes in the second one, much of it too late."""
    root, files, events = work_path(spark, "event-log"), work_path(spark, "event-files"), table(spark, sf, "events")
    for rows in (events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0")):
        rows.write.mode("append").parquet(files)
        jobs.run_event_log(spark, files, root, late="5 days")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    day = lambda at: F.floor(at / F.lit(86_400_000_000)).cast("bigint").alias("day")
    keys = ["day", "user_id", "event_type"]
    kept = jobs.event_snapshot(spark, root).select(day(F.unix_micros("window_start")), *keys[1:], "n_events", F.lit(0).cast("bigint").alias("n_late"))
    late = jobs.late_events(spark, root).select(day(micros), *keys[1:]).groupBy(*keys).agg(F.lit(0).cast("bigint").alias("n_events"), F.count(F.lit(1)).alias("n_late"))
    return kept.unionByName(late).groupBy(*keys).agg(F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late"))
