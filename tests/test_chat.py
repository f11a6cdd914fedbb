from pyspark.sql import functions as F

from rankloom.operators import chatlog, prompts
from rankloom.sources import documents

LOG = [
    (1, 0, "user", "Hi there"), (1, 1, "assistant", "hi HI"), (1, 2, "user", "  "), (1, 9000, "user", "a.b"),
    (1, 9001, "assistant", "axb hi"), (2, 0, "system", "hi"), (2, 1, "user", "lonely"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def log(spark):
    return spark.createDataFrame(LOG, SCHEMA)


def test_search_is_literal(spark):
    got = chatlog.search_messages(log(spark), "A.B").collect()
    assert [(r.turn, r.highlighted) for r in got] == [(9000, '<mark class="hl">a.b</mark>')]
    assert chatlog.search_messages(log(spark), "  ").count() == 0
    assert chatlog.search_messages(log(spark), "(", "user").count() == 0


def test_cycle_crosses_blocks(spark):
    got = {(r.conv_id, r.turn): r for r in chatlog.match_cycle(log(spark), "hi").collect()}
    assert [got[1, t].first_match for t in (0, 1, 9001)] == [1, 2, 4]
    assert (got[1, 0].prev_turn, got[1, 1].next_turn, got[1, 9001].next_turn) == (9001, 9001, 0)
    assert (got[2, 0].prev_turn, got[2, 0].next_turn, got[2, 0].n_total) == (0, 0, 1)


def test_pairs_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(chatlog, "TURNS", 1)
    got = sorted((r.conv_id, r.turn, r.answer) for r in chatlog.paired_turns(log(spark)).collect())
    assert got == [(1, 0, "hi HI"), (1, 9000, "axb hi")]


def test_transcript_parts(spark):
    lines = chatlog.transcript_lines(log(spark), F.lit("t"))
    parts = {(r.conv_id, r.part): r.transcript for r in chatlog.transcripts(lines).collect()}
    assert parts[1, 0] == "=== Chat Transcript ===\n\n[User @ t]: Hi there\n[Bot @ t]: hi HI\n"
    assert parts[1, 8] == "[User @ t]: a.b\n[Bot @ t]: axb hi\n"
    assert parts[2, 0].endswith("[System @ t]: hi\n[User @ t]: lonely\n")


def test_write_transcripts(spark, tmp_path):
    lines = chatlog.transcript_lines(log(spark), F.lit("t"))
    chatlog.write_transcripts(chatlog.transcripts(lines), f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out", wholetext=True)
    assert sorted(r.part for r in back.select("part").collect()) == [0, 0, 8]


def test_append_ignores_unknown(spark):
    new = spark.createDataFrame([(7, 1, "user", "b", 5), (6, 1, "user", "a", 5), (8, 3, "user", "x", 1)],
                                "msg_id bigint, conv_id bigint, role string, text string, ts bigint")
    got = chatlog.append_messages(log(spark), new).where("turn > 9001").orderBy("turn").collect()
    assert [(r.conv_id, r.turn, r.text) for r in got] == [(1, 9002, "a"), (1, 9003, "b")]


def test_folders(spark):
    folders = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "folder string, conv_id bigint")
    merge = spark.createDataFrame([("a", "b")], "folder string, new_name string")
    assert sorted(map(tuple, chatlog.rename_folders(folders, merge).collect())) == [("b", 1), ("b", 2)]
    flags = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("z", 1, True)], "folder string, conv_id bigint, member boolean")
    assert sorted(map(tuple, chatlog.assign_folders(folders, flags).collect())) == [("a", 2), ("b", 1), ("b", 2)]


def test_store_documents(spark):
    docs = spark.createDataFrame([('[{"id":1,"title":"t","msgs":[{"role":"user","text":"x","ts":5}]}]',), ("{broken",), ("",), ("[]",), (None,)], "document string")
    got = [tuple(r) for r in documents.conversations_from_json(docs).collect()]
    assert got == [("1", "t", 0, "user", "x", 5)]  # ids are texts
    folders = spark.createDataFrame([('{"a":[1,2],"b":[]}',), ("nope",)], "document string")
    assert sorted(map(tuple, documents.folders_from_json(folders).collect())) == [("a", "1"), ("a", "2")]


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


def test_clean_generated(spark):
    raw = "<s>[INST] q [/INST] answer <s>x</s>\n\n\n\n\nmore [/INST] tail </s>"
    assert one(spark, prompts.clean_generated("t"), raw) == "answer x\n\nmore [/INST] tail"
    assert one(spark, prompts.clean_generated("t", "last"), raw) == "tail </s>"
    assert one(spark, prompts.clean_generated("t"), "  plain ") == "plain"


def test_markup(spark):
    html = one(spark, prompts.markup_to_html("t"), "### Small\n## Big\n**b** *i*\n- x\n1. y\nNext actions: z")
    assert html == ("<h3>Small</h3><h2>Big</h2><b>b</b> <i>i</i><br>• x<br><div class='list-item'><b>1.</b> y</div>"
                    "<br><br><br><b>Next actions:</b><br> z")


def test_split_valid(spark):
    df = spark.createDataFrame([("a",), (" \n",), (None,)], "q string")
    good, bad = prompts.split_valid(df, "q")
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["No question provided"] * 2


def test_token_windows(spark):
    df = spark.createDataFrame([(" a b  c",), ("",)], "t string")
    rows = prompts.token_windows(df, "t", 2).collect()
    assert [(r.n_tokens, r.n_kept, r.tokens) for r in rows] == [(3, 2, ["a", "b"]), (0, 0, ["</s>", "</s>"])]


def test_prompts(spark):
    assert one(spark, prompts.build_prompt("t"), "q") == "<s>[INST] q [/INST]"
    assert one(spark, prompts.build_prompt("t", "sys"), "q") == "<s>[INST] sys\n\nUser question: q [/INST]"
