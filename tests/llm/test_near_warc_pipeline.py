"""Near duplicates, archives and the pipeline against brute force."""

import base64
import collections
import gzip
import hashlib
import itertools
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from rankloom.llm import hyperminhash as H
from rankloom.llm import warc as R

DOCS = "doc_id long, text string"


def near_rows(seed, n=25, copies=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 5, 9, 30, 120, 400]))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append(rng.choice([" ", "\n", "\x0b"]).join(text))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        text = list(hot)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = word()
        rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """Smallest reachable id of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                up[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))], len(groups)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_rows(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One Two"), (9004, "one two"), (None, "one two"), (None, "alone here"), (9005, "w " * 50_000)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash")).withColumn("component", F.lit(0))
    got = sorted(((r.id, r.n_shingles, r.component) for r in H.near_duplicates(df).collect()), key=str)
    want, _ = brute(rows)
    assert got == sorted(want, key=str)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    (one, own1), (other, own2) = H.sketch(a), H.sketch(b)
    jaccard, m = H.estimate(one, other, own1, own2, len(a), len(b))
    assert m == H.BUCKETS and abs(jaccard - 2 / 3) < 0.12
    far, _ = H.estimate(one, H.sketch(np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)))[0], own1, own2, len(a), 3000)
    assert far < 0.02
    assert (H.sketch(a)[0] == one).all()


def test_bands_find_similar_sets_of_any_size():
    rng = np.random.default_rng(5)
    for n in (7, 20, 100, 2000):
        missed = 0
        for _ in range(150):
            whole = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
            drop = int(n * 0.15)
            a, b = np.unique(whole), np.unique(whole[max(1, drop) :])
            keys = H.band_keys(np.stack([H.sketch(a)[0], H.sketch(b)[0]]))
            missed += not (keys[0] == keys[1]).any()
        assert missed == 0


def test_one_of_each_group_stays(spark):
    rows = near_rows(3) + [(1, None), (1, None), (None, "")]
    df = spark.createDataFrame(rows + rows[:5], DOCS).withColumn("_x", F.lit("kept"))
    got = H.one_of_each(df).collect()
    want, n_groups = brute([r for r in rows if shingles(r[1])])
    assert len([r for r in got if shingles(r.text)]) == n_groups and all(r._x == "kept" for r in got)
    assert {r.doc_id for r in got if shingles(r.text)} == {w[2] for w in want}
    assert len([r for r in got if not shingles(r.text)]) == 2
    assert H.one_of_each(df.limit(0)).count() == 0


def pages(spark):
    nested = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode("latin-1")
    rows = [(i, f"http://x.org/{i}%20 \n", f"<p>{i % 7}</p>" * (1 + i % 3)) for i in range(120)]
    rows += [(500, None, None), (501, "u", ""), (None, "v", "unique"), (None, "w", ""), (502, "z", nested * 50), (503, "z", "é" * 300_000), (3, "again", rows[3][2])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(0))


@pytest.mark.parametrize("range_bytes", [501, 10_000, 8 << 20])
def test_archives_round_trip(spark, range_bytes):
    rows, df = pages(spark)
    listed = R.write_archives(df.repartition(3), archive_bytes=3000)
    assert listed.count() > 3 and listed.agg(F.sum("records")).first()[0] == len(rows)
    got = R.read_archives(listed, range_bytes).collect()
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        least = min((x for x in groups[raw] if x is not None), default=None)
        revisit = len(groups[raw]) > 1 and least is not None and i != least
        want.append((i, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", least if revisit else None, True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    rows, df = pages(spark)
    got = R.read_archives(R.write_archives(df, least_bytes=15)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 15} == {"response"} and any(r.record_type == "revisit" for r in got)
    assert R.read_archives(R.write_archives(df.limit(0))).count() == 0


def test_stored_member_inside_a_payload_is_no_record(tmp_path):
    inner = R._member(R._record("other", 1, None, b"inner", None, None, False))
    # Level 0 keeps the payload's bytes as they are, magic number included.
    outer = gzip.compress(R._record("own", 2, None, inner * 20, None, None, False), 0)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + R._member(R._record("own", 3, None, b"x", None, None, False)))
    size = path.stat().st_size
    for step in (50, 333, size):
        found = []
        for start in range(0, size, step):
            with pafs.LocalFileSystem().open_input_file(str(path)) as file:
                found += [h["X-Page-ID"] for h, _ in R.records_in(file, size, start, min(start + step, size), "own")]
        assert found == ["2", "3"]


def test_long_headers_are_read(spark):
    urls = {1: "http://x.org/" + "a" * (2 << 20), 2: "http://x.org/" + "ab/" * (6 << 20), 3: "http://x.org/3"}
    df = spark.createDataFrame([(i, u, f"p{i}") for i, u in urls.items()], "page_id long, url string, html string")
    got = R.read_archives(R.write_archives(df.coalesce(1)), 4000).collect()
    assert {r.page_id: r.url for r in got} == urls and len(got) == 3 and all(r.sound for r in got)


def test_headers_name_what_is_there(spark):
    """Other readers see the url as it is, and a revisit names its response's record."""
    rows = [(1, "http://x.org/a%20b?ü=%C3%BC", "same"), (2, "http://x.org/two words\u2028\n", "same"), (3, None, "other")]
    listed = R.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    raw = gzip.decompress(open(listed.first().path.removeprefix("file:"), "rb").read()).decode()
    heads = {h["X-Page-ID"]: h for h in ({k: v for k, v in (x.split(": ", 1) for x in part.split("\r\n\r\n")[0].split("\r\n") if ": " in x)} for part in raw.split("WARC/1.1\r\n")) if "X-Page-ID" in h}
    assert heads["1"]["WARC-Target-URI"] == rows[0][1] and "X-Target-URI" not in heads["1"]
    assert heads["2"]["WARC-Target-URI"] == "http://x.org/two%20words%E2%80%A8%0A"
    assert heads["2"]["WARC-Refers-To"] == heads["1"]["WARC-Record-ID"] and heads["2"]["WARC-Refers-To-Target-URI"] == rows[0][1]
    assert {(r.page_id, r.url, r.refers_to) for r in R.read_archives(listed).collect()} == {(1, rows[0][1], None), (2, rows[1][1], 1), (3, None, None)}


def test_lost_records_are_an_error(spark):
    listed = R.write_archives(spark.createDataFrame([(i, "u", f"p{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1))
    with pytest.raises(ValueError, match="lists 6 records, 5 were read"):
        R.read_archives(listed.withColumn("records", F.col("records") + 1))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(7)
    syllables = {"aa": "ka lo mi ten var dos pel".split(), "bb": "schü zur gen ach ung keit ßen".split()}
    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        text = prose(lang, 80)
        if i % 4 == 0:
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["wuxy", "zorq"]))
            text = " ".join(words)
            labels.append((i, 0, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    passage = prose("aa", 50)
    rows += [(300 + k, rows[1][1] + (" end" if k else ""), "aa", "s0", 1) for k in range(3)]
    rows += [(310, f"{prose('aa', 30)} {passage} {prose('aa', 30)}", "aa", "s1", 1)]
    rows += [(320, "12 34 !!", "aa", "s1", 1), (321, None, None, None, None), (322, "", "bb", "s2", 0), (1, rows[1][1], "aa", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in {
        "documents": docs, "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, passage), (2, prose("bb", 40))], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path), rows


def test_stages_do_what_they_say(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("kept")).withColumn("a.b", F.lit(1))
    by_name = dict(P.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    every = sorted(r[0] for r in rows)
    spoken = by_name["language"](spark, docs, folder)
    assert spoken.columns == docs.columns and ids(spoken) == [i for i in every if i not in (320, 321, 322)]
    calm = by_name["toxicity"](spark, docs, folder)
    toxic = {r[0] for r in rows if r[0] < 300 and r[0] % 4 == 0}
    kept = ids(calm)
    assert calm.columns == docs.columns and len(toxic & set(kept)) <= 3 and len(set(every) - toxic - set(kept)) <= 3
    apart = by_name["near-dedup"](spark, docs, folder)
    assert apart.columns == docs.columns and ids(apart) == sorted(set(every) - {300, 301, 302})
    clean = by_name["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == [i for i in every if i != 310]
    mixed = by_name["mixing"](spark, docs, folder)
    assert set(mixed.columns) == {*docs.columns, "size", "source_size", "target", "copies", "taken"} and mixed.where("copies < 1").count() == 0
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_stage_links_near_copies_from_four_fifths(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]
    near, far = list(words), list(words)
    for i in (20, 60):
        near[i] = "x"  # ten of 100 shingles: 90 of 110
    for i in (20, 50, 80):
        far[i] = "y"  # fifteen of 100: 85 of 115
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    a, b, c = (shingles(t) for _, t in rows)
    assert 0.80 <= len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.80
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert {r.component for r in H.near_duplicates(docs).collect()} == {1, 2, 3}


def test_toxicity_stage_learns_from_documents_it_has(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300")
    # Most labelled ids belong to documents that no earlier stage kept.
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic")
    absent = spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels.union(absent).write.parquet(f"{folder}/more/labels.parquet")
    kept = {r.doc_id for r in P.toxicity(spark, docs, f"{folder}/more").collect()}
    toxic = {r[0] for r in rows if r[0] < 300 and r[0] % 4 == 0}
    assert len(toxic & kept) <= 3 and len({r[0] for r in rows if r[0] < 300} - toxic - kept) <= 3


def test_run_chains_the_stages(spark, corpus):
    folder, rows = corpus
    out = P.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {310, 320, 321, 322, 300, 301, 302} and len(out) == len(ids) > 100
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5
