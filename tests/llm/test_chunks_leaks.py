"""Chunk fingerprints and benchmark decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm import chunks as C
from rankloom.llm import decontaminate as D

DOCS = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_gear_depends_on_the_last_bytes_only():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    assert (C.gear(data)[200:] == C.gear(data[150:])[50:]).all()


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(3)
    text = prose(rng, 800).encode()
    shifted = b"inserted words " + text
    one, other = list(C.fingerprints([text, shifted]))
    assert one[1].max() <= C.MOST and C.likeness(one, other) > 0.9
    ends, counts = C.chunk_ends(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
    assert ends[-1] == len(text) and counts.tolist() == [len(ends)]
    assert C.from_text(C.as_text(one))[0].tolist() == one[0].tolist()


def test_a_text_has_one_fingerprint_whatever_stands_beside_it():
    rng = random.Random(4)
    texts = [prose(rng, n).encode() for n in (1, 3, 40, 0, 200)]
    together = [C.as_text(p) for p in C.fingerprints(texts)]
    assert together == [C.as_text(next(C.fingerprints([t]))) for t in texts]


def test_chunks_equal_a_byte_by_byte_chunker():
    rng = random.Random(6)
    for size in (0, 1, 11, 12, 13, 700, 5000):
        text = bytes(rng.choice([rng.randrange(256), 32, 101]) for _ in range(size))
        h, cuts, start = 0, [], 0
        for b in bytes(32):
            h = ((h << 1) + int(C._GEAR[b])) % 2**32
        for i, b in enumerate(text, 1):
            h = ((h << 1) + int(C._GEAR[b])) % 2**32
            n = i - start
            if n == C.MOST or i == size or (n >= C.NORMAL and h >> 28 == 0) or (C.LEAST <= n < C.NORMAL and h >> 26 == 0):
                cuts.append((start, i))
                start = i
        digests = {int(A.span_hash(A.prefix_hash(np.frombuffer(text[a:b], np.uint8), A.EXACT), np.array([0]), np.array([b - a]))[0]): b - a for a, b in cuts}
        found = next(C.fingerprints([text]))
        assert dict(zip(found[0].tolist(), found[1].tolist(), strict=True)) == digests


@pytest.mark.parametrize("rows", [0, 1, 60])
def test_edits_equal_brute_force(spark, rows):
    rng = random.Random(rows)
    data = [(i * 7 if i % 9 else -i, prose(rng, rng.choice([0, 1, 30, 120]))) for i in range(rows)]
    if rows > 1:
        data += [(None, "no id é"), (5000, None), (5001, "日本語テキスト" * 4000), (5001, "日本語テキスト" * 4000)]
        data += [(-(2**63), "the least id"), (2**63 - 1, "the greatest id")]
    df = spark.createDataFrame(data, DOCS).withColumn("block", F.lit("clash")).withColumn("h", F.lit(0))
    got = C.fingerprint_edits(df).collect()
    assert len(got) == len(data)
    texts = sorted(((i is None, -(i or 0), t or "") for i, t in data))
    follow = {(t[0], t[1]): texts[(k + 1) % len(texts)][2] for k, t in enumerate(texts)}
    own = {(t[0], t[1]): t[2] for t in texts}
    for r in got:
        key = (r.doc_id is None, -(r.doc_id or 0))
        n = len(own[key]) // 3
        edited = {own[key][: len(own[key]) - n] + f[:n] for f in ({follow[key], own[key]} if r.doc_id == 5001 else {follow[key]})}
        assert r.n_chars == len(own[key]) and r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edited}
        assert r.near_edited == C.likeness(C.from_text(r.fingerprint), C.from_text(r.edited_fingerprint)) and 0 <= r.near_next <= 1


def edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.33:
            chars[p] = "z"
        elif kind < 0.66:
            del chars[p]
        else:
            chars.insert(p, "y")
    return "".join(chars)


def distance(pattern, text):
    """Fewest edits of ``pattern`` anywhere in ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_filter_and_alignment_lose_no_window():
    rng = random.Random(8)
    items = [(k, prose(rng, 30)) for k in range(4)]
    index = D.Index.of(items, 12, 96, 0.06)
    for n in range(0, 16, 2):
        item, text = rng.choice(items)
        doc = prose(rng, 20) + " " + edit(rng, text, n) + " " + prose(rng, 20)
        folded = "".join(map(chr, D.fold(doc)))
        windows = ["".join(map(chr, index.points[a : a + n])) for a, n in zip(index.start, index.size, strict=True)]
        want = {index.items[index.owner[w]] for w, part in enumerate(windows) if distance(part, folded) <= index.edits[w]}
        found = index.matches([doc])[0]
        assert {m["item_id"] for m in found} == want
        if n == 0:
            assert found[0]["edits"] == 0 and found[0]["windows"] == found[0]["of_windows"]


def test_quotes_are_found_wherever_they_begin(spark):
    rng = random.Random(12)
    passage = prose(rng, 60)
    whole = "".join(map(chr, D.fold(passage)))
    quotes = [(k, f"{prose(rng, 8)} {whole[k : k + 80]} {prose(rng, 8)}") for k in range(len(whole) - 79)]
    docs = spark.createDataFrame([*quotes, (-1, prose(rng, 60))], DOCS)
    got = D.with_matches(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).where(F.size("matches") > 0)
    assert {r.doc_id for r in got.collect()} == {k for k, text in quotes if whole[k : k + 80] in text} and len(quotes) > 200


def test_decontamination_of_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 40)
    docs = [(1, f"x {passage.upper()}!! y"), (2, prose(rng, 300)), (3, None), (None, ""), (4, prose(rng, 40_000) + passage), (4, passage), (5, passage[:60])]
    benchmark = spark.createDataFrame(
        [(10, passage), (11, passage), (11, passage), (12, None), (13, "-- !"), (14, prose(rng, 40)), (None, passage), (-1, prose(rng, 40))], "item_id long, text string"
    )
    df = spark.createDataFrame(docs, DOCS).withColumn("matches", F.lit("clash")).withColumn("a.b`c", F.lit(7))
    want = [(1, [None, 10, 11]), (4, [None, 10, 11]), (4, [None, 10, 11])]
    whole = None
    for limit in (D.BLOCK_POINTS, 300, 70):
        monkeypatch.setattr(D, "BLOCK_POINTS", limit)
        got = D.with_matches(df, benchmark).collect()
        assert sorted((r.doc_id, [m.item_id for m in r.matches]) for r in got if r.matches) == want and len(got) == len(docs)
        assert {r["a.b`c"] for r in got} == {7}
        # An item cut into several indexes is one match with all its windows.
        result = sorted((r.doc_id, r.text, [tuple(m) for m in r.matches]) for r in got if r.matches)
        whole = whole or result
        assert result == whole and all(m[2] == m[3] for _, _, ms in result for m in ms)
        assert D.indexes(benchmark, "item_id", "text", 12, 64, 17).count() == 1 if limit > 300 else True
    assert D.with_matches(df.limit(0), benchmark).count() == 0
    assert all(not r.matches for r in D.with_matches(df, benchmark.limit(0)).collect())


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "Short"), (2, "two, words"), (3, "x"), (4, "eleven char"), (5, "twelve chars"), (6, "日本")]
    texts = ["a short one", "shorter", "short", "TWO  words", "two wordsy", "x", "", None, "ax xa", "eleven-char!", "twelve chars", "日本 y", "日本語", "short short x"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = D.with_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()

    def folded(text):
        return "".join(map(chr, D.fold(text)))

    for r in got:
        want = [i for i, t in items if f" {folded(t)} " in f" {folded(r.text)} "]
        assert [m.item_id for m in r.matches] == want
        for m in r.matches:
            assert (m.edits, m.windows, m.of_windows) == (0, 1, 1)
            assert f" {folded(r.text)} "[m["at"] :].startswith(f" {folded(dict(items)[m.item_id])} ")
