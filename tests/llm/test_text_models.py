"""LM scoring, toxicity and language: brute force, held-out accuracy and odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm import exchange as X
from rankloom.llm import interpolation as I
from rankloom.llm.language import learn_dictionaries, letters, with_language
from rankloom.llm.toxicity import ORDER, build, figures, learn, windows, with_toxicity

DOCS = "doc_id long, text string"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (4, "One two"), (5, "word " * 30_000), (6, "é x ÉCOLE\x0b1")]


def tokens(text):
    return [*(text or "").encode().lower().split(), "$"]


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 9, 50), rng.integers(0, 2**63, 50).astype(np.uint64)):
        assert (A.unpack(A.pack(values)).astype(np.uint64) == values.astype(np.uint64)).all()
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (X.unpack_sorted(X.pack_sorted(keys)) == keys).all()


def test_word_hashes_follow_the_words():
    texts = ["A b c a", None, "", "  x\x0by  ", "a"]
    h, first = A.word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 2, 1]
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4


def interpolated(rows):
    """The whole model in plain Python; its weights come from exact cells."""
    part = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 for i, _ in rows}
    seqs = [(i, tokens(t), part[i] != 2, part[i] == 3) for i, t in rows]

    def counts(use):
        uni, bi = collections.Counter(), collections.Counter()
        for _, s, train, deleted in seqs:
            if use(train, deleted):
                uni.update(s)
                bi.update(zip(["^", *s], s))
        uni["^"] = uni["$"]
        return uni, bi

    uni, bi = counts(lambda train, deleted: train)
    kept, kept_bi = counts(lambda train, deleted: train and not deleted)
    n, v = sum(c for w, c in uni.items() if w != "^"), sum(1 for w in uni if w != "^")
    n_kept = sum(c for w, c in kept.items() if w != "^")
    cells = collections.Counter()
    for _, s, train, deleted in seqs:
        if train and deleted:
            for a, w in zip(["^", *s], s):
                pair = kept_bi[a, w] / max(1, kept[a]) * (v + 1)
                cells[int(I._bucket(np.array([kept[a]]))[0]), int(I._bin(np.array([pair]))[0]), int(I._bin(np.array([kept[w] / max(1, n_kept) * (v + 1)]))[0])] += 1
    table = I._weight_table(I.learn_weights(sorted((*k, c) for k, c in cells.items())))
    out = []
    for i, s, train, _ in seqs:
        score = 0.0
        for a, w in zip(["^", *s], s):
            w2, w1, w0 = table[int(I._bucket(np.array([uni[a]]))[0])]
            score += math.log10(w2 * bi[a, w] / max(1, uni[a]) + w1 * uni[w] / n + w0 / (v + 1))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s)
        out.append((i, train, len(s), sum(uni[w] > 0 for w in s), n, base, score))
    return out


def test_interpolation_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("aa bb Bb cc dd ee ff gg hh".split()) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += ODD
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash")).withColumn("block", F.lit(1)).repartition(5)
    got = sorted(map(tuple, I.score_texts(df, part != 2, part == 3).collect()), key=str)
    want = sorted(interpolated(rows), key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_interpolation_gives_probabilities_that_sum_to_one():
    table = I._weight_table(I.learn_weights([(0, 0, 380, 5), (3, 420, 390, 50), (3, 0, 390, 5), (4, 0, 0, 9)]))
    assert table.min() >= 0 and np.allclose(table.sum(1), 1) and table[0, 0] == 0 and (table[1:, 2] > 0).all()
    assert table[3, 0] > table[4, 0]


def test_interpolation_without_rows_or_training(spark):
    empty = spark.createDataFrame([], DOCS)
    assert I.score_texts(empty, F.lit(True), F.lit(False)).count() == 0
    one = I.score_texts(spark.createDataFrame([(1, "a b")], DOCS), F.lit(False), F.lit(False)).first()
    assert (one.train_tokens, one.n_known, one.score, one.base_score) == (0, 0, 0.0, 0.0)


def test_toxicity_windows_fold_case_and_marks():
    one, _ = windows(pa.array(["Ça--va!"]))
    other, first = windows(pa.array(["çA   vA "]))
    assert (one == other).all() and first.tolist() == [0, len("ça va ".encode())]


def test_toxicity_model_is_a_distribution():
    found, _ = windows(pa.array(["abab abba", "bbab aaab"]))
    label = np.repeat([0, 1], [10, 9])[: len(found)]
    keys = np.concatenate([np.unique(found[label == c]) for c in (0, 1)])
    of = np.repeat([0, 1], [len(np.unique(found[label == c])) for c in (0, 1)])
    model = build(of, keys, np.ones(len(keys)))
    assert np.isfinite(model["window"].values).all() and np.isfinite(model["context"].values).all()
    value, known = model["window"].find(np.array([keys[0], np.uint64(1)]))
    assert known.tolist() == [True, False] and value[1] == 0
    assert figures(model, pa.array([None, ""], pa.string())).tolist() == [0.0, 0.0]
    assert keys.max() < 1 << 8 * ORDER


def planted(n, seed):
    rng = random.Random(seed)
    plain = ["lo", "mar", "ten", "vis", "ka", "sol", "dir", "pen"]
    rows = []
    for i in range(n):
        text = ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        toxic = int(i % 4 == 0)
        for _ in range(4 * toxic):
            text.insert(rng.randrange(60), rng.choice(["zorg", "zorgs", "wuxy"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_finds_held_out_toxic_texts(spark):
    rows = planted(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + ODD[:1], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (7, None), (9999, 0)], "doc_id long, toxic int")
    model = learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in with_toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([got[i].predicted == t for i, _, t in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    rows = with_toxicity(docs, learn(docs, labels)).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    assert with_toxicity(docs.limit(0), learn(docs.limit(0), labels)).count() == 0


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "the cat and the dog went to the house of the old man", "en") for i in range(3)]
        + [(9, "le chat et le chien sont dans la maison du vieux homme", "fr"), (10, "x", None), (11, None, "fr")], "doc_id long, text string, lang string")
    learned = learn_dictionaries(docs, F.lit(True))
    assert sorted(learned) == ["en", "fr"]
    odd = spark.createDataFrame([*ODD, (7, "123 ... !!"), (8, "LE CHIEN!! ET!! LE CHAT!! DANS LA MAISON!!"), (9, "the dog went to the house " * 5000)], DOCS)
    got = {r.doc_id: r for r in with_language(odd.withColumn("score", F.lit("clash")), learned).collect()}
    assert {got[i].lang_pred for i in (None, 1, 2, 3, 7)} == {"und"} and all(got[i].rejected and got[i].score == 0 for i in (None, 2, 7))
    assert (got[8].lang_pred, got[9].lang_pred) == ("fr", "en") and not got[8].rejected
    assert with_language(odd.limit(0), learned).count() == 0
    nothing = with_language(odd, learn_dictionaries(docs.limit(0), F.lit(True)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_dictionaries_learn_from_the_middle_of_whole_texts(spark):
    text = "12 34 " * 50_000 + "opening " * 20_000 + "middle " * 60_000 + "closing " * 20_000
    docs = spark.createDataFrame([(text, "aa"), (text, "aa")], "text string, lang string")
    (learned,) = learn_dictionaries(docs, F.lit(True)).values()
    assert len(learned) == 112 << 10 and set(learned.decode().split()[1:-1]) == {"middle"}


def test_language_equals_plain_compressed_sizes(spark, sf):
    """Every text against every dictionary by one plain compression per piece, of letters picked one by one."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = learn_dictionaries(docs, F.lit(True))
    assert set(learned) == {r.lang for r in docs.select("lang").distinct().collect()}
    for row in with_language(docs, learned).collect():
        kept = "".join(c if c == "_" or c.isalnum() else " " for c in row.text.lower())
        words = "".join(" " if c == "_" or c.isdecimal() else c for c in kept).split()
        if not any(c.isalpha() for w in words for c in w):
            assert (row.lang_pred, row.rejected) == ("und", True)
            continue
        raw, sizes = f" {' '.join(words)} ".encode(), {}
        for lang, content in learned.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=3)
            coder = zstandard.ZstdCompressor(dict_data=known, level=3, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        first, second = sorted(sizes.values())[:2]
        assert sizes[row.lang_pred] == first
        assert row.margin == pytest.approx((second - first) / second) and row.rejected == (row.margin < 0.002)


def test_language_held_out_accuracy(spark):
    from rankloom.llm.queries_language import op7_language

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op7_language(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_sample_is_the_smallest_hashes(spark):
    """The share of hashes that are ordered holds all that are chosen, in large languages and small ones."""
    rows = [(f"wort {'abcdefghij'[i % 10] * (i // 10 + 1)} ende", "de") for i in range(3000)] + [(f"word {'k' * (i + 1)}", "en") for i in range(7)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(16)
    got = learn_dictionaries(docs, F.lit(True), per_language=20, dictionary_bytes=1 << 20)
    want = {}
    for row in docs.select("text", "lang", F.xxhash64("text").alias("h")).toPandas().sort_values("h").groupby("lang"):
        want[row[0]] = {letters(t) for t in row[1]["text"].head(20)}
    assert {lang: all(t in data for t in want[lang]) for lang, data in got.items()} == {"de": True, "en": True}
    assert {lang: len(data) for lang, data in got.items()} == {lang: sum(map(len, texts)) for lang, texts in want.items()}
