"""Line deduplication, token alignment and collocations against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import alignment as T
from rankloom.llm import collocations as C
from rankloom.llm import line_dedup as L
from rankloom.llm.queries_tokens import TOKENIZERS

DOCS = "doc_id long, text string, lang string"


@pytest.fixture
def many_partitions(spark):
    """More partitions than lines have documents, so that lines reach over several."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def line_key(line):
    return line.strip(L.BLANKS).translate({c: c + 32 for c in range(65, 91)})


def lines_by_hand(rows, min_docs, keep_first):
    """(id, text) -> dropped places."""
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[line_key(line)].add(i)
    common = {k for k, ids in held.items() if k and len(ids) >= min_docs}
    first = {}
    for i, text in sorted(set((i, text or "") for i, text in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for place, line in enumerate(text.split("\n")):
            first.setdefault(line_key(line), (i, text, place))
    return {
        (i, text): {p for p, line in enumerate(text.split("\n"))
                    if line_key(line) in common and not (keep_first and first[line_key(line)] == (i, text, p))}
        for i, text in {(i, text or "") for i, text in rows}
    }


@pytest.mark.parametrize(("min_docs", "keep_first"), [(2, True), (3, False), (10, False), (7, True)])
def test_lines_equal_brute_force(spark, many_partitions, min_docs, keep_first):
    rng = random.Random(min_docs)
    pool = ["", "  ", "Über uns", "\tHot LINE ", "hot line", *[f"line {i}" for i in range(40)]]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(12)) + ["HOT line"] * rng.randrange(3))) for i in range(60)]
    rows += [(61, "hot line\n" * 300), (62, None), (63, ""), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).withColumn("keep", F.lit("clash")).withColumn("h", F.lit(1))
    bitmaps = L.keep_bitmaps(docs, min_docs, keep_first).persist()
    want = lines_by_hand(rows, min_docs, keep_first)
    texts = {(r.id, r.n_lines): r for r in bitmaps.collect()}
    assert len(texts) <= len(want) == bitmaps.count()
    got = collections.Counter((r.id, r.kept, r.n_lines, r.n_dropped) for r in L.apply_bitmaps(docs, bitmaps).collect())
    expected = collections.Counter()
    for i, text in ((i, t or "") for i, t in rows):
        lines, gone = text.split("\n"), want[i, text]
        expected[i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)] += 1
    assert got == expected


def test_lines_of_odd_rows(spark):
    rows = [(None, "a\nb"), (None, "a\nc"), (1, "a"), (2, "A "), (2, "a\nother")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], DOCS)
    got = {(r.id, r.kept) for r in L.apply_bitmaps(docs, L.keep_bitmaps(docs, 3, False)).collect()}
    assert got == {(None, "b"), (None, "c"), (1, ""), (2, ""), (2, "other")}  # three ids: null, 1 and 2
    assert {r.n_dropped for r in L.keep_bitmaps(docs, 4, False).collect()} == {0}
    assert L.apply_bitmaps(docs.limit(0), L.keep_bitmaps(docs.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000, None), (2, "y\n" * 200_000, None), (3, "y", None)], DOCS)
    assert {r.id: (r.n_lines, r.n_dropped) for r in L.keep_bitmaps(long, 2, False).collect()} == {1: (1, 0), 2: (200_001, 200_000), 3: (1, 1)}
    keep = [r for r in L.keep_bitmaps(long, 2, True).collect() if r.id == 2][0].keep
    assert len(keep) < 100 and L.bitmap(keep, 200_001).nonzero()[0].tolist() == [0, 200_000]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 3, shape) * (rng.random(shape) < 0.3) for shape in ((7, 11), (11, 5)))
    sparse = lambda m: T.from_entries(*np.nonzero(m), m[np.nonzero(m)], *m.shape)
    dense = lambda m, shape: np.bincount(m.row * shape[1] + m.column, m.value, shape[0] * shape[1]).reshape(shape)
    assert (dense(T.product(sparse(a), sparse(b)), (7, 5)) == a @ b).all()
    assert (dense(T.transposed(sparse(a)), (11, 7)) == a.T).all()
    none = T.from_entries(*[np.zeros(0, np.int64)] * 3, 0, 0)
    assert len(T.product(none, none).value) == 0


TEXTS = [
    "The quick brown fox, it's <|endoftext|> and </s> <s> here.", " leading  and trailing  ", "a\n\nb\tc  d　e", "Ünï cödé straße déjà-vu",
    "x" * 700, "日本語 テキスト 🙂🙃 family 👨‍👩‍👧", "▁ bar", "", None, " ", "3.14159 2,718 1e-9", "I'm we'll they've 'tis", "é é ́x",
    "null\x00byte and \x85next", "the the the the", "</s>", "tab\t space", "a b  c   d    e",
]


def vocabularies():
    return T.read_vocabularies(TOKENIZERS)


def encoded_whole(encoders, text):
    """Both tokenizers over the whole text: ids and byte ends; nothing if they do not spell it."""
    if not text:
        return None
    coded = encoders.spell(text)
    return coded and (coded[0].tolist(), coded[1].tolist(), np.cumsum(encoders.length_a[coded[0]]).tolist(), np.cumsum(encoders.length_b[coded[1]]).tolist())


def test_small_memory_and_strings_change_nothing(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())})
    encoders, found = T.Encoders(vocabularies()), []
    for memory, string, span in ((300_000, 1 << 16, 1 << 17), (3, 5, 7), (50, 1, 1)):
        for name, value in zip(("MEMORY", "STRING", "SPAN"), (memory, string, span), strict=True):
            monkeypatch.setattr(T, name, value)
        kept = T.Memory(encoders)
        for _ in range(2):
            found.append({k: [x.tolist() if isinstance(x, np.ndarray) else x for x in v] for k, v in T._block_rows(kept, 1, batch).items()})
    assert all(f == found[0] for f in found)


def test_alignment_equals_brute_force(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + TEXTS + TEXTS[:3]
    encoders = T.Encoders(vocabularies())
    assert encoders.cuts
    whole = [encoded_whole(encoders, t) for t in rows]
    assert sum(w is None for w in whole) == 3
    links, count = [], collections.Counter()
    for w in whole:
        pairs = [(x, y) for x, e in zip(w[0], w[2], strict=True) for y, f in zip(w[1], w[3], strict=True) if e == f] if w and len(w[0]) < 800 else None
        if w and pairs is None:
            at = dict(zip(w[3], w[1], strict=True))
            pairs = [(x, at[e]) for x, e in zip(w[0], w[2], strict=True) if e in at]
        links.append(pairs or [])
        count.update(pairs or [])
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    docs = spark.createDataFrame([(i if i % 7 else None, t, None) for i, t in enumerate(rows)], DOCS).withColumn("block", F.lit("clash"))
    got = collections.Counter(tuple(r) for r in T.align_documents(docs.repartition(3), vocabularies()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    want = collections.Counter()
    for i, (w, pairs) in enumerate(zip(whole, links, strict=True)):
        row = (0, 0, 0, 0, 0, 0, "")
        if w:
            a, b, ends_a, ends_b = w
            spelt, common = [], sorted(set(ends_a) & set(ends_b))
            for low, high in zip([0, *common], common, strict=False):
                spelt.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b))))
            row = (len(a), len(b), len(common), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs),
                   hashlib.sha256(";".join(spelt).encode()).hexdigest())
        want[(i if i % 7 else None, *row)] += 1
    assert got == want
    assert T.align_documents(docs.limit(0), vocabularies()).count() == 0


@pytest.mark.parametrize("kind", ["overlap", "group"])
def test_token_links_equal_brute_force(spark, kind):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], DOCS)
    encoders = T.Encoders(vocabularies())
    for r in T.token_links(docs, vocabularies(), kind).collect():
        w = encoded_whole(encoders, TEXTS[r.doc_id])
        if not w:
            assert (r.a, r.b, r.weight) == ([], [], [])
            continue
        a, b, ends_a, ends_b = w
        assert (r.a, r.b) == (a, b)
        common = sorted(set(ends_a) & set(ends_b))
        group = lambda e, common=common: sum(c < e for c in common)
        want = {}
        for i, (low, high) in enumerate(zip([0, *ends_a], ends_a, strict=False)):
            for j, (start, end) in enumerate(zip([0, *ends_b], ends_b, strict=False)):
                shared = max(0, min(high, end) - max(low, start)) if kind == "overlap" else int(group(high) == group(end))
                if shared:
                    want[i, j] = shared
        assert dict(zip(zip(r.a_place, r.b_place, strict=True), r.weight, strict=True)) == want


def phrases_by_hand(rows, min_count, longest, top, inside):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    some = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    rows = []
    for (lang, w), a in some.items():
        if any(100 * b >= inside * a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in some.items() if x == lang):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, rank = [], collections.Counter()
    for lang, score, a, phrase, left, right, words in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, words, -score))
    return out


@pytest.mark.parametrize(("min_count", "block_words", "inside"), [(3, 40, 100), (5, 1, 80), (4, 100_000, 100), (300, 500, 100)])
def test_collocations_equal_brute_force(spark, min_count, block_words, inside, monkeypatch):
    monkeypatch.setattr(C, "PART_MASS", 1000)  # in the driver: several partitions
    rng = random.Random(min_count)
    words = ["New", "york", "City", "der", "the", "of", "Ähre", "a", "b", "cc"]
    text = lambda: "".join(rng.choice(words) + rng.choice(["  ", " ", " ", "\t", ". ", "\n", ",", " new york city "]) for _ in range(rng.randrange(40)))
    rows = [(i % 20, text(), rng.choice(["en", "de", None, "und", ""])) for i in range(90)]
    rows += [(1, None, "en"), (1, "", "fr"), (2, ". ; .", "fr"), (3, "the the " * 400, "en"), (None, "b" * 100_000, "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = C.collocations(docs, min_count, 5, 25, inside, block_words=block_words)
    want = phrases_by_hand(rows, min_count, 5, 25, inside)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(want)
    assert want
    assert C.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    counts = spark.createDataFrame([("x", "a b", 2, big // 3), ("x", "a", 1, big // 2), ("x", "b", 1, big // 2 + 7)], "lang string, phrase string, n_words int, f long")
    totals = spark.createDataFrame([("x", big)], "lang string, n long")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: (counts, totals))
    row = C.collocations(spark.createDataFrame([], DOCS)).first()
    assert row.score == 1000 * (big // 3) * big // ((big // 2) * (big // 2 + 7))


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(4)
    for trial in range(20):
        stream = rng.zipf(1.3, 4000) % 900
        summary, parts = C.Summary(len(stream) // 50 + 1), np.array_split(stream, trial + 1)
        for part in parts:
            own = C.Summary(len(stream) // 50 + 1)
            keys, counts = np.unique(part, return_counts=True)
            own.merge(keys.astype(np.uint32), counts)
            summary.merge(own.keys, own.counts, own.taken)
        assert summary.taken < 50 and len(summary.keys) <= summary.capacity
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= 50].tolist()) <= set(summary.may_reach(50).tolist())


def test_packed_keys():
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0), [0], [65534, 65535, 131070, 2**28 - 1], np.unique(rng.integers(0, 2**28, 5000)), np.arange(70_000)):
        keys = np.asarray(keys).astype(np.uint32)
        for wide in (True, False):
            assert (C.unpack_keys(C.pack_keys(keys, wide), wide) == keys).all()


@pytest.mark.parametrize("many", [1, 6])
def test_partition_answers_hold_every_frequent_key(many):
    """Partitions with a very common key, whatever mass it has."""
    rng = np.random.default_rng(many)
    blocks = [np.append(rng.integers(0, 4000, 3000), np.full(50_000 if b else 3, 17)) for b in range(many)]
    pieces, total = [], collections.Counter()
    for b, stream in enumerate(blocks):
        keys, counts = np.unique(stream, return_counts=True)
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        counts, one = counts.clip(max=12), counts == 1
        pieces.append({"part": 0, "block": b, "wide": False, "ones": C.pack_keys(keys[one], False), "more": C.pack_keys(keys[~one], False), "counts": counts[~one].astype(np.uint8).tobytes()})
    for row, stream in zip(C.answer_part(pieces, 12), blocks, strict=True):
        assert row["taken"] < 12
        got = set(np.cumsum(C.A.unpack(row["keys"]), dtype=np.int64).tolist())
        assert {k for k in set(stream.tolist()) if total[k] >= 12} <= got <= set(stream.tolist())
