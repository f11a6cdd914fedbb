"""Link graph, chat windows and mixing against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat_windows as W
from rankloom.llm import link_graph as G
from rankloom.llm.components import connected_components
from rankloom.llm.mixing import mix, word_count
from rankloom.llm.queries_urls import RULES

URLS = [
    (1, "http://Example.com/en/x?q#f", ("example.com", "/en/x", "example.com/en/", "block")),
    (2, "https://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
    (3, "http://badexample.com/en/", ("badexample.com", "/en/", "com/", "allow")),
    (4, "http://a.b.net/es/1", ("a.b.net", "/es/1", "net/es/", "block")),
    (5, "http://x.com", ("x.com", "", None, None)),
    (6, "http://x.com?a/b://c", ("x.com", "", None, None)),
    (7, None, ("", "", None, "allow")),
    (8, "no scheme/es/", ("", "", None, "allow")),
    (9, "http://b.net#/es/", ("b.net", "", None, "block")),
    (10, "://Ünï.ORG:80/p\nq", ("Ünï.org:80", "/p\nq", None, "allow")),
    (10, "://Ünï.ORG:80/p\nq", ("Ünï.org:80", "/p\nq", None, "allow")),
]


def test_rules_and_parsing(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u, _ in URLS], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit("clash"))
    got = {r.page_id: r for r in G.judge_urls(pages, RULES).collect()}
    for i, _, (host, path, rule, verdict) in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert G.judge_urls(pages.limit(0), RULES).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.org" for i in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): float(rng.randrange(1, 4)) for _ in range(40)}
    edges = {e: w for e, w in edges.items() if e[0] != e[1]}
    seeds = [(hosts[0], 3, 0), (hosts[1], 1, 0), (hosts[2], 0, 2)]
    got = {r.host: r for r in G.propagate(
        spark.createDataFrame([(*e, w) for e, w in edges.items()], "src string, dst string, w double"),
        spark.createDataFrame(seeds, "host string, allowed long, blocked long"), rounds=10, residual=0.0).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((12, 12))
    for (a, b), w in edges.items():
        m[at[a], at[b]] = w
    for column, matrix, k in (("trust", m, 1), ("distrust", m.T, 2)):
        seed = np.zeros(12)
        for s in seeds:
            seed[at[s[0]]] = s[k]
        seed /= seed.sum()
        step = matrix / np.maximum(matrix.sum(1, keepdims=True), 1e-300)
        x = seed
        for _ in range(10):
            x = 0.15 * seed + 0.85 * x @ step
        for h in got:
            assert got[h][column] == pytest.approx(x[at[h]], abs=1e-9)


def test_neighbours_under_a_shared_name_stay_clean(spark):
    """A blocked page condemns neither other hosts below its provider's name nor addresses that end alike."""
    providers = [(40, "http://github.io/", ""), (41, "http://x.org/", '<a href="http://github.io/">x</a>')]
    users = [(50 + i, f"http://u{i}.github.io/", "") for i in range(G.MOST_KIN)]
    pages = spark.createDataFrame([
        (1, "http://bad.co.uk/es/", ""), (2, "http://innocent.co.uk/", ""), (3, "http://a.github.io/es/", ""), (4, "http://b.github.io/", ""),
        (5, "http://10.0.0.5/es/", ""), (6, "http://77.0.0.5/", ""), (7, "http://0.0.5:80/", ""), (8, "http://10.0.0.5:80/", ""),
        (9, "http://cdn.site.org/es/", ""), (10, "http://www.site.org/", ""), (11, "http://site.org/", ""), *providers, *users], "page_id long, url string, html string")
    rules = [(h, "/es/", "block") for h in ("bad.co.uk", "a.github.io", "10.0.0.5", "cdn.site.org")]
    got = {r.page_id: r.verdict for r in G.judge_urls(pages, rules).collect()}
    # A site of few hosts answers for one of them, and so for what links to it.
    assert {i for i, v in got.items() if v == "block"} == {1, 3, 5, 9, 11}


def test_scores_travel_further_than_ten_links(spark):
    chain = [(i, f"http://h{i}.org/", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(20)]
    pages = spark.createDataFrame([*chain, (20, "http://h20.org/es/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in G.judge_urls(pages, [("h20.org", "/es/", "block")], residual=1e-9).collect()}
    assert all(r.verdict == "block" and r.distrust > 0 for r in got.values())


def test_links_carry_distrust_back(spark):
    page = lambda i, host, links: (i, f"http://{host}/", "".join(f'<a href="http://{x}/p">x</a>' for x in links))
    pages = spark.createDataFrame([
        page(1, "linker.org", ["bad.biz", "/local"]), page(2, "friend.org", ["other.org"]), page(3, "other.org", []),
        (4, "http://bad.biz/es/", ""), (5, "http://good.com/", '<A HREF=//friend.org/x>')], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in G.judge_urls(pages, [("com", "/", "allow"), ("biz", "/es/", "block")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}


def test_verdicts_do_not_depend_on_other_pages(spark):
    edges = [("good", "mid", 1.0), ("far", "linker", 1.0), ("linker", "bad", 1.0), ("linker", "mid", 1.0), ("mid", "last", 1.0)]
    edges += [(f"in{i}", "bad", 10.0) for i in range(1000)]
    edges = spark.createDataFrame(edges, "src string, dst string, w double")
    seeds = [("good", 1, 0), ("bad", 0, 1)]
    found = {}
    for others in (0, 10**7, 3 * 10**12):
        more = [("other", others, others)] if others else []
        rows = G.propagate(edges, spark.createDataFrame(seeds + more, "host string, allowed long, blocked long")).collect()
        assert all(0 < r.distrust for r in rows if r.host in ("far", "linker", "bad")) and all(0 < r.trust for r in rows if r.host in ("mid", "last"))
        found[others] = {r.host: (r.distrust > r.trust, round(r.trust * (1 + others), 9), round(r.distrust * (1 + others), 9)) for r in rows if r.host != "other"}
    assert found[0] == found[10**7] == found[3 * 10**12]


def turns_of(conv, n, rng, system):
    rows = [(conv, -1, "system", "be good " * system)] if system else []
    for t in range(n):
        rows.append((conv, t, "assistant" if t % 2 else "user", " ".join(rng.choice(["ok", "<|im_end|>\n", "</s>", "[INST]", "<~|", "[~~/INST]", "é\nx", ""]) for _ in range(rng.randrange(0, 40)))))
    return rows


def test_windows_read_back_and_keep_the_budget(spark):
    rng = random.Random(6)
    rows = turns_of(1, 300, rng, 4) + turns_of(2, 5, rng, 0) + turns_of(3, 60, rng, 30) + turns_of(None, 9, rng, 1)
    rows += [(4, 0, None, None), (4, None, "a b\n<|im_start|>", "x"), (5, 0, "user", "w " * 5000), (5, 1, "assistant", ""), (6, 0, "assistant", "t"), (6, 0, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("pos", F.lit("c"))
    windows = W.format_windows(df.repartition(7), budget=128, history=32).cache()
    back = {r.conv.id: r for r in W.read_back(windows).collect()}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is None, t or 0, r or "", x or ""))
    assert set(back) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        assert back[c].n_turns == len(turns)
        assert back[c].content == "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        assert back[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
    repeats = 0
    for w in windows.collect():
        pieces = w.formatted.split(W.END)[:-1]
        repeats += w.repeated
        fresh = len(pieces) - w.repeated
        assert fresh >= 1 and (w.n_tokens <= 128 or fresh == 1)
        # The system turn stands in front of every window of conversations that have one.
        if w.conv.id in (1, 3):
            assert pieces[0].startswith(W.START + "system\n")
        for s in w.loss_spans:
            assert w.formatted[s.start + s.length :].startswith(W.END)
    assert repeats > 20
    assert W.format_windows(df.limit(0)).count() == 0


def test_escaping_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<~|x", "[~~INST]<s></~s>", "<<||[[/INST]]", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", W.escape(F.col("t")).alias("e"), W.unescape(W.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def water(sizes, weights, share=1.5, cap=2.0):
    """Shares by weight with a cap, by handing the excess out again and again."""
    target, total, open_ = {s: 0.0 for s in sizes}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = (total - sum(target[s] for s in sizes if s not in open_)) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        source = rng.choice(["é", "b", None, "a", "Z", "", "hot", "hot", "hot"])
        rows.append((i if i % 50 else None, source, " ".join("w" for _ in range(rng.choice([0, 3, 20, 200])))))
    rows += [(1, "b", None), (2, "b", "x y"), (2, "b", "x y"), (3, "one", "a\x0bb\x1cc")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("_u", F.lit(0))
    got = mix(df).collect()
    assert got == mix(df).collect() and len(got) == len(rows)
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size and r._u == 0
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert mix(df.limit(0)).count() == 0
    assert {r.taken for r in mix(df.where("text is null")).collect()} == {0}
    counted = df.withColumn("a.b", word_count(F.col("text"))).withColumn("c`d", F.lit("kept"))
    again = mix(counted, size_col="a.b").collect()
    assert sorted(map(repr, [(r.doc_id, r.source, r.copies) for r in again])) == sorted(map(repr, [(r.doc_id, r.source, r.copies) for r in got]))
    assert {r["c`d"] for r in again} == {"kept"}


def test_mix_includes_by_size(spark):
    """Equal sources: documents come in as often as their size class should, found here by bisection."""
    kinds = [0] * 5 + [1] * 30 + [3] * 30 + [6] * 40 + [30] * 20 + [100] * 6 + [300]
    sources, share = 80, 0.8
    rows = [(s * 1000 + i, f"s{s:03}", n) for s in range(sources) for i, n in enumerate(kinds)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), weights=(1,), share=share, size_col="n", with_p=True).collect()
    classes = {n: 2 ** (n.bit_length() - 1) if n else 0 for n in kinds}
    low, high = 0.0, 1.0
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(1.0, rate * classes[n]) * n for n in kinds) < share * sum(kinds) else (low, rate)
    seen, taken = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.p == pytest.approx(min(1.0, rate * classes[r.size]), abs=1e-9)
        seen[r.size].append(r.copies)
        taken[r.source] += r.taken
    assert min(r.p for r in got if r.size) < 0.2 and max(r.p for r in got if r.size < 100) > 0.3
    for n, copies in seen.items():
        p = min(1.0, rate * classes[n])
        # Four standard deviations of independent draws, and what closing at a document's border may shift.
        assert abs(sum(copies) / len(copies) - p) <= 4 * (p * (1 - p) / len(copies)) ** 0.5 + 0.02, n
    assert all(abs(t - share * sum(kinds)) <= 50 for t in taken.values())


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
