"""Whitening, URL filter and prefix trie against brute-force versions on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from esquina.llm import prefix_trie, url_filter, whitening
from esquina.llm.ship import ship

# --- whitening -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, component string, x int"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], VECTORS)


def usable(rows, size):
    return [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(c) < 1e13 for c in v)]


def brute_whitening(rows, size, most=16):
    good = usable(rows, size)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    held = [i for i in range(min(most, size)) if values[i] > size * 2.3e-16 * values[0]]
    z = ((x - sums / n) @ vectors_ / np.sqrt(np.where(values > 0, values, 1)))[:, held]
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(1), z, values[held] / values.sum()


@pytest.mark.parametrize("size", [3, 20])
def test_whitening_against_dense_solver(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, (rng.standard_normal(size) * (1 + np.arange(size)) / 8).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (None, rows[3][1])]
    rows += [(301, None), (302, []), (303, [None] * size), (304, [float("nan")] * size), (305, [float("inf")] * size), (306, [1e30] * size), (307, [0.5])]
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    ids, n, deviation, z, explained = brute_whitening(rows, size)
    k = z.shape[1]
    assert len(got) == len(ids) * k
    assert (got.n == n).all() and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert np.allclose(got[got.vec_id == 1].sort_values("component").explained, explained, rtol=1e-9)
    mine = sorted(((r.vec_id if r.vec_id == r.vec_id else -1), r.component, r.deviation, r.whitened) for r in got.itertuples())
    sign = [np.sign(next(m[3] for m in mine if m[0] == 1 and m[1] == j + 1) * z[ids.index(1), j]) for j in range(k)]
    want = sorted((-1 if i is None else i, j + 1, int(d), float(row[j] * sign[j])) for i, d, row in zip(ids, deviation, z) for j in range(k))
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    assert np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-8)


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    flat = whitening.whitened(vectors(spark, [(i, [float(i), 0.0]) for i in range(4)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 4


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0.5], [3.0] * 6, [1e6, 1, 1e-6, 1e-12, 0, 0], [0.0] * 6, [2, 1, 0, -1, -2, -2]])
def test_divide_and_conquer_eigenvectors(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((6, 6)))
    v = (q * np.array(values, float)) @ q.T
    found, u = whitening.eigen(v)
    scale = max(1e-300, np.abs(values).max())
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * scale)
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-13)
    assert np.allclose(v @ u, u * found, atol=1e-13 * scale)


def test_polar_factor_is_the_sign():
    a = np.diag([4.0, -2.0, 1e-9, -1e-12])
    assert np.allclose(whitening.polar_factor(a), np.diag([1.0, -1, 1, -1]), atol=1e-12)


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 5], [0, 5], [3, 5]], np.int64)
    assert whitening.deviations(x, 3, np.array([2**40 + 3, 15], object)) == [None, None, None]
    x = np.array([[2**20, 5], [0, 5]], np.int64)
    assert whitening.deviations(x, 2, np.array([2**20, 10], object)) == [2**40, 2**40]


# --- URL filter ------------------------------------------------------------

def all_splits(word):
    if not word:
        yield []
    for i in range(1, min(len(word), url_filter.LONGEST_WORD) + 1):
        for rest in all_splits(word[i:]):
            yield [word[:i], *rest]


def split_score(words, counts, total):
    return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)


@pytest.mark.parametrize("part", ["", "a", "cheappills", "pillscheap", "newsnews", "xqz", "thecheapxnews"])
def test_viterbi_is_the_best_of_all_splits(part):
    counts = {"cheap": 40, "pills": 7, "news": 90, "the": 500, "he": 300, "ill": 12, "new": 80, "s": 3, "a": 200}
    total = sum(counts.values())
    found = url_filter.best_split(part, counts, total)
    assert "".join(found) == part
    assert math.isclose(split_score(found, counts, total), max(split_score(w, counts, total) for w in all_splits(part)), abs_tol=1e-9)


def test_split_is_linear_in_a_long_name(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, "http://" + "cheappills" * 40 + ".net/", "<p>cheap pills cheap pills</p>")], "page_id long, url string, html string")
    [row] = url_filter.filter_urls(pages).collect()
    assert "".join(row.words) == "cheappills" * 40 + "net" and row.verdict == "block"


PAGES = "page_id long, url string, html string, host int, words int, n int, rule int"


def judged(spark, urls):
    ship(spark)
    html = "<script>casino casino</script><p>The river and the old bridge news. Cheap pills.</p>"
    pages = spark.createDataFrame([(i, u, html, 1, 2, 3, 4) for i, u in urls], PAGES)
    return {(r.page_id, r.host, r.path): (r.rule, r.verdict, r.words) for r in url_filter.filter_urls(pages).collect()}, url_filter.filter_urls(pages).count()


def test_rules_and_words(spark):
    urls = [
        (1, "http://a.Example.ORG/es/5?x=1"), (2, "https://example.org/en/12#t"), (3, "https://example.org/en/2"), (4, "http://x.org"),
        (5, "http://shop.com/fr/1"), (6, "http://shop.com/de/1"), (7, "http://notexample.org/es/1"), (8, "http://cheappills.net/x"),
        (9, "http://theoldbridgenews.net/en/"), (10, None), (11, "no scheme"), (12, "http://cheappills.com/fr/x"), (13, "http://"),
        (14, "http://org/"), (14, "http://org/"), (None, "http://q.net/casino-bonus?org/"), (15, "ftp://h.net#/es/"), (16, "x://a.net/u://b.org/c"),
    ]
    got, n = judged(spark, urls)
    assert n == len(urls)
    want = {
        (1, "a.example.org", "/es/5"): ("example.org/es/", "block"), (2, "example.org", "/en/12"): ("example.org/en/1", "block"),
        (3, "example.org", "/en/2"): ("org/", "allow"), (4, "x.org", ""): (None, "allow"), (5, "shop.com", "/fr/1"): ("com/fr/", "allow"),
        (6, "shop.com", "/de/1"): ("com/de/", "block"), (7, "notexample.org", "/es/1"): ("org/", "allow"),
        (8, "cheappills.net", "/x"): (None, "block"), (9, "theoldbridgenews.net", "/en/"): (None, "allow"), (10, "", ""): (None, "allow"),
        (11, "", ""): (None, "allow"), (12, "cheappills.com", "/fr/x"): ("com/fr/", "allow"), (13, "", ""): (None, "allow"),
        (14, "org", "/"): ("org/", "allow"), (None, "q.net", "/casino-bonus"): (None, "block"), (15, "h.net", ""): (None, "allow"),
        (16, "a.net", "/u://b.org/c"): (None, "allow"),
    }
    assert {k: v[:2] for k, v in got.items()} == want
    assert got[(9, "theoldbridgenews.net", "/en/")][2] == ["the", "old", "bridge", "news", "net", "en"]
    assert judged(spark, []) == ({}, 0)


def test_bayes_against_counts(spark):
    ship(spark)
    rows = [("http://win.net/a", True), ("http://win.net/b", True), ("http://river.net/a", False), ("http://lake.net/a", None), ("http://win.net/a", True)]
    counts = spark.createDataFrame([("win", 5), ("river", 5), ("net", 9), ("a", 1), ("b", 1)], "word string, n long")
    model = url_filter.train(spark.createDataFrame(rows, "url string, blocked boolean"), counts, prior=0.5)
    yes, no = defaultdict(int, win=2, net=2, a=1, b=1), defaultdict(int, river=1, net=1, a=1)
    words = set(yes) | set(no)
    s = url_filter.SMOOTHING
    for w in words:
        p, q = (c[w] + s for c in (yes, no))
        assert math.isclose(model.words[w], math.log(p / (6 + s * 5)) - math.log(q / (3 + s * 5)))
    assert model.odds == 0 and set(model.words) == words


def test_word_counts_leave_markup_out(spark):
    ship(spark)
    pages = spark.createDataFrame([("<b class='x'>Été</b> one<style>two</style>one " + "z" * 30,), (None,), ("",)], "html string")
    assert {r.word: r.n for r in url_filter.word_counts(pages, F.col("html")).collect()} == {"été": 1, "one": 2}


# --- prefix trie -----------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, path string, k1 int, n int"


def conversations(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], TURNS)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(math.fmod(c, 100))
        turns = own.get(family, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            node = nodes.setdefault(key, {"conv": c, "n": 0, "ends": [], "children": set()})
            node["n"] += 1
            if d:
                nodes[key[:-1]]["children"].add(key)
            if d == len(turns):
                node["ends"].append(c)
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        node["leaves"] = sum(nodes[x]["leaves"] for x in node["children"]) or 1
        node["saved"] = sum(nodes[x]["saved"] for x in node["children"]) + ((node["n"] - 1) * len(key[-1][1]) if key else 0)
    return sorted(
        (v["conv"], len(k), nodes[k[:-1]]["conv"] if k else -1, v["n"], len(v["children"]), v["leaves"], v["saved"],
         hashlib.sha256(",".join(map(str, sorted(v["ends"]))).encode()).hexdigest())
        for k, v in nodes.items()
    )


def node_tuples(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def random_turns(seed, convs, most, kinds, ids=None):
    rng = random.Random(seed)
    ids = ids or [rng.randrange(-300, 900) for _ in range(convs)]
    return [(c, rng.choice([None, t, t // 2]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", *["x" * k for k in range(kinds)]])) for c in ids for t in range(rng.randrange(most))]


def test_trie_of_odd_rows(spark):
    rows = random_turns(1, 150, 6, 2) + [(None, 1, "user", "x"), (7, 1, "user", "ñandú\U0001f600"), (7, 1, "user", "ñandú\U0001f600")]
    assert node_tuples(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_long_chains_and_copies(spark):
    # One chain of 70 turns that conversations leave or end in at every depth, and thousands of equal ones.
    rows = [(c, t, "user", f"t{t}" if t < c or c % 3 else f"own {c} {t}") for c in range(70) for t in range(70 if c % 3 else c)]
    rows += [(c, t, "system", "same") for c in range(1000, 3200) for t in range(2)]
    assert node_tuples(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 0, "user", "x")])).count() == 0
    rows = [(6 * 100 + 1, 0, None, None)]
    assert node_tuples(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: (x & -x, x))


def test_exit_nodes_by_fat_binary_search(spark):
    rows = random_turns(5, 120, 30, 1, ids=list(range(120)))
    trie = prefix_trie.build(conversations(spark, rows))
    settled = {(r.k1, r.k2): r for r in trie.nodes.collect()}
    patterns = trie.classes.select("cid", "path")
    deepest = {r.cid: max(s["depth"] for s in r.path if (s["k1"], s["k2"]) in settled) for r in patterns.collect()}
    assert {r.cid: r.a for r in prefix_trie.locate(patterns, trie.nodes).collect()} == deepest
    # A node is a branching point, an end or the root, and its edge begins at its parent.
    ends = {(r.k1, r.k2) for r in trie.classes.collect()}
    children = defaultdict(int)
    for r in settled.values():
        children[(r.p1, r.p2)] += 1
        assert len(r.edge) == r.depth - r.parent_depth and (r.depth == 0 or settled[(r.p1, r.p2)].depth == r.parent_depth)
    assert all(k in ends or children[k] > 1 or r.depth == 0 for k, r in settled.items())
