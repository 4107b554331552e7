import itertools
import random

import pytest
from pyspark.sql import functions as F

from esquina.functions import analysis as an
from esquina.operators import search
from esquina.operators.stage import settle


def stream(spark, text):
    df = spark.createDataFrame([(text,)], "s string").withColumn("ws", F.expr(an.street_words("s")))
    return [(r["pos"], r["term"]) for r in df.select(F.inline(F.expr(an.query_entries("ws")))).collect()]


@pytest.mark.parametrize("text, want", [("av costa", "avenida cosanta"), ("avda Av. gral.gral", "avenida Av. generalgeneral"), ("stav s.sto", "santav sansanto")])
def test_abbreviations(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(F.expr(an.expand_abbreviations("s")).alias("r")).first()
    assert got["r"] == want


def test_html(spark):
    text = "<p>San<b>ta</b> F&eacute;</p><script>x<y</script><!-- no -->a < b &amp;lt;"
    got = spark.createDataFrame([(text,)], "s string").select(F.expr(an.html_strip("s")).alias("r")).first()
    assert got["r"] == "\nSanta Fé\n  a < b &lt;"


def test_query_chain(spark):
    assert stream(spark, "9 de Julio") == [(0, "9"), (0, "nueve"), (1, "d"), (2, "julio"), (2, "j")]
    assert ("31" in [t for _, t in stream(spark, "treinta y uno")])
    # "uno" and "y" are stop words.
    assert stream(spark, "31 x") == [(0, "31"), (0, "treinta"), (1, "x")]


def test_edge_grams_and_shingles(spark):
    df = spark.createDataFrame([("Belgrano ab",)], "s string").withColumn("ws", F.expr(an.street_words("s")))
    df = df.withColumn("stream", F.expr(an.query_entries("ws")))
    terms = {r["term"] for r in df.select(F.inline(F.expr(an.edge_grams(an.shingles("stream"))))).collect()}
    assert {"bel", "belgrano", "belgrano b", "belgrano b ab", "b a", "b ab"} <= terms
    assert "ab" not in terms and all(3 <= len(t) <= 15 for t in terms)


def damerau(a, b):
    d = {(-1, -1): len(a) + len(b)}
    last = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = len(a) + len(b)
        if i >= 0:
            d[i, 0] = i
    for j in range(-1, len(b) + 1):
        d[-1, j] = len(a) + len(b)
        if j >= 0:
            d[0, j] = j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            if not cost:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + i - k + j - l - 1)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_fuzzy_terms_are_those_of_brute_force(spark):
    rnd = random.Random(11)
    words = {"ma" + "".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(150)}
    vocabulary = spark.createDataFrame([(w,) for w in sorted(words)], "found string")
    terms = sorted(rnd.sample(sorted(words), 30)) + ["maacbb", "mabaca", "mb", "macabcab"]
    got = {(r["term"], r["found"]): r["edits"] for r in search.fuzzy_terms(spark.createDataFrame([(t,) for t in set(terms)], "term string"), vocabulary).collect()}
    want = {}
    for t, w in itertools.product(set(terms), words):
        budget = 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
        if t[:2] == w[:2] and damerau(t, w) <= budget:
            want[t, w] = damerau(t, w)
    assert got == want


def docs(spark, names):
    return spark.createDataFrame([(i, f"c{i}", n) for i, n in enumerate(names)], "id long, numero_cal string, nombre_cal string")


def ask(spark, table, rows):
    df = spark.createDataFrame(rows, "req_id long, qstr string, limit int")
    out = {}
    for r in search.search_suggest(df, table).orderBy("req_id", "rank").collect():
        out.setdefault(r["req_id"], []).append(r["nombre_cal"])
    return out


def test_phrase_beats_scattered_words(spark):
    table = docs(spark, ["San Martin", "Martin Garcia San Roque Norte Viejo", "Belgrano", "", "Martin San"])
    got = ask(spark, table, [(1, "san martin", 10), (2, "belgrnao", 10), (3, "", 10), (4, "bel", 10)])
    assert got[1][0] == "San Martin" and got[2] == ["Belgrano"] and got[4] == ["Belgrano"] and 3 not in got


def test_phrase_slop_and_repeats(spark):
    index = search.search_index(docs(spark, ["abc uuu vvv www xyz", "abc uuu vvv www zzz xyz", "abc xyz", "xyz abc", "abc"]))
    texts = search.prepare_texts(spark.createDataFrame([("abc xyz",), ("abc abc",)], "qstr string"))
    texts = settle(texts, "texts")
    parts = search.clause_inputs(texts, index)
    found = search.phrase_scores(parts.entries, parts.weighted[search.STREET])
    named = found.join(index.names, "nid").join(texts.select("qid", "qstr"), "qid")
    got = {(r["qstr"], r["nombre_cal"]) for r in named.collect()}
    assert ("abc xyz", "abc xyz") in got and ("abc xyz", "xyz abc") in got and ("abc xyz", "abc uuu vvv www xyz") in got
    assert ("abc xyz", "abc uuu vvv www zzz xyz") not in got and not any(q == "abc abc" for q, _ in got)


@pytest.mark.parametrize("hot", [False, True])
def test_documents_of_one_name_crowd_out_others(spark, hot, request):
    if hot:
        request.getfixturevalue("hot_rows")
    table = docs(spark, ["Roca"] * 12 + ["Roca Norte"] * 3 + ["Roca Sur"])
    got = ask(spark, table, [(1, "roca", 2), (2, "roca", 3), (3, "roca", 10), (4, "roca", 60)])
    assert got[1] == ["Roca"] and got[2][0] == "Roca" and len(got[2]) == 2 and len(got[3]) == 3 and 4 not in got


def many_names(n):
    """Names that all have one word, few that have a second, and names of several lengths."""
    rnd = random.Random(5)
    words = ["costa", "norte", "roca", "luna", "verde", "plaza", "brown", "perez"]
    names = [f"barrio {i}" if i % 3 else f"barrio {rnd.choice(words)} {i}" for i in range(n)]
    return names + [f"barrio {w} del barrio" for w in words] + ["barrio"] * 5 + ["barrio luna"] * 300


ASKED = ["barrio", "barri", "barrio luna", "luna barrio", "barrio 77", "bario lun", "verde roca", "nada", "barrio brown 1", "b"]


def ranked(scores, names):
    """The 200 best of each query, by brute force."""
    out = {}
    for q, nid, score in scores:
        out.setdefault(q, []).append((-score, names[nid], nid))
    return {q: [(nid, -s) for s, _, nid in sorted(rows)[: search.MAX_FETCH]] for q, rows in out.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_cut_by_block_bounds_is_exact_and_scores_little(spark, hot, request, monkeypatch):
    if hot:
        request.getfixturevalue("hot_rows")
    index = search.search_index(docs(spark, many_names(4000)))
    texts = settle(search.prepare_texts(spark.createDataFrame([(q,) for q in ASKED], "qstr string")), "texts")
    parts = search.clause_inputs(texts, index)
    every = [tuple(r) for r in search.score_names(parts, index).select("qid", "nid", "score").collect()]
    bounds = {(r.qid, r.block): r.bound for r in search.score_bounds(parts, index).collect()}
    assert all(score <= bounds[q, nid >> search.BLOCK_BITS] for q, nid, score in every)
    assert {(q, nid >> search.BLOCK_BITS) for q, nid, _ in every} <= set(bounds)

    scored = []
    whole = search.score_names
    monkeypatch.setattr(search, "score_names", lambda *a: scored.append(settle(whole(*a), "scored")) or scored[-1])
    found = {}
    for r in sorted(search.best_names(parts, index).collect(), key=lambda r: (-r.score, r.first_id)):
        found.setdefault(r.qid, []).append((r.nid, r.score))
    assert found == ranked(every, {r.nid: r.first_id for r in index.names.collect()})
    # "barrio" is in all 4000 names; a query that has it is answered from a few blocks.
    per_query = {}
    for r in [r for df in scored for r in df.groupBy("qid").count().collect()]:
        per_query[r["qid"]] = per_query.get(r["qid"], 0) + r["count"]
    common = texts.filter("qstr = 'barrio'").first().qid
    assert sum(q == common for q, *_ in every) > 4000 and per_query[common] <= 1000
    # Bounds are looser where the words of a query lie in different names of a block.
    assert sum(per_query.values()) < len(every) / 2


def test_phrase_of_a_name_with_very_many_repeats(spark):
    index = search.search_index(docs(spark, ["abc xyz " * 1000, "xyz abc abc", "abc uno dos tres cuatro xyz"]))
    texts = settle(search.prepare_texts(spark.createDataFrame([("abc xyz",), ("xyz abc abc",)], "qstr string")), "texts")
    parts = search.clause_inputs(texts, index)
    found = search.phrase_scores(parts.entries, parts.weighted[search.STREET]).join(texts.select("qid", "qstr"), "qid").join(index.names, "nid")
    got = {(r.qstr, r.nombre_cal[:8]) for r in found.collect()}
    assert got == {("abc xyz", "abc xyz "), ("abc xyz", "xyz abc "), ("xyz abc abc", "xyz abc "), ("xyz abc abc", "abc xyz ")}


def test_blocks_hold_names_of_like_lengths(spark):
    index = search.search_index(docs(spark, many_names(500)))
    rows = index.names.withColumn("n", F.size(F.split("nombre_cal", " "))).groupBy("block").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert max(r.c for r in rows) <= 1 << search.BLOCK_BITS
    assert sum(r.lo != r.hi for r in rows) <= 5


def test_terms_are_counted_where_their_texts_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_CHARS", 20)
    texts = [(1, "gral alvear veinte"), (1, "gral mitre"), (2, "gral mitre"), (None, "alvear sur"), (None, "alvear"), (3, None), (3, "")]
    docs = spark.createDataFrame(texts, "nid long, nombre_cal string")
    dealt = search.dealt_by_name(docs)
    assert dealt.rdd.getNumPartitions() >= 3

    def counted(rows):
        return search.street_terms(rows).groupBy("nid", "term").agg(F.count("*").alias("n"), F.sum("pos").alias("at"))

    found = counted(dealt).groupBy("nid").agg(F.sum("n"), F.count("*"), F.sum("at"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    key = lambda r: str(tuple(r))
    assert sorted(counted(dealt).collect(), key=key) == sorted(counted(docs).collect(), key=key)
    names = docs.filter("nid IS NOT NULL").withColumns({"block": F.lit(0).cast("long"), "docs": F.lit(1).cast("long")})
    assert "hashpartitioning(nid" in (made := search.build_postings(names)._jdf.queryExecution().executedPlan().toString())
    assert "term" not in "".join(line.split("[plan_id")[0] for line in made.splitlines() if "Exchange hashpartitioning" in line)


def test_what_grows_with_the_names_is_not_broadcast(spark):
    # Files of equal rows are small, whatever the rows take in memory.
    rows = settle(spark.sql("SELECT 'a' AS term, id AS nid, id % 4 AS block, 1D AS weight FROM range(1000)"), "rows")
    asked = settle(spark.sql("SELECT 7L AS qid, 'a' AS term"), "asked")
    pairs = settle(spark.sql("SELECT 7L AS qid, id AS block FROM range(2)"), "pairs")
    begun = search.Beginnings(rows.selectExpr("'street' AS field", "term AS key", "nid", "block"), None, "nid")
    words = asked.selectExpr("qid", "'street' AS field", "term AS key")
    weighted = search.Weighted(rows, None)
    for some, n in (
        (weighted.of(asked), 1000),
        (weighted.of(search.within(asked, pairs)), 500),
        (begun.of(words), 1000),
        (begun.of(search.within(words, pairs)), 500),
    ):
        assert some.count() == n
        assert "Broadcast" not in some._jdf.queryExecution().executedPlan().toString()


def test_counted_terms_are_those_of_the_chain(spark, monkeypatch):
    monkeypatch.setattr(search, "RUN_CHARS", 40)
    rng = random.Random(5)
    words = ["av.", "gral", "la", "uno", "31", "treinta y uno", "ñandú", "straße", "san", "santa", "santafé", "x", "7", "&amp;", "<b>", "<p>", "belgrano", "belgranos", "constitucionalmente"]
    texts = [(rng.choice([1, 2, 3, None, 4]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(60)]
    docs = spark.createDataFrame([*texts, (5, None), (6, ""), (7, "de la"), (8, "a b")], "nid long, nombre_cal string")
    per_term = search.street_terms(docs).groupBy("nid", "term").agg(F.count("*").alias("n"), F.sum("pos").alias("at"))
    weight = (F.col("at") + F.col("n")) * F.length("term")
    want = per_term.groupBy("nid").agg(F.sum("n").alias("n"), F.count("*").alias("terms"), F.sum(weight).alias("weight"))
    got = search.term_counts(docs)
    assert got.dtypes == want.dtypes
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    # One row per word or initial, not one per term.
    entries = search.shingle_runs(search.with_runs(docs))
    assert 0 < 4 * entries.count() < search.street_terms(docs).count()


@pytest.mark.parametrize("text", ["Straße ÆGIR", "İZMİR ñandú", "a&ntilde;b <i>c</i>d", "x &lt; y", "<p>uno</p>dos", "日本 Łódź 31"])
def test_words_split_before_folding_are_those_split_after(spark, text):
    old = an.words(an.fold(an.expand_abbreviations(an.collapse_spaces(an.html_strip("s")))))
    row = spark.createDataFrame([(text,)], "s string").select(F.expr(old).alias("old"), F.expr(an.street_words("s")).alias("new")).first()
    assert row["old"] == row["new"]


def test_postings_are_those_of_every_term(spark):
    rng = random.Random(9)
    words = ["av.", "uno", "31", "treinta y uno", "ñandú", "san", "x", "7", "belgrano", "belgranos", "İİ"]
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 3, 3, 5, 8, 40)] + ["İ" * 60, "a " * 30, "31 " * 25, "de la"]
    names = spark.createDataFrame([(i, i // 4, i + 1, t) for i, t in enumerate(texts)], "nid long, block long, docs long, nombre_cal string")
    made = search.build_postings(names)
    # The lengths of names come with their terms, not from a second analysis.
    assert "distinct" not in made._jdf.queryExecution().executedPlan().toString().replace("array_distinct", "")
    plain = names.select("nid", F.posexplode(F.expr(an.plain_words("nombre_cal"))).alias("pos", "term"))
    want = {}
    for field, rows in ((search.STREET, search.street_terms(names).collect()), (search.PLAIN, plain.collect())):
        for nid in {r["nid"] for r in rows}:
            own = [r for r in rows if r["nid"] == nid]
            for term in {r["term"] for r in own}:
                at = [r["pos"] for r in own if r["term"] == term]
                want[field, term, nid] = (nid // 4, len(at), sorted(set(at)), len({r["pos"] for r in own}), nid + 1)
    got = {(r["field"], r["term"], r["nid"]): (r["block"], r["tf"], r["at"], r["dl"], r["docs"]) for r in made.collect()}
    assert got == want
    assert dict(made.dtypes) == {"field": "string", "term": "string", "nid": "bigint", "block": "bigint", "tf": "bigint", "at": "array<int>", "dl": "bigint", "docs": "bigint"}


def test_fuzzy_terms_of_long_words_shorten_their_beginnings(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["ma" + "".join(rnd.choices("ab", k=rnd.randint(4, 12))) for _ in range(25)]
    words = set(base)
    for w in base:
        for n in range(12):
            v = w
            for _ in range(1 + n % 3):
                i, kind = rnd.randrange(2, len(v)), rnd.randrange(4)
                v = (v[:i] + v[i + 1 :], v[:i] + "b" + v[i:], v[:i] + "a" + v[i + 1 :], v[:i] + v[i : i + 2][::-1] + v[i + 2 :])[kind]
            words.add(v[:15])
    vocabulary = spark.createDataFrame([(w,) for w in sorted(words)], "found string")
    kept = {}
    monkeypatch.setattr(search, "settle", lambda df, name: kept.setdefault(name, settle(df, name)))
    found = search.fuzzy_terms(spark.createDataFrame([(t,) for t in set(base)], "term string"), vocabulary)
    got = {(r["term"], r["found"]): r["edits"] for r in found.collect()}
    close = {(t, w): damerau(t, w) for t, w in itertools.product(set(base), words) if t[:2] == w[:2]}
    assert got == {p: d for p, d in close.items() if d <= (1 if len(p[0]) <= 5 else 2)}
    # Words that differ behind their eighth character only are shortened once.
    assert kept["near-terms"].select("stem").distinct().count() < len(words) / 2


def test_rounds_are_the_same_where_their_blocks_are_listed(spark, monkeypatch):
    rng = random.Random(21)
    words = ["belgrano", "norte", "sur", "mitre", "alvear", "rio", "monte", "lago", "campo", "villa"]
    table = docs(spark, [" ".join(rng.choices(words, k=rng.randrange(1, 6))) + f" {i % 97}" for i in range(900)])
    asked = [(1, "belgrano norte", 10), (2, "vila lago", 50), (3, "monte ca", 20), (4, "97 rio", 5)]
    listed = ask(spark, table, asked)
    monkeypatch.setattr(search, "LISTED_BLOCKS", 0)
    assert listed == ask(spark, table, asked) and len(listed) == 4
