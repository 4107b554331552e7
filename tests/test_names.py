import random

import pytest
from pyspark.sql import functions as F

from esquina.operators import names
from tests.helpers import like, similarity, streets

STOP = {"avenida", "av", "calle", "gral", "general", "dr"}
SYLLABLES = ["san", "ma", "ro", "li", "bel", "gra", "no", "ta", "e", "u"]


def brute(queries, table, k):
    out = {}
    for q in queries:
        toks = [t for t in q.split(" ") if t and t not in STOP]
        pat = "%" + "%".join(toks) + "%" if toks else "%"
        found = []
        for n in {r[2] for r in table}:
            low = n.lower()
            sim, hit = similarity(low, q), like(low, pat)
            if hit or sim > 0.35:
                bonus = round(0.15 * sum(t in low for t in toks), 2)
                found.append((-round(max(sim, 0.7 if hit else 0, bonus), 6), n))
        out[q] = [(n, -s) for s, n in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_suggestions_are_those_of_brute_force(spark, hot, request, monkeypatch):
    if hot:
        request.getfixturevalue("hot_rows")
    monkeypatch.setattr(names, "FIRST_NAMES", 7)
    monkeypatch.setattr(names, "MORE_NAMES", 3)
    rnd = random.Random(3)

    def word():
        return "".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 4)))

    table = [
        (i, f"c{i}", rnd.choice(["Avenida ", "", "Calle "]) + " ".join(word() for _ in range(rnd.randint(1, 3))), 0, 1, 0, 1)
        for i in range(300)
    ]
    queries = sorted({
        "", "avenida", "calle", "e", "sa", "_", "_____ _____ _____", "%", "s_n", "ta no", "san ma ro li bel gra",
        "a\\b", "\\%", *(word() for _ in range(40)), *("avenida " + word() for _ in range(40)),
        *(r[2].lower().replace("a", "o", 1) for r in table[:40]),
    })
    df = spark.createDataFrame([(i, q, 1 + i % 50) for i, q in enumerate(queries)] + [(1000 + i, "", 9) for i in range(8)], "req_id long, qstr string, limit int")
    got = {}
    for r in names.suggest(df, streets(spark, table)).collect():
        got.setdefault(r["req_id"], []).append((r["rank"], r["nombre_cal"], r["score"]))
    want = brute(queries, table, 50)
    for i, q in enumerate(queries):
        mine = [(n, s) for _, n, s in sorted(got.get(i, []))]
        assert mine == [(n, pytest.approx(s)) for n, s in want[q][: 1 + i % 50]], q
    assert all(len(got[1000 + i]) == 9 for i in range(8))


def test_null_names_come_last_and_codes_win(spark):
    table = streets(spark, [(1, "b", None, 0, 1, 0, 1), (2, "z", "Zeta", 0, 1, 0, 1), (3, "y", "Zeta", 0, 1, 0, 1)])
    df = spark.createDataFrame([(1, "", 5), (2, "zeta", 5), (3, "x" * 101, 5), (4, "a", 0)], "req_id long, qstr string, limit int")
    got = [(r["req_id"], r["nombre_cal"], r["numero_cal"]) for r in names.suggest(df, table).orderBy("req_id", "rank").collect()]
    assert got == [(1, "Zeta", "y"), (1, None, "b"), (2, "Zeta", "y")]
    assert [r["status"] for r in names.suggest_status(df).orderBy("req_id").collect()] == ["ok", "ok", "invalid", "invalid"]
    texts = spark.createDataFrame([("Z",), ("zeta",), ("nothing at all",)], "q string")
    assert {r["q"]: r["code"] for r in names.resolve_streets(texts, table).collect()} == {"Z": "z", "zeta": "y", "nothing at all": None}


def test_plan_has_no_cross_join(spark):
    table = streets(spark, [(i, f"c{i}", f"name {i}", 0, 1, 0, 1) for i in range(20)])
    index = names.name_index(table)
    q = spark.createDataFrame([("name 1", 3), ("_", 3)], "qnorm string, k int")
    plan = names.rank_names(q, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_answer_counts(spark):
    table = streets(spark, [(1, "a", "alfa", 0, 1, 0, 1)])
    df = spark.createDataFrame([(1, "alfa", 5), (2, "qqqq", 5)], "req_id long, qstr string, limit int")
    got = names.answer_counts(df, names.suggest(df, table)).orderBy("req_id").collect()
    assert [r["count"] for r in got] == [1, 0]


def test_token_hits_beat_substring_matches_whatever_the_rest_of_the_batch_asks(spark):
    table = [(1, "a", "z santa maria pedro lopez casa", 0, 1, 0, 1), (2, "b", "aaaa bbbb ca ccc lo pe ma sa", 0, 1, 0, 1)]
    stored = streets(spark, table)
    first = []
    for limits in ([1], [1, 2]):
        asked = spark.createDataFrame([(i, "sa ma pe lo ca", n) for i, n in enumerate(limits)], "req_id long, qstr string, limit int")
        first.append({(r["req_id"], r["numero_cal"]) for r in names.suggest(asked, stored).collect() if r["rank"] == 1})
    assert first == [{(0, "b")}, {(0, "b"), (1, "b")}]
    texts = spark.createDataFrame([("sa ma pe lo ca",)], "q string")
    assert [r["code"] for r in names.resolve_streets(texts, stored).collect()] == ["b"]


def test_first_matches_are_found_without_listing_all(spark, monkeypatch):
    table = [(i, f"c{i}", f"san martin {i:05d}", 0, 1, 0, 1) for i in range(3000)] + [(9000, "z", "zulu martin", 0, 1, 0, 1), (9001, "n", None, 0, 1, 0, 1)]
    index = names.name_index(streets(spark, table))
    assert [r["ord"] for r in index.names.orderBy(F.asc_nulls_last("nombre_cal")).collect()] == list(range(3002))
    asked = {"a": 5, "": 3, "_": 9, "zu mar": 2, "sa ma 2": 50, "s a n m a": 1, "qqq": 4}
    queries = spark.createDataFrame(list(asked.items()), "qnorm string, k int")
    prepared = names.prepare_queries(queries, index)
    found = [tuple(r) for r in names.first_substrings(prepared, index, ["qnorm", "k", "nombre_cal"]).select("qnorm", "nombre_cal", "sim").collect()]
    every = [tuple(r) for r in names.substring_pairs(prepared, index).select("qnorm", "nombre_cal", "sim").collect()]
    for q, k in asked.items():
        mine = sorted(n for query, n, _ in found if query == q)
        all_names = sorted(n for query, n, _ in every if query == q and n is not None)
        if q == "s a n m a":  # token hits may lift any of these, so all are seen
            assert mine == all_names
        else:
            # Per range that is searched at most k pairs are written.
            assert mine[:k] == all_names[:k] and len(mine) <= 4 * k
