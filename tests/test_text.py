import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from esquina.functions import text as tx
from tests.helpers import like, similarity


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given_text, want",
    [(None, ""), ("  Av.  Ñandú\n\tX ", " av. nandu x "), ("Straße Æ œ", "strasse ae oe"), ("ŁÓDŹ", "lodz")],
)
def test_norm_text(spark, given_text, want):
    assert one(spark, given_text, tx.norm_text) == want


@pytest.mark.parametrize("given_text, want", [(None, ""), (" a\t1 é ", "A1É"), ("\n", "")])
def test_norm_code(spark, given_text, want):
    assert one(spark, given_text, tx.norm_code) == want


@pytest.mark.parametrize(
    "given_text, want",
    [
        ("avenida san gral martin", ["san", "martin"]),
        ("monseñor", []),
        ("av. calle", []),
        ("", [""]),
        ("avenidas", ["avenidas"]),
    ],
)
def test_prefix_tokens(spark, given_text, want):
    assert one(spark, given_text, lambda c: tx.name_tokens(tx.norm_text(c))) == want


@pytest.mark.parametrize(
    "query, name, want",
    [
        ("", "anything", True),
        ("avenida", "x", True),
        ("san mar", "general san martin", True),
        ("mar san", "general san martin", False),
        ("s_n", "sun", True),
        ("50% x", "50 xx", True),
        (r"a\b", "cab", True),
        (r"a\%", "a%b", True),
        (r"a\%", "aab", False),
        ("foo\\", "foo%", True),
        ("foo\\", "foox", False),
        (r"a\\b", r"xa\b", True),
    ],
)
def test_like_pattern(spark, query, name, want):
    df = spark.createDataFrame([(query, name)], "q string, n string")
    pat = tx.like_pattern(tx.name_tokens(tx.norm_text(F.col("q"))))
    row = df.select(tx.like(F.col("n"), tx.spark_like_pattern(pat)).alias("r"), pat.alias("pat")).first()
    assert row["r"] is want
    assert like(name, row["pat"]) is want


def test_literal_runs(spark):
    runs = one(spark, r"%a\%b_c%\\d%", tx.literal_runs)
    assert runs == ["a%b", "c", "\\d"]
    assert one(spark, r"%\_%_%", tx.wildcard_min_length) == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text("abcé1 .", max_size=12), st.text("abcé1 .", max_size=12)), min_size=1, max_size=20))
def test_similarity_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(
        tx.similarity(F.col("a"), F.col("b")).alias("ab"), tx.similarity(F.col("b"), F.col("a")).alias("ba"), "a", "b"
    ).collect()
    for r in got:
        assert r["ab"] == pytest.approx(r["ba"]) and 0 <= r["ab"] <= 1
        assert r["ab"] == pytest.approx(similarity(r["a"], r["b"]))


def test_five_token_hits_beat_the_flat_score(spark):
    df = spark.createDataFrame([("e d c b a", "a b c d e zzzzzzzzzzzz")], "q string, n string")
    toks = tx.name_tokens(F.col("q"))
    row = df.select(tx.token_bonus(toks, F.col("n")).alias("bonus")).first()
    assert row["bonus"] == 0.75


def test_code_list(spark):
    assert one(spark, " a 1 ;;b2; a1;", tx.code_list) == ["A1", "B2", "A1"]
    assert one(spark, None, tx.code_list) == []
