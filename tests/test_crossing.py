import random

import pytest
from pyspark.sql import functions as F

from esquina.functions import geometry as gm
from esquina.operators import crossing
from tests.helpers import streets

CROSSING = "id long, num_calle string, srid int, j string"


def crossings(spark, rows):
    df = spark.createDataFrame(rows, CROSSING)
    parsed = df.withColumn("g", gm.parse_geojson(F.col("j"), gm.WGS84))
    return parsed.select("id", "num_calle", F.col("g").withField("srid", F.col("srid")).alias("geom"))


def point(x, y):
    return f'{{"type":"Point","coordinates":[{x},{y}]}}'


@pytest.fixture
def town(spark):
    return streets(spark, [(i, f"c{i}", n, 0, 98, 1, 99) for i, n in enumerate(["alfa", "beta", "gama", "delta"])])


def test_crossings(spark, town):
    table = crossings(spark, [
        (1, "C0; c1", 4326, point(1, 2)),
        (2, "c1;c0;;", 4326, point(9, 9)),
        (3, "c1;c2", 0, point(-6523000, -4110000)),
        (4, "c2;c3", 22185, point(1, 1)),
        (5, "c3", 4326, '{"type":"LineString","coordinates":[[0,0],[1,1],[2,2]]}'),
    ])
    df = spark.createDataFrame(
        [(1, "alfa", "beta"), (2, "beta", "alfa"), (3, "gama", "beta"), (4, "gama", "delta"), (5, "alfa", "alfa"),
         (6, "alfa", "gama"), (7, "", "alfa"), (8, None, "alfa"), (9, "delta", "c3"), (10, "alfa", "zzzz")],
        "req_id long, calle1 string, calle2 string",
    )
    got = {r["req_id"]: r for r in crossing.geocode_intersections(df, town, table).collect()}
    assert len(got) == 10
    assert (got[1]["lon"], got[1]["lat"], got[1]["success"]) == (1, 2, True)
    assert got[2]["lon"] == 1 and got[5]["lon"] == 1
    assert got[3]["lon"] == pytest.approx(-58.597, abs=1e-2)
    assert got[4]["status"] == "unsupported_crs" and got[4]["success"] is None
    assert got[6]["message"] == crossing.NOT_FOUND and got[6]["status"] == "ok"
    assert got[10]["message"] == crossing.NOT_FOUND
    assert got[7]["status"] == got[8]["status"] == "invalid"
    # No point: the middle vertex of the line. The pair (delta, delta) meets 4 first, which has no known system.
    assert got[9]["status"] == "unsupported_crs"


@pytest.mark.parametrize("hot", [False, True])
def test_crowded_crossings_agree_with_brute_force(spark, hot, request):
    if hot:
        request.getfixturevalue("hot_rows")
    rnd = random.Random(5)
    codes = [f"C{i}" for i in range(30)]
    rows = [(i, ";".join(rnd.choices(codes, k=rnd.choice([0, 1, 2, 3, 12, 20]))), 4326, point(i, i)) for i in range(60)]
    town = streets(spark, [(i, c, f"calle {c}", 0, 98, 1, 99) for i, c in enumerate(codes)])
    pairs = [(i, rnd.choice(["C1", rnd.choice(codes)]), rnd.choice(codes)) for i in range(150)]
    df = spark.createDataFrame(pairs, "req_id long, calle1 string, calle2 string")
    got = {r["req_id"]: r["lon"] for r in crossing.geocode_intersections(df, town, crossings(spark, rows)).collect()}
    for req_id, a, b in pairs:
        ids = [r[0] for r in rows if {a, b} <= set(r[1].split(";"))]
        assert got[req_id] == (min(ids) if ids else None), (a, b)


def test_one_street_in_every_crowded_crossing(spark, hot_rows):
    """The pairs of the common street look at the rarer one; its list and its pairs are cut into cells."""
    rnd = random.Random(3)
    codes = [f"C{i:02}" for i in range(40)]
    rows = [(i, ["C00", *rnd.sample(codes[1:], rnd.choice([8, 12]))]) for i in range(80)]
    table = spark.createDataFrame(rows, "id long, nums_norm array<string>")
    asked = [("C00", c) for c in codes] + [(a, b) for a in codes[1:9] for b in codes[1:9] if a <= b] + [("C01", "none")]
    pairs = spark.createDataFrame(sorted(set(asked)), "a string, b string")
    got = {(r["a"], r["b"]): r["id"] for r in crossing.crossing_of_pairs(pairs, table).collect()}
    want = {p: min((i for i, c in rows if set(p) <= set(c)), default=None) for p in asked}
    assert got == {p: i for p, i in want.items() if i is not None}


def test_backfill_keeps_what_is_there(spark):
    df = spark.createDataFrame([(1, "a;b", ["X"]), (2, "a;b", None)], "id long, num_calle string, nums_norm array<string>")
    got = {r["id"]: r["nums_norm"] for r in crossing.with_code_list(df, only_missing=True).collect()}
    assert got == {1: ["X"], 2: ["A", "B"]}
    assert {tuple(r["nums_norm"]) for r in crossing.with_code_list(df).collect()} == {("A", "B")}
