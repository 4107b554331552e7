import random

import pytest
from pyspark.sql import functions as F

from esquina.operators.address import FIELDS, NOT_FOUND, UNMERGEABLE, answer_json, attach_addresses, best_blocks, best_segments, geocode_addresses
from esquina.plans.batch import geocode_table
from tests.helpers import streets

REQUEST = "req_id long, calle string, altura int, numero_cal string, fallback boolean"


def ask(spark, table, rows, **kw):
    got = geocode_addresses(spark.createDataFrame(rows, REQUEST), table, **kw).collect()
    assert len(got) == len(rows)
    return {r["req_id"]: r for r in got}


def test_ranges(spark):
    table = streets(spark, [
        (1, "a", "alfa", None, None, None, None),
        (2, "b", "beta", 100, None, None, None),
        (3, "c", "gama", 198, 100, 199, 101),
        (4, "d", "delta", 100, 198, 101, 199),
        (5, "d", "delta", 300, 348, 301, 399),
    ])
    got = ask(spark, table, [
        (1, None, 500, "A", False), (2, None, 100, "b", False), (3, None, 100, " c ", False),
        (4, None, 20, "d", True), (5, None, 20, "d", False), (6, None, 149, "d", False),
    ])
    assert (got[1]["min_rango"], got[1]["max_rango"]) == (0, 999_999)
    assert got[1]["lon"] == pytest.approx(500 / 999_999)
    assert (got[2]["min_par"], got[2]["max_par"], got[2]["lon"]) == (100, 100, 0.5)
    assert got[3]["lon"] == 0 and got[3]["success"] is True
    assert got[4]["min_par"] == 300 and got[4]["lon"] == 0
    assert got[5]["success"] is None and got[5]["message"] == NOT_FOUND and got[5]["nombre_cal"] is None
    assert got[6]["paridad"] == "impar" and got[6]["min_rango"] == 101


def test_streets_by_text_and_code(spark):
    table = streets(spark, [(1, " a 1", "Avenida Ñandú", 0, 98, 1, 99), (2, "b2", "Boedo", 0, 98, 1, 99), (3, "", "Blank", 0, 8, 1, 9)])
    got = ask(spark, table, [
        (1, "nandu", 10, None, False), (2, "A1", 10, None, False), (3, "boedo", 10, "A1", False),
        (4, "boedo", 10, "zz", False), (5, None, 4, None, False), (6, "boedo", 4, "", False), (7, "xyzxyz", 4, None, False),
    ])
    assert [got[i]["nombre_cal"] for i in (1, 2, 3)] == ["Avenida Ñandú"] * 3
    assert got[4]["message"] == NOT_FOUND
    # Nothing given finds the blank code; a blank code that is given wins over the street.
    assert got[5]["nombre_cal"] == "Blank" and got[6]["nombre_cal"] == "Blank"
    # An unknown street has no code, which reads as the blank one.
    assert got[7]["nombre_cal"] == "Blank"


def test_nothing_given_without_a_blank_code_is_the_first_name(spark):
    table = streets(spark, [(1, "a", "Zeta", 0, 98, 1, 99), (2, "b", "Alfa", 0, 98, 1, 99)])
    assert ask(spark, table, [(1, None, 10, None, False)])[1]["nombre_cal"] == "Alfa"


def test_checks_and_geometry_status(spark):
    gap = '{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[2,0],[3,0]]]}'
    table = streets(spark, [(1, "a", "alfa", 0, 98, 1, 99, gap), (2, "b", "beta", 0, 98, 1, 99, None)])
    rows = [(1, None, 10, "a", False), (2, None, 10, "b", False), (3, None, -1, "a", False), (4, None, 200_001, "a", True), (5, None, None, "b", True)]
    got = ask(spark, table, rows)
    assert got[1]["status"] == UNMERGEABLE and got[1]["success"] is None and got[1]["lat"] is None
    assert got[2]["success"] is True and got[2]["lat"] is None
    assert {got[i]["status"] for i in (3, 4, 5)} == {"invalid"}
    free = ask(spark, table, rows, validate=False)
    assert free[5]["paridad"] == "impar" and free[5]["success"] is True


def test_json_keeps_nulls(spark):
    table = streets(spark, [(1, "a", "alfa", 0, 98, 1, 99)])
    df = spark.createDataFrame([(1, None, 0, "a", False), (2, None, 1000, "a", False)], REQUEST)
    done = attach_addresses(df, table).select("req_id", answer_json(F.col("answer"), FIELDS).alias("j"))
    got = {r["req_id"]: r["j"] for r in done.collect()}
    assert '"geojson":{"type":"Point","coordinates":[0.0,0.0]},"message":null}' in got[1]
    assert got[2].startswith('{"success":null,"numero_cal":null') and NOT_FOUND in got[2]


def brute(table, code, number, fallback):
    best = None
    for s in table:
        if s[1] != code:
            continue
        a, b = (s[3], s[4]) if number % 2 == 0 else (s[5], s[6])
        known = [v for v in (a, b) if v is not None]
        lo, hi = (max(min(known), 0), min(max(known), 999_999)) if known else (0, 999_999)
        inside = min(lo, hi) <= number <= max(lo, hi)
        if inside or fallback:
            best = min(filter(None, [best, (not inside, hi - lo, s[0])]))
    return best and best[2]


@pytest.mark.parametrize("hot", [False, True])
def test_best_segment_is_that_of_brute_force(spark, hot, request):
    if hot:
        request.getfixturevalue("hot_rows")
    rnd = random.Random(7)

    def bound():
        return rnd.choice([None, rnd.randint(-50, 3000), rnd.randint(0, 300) * 100])

    # Most segments and most requests belong to one code.
    table = [(i, rnd.choice("AAAB"), f"n{i}", bound(), bound(), bound(), bound()) for i in range(150)]
    rows = [(i, None, rnd.choice([7, rnd.randint(0, 3500)]), rnd.choice("AAAC"), rnd.random() < 0.5) for i in range(300)]
    got = ask(spark, streets(spark, table), rows)
    for req_id, _, number, code, fallback in rows:
        want = brute(table, code, number, fallback)
        assert got[req_id]["nombre_cal"] == (None if want is None else f"n{want}"), (code, number, fallback)


def test_batch_keeps_rows_and_columns(spark):
    table = streets(spark, [(1, "a", "alfa", 0, 98, 1, 99)])
    df = spark.createDataFrame([(1, "alfa", 10, "x", "P"), (2, "alfa", 5000, "y", "P"), (3, "alfa", 10, "z", "Q")], "req_id long, calle string, altura int, numero_cal string, partido string")
    got = {r["req_id"]: r for r in geocode_table(df, table, "partido = 'P'").collect()}
    assert set(got) == {1, 2} and got[1]["numero_cal"] == "x"
    assert got[1]["api_result_api_success"] is True and got[2]["api_result_api_lon"] is None


def test_only_asked_numbers_are_tiled(spark):
    table = streets(spark, [(i, "a", f"n{i}", 100 * i, 100 * i + 98, 100 * i + 1, 100 * i + 99) for i in range(300)])
    blocks = best_blocks(table, (150, 210)).filter("level >= 0").withColumn("at", F.col("block") * F.pow(F.lit(16), "level"))
    ends = blocks.agg(F.min("at"), F.max("at"), F.count(F.lit(1))).first()
    assert ends[0] >= 150 and ends[1] <= 210 and ends[2] <= 2 * 61
    # Widths are those of the whole ranges, and any number still finds the narrowest segment of all.
    assert {r["best"]["width"] for r in blocks.collect()} == {98}
    assert best_blocks(table, (150, 210)).filter("level < 0").count() == 2


@pytest.mark.parametrize("numbers", [[150], [0, 29_999], [-3, 5], [40_000], [None], [None, 7, 2501]])
def test_numbers_at_the_ends_of_those_asked(spark, numbers):
    wide = [(900, "A", "n900", 2400, 2502, None, None), (901, "B", "n901", None, None, -9, -2), (902, "B", "n902", 2_000_000, 3_000_000, 5, 5)]
    table = [(i, "A", f"n{i}", 100 * i, 100 * i + 98, 100 * i + 1, 100 * i + 99) for i in range(300)] + wide
    for fallback in (False, True):
        points = spark.createDataFrame([(c, n, fallback) for c in "AB" for n in numbers], "code string, altura long, fallback boolean")
        got = {(r["code"], r["altura"]): r["id"] for r in best_segments(points, streets(spark, table)).collect()}
        for code, number, _ in points.collect():
            # No number reads as an odd one that is in no range.
            want = brute(table, code, -99 if number is None else number, fallback)
            assert got.get((code, number)) == want, (code, number, fallback)
