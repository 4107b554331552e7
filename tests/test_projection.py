import random

import pytest
from pyspark.sql import functions as F

from esquina.functions import geometry as gm


def moved(spark, rows, src, dst):
    df = spark.createDataFrame(rows, "i int, x double, y double")
    v = gm.transform_vertex(gm.vertex(F.col("x"), F.col("y")), F.lit(src), dst)
    return [(r["v"]["x"], r["v"]["y"]) if r["v"] else None for r in df.select("i", v.alias("v")).orderBy("i").collect()]


def test_control_points(spark):
    # The equator on the meridian, the pole (a quarter of the meridian), a tower known to the metre.
    east, north = zip(*moved(spark, [(0, -81.0, 0.0), (1, -81.0, 90.0), (2, -79 - 23 / 60 - 13.7 / 3600, 43 + 38 / 60 + 33.24 / 3600)], gm.WGS84, 32617))
    assert east[:2] == pytest.approx((500000, 500000), abs=1e-3) and north[:2] == pytest.approx((0, 9997964.943), abs=1e-3)
    assert east[2] == pytest.approx(630084, abs=1) and north[2] == pytest.approx(4833438, abs=1)
    # Belts count from the south pole and carry their number in the easting.
    assert moved(spark, [(0, -60.0, 0.0)], gm.WGS84, 5347)[0] == pytest.approx((5500000, 10001965.729), abs=1e-3)
    assert moved(spark, [(0, -60.0, -90.0)], gm.WGS84, 5347)[0] == pytest.approx((5500000, 0), abs=1e-3)


@pytest.mark.parametrize("srid, meridian", [(32601, -177), (32660, 177), (32721, -57), (5343, -72), (5349, -54)])
def test_round_trip(spark, srid, meridian):
    rnd = random.Random(srid)
    rows = [(i, (meridian + rnd.uniform(-6, 6) + 180) % 360 - 180, rnd.uniform(-84, 84)) for i in range(200)]
    there = moved(spark, rows, gm.WGS84, srid)
    back = moved(spark, [(i, *p) for i, p in enumerate(there)], srid, gm.WGS84)
    for (_, x, y), (u, v) in zip(rows, back):
        assert abs((x - u + 180) % 360 - 180) < 1e-8 and abs(y - v) < 1e-8  # about a millimetre


def test_pairs_of_systems(spark):
    grid = moved(spark, [(0, -58.4, -34.6)], gm.WGS84, 32721)
    flat = moved(spark, [(0, -58.4, -34.6)], gm.WGS84, gm.MERCATOR)
    assert moved(spark, [(0, *flat[0])], gm.MERCATOR, 32721)[0] == pytest.approx(grid[0], abs=1e-3)
    assert moved(spark, [(0, *grid[0])], 32721, gm.MERCATOR)[0] == pytest.approx(flat[0], abs=1e-3)
    assert moved(spark, [(0, *grid[0])], 32721, 5348)[0] == pytest.approx(moved(spark, [(0, -58.4, -34.6)], gm.WGS84, 5348)[0], abs=1e-3)
    # Unknown systems, null numbers, the far side of the earth.
    assert moved(spark, [(0, 1.0, 1.0)], 32661, gm.WGS84) == [None] and moved(spark, [(0, 1.0, 1.0)], gm.WGS84, 2) == [None]
    assert moved(spark, [(0, 123.0, 1.0)], gm.WGS84, 32721) == [None]
    known = spark.range(1).select(*[gm.transformable(F.lit(a), b) for a, b in [(32721, 4326), (4326, 5347), (32661, 4326), (4326, 2), (7, 7)]]).first()
    assert list(known) == [True, True, False, False, True]
