import pytest
from pyspark.sql import functions as F

from esquina.functions import geometry as gm, ranges as rg


def geom(spark, text, srid=gm.WGS84):
    return spark.createDataFrame([(text,)], "j string").select(gm.parse_geojson(F.col("j"), srid).alias("g"))


def xy(v):
    return None if v is None else (v["x"], v["y"])


@pytest.mark.parametrize(
    "coords, want",
    [
        ("[[[0,0],[1,0]]]", [(0, 0), (1, 0)]),
        ("[[[0,0],[1,0]],[[1,0],[1,2]]]", [(0, 0), (1, 0), (1, 2)]),
        # Two of three parts run the other way, so the line does too.
        ("[[[1,0],[0,0]],[[1,2],[1,0]],[[1,2],[1,3]]]", [(1, 3), (1, 2), (1, 0), (0, 0)]),
        # A tie starts at the smaller end.
        ("[[[1,0],[0,0]],[[1,0],[1,2]]]", [(0, 0), (1, 0), (1, 2)]),
        ("[[[0,0],[1,0]],[[2,0],[3,0]]]", None),
        ("[[[0,0],[1,0]],[[1,0],[2,0]],[[1,0],[1,1]]]", None),
    ],
)
def test_line_merge(spark, coords, want):
    df = geom(spark, '{"type":"MultiLineString","coordinates":' + coords + "}")
    line = df.select(gm.merge_lines(gm.line_parts(F.col("g"))).alias("m")).first()["m"]
    assert (line if line is None else [xy(v) for v in line]) == want


def test_no_lines_do_not_merge(spark):
    df = geom(spark, '{"type":"Point","coordinates":[1,2]}')
    assert df.select(gm.merge_lines(gm.line_parts(F.col("g"))).alias("m")).first()["m"] is None


@pytest.mark.parametrize(
    "f, want", [(-1.0, (0, 0)), (0.0, (0, 0)), (0.25, (1, 0)), (0.5, (1, 1)), (0.875, (1, 2.5)), (1.0, (1, 3)), (2.0, (1, 3))]
)
def test_interpolate(spark, f, want):
    df = geom(spark, '{"type":"LineString","coordinates":[[0,0],[1,0],[1,3]]}')
    at = gm.interpolate(F.col("g.parts")[0], F.lit(f))
    assert xy(df.select(at.alias("p")).first()["p"]) == want


def test_interpolate_on_a_line_without_length(spark):
    df = geom(spark, '{"type":"LineString","coordinates":[[2,2],[2,2]]}')
    assert xy(df.select(gm.interpolate(F.col("g.parts")[0], F.lit(0.5)).alias("p")).first()["p"]) == (2, 2)


def test_round_trip(spark):
    df = geom(spark, '{"type":"MultiPoint","coordinates":[[-58.6,-34.6],[10,80]]}')
    back = df.select(gm.transform(gm.transform(F.col("g"), gm.MERCATOR), gm.WGS84).alias("g")).first()["g"]
    assert [xy(p[0]) for p in back["parts"]] == [pytest.approx((-58.6, -34.6)), pytest.approx((10, 80))]


def test_unknown_systems_are_not_transformed(spark):
    df = geom(spark, '{"type":"Point","coordinates":[1,2]}', srid=22185)
    row = df.select(gm.transform(F.col("g"), gm.WGS84).alias("t"), gm.transformable(F.col("g.srid"), gm.WGS84).alias("can")).first()
    assert row["t"] is None and row["can"] is False


@pytest.mark.parametrize(
    "text",
    ['{"type":"LineString","coordinates":[[0,"x"]]}', '{"type":"Point"}', "nonsense", None,
     '{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}]}'],
)
def test_unusable_geometry_is_null(spark, text):
    assert geom(spark, text).first()["g"] is None


def test_collection_kinds(spark):
    df = geom(spark, '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[5,6]},{"type":"LineString","coordinates":[[0,0],[1,0]]}]}')
    row = df.select(gm.point_parts(F.col("g")).alias("p"), gm.line_parts(F.col("g")).alias("l"), gm.representative_point(F.col("g")).alias("r")).first()
    assert len(row["p"]) == 1 and len(row["l"]) == 1 and xy(row["r"]) == (5, 6)


@pytest.mark.parametrize(
    "text, centre, inside",
    [
        ('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}', (2, 2), (2, 2)),
        ('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[2,3],[2,1],[1,1]]]}', None, (3, 2)),
        ('{"type":"LineString","coordinates":[[0,0],[2,0],[2,2]]}', (1.5, 0.5), (2, 0)),
        ('{"type":"LineString","coordinates":[[0,0],[2,0]]}', (1, 0), (0, 0)),
        ('{"type":"MultiPoint","coordinates":[[0,0],[2,4]]}', (1, 2), (0, 0)),
    ],
)
def test_centroid_and_representative_point(spark, text, centre, inside):
    row = geom(spark, text).select(gm.centroid(F.col("g")).alias("c"), gm.representative_point(F.col("g")).alias("r")).first()
    if centre:
        assert xy(row["c"]) == pytest.approx(centre)
    assert xy(row["r"]) == inside


def test_pieces_hold_exactly_the_numbers_of_a_range(spark):
    rows = [(lo, lo + w, n) for lo in (0, 1, 15, 16, 100, 255, 4095, 999_990) for w in (0, 1, 98, 300, 70_000, 999_999)
            for n in (lo - 1, lo, lo + w // 2, lo + w, lo + w + 1)] + [(-5, 0, -3), (5_000_000, 5_000_000, 5_000_000)]
    df = spark.createDataFrame(rows, "lo long, hi long, n long")
    shared = F.size(F.array_intersect(rg.pieces_of_range("lo", "hi"), rg.pieces_of_number("n")))
    for r in df.withColumn("k", shared).collect():
        assert r["k"] == (1 if r["lo"] <= r["n"] <= r["hi"] else 0), r
