import json

import pytest
from pyspark.sql import functions as F

from esquina.functions import geometry as gm
from esquina.operators.search import search_suggest
from esquina.operators import address, crossing, names
from esquina.plans.load import LOOKUPS, StaleIndex, Store, load, refresh_names, stored_search_index, stored_street_index, table_name
from esquina.sources import geojson, tables
from esquina.streaming.geocode import stream_addresses
from tests.helpers import streets


def feature(i, geometry, **props):
    return {"type": "Feature", "id": i, "properties": props, "geometry": geometry}


LINE = {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}
FEATURES = [
    feature(1, LINE, numero_cal="a", nombre_cal="Alfa", alt_ini_pa=0, alt_fin_pa=98, alt_ini_im=1, alt_fin_im=99, other="kept"),
    feature(2, None, numero_cal="b", nombre_cal="Beta"),
    feature(3, {"type": "LineString", "coordinates": [[0, "x"]]}, numero_cal="c", nombre_cal="Gama"),
    feature(4, {"type": "MultiLineString", "coordinates": [[[0, 0], [0, 1]]]}, numero_cal="d", nombre_cal="Delta"),
]


@pytest.fixture
def files(tmp_path):
    collection = tmp_path / "streets.geojson"
    collection.write_text(json.dumps({"type": "FeatureCollection", "name": "streets", "features": FEATURES}))
    lines = tmp_path / "lines.geojson"
    body = ",\n".join(json.dumps(f) for f in FEATURES)
    lines.write_text('{\n"type": "FeatureCollection",\n"name": "streets",\n"features": [\n' + body + "\n]\n}\n")
    points = tmp_path / "points.geojson"
    points.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature(9, {"type": "Point", "coordinates": [5, 6]}, num_calle="a; d")]}))
    return collection, lines, points


@pytest.mark.parametrize("which, layout", [(0, "collection"), (1, "lines")])
def test_read(spark, files, which, layout):
    loaded = geojson.read_geojson(spark, str(files[which]), geojson.STREET_SCHEMA, layout=layout)
    rows = {r["id"]: r for r in loaded.rows.collect()}
    assert set(rows) == {1, 4} and rows[1]["geom"]["type"] == "MultiLineString" and rows[1]["alt_fin_pa"] == 98
    assert json.loads(rows[1]["properties"])["other"] == "kept"
    assert [r["reason"] for r in loaded.rejects.collect()] == ["geometry", "geometry"]


def test_options(spark, files):
    loaded = geojson.read_geojson(spark, str(files[0]), geojson.STREET_SCHEMA, dst=gm.MERCATOR, promote=False)
    row = loaded.rows.filter("id = 1").first()
    assert row["geom"]["type"] == "LineString" and row["geom"]["srid"] == 3857
    assert row["geom"]["parts"][0][1]["x"] == pytest.approx(111319.49, abs=0.01)
    with pytest.raises(Exception, match="bad feature"):
        geojson.read_geojson(spark, str(files[0]), geojson.STREET_SCHEMA, on_error="fail").rows.collect()


def test_broken_file_is_rejected(spark, tmp_path):
    path = tmp_path / "broken.geojson"
    path.write_text('{"type": "FeatureCollection", "features": [')
    loaded = geojson.read_geojson(spark, str(path), geojson.STREET_SCHEMA)
    assert loaded.rows.count() == 0 and loaded.rejects.count() == 1


def test_missing_ids_count_from_one(spark, tmp_path):
    path = tmp_path / "no_ids.geojson"
    features = [{"type": "Feature", "properties": {}, "geometry": LINE} for _ in range(3)]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = geojson.read_geojson(spark, str(path), geojson.STREET_SCHEMA).rows
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3]


def test_write_skips_rows_without_numeric_coordinates(spark, tmp_path):
    df = spark.createDataFrame([(1, "1.5", 2.0), (2, "x", 2.0), (3, None, 2.0), (4, "1", None)], "id long, lon string, lat double")
    geojson.write_geojson(df, str(tmp_path / "out"), "lon", "lat")
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [{"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}}]


def test_load_skips_unchanged_files(spark, files, tmp_path):
    store = Store(str(tmp_path / "store"))
    assert load(spark, str(files[0]), str(files[2]), store) is True
    assert load(spark, str(files[0]), str(files[2]), store) is False
    assert load(spark, str(files[0]), str(files[2]), store, tables.LoadConfig(append=True)) is True
    assert store.table(spark, "streets").count() == 4 and store.table(spark, "rejects").count() == 4
    assert store.table(spark, "intersections").first()["nums_norm"] == ["A", "D"]
    asked = spark.createDataFrame([(1, "alfa", 5)], "req_id long, qstr string, limit int")
    answer = search_suggest(asked, stored_search_index(spark, store)).first()
    assert answer["nombre_cal"] == "Alfa" and answer["centroid"]["lon"] == pytest.approx(0.5)


def test_csv_requests(spark, tmp_path):
    path = tmp_path / "requests.csv"
    path.write_text("req_id,calle,altura,numero_cal,fallback,partido\n1,alfa,10,,true,P\n2,beta,oops,x,false,\n")
    rows = tables.read_requests(spark, str(path), tables.ADDRESS_SCHEMA, "csv").orderBy("req_id").collect()
    assert rows[0]["fallback"] is True and rows[0]["numero_cal"] is None and rows[1]["altura"] is None


def test_stream(spark, tmp_path):
    table = streets(spark, [(1, "a", "alfa", 0, 98, 1, 99)])
    requests = spark.createDataFrame([(i, "alfa", i) for i in range(20)], "req_id long, calle string, altura int")
    requests.write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
        stream_addresses(stream, lambda: table, out, state, once=True).awaitTermination()
        return spark.read.parquet(out).filter("success").count()

    assert run() == 20
    requests.withColumn("req_id", F.col("req_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 40


def test_repeated_ids_are_rejected_across_files(spark, tmp_path):
    rows = [feature(1, LINE, nombre_cal="beta"), feature(1, LINE, nombre_cal="alfa"), feature(2, LINE, nombre_cal="gama"), feature(2, None)]
    for i, part in enumerate((rows, [feature(1, LINE, nombre_cal="alfa"), feature(None, LINE), feature(None, LINE)])):
        (tmp_path / f"{i}.geojson").write_text("\n".join(json.dumps(f) for f in part))
    loaded = geojson.read_geojson(spark, str(tmp_path), geojson.STREET_SCHEMA, layout="lines")
    assert sorted((r["id"], r["nombre_cal"]) for r in loaded.rows.collect()) == [(1, "alfa"), (2, "gama")]
    assert sorted(r["reason"] for r in loaded.rejects.collect()) == ["geometry", "id", "id", "repeated id", "repeated id"]
    with pytest.raises(Exception, match="bad feature"):
        geojson.read_geojson(spark, str(tmp_path), geojson.STREET_SCHEMA, layout="lines", on_error="fail").rows.collect()


def test_fingerprint_depends_on_the_content_only(spark, tmp_path):
    lines = [f"line {i % 50} {'x' * (i % 90)}" for i in range(4000)]

    def key(name, text, **conf):
        path = tmp_path / name
        path.write_text(text, newline="")
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
        try:
            return tables.fingerprint(spark, str(path))
        finally:
            for k in conf:
                spark.conf.unset(f"spark.sql.files.{k}")

    whole = "\n".join(lines) + "\n"
    one = key("a.json", whole)
    assert key("b.json", whole) == one
    assert key("c.json", whole, maxPartitionBytes="3000", openCostInBytes="10") == one
    assert key("d.json", whole, maxPartitionBytes="17777", minPartitionNum="3") == one
    swapped = [*lines[:100], lines[101], lines[100], *lines[102:]]
    others = [key("e.json", "\n".join(swapped) + "\n"), key("f.json", whole[:-1]), key("g.json", whole.replace("\n", "\r\n")), key("h.json", ""), key("i.json", whole + "\n")]
    assert len({one, *others}) == 6


@pytest.fixture
def stored(spark, tmp_path):
    rows = [feature(i, {"type": "LineString", "coordinates": [[i, 0], [i + 1, 0]]}, numero_cal=f"c{i % 40}", nombre_cal=f"Calle san {i % 40} martin",
                    alt_ini_pa=100 * i, alt_fin_pa=100 * i + 98, alt_ini_im=100 * i + 1, alt_fin_im=100 * i + 99) for i in range(120)]
    (tmp_path / "s.geojson").write_text("\n".join(json.dumps(f) for f in rows))
    points = [feature(i, {"type": "Point", "coordinates": [i, i]}, num_calle=f"c{i};c{i + 1}") for i in range(30)]
    (tmp_path / "p.geojson").write_text("\n".join(json.dumps(f) for f in points))
    store = Store(str(tmp_path / "store"))
    assert load(spark, str(tmp_path / "s.geojson"), str(tmp_path / "p.geojson"), store, layout="lines")
    return store


def everything(spark, store, index):
    asked = spark.createDataFrame([(1, "san 3", 5), (2, "", 7), (3, "sam 17 martin", 50)], "req_id long, qstr string, limit int")
    places = spark.createDataFrame([(i, f"san {i} martin", 100 * i + 50) for i in range(45)] + [(99, "C7", 4750)], "req_id long, calle string, altura int")
    pairs = spark.createDataFrame([(i, f"san {i} martin", f"c{i + 1}") for i in range(35)], "req_id long, calle1 string, calle2 string")
    return [
        sorted(map(str, df.collect()))
        for df in (names.suggest(asked, index), address.geocode_addresses(places, index), crossing.geocode_intersections(pairs, index, store.table(spark, "intersections")))
    ]


def test_stored_look_ups_give_the_same_answers(spark, stored):
    index = stored_street_index(spark, stored)
    want = everything(spark, stored, stored.table(spark, "streets"))
    assert everything(spark, stored, index) == want and "success=True" in want[1][1]
    # Another session, which does not know the tables.
    for name in LOOKUPS:
        spark.sql(f"DROP TABLE {table_name(stored, name)}")
    assert everything(spark, stored, stored_street_index(spark, stored)) == want


def test_stored_look_ups_are_not_shuffled(spark, stored):
    index = stored_street_index(spark, stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        prepared = names.prepare_queries(spark.createDataFrame([("san 3", 5)], "qnorm string, k int"), index.names()).withColumn("percent", F.lit(35))
        points = spark.createDataFrame([("C1", 150, True)], "code string, altura int, fallback boolean")
        codes = spark.createDataFrame([("C1",)], "qcode string").join(index.codes, "qcode")
        jobs = {
            "name_slices": names.substring_pairs(prepared, index.names()),
            "name_grams": names.similar_pairs(prepared, index.names()),
            "street_blocks": address.best_segments(points, index),
            "street_codes": codes,
        }
        for name, job in jobs.items():
            plan = job._jdf.queryExecution().executedPlan().toString()
            above = plan[: plan.index(f"{table_name(stored, name)}")].split("Join")[-1]
            assert "Bucketed: true" in plan and above.count("Exchange") <= 1, plan
            side = plan[plan.index("SortMergeJoin") :].split("Exchange hashpartitioning")
            assert table_name(stored, name) not in side[-1] or len(side) == 2, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stale_look_ups_are_refused(spark, stored):
    refresh_names(spark, stored, "another load")
    with pytest.raises(StaleIndex):
        stored_street_index(spark, stored)


def test_stream_against_stored_look_ups(spark, stored, tmp_path):
    requests = spark.createDataFrame([(i, f"san {i} martin", 100 * i + 50) for i in range(10)], "req_id long, calle string, altura int")
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    stream_addresses(stream, lambda: stored_street_index(spark, stored), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = address.geocode_addresses(requests, stored.table(spark, "streets"))
    assert sorted(map(str, done.select(*want.columns).collect())) == sorted(map(str, want.collect())) and done.filter("success").count() > 0


def test_settled_features_are_parsed_once_for_both_tables(spark, tmp_path):
    point = '{"type":"Feature","id":%d,"properties":{"num_calle":"%s"},"geometry":%s}\n'
    place = '{"type":"Point","coordinates":[-58.5,-34.5]}'
    lines = [point % (1, "a;b", place), point % (1, "b;c", place), point % (2, "c", "null"), point % (3, "d", place)]
    (tmp_path / "in.txt").write_text("".join(lines))
    plain, once = (
        geojson.read_geojson(spark, str(tmp_path), geojson.INTERSECTION_SCHEMA, layout="lines", **more) for more in ({}, {"settled": True})
    )
    for table in ("rows", "rejects"):
        want, got = getattr(plain, table), getattr(once, table)
        assert want.columns == got.columns and sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
        assert "Scan text" not in got._jdf.queryExecution().executedPlan().toString()
    assert once.rows.count() == 2 and once.rejects.count() == 2
