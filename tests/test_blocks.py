import json
import random

import pytest

from esquina.sources import geojson
from esquina.sources.blocks import scan_collections

ODD = ['plain', 'a "quoted" word', 'back\\slash\\', '}{][', '"features": [{', 'línea\nnueva', '\\"}', '', '\\\\"', '], "features":[{"x":1}', '€uro 🙂 }']
HEADS = [
    {},
    {"name": 'x "features": [ y'},
    {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}},
    {"bbox": [1, 2, 3, 4], "meta": {"features": [{"a": {}}], "note": "}"}},
]


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "1500")
    spark.conf.set(names[1], "0")
    yield
    for n, value in old.items():
        spark.conf.set(n, value)


def made_feature(rnd, i):
    props = {"numero_cal": rnd.choice(ODD), "nombre_cal": rnd.choice(ODD) * rnd.choice([1, 1, 40]), "deep": {"er": [{}, [rnd.choice(ODD)]]}}
    line = {"type": "LineString", "coordinates": [[i, 0], [i + 1, rnd.random()]]}
    out = {"type": "Feature", "properties": props, "geometry": rnd.choice([line, line, line, None])}
    if rnd.random() < 0.7:
        out["id"] = 1000 + i
    return out


def rows_of(loaded):
    return sorted((r["id"], r["numero_cal"], r["nombre_cal"], json.loads(r["properties"]), str(r["geom"])) for r in loaded.rows.collect())


@pytest.mark.parametrize("seed", range(3))
def test_blocks_agree_with_whole_files(spark, tmp_path, small_blocks, seed):
    rnd = random.Random(seed)
    for f in range(rnd.choice([1, 3])):
        features = [made_feature(rnd, i + 100 * f) for i in range(rnd.choice([0, 1, 30]))]
        body = {"type": "FeatureCollection", **rnd.choice(HEADS), "features": features, **rnd.choice([{}, {"tail": {"x": {}}}])}
        text = json.dumps(body, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5)
        (tmp_path / f"{f}.geojson").write_text(text + rnd.choice(["", "\n", " \n\n"]), encoding="utf-8")
    read = [geojson.read_geojson(spark, str(tmp_path), geojson.STREET_SCHEMA, layout=x) for x in ("blocks", "collection")]
    assert rows_of(read[0]) == rows_of(read[1])
    assert read[0].rejects.count() == read[1].rejects.count()


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    path = tmp_path / "one.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [made_feature(rnd, i) for i in range(50)]}))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
    features, broken = scan_collections(spark, str(path))
    assert [r["at"] for r in features.orderBy("at").collect()] == list(range(1, 51)) and broken.isEmpty()


# What is left of the text, whole features, broken rests.
@pytest.mark.parametrize("keep, whole", [(-2, 3), (-3, 2), (-40, 2)])
def test_broken_tails_are_rejected(spark, tmp_path, keep, whole):
    point = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    features = [{"type": "Feature", "id": i, "properties": {}, "geometry": point} for i in range(3)]
    path = tmp_path / "cut.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features})[:keep])
    loaded = geojson.read_geojson(spark, str(path), geojson.STREET_SCHEMA, layout="blocks")
    assert {r["id"] for r in loaded.rows.collect()} == set(range(whole))
    assert loaded.rejects.count() == (whole < 3)


def test_blank_and_empty_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text("")
    (tmp_path / "b.geojson").write_text(" \n")
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    loaded = geojson.read_geojson(spark, str(tmp_path), geojson.STREET_SCHEMA, layout="blocks")
    assert loaded.rows.isEmpty() and loaded.rejects.isEmpty()
