"""GeoJSON in and out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from esquina.functions import geometry as gm
from esquina.operators.stage import settle
from esquina.sources.blocks import scan_collections

# Columns that the engine reads; the raw properties are kept beside them.
STREET_SCHEMA = (
    "numero_cal string, nombre_cal string, alt_ini_pa int, alt_fin_pa int, alt_ini_im int, alt_fin_im int"
)
INTERSECTION_SCHEMA = "num_calle string"

FEATURE = "struct<type:string,id:string,properties:string,geometry:string>"
COLLECTION_SCHEMA = f"type string, features array<{FEATURE}>, _corrupt_record string"

# A line of a pretty-printed collection that holds no feature.
WRAPPER = r'^\s*$|^\s*[\[\]{}],?\s*$|^\s*"(type|name|crs|features|bbox)"\s*:.*$|^\s*[\]}]+\s*,?\s*[\]}]*\s*$'


@dataclass
class Loaded:
    """Features that were read, and the rejected ones with the reason."""

    rows: DataFrame
    rejects: DataFrame


def _features_of_collections(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", True).json(path)
    several = len(whole.inputFiles()) > 1
    whole = whole.withColumn("file", F.col("_metadata.file_path") if several else F.lit(""))
    broken = whole.filter(F.col("_corrupt_record").isNotNull() | F.col("features").isNull()).select(
        F.col("_corrupt_record").alias("raw"), F.lit(None).cast(FEATURE).alias("feature"), F.lit(None).cast("long").alias("at")
    )
    # One file is one task up to here, so the features are dealt out again.
    found = (
        whole.filter(F.col("_corrupt_record").isNull())
        .select("file", F.posexplode("features").alias("at", "feature"))
        .select(F.to_json("feature").alias("raw"), "feature", (F.col("at") + 1).cast("long").alias("at"), "file")
        .repartition(spark.sparkContext.defaultParallelism)
    )
    if several:
        # Features are numbered on from file to file; this table has one row per file.
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        sizes = whole.select("file", F.coalesce(F.size("features"), F.lit(0)).cast("long").alias("n"))
        starts = sizes.select("file", F.coalesce(F.sum(F.greatest("n", F.lit(0))).over(before), F.lit(0)).alias("start"))
        found = found.join(starts, "file").withColumn("at", F.col("at") + F.col("start")).drop("start")
    found = found.drop("file")
    return found.unionByName(broken)


def _features_of_lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).filter(~F.col("value").rlike(WRAPPER))
    raw = F.regexp_replace("value", r",\s*$", "")
    return text.select(
        raw.alias("raw"), F.from_json(raw, FEATURE).alias("feature"), F.lit(None).cast("long").alias("at")
    )


def _features_of_blocks(spark: SparkSession, path: str) -> DataFrame:
    found, broken = scan_collections(spark, path)
    features = found.select("raw", F.from_json("raw", FEATURE).alias("feature"), "at")
    return features.unionByName(broken.select("raw", F.lit(None).cast(FEATURE).alias("feature"), F.lit(None).cast("long").alias("at")))


def read_geojson(
    spark: SparkSession,
    path: str,
    schema: str,
    src: int = gm.WGS84,
    dst: int = gm.WGS84,
    promote: bool = True,
    layout: str = "collection",
    on_error: str = "skip",
    settled: bool = False,
) -> Loaded:
    """Features as rows: id, the columns of ``schema``, properties, geom.

    ``layout="collection"`` reads any FeatureCollection, a file per task.
    ``layout="blocks"`` reads a FeatureCollection, however it is printed, in many tasks
    (see ``blocks.scan_collections``); of a broken file it keeps the whole features.
    ``layout="lines"`` reads one feature per line, bare or inside a collection written
    that way, and splits large files over many tasks; it needs an id in every feature.
    Features without a usable geometry or id are rejected, and so are those that repeat an
    id, in whatever file: the one whose text comes first is kept. ``on_error="fail"`` makes
    them fail the job instead. ``settled`` stores what was read, for callers that take both
    tables, so that the files are parsed once.
    """
    read = {"collection": _features_of_collections, "blocks": _features_of_blocks, "lines": _features_of_lines}[layout]
    features = read(spark, path)
    own_id = F.coalesce(F.col("feature.id"), F.get_json_object("feature.properties", "$.id"))
    stored = gm.reproject(F.col("geom"), src, dst)
    parsed = features.select(
        "raw",
        F.coalesce(own_id.try_cast("long"), F.col("at")).alias("id"),
        F.from_json("feature.properties", schema).alias("props"),
        F.col("feature.properties").alias("properties"),
        gm.parse_geojson(F.col("feature.geometry"), src).alias("geom"),
    ).withColumn("geom", gm.let(stored, gm.promote_multi) if promote else stored)
    reason = F.when(F.col("geom").isNull(), F.lit("geometry")).when(F.col("id").isNull(), F.lit("id"))
    # Only usable features compete for an id; the others stay apart from each other.
    by_id = Window.partitionBy("id", F.when(reason.isNotNull(), F.xxhash64("raw"))).orderBy("raw")
    repeated = F.when(F.row_number().over(by_id) > 1, F.lit("repeated id"))
    checked = parsed.withColumn("reason", F.coalesce(reason, repeated))
    if settled:
        # The text is needed of a rejected feature only.
        checked = settle(checked.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw"))), "features")
    rejects = checked.filter(F.col("reason").isNotNull()).select("raw", "reason")
    if on_error == "fail":
        bad = F.raise_error(F.concat(F.lit("bad feature: "), F.col("raw")))
        rows = checked.withColumn("id", F.when(F.col("reason").isNotNull(), bad).otherwise(F.col("id")))
    else:
        rows = checked.filter(F.col("reason").isNull())
    return Loaded(rows.select("id", "props.*", "properties", "geom"), rejects)


def feature_lines(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON point feature per row with numeric coordinates; others are dropped."""
    x, y = F.expr(f"try_cast({lon} AS DOUBLE)"), F.expr(f"try_cast({lat} AS DOUBLE)")
    properties = F.struct(*[F.col(c) for c in df.columns if c not in (lon, lat)])
    shape = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry")
    )
    kept = df.filter(x.isNotNull() & y.isNotNull())
    return kept.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, lon: str, lat: str, mode: str = "errorifexists") -> None:
    feature_lines(df, lon, lat).write.mode(mode).text(path)
