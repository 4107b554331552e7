"""Two crossing streets to a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from esquina.functions import checks, geometry as gm
from esquina.functions import text as tx
from esquina.operators.address import UNSUPPORTED
from esquina.operators.names import StreetIndex, resolve_streets
from esquina.operators.skew import hot_rows, spread_lookup
from esquina.operators.stage import settle

# Fixed value: answer text.
NOT_FOUND = "Intersección no encontrada o geometría no puntual."
FIELDS = ["success", "lat", "lon", "geojson", "message"]

# A crossing of more streets than this is joined street by street instead of by pairs.
MAX_PAIRED = 8


def with_code_list(intersections: DataFrame, only_missing: bool = False) -> DataFrame:
    """(Re)computes ``nums_norm``; the backfill form keeps what is there."""
    fresh = tx.code_list(F.col("num_calle"))
    if only_missing and "nums_norm" in intersections.columns:
        fresh = F.coalesce(F.col("nums_norm"), fresh)
    return intersections.withColumn("nums_norm", fresh)


def _pairs(codes: Column) -> Column:
    """Ordered pairs within one crossing, each street with itself included."""
    sorted_codes = F.array_sort(F.array_distinct(codes))
    return F.flatten(
        F.transform(
            sorted_codes,
            lambda a, i: F.transform(
                F.slice(sorted_codes, i + 1, F.size(sorted_codes) - i),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def crossing_of_pairs(pairs: DataFrame, intersections: DataFrame) -> DataFrame:
    """(a, b) with a <= b to the lowest id of a crossing that lists both codes."""
    listed = intersections.select("id", "nums_norm").withColumn("many", F.size(F.array_distinct("nums_norm")))
    usual = (
        listed.filter(F.col("many") <= MAX_PAIRED)
        .select("id", F.inline_outer(_pairs(F.col("nums_norm"))))
        .filter(F.col("a").isNotNull())
        .groupBy("a", "b")
        .agg(F.min("id").alias("id"))
        .join(pairs, ["a", "b"])
    )
    crowded = listed.filter(F.col("many") > MAX_PAIRED)
    rare = _crowded_pairs(pairs, crowded.select("id", "nums_norm"))
    return usual.unionByName(rare).groupBy("a", "b").agg(F.min("id").alias("id"))


def _crowded_pairs(pairs: DataFrame, crowded: DataFrame) -> DataFrame:
    """The pairs of one crossing are too many to write, so each pair looks at those of its rarer street.

    The pairs that look at a street and the crossings that list it form a grid, which is cut into cells of at
    most about ``spark.esquina.hotRows`` comparisons; the least ids of the cells are merged.
    """
    side = max(1, math.isqrt(hot_rows(pairs)))
    listings = crowded.select("id", "nums_norm", F.explode(F.array_distinct("nums_norm")).alias("k"))
    listed = settle(listings.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "crossing-listed")
    if listed.isEmpty():
        return listed.select(F.col("k").alias("a"), F.col("k").alias("b"), F.col("n").alias("id")).limit(0)
    asked = pairs
    for own, other in (("a", "b"), ("b", "a")):
        counts = pairs.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
        sizes = listed.select(F.col("k").alias(own), F.col("n").alias(f"_n_{own}"))
        # A pair with a street that no crowded crossing lists has none.
        asked = spread_lookup(asked, sizes, counts, [own], F.col(other), how="inner")
    first = F.col("_n_a") <= F.col("_n_b")
    asked = settle(
        asked.select(
            "a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("k"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other")
        ),
        "crossing-asked",
    )
    askers = settle(asked.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "crossing-askers")
    cells = askers.join(listed.select("k", F.col("n").alias("m")), "k").select(
        "k", F.ceil(F.col("n") / side).alias("pair_parts"), F.ceil(F.col("m") / side).alias("id_parts")
    )

    def parts(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name).cast("long") - 1))

    def part(value: str, name: str) -> Column:
        return F.pmod(F.xxhash64(value), F.col(name).cast("long"))

    wide = spread_lookup(asked, cells, askers, ["k"], F.col("other"), how="inner").select(
        "a", "b", "k", "other", part("other", "pair_parts").alias("pair_part"), parts("id_parts").alias("id_part")
    )
    long = spread_lookup(listings, cells, listed, ["k"], F.col("id"), how="inner").select(
        "id", "nums_norm", "k", part("id", "id_parts").alias("id_part"), parts("pair_parts").alias("pair_part")
    )
    return (
        wide.join(long, ["k", "pair_part", "id_part"])
        .filter(F.array_contains("nums_norm", F.col("other")))
        .groupBy("a", "b")
        .agg(F.min("id").alias("id"))
    )


def crossing_point(geom: Column) -> Column:
    """First point of the geometry, else a point on it, in WGS84."""
    at = gm.representative_point(geom)
    return gm.transform_vertex(at, gm.default_srid(geom["srid"]), gm.WGS84)


def attach_crossings(
    requests: DataFrame, streets: DataFrame | StreetIndex, intersections: DataFrame, validate: bool = True
) -> DataFrame:
    """Every request row with its answer in the struct column ``answer``."""
    if "nums_norm" not in intersections.columns:
        intersections = with_code_list(intersections)
    valid = checks.valid_crossing(F.col("calle1"), F.col("calle2")) if validate else F.lit(True)
    rows = requests.withColumns(
        {
            "_valid": valid,
            "_q1": tx.null_to_empty(F.col("calle1")),
            "_q2": tx.null_to_empty(F.col("calle2")),
        }
    )
    keys = ["_q1", "_q2"]
    counts = settle(rows.filter("_valid").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "crossing-texts")
    texts = counts.select(F.explode(F.array("_q1", "_q2")).alias("q")).distinct()
    resolved = settle(
        resolve_streets(texts, streets).select("q", tx.norm_code(F.col("code")).alias("code")), "crossing-codes"
    )

    may_be_hot = counts.count() > hot_rows(counts)

    def with_code(df: DataFrame, key: str, other: str, name: str) -> DataFrame:
        # One street may be part of very many of the pairs.
        sizes = counts.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if may_be_hot else None
        table = resolved.select(F.col("q").alias(key), F.col("code").alias(name))
        return spread_lookup(df, table, sizes, [key], F.col(other))

    looked = with_code(with_code(counts.select(*keys), "_q1", "_q2", "c1"), "_q2", "_q1", "c2").select(
        *keys, F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")
    )
    coded = settle(looked, "crossing-pairs")
    pairs = coded.select("a", "b").distinct()
    picked = crossing_of_pairs(pairs, intersections)
    placed = picked.join(intersections.select("id", "geom"), "id").select(
        "a",
        "b",
        crossing_point(F.col("geom")).alias("point"),
        gm.transformable(gm.default_srid(F.col("geom.srid")), gm.WGS84).alias("can_transform"),
        F.col("geom").isNotNull().alias("has_geom"),
    )
    # Many spellings may name the same two streets.
    spellings = coded.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")) if may_be_hot else None
    found = spread_lookup(coded, placed, spellings, ["a", "b"], F.xxhash64(*keys), how="inner").drop("a", "b")
    joined = spread_lookup(rows, found, counts, keys, F.col("req_id"))
    hit = F.col("_valid") & F.col("point").isNotNull()
    lat, lon = F.when(hit, F.col("point.y")), F.when(hit, F.col("point.x"))
    refused = F.coalesce(F.col("has_geom") & ~F.col("can_transform"), F.lit(False))
    answer = F.struct(
        F.when(hit, F.lit(True)).alias("success"),
        lat.alias("lat"),
        lon.alias("lon"),
        gm.point_geojson(lon, lat).alias("geojson"),
        F.when(F.col("_valid") & ~hit, F.lit(NOT_FOUND)).alias("message"),
        F.when(~F.col("_valid"), F.lit(checks.INVALID))
        .when(refused, F.lit(UNSUPPORTED))
        .otherwise(F.lit(checks.OK))
        .alias("status"),
    )
    return joined.select(*[F.col(c) for c in requests.columns], answer.alias("answer"))


def geocode_intersections(
    requests: DataFrame, streets: DataFrame | StreetIndex, intersections: DataFrame, validate: bool = True
) -> DataFrame:
    """The five answer fields and a status for every request."""
    return attach_crossings(requests, streets, intersections, validate).select("req_id", "answer.*")
