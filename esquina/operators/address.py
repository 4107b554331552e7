"""Street and house number to a point.

Ranges are cut into blocks and a number looks up the blocks that hold it, so that a
street with very many segments and very many requests never pairs all of both: a block
keeps its best segment only, and a number meets at most seven blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from esquina.functions import checks, geometry as gm, ranges as rg
from esquina.functions import text as tx
from esquina.operators.names import StreetIndex, indexed, resolve_streets
from esquina.operators.skew import hot_rows, spread_lookup
from esquina.operators.stage import settle

# Answer texts.
NOT_FOUND = "Sin coincidencias en el rango/paridad."
UNMERGEABLE, UNSUPPORTED = "unmergeable_geometry", "unsupported_crs"

# Stands for a missing house number in join keys.
NO_NUMBER = -(1 << 40)

FIELDS = [
    "success", "numero_cal", "nombre_cal", "altura", "paridad",
    "min_par", "max_par", "min_impar", "max_impar", "min_rango", "max_rango",
    "lat", "lon", "geojson", "message",
]


def with_bounds(streets: DataFrame) -> DataFrame:
    """Adds the ordered, clamped bounds of both sides."""
    return streets.select(
        "*",
        rg.lower_bound(F.col("alt_ini_pa"), F.col("alt_fin_pa")).alias("min_par"),
        rg.upper_bound(F.col("alt_ini_pa"), F.col("alt_fin_pa")).alias("max_par"),
        rg.lower_bound(F.col("alt_ini_im"), F.col("alt_fin_im")).alias("min_impar"),
        rg.upper_bound(F.col("alt_ini_im"), F.col("alt_fin_im")).alias("max_impar"),
    )


def best_blocks(streets: DataFrame, asked: tuple[int, int] | None = None) -> DataFrame:
    """The narrowest segment of every (code, side, block); ties go to the lowest id.

    With ``asked``, the least and the greatest number that is looked up, ranges are tiled between the two only.
    """
    tiled_from, tiled_to = F.col("low"), F.col("high")
    if asked is not None:
        tiled_from, tiled_to = F.greatest(tiled_from, F.lit(asked[0]).cast("long")), F.least(tiled_to, F.lit(asked[1]).cast("long"))

    def side(even: bool, low: str, high: str) -> Column:
        return F.struct(
            F.lit(even).alias("even"),
            F.least(low, high).cast("long").alias("low"),
            F.greatest(low, high).cast("long").alias("high"),
            (F.col(high).cast("long") - F.col(low)).alias("width"),
        )

    sides = F.array(side(True, "min_par", "max_par"), side(False, "min_impar", "max_impar"))
    return (
        with_bounds(streets)
        .select(tx.norm_code(F.col("numero_cal")).alias("code"), "id", F.inline(sides))
        .withColumns({"low": tiled_from, "high": tiled_to})
        .select("code", "even", "width", "id", F.inline_outer(rg.pieces_of_range("low", "high", with_any=True)))
        .groupBy("code", "even", "level", "block")
        .agg(F.min(F.struct("width", "id")).alias("best"))
    )


def asked_numbers(points: DataFrame) -> tuple[int, int]:
    """The least and the greatest number of the points; an empty range where none has one."""
    ends = points.agg(F.min("altura").alias("least"), F.max("altura").alias("greatest")).first()
    return (0, -1) if ends["least"] is None else (ends["least"], ends["greatest"])


def best_segments(points: DataFrame, streets: DataFrame | StreetIndex) -> DataFrame:
    """(code, altura, fallback) to the id of the segment that is chosen.

    Segments in range come first, then the narrowest. Without one in range, ``fallback``
    takes the narrowest segment of that side of the street. Points are read twice where
    the blocks are not stored, so that they are best settled.
    """
    asked = points.select(
        "code",
        "altura",
        rg.is_even(F.col("altura")).alias("even"),
        F.inline_outer(rg.pieces_of_number("altura", "fallback")),
    )
    index = indexed(streets)
    blocks = best_blocks(index.streets, asked_numbers(points)) if index.blocks is None else index.blocks
    met = asked.join(blocks, ["code", "even", "level", "block"])
    # A number meets at most one row per level, so that taking it by level keeps the
    # aggregation on plain numbers, which Spark hashes; structs it would sort.
    levels = [*range(rg.LEVELS), rg.ANY_NUMBER]
    by_level = [
        F.max(F.when(F.col("level") == level, F.col(f"best.{field}"))).alias(f"{field}{i}")
        for i, level in enumerate(levels)
        for field in ("width", "id")
    ]

    def one(i: int) -> Column:
        row = F.struct(
            F.lit(levels[i] == rg.ANY_NUMBER).alias("outside"), F.col(f"width{i}").alias("width"), F.col(f"id{i}").alias("id")
        )
        return F.when(F.col(f"id{i}").isNotNull(), row)

    picked = met.groupBy("code", "altura").agg(*by_level)
    return picked.withColumn("pick", F.least(*[one(i) for i in range(len(levels))])).select(
        "code", "altura", (~F.col("pick.outside")).alias("in_range"), F.col("pick.id").alias("id")
    )


def street_segments(streets: DataFrame) -> DataFrame:
    """By code and id, what an answer tells of a segment, and its merged line."""
    return with_bounds(streets).select(
        tx.norm_code(F.col("numero_cal")).alias("code"),
        "id", "numero_cal", "nombre_cal", "min_par", "max_par", "min_impar", "max_impar",
        F.col("geom").isNotNull().alias("has_geom"),
        F.col("geom.srid").alias("srid"),
        gm.merge_lines(gm.line_parts(F.col("geom"))).alias("line"),
    )


def place(picked: DataFrame, streets: DataFrame | StreetIndex) -> DataFrame:
    """(code, altura) with the chosen segment and its point in the struct ``seg``."""
    even = rg.is_even(F.col("altura"))
    index = indexed(streets)
    payload = street_segments(index.streets) if index.segments is None else index.segments
    srid = F.col("srid")
    at = gm.interpolate(F.col("line"), rg.position(F.col("altura"), F.col("min_rango"), F.col("max_rango")))
    status = (
        F.when(~F.col("has_geom"), F.lit(checks.OK))
        .when(F.col("line").isNull(), F.lit(UNMERGEABLE))
        .when(~gm.transformable(srid, gm.WGS84), F.lit(UNSUPPORTED))
        .otherwise(F.lit(checks.OK))
    )
    return (
        picked.join(payload, ["code", "id"])
        .withColumn("min_rango", F.when(even, F.col("min_par")).otherwise(F.col("min_impar")))
        .withColumn("max_rango", F.when(even, F.col("max_par")).otherwise(F.col("max_impar")))
        .select(
            "code",
            "altura",
            F.struct(
                "in_range", "numero_cal", "nombre_cal", "min_par", "max_par", "min_impar", "max_impar",
                "min_rango", "max_rango", status.alias("status"),
                gm.transform_vertex(at, srid, gm.WGS84).alias("point"),
            ).alias("seg"),
        )
    )


def street_key(code: Column, street: Column) -> Column:
    """What the street is looked up by: a code that is given, even an empty one, wins."""
    return F.when(code.isNotNull(), tx.norm_code(code)).otherwise(tx.null_to_empty(street))


def attach_addresses(requests: DataFrame, streets: DataFrame | StreetIndex, validate: bool = True) -> DataFrame:
    """Every request row with its answer in the struct column ``answer``.

    Needs req_id and altura, and calle or numero_cal; fallback is optional. A code that
    is given wins over the street text, even an empty one.
    """
    have = set(requests.columns)
    code_in = F.col("numero_cal") if "numero_cal" in have else F.lit(None).cast("string")
    street = F.col("calle") if "calle" in have else F.lit(None).cast("string")
    fallback = F.coalesce(F.col("fallback"), F.lit(False)) if "fallback" in have else F.lit(False)
    valid = checks.valid_number(F.col("altura")) if validate else F.lit(True)

    rows = requests.withColumns(
        {
            "_valid": valid,
            "_by_code": code_in.isNotNull(),
            "_key": street_key(code_in, street),
            "_number": F.coalesce(F.col("altura").cast("long"), F.lit(NO_NUMBER)),
            "_fallback": fallback,
        }
    )
    keys = ["_by_code", "_key", "_number"]
    counts = settle(
        rows.filter("_valid")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.max("_fallback").alias("fallback")),
        "address-keys",
    )
    texts = counts.filter(~F.col("_by_code")).select(F.col("_key").alias("q")).distinct()
    resolved = resolve_streets(texts, streets).withColumnRenamed("code", "resolved")
    looked = counts.join(resolved, ~F.col("_by_code") & (F.col("_key") == F.col("q")), "left").select(
        *keys,
        "fallback",
        F.when(F.col("_by_code"), F.col("_key")).otherwise(tx.norm_code(F.col("resolved"))).alias("_code"),
    )
    coded = settle(looked, "address-codes")
    points = settle(
        coded.groupBy("_code", "_number").agg(F.max("fallback").alias("fallback"), F.count(F.lit(1)).alias("n")),
        "address-points",
    )
    may_be_hot = coded.count() > hot_rows(coded)
    number = F.when(F.col("_number") != NO_NUMBER, F.col("_number"))
    asked = points.select(F.col("_code").alias("code"), number.alias("altura"), "fallback")
    placed = place(best_segments(asked, streets), streets).select(
        F.col("code").alias("_code"),
        F.coalesce("altura", F.lit(NO_NUMBER)).alias("_number"),
        F.col("seg").alias("_seg"),
    )
    # Both look-ups are salted: many spellings may mean one address, many requests one spelling.
    sizes = points if may_be_hot else None
    found = spread_lookup(coded, placed, sizes, ["_code", "_number"], F.col("_key"), "inner").select(*keys, "_seg")

    joined = spread_lookup(rows, found, counts, keys, F.col("req_id"))
    hit = F.col("_valid") & F.coalesce(F.col("_seg.in_range") | F.col("_fallback"), F.lit(False)) & F.col("_seg").isNotNull()
    good = hit & (F.col("_seg.status") == checks.OK)

    def held(name: str) -> Column:
        return F.when(hit, F.col(f"_seg.{name}")).alias(name)

    lat = F.when(good, F.col("_seg.point.y"))
    lon = F.when(good, F.col("_seg.point.x"))
    answer = F.struct(
        F.when(good, F.lit(True)).alias("success"),
        held("numero_cal"),
        held("nombre_cal"),
        number.cast("int").alias("altura"),
        tx.parity_label(number).alias("paridad"),
        *[held(c) for c in ("min_par", "max_par", "min_impar", "max_impar", "min_rango", "max_rango")],
        lat.alias("lat"),
        lon.alias("lon"),
        gm.point_geojson(lon, lat).alias("geojson"),
        F.when(F.col("_valid") & ~hit, F.lit(NOT_FOUND)).alias("message"),
        F.when(~F.col("_valid"), F.lit(checks.INVALID))
        .when(hit, F.col("_seg.status"))
        .otherwise(F.lit(checks.OK))
        .alias("status"),
    )
    return joined.select(*[F.col(c) for c in requests.columns], answer.alias("answer"))


def geocode_addresses(requests: DataFrame, streets: DataFrame | StreetIndex, validate: bool = True) -> DataFrame:
    """The fifteen answer fields and a status for every request."""
    return attach_addresses(requests, streets, validate).select("req_id", "answer.*")


def answer_json(answer: Column, fields: list[str]) -> Column:
    """The answer as one JSON object; null fields are kept."""
    point = "struct<type:string,coordinates:array<double>>"
    cols = [
        (F.from_json(answer["geojson"], point) if f == "geojson" else answer[f]).alias(f) for f in fields
    ]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
