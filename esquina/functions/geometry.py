"""Planar geometry on ``struct<type, srid, parts>`` columns.

``parts`` is an array of vertex arrays: a point is one part with one vertex, a
multi-point has one part per point, a (multi)line one part per line, a polygon one
part per ring. All steps are array expressions, so they run inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from esquina.functions.projection import from_grid, is_grid, to_grid

VERTEX = "struct<x:double,y:double>"
LINE = f"array<{VERTEX}>"
GEOMETRY = f"struct<type:string,srid:int,parts:array<{LINE}>>"

WGS84, MERCATOR = 4326, 3857
EARTH_RADIUS = 6378137.0

POINT_TYPES = ["Point", "MultiPoint"]
LINE_TYPES = ["LineString", "MultiLineString"]
POLYGON_TYPES = ["Polygon", "MultiPolygon"]
COLLECTION = "GeometryCollection"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: Column, srid: Column, parts: Column) -> Column:
    return F.struct(kind.alias("type"), srid.cast("int").alias("srid"), parts.alias("parts"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _no_parts() -> Column:
    return F.array().cast(f"array<{LINE}>")


# --- parsing ---------------------------------------------------------------

def _coordinates(kind: Column, text: Column) -> Column:
    def parsed(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    def vert(c: Column) -> Column:
        return vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1)))

    def line(c: Column) -> Column:
        return F.transform(c, vert)

    return (
        F.when(kind == "Point", F.array(F.array(vert(parsed(1)))))
        .when(kind == "MultiPoint", F.transform(parsed(2), lambda p: F.array(vert(p))))
        .when(kind == "LineString", F.array(line(parsed(2))))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(parsed(3), line))
        .when(kind == "MultiPolygon", F.flatten(F.transform(parsed(4), lambda p: F.transform(p, line))))
    )


def parse_geojson(text: Column, srid: int) -> Column:
    """A GeoJSON geometry text as a geometry, or null if any of it is unusable.

    A collection keeps its points and lines; one with polygons is not accepted.
    """
    kind = F.get_json_object(text, "$.type")
    plain = _coordinates(kind, F.get_json_object(text, "$.coordinates"))
    members = F.from_json(
        F.get_json_object(text, "$.geometries"), "array<struct<type:string,coordinates:string>>"
    )
    usable = F.forall(members, lambda m: m["type"].isin(POINT_TYPES + LINE_TYPES))
    collected = F.when(
        usable, F.flatten(F.transform(members, lambda m: _coordinates(m["type"], m["coordinates"])))
    )
    parts = F.when(kind == COLLECTION, collected).otherwise(plain)

    def checked(found: Column) -> Column:
        whole = F.forall(
            found,
            lambda p: (F.size(p) > 0) & F.forall(p, lambda v: v["x"].isNotNull() & v["y"].isNotNull()),
        )
        return F.when(F.coalesce((F.size(found) > 0) & whole, F.lit(False)), geometry(kind, F.lit(srid), found))

    return let(parts, checked)


def promote_multi(geom: Column) -> Column:
    """Single types become their multi type; the parts stay as they are."""
    single = geom["type"].isin("Point", "LineString", "Polygon")
    kind = F.when(single, F.concat(F.lit("Multi"), geom["type"])).otherwise(geom["type"])
    return F.when(geom.isNotNull(), geometry(kind, geom["srid"], geom["parts"]))


# --- coordinate systems ----------------------------------------------------

def _to_wgs84(v: Column) -> Column:
    lat = F.degrees(2 * F.atan(F.exp(v["y"] / EARTH_RADIUS)) - math.pi / 2)
    return vertex(F.degrees(v["x"] / EARTH_RADIUS), lat)


def _to_mercator(v: Column) -> Column:
    y = F.log(F.tan(math.pi / 4 + F.radians(v["y"]) / 2)) * EARTH_RADIUS
    return vertex(F.radians(v["x"]) * EARTH_RADIUS, y)


def transformable(srid: Column, dst: int) -> Column:
    known = srid.isin(WGS84, MERCATOR) | is_grid(srid)
    reachable = F.lit(dst in (WGS84, MERCATOR)) | is_grid(F.lit(dst))
    return F.coalesce((srid == dst) | known & reachable, F.lit(False))


def transform_vertex(v: Column, srid: Column, dst: int) -> Column:
    """The vertex in ``dst``; null for a pair of systems that is not supported."""

    def from_wgs84(w: Column) -> Column:
        if dst == WGS84:
            return w
        if dst == MERCATOR:
            return _to_mercator(w)
        return F.when(is_grid(F.lit(dst)), to_grid(w, F.lit(dst)))

    def moved(w: Column) -> Column:
        out = F.when(srid == dst, w).when(srid == WGS84, from_wgs84(w))
        if dst != MERCATOR:
            out = out.when(srid == MERCATOR, let(_to_wgs84(w), from_wgs84))
        return out.when(is_grid(srid), let(from_grid(w, srid), from_wgs84))

    return let(v, moved)


def transform(geom: Column, dst: int) -> Column:
    srid = geom["srid"]
    parts = F.transform(geom["parts"], lambda p: F.transform(p, lambda v: transform_vertex(v, srid, dst)))
    same = F.when(srid == dst, geom)
    return same.when(transformable(srid, dst), geometry(geom["type"], F.lit(dst), parts))


def reproject(geom: Column, src: int, dst: int) -> Column:
    """Reads the stored numbers as ``src``, whatever they are tagged with."""
    retagged = F.when(geom.isNotNull(), geometry(geom["type"], F.lit(src), geom["parts"]))
    return retagged if src == dst else let(retagged, lambda g: transform(g, dst))


def default_srid(srid: Column) -> Column:
    """An unknown system is taken to be spherical Mercator."""
    return F.when(srid == 0, F.lit(MERCATOR)).otherwise(srid)


# --- parts -----------------------------------------------------------------

def point_parts(geom: Column) -> Column:
    kind, parts = geom["type"], geom["parts"]
    return (
        F.when(kind.isin(POINT_TYPES), parts)
        .when(kind == COLLECTION, F.filter(parts, lambda p: F.size(p) == 1))
        .otherwise(_no_parts())
    )


def line_parts(geom: Column) -> Column:
    kind, parts = geom["type"], geom["parts"]
    return (
        F.when(kind.isin(LINE_TYPES), parts)
        .when(kind == COLLECTION, F.filter(parts, lambda p: F.size(p) > 1))
        .otherwise(_no_parts())
    )


def first_point(geom: Column) -> Column:
    return F.get(F.get(point_parts(geom), F.lit(0)), F.lit(0))


def _first(p: Column) -> Column:
    return F.get(p, F.lit(0))


def _last(p: Column) -> Column:
    return F.get(p, F.size(p) - 1)


def merge_lines(parts: Column) -> Column:
    """One line out of parts that meet end to end; null if they do not form one.

    A single part is kept as stored. Several are walked from the end with the smallest
    coordinates, each part turned as needed; a gap or a node where three parts meet
    gives null. The direction is that of the majority of the parts.
    """
    return let(parts, _merged)


def _merged(parts: Column) -> Column:
    ends = F.flatten(F.transform(parts, lambda p: F.array(_first(p), _last(p))))
    nodes = F.array_distinct(ends)

    def degree(node: Column) -> Column:
        return F.size(F.filter(ends, lambda e: e == node))

    open_ends = F.filter(nodes, lambda n: degree(n) == 1)
    start = F.array_min(F.when(F.size(open_ends) > 0, open_ends).otherwise(nodes))
    forked = F.exists(nodes, lambda n: degree(n) > 2)

    state_type = f"struct<line:{LINE},left:array<{LINE}>,forward:int,backward:int>"
    zero = F.struct(
        F.array(start).alias("line"), parts.alias("left"), F.lit(0).alias("forward"), F.lit(0).alias("backward")
    ).cast(state_type)

    def step(acc: Column, _: Column) -> Column:
        tail = _last(acc["line"])
        index = F.array_position(
            F.transform(acc["left"], lambda p: (_first(p) == tail) | (_last(p) == tail)), F.lit(True)
        ).cast("int")
        part = F.get(acc["left"], index - 1)
        ahead = _first(part) == tail
        run = F.when(ahead, part).otherwise(F.reverse(part))
        return F.when(index == 0, acc).otherwise(
            F.struct(
                F.concat(acc["line"], F.slice(run, F.lit(2), F.greatest(F.size(run) - 1, F.lit(0)))).alias("line"),
                F.filter(acc["left"], lambda p, i: i != index - 1).alias("left"),
                (acc["forward"] + ahead.cast("int")).alias("forward"),
                (acc["backward"] + (~ahead).cast("int")).alias("backward"),
            ).cast(state_type)
        )

    walked = F.aggregate(parts, zero, step)

    def finish(w: Column) -> Column:
        line = F.when(w["backward"] > w["forward"], F.reverse(w["line"])).otherwise(w["line"])
        return F.when(F.size(w["left"]) == 0, line)

    stitched = let(walked, finish)
    return (
        F.when(F.size(parts) == 1, _first(parts))
        .when((F.size(parts) > 1) & ~forked, stitched)
    )


# --- measures --------------------------------------------------------------

def _edges(line: Column) -> Column:
    """Edges with their lengths; an edge starts at every vertex but the last."""

    def edge(v: Column, i: Column) -> Column:
        w = F.get(line, i + 1)
        length = F.sqrt((w["x"] - v["x"]) * (w["x"] - v["x"]) + (w["y"] - v["y"]) * (w["y"] - v["y"]))
        return F.struct(v.alias("a"), w.alias("b"), length.alias("length"))

    return F.transform(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), edge)


def _sum(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))


def interpolate(line: Column, fraction: Column) -> Column:
    """The vertex at that share of the planar length, with the share held in [0, 1]."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))

    def walk(at: Column) -> Column:
        edges, goal = at["edges"], at["goal"]
        zero = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast(VERTEX).alias("at"))

        def step(acc: Column, e: Column) -> Column:
            after = acc["before"] + e["length"]
            part = F.when(e["length"] > 0, (goal - acc["before"]) / e["length"]).otherwise(F.lit(0.0))
            here = vertex(
                e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * part, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * part
            )
            reached = acc["at"].isNull() & (goal <= after)
            return F.struct(after.alias("before"), F.when(reached, here).otherwise(acc["at"]).alias("at"))

        return F.aggregate(edges, zero, step)["at"]

    def measured(edges: Column) -> Column:
        return F.struct(edges.alias("edges"), (_sum(edges, lambda e: e["length"]) * share).alias("goal"))

    walked = let(let(_edges(line), measured), walk)
    # Both ends are the stored vertices themselves, free of rounding.
    return (
        F.when(share <= 0, _first(line))
        .when(share >= 1, _last(line))
        .otherwise(F.coalesce(walked, _last(line)))
    )


def centroid(geom: Column) -> Column:
    """Mean of points; length-weighted mean of edge middles; area-weighted for rings."""
    return let(geom, _centroid)


def _centroid(geom: Column) -> Column:
    kind, parts = geom["type"], geom["parts"]

    def mean(vs: Column) -> Column:
        n = F.size(vs)
        return F.when(n > 0, vertex(_sum(vs, lambda v: v["x"]) / n, _sum(vs, lambda v: v["y"]) / n))

    def middle(edges: Column) -> Column:
        total = _sum(edges, lambda e: e["length"])

        def axis(name: str) -> Column:
            return _sum(edges, lambda e: (e["a"][name] + e["b"][name]) / 2 * e["length"])

        return F.when(total > 0, vertex(axis("x") / total, axis("y") / total))

    def of_lines(lines: Column) -> Column:
        return F.coalesce(let(F.flatten(F.transform(lines, _edges)), middle), mean(F.flatten(lines)))

    def of_rings(rings: Column) -> Column:
        # Relative to the first vertex, so that large coordinates do not cancel.
        base = _first(_first(rings))

        def cross(e: Column) -> Column:
            return (e["a"]["x"] - base["x"]) * (e["b"]["y"] - base["y"]) - (e["b"]["x"] - base["x"]) * (
                e["a"]["y"] - base["y"]
            )

        def balance(edges: Column) -> Column:
            area = _sum(edges, cross)

            def axis(name: str) -> Column:
                return base[name] + _sum(
                    edges, lambda e: (e["a"][name] + e["b"][name] - 2 * base[name]) * cross(e)
                ) / (3 * area)

            return F.when(area != 0, vertex(axis("x"), axis("y")))

        return F.coalesce(let(F.flatten(F.transform(rings, _edges)), balance), of_lines(rings))

    lines = line_parts(geom)
    return (
        F.when(kind.isin(POLYGON_TYPES), of_rings(parts))
        .when(F.size(lines) > 0, of_lines(lines))
        .otherwise(mean(F.flatten(parts)))
    )


def _inner_run(rings: Column) -> Column:
    """Middle of the widest inside run on a scan line about halfway up the rings."""

    def height(ys: Column) -> Column:
        low, high = F.array_min(ys), F.array_max(ys)
        middle = (low + high) / 2
        # Between two vertex heights, so that it crosses every edge at most once.
        above = F.array_min(F.filter(ys, lambda y: y > middle))
        below = F.array_max(F.filter(ys, lambda y: y <= middle))
        return F.when(high > low, (above + below) / 2)

    def crossings(scan: Column) -> Column:
        edges = F.flatten(F.transform(rings, _edges))
        met = F.filter(edges, lambda e: (e["a"]["y"] > scan) != (e["b"]["y"] > scan))
        xs = F.transform(
            met,
            lambda e: e["a"]["x"]
            + (scan - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]),
        )
        return F.struct(scan.alias("y"), F.array_sort(xs).alias("xs"))

    def widest(line: Column) -> Column:
        def run(x: Column, i: Column) -> Column:
            end = F.get(line["xs"], i + 1)
            return F.struct(F.when(i % 2 == 0, end - x).alias("width"), ((end + x) / 2).alias("x"))

        best = F.array_max(F.transform(line["xs"], run))
        return F.when(best["width"].isNotNull(), vertex(best["x"], line["y"]))

    ys = F.transform(F.flatten(rings), lambda v: v["y"])
    return let(let(let(ys, height), crossings), widest)


def representative_point(geom: Column) -> Column:
    """A point on the geometry.

    Points: the first. Lines: the inner vertex nearest to the centroid, or an end if
    there is none. Polygons: the middle of the widest inside run of a scan line.
    """
    return let(geom, _representative)


def _representative(geom: Column) -> Column:
    kind = geom["type"]
    lines = line_parts(geom)
    inner = F.flatten(F.transform(lines, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))))
    stops = F.when(F.size(inner) > 0, inner).otherwise(
        F.flatten(F.transform(lines, lambda p: F.array(_first(p), _last(p))))
    )

    def nearest(middle: Column) -> Column:
        ranked = F.transform(
            stops,
            lambda v, i: F.struct(
                (
                    (v["x"] - middle["x"]) * (v["x"] - middle["x"])
                    + (v["y"] - middle["y"]) * (v["y"] - middle["y"])
                ).alias("d"),
                i.alias("i"),
                v.alias("v"),
            ),
        )
        return F.array_min(ranked)["v"]

    on_line = let(centroid(geom), nearest)
    return (
        F.when(F.size(point_parts(geom)) > 0, first_point(geom))
        .when(kind.isin(POLYGON_TYPES), F.coalesce(_inner_run(geom["parts"]), _first(_first(geom["parts"]))))
        .when(F.size(lines) > 0, on_line)
    )


# --- output ----------------------------------------------------------------

def point_geojson(lon: Column, lat: Column) -> Column:
    """A GeoJSON point text with at most nine decimals; null without coordinates."""
    # Fixed value: nine decimals.
    pair = F.array(F.round(lon, 9), F.round(lat, 9))
    body = F.to_json(F.struct(F.lit("Point").alias("type"), pair.alias("coordinates")))
    return F.when(lon.isNotNull() & lat.isNotNull(), body)
