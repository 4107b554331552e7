"""Input tables of the engine, derived from the driver's parquet tables.

The same SQL runs in Spark and in DuckDB; only identifier quoting differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.functions import geometry as gm
from esquina.operators.stage import settle

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

STREETS = """
SELECT id,
  concat(' ', substr(md5(p_name),1,3), ' ', substr(md5(p_name),4,3)) AS numero_cal,
  concat(CASE WHEN h < '4' THEN 'Av. ' WHEN h < '8' THEN 'CALLE  ' WHEN h < 'a' THEN 'Gral ' ELSE '' END,
         replace(p_name, 'o', 'ó')) AS nombre_cal,
  CASE WHEN p_size = 50 THEN NULL WHEN p_size % 2 = 0 THEN hi_pa ELSE lo_pa END AS alt_ini_pa,
  CASE WHEN p_size = 50 THEN NULL WHEN p_size % 2 = 0 THEN lo_pa ELSE hi_pa END AS alt_fin_pa,
  CASE WHEN p_size = 50 THEN NULL WHEN p_size % 2 = 0 THEN hi_im ELSE lo_im END AS alt_ini_im,
  CASE WHEN p_size = 50 THEN NULL WHEN p_size % 2 = 0 THEN lo_im ELSE hi_im END AS alt_fin_im,
  x0, y0, x0 + 1e-3 AS x1, y0 AS y1, x0 + 1e-3 AS x2, y0 + CAST(1 + p_size % 3 AS DOUBLE) / 1e3 AS y2
FROM (
  SELECT *, 100 * seg AS lo_pa, CASE WHEN p_size = 49 THEN 100 * seg ELSE 100 * seg + 98 END AS hi_pa,
    100 * seg + 1 AS lo_im, 100 * seg + 99 AS hi_im,
    -58.6e0 + CAST(id % 1000 AS DOUBLE) / 1e4 AS x0, -34.6e0 + CAST(seg AS DOUBLE) / 1e3 AS y0
  FROM (
    SELECT p_partkey AS id, p_name, p_size, substr(md5(p_name),1,1) AS h,
      CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS INT) AS seg
    FROM part) b) g
"""

# Every order with the streets of its first and last part.
ORDER_PARTS = """
SELECT l_orderkey, min(l_partkey) AS first_part, max(l_partkey) AS last_part FROM lineitem GROUP BY l_orderkey
"""

ADDRESS_REQUESTS = f"""
SELECT o_orderkey AS req_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
       WHEN o_orderpriority = '5-LOW' THEN concat(' ', substr(md5(p_name),1,3), ' ', substr(md5(p_name),4,3))
       WHEN o_orderstatus = 'P' THEN replace(p_name, 'i', 'y')
       WHEN o_orderstatus = 'O' THEN concat('Avenida ', p_name) ELSE p_name END AS calle,
  CAST(o_orderkey * 13 % 4000 AS INT) AS altura,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
       THEN upper(concat(' ', substr(md5(p_name),1,3), ' ', substr(md5(p_name),4,3))) END AS numero_cal,
  o_orderstatus = 'F' AS fallback, concat('Partido ', CAST(o_custkey % 5 AS STRING)) AS partido
FROM orders JOIN ({ORDER_PARTS}) op ON l_orderkey = o_orderkey JOIN part ON p_partkey = first_part
"""

INTERSECTIONS = f"""
SELECT o_orderkey AS id,
  concat(' ', substr(md5(a.p_name),1,3), ' ', substr(md5(a.p_name),4,3),
         CASE WHEN o_orderkey % 40 = 0 THEN ' ;; ' ELSE ';' END,
         ' ', substr(md5(b.p_name),1,3), ' ', substr(md5(b.p_name),4,3)) AS num_calle,
  CASE WHEN o_orderkey % 200 = 0 THEN 0 ELSE 4326 END AS srid,
  CASE WHEN o_orderkey % 200 = 0 THEN -6523000e0 + CAST(o_custkey AS DOUBLE)
       ELSE -58.6e0 + CAST(o_custkey AS DOUBLE) / 1e4 END AS x,
  CASE WHEN o_orderkey % 200 = 0 THEN -4110000e0 + CAST(o_custkey AS DOUBLE)
       ELSE -34.6e0 + CAST(o_orderkey % 1000 AS DOUBLE) / 1e4 END AS y
FROM orders JOIN ({ORDER_PARTS}) op ON l_orderkey = o_orderkey
JOIN part a ON a.p_partkey = first_part JOIN part b ON b.p_partkey = last_part
"""

INTERSECTION_REQUESTS = f"""
SELECT o_custkey AS req_id, a.p_name AS calle1, b.p_name AS calle2
FROM (SELECT o_custkey, min(o_orderkey) AS o1, max(o_orderkey) AS o2 FROM orders GROUP BY o_custkey) c
JOIN ({ORDER_PARTS}) p1 ON p1.l_orderkey = o1 JOIN ({ORDER_PARTS}) p2 ON p2.l_orderkey = o2
JOIN part a ON a.p_partkey = p1.first_part JOIN part b ON b.p_partkey = p2.last_part
"""

SUGGEST_REQUESTS = """
SELECT CAST(row_number() OVER (ORDER BY q, lim) AS BIGINT) AS req_id, q AS qstr, lim AS "limit" FROM (
  SELECT DISTINCT split_part(p_name, ' ', 1) AS q, 5 AS lim FROM part
  UNION SELECT DISTINCT replace(p_name, 'e', 'é'), 10 FROM part
  UNION SELECT DISTINCT concat('avda ', replace(p_name, 'i', 'y')), 20 FROM part
  UNION SELECT DISTINCT concat(substr(p_name, 1, 2), ' ', split_part(p_name, ' ', 2)), 50 FROM part
  UNION SELECT '', 20 UNION SELECT 'Avenida', 20 UNION SELECT 'ol_ b', 20 UNION SELECT 'e', 7
  UNION SELECT '_', 3 UNION SELECT 'blu', 51) t
"""

STREAM_REQUESTS = """
SELECT event_id AS req_id, ts, p_name AS calle, CAST(event_id * 13 % 4000 AS INT) AS altura,
  CAST(NULL AS STRING) AS numero_cal, event_type = 'error' AS fallback
FROM events JOIN part ON p_partkey = user_id
"""

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables it names."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    frames = {t: load(spark, sf_dir, t) for t in TABLES if t in words}
    text = sql.replace('"limit"', "`limit`").replace("{", "{{").replace("}", "}}")
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **frames)


_SETTLED: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored table, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SETTLED:
        _SETTLED[key] = settle(make(), name)
    return _SETTLED[key]


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "streets", lambda: _streets(spark, sf_dir))


def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "intersections", lambda: _intersections(spark, sf_dir))


def _streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, STREETS)
    line = F.array(*[gm.vertex(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(3)])
    return s.select(
        "id", "numero_cal", "nombre_cal", "alt_ini_pa", "alt_fin_pa", "alt_ini_im", "alt_fin_im",
        gm.geometry(F.lit("LineString"), F.lit(gm.WGS84), F.array(line)).alias("geom"),
    )


def _intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, INTERSECTIONS)
    point = F.array(F.array(gm.vertex(F.col("x"), F.col("y"))))
    return i.select("id", "num_calle", gm.geometry(F.lit("Point"), F.col("srid"), point).alias("geom"))


def address_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ADDRESS_REQUESTS)


def intersection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INTERSECTION_REQUESTS)


SEARCH_DOCS = "SELECT doc_id AS id, CAST(doc_id AS STRING) AS numero_cal, substr(text, 1, 60) AS nombre_cal FROM documents"

SEARCH_REQUESTS = 'SELECT item_id AS req_id, substr(text, 1, 25) AS qstr, 10 AS "limit" FROM benchmark'


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEARCH_DOCS)


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEARCH_REQUESTS)


def suggest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SUGGEST_REQUESTS)


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STREAM_REQUESTS)
