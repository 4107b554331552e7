import re

from pyspark.sql import functions as F

from esquina.functions import geometry as gm

STREET = "id long, numero_cal string, nombre_cal string, alt_ini_pa int, alt_fin_pa int, alt_ini_im int, alt_fin_im int, wkt string"


def streets(spark, rows):
    """Rows end with a GeoJSON geometry text, or None for a line from (0,0) to (1,0)."""
    line = '{"type":"LineString","coordinates":[[0,0],[1,0]]}'
    filled = [(*r[:7], line if len(r) < 8 else r[7]) for r in rows]
    df = spark.createDataFrame(filled, STREET)
    return df.withColumn("geom", gm.parse_geojson(F.col("wkt"), gm.WGS84)).drop("wkt")


def trigram_set(text):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", text) for i in range(len(w) + 1)}


def similarity(a, b):
    x, y = trigram_set(a), trigram_set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def like(text, pattern):
    """LIKE with backslash as the escape character."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 2
            continue
        out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, text, re.S) is not None
