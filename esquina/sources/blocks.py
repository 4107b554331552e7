"""One large GeoJSON collection read by many tasks.

The file is read in blocks of ``spark.sql.files.maxPartitionBytes``. A block is a run of pieces that
end with a closing brace. What a piece does to the reader's state (inside a string or not, depth of
brackets) is known for both states it may start in, and such effects combine, so one row per block
tells the state at which every block starts. Nothing but those rows passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from esquina.operators.stage import settle

PIECE_END = "}"
# Depth right behind a feature: inside the collection and its list of features.
FEATURE_DEPTH = 2
FIRST_FEATURE = r'(?s)"features"\s*:\s*\[\s*(\{.*)$'


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _moved(text: Column) -> Column:
    """How much deeper the brackets of a text without strings lead."""
    return _count(text, "[{") - _count(text, "]}")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces in order of (file, block, nth), with the effect of each.

    ``flips``: 1 if it starts inside a string and ends outside, or the reverse. ``outside``, ``inside``:
    how much deeper it leads if it starts outside or inside of a string.
    """
    text = spark.read.option("lineSep", PIECE_END).text(path)
    # An escaped character never opens or closes a string; a piece never starts within an escape.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|$)'
    flips = _count(bare, '"') % 2
    inside = F.regexp_replace(F.regexp_replace(bare, r'^[^"]*("|$)', ""), strings, "")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
        flips.alias("flips"),
        (_moved(F.regexp_replace(bare, strings, "")) - F.when(flips == 0, 1).otherwise(0)).alias("outside"),
        (_moved(inside) - F.when(flips == 1, 1).otherwise(0)).alias("inside"),
    )


def _before(*order: str, by: list[str]) -> Column:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column | str, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _block_starts(pieces: DataFrame) -> DataFrame:
    """The state at the start of every block: ``quoted`` (0 or 1) and ``depth``."""
    flipped = _sum_before("flips", _before("nth", by=["file", "block"])) % 2
    effects = (
        pieces.withColumn("flipped", flipped)
        .groupBy("file", "block")
        .agg(
            (F.sum("flips") % 2).alias("flips"),
            F.sum(F.when(F.col("flipped") == 0, F.col("outside")).otherwise(F.col("inside"))).alias("outside"),
            F.sum(F.when(F.col("flipped") == 0, F.col("inside")).otherwise(F.col("outside"))).alias("inside"),
            F.sum(F.octet_length("value") + 1).alias("bytes"),
            F.first("size").alias("size"),
        )
    )
    before, whole = _before("block", by=["file"]), Window.partitionBy("file")
    last = F.col("block") == F.max("block").over(whole)
    return (
        effects.withColumn("quoted", _sum_before("flips", before) % 2)
        .withColumn("moved", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
        .select(
            "file",
            "block",
            "quoted",
            _sum_before("moved", before).alias("depth"),
            # The text behind the last brace of a file has none of its own.
            (last & (F.sum("bytes").over(whole) > F.col("size"))).alias("open_end"),
        )
    )


def _segments(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Texts between cuts, and the rests at both edges of a block.

    A cut lies behind each brace that leaves the reader at the depth of the feature list or above it.
    """
    # Renamed, so that the two branches of one table can be joined.
    at = starts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "quoted", "depth", "open_end")
    by = ["file", "block"]
    before = _before("nth", by=by)
    rows = pieces.join(at, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    quoted = (F.col("quoted") + _sum_before("flips", before)) % 2
    rows = rows.withColumn("was_quoted", quoted).withColumn(
        "moved", F.when(F.col("was_quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    )
    end = F.lead("nth").over(Window.partitionBy(*by).orderBy("nth")).isNull() & F.col("open_end")
    rows = rows.withColumns({"from": F.col("depth") + _sum_before("moved", before), "end": end})
    cut = ((F.col("was_quoted") + F.col("flips")) % 2 == 0) & (F.col("from") + F.col("moved") <= FEATURE_DEPTH) & ~F.col("end")
    rows = rows.withColumn("cut", cut)
    rows = rows.withColumn("part", _sum_before(F.col("cut").cast("long"), before))
    text = F.concat("value", F.when(F.col("end"), F.lit("")).otherwise(F.lit(PIECE_END)))
    return rows.groupBy(*by, "part").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("text")))), lambda p: p["text"])).alias("text"),
        F.min_by("from", "nth").alias("from"),
        F.max_by(F.col("from") + F.col("moved"), "nth").alias("to"),
        F.bool_or("cut").alias("cut"),
    )


def scan_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features as (raw, at), ``at`` counting from 1 over all files in order of their names, and broken rests as (raw).

    Reads plain (not compressed) files that hold a FeatureCollection each; its ``features`` must be the
    only list of objects right under the root. What stands behind the last whole object of a broken
    file is given as broken, one row per block; an object whose brackets or quotes do not match takes
    all that follows with it. Line breaks, indents and empty files do not matter.
    """
    pieces = settle(_pieces(spark, path), "collection-pieces")
    segments = settle(_segments(pieces, _block_starts(pieces)), "collection-segments")
    # One row per block from here on.
    cuts = segments.groupBy("file", "block").agg(F.max("part").alias("last"), F.sum(F.col("cut").cast("long")).alias("cuts"))
    offsets = cuts.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        "last",
        _sum_before("cuts", _before("block", by=["file"])).alias("offset"),
        F.sum("cuts").over(Window.partitionBy("file")).alias("total"),
    )
    placed = (
        segments.join(offsets, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
        .withColumn("no", F.col("offset") + F.col("part"))
        .drop("_file", "_block")
    )
    rest = F.col("no") == F.col("total")
    broken = placed.filter(rest & F.col("text").rlike(r"\S")).select(F.col("text").alias("raw"))
    # Only the first and the last text of a block may belong to one that began or goes on elsewhere.
    edge = (F.col("part") == 0) | ~F.col("cut")
    fields = ["file", "block", "no", "text", "from", "to"]
    joined = (
        placed.filter(~rest & edge)
        .groupBy("file", "no")
        .agg(
            F.max("block").alias("block"),
            F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])).alias("text"),
            F.min_by("from", "block").alias("from"),
            F.max_by("to", "block").alias("to"),
        )
    )
    whole = placed.filter(~rest & ~edge).select(*fields).unionByName(joined.select(*fields))
    # The first feature comes with the head of the collection.
    body = F.when(F.col("from") >= FEATURE_DEPTH, F.regexp_replace("text", r"^\s*,?\s*", "")).otherwise(
        F.regexp_extract("text", FIRST_FEATURE, 1)
    )
    features = (
        whole.filter(F.col("to") == FEATURE_DEPTH)
        .select("file", "block", "no", body.alias("raw"))
        .filter(F.startswith("raw", F.lit("{")))
    )
    return _numbered(features, offsets), broken


def _numbered(features: DataFrame, blocks: DataFrame) -> DataFrame:
    """(raw, at): the features of a file follow each other, so their numbers do too."""
    files = features.groupBy("file").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per file.
    shift = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file").alias("_named"), (shift - F.col("first") + 1).alias("shift"))
    # By block, as one file may hold all rows.
    shifts = blocks.join(files, F.col("_file") == F.col("_named")).select("_file", "_block", "shift")
    return features.join(shifts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select(
        "raw", (F.col("no") + F.col("shift")).cast("long").alias("at")
    )
