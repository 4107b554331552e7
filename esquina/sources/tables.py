"""Tables, request tables, search documents, and the state of the last load."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from esquina.functions import geometry as gm
from esquina.functions import text as tx

ADDRESS_SCHEMA = "req_id long, calle string, altura int, numero_cal string, fallback boolean, partido string"
CROSSING_SCHEMA = "req_id long, calle1 string, calle2 string"
SUGGEST_SCHEMA = "req_id long, qstr string, limit int"


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_requests(spark: SparkSession, path: str, schema: str, source: str = "parquet") -> DataFrame:
    """A request table; csv files have a header. Unreadable numbers become null."""
    reader = spark.read.schema(schema)
    if source == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return reader.format(source).load(path)


def street_docs(streets: DataFrame) -> DataFrame:
    """One search document per segment that has a place."""
    at = gm.centroid(gm.transform(F.col("geom"), gm.WGS84))
    return (
        streets.select(
            "id",
            tx.null_to_empty(F.col("numero_cal").cast("string")).alias("numero_cal"),
            tx.null_to_empty(F.col("nombre_cal")).alias("nombre_cal"),
            at.alias("_at"),
        )
        .filter(F.col("_at.x").isNotNull() & F.col("_at.y").isNotNull())
        .select(
            "id", "numero_cal", "nombre_cal", F.struct(F.col("_at.y").alias("lat"), F.col("_at.x").alias("lon")).alias("centroid")
        )
    )


def write_docs(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; a row that cannot be written fails the job."""
    docs.write.mode(mode).json(path)


@dataclass(frozen=True)
class LoadConfig:
    """What, besides the file contents, decides whether a load has to be repeated."""

    src: int = gm.WGS84
    dst: int = gm.WGS84
    append: bool = False
    promote: bool = True


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the content of a file, or of a folder's files in the order of their names.

    The lines are hashed in parallel, each with its number in the whole content, and added up, so a large file is no
    single task. The number comes from the counts of the splits before, so neither the size of the splits nor the
    name of the file matters, but order, line ends and the last one do. One row per split is broadcast.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    split = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *split, in_task.alias("at"))
    splits = lines.groupBy("file_path", "file_block_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min("file_size").alias("file_size")
    )
    earlier = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    starts = numbered.select(F.col("file_path").alias("in_file"), F.col("file_block_start").alias("in_split"), "before")
    same = (F.col("file_path") == F.col("in_file")) & (F.col("file_block_start") == F.col("in_split"))
    placed = lines.join(F.broadcast(starts), same)
    digest = F.sha2(F.concat_ws(" ", F.col("at") + F.col("before"), "value"), 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"part{i}")
        for i in range(4)
    ]
    row = placed.agg(F.count(F.lit(1)).alias("lines"), *parts).first()
    size = splits.groupBy("file_path").agg(F.min("file_size").alias("size")).agg(F.sum("size")).first()[0]
    return ":".join(str(v) for v in (size, *row))


def load_key(spark: SparkSession, paths: list[str], config: LoadConfig) -> str:
    return "|".join([*(fingerprint(spark, p) for p in paths), *(str(v) for v in asdict(config).values())])


def needs_import(spark: SparkSession, key: str, state_path: str) -> bool:
    """Whether the stored key of the last load differs. The state is one row."""
    try:
        last = spark.read.schema("key string").json(state_path).first()
    except AnalysisException:
        return True
    return last is None or last["key"] != key


def write_state(spark: SparkSession, key: str, state_path: str) -> None:
    spark.range(1).select(F.lit(key).alias("key")).write.mode("overwrite").json(state_path)
