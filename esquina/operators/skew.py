"""Look-ups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from esquina.operators.stage import shuffled

HOT_ROWS_CONF = "spark.esquina.hotRows"
DEFAULT_HOT_ROWS = 1_000_000
# Bound of the broadcast list. A key outside it holds less than 1/4096 of all rows.
MAX_HOT_KEYS = 4096


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def spread_lookup(
    rows: DataFrame, table: DataFrame, counts: DataFrame | None, keys: list[str], row_id: Column, how: str = "left", large: bool = False
) -> DataFrame:
    """``rows`` joined to ``table`` on ``keys``, which are not null, with hot keys salted.

    ``counts`` is a settled table: one row per key of ``rows`` with the row count in ``n``.
    Rows of a key with more than ``spark.esquina.hotRows`` rows are spread over as many salts as needed
    and the table rows of that key are repeated once per salt; the result is the same as
    that of a plain join. The list of hot keys is broadcast: at most 4096 rows. Without
    ``counts`` the caller knows that no key is hot. With ``large`` neither side is broadcast.
    """
    table_names = [f"_table_{k}" for k in keys]
    renamed = table.select(
        *[F.col(k).alias(n) for k, n in zip(keys, table_names)], *[c for c in table.columns if c not in keys]
    )
    per_task = hot_rows(rows)
    if counts is None or counts.filter(F.col("n") > per_task).isEmpty():
        same = [F.col(k) == F.col(n) for k, n in zip(keys, table_names)]
        return (shuffled(rows) if large else rows).join(renamed, same, how).drop(*table_names)

    hot = (
        counts.filter(F.col("n") > per_task)
        .orderBy(F.desc("n"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("n") / per_task).alias("_fan"))
    )
    hot_names = [f"_hot_{k}" for k in keys]

    def with_fan(df: DataFrame, names: list[str]) -> DataFrame:
        same = [F.col(n) == F.col(h) for n, h in zip(names, hot_names)]
        return df.join(F.broadcast(hot), same, "left").drop(*hot_names)

    salt = F.when(F.col("_fan") > 1, F.pmod(F.xxhash64(row_id), F.col("_fan"))).otherwise(F.lit(0))
    salted = with_fan(rows, keys).withColumn("_salt", salt.cast("long")).drop("_fan")

    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_fan") - 1, F.lit(0)).cast("long"))
    repeated = with_fan(renamed, table_names).withColumn("_table_salt", F.explode(salts)).drop("_fan")

    same = [F.col(k) == F.col(n) for k, n in zip([*keys, "_salt"], [*table_names, "_table_salt"])]
    return (shuffled(salted) if large else salted).join(repeated, same, how).drop(*table_names, "_salt", "_table_salt")
