"""Batch geocoding of a table of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from esquina.operators.address import FIELDS, attach_addresses
from esquina.sources.geojson import write_geojson

# Fixed value: prefix of the answer columns.
PREFIX = "api_result_api_"


def geocode_table(requests: DataFrame, streets: DataFrame, where: str | None = None, prefix: str = PREFIX) -> DataFrame:
    """All request rows and columns with the answer fields beside them.

    Rows that could not be placed keep their columns and get nulls; ``where`` is a filter
    on the request columns, applied before anything is looked up.
    """
    kept = requests.filter(where) if where else requests
    asked = kept.select("req_id", "calle", "altura")
    answers = attach_addresses(kept, streets) if set(asked.columns) == set(kept.columns) else _keep(kept, streets)
    failed = F.col("answer.status") != "ok"
    return answers.select(
        *[F.col(c) for c in kept.columns],
        *[F.when(~failed, F.col(f"answer.{f}")).alias(f"{prefix}{f}") for f in FIELDS],
        F.col("answer.status").alias(f"{prefix}status"),
    )


def _keep(requests: DataFrame, streets: DataFrame) -> DataFrame:
    """Answers by street text and number only; other request columns ride along."""
    others = [c for c in requests.columns if c not in ("req_id", "calle", "altura")]
    packed = requests.select("req_id", "calle", "altura", F.struct(*others).alias("_others"))
    return attach_addresses(packed, streets).select("req_id", "calle", "altura", "_others.*", "answer")


def geocode_to_geojson(
    requests: DataFrame, streets: DataFrame, path: str, where: str | None = None, prefix: str = PREFIX
) -> None:
    """Geocodes, filters, and writes the placed rows as GeoJSON features."""
    table = geocode_table(requests, streets, where, prefix)
    write_geojson(table, path, lon=f"{prefix}lon", lat=f"{prefix}lat")
