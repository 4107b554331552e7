"""Geocoding of request streams against stored tables.

Each micro-batch runs the batch job, since choosing the best of several rows per request
needs ranking, which a streaming plan does not allow. Every batch is written to a folder
of its own and overwritten when it is repeated after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from esquina.operators.address import geocode_addresses
from esquina.operators.crossing import geocode_intersections
from esquina.operators.names import StreetIndex


def _start(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        # The job reads the batch more than once.
        batch.persist()
        try:
            answer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_addresses(
    stream: DataFrame, streets: Callable[[], DataFrame | StreetIndex], out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """``streets`` is called for every batch, so a reload of the table is picked up.

    With a stored index (``plans.load.stored_street_index``) a batch builds no look-ups of its own.
    """
    return _start(stream, lambda b: geocode_addresses(b, streets()), out, checkpoint, once)


def stream_crossings(
    stream: DataFrame,
    streets: Callable[[], DataFrame | StreetIndex],
    intersections: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    return _start(stream, lambda b: geocode_intersections(b, streets(), intersections()), out, checkpoint, once)
