"""Documents handed to Python in Arrow batches, as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

Row = tuple
# What this Python worker keeps from one task to the next, under its name: one thing at most.
KEPT: dict = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """What ``make`` gave when ``name`` was last asked for in this worker, or gives now."""
    if name not in KEPT:
        drop_kept()
        KEPT[name] = make()
    return KEPT[name]


def drop_kept() -> None:
    """For tasks of another kind in a reused worker: what earlier ones kept goes, and Arrow gives back unused memory."""
    if KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; all others stay behind, whatever their names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def map_documents(docs: DataFrame, fn: Callable[[int | None, bytes | None], Iterator[Row]], schema: StructType) -> DataFrame:
    """``fn(doc_id, text)`` for every row of a table with the columns of ``id_and_text``; it yields rows of ``schema``."""
    arrow = to_arrow_schema(schema)
    step = 2000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[Row] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i, doc_id in enumerate(ids):
                rows += fn(doc_id, texts[i].as_py())
                if len(rows) >= step:
                    yield table(rows, arrow)
                    rows = []
        if rows:
            yield table(rows, arrow)

    return docs.mapInArrow(run, schema)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one, here and in the JVM that reads it, stays small."""
    drop_kept()
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


def table(rows: list[Row], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def fields(text: str) -> StructType:
    """A schema from ``name type, ...`` text, with ``doc_id long`` first."""
    rest = StructType.fromDDL(text) if text else StructType()
    return StructType([StructField("doc_id", LongType()), *rest.fields])
