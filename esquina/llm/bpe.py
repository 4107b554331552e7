"""Byte-level BPE: texts to ids and back, with long texts encoded in overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, on any task; its first
boundaries may be wrong, since it may begin inside a match. Where the boundaries of neighbouring chunks agree
again inside the overlap, the text is cut, and the pieces between the cuts are encoded independently. Chunks
that do not agree anywhere inside the overlap become one piece, so a match of any length stays whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from esquina.llm.batches import fields, id_and_text, map_documents

CHUNK = 32_768
OVERLAP = 512
# What the longest look beyond a match's end may see, in bytes.
LOOK = 16
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Coder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: bytes) -> list[int]:
        return self.encoding.encode_ordinary(text.decode("utf-8", "replace"))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Character offsets where matches end."""
        return [m.end() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, row_key, piece, text``: texts of more than ``chunk`` bytes in independent pieces, others whole.

    ``row_key`` keeps rows apart that share an id. A long text that repeats under one id gives its pieces once.
    A null text is an empty one.
    """
    rows = id_and_text(docs).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit(b"")).alias("text")
    )
    short = rows.filter(F.length("text") <= chunk).select("doc_id", "row_key", F.lit(0).alias("piece"), "text")
    return short.unionByName(stitched(rows.filter(F.length("text") > chunk), path, pattern, chunk, overlap))


def cut_chunks(text: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Number, body and overlap of each chunk; cuts never fall inside a character."""

    def whole(i: int) -> int:
        while i < len(text) and text[i] & 0xC0 == 0x80:
            i += 1
        return min(i, len(text))

    starts = [whole(i) for i in range(0, len(text), chunk)]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        yield k, text[a:b], text[b : whole(b + overlap)]


def edges(body: bytes, tail: bytes, overlap: int, of: Coder) -> tuple[list[int], list[int]]:
    """Boundaries of the chunk in its first bytes, and trusted ones in its overlap, counted from its end.

    The second list keeps what text beyond the overlap cannot change, and only places after a character that
    is not white space, where the pieces on both sides can be encoded apart.
    """
    text = (body + tail).decode("utf-8", "replace")
    head, rear, at, done, size = [0], [], 0, 0, len(body) + len(tail)
    for end in of.boundaries(text):
        at += len(text[done:end].encode())
        done = end
        if at <= overlap + 4:
            head.append(at)
        if len(body) <= at <= size - LOOK and not text[end - 1].isspace():
            rear.append(at - len(body))
    return head, rear


def stitched(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    key = "row_key long, chunk int"
    chunked = map_keyed(rows, f"{key}, body binary, tail binary", lambda t: cut_chunks(t, chunk, overlap))
    spread = chunked.dropDuplicates(["doc_id", "row_key", "chunk"])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path, pattern)
        for b in batches:
            found = [edges(x.as_py(), y.as_py(), overlap, of) for x, y in zip(b.column("body"), b.column("tail"))]
            sides = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *sides], [*b.schema.names, "head", "rear"])

    split = spread.mapInArrow(boundaries, f"doc_id long, {key}, body binary, tail binary, head array<int>, rear array<int>")
    text = Window.partitionBy("doc_id", "row_key").orderBy("chunk")
    agreed = F.array_min(F.array_intersect("head", F.lag("rear").over(text)))
    cut = split.withColumn("cut", F.when(F.col("chunk") == 0, 0).otherwise(agreed))
    numbered = cut.select(
        "*",
        F.lead("cut").over(text).alias("next_cut"),
        (F.count("cut").over(text) - 1).cast("int").alias("piece"),
    )
    part = F.struct("chunk", "body", "tail", "cut", "next_cut")
    gathered = numbered.groupBy("doc_id", "row_key", "piece").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    last = F.element_at("parts", -1)
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["body"]))
    extra = F.coalesce(last["next_cut"], F.lit(0))
    begin = F.element_at("parts", 1)["cut"]
    rear = F.substring(last["tail"], F.lit(1), extra)
    whole = F.concat(joined, rear)
    return gathered.select(
        "doc_id", "row_key", "piece", F.substring(whole, begin + 1, F.length(whole) - begin).alias("text")
    )


def map_keyed(rows: DataFrame, schema: str, split) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, key, text = (c[i].as_py() for c in b.columns)
                parts = [(doc_id, key, *x) for x in split(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields(schema))
    return rows.mapInArrow(run, fields(schema))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, row_key, piece, ids``: the ids of a document are those of its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path, pattern)
        for b in batches:
            ids = pa.array([of.encode(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], ["doc_id", "row_key", "piece", "ids"])

    return pieces(docs, path, pattern, chunk, overlap).mapInArrow(run, "doc_id long, row_key long, piece int, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, row_key, piece, text``: the raw bytes of each piece; they are joined in order, not as characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path, pattern)
        for b in batches:
            text = pa.array([of.decode(i.as_py()) for i in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], text], ["doc_id", "row_key", "piece", "text"])

    return encoded.mapInArrow(run, "doc_id long, row_key long, piece int, text binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: number of ids, digest of the ids as text, digest of the bytes they decode to.

    Texts of one piece are finished where they are read. Pieces of longer texts are encoded on any task; only
    their ids meet again, one text at a time. Null counts as empty, ids may be null, and repeated rows stay.
    """
    rows = id_and_text(docs).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit(b"")).alias("text")
    )
    schema = fields(DIGESTS)

    def short(i: int | None, text: bytes) -> Iterator[tuple]:
        of = coder(path, pattern)
        ids = of.encode(text)
        yield i, len(ids), sha(join_ids(ids)), sha(of.decode(ids))

    whole = map_documents(rows.filter(F.length("text") <= chunk).select("doc_id", "text"), short, schema)
    long = rows.filter(F.length("text") > chunk)
    copies = long.groupBy(F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key")).agg(F.count("*").alias("copies"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path, pattern)
        for b in batches:
            ids = [of.encode(t.as_py()) for t in b.column("text")]
            columns = [[len(i) for i in ids], [join_ids(i) for i in ids], [of.decode(i) for i in ids]]
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], [*b.schema.names[:3], "n", "ids", "raw"])

    split = stitched(long, path, pattern, chunk, overlap)
    encoded = split.repartition("doc_id", "row_key", "piece").mapInArrow(
        ids_of, "doc_id long, row_key long, piece int, n long, ids binary, raw binary"
    )

    def finish(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(group)).sort_by("piece")
        text, raw = hashlib.sha256(), hashlib.sha256()
        for k, (i, r) in enumerate(zip(t.column("ids"), t.column("raw"))):
            text.update(b"," * (k > 0) + i.as_py())
            raw.update(r.as_py())
        row = {"doc_id": key[0].as_py(), "row_key": key[1].as_py(), "n_tokens": sum(t.column("n").to_pylist())}
        row |= {"ids_sha256": text.hexdigest(), "decoded_sha256": raw.hexdigest()}
        yield pa.RecordBatch.from_pylist([row], finished)

    finished = pa.schema(
        [("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_tokens", pa.int64())]
        + [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    done = encoded.groupBy("doc_id", "row_key").applyInArrow(finish, f"doc_id long, row_key long, {DIGESTS}")
    again = done.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_key") == F.col("c_key")))
    repeated = again.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return whole.unionByName(repeated.select(*schema.names))


def join_ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
