"""Token ids in shard files: a wavelet matrix per shard, documents in ascending id order.

A shard keeps one bit-plane for each bit of an id. Ids are found by position, counted and looked up from the
planes, without unpacking the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.llm.batches import id_and_text
from esquina.llm.vocab import slices, unit_ids

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
END_ID = 2
BLOCK = 512
SHARDS = "part int, shard int, start_in_part long, n_tokens long, n_docs long, payload binary"


class WaveletMatrix:
    """Bit-planes from the highest bit down; behind each plane the zeros come first, then the ones, in order."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int):
        self.planes, self.zeros, self.size = planes, zeros, size
        self.blocks = []
        for p in planes:
            per_block = np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self.blocks.append(np.concatenate([[0], np.cumsum(per_block)]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros = [], []
        # Half the bytes are moved where 16 bits hold every id; two arrays take turns.
        ids = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        other = np.empty_like(ids)
        for bit in range(depth - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones))
            low = len(ids) - int(np.count_nonzero(ones))
            zeros.append(low)
            np.compress(~ones, ids, out=other[:low])
            np.compress(ones, ids, out=other[low:])
            ids, other = other, ids
        return cls(planes, zeros, len(ids))

    def tokens(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        ids = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, (plane, low) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane, count=self.size).view(bool)
            ids[low:] |= ids.dtype.type(1 << bit)
            above = np.empty_like(ids)
            above[~ones], above[ones] = ids[:low], ids[low:]
            ids = above
        return ids.astype(np.uint32)

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones in the first ``i`` bits of a plane."""
        plane, block = self.planes[level], i // BLOCK
        total = self.blocks[level][block]
        padded = np.pad(plane, (0, BLOCK // 8 + 1))
        bytes_at = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
        inside = np.arange(BLOCK // 8) < (i % BLOCK // 8)[:, None]
        total = total + (np.bitwise_count(padded[bytes_at]) * inside).sum(1)
        rest = i % 8
        total = total + np.bitwise_count(padded[i // 8] >> (8 - rest).astype(np.uint8)) * (rest > 0)
        return total.astype(np.int64)

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return self.planes[level][i // 8] >> (7 - i % 8).astype(np.uint8) & 1

    def access(self, positions: np.ndarray) -> np.ndarray:
        i, ids = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for level, low in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            ids = ids << 1 | bit
            i = np.where(bit == 1, low + ones, i - ones)
        return ids

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        depth = len(self.planes)
        if token >> depth:
            return 0, 0
        ends = np.array([a, b], np.int64)
        for level, low in enumerate(self.zeros):
            ones = self._ones(level, ends)
            ends = low + ones if token >> (depth - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often a token stands at positions from ``a`` up to ``b``."""
        lo, hi = self._range(token, a, self.size if b is None else b)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """The positions of a token, by select on the planes from the lowest up."""
        lo, hi = self._range(token, 0, self.size)
        at, depth = np.arange(lo, hi), len(self.planes)
        for level in range(depth - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size).view(bool)
            if token >> (depth - 1 - level) & 1:
                at = np.flatnonzero(ones)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(~ones)[at]
        return at

    def to_bytes(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        known = np.array([i is not None for i in doc_ids], bool)
        docs = np.array([i or 0 for i in doc_ids], "<i8")
        body = b"".join(
            [np.packbits(known).tobytes(), docs.tobytes(), np.array(lengths, "<i8").tobytes()]
            + [np.array(self.zeros, "<i8").tobytes(), *(p.tobytes() for p in self.planes)]
        )
        head = MAGIC + struct.pack("<QIB", self.size, len(docs), len(self.planes))
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        size, n, depth = struct.unpack_from("<QIB", raw, 4)
        body = zstandard.ZstdDecompressor().decompress(raw[4 + struct.calcsize("<QIB") :])
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        known = np.unpackbits(take("u1", -(-n // 8)), count=n)
        docs, lengths, zeros = take("<i8", n), take("<i8", n), take("<i8", depth).tolist()
        planes = [take("u1", -(-size // 8)) for _ in range(depth)]
        return cls(planes, zeros, size), [d if k else None for d, k in zip(docs.tolist(), known)], lengths


def build_shards(docs: DataFrame, path: str, spaced: bool = True, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard, for ``write_shards``. Documents are whole inside a shard and ordered by id, null first.

    A null text is empty and gives the end id alone; of rows with one id all stay, in the order of their texts.
    """
    plain = id_and_text(docs).withColumn("text", F.col("text").cast("string"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = unit_ids(path, spaced), TaskContext.get().partitionId()
        shard, start, held, ids, lengths, waiting = 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            payload = WaveletMatrix.build(np.concatenate(waiting)).to_bytes(ids, lengths)
            row = [[part], [shard], [start], [held], [len(ids)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "shard", "start_in_part", "n_tokens", "n_docs", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names)

        for b in (x for whole in batches for x in slices(whole)):
            flat, at = coder.encode(b.column("text"))
            flat = np.insert(flat, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            doc_ids, first = b.column("doc_id").to_pylist(), 0
            while first < len(doc_ids):
                last = int(np.searchsorted(at, at[first] + shard_tokens - held, side="left"))
                last = min(max(last, first + 1), len(doc_ids))
                waiting.append(flat[at[first] : at[last]])
                ids += doc_ids[first:last]
                lengths += np.diff(at[first : last + 1]).tolist()
                held += int(at[last] - at[first])
                first = last
                if held >= shard_tokens:
                    yield close()
                    shard, start, held, ids, lengths, waiting = shard + 1, start + held, 0, [], [], []
        if ids:
            yield close()

    return ordered.mapInArrow(run, SHARDS)


def write_shards(docs: DataFrame, folder: str, path: str, **options) -> None:
    build_shards(docs, path, **options).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the ids of all shards before; one row for each written part is broadcast for it."""
    shards = spark.read.parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    parts = spark.createDataFrame(rows, "part int, before long")
    joined = shards.join(F.broadcast(parts), "part")
    return joined.select("part", "shard", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "payload")


def document_rows(shards: DataFrame) -> DataFrame:
    """Per document, from the shard files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload")):
                matrix, docs, lengths = WaveletMatrix.from_bytes(payload.as_py())
                ids = matrix.tokens().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Every position of a token in the whole output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload")):
                found = WaveletMatrix.from_bytes(payload.as_py())[0].occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(found + start, pa.int64())], ["position"])

    return shards.select("start", "payload").mapInArrow(run, "position long")


def counts(shards: DataFrame, token: int) -> DataFrame:
    """Per shard, how often a token occurs, by rank on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [WaveletMatrix.from_bytes(p.as_py())[0].count(token) for p in b.column("payload")]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("shard"), pa.array(found, pa.int64())], ["part", "shard", "n"])

    return shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, n long")
