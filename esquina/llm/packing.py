"""Best-fit packing of token pieces into sequences of bounded length, by minimum bin slack.

Which lengths share a sequence depends only on how many pieces of each length there are, at most one number per
possible length. The plan is made from these counts: for one bin after another, a subset-sum table held as a
bitset finds the fullest feasible combination of the available lengths, and the combination is removed as often as
the counts allow. Pieces then take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from esquina.llm.batches import id_and_text
from esquina.llm.vocab import slices, unit_ids
from esquina.operators.stage import settle

CAPACITY = 4096
END_ID = 1
# Pieces of one length that are numbered by one task.
RANK_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, spaced: bool, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each text's ids and the end id, cut every ``capacity`` ids. Null counts as empty and gives the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = unit_ids(path, spaced)
        for b in (part for whole in batches for part in slices(whole)):
            ids, at = coder.encode(b.column("text"))
            rows: list[tuple] = []
            for doc_id, i, j in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part), part)[: 6 if with_ids else 5])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    plain = id_and_text(docs).withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each, with the largest sum up to ``room``. ``lengths`` falls; long ones go first."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, k = left - take, 2 * k
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + take
            at -= n * take
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """``(first bin, bins, [(length, how many in each bin), ...])`` until every piece has a place."""
    counts, plan, bins = dict(histogram), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        content = dict(fullest([n for n in lengths if counts[n]], counts, capacity - top))
        counts[top] += 1
        content[top] = content.get(top, 0) + 1
        times = min(counts[n] // k for n, k in content.items())
        plan.append((bins, times, sorted(content.items(), reverse=True)))
        bins += times
        for n, k in content.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, length, …``) with ``sequence_id`` and ``offset``; sequences have no gaps.

    ``pieces`` is read three times: settle it before. The driver holds one count for each length, at most
    ``capacity`` of them, and a plan of at most one entry for each length that runs out. A length that very many
    pieces share is ranked in buckets. Repeated rows get places of their own; an empty table gives an empty one.
    """
    keyed = pieces.withColumn("_key", F.xxhash64("doc_id", "piece"))
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.collect()}
    buckets = max(1, sum(histogram.values()) // RANK_ROWS)
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    per_bucket = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("_key", "doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_own", F.row_number().over(own)).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_own") - 1)

    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for first, times, content in plan_bins(histogram, capacity):
        offset = 0
        for n, k in content:
            slots.setdefault(n, []).append((used.get(n, 0), first, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
    tables = {n: np.array(s, np.int64) for n, s in slots.items()}
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            bin_, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
            for rows in np.split(order, starts[1:]):
                if len(rows):
                    n = int(length[rows[0]])
                    t = tables[n]
                    r = rank[rows]
                    k = np.searchsorted(t[:, 0], r, side="right") - 1
                    inside = r - t[k, 0]
                    bin_[rows] = t[k, 1] + inside // t[k, 2]
                    offset[rows] = t[k, 3] + inside % t[k, 2] * n
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, spaced: bool, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(settle(token_pieces(docs, path, spaced, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, path: str, spaced: bool, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and where each piece begins."""
    placed = pack(settle(token_pieces(docs, path, spaced, capacity, end_id, with_ids=True), "pieces"), capacity)
    part = F.struct("offset", "doc_id", "piece", "ids")
    gathered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return gathered.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("pieces"),
    )
