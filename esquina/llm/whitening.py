"""Embedding whitening: components of the covariance by spectral divide and conquer.

Spark computes exact sums and the centred covariance over the distinct vectors. The polar factor of the covariance
minus a shift, found by QDWH iterations, gives the projectors onto the eigenvectors on both sides of the shift; each
invariant subspace is split again until its block has one eigenvalue. That work has the size of one matrix, dimensions
squared. The whitening matrix is broadcast with the tasks' code and applied to every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from esquina.operators.stage import settle

MOST_COMPONENTS = 16
EPS = float(np.finfo(float).eps)
# Vectors worked on at once.
BLOCK = 4096
LONG = 2**63


# --- eigenvectors of one symmetric matrix ----------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations on QR factors.

    Of a matrix without zero eigenvalues it is its matrix sign.
    """
    size = len(a)
    x = a / np.linalg.norm(a)
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = EPS
    least = min(max(least, EPS), 1.0)
    for _ in range(40):
        root = (4 * (1 - least**2) / least**4) ** (1 / 3)
        step = math.sqrt(1 + root)
        wa = step + 0.5 * math.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - least**2) / (least**2 * step)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(size)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        least = min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 10 * EPS * size and 1 - least <= 10 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; none if one is empty or not clear."""
    size = len(a)
    sign = polar_factor(a - shift * np.eye(size))
    projector = (sign + np.eye(size)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < size or np.linalg.norm(projector @ projector - projector) > 1e-6:
        return None
    # The columns of a projector with the largest remainders span its range; a second pass makes the basis exact.
    start = np.random.default_rng(rank).standard_normal((size, size))
    mixed = np.hstack([projector @ start[:, :rank], start[:, rank:] - projector @ start[:, rank:]])
    basis, _ = np.linalg.qr(mixed)
    again = np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]])
    basis, _ = np.linalg.qr(again)
    return basis[:, :rank], basis[:, rank:]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the largest entry positive) of a symmetric matrix."""
    v = (v + v.T) / 2
    scale = np.linalg.norm(v)
    values, vectors = [], []
    work = [np.eye(len(v))] if len(v) else []
    while work:
        basis = work.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        diagonal = np.diag(block)
        spread = np.linalg.norm(block - np.diag(np.full(len(block), diagonal.mean())))
        if len(block) == 1 or spread <= 4 * EPS * scale:
            values += diagonal.tolist()
            vectors += list(basis.T)
            continue
        halves = None
        # A median diagonal entry lies between the eigenvalues and halves them well; their mean is strictly between.
        reach = np.abs(block).sum(1).max()
        for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + reach * f for f in (1e-3, -1e-3, 1e-6, -1e-6, 1e-9, -1e-9))):
            halves = split(block, float(shift))
            if halves:
                break
        if halves is None:
            # One eigenvalue within what the shifts can tell apart: any basis will do.
            values += diagonal.tolist()
            vectors += list(basis.T)
            continue
        work += [basis @ half for half in halves]
    vectors = np.array(vectors).reshape(len(values), len(v))
    order = np.argsort(-np.array(values), kind="stable")
    vectors = vectors[order]
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)] if len(vectors) else np.empty(0)
    return np.array(values)[order], (vectors * np.where(largest < 0, -1.0, 1.0)[:, None]).T


# --- vectors in Arrow batches ----------------------------------------------

def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, four for each number if all of a row allow it. Equal rows give equal bytes."""
    small = (np.abs(x) < 2**31).all(1) if x.size else np.ones(len(x), bool)
    short, wide = x.astype("<i4"), x.astype("<i8")
    return pa.array([b"\4" + a.tobytes() if s else b"\10" + b.tobytes() for s, a, b in zip(small, short, wide)], pa.binary())


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    kinds = {4: "<i4", 8: "<i8"}
    rows = [np.frombuffer(r, kinds[r[0]], offset=1) for r in column.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), size)


def whole_numbers(vectors: pa.ListArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which rows have a vector of finite entries, and per length those rows' numbers ``floor(64 * c) + 1000000``.

    The result is row numbers by length and their values; a number of 2^53 or more makes the row unusable.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    found: dict[int, np.ndarray] = {}
    places = np.full(len(vectors), -1)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(64.0 * flat) + 1_000_000
            usable = (np.isfinite(flat) & (np.abs(x) < 2.0**53)).all(1)
        found[size] = np.where(usable[:, None], x, 0).astype(np.int64)[usable]
        places[rows[usable]] = size
    return places, found


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BLOCK):
        yield batch.slice(i, BLOCK)


def fit_list(rows: DataFrame, vector_col: str) -> DataFrame:
    """``size, x``: each distinct vector of whole numbers once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                for size, x in whole_numbers(b.column(0))[1].items():
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([size] * len(x), pa.int32()), packed(x)], ["size", "x"])

    return rows.select(F.col(f"`{vector_col}`")).mapInArrow(run, "size int, x binary").distinct()


def summed(table: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (a matrix of fixed shape) over blocks of vectors, one matrix a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in blocks(batch):
                one = part(unpacked(b.column("x"), size))
                total = one if total is None else total + one
        if total is not None:
            for i, row in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i)), pa.array(np.arange(len(row))), pa.array(row)], ["i", "j", "v"])

    kind = "double" if part(np.zeros((1, size), np.int64)).dtype == np.float64 else "long"
    cells = table.select("x").mapInArrow(run, f"i long, j long, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    shape = part(np.zeros((1, size), np.int64)).shape
    out = np.zeros(shape, np.float64 if kind == "double" else np.int64)
    for c in cells:
        out[c["i"], c["j"]] = c["v"]
    return out


@dataclass
class Whitening:
    """``n`` fitted vectors with ``sums``; ``matrix`` (components × dimensions) maps a centred vector to its whitened one."""

    size: int
    n: int
    sums: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> Whitening | None:
    """Fitted on all distinct vectors; none if there are none. The driver gets matrices of dimensions squared."""
    table = settle(fit_list(rows, vector_col), "fit-list")
    sizes = table.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return None
    size, n = sizes["size"], sizes["n"]
    table = table.filter(F.col("size") == size)
    high, low = summed(table, size, halves_summed).tolist()
    sums = np.array([(h << 32) + r for h, r in zip(high, low)], object)
    mean = mean_of(sums, n)

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x, mean)
        return c.T @ c

    v = summed(table, size, outer) / n
    values, vectors = eigen(v)
    held = int((values[:most] > size * EPS * max(values[0], 0)).sum()) if values[0] > 0 else 0
    matrix = (vectors[:, :held] / np.sqrt(values[:held])).T
    trace = float(np.trace(v))

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x, mean) @ matrix.T
        return np.vstack([z.T @ z, z.sum(0)])

    error = 0.0
    if held:
        m = summed(table, size, moments) / n
        error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(held)).max())
    return Whitening(size, n, sums, matrix, values[:held] / trace if trace else values[:held], error)


def halves_summed(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and of the lower 32 bits, which no number of rows that fits a table can overflow."""
    return np.vstack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])


def mean_of(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest below one, so that no digit is lost in centring."""
    whole = sums // n
    return whole.astype(np.int64), ((sums - whole * n) / n).astype(np.float64)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]).astype(np.float64) - mean[1]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S)^2``, exactly; null where no long can hold it."""
    far = n * centred(x, mean_of(sums, n))
    safe = ((far**2).sum(1) < 4e18) & (np.abs(x.astype(np.float64)).max(1) * n < 4e18)
    fits = max(map(abs, sums.tolist())) < LONG
    with np.errstate(over="ignore"):
        d = x * n - (sums if fits else 0 * sums).astype(np.int64)
        out: list[int | None] = (d * d).sum(1).tolist()
    safe &= fits
    for i in np.flatnonzero(~safe).tolist():
        exact = sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums.tolist()))
        out[i] = exact if exact < LONG else None
    return out


ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: its whitened coordinate and the figures of the fit.

    Null vectors, empty ones, and those with a null or non-finite entry, or one whose number reaches 2^53, are left out.
    Of vectors of several lengths only those of the most frequent one (of distinct vectors; ties to the shorter) take
    part. Repeated rows count once in the fit and are all returned; a null id stays null. Components without variance
    (rounding aside) have no whitened coordinate and are left out; so one distinct vector alone, or an empty table,
    gives no rows. Among equal eigenvalues any orthonormal basis is a valid result.
    """
    out = f"{id_col} long, {ROWS}"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held = 0 if model is None else len(model.matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch) if held else ():
                places, found = whole_numbers(b.column(1))
                x = found.get(model.size, np.empty((0, model.size), np.int64))
                if not len(x):
                    continue
                ids = b.column(0).take(pa.array(np.repeat(np.flatnonzero(places == model.size), held)))
                z = centred(x, mean_of(model.sums, model.n)) @ model.matrix.T
                each = np.arange(held)
                rows_ = len(x) * held
                columns = [
                    ids,
                    pa.array(np.tile(each + 1, len(x)), pa.int32()),
                    pa.array(np.full(rows_, model.n), pa.int64()),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), held))),
                    pa.array(z.ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(rows_, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{vector_col}`")).mapInArrow(run, out)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    return whiten(rows, fit(rows, vector_col, most), id_col, vector_col)
