"""Embedding whitening with exact second moments by bit slices.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. Less its dimension's minimum an x has a few bits; the bits of one
place in one dimension, over the rows of a block, are a plane that is packed into 64-bit words. The popcount of two
planes' AND, weighted by both places, is their part of the sum of products of two dimensions. Blocks leave a task as
whole numbers per pair of dimensions; Spark adds them up. With the exact sums of all rows the scatter matrix is centred in whole
numbers, n * sum(x y) - sum(x) * sum(y), and only then becomes double for the eigenvectors.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, pick, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 16_384  # rows whose planes are held at a time
LIMB = 40  # bits
WIDEST = 2.0**61  # entries whose scaled value is beyond it have no whole number of 64 bits


def usable(column: str = "embedding"):
    """Vectors with at least one entry, none of them null, NaN, infinite or beyond 64 bits once scaled."""
    c = F.col(column)
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < WIDEST))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & sound, F.lit(False))


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _sums(dims: int):
    # Two halves keep the sum of a batch within 64 bits whatever the entries are.
    def run(batch):
        x = _whole(batch.column("embedding"), dims)
        low, high = x & 0xFFFFFFFF, x >> 32
        names = ["d", "n", "least", "most", "low", "high"]
        cols = [np.arange(dims), np.full(dims, len(x)), x.min(axis=0), x.max(axis=0), low.sum(axis=0), high.sum(axis=0)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes of non-negative y (rows x dims): dimension and place of every plane that is not all zero, and its words."""
    rows = -(-len(y) // 64) * 64
    dims, places, words = [], [], []
    for d in range(y.shape[1]):
        for b in range(int(bits[d])):
            plane = np.zeros(rows, np.uint8)
            plane[: len(y)] = (y[:, d] >> b) & 1
            if plane.any():
                dims.append(d)
                places.append(b)
                words.append(np.packbits(plane, bitorder="little").view(np.uint64))
    return np.array(dims, np.int64), np.array(places, np.int64), np.array(words, np.uint64).reshape(len(words), rows // 64)


def cross_products(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Upper triangle of the sums of products of the columns of non-negative y, exact, from popcounts of their planes' ANDs."""
    dims, places, words = planes(y, bits)
    weights, width = 2 * int(bits.max(initial=1)), y.shape[1]
    found = np.zeros(width * width * weights, np.int64)
    for p in range(len(dims)):
        counts = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        # A pair of two places of one dimension stands for both of its orders.
        counts = np.where((dims[p:] == dims[p]) & (places[p:] != places[p]), 2 * counts, counts)
        np.add.at(found, (dims[p] * width + dims[p:]) * weights + places[p] + places[p:], counts)
    kind = np.int64 if weights + len(y).bit_length() < 63 else object
    powers = np.array([1 << s for s in range(weights)], kind)
    return found.reshape(width, width, weights).astype(kind) @ powers


def _scatter(dims: int, least: np.ndarray, bits: np.ndarray):
    def run(batches):
        total = np.zeros((dims, dims), object)
        held: list[np.ndarray] = []

        def add():
            y = np.concatenate(held)
            held.clear()
            for at in range(0, len(y), BLOCK):
                np.add(total, cross_products(y[at : at + BLOCK], bits).astype(object), out=total)

        for batch in batches:
            if batch.num_rows:
                held.append(_whole(batch.column("embedding"), dims) - least)
                if sum(map(len, held)) >= BLOCK:
                    add()
        if held:
            add()
        # Whole numbers of any length leave the task in limbs.
        cells = []
        for i in range(dims):
            for j in range(i, dims):
                rest, limb = int(total[i, j]), 0
                while rest:
                    cells.append((i, j, limb, rest & (1 << LIMB) - 1))
                    rest, limb = rest >> LIMB, limb + 1
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells)], ["i", "j", "limb", "part"])

    return run


class Fit:
    """n, the exact sums and centred scatter matrix (whole numbers) of all rows, and the components."""

    def __init__(self, dims: int, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int):
        self.dims, self.n, self.sums = dims, n, sums
        self.scatter = [[n * products[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
        # Division of whole numbers rounds once.
        v = np.array([[cell / (n * n) for cell in row] for row in self.scatter], np.float64)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = sum(self.scatter[d][d] for d in range(dims)) / (n * n)
        # What rounding leaves of a direction without any spread is not a component.
        floor = self.trace * dims * np.finfo(np.float64).eps
        self.order = [int(k) for k in order if values[k] > floor]
        self.values = values[self.order]
        self.vectors = vectors[:, self.order]
        self.explained = [float(e) / self.trace for e in self.values]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, DataFrame]:
    """The fit over all usable vectors of the prevailing length, and those rows (vec_id, embedding); no fit without rows.

    Vectors of another length than the most frequent one (ties: the longest) are left out like unusable ones.
    """
    rows = pick(vectors, "vec_id", "embedding").filter(usable())
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    if first is None:
        return None, rows
    dims = first["dims"]
    rows = rows.filter(F.size("embedding") == dims)
    parts = per_batch(rows, _sums(dims), "d bigint, n bigint, least bigint, most bigint, low bigint, high bigint")
    wide = "decimal(38,0)"
    exact = F.sum(F.col("low").cast(wide)) + F.sum(F.col("high").cast(wide)) * F.lit(2**32).cast("decimal(20,0)")
    moments = parts.groupBy("d").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), exact.alias("s"))
    moments = sorted(moments.collect())  # one row per dimension
    least = np.array([m["least"] for m in moments], np.int64)
    bits = np.array([int(m["most"] - m["least"]).bit_length() for m in moments], np.int64)
    parts = rows.mapInArrow(_scatter(dims, least, bits), "i bigint, j bigint, limb bigint, part bigint")
    n, products = moments[0]["n"], {(i, j): 0 for i in range(dims) for j in range(i, dims)}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect():  # dims x dims, some limbs each
        products[r["i"], r["j"]] += r["part"] << LIMB * r["limb"]
    sums = [int(m["s"]) for m in moments]
    for (i, j), shifted in products.items():  # back from y = x - least to x
        a, b = int(least[i]), int(least[j])
        products[i, j] = shifted + a * (sums[j] - n * b) + b * (sums[i] - n * a) + n * a * b
    return Fit(dims, n, sums, products, components), rows


def _projected(found: Fit):
    n, sums, dims = found.n, found.sums, found.dims
    matrix = found.vectors / np.sqrt(found.values)

    def run(batch):
        x = _whole(batch.column("embedding"), dims)
        most = max(max(abs(n * int(x[:, d].min()) - sums[d]), abs(n * int(x[:, d].max()) - sums[d])) for d in range(dims))
        if dims * most * most < 2**63 and max(map(abs, sums)) < 2**63:
            apart = n * x - np.array(sums, np.int64)
            deviation = (apart * apart).sum(axis=1).tolist()
        else:
            apart = n * x.astype(object) - np.array(sums, object)
            deviation = (apart * apart).sum(axis=1).tolist()
        white = (apart / n).astype(np.float64) @ matrix
        number = pa.decimal128(38, 0)
        squares = pa.array([decimal.Decimal(v) if v < 10**38 else None for v in deviation], number)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), squares, values], ["vec_id", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """(vec_id, deviation, whitened) per usable row, a written table, and the fit.

    deviation: exact sum over dimensions of (n x - S) squared, decimal(38, 0), null from 10^38 on. whitened: array with the row's value on each
    component that has any spread, by falling eigenvalue. Null, empty and unusable vectors are dropped; repeated rows
    and ids, and null ids, stay and count as often as they occur. Equal vectors throughout have no component, and without rows there is no fit;
    both give no rows. Other columns are ignored.
    """
    found, rows = fit(vectors, components)
    shape = "vec_id bigint, deviation decimal(38,0), whitened array<double>"
    if found is None or not found.order:
        return rows.limit(0).selectExpr("vec_id", "cast(0 as decimal(38,0)) as deviation", "array(cast(0 as double)) as whitened"), found
    return written(per_batch(rows, _projected(found), shape), "whitened"), found


def identity_error(table: DataFrame, width: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of the whitened values minus the identity."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    cells = [F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    row = table.agg(*cells).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def long_form(table: DataFrame, found: Fit | None) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    width = len(found.order) if found else 0
    error = identity_error(table, width) if width else 0.0
    shares = F.array(*[F.lit(e) for e in found.explained]) if width else F.array(F.lit(0.0))
    rows = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n if found else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
