"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Equal vectors of a label are one node with a multiplicity. The principal axes of all unit
vectors order the dimensions by their share of the length. Nodes are sorted along the first
axis and cut into tiles; every pair of tiles of one label whose boxes on the leading axes come close
enough is compared in a task of its own. There, products are summed over the leading dimensions first; what the
remaining dimensions can still add is bounded by the product of the suffix norms, and a
pair is given up as soon as the threshold is out of reach. Survivors are verified by the
cosine of the original vectors in double precision.

A tile pair returns link counts and a spanning forest, at most a few rows per vector, never the list of
its links. The comparison is exact, so its work is quadratic in the size of a label except
for what the boxes and bounds prune.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stage import global_places
from tidemark.llm.common import pick, written
from tidemark.llm.graph import components

THRESHOLD = 0.93
TILE = 1024
LEADING = 4  # axes of the boxes around tiles
STEPS = (8, 16, 32)  # dimensions after which pairs are given up
SLACK = 1e-9  # rounding of the rotated products; the final check has none


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a double matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow for very large components
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def comparable() -> F.Column:
    """Whether a row can link at all: a label, and a vector of finite components that are not all zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    other = F.exists(e, lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite & other, F.lit(False))


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling variance per vector length, from the second moments of all unit vectors."""

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                x = _unit(_matrix(batch.column("embedding").filter(pa.array(sizes == d))))
                total[int(d)] = total.get(int(d), 0) + x.T @ x
        for d, m in total.items():
            rows = np.repeat(np.arange(d), d)
            cols = np.tile(np.arange(d), d)
            yield pa.RecordBatch.from_pydict({"dim": np.full(d * d, d, np.int32), "i": rows.astype(np.int32), "j": cols.astype(np.int32), "m": m.reshape(-1)})

    parts = nodes.select("dim", "embedding").mapInArrow(moments, "dim int, i int, j int, m double")
    found: dict[int, np.ndarray] = {}
    for d, i, j, m in parts.groupBy("dim", "i", "j").agg(F.sum("m")).collect():  # dim * dim numbers
        found.setdefault(d, np.zeros((d, d)))[i, j] = m
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in found.items()}


def _close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold, by sums over the leading axes with suffix bounds."""
    ux, uy = _unit(x), _unit(y)
    rx, ry = ux @ axes, uy @ axes
    d = rx.shape[1]
    cuts = [c for c in STEPS if c < d] + [d]
    rest = lambda r: np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0))
    tail_x, tail_y = (np.hstack([rest(r), np.zeros((len(r), 1))]) for r in (rx, ry))
    first = cuts[0]
    sums = rx[:, :first] @ ry[:, :first].T
    a, b = np.nonzero(sums + tail_x[:, first, None] * tail_y[None, :, first] >= threshold - SLACK)
    part = sums[a, b]
    for lo, hi in zip(cuts, cuts[1:]):
        part = part + _dots(rx[:, lo:hi], ry[:, lo:hi], a, b)
        alive = part + tail_x[a, hi] * tail_y[b, hi] >= threshold - SLACK
        a, b, part = a[alive], b[alive], part[alive]
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    cosine = _dots(x, y, a, b) / (norm(x)[a] * norm(y)[b])
    wild = ~np.isfinite(cosine)  # lengths beyond the range of doubles
    cosine[wild] = _dots(ux, uy, a[wild], b[wild])
    return a[cosine >= threshold], b[cosine >= threshold]


def _dots(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 100_000) -> np.ndarray:
    out = np.empty(len(a))
    for i in range(0, len(a), step):
        out[i : i + step] = np.einsum("ij,ij->i", x[a[i : i + step]], y[b[i : i + step]])
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Only vectors of equal, known label and equal length are compared. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. Equal vectors link with each other;
    repeated rows and repeated ids stay separate rows. component_id is the smallest vec_id reachable
    (a null id is never the smallest); kept says whether it is the row's own. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = pick(vectors, "vec_id", "embedding", "label")
    good = rows.filter(comparable())
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("*", F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim")), "vector-nodes")
    axes = nodes.sparkSession.sparkContext.broadcast(principal_axes(nodes))  # dim * dim numbers per vector length

    lead = ", ".join(f"p{i} double" for i in range(LEADING))

    def rotate(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, LEADING))
            for d in np.unique(sizes):
                mine = sizes == d
                x = _unit(_matrix(batch.column("embedding").filter(pa.array(mine))))
                out[mine, : min(d, LEADING)] = (x @ axes.value[int(d)])[:, :LEADING]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "dim")), *(pa.array(out[:, i].copy()) for i in range(LEADING))],
                ["node", "label", "dim", *(f"p{i}" for i in range(LEADING))],
            )

    label_type = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "label", "dim", "embedding").mapInArrow(rotate, f"node bigint, label {label_type}, dim int, {lead}")
    placed = global_places(placed, ["label", "dim", "p0", "node"], "vector-order")
    starts = placed.groupBy("label", "dim").agg(F.min("place").alias("start"))
    tiled = placed.join(starts, ["label", "dim"]).withColumn("tile", F.floor((F.col("place") - F.col("start")) / tile)).drop("place", "start")
    tiled = written(tiled, "vector-tiles")

    boxes = tiled.groupBy("label", "dim", "tile").agg(
        F.count(F.lit(1)).alias("n"), *[f(f"p{i}").alias(f"{f.__name__}{i}") for i in range(LEADING) for f in (F.min, F.max)]
    )
    other = boxes.select("label", "dim", *[F.col(c).alias(f"o_{c}") for c in boxes.columns if c not in ("label", "dim")])
    gap = [F.greatest(F.col(f"min{i}") - F.col(f"o_max{i}"), F.col(f"o_min{i}") - F.col(f"max{i}"), F.lit(0.0)) for i in range(LEADING)]
    near = sum((g * g for g in gap), F.lit(0.0)) <= 2 - 2 * threshold + SLACK
    pairs = boxes.join(other, ["label", "dim"]).filter((F.col("tile") <= F.col("o_tile")) & near)
    sides = pairs.select(
        "label", "dim", F.col("tile").alias("left_tile"), F.col("o_tile").alias("right_tile"),
        F.explode(F.array_distinct(F.array("tile", "o_tile"))).alias("tile"),
    )
    members = tiled.select("node", "label", "dim", "tile").join(nodes.select("node", "copies", "embedding"), "node")
    dealt = members.join(sides, ["label", "dim", "tile"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("node")
        left_side = group.column("tile").to_numpy() == group.column("left_tile").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = _matrix(group.column("embedding").combine_chunks())
        basis = axes.value[x.shape[1]]
        at = np.nonzero(left_side)[0]
        to = at if left_side.all() else np.nonzero(~left_side)[0]
        a, b = _close_pairs(x[at], x[to], basis, threshold)
        a, b = at[a], to[b]
        if left_side.all():
            a, b = a[a != b], b[a != b]  # holds each link in both directions
            links = np.bincount(a, weights=copies[b], minlength=len(node))
        else:
            links = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        low = _forest(a, b, len(node))
        some = links > 0
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "low": node[low[some]]})

    partial = dealt.groupBy("label", "dim", "left_tile", "right_tile").applyInArrow(compare, "node bigint, links bigint, low bigint")
    partial = written(partial, "vector-links")
    counts = partial.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(partial, "node", "low")
    known = nodes.select("label", "embedding", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root").select(
        "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", F.col("least").alias("component_id"))
    alone = rows.filter(~comparable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
