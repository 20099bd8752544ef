"""Shares of neighbours and of similar items, added up in bounded blocks.

A neighbour's items travel as one packed row, and a task adds the rows of whole users up: no row per (user, neighbour, item)
is written or shuffled. Item similarities are dealt into tiles of the scored items, packed, and users into parts; a tile meets
every part once, and a task holds one of each. The shares of a user's neighbours alone tell what its k-th best score is at least (a floor), so
of the cells with a share of similar items only those that reach it are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.operators.neighbours import _flat

ENTRIES = 1_000_000  # (neighbour, item) entries added up at a time
PART_ENTRIES = 8_000_000  # entries of a part of users, own items and shares in a tile
USERS = 20_000  # of a part, looked at together
TILE_SIMS = 4_000_000  # similarities of a tile of items, about; a quarter where that is needed for enough tiles
PACKED = 500_000  # similarities packed at a time
SLACK = 1e-9  # of a score against a floor; scores are compared at 10 decimals
CELLS = 1_000_000  # (user, item) cells of a block
PAIRS = 1_000_000  # (used item, similar item) entries of a block
MATRIX = 1_000_000  # cells up to which a tile's similarities become a dense matrix


def _whole_users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by user in runs of about ENTRIES entries that end where a user ends."""
    held, size, limit = [], 0, ENTRIES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("items").flatten())
        if size < limit:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column("user_id").to_numpy()
        before = np.flatnonzero(ids != ids[-1])
        if not len(before):
            limit = 2 * size
            continue
        yield table.slice(0, before[-1] + 1)
        rest = table.slice(before[-1] + 1).combine_chunks()
        held, limit = rest.to_batches(), ENTRIES
        size = sum(len(b.column("items").flatten()) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _added_up(table: pa.Table, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First row of each user; (user, item, share) of its neighbours' items in order of user; (user, item) of the rows without `sim`."""
    ids, sim = table.column("user_id").to_numpy(), table.column("sim").to_numpy()
    new = np.r_[True, ids[1:] != ids[:-1]]
    starts, user = np.flatnonzero(new), np.cumsum(new) - 1
    n = len(starts)
    row, item, w = _flat(table)
    own = np.isnan(sim)
    total = np.bincount(user, np.where(own, 0.0, sim), minlength=n) + epsilon
    mine = own[row]
    row_n, w_n = row[~mine], w[~mine]
    code, names = pd.factorize(item[~mine])
    flat = user[row_n] * len(names) + code
    value = sim[row_n] * w_n
    if n * len(names) <= 8 * len(flat):
        cell = np.flatnonzero(np.bincount(flat, minlength=n * len(names)))
        sums = np.bincount(flat, value, minlength=n * len(names))[cell]
    else:
        cell, where = np.unique(flat, return_inverse=True)
        sums = np.bincount(where, value, minlength=len(cell))
    u, c = np.divmod(cell, max(len(names), 1))
    return starts, u, np.asarray(names)[c], sums / total[u], user[row[mine]], item[mine], n


def _by_user(near: DataFrame, vectors: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(user_id, sim, items, ws): the packed items of each neighbour, and of the user itself without `sim`; sorted by user."""
    other = vectors.select(F.col("user_id").alias("other_id"), "items", "ws")
    rows = near.select("user_id", "other_id", "sim").join(other, "other_id").select("user_id", "sim", "items", "ws")
    if own is not None:
        rows = rows.unionByName(own.select("user_id", F.lit(None).cast("double").alias("sim"), "items", "ws"))
    return skew.spread(rows, "user_id").sortWithinPartitions("user_id")


def neighbour_shares(near: DataFrame, vectors: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(user_id, item_id, score): sum of sim x weight over the neighbours, divided by the sum of their similarities."""
    user, item = vectors.schema["user_id"].dataType.simpleString(), vectors.schema["items"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_users(batches):
            starts, u, items, score, *_ = _added_up(table, epsilon)
            ids = table.column("user_id").combine_chunks().take(pa.array(starts[u]))
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, vector_type(table)), pa.array(score)], ["user_id", "item_id", "score"])

    return _by_user(near, vectors).mapInArrow(run, f"user_id {user}, item_id {item}, score double")


def vector_type(table: pa.Table) -> pa.DataType:
    return table.schema.field("items").type.value_type


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _floors(u: np.ndarray, share: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Per user what the k-th largest share of an item it does not have is at least: the (k + held)-th of all, 0 if there are fewer."""
    order = np.lexsort((-share, u))
    ends = np.searchsorted(u, np.arange(len(held) + 1))  # users are in order
    at = ends[:-1] + held + k - 1
    there = at < ends[1:]
    out = np.zeros(len(held))
    out[there] = share[order[at[there]]]
    return out


def _people(near: DataFrame, vectors: DataFrame, own: DataFrame, tiles: int, epsilon: float, k: int) -> DataFrame:
    """(user_id, tile, own, items, shares, floor) per user and tile of items, items as places; `own` and `floor` are the same in each tile."""
    user = vectors.schema["user_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_users(batches):
            starts, u, items, share, own_u, own_items, n = _added_up(table, epsilon)
            ids = table.column("user_id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            key = u * tiles + items % tiles if len(u) else np.zeros(0, np.int64)
            order = np.argsort(key, kind="stable")
            ends = np.searchsorted(key[order], np.arange(n * tiles + 1))
            own_ends = np.searchsorted(own_u, np.arange(n + 1))
            held = _lists(own_ends, own_items, pa.int32())
            floor = _floors(u, share, np.diff(own_ends), k)
            every = np.repeat(np.arange(n), tiles)
            step = max(1, ENTRIES // max(1, -(-len(own_items) // n)))
            found, shares = items[order], share[order]
            for lo in range(0, n * tiles, step):  # a user's own items are repeated in every tile
                up = min(lo + step, n * tiles)
                cut = slice(ends[lo], ends[up])
                some = every[lo:up]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(starts[some])),
                        pa.array(np.arange(lo, up) % tiles, pa.int32()),
                        held.take(pa.array(some)),
                        _lists(ends[lo : up + 1] - ends[lo], found[cut], pa.int32()),
                        _lists(ends[lo : up + 1] - ends[lo], shares[cut], pa.float64()),
                        pa.array(floor[some]),
                    ],
                    ["user_id", "tile", "own", "items", "shares", "floor"],
                )

    return _by_user(near, vectors, own).mapInArrow(run, f"user_id {user}, tile int, own array<int>, items array<int>, shares array<double>, floor double")


def _packed(sims: DataFrame, tiles: int) -> DataFrame:
    """(tile, a, b, v): both directions of similarities (a, b, sim) as lists, one row for each tile of b and run of rows."""

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, v = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in batches]) for c in ("a", "b", "sim"))
        a, b, v = np.r_[a, b], np.r_[b, a], np.r_[v, v]
        tile = (b % tiles).astype(np.int32)
        order = np.argsort(tile, kind="stable")
        found, first = np.unique(tile[order], return_index=True)
        ends = np.r_[first, len(order)]
        lists = [_lists(ends, x[order], kind) for x, kind in ((a, pa.int32()), (b, pa.int32()), (v, pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *lists], ["tile", "a", "b", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return sims.mapInArrow(run, "tile int, a array<int>, b array<int>, v array<double>")


def _unpacked(rows: pa.Table) -> pa.Table:
    """Rows (a, b, v, item_id) out of lists; entries of similarities have no item_id."""
    lists = {c: rows.column(c).combine_chunks().flatten() for c in ("a", "b", "v")}
    ids = rows.column("item_id").combine_chunks()
    at = np.repeat(np.arange(rows.num_rows), rows.column("a").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    return pa.table({**lists, "item_id": ids.take(pa.array(at))})


class _Tile:
    """Items of a tile in order of their ids, and the similarities of all items to them."""

    def __init__(self, rows: pa.Table):
        a, b, v = (rows.column(c).to_numpy() for c in ("a", "b", "v"))
        listed = a < 0
        ids = rows.column("item_id").combine_chunks().filter(pa.array(listed))
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        self.ids = ids.take(pa.array(order))
        self.place, self.popularity = b[listed][order], v[listed][order]
        self.width = len(self.place)
        self.by_place = np.argsort(self.place)
        self.places = self.place[self.by_place]
        sort = np.argsort(a[~listed], kind="stable")
        left = a[~listed][sort]
        self.column, self.sim = self.columns(b[~listed][sort])[0], v[~listed][sort]
        self.used, first = np.unique(left, return_index=True)
        self.ends = np.r_[first, len(left)].astype(np.int64)
        self.matrix = None
        if len(self.used) * self.width <= MATRIX:
            self.matrix = np.zeros((len(self.used), self.width))
            self.matrix[np.repeat(np.arange(len(self.used)), np.diff(self.ends)), self.column] = self.sim

    def columns(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column of each place, and which of them are in the tile."""
        at = np.minimum(np.searchsorted(self.places, places), self.width - 1)
        return self.by_place[at], self.places[at] == places

    def related(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """Sums of similarities to the used items `at` of each row."""
        if self.matrix is not None:
            x = np.zeros((rows, len(self.used)))
            x[row, at] = 1.0
            return x @ self.matrix
        span = self.ends[at + 1] - self.ends[at]
        place = np.repeat(self.ends[at] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        flat = np.repeat(row * self.width, span) + self.column[place]
        return np.bincount(flat, self.sim[place], minlength=rows * self.width).reshape(rows, self.width)


def _list_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    # Ends of the lists (from 0) and their values.
    lists = table.column(name).combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.r_[0, np.cumsum(sizes)], lists.flatten().to_numpy(zero_copy_only=False)


def _best_cells(people: pa.Table, tile: _Tile, weights: Mapping[str, float], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, column, user_cf, item_cf) of the unseen cells with a share that are among the best k of the tile and reach the user's floor, or have an early place.

    Without a column `floor`, what the user's k-th best score is at least, every cell may.
    """
    (own_ends, own), (ends, items), shares = _list_of(people, "own"), _list_of(people, "items"), _list_of(people, "shares")[1]
    floor = people.column("floor").to_numpy() if "floor" in people.column_names else np.full(people.num_rows, -np.inf)
    held = np.diff(own_ends)
    own_row = np.repeat(np.arange(people.num_rows), held)
    at = np.minimum(np.searchsorted(tile.used, own), max(len(tile.used) - 1, 0))
    known = tile.used[at] == own if len(tile.used) else np.zeros(len(own), bool)
    span = np.zeros(len(own), np.int64)
    span[known] = (tile.ends[at + 1] - tile.ends[at])[known] if len(tile.used) else 0
    done = np.r_[0, np.cumsum(span)][own_ends]
    most = float((weights["popularity"] * tile.popularity).max(initial=0.0))
    lo = 0
    while lo < people.num_rows:
        up = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, side="right")) - 1)
        up = min(up, lo + max(1, CELLS // tile.width), people.num_rows)
        cut = slice(own_ends[lo], own_ends[up])
        row, mine = own_row[cut] - lo, known[cut]
        number = np.maximum(held[lo:up], 1)
        related = tile.related(row[mine], at[cut][mine], up - lo)
        column, here = tile.columns(own[cut])
        related[row[here], column[here]] = 0.0
        near = slice(ends[lo], ends[up])
        near_row, near_column = np.repeat(np.arange(up - lo), np.diff(ends[lo : up + 1])), tile.columns(items[near])[0]
        seen = np.isin(near_row * tile.width + near_column, row[here] * tile.width + column[here])
        near_cell, share = (near_row * tile.width + near_column)[~seen], shares[near][~seen]
        # Cells without a share of neighbours have to reach the floor by similar items and popularity alone.
        if weights["item_cf"] > 0 and np.isfinite(floor[lo:up]).all():  # then nothing is negative
            need = (floor[lo:up] - SLACK - most) * number / weights["item_cf"] * (1 - 1e-9)
            found = related >= np.maximum(need, 1e-300)[:, None]
        else:
            found = related != 0
        cell = [np.flatnonzero(found), near_cell]
        early = np.flatnonzero(tile.place <= k + held[lo:up].max(initial=0))
        if len(early):
            r, c = (x.ravel() for x in np.meshgrid(np.arange(up - lo), early, indexing="ij"))
            cell.append((r * tile.width + c)[(related[r, c] != 0) & (tile.place[c] <= k + held[lo + r])])
        cell = np.unique(np.concatenate(cell))
        r, c = np.divmod(cell, tile.width)
        item_cf, user_cf = related[r, c] / number[r], np.zeros(len(cell))
        user_cf[np.searchsorted(cell, near_cell)] = share
        score = weights["user_cf"] * user_cf + weights["item_cf"] * item_cf + weights["popularity"] * tile.popularity[c]
        early = tile.place[c] <= k + held[lo + r]
        keep = ((user_cf != 0) | (item_cf != 0)) & (early | (score >= floor[lo + r] - SLACK))
        r, c, user_cf, item_cf, score, early = (x[keep] for x in (r, c, user_cf, item_cf, score, early))
        order = np.lexsort((c, -np.round(score, 10), r))  # columns are in order of ids
        first = np.searchsorted(r, np.arange(up - lo))
        place = np.empty(len(r), np.int64)
        place[order] = np.arange(len(r)) - first[r[order]]
        top = np.flatnonzero((place < k) | early)
        yield lo + r[top], c[top], user_cf[top], item_cf[top]
        lo = up


def best_shares(
    near: DataFrame, vectors: DataFrame, own: DataFrame, sims: DataFrame, places: DataFrame, weights: Mapping[str, float], k: int, epsilon: float = 1e-10
) -> DataFrame:
    """(user_id, item_id, user_cf, item_cf) of the users in `own`: unseen items with a share that can be among a user's best k.

    user_cf is a share of the neighbours' weights, item_cf of the similarities of the user's items. `vectors` and `own` hold places for
    items; `places` is (item_id, popularity, place), `sims` is (a, b, sim) by place, one direction of each pair. Of every tile of items a user keeps the best k by
    the weighted sum with the popularity (ties by id) that can be among its best k at all, and all of the first k + (own items) places.
    """
    (pairs, least), (entries, users) = sims.agg(F.count(F.lit(1)), F.min("sim")).first(), vectors.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)), F.count(F.lit(1))).first()
    n_sims = 2 * pairs
    around = -(-near.count() // max(users, 1))
    width = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-n_sims // TILE_SIMS), min(-(-4 * n_sims // TILE_SIMS), width))
    parts = max(1, -(-entries * (tiles + around) // (tiles * PART_ENTRIES)), min(-(-width // tiles), TILE_SIMS // max(n_sims, 1)))
    people = _people(near, vectors, own, tiles, epsilon, k)
    # Shares of neighbours are a floor only where nothing is negative.
    bounded = min(weights.values()) >= 0 and (least is None or least >= 0)
    people = people.withColumn("floor", F.col("floor") * weights["user_cf"] if bounded else F.lit(float("-inf"))).withColumn("part", F.pmod(F.xxhash64("user_id", F.lit(7)), F.lit(parts)).cast("int"))
    item = places.schema["item_id"].dataType.simpleString()
    place = F.col("place").cast("int")
    listed = places.select(F.pmod(place, F.lit(tiles)).cast("int").alias("tile"), F.array(F.lit(-1)).alias("a"), F.array(place).alias("b"), F.array("popularity").alias("v"), "item_id")
    cells = _packed(sims, tiles).withColumn("item_id", F.lit(None).cast(item)).unionByName(listed)
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    user = vectors.schema["user_id"].dataType.simpleString()
    wanted = dict(weights)

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kinds = [mine.schema.field("user_id").type, theirs.schema.field("item_id").type, pa.float64(), pa.float64()]
        out = pa.schema(list(zip(["user_id", "item_id", "user_cf", "item_cf"], kinds)))
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        tile, ids = _Tile(_unpacked(theirs)), mine.column("user_id").combine_chunks()
        made = [
            pa.RecordBatch.from_arrays([ids.take(pa.array(lo + r)), tile.ids.take(pa.array(c)), pa.array(x), pa.array(y)], schema=out)
            for lo in range(0, mine.num_rows, USERS)
            for r, c, x, y in _best_cells(mine.slice(lo, USERS), tile, wanted, k)
        ]
        return pa.Table.from_batches(made, out)

    left, right = (skew.spread(df, "tile", "part").groupBy("tile", "part") for df in (people, cells))
    return left.cogroup(right).applyInArrow(meet, f"user_id {user}, item_id {item}, user_cf double, item_cf double")
