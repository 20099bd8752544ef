"""Greedy re-rankers over each user's candidate list.

Candidates are packed into one row per user and re-ordered in Arrow batches. The whole list is
ordered unless the caller asks for a limit; callers with long lists cut them first (`scoring.top_k`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew

USERS = 500  # lists ordered at a time


def pack(cands: DataFrame, *columns: str) -> DataFrame:
    """One row per user: an array of (item_id, score, *columns) by score desc, item asc."""
    entry = F.struct((-F.round("score", 10)).alias("o"), "item_id", "score", *columns)
    return skew.spread(cands, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))


def with_pair_sims(cands: DataFrame, sims: DataFrame) -> DataFrame:
    """Adds to every candidate its similarities to the user's other candidates (0 if unknown).

    `sims` has both directions (item_a, item_b, sim); one is joined and stands for both. The join
    is on user and stays within lists that were cut to a fixed length.
    """
    other = cands.select("user_id", F.col("item_id").alias("item_b"))
    pairs = cands.select("user_id", F.col("item_id").alias("item_a")).join(other, "user_id").filter("item_a <= item_b")
    met = pairs.join(sims.select("item_a", "item_b", "sim").filter("item_a <= item_b"), ["item_a", "item_b"])
    ways = F.when(F.col("item_a") == F.col("item_b"), F.array(F.struct("item_a", "item_b"))).otherwise(
        F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    )
    known = met.select("user_id", "sim", F.explode(ways).alias("p")).select("user_id", "p.item_a", "p.item_b", "sim")
    maps = known.groupBy("user_id", F.col("item_a").alias("item_id")).agg(
        F.array_sort(F.collect_list(F.struct("item_b", "sim"))).alias("sims")
    )
    return cands.join(maps, ["user_id", "item_id"], "left")


def _map_matrix(entries: list) -> np.ndarray:
    ids = [e["item_id"] for e in entries]
    maps = [{p["item_b"]: p["sim"] for p in e["sims"]} if e["sims"] is not None else {} for e in entries]
    return np.array([[m.get(j, 0.0) for j in ids] for m in maps])


def _vector_matrix(entries: list) -> np.ndarray:
    """Cosine of the embeddings over the shorter prefix, else 1 for equal categories."""
    n = len(entries)
    cats = np.array([e["category"] or "" for e in entries], dtype=object)
    out = ((cats[:, None] == cats[None, :]) & (cats[:, None] != "")).astype(float)
    have = [i for i in range(n) if e_len(entries[i]["embedding"])]
    if have:
        size = min(len(entries[i]["embedding"]) for i in have)
        vec = np.array([np.asarray(entries[i]["embedding"][:size], dtype=float) for i in have])
        norm = np.linalg.norm(vec, axis=1)
        ok = [h for h, m in zip(have, norm) if m > 0]
        unit = vec[norm > 0] / norm[norm > 0][:, None]
        out[np.ix_(ok, ok)] = unit @ unit.T
    return out


def e_len(v) -> int:
    return 0 if v is None else len(v)


def _greedy(score: np.ndarray, sim: np.ndarray, value: Callable[[np.ndarray, np.ndarray, int], np.ndarray], limit: int) -> list[int]:
    """Picks the first candidate, then repeatedly the one of the highest value."""
    chosen, left = [0], np.ones(len(score), dtype=bool)
    left[0] = False
    worst, total = sim[:, 0].copy(), sim[:, 0].copy()
    while left.any() and len(chosen) < limit:
        gain = np.where(left, np.round(value(worst, total, len(chosen)), 10), -np.inf)
        nxt = int(np.argmax(gain))
        chosen.append(nxt)
        left[nxt] = False
        worst, total = np.maximum(worst, sim[:, nxt]), total + sim[:, nxt]
    return chosen


def _category_gap(entries: list, gap: int, limit: int) -> list[int]:
    """Skips a candidate whose category was placed fewer than `gap` places ago; skipped ones fill up the end."""
    chosen, last = [], {}
    for i, e in enumerate(entries):
        if len(chosen) >= limit:
            break
        cat = e["category"]
        if cat in last and len(chosen) - last[cat] < gap:
            continue
        last[cat] = len(chosen)
        chosen.append(i)
    rest = [i for i in range(len(entries)) if i not in set(chosen)]
    return chosen + rest[: max(0, limit - len(chosen))]


def rerank(packed: DataFrame, method: str, limit: int | None = None, lam: float = 0.5, gap: int = 2) -> DataFrame:
    """(user_id, item_id, score, place) with the original scores in greedy order.

    method "mmr": lam * score - (1 - lam) * max similarity, by embedding or category;
    "mmr_signed": the same with negative similarities mapped to [0, 1];
    "mean_gap": lam * score + (1 - lam) * (1 - mean similarity), pair similarities given,
    lists of three or fewer stay as they are; "category_gap": category spacing.
    """
    lam = min(1.0, max(0.0, lam))
    user_type = packed.schema["user_id"].dataType.simpleString()
    item_type = packed.schema["c"].dataType.elementType["item_id"].dataType.simpleString()

    def order(entries: list) -> list[int]:
        n = len(entries) if limit is None else min(len(entries), limit)
        if method == "category_gap":
            return _category_gap(entries, gap, n)
        score = np.array([e["score"] for e in entries])
        if method == "mean_gap":
            if len(entries) <= 3:
                return list(range(len(entries)))[:n]
            return _greedy(score, _map_matrix(entries), lambda worst, total, k: lam * score + (1 - lam) * (1 - total / k), n)
        sim = _vector_matrix(entries)
        if method == "mmr":
            sim = np.maximum(sim, 0.0)
            return _greedy(score, sim, lambda worst, total, k: lam * score - (1 - lam) * worst, n)
        shift = lambda x: np.where(x < 0, (x + 1) / 2, x)
        return _greedy(score, sim, lambda worst, total, k: lam * score - (1 - lam) * shift(worst), n)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, USERS):  # the entries of a list are Python objects
                some = batch.select(["user_id", "c"]).slice(at, USERS)
                user, item, score, place = [], [], [], []
                for row, entries in enumerate(some.to_pandas()["c"]):
                    entries = list(entries)
                    chosen = order(entries)
                    user += [row] * len(chosen)
                    item += [entries[i]["item_id"] for i in chosen]
                    score += [entries[i]["score"] for i in chosen]
                    place += range(1, len(chosen) + 1)
                kind = some.schema.field("c").type.value_type.field("item_id").type
                columns = [some.column("user_id").take(pa.array(user, pa.int64())), pa.array(item, kind), pa.array(score, pa.float64()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["user_id", "item_id", "score", "place"])

    return packed.mapInArrow(task, f"user_id {user_type}, item_id {item_type}, score double, place int")
