"""Items used near each other in time by the same user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.operators.cf import PAIR_BUDGET, RUN_ROWS

HOT_CHUNKS = 16


def _follow(us: np.ndarray, code: np.ndarray, home: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code_a * n + code_b, count) over home events and the later events within `width`.

    Rows are in time order. When windows are short, followers are listed in bounded runs and
    counted; else running counts per item turn each window into a difference of two rows.
    """
    upto = np.searchsorted(us, us + width, side="right")
    span = np.where(home, upto - np.arange(len(us)) - 1, 0)
    if span.sum() <= len(us) * n:
        return _listed(code, span, n)
    return _running(code, upto, home, n)


def _listed(code: np.ndarray, span: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    done = np.r_[0, np.cumsum(span)]
    keys, counts, at = [], [], 0
    while at < len(code):
        end = max(at + 1, int(np.searchsorted(done, done[at] + PAIR_BUDGET, side="right")) - 1)
        part = span[at:end]
        left = np.repeat(np.arange(at, end), part)
        right = left + 1 + np.arange(len(left)) - np.repeat(done[at:end] - done[at], part)
        k, c = np.unique(code[left] * n + code[right], return_counts=True)
        keys.append(k)
        counts.append(c)
        at = end
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(keys, return_inverse=True)
    return k, np.bincount(where, counts, minlength=len(k)).astype("int64")


def _running(code: np.ndarray, upto: np.ndarray, home: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((n, n))
    picked = np.flatnonzero(home)
    step = max(1, PAIR_BUDGET // n)
    for first in range(0, len(code), step):
        block = code[first : first + step]
        run = np.zeros((len(block) + 1, n))
        run[np.arange(1, len(block) + 1), block] = 1
        run = np.cumsum(run, axis=0)
        near = picked[(picked + 1 < first + len(block)) & (upto[picked] > first)]
        for some in np.array_split(near, max(1, len(near) // step)):
            lo, hi = (np.clip(x - first, 0, len(block)) for x in (some + 1, upto[some]))
            np.add.at(total, code[some], run[hi] - run[lo])
    keys = np.flatnonzero(total)
    return keys, total.ravel()[keys].astype("int64")


def _pairs(rows: pd.DataFrame, us: np.ndarray, width: int) -> pd.DataFrame:
    items, code = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    home = rows["home"].to_numpy() if "home" in rows else np.ones(len(rows), dtype=bool)
    keys, n = _follow(us, code.astype(np.int64), home, width, len(items))
    a, b = keys // len(items), keys % len(items)
    out = pd.DataFrame({"item_a": items[a], "item_b": items[b], "n": n})
    return out[a != b]


def item_cooccurrence(events: DataFrame, window_hours: int = 24, min_hot_rows: int | None = None) -> DataFrame:
    """(item_a, item_b, n, score): events of b within the window around each event of a, by the
    same user, summed over users; score is n over the largest n of item a.

    Counting only later events and adding both directions gives the symmetric count. A task
    takes runs of users in (user, time) order and returns summed counts per item pair. Hot
    users go through `_hot_counts`.
    """
    width = window_hours * 3_600_000_000
    item_type = events.schema["item_id"].dataType.simpleString()
    schema = f"item_a {item_type}, item_b {item_type}, n long"
    known = events.filter(F.col("item_id").isNotNull()).select("user_id", "item_id", F.unix_micros("event_time").alias("us"))
    hot = skew.hot_keys(known.select("user_id"), ["user_id"], min_hot_rows)
    usual = known if hot is None else known.join(F.broadcast(hot), "user_id", "left_anti")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Users follow each other on one time line, further apart than the window.
        _, user = np.unique(rows["user_id"].to_numpy(), return_inverse=True)
        us = rows["us"].to_numpy()
        line = (us - us.min()) + user * (us.max() - us.min() + width + 1)
        order = np.argsort(line, kind="stable")
        return _pairs(rows.iloc[order], line[order], width)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if size >= RUN_ROWS:
                same = batch["user_id"] == held[-1]["user_id"].iloc[-1]
                held.append(batch[same])
                batch = batch[~same]
                if len(batch):
                    yield run(pd.concat(held))
                    held, size = [], 0
            held.append(batch)
            size += len(batch)
        if size:
            yield run(pd.concat(held))

    forward = skew.spread(usual, "user_id").sortWithinPartitions("user_id").mapInPandas(task, schema)
    if hot is not None:
        forward = forward.unionByName(_hot_counts(known.join(F.broadcast(hot), "user_id", "left_semi"), width, schema))
    both = forward.select(
        F.explode(F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))).alias("p"), "n"
    )
    counts = both.groupBy("p.item_a", "p.item_b").agg(F.sum("n").alias("n"))
    top = counts.groupBy("item_a").agg(F.max("n").alias("top"))
    return counts.join(top, "item_a").select("item_a", "item_b", "n", (F.col("n") / F.col("top")).alias("score"))


def _hot_counts(rows: DataFrame, width: int, schema: str) -> DataFrame:
    """Later-event counts of hot users.

    Groups are (user, slice of one window width, pair of item chunks). Events also join the
    slice before their own, so each event finds all that follows within the window; the
    chunk pairs split a slice into HOT_CHUNKS ** 2 / 2 parts.
    """
    own = F.floor(F.col("us") / F.lit(width))
    chunk = F.pmod(F.xxhash64("item_id"), F.lit(HOT_CHUNKS)).cast("int")
    near = rows.select("user_id", "item_id", "us", chunk.alias("chunk"), own.alias("own"), F.explode(F.array(own, own - 1)).alias("slice"))
    spread = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(HOT_CHUNKS - 1))).alias("other")).select(
        "user_id", "slice", "item_id", "us", "chunk", (F.col("own") == F.col("slice")).alias("home"),
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
    )

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("us", kind="stable")
        out = _pairs(part, part["us"].to_numpy(), width)
        if key[2] != key[3]:
            # Pairs inside one chunk belong to the groups of equal chunks.
            side = part.drop_duplicates("item_id").set_index("item_id")["chunk"]
            out = out[out["item_a"].map(side) != out["item_b"].map(side)]
        return out

    return spread.groupBy("user_id", "slice", "i", "j").applyInPandas(task, schema)


def used_together(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Array of the k items most used together with each item."""
    best = skew.rank_rows(pairs, ["item_a"], [F.desc("n"), F.asc("item_b")], k)
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col("item_b").alias("item_id"), "score")))
    return best.groupBy(F.col("item_a").alias("item_id")).agg(packed.alias("used_with"))
