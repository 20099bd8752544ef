"""Periodic runs of words: stretches that repeat with a period, found by tiles per octave of periods.

Scale D serves the periods from D to 2 D - 1; the first one, 8, also those below. A stretch of a period q whose words equal those q
further on is at least 2 D long, so the boundaries 0, D, 2 D, ... of a document cut it, and it holds D equal words
to the right of one of them. Windows of D words, hashed by doubling, show which boundaries that can be; around those the
document is cut into overlapping tiles of 5 D words. Every tile is solved on its own: the Z-function of what is right
of the boundary gives the equal words of every period there, the same to the left the rest, both as far as the next
boundaries reach. Fragments go to their document and period and are joined where they touch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import pick, texts_of, written

LEAST, TIMES = 24, 3  # a run has at least LEAST words and TIMES periods
SMALLEST = 8  # scale of the periods 1 to 15
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
SHAPE = "row bigint, doc_id bigint, n bigint, text string, scale int, boundary bigint, first bigint, tile array<int>"
SOLVED = "row bigint, doc_id bigint, n bigint, text string, period bigint, lo bigint, hi bigint"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal exactly where the words are."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt + 1)) * _FACTOR
    return x ^ (x >> np.uint64(29))


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per scale D its boundaries c at which the D words from c on may be those from c + q on, q a period of the scale."""
    n, d = len(ids), SMALLEST
    if n < LEAST:
        return
    h, wide, level = _mixed(ids.astype(np.uint64), 0), 1, 0
    while d <= n // TIMES or d == SMALLEST:
        while wide < d:
            level += 1
            h = _mixed(h[: len(h) - wide] * np.uint64(2 * level + 1) + (h[wide:] ^ (h[wide:] >> np.uint64(31))), level)
            wide *= 2
        met = np.repeat(h[::d], d)[: max(len(h) - d, 0)] == h[d:]
        found = np.flatnonzero(met) // d
        if d == SMALLEST:
            near = [np.flatnonzero(h[:: d][: len(h[q::d])] == h[q::d]) for q in range(1, d)]
            found = np.concatenate([found, *near])
        if len(found):
            yield d, np.unique(found) * d
        d *= 2


def _z(t: np.ndarray) -> dict[int, int]:
    """The Z-function of t where it is not zero: how many words from i on equal those at the start."""
    z, left, right, n = {}, 0, 0, len(t)
    for i in (np.flatnonzero(t[1:] == t[0]) + 1).tolist():
        length = min(z.get(i - left, 0), right - i) if i < right else 0
        if i + length >= right:
            length = max(right - i, 0) if i < right else 0
            length += _equal(t[length : n - i], t[i + length :])
            left, right = i, i + length
        z[i] = length
        if right == n and 2 * left <= n:
            # From here on all repeats with period `left` to the end.
            own = np.array([z.get(j, 0) for j in range(left)], np.int64)
            at = np.arange(left, n)
            rest = np.where(at % left == 0, n - at, np.minimum(own[at % left], n - at))
            z.update(zip(at[rest > 0].tolist(), rest[rest > 0].tolist()))
            break
    return z


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start on are equal; looks in growing steps."""
    at, step = 0, 64
    while at < len(a):
        apart = a[at : at + step] != b[at : at + step]
        if apart.any():
            return at + int(apart.argmax())
        at, step = at + step, 4 * step
    return len(a)


def solve(tile: np.ndarray, boundary: int, scale: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi) in the tile: the words from lo to hi - 1 around the boundary that equal those a period further on.

    At most `scale` words to the left and twice that to the right. Periods that are a multiple of a shorter one there are left out,
    since their stretch is that one's.
    """
    right = tile[boundary:]
    z = _z(right)
    lowest = 1 if scale == SMALLEST else scale
    long = sorted(q for q, length in z.items() if length >= min(scale, q // 2))
    out = []
    for q in long:
        if not lowest <= q < 2 * scale or z[q] < scale:
            continue
        if any(q % p == 0 and z[p] >= q - p for p in long if p < q and 2 * p <= q):
            continue
        ahead = min(z[q], 2 * scale)
        back = tile[:boundary][::-1]
        behind = _equal(back, tile[: boundary + q][::-1][: len(back)])
        if ahead + behind >= scale:
            out.append((q, boundary - behind, boundary + ahead))
    return out


def joined(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of a period that overlap or touch as one."""
    out: list[list[int]] = []
    for q, lo, hi in sorted(fragments):
        if out and out[-1][0] == q and lo <= out[-1][2]:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([q, lo, hi])
    return [tuple(x) for x in out]


def _blank(words: list[bytes], digest: bool) -> str:
    whole = b" ".join(words)
    return hashlib.sha256(whole).hexdigest() if digest else whole.decode()


def _tiles(digest: bool):
    # A document without any tile is final: its text column is what stays of it. Others keep their words and explode into tiles.
    def run(batches):
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                words = text.split()
                ids = word_ids(words)
                head = (row, doc, len(words))
                found = list(boundaries(ids))
                rows.append((*head, _blank(words, digest and not found), -1 if found else 0, None, None, None))
                for d, at in found:
                    for c in at.tolist():
                        first = max(c - d, 0)
                        rows.append((row, doc, None, None, d, c, first, ids[first : c + 4 * d]))
                if len(rows) >= 2_000:
                    yield _batch(rows, SHAPE)
                    rows = []
            if rows:
                yield _batch(rows, SHAPE)

    return run


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


def _solved(batches):
    # Documents pass; tiles become fragments, those of one document in a batch joined already. scale 0 is told by period 0.
    for batch in batches:
        rows, fragments = [], {}
        cols = [batch.column(i) for i in range(batch.num_columns)]
        scales = cols[4].to_pylist()
        tiles = cols[7]
        heads = list(zip(*[c.to_pylist() for c in cols[:4]], cols[5].to_pylist(), cols[6].to_pylist()))
        for i, (scale, (row, doc, n, text, boundary, first)) in enumerate(zip(scales, heads)):
            if scale <= 0:
                rows.append((row, doc, n, text, scale, None, None))
                continue
            tile = tiles[i].values.to_numpy(zero_copy_only=False)
            made = solve(tile, boundary - first, scale)
            fragments.setdefault((row, doc), []).extend((q, lo + first, hi + first) for q, lo, hi in made)
        for (row, doc), found in fragments.items():
            rows += [(row, doc, None, None, *f) for f in joined(found)]
        yield _batch(rows, SOLVED)


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period) of every run, from fragments (row, period, lo, hi).

    Each document and period is a group of its own; its size is bounded by the document's.
    """
    before = W.partitionBy("row", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(before.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    island = F.sum("opens").over(before.rowsBetween(W.unboundedPreceding, 0))
    parts = fragments.withColumn("opens", opens).withColumn("island", island)
    whole = parts.groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    whole = whole.withColumn("length", F.col("hi") - F.col("start") + F.col("period"))
    long = whole.filter((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))
    # A multiple of a period makes the same stretch; the least one is the period.
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run (start, length, period) holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    held = np.cumsum(change)[:-1] == 0
    return [w for w, k in zip(words, held.tolist()) if k]


def _collapse(digest: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(texts_of(batch.column("text")), batch.column("runs").to_pylist()):
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                out.append(_blank(kept_words(text.split(), runs), digest))
            cols = [batch.column(c) for c in ("doc_id", "n", "runs")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, runs (start, length, period, by start and period) and the collapsed text (`digest`: its SHA-256).

    A run is a stretch of words with smallest period q, at least 24 words and 3 q long, that no neighbouring word extends. The collapsed text
    is the words outside every run and each run's first period, joined by one space. Null and empty texts have no words, no runs
    and an empty collapsed text. Repeated rows and ids, and null ids, stay rows of their own. The work on a text of n words is
    in proportion to n log n. Other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    table = written(rows.mapInArrow(_tiles(digest), SHAPE).mapInArrow(_solved, SOLVED), "period-fragments")
    texts = table.filter("period <= 0")
    runs = stitched(table.filter("period > 0").select("row", "period", "lo", "hi"))
    by_doc = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    in_order = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    open_docs = texts.filter("period < 0").join(by_doc.withColumn("runs", in_order), "row", "left")
    open_docs = open_docs.select("doc_id", "n", "text", F.coalesce("runs", none).alias("runs"))
    shape = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    done = texts.filter("period = 0").select("doc_id", F.col("n").alias("n_words"), none.alias("runs"), F.col("text").alias("collapsed"))
    return done.unionByName(open_docs.mapInArrow(_collapse(digest), shape))
