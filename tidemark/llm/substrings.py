"""Exact removal of repeated 100-byte strings by a suffix sort around shared anchors.

1. Every 100-byte window of a text picks the 32-byte string with the smallest hash in it as its anchor, so equal windows
   have equal anchors at equal offsets. Anchors meet by hash; those that occur once settle all their windows.
2. For every other anchor the text around it travels to the task of its hash.
3. There the suffixes that start at the anchors, and the reversed prefixes that end there, are put into order by a
   mergesort. It compares two suffixes by their longest common extension, found by binary search over prefix
   polynomial hashes, and the finished order is verified byte by byte; on a collision it is done again with another base.
4. Runs of the two orders with long enough common extensions are the sets of equal windows; all but the
   first window of each set are removed, and go back to their texts.

Texts stay in buckets of a few megabytes by document (id and text, so that many null ids are many buckets), anchors in buckets by hash; the number of
buckets follows the input. Of equal surroundings in one bucket only the first travels on. Anchors shared by very many
texts are cut into narrower ranges of offsets with keys of their own, so that no group of windows meets in one task as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, pick, texts_of, written

LENGTH = 100
ANCHOR = 32  # bytes; a power of two
WINDOW = LENGTH - ANCHOR + 1  # anchors to choose from in one window
BLOCK = 2_000_000  # bytes hashed together
BUCKET_BYTES = 6_000_000  # input bytes per bucket
FLUSH = 400_000  # anchors per message of a task
HOT = 5_000  # occurrences from which an anchor's windows are keyed more finely
HOT_SHARE = 20_000  # at most so many anchors can be hot
STEP = 8  # offsets per key of a hot anchor

COLUMNS = {"doc": "bigint", "th": "bigint", "d": "int", "q": "int", "ac": "int", "h": "bigint", "n": "int"}
SCHEMA = "bucket int, kind int, " + ", ".join(f"{c} array<{t}>" for c, t in COLUMNS.items()) + ", seg binary"
KIND = {"bigint": np.int64, "int": np.int32}
ANCHORS, KNOWN, HOTTEST = 0, 1, 2
NO_ID = -(1 << 63)  # what a null doc_id sorts as

_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _rolling(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every ANCHOR-byte string, by doubling."""
    h, size, power = _BYTE[b], 1, _BASE
    while size < ANCHOR:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(x: np.ndarray) -> np.ndarray:
    size = 1
    while 2 * size <= WINDOW:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = WINDOW - size
    return np.minimum(x[: len(x) - rest], x[rest:])


def anchors(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts b[start : start + size]: text number, place in the text, first and last window, hash."""
    windows = np.maximum(sizes - LENGTH + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.int64),)
    hashes = _rolling(b)
    low = np.uint64((1 << 24) - 1)
    ranked = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))  # on ties the last place
    best = _window_minima(ranked)
    text = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (low - (best[inside + starts[text]] & low)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return text[new], at[new] - starts[text[new]], inside[new], inside[last], hashes[at[new]].view(np.int64)


def _blocks(texts: list[bytes]):
    """(text number, offset, bytes) parts in lists of at most BLOCK bytes; parts of one long text overlap by LENGTH - 1."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            piece = t[at : at + BLOCK + LENGTH - 1] if len(t) > BLOCK else t
            if part and size + len(piece) > BLOCK:
                yield part
                part, size = [], 0
            part.append((i, at, piece))
            size += len(piece)
            if piece is t:
                break
    if part:
        yield part


def text_hash(t: bytes) -> int:
    return xxhash.xxh64_intdigest(t, 7) - (1 << 63)


def _messages(kind: int, bucket: np.ndarray, cols: dict[str, np.ndarray], segs: list[bytes] | None = None) -> pa.RecordBatch:
    """One row per bucket that holds its anchors as lists."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[cuts, len(bucket)].astype(np.int32))
    lists = []
    for c, t in COLUMNS.items():
        values = cols[c][order] if c in cols else np.zeros(len(order))
        lists.append(pa.ListArray.from_arrays(offsets, pa.array(values.astype(KIND[t]))))
    ends = [*cuts[1:].tolist(), len(bucket)]
    press = zstandard.ZstdCompressor(level=1)
    joined = [None if segs is None else press.compress(b"".join(segs[i] for i in order[lo:hi])) for lo, hi in zip(cuts.tolist(), ends)]
    names = ["bucket", "kind", *COLUMNS, "seg"]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32)), *lists, pa.array(joined, pa.binary())], names
    )


def _cells(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    mine = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    return {c: mine.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(KIND[t]) for c, t in COLUMNS.items()} | {
        "seg": b"".join(zstandard.decompress(s) for s in mine.column("seg").to_pylist() if s)
    }


def _pick(cols: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {c: cols[c][which] for c in COLUMNS}


def _pressed(docs: DataFrame) -> DataFrame:
    """`docs` (bucket, doc_id, text) with compressed texts, which cross the network twice."""

    def one(batch):
        press = zstandard.ZstdCompressor(level=1)
        texts = pa.array([press.compress(t) for t in texts_of(batch.column("text"))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("doc_id").cast(pa.int64()), texts], ["bucket", "doc_id", "text"])

    return per_batch(docs.select("bucket", "doc_id", "text"), one, "bucket int, doc_id bigint, text binary")


def _unpressed(docs: pa.Table):
    """(doc_id, text) of each row, one text at a time."""
    opener = zstandard.ZstdDecompressor()
    for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text")):
        yield i, opener.decompress(t.as_py())


def _all_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        waiting = 0

        def flush():
            cols = {c: np.concatenate([h[c] for h in held]) for c in COLUMNS}
            held.clear()
            # Of anchors that occur several times here only the first meets those of other tasks; the others are known.
            _, first, back, n = np.unique(cols["h"], return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(n[back] > 1)
            cols["n"] = n[back].astype(np.int32)
            yield _messages(ANCHORS, cols["h"][first] % buckets, _pick(cols, first))
            if len(known):
                yield _messages(KNOWN, cols["d"][known], _pick(cols, known))

        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids = [NO_ID if v is None else v for v in batch.column("doc_id").to_pylist()]
            homes = batch.column("bucket").to_pylist()
            for part in _blocks(texts):
                pieces = [p for _, _, p in part]
                sizes = np.array([len(p) for p in pieces])
                text, q, first, last, h = anchors(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)
                shift = np.array([at for _, at, _ in part])[text]
                own = [i for i, _, _ in part]
                held.append({
                    "doc": np.array([ids[i] for i in own], np.int64)[text],
                    "th": np.array([text_hash(texts[i]) for i in own], np.int64)[text],
                    "d": np.array([homes[i] for i in own], np.int32)[text],
                    "q": (q + shift).astype(np.int32),
                    "ac": ((q - first) * 256 + (q - last)).astype(np.int32),
                    "h": h,
                    "n": np.ones(len(q), np.int32),
                })
                waiting += len(q)
                if waiting > FLUSH:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, SCHEMA)


def _repeated(group: pa.Table) -> pa.Table:
    """Anchors of one hash bucket that occur more than once, by document bucket; how often the frequent ones occur."""
    cols, known = _cells(group, ANCHORS), _cells(group, KNOWN)
    values, back = np.unique(cols["h"], return_inverse=True)
    n = np.bincount(back, weights=cols["n"], minlength=len(values))
    tasks = np.bincount(back, minlength=len(values))
    news = np.flatnonzero((tasks[back] > 1) & (cols["n"] == 1))
    often = np.flatnonzero(n >= HOT)
    out = [_messages(KNOWN, cols["d"][news], _pick(cols, news)), _messages(KNOWN, known["d"], _pick(known, slice(None)))]
    out.append(_messages(HOTTEST, np.zeros(len(often), np.int32), {"h": values[often], "n": n[often]}))
    return pa.Table.from_batches(out)


def _surroundings(hot: np.ndarray, buckets: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        """The text around each repeated anchor of one document bucket, keyed by the anchor; equal ones are settled here."""
        cols = _cells(marks, KNOWN)
        texts = {}
        for i, t in _unpressed(docs):
            if len(t) >= LENGTH:
                texts[NO_ID if i is None else i, text_hash(t)] = t
        place = ("doc", "th", "q", "ac")
        cols = _pick(cols, np.lexsort([cols[c] for c in reversed(place)]))
        repeats = np.logical_and.reduce([cols[c][1:] == cols[c][:-1] for c in place])
        cols = _pick(cols, np.r_[True, ~repeats][: len(cols["doc"])])  # rows that repeat a document give its anchors twice
        is_hot = np.isin(cols["h"], hot)
        seen: set = set()
        rows: list[tuple[int, int, int]] = []  # anchor number, narrowed offsets, key
        segs: list[bytes] = []
        settled: list[tuple[int, int]] = []
        here = zip(cols["doc"].tolist(), cols["th"].tolist(), cols["q"].tolist(), cols["ac"].tolist(), cols["h"].tolist(), is_hot.tolist())
        for i, (doc, th, q, ac, h, often) in enumerate(here):
            a, c = ac >> 8, ac & 255
            text = texts[doc, th]
            ranges = [(a, c, h)]
            if often:
                ranges = []
                for lo in range(c - c % STEP, a + 1, STEP):  # windows of such offsets all hold this core
                    core = text[q - lo : q - lo - STEP + 1 + LENGTH]
                    ranges.append((min(a, lo + STEP - 1), max(c, lo), xxhash.xxh64_intdigest(core, lo + 1) - (1 << 63)))
            for x, y, key in ranges:
                seg = text[q - x : q - y + LENGTH]
                if (same := (key, x, seg)) in seen:
                    settled.append((i, x * 256 + y))
                    continue
                seen.add(same)
                rows.append((i, x * 256 + y, key))
                segs.append(seg)
        out = []
        at = np.array([r[0] for r in rows], np.int64)
        sent = _pick(cols, at) | {"ac": np.array([r[1] for r in rows], np.int32), "h": np.array([r[2] for r in rows], np.int64)}
        out.append(_messages(ANCHORS, sent["h"] % buckets, sent, segs))
        at, ac = np.array([s[0] for s in settled], np.int64), np.array([s[1] for s in settled], np.int64)
        done = _pick(cols, at)
        done["q"], done["ac"] = done["q"] - (ac >> 8).astype(np.int32), ((ac >> 8) - (ac & 255)).astype(np.int32)
        out.append(_messages(KNOWN, done["d"], done))
        return pa.Table.from_batches(out)

    return run


class Pool:
    """Bytes with prefix polynomial hashes modulo 2^64."""

    def __init__(self, b: np.ndarray, base: int):
        with np.errstate(over="ignore"):
            n = len(b)
            powers = np.full(n + 1, np.uint64(base))
            powers[0] = 1
            inverse = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
            inverse[0] = 1
            self.bytes, self.inverse = b, np.multiply.accumulate(inverse)
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[b] * np.multiply.accumulate(powers)[:n], out=self.prefix[1:])

    def _hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.inverse[at]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at x and y, at most `most`, by binary search."""
        lo, hi = np.zeros_like(most), most.copy()
        for _ in range(int(most.max()).bit_length() if len(most) else 0):
            mid = (lo + hi + 1) >> 1
            same = self._hash(x, mid) == self._hash(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def before(self, x, y, size_x, size_y) -> np.ndarray:
        """Whether the suffix at x sorts strictly before the one at y."""
        most = np.minimum(size_x, size_y)
        k = self.common(x, y, most)
        end = k == most
        at = np.where(end, 0, k)
        return np.where(end, size_x < size_y, self.bytes[np.minimum(x + at, len(self.bytes) - 1)] < self.bytes[np.minimum(y + at, len(self.bytes) - 1)])


def suffix_order(pool: Pool, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the suffixes (at, size) within their groups; common prefix with the one before (-1 at a group's start); verified.

    A bottom-up mergesort of all groups at once: at each level every element finds its place in the run next to its own.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    head = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    count = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
    width = 1
    while n and width < count.max():
        pos = np.flatnonzero(count > width)
        base = start[pos] + (pos - start[pos]) // (2 * width) * (2 * width)
        stop = start[pos] + count[pos]
        mid, end = np.minimum(base + width, stop), np.minimum(base + 2 * width, stop)
        left = pos < mid
        from_, to = np.where(left, mid, base), np.where(left, end, mid)
        lo, hi = from_.copy(), to.copy()
        me = order[pos]
        while (open_ := np.flatnonzero(lo < hi)).size:
            probe = (lo[open_] + hi[open_]) >> 1
            x, y = me[open_], order[probe]
            is_left = left[open_]
            one, two = np.where(is_left, y, x), np.where(is_left, x, y)
            less = pool.before(at[one], at[two], size[one], size[two])
            onward = np.where(is_left, less, ~less)
            lo[open_] = np.where(onward, probe + 1, lo[open_])
            hi[open_] = np.where(onward, hi[open_], probe)
        merged = order.copy()
        merged[base + (pos - np.where(left, base, mid)) + (lo - from_)] = me
        order = merged
        width *= 2
    common = np.full(n, -1, np.int64)
    pairs = np.flatnonzero(~head)
    x, y = order[pairs - 1], order[pairs]
    most = np.minimum(size[x], size[y])
    common[pairs] = k = pool.common(at[x], at[y], most)
    good = np.ones(len(pairs), bool)
    for t in range(int(k.max()) if len(k) else 0):
        here = np.flatnonzero(k > t)
        good[here] &= pool.bytes[at[x[here]] + t] == pool.bytes[at[y[here]] + t]
    differ = np.flatnonzero(k < most)
    good[differ] &= pool.bytes[at[x[differ]] + k[differ]] < pool.bytes[at[y[differ]] + k[differ]]
    good[k == most] &= (size[x] <= size[y])[k == most]
    return order, common, bool(good.all())


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number per suffix that is shared exactly by those with `length` common bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(common < length, np.arange(len(order)), 0))
    return out


def later_windows(cols: dict[str, np.ndarray], pool_bytes: np.ndarray) -> np.ndarray:
    """For anchors in document order: which of their windows (by offset of the anchor) occurred before."""
    a, c = cols["ac"] >> 8, cols["ac"] & 255
    n = len(a)
    sizes = (a - c + LENGTH).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    at = begin + a
    group = cols["h"]
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        ahead, behind = Pool(pool_bytes, base), Pool(pool_bytes[::-1].copy(), base)
        right, right_common, ok = suffix_order(ahead, at, (LENGTH - c).astype(np.int64), group)
        left, left_common, fine = suffix_order(behind, len(pool_bytes) - at, a.astype(np.int64), group)
        if ok and fine:
            break
    else:
        raise RuntimeError("hash collisions under four bases")
    removed = np.zeros((n, WINDOW + 1), bool)
    for offset in range(WINDOW):
        mine = np.flatnonzero((c <= offset) & (offset <= a))
        if len(mine) < 2:
            continue
        key = _classes(right, right_common, LENGTH - offset)[mine] * n + _classes(left, left_common, offset)[mine]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(mine), bool)
        again[first] = False
        removed[mine[again], offset] = True
    return removed


def _settle(group: pa.Table) -> pa.Table:
    """Removed windows of one bucket of anchors, as ranges of window starts by document bucket."""
    raw, known = _cells(group, ANCHORS), _cells(group, KNOWN)
    sizes = (raw["ac"] >> 8) - (raw["ac"] & 255) + LENGTH
    order = np.lexsort((raw["q"], raw["th"], raw["doc"]))
    b = np.frombuffer(raw["seg"], np.uint8)
    begin = (np.cumsum(sizes) - sizes)[order]
    cols, sizes = _pick(raw, order), sizes[order]
    out = [_messages(KNOWN, known["d"], _pick(known, slice(None)))]
    lone = np.unique(cols["h"], return_inverse=True, return_counts=True)
    several = np.flatnonzero(lone[2][lone[1]] > 1) if len(order) else np.zeros(0, np.int64)
    if len(several):
        cols, begin, sizes = _pick(cols, several), begin[several], sizes[several]
        gather = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        removed = later_windows(cols, b[gather])
        edge = np.diff(removed.astype(np.int8), axis=1, prepend=0)
        who, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1  # the last column is never set, so each run ends
        found = _pick(cols, who)
        found["q"], found["ac"] = (cols["q"][who] - hi).astype(np.int32), (hi - lo).astype(np.int32)
        out.append(_messages(KNOWN, found["d"], found))
    return pa.Table.from_batches(out)


def _result(docs: pa.Table, marks: pa.Table) -> pa.Table:
    cols = _cells(marks, KNOWN)
    order = np.lexsort((cols["th"], cols["doc"]))
    cols = _pick(cols, order)
    ends = np.flatnonzero(np.r_[(cols["doc"][1:] != cols["doc"][:-1]) | (cols["th"][1:] != cols["th"][:-1]), True]) + 1 if len(order) else []
    ranges, begin = {}, 0
    for end in ends:
        ranges[int(cols["doc"][begin]), int(cols["th"][begin])] = (cols["q"][begin:end], cols["ac"][begin:end])
        begin = end
    rows = []
    for i, t in _unpressed(docs):
        found = ranges.get((NO_ID if i is None else i, text_hash(t)))
        kept, spans = t, 0
        if found is not None:
            change = np.zeros(len(t) + 1, np.int64)
            np.add.at(change, found[0], 1)
            np.add.at(change, found[0] + found[1] + LENGTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        rows.append((i, len(t), len(t) - len(kept), spans, kept))
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)


def _digest(fn):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        made = fn(docs, marks)
        digests = [hashlib.sha256(k).hexdigest() for k in made.column("kept").to_pylist()]
        return made.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digests, pa.string()))

    return run


def without_repeats(docs: DataFrame, digest: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their SHA-256 with `digest`).

    Texts are UTF-8 bytes, null counts as empty and texts under 100 bytes lose nothing. A 100-byte string is removed
    where it starts later than elsewhere: at a larger doc_id (null is the smallest), or later in the
    same document. Rows that repeat both doc_id and text are one document and get the same result each; of different
    texts with one doc_id, an order by text hash decides. Strings are judged on the input. Other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(buckets)).cast("int"))

    met = _all_anchors(placed, buckets).groupBy("bucket").applyInArrow(_repeated, SCHEMA)
    repeated = written(met, "repeated-anchors")
    tops = repeated.filter(F.col("kind") == HOTTEST).select(F.explode(F.arrays_zip("h", "n")).alias("x")).select("x.*")
    hot = np.array(sorted(r[0] for r in tops.orderBy(F.desc("n"), "h").limit(HOT_SHARE).collect()), np.int64)
    marks = repeated.filter(F.col("kind") == KNOWN)
    pressed = _pressed(placed)
    around = pressed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_surroundings(hot, buckets), SCHEMA)
    removed = written(around.groupBy("bucket").applyInArrow(_settle, SCHEMA), "removed-windows")
    final = pressed.groupBy("bucket").cogroup(removed.groupBy("bucket"))
    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
    if digest:
        return final.applyInArrow(_digest(_result), shape + "kept_sha256 string")
    return final.applyInArrow(_result, shape + "kept binary")
