"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority over the hashes of its word shingles. The
distinct fingerprints are cut into segments of 32 bits. Two fingerprints within the allowed
distance agree in some segment up to a small ball, so each one looks up the ball around
each of its segments in the table of segment values and verifies the complete distance of
what it meets. Equal fingerprints are one node from the start; only links between different
fingerprints are listed, and each of those has a bounded number of neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, one_of_each, per_batch, pick, texts_of, written
from tidemark.llm.graph import components

SEED = 42
SEGMENT_BITS = 32
HOT_SEGMENT = 2_000  # fingerprints of one segment value beyond which single-bit neighbours are met instead


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; fewer words count as one run, none gives none."""
    found = text.lower().split()  # bytes: A-Z only, and exactly the white space 09-0D and 20
    if len(found) < words:
        runs = [b" ".join(found)] if found else []
    else:
        runs = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes; no words give zero."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 100_000):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) per row; a null text has no words. The bigint columns `also` are carried along."""

    def one(batch):
        found = [fingerprint(t, words) for t in texts_of(batch.column("text"))]
        ids = [batch.column(c).cast(pa.int64()) for c in ("doc_id", *also)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(found, pa.int64())], ["doc_id", *also, "fp"])

    return per_batch(pick(docs, "doc_id", "text", *also), one, ", ".join(f"{c} bigint" for c in ("doc_id", *also, "fp")))


def segment_radii(distance: int) -> list[int]:
    """Ball radius per segment of a 64-bit fingerprint such that no pair within `distance` is missed.

    With m segments and distance = m * a + b, either one of the first b + 1 segments differs in
    at most a bits, or one of the others in at most a - 1 (a radius of -1: no lookup needed).
    """
    m = 64 // SEGMENT_BITS
    a, b = divmod(distance, m)
    return [a if i <= b else a - 1 for i in range(m)]


def _segment(i: int) -> F.Column:
    value = F.shiftrightunsigned("fp", i * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return value + F.lit(i << SEGMENT_BITS)  # the segment's number and its value in one key


def _single_bits(n: int) -> F.Column:
    return F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(n)])


def _ball(value: F.Column) -> F.Column:
    # The bit that differs is 0 on one side of a pair: only that side looks up its flip.
    free = F.filter(_single_bits(SEGMENT_BITS), lambda bit: value.bitwiseAND(bit) == 0)
    return F.concat(F.array(value), F.transform(free, lambda bit: value + bit))


def _bits_apart(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def links(classes: DataFrame, distance: int = 2, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """(fp, other) for different fingerprints at most `distance` (0 to 3) bits apart; classes: one row per fp.

    Pairs are listed once. Segment values that more than `hot_segment` fingerprints share are
    looked up another way at distance 2: their fingerprints meet at common neighbours
    one bit away, and all that meet at one neighbour are linked to the smallest of them. That
    gives the same components from 65 rows a fingerprint, however large the segment's group.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3: beyond that balls of one bit would miss pairs")
    if distance < 2:  # the whole fingerprint is the segment: its ball holds exactly the pairs
        free = F.filter(_single_bits(64), lambda bit: F.col("fp").bitwiseAND(bit) == 0)
        flips = classes.select(F.col("fp").alias("other"), F.explode(free).alias("bit")).filter(F.lit(distance == 1))
        flips = flips.select("other", F.col("other").bitwiseXOR(F.col("bit")).alias("fp"))
        return classes.select("fp").join(flips, "fp").select(F.greatest("fp", "other").alias("fp"), F.least("fp", "other").alias("other"))
    radii = segment_radii(distance)
    used = [i for i, r in enumerate(radii) if r >= 0]
    entries = classes.select("fp", F.explode(F.array(*[_segment(i) for i in used])).alias("key"))
    lookups = []
    for i in used:
        lookups.append(_ball(_segment(i)) if radii[i] else F.array(_segment(i)))
    probes = classes.select(F.col("fp").alias("other"), F.explode(F.concat(*lookups)).alias("key"))

    hot = entries.groupBy("key").count().filter(F.col("count") > hot_segment).select("key")
    met = None
    if distance == 2 and not hot.isEmpty():
        hot = written(hot, "hot-segments")
        around = F.concat(F.array(F.lit(0).cast("bigint")), _single_bits(64))
        touched = entries.join(hot, "key", "left_semi").select("fp").unionByName(
            probes.join(hot, "key", "left_semi").select(F.col("other").alias("fp"))
        )
        steps = touched.distinct().select("fp", F.explode(around).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("at"))
        least = steps.groupBy("at").agg(F.min("fp").alias("low"))
        met = steps.join(least, "at").filter(F.col("fp") != F.col("low")).select("fp", F.col("low").alias("other")).distinct()
        entries, probes = entries.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti")

    close = (_bits_apart("fp", "other") <= distance) & (F.col("fp") != F.col("other"))
    pairs = entries.join(probes, (entries["key"] == probes["key"]) & close).select(
        F.greatest("fp", "other").alias("fp"), F.least("fp", "other").alias("other")
    )
    return (pairs if met is None else pairs.unionByName(met)).distinct()


def _named(found: DataFrame, distance: int) -> DataFrame:
    # The root fingerprint and the component's smallest doc_id (null without any) for each row of `found`.
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(links(classes, distance), "fp", "other").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows
    and repeated ids stay separate rows of one component. A null doc_id is never the
    smallest; component_id is null only if a component has no id at all. Other columns are ignored.
    """
    found = _named(written(fingerprints(docs, words), "fingerprints"), distance)
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """`docs` with exactly one row of each component: smallest doc_id (null last), then smallest hash of the text, then first row.

    The grouping goes by row, so of rows that repeat an id each belongs to the component of its own text.
    """
    rows, name = numbered(docs)
    keys = rows.select(F.col(name).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    named = _named(written(fingerprints(keys, words, ["row", "text_hash"]), "fingerprints"), distance)
    return one_of_each(rows, name, named, "root").select(*docs.columns)
