"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of an unseen text,
the longest match with that language's sample. Parsing a text greedily into such matches
("phrases") and normalising the number of phrases by the sample's size and the text's length
estimates the cross entropy; the language that needs the fewest normalised phrases wins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import in_slices, per_batch, pick

# The documented bounds of the learning sample.
SAMPLE_ROWS = 64  # labelled rows per language, taken in hash order
SAMPLE_CHARS = 192_000  # characters of all languages together, shared evenly

SYMBOLS = 64
SEPARATOR, OTHER, PAD = 0, 55, 63  # 1..54: the sample's commonest letters; 55..62: other letters by code block
LANE = 256  # characters parsed in one lane; a longer text takes several lanes
BLOCK_CHARS = 2_000_000  # characters parsed together


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: letters without case, everything else one separator."""
    letters = Counter(c for t in texts for c in t.lower() if c.isalpha())
    common = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: OTHER - 1]]
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = OTHER + (cp >> 7) % (PAD - OTHER)
    for i, c in enumerate(common, 1):
        for form in {c, c.upper()}:
            if len(form) == 1:
                table[ord(form)] = i
    return table


def automaton(samples: list[np.ndarray]) -> np.ndarray:
    """Transitions of the suffix automaton of the samples as one flat array.

    Entry [offset + symbol] holds 2 * (offset of the next state), plus 1 where the match ends
    and a new phrase starts with this symbol. The pad symbol stays in its state for free.
    """
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for sample in samples:
        for c in [*sample.tolist(), PAD]:  # a pad between samples: no match runs across it
            new = len(follow)
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p != -1:
                q = follow[p][c]
                if length[p] + 1 != length[q]:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
    states = len(follow)
    first = np.zeros(SYMBOLS, dtype=np.int64)
    for c, s in follow[0].items():
        first[c] = s
    table = np.tile(2 * first * SYMBOLS + 1, (states, 1))
    rows = np.repeat(np.arange(states), [len(d) for d in follow])
    cols = np.fromiter((c for d in follow for c in d), dtype=np.int64, count=len(rows))
    to = np.fromiter((s for d in follow for s in d.values()), dtype=np.int64, count=len(rows))
    table[rows, cols] = 2 * to * SYMBOLS
    table[:, PAD] = 2 * np.arange(states) * SYMBOLS
    return table.reshape(-1).astype(np.int32)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang known, and crc32(doc_id as text) mod 4 is not 2."""
    known = F.col("text").isNotNull() & F.col("lang").isNotNull()
    return pick(docs, "doc_id", "text", "lang").filter(known & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Model from a bounded sample of (doc_id, text, lang); without labelled rows no language is learned.

    The sample is `sample_rows` rows per language in the order of a hash of doc_id and text; of
    those, texts are taken until the language's even share of `sample_chars` is full. A
    text that is longer than what remains of the share is cut there. The model's size depends on these bounds
    alone: about 300 bytes per character of the sample.
    """
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id")]
    chosen = (
        labelled.select("doc_id", "lang", F.substring("text", 1, sample_chars).alias("text"))
        .withColumn("_place", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
        .filter(F.col("_place") <= sample_rows)
    )
    found: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["_place"])):
        found.setdefault(row["lang"], []).append(row["text"])
    table = alphabet([t for texts in found.values() for t in texts])
    share = sample_chars // max(1, len(found))
    model = {"alphabet": table, "langs": [], "tables": [], "sizes": []}
    for lang, texts in found.items():
        parts, left = [], share
        for text in texts:
            codes = table[np.frombuffer(text[:left].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            parts.append(codes)
            left -= len(codes)
        if any(p.any() for p in parts):
            model["langs"].append(lang)
            model["tables"].append(automaton(parts))
            model["sizes"].append(sum(len(p) for p in parts))
    return model


def phrases(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases per text and language, characters per text, and whether the text has a letter.

    All lanes of 256 characters advance together, one character at a time.
    """
    codes = model["alphabet"][np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(texts)), lanes)
    grid = np.full((int(lanes.sum()), LANE), PAD, dtype=np.uint8)
    starts = np.cumsum(lanes) - lanes
    flat = grid.reshape(-1)
    place = np.repeat(starts * LANE - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
    flat[place] = codes
    letters = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=codes > 0, minlength=len(texts)) > 0
    steps = np.ascontiguousarray(grid.T).astype(np.int32)
    counts = np.zeros((len(texts), len(model["langs"])), dtype=np.int64)
    for j, table in enumerate(model["tables"]):
        at = np.zeros(len(grid), dtype=np.int32)
        breaks = np.ones(len(grid), dtype=np.int32)
        for row in steps:
            at >>= 1
            at += row
            at = table[at]
            breaks += at & 1
        counts[:, j] = np.bincount(owner, weights=breaks, minlength=len(texts))
    return counts, sizes, letters


def _blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    yield slice(start, len(texts))


def identify(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and margin (0 to 1: how many fewer normalised phrases than the second best) per text."""
    langs, scores = [], []
    weights = np.array([math.log2(n + 2) for n in model["sizes"]])
    for block in _blocks(texts := [t or "" for t in texts]):
        part = texts[block]
        counts, sizes, letters = phrases(model, part)
        if not model["langs"]:
            langs += ["und"] * len(part)
            scores += [0.0] * len(part)
            continue
        rates = counts * weights / np.maximum(sizes, 1)[:, None]
        best = rates.argmin(axis=1)  # ties: the first language in code order
        ordered = np.sort(rates, axis=1)
        margin = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-300) if rates.shape[1] > 1 else np.ones(len(part))
        langs += [model["langs"][b] if ok else "und" for b, ok in zip(best, letters)]
        scores += [float(m) if ok else 0.0 for m, ok in zip(margin, letters)]
    return langs, scores


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) per row, from the text alone; whole texts are parsed.

    A null text and one without letters get `und` and score 0, and so does every text if no language
    was learned. The model is bounded by the sample's parameters and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch):
        langs, scores = identify(shared.value, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    return per_batch(pick(docs, "doc_id", "text"), one, "doc_id bigint, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score per row of `docs`; repeated rows stay, a null id is not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, fit(learnable(docs))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.01) -> DataFrame:
    """`docs` without the rows whose language is not recognised: no letters, or a margin under `min_score`.

    Works row by row on whole rows, so repeated rows and null ids need no key; all columns stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(learnable(docs)))
    schema = docs.schema

    def one(batch):
        langs, scores = identify(model.value, batch.column("text").to_pylist())
        return batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in zip(langs, scores)], pa.bool_()))

    return in_slices(docs, one, schema)
