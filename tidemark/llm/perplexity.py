"""Quality rules: base counts per text and bands of n-gram perplexity per language.

The model is a modified Kneser-Ney model of characters: Spark counts the n-grams of the
highest order over all documents of a language, and continuation counts, discounts and interpolated
probabilities follow by aggregates and joins over that table. A model is stored as arrays of sorted 60-bit n-gram
keys with log probabilities, and of context keys with log back-off weights, searched by bisection.

A text is never scored by its own counts: texts fall into two folds, and each fold is scored by the model of
the other one. The fold comes from the smallest hash of a text's stretches of 20 symbols, so copies share it and
near-copies mostly do, and they do not vouch for each other.

A model larger than one pass is scored in passes over ranges of contexts. Read backwards from its end, a context is a
number, and all that a back-off from it can visit are the starts of that number; so every n-gram is scored whole in
exactly one pass, and a text's score is the sum over the passes.

Characters are the unit because their n-grams stay few next to the text, in any language; word n-grams are nearly
all different in a large corpus, and shipping them twice would cost more than the corpus itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stage import maybe_broadcast
from tidemark.llm.common import per_batch, pick, written

ORDER = 5
BITS = 12  # of a symbol; five fit into one key
START = 2
BLOCK_CHARS = 1_000_000
WIDE = 3584  # code points from here on are two symbols, so that no two texts look alike
FOLDS = 2
MODEL_ENTRIES = 4_000_000  # scored in one pass, about 50 MB on the driver; larger models take more passes
LOWER_BAND, UPPER_BAND = 2.0, 1.5  # quartile distances below the lower and above the upper quartile
FEW = 2.33  # two standard errors of a quartile distance are this share of it, divided by the square root of the texts
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOL_MARKS = b"#*$%&|<>"
START_MARK = "\U0010ffff"


def _symbols() -> np.ndarray:
    """Folded code point of each code point: no case, one digit, one space."""
    table = np.empty(0x110000, dtype=np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        c = "0" if c.isdigit() else " " if c.isspace() or cp == START else c.lower()
        table[cp] = ord(c) if len(c) == 1 else cp
    table[ord(START_MARK)] = START
    return table


def packed(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key that ends at each symbol, texts one after the other, and the texts' sizes in symbols.

    Every text is preceded by start symbols, so no n-gram crosses texts. A code point from WIDE on is a
    leading symbol of its upper bits and one of its lower 12 bits.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    lead = START_MARK * (ORDER - 1)
    joined = "".join(lead + t for t in texts)
    codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    wide = codes >= WIDE
    if wide.any():
        owner = np.repeat(np.arange(len(texts)), sizes + ORDER - 1)
        sizes = sizes + np.bincount(owner[wide], minlength=len(texts))
        at = np.flatnonzero(wide) + np.arange(int(wide.sum()))
        high, low = WIDE + (codes[wide] >> BITS), codes[wide] & ((1 << BITS) - 1)
        codes = np.repeat(codes, 1 + wide)
        codes[at], codes[at + 1] = high, low
    grams = np.zeros(max(0, len(codes) - ORDER + 1), dtype=np.int64)
    for k in range(ORDER):
        grams <<= BITS
        grams |= codes[k : k + len(grams)]
    first = np.arange(int(sizes.sum())) + (ORDER - 1) * np.repeat(np.arange(len(texts)), sizes)
    return grams[first], sizes


def _blocks(rows: list[int], texts: list[str]):
    part, size = [], 0
    for i in rows:
        if part and size + len(texts[i]) > BLOCK_CHARS:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def folds_of(texts: list[str], table: np.ndarray) -> np.ndarray:
    """0 or 1 per text, by the smallest hash of its stretches of four n-grams; texts shorter than that by a hash of the whole."""
    out = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t in texts], dtype=np.int32)
    reach = ORDER * (len(MIX) - 1)
    for part in _blocks(range(len(texts)), texts):
        grams, sizes = packed([texts[i] for i in part], table)
        grams = np.concatenate([grams, np.zeros(reach, dtype=np.int64)]).view(np.uint64)
        n = int(sizes.sum())
        mixed = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(MIX):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ grams[ORDER * k : ORDER * k + n]) * factor
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(n)
        mixed[left <= reach] = np.iinfo(np.uint64).max  # would reach into the next text
        long = np.flatnonzero(sizes > reach)
        if len(long):
            least = np.minimum.reduceat(mixed, np.column_stack([starts[long], np.minimum(starts[long] + sizes[long], n - 1)]).ravel())[::2]
            out[np.array(part)[long]] = (least >> np.uint64(24)) & np.uint64(1)
    return out


def prepared(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, lang, fold and the base counts per row, written; null languages stay null."""
    table_of: list[np.ndarray] = []

    def one(batch):
        table_of or table_of.append(_symbols())
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counted = list(zip(*[base_counts(t.encode()) for t in texts]))
        kept = [batch.column("row"), batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), batch.column("lang").cast(pa.string())]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(folds_of(texts, table_of[0])), *(pa.array(c, pa.int64()) for c in counted)], ["row", "doc_id", "text", "lang", "fold", *BASE]
        )

    numbered = pick(docs, "doc_id", "text", "lang").withColumn("row", F.monotonically_increasing_id())
    schema = f"row bigint, doc_id bigint, text string, lang string, fold int, {', '.join(f'{b} bigint' for b in BASE)}"
    return written(per_batch(numbered, one, schema), "texts", codec="zstd")  # whole texts, kept for all passes


def model_of(folds: int, other: bool = False) -> F.Column:
    """Name of the model that scores a row (`other`: of the model that counts it): fold and language; null counts as ''."""
    fold = F.col("fold") % folds
    return F.concat(((folds - 1 - fold) if other else fold).cast("string"), F.coalesce(F.col("lang"), F.lit("")))


def _by_language(batch) -> tuple[list[str], dict[str, list[int]]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        rows.setdefault(lang, []).append(i)
    return texts, rows


def counts(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(lang, gram, c) of prepared rows: n-grams of the highest order per model; `lang` is the model's name, see `model_of`.

    With two folds a text counts in the model that scores the other fold, with one in the only model.
    """

    def run(batches):
        table = _symbols()
        held: dict[str, list] = {}
        waiting = 0

        def flush():
            for lang, parts in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, rows = _by_language(batch)
            for lang, mine in rows.items():
                for part in _blocks(mine, texts):
                    grams, _ = packed([texts[i] for i in part], table)
                    if not len(grams):
                        continue
                    seen = pa.array(grams).value_counts()
                    held.setdefault(lang, []).append((seen.field("values").to_numpy(), seen.field("counts").to_numpy()))
                    waiting += len(seen)
                    if waiting > 1_500_000:  # bounded memory; Spark adds up what is sent in parts
                        yield from flush()
                        waiting = 0
        yield from flush()

    named = rows.select("text", model_of(folds, other=True).alias("lang"))
    parts = named.mapInArrow(run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("c"))


def _suffix(order: int) -> F.Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def _discounts(level: DataFrame) -> DataFrame:
    # Modified Kneser-Ney: three discounts per language from the counts of counts, with common values where those are missing.
    n = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("size"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    formula = {k: F.try_subtract(F.lit(float(k)), F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))) for k in (1, 2, 3)}
    usable = lambda k: F.when((formula[k] >= 0) & (formula[k] <= k), formula[k]).otherwise(k / 2)
    return n.select("lang", "size", *[usable(k).alias(f"d{k}") for k in (1, 2, 3)])


def estimate(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated log probabilities (lang, n, gram, logp) and log back-off weights (lang, n, gram, logb), all orders.

    Lower orders count in how many different n-grams of the next order they are the end.
    """
    levels = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = written(levels[n + 1].groupBy("lang", _suffix(n).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"ngrams-{n}")
    lower, probabilities, weights = None, [], []
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("context", F.shiftright("gram", BITS))
        discounts = _discounts(levels[n])
        around = level.groupBy("lang", "context").agg(
            F.sum("c").alias("total"), *[F.count_if(F.col("c") == k).alias(f"m{k}") for k in (1, 2)], F.count_if(F.col("c") >= 3).alias("m3")
        )
        left = F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")
        around = around.join(discounts, "lang").select("lang", "context", "total", "size", "d1", "d2", "d3", (left / F.col("total")).alias("gamma"))
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = level.join(around, ["lang", "context"])
        if lower is None:
            joined = joined.withColumn("p_lower", 1 / (F.col("size") + 1))  # the symbols seen, and one for all others
        else:
            below = lower.select("lang", F.col("gram").alias("end"), F.col("p").alias("p_lower"))
            joined = joined.withColumn("end", _suffix(n - 1)).join(below, ["lang", "end"])
        p = (F.col("c") - taken) / F.col("total") + F.col("gamma") * F.col("p_lower")
        lower = written(joined.select("lang", "gram", p.alias("p")), f"probabilities-{n}")
        probabilities.append(lower.select("lang", F.lit(n).alias("n"), "gram", F.log("p").cast("float").alias("value")))
        base = F.log("gamma") if n > 1 else F.log(F.col("gamma") / (F.col("size") + 1))  # order 1: what an unseen symbol gets
        weights.append(around.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), base.cast("float").alias("value")))
    return _all(probabilities), _all(weights)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _backwards(gram: F.Column, order: int) -> F.Column:
    """The last `order` symbols of a context, last one first, as the upper symbols of a context number."""
    mask = F.lit((1 << BITS) - 1)
    parts = [F.shiftleft(F.shiftright(gram, BITS * i).bitwiseAND(mask), BITS * (ORDER - 2 - i)) for i in range(order)]
    out = F.lit(0).cast("bigint")
    for p in parts:
        out = out.bitwiseOR(p)
    return out


CONTEXTS = 1 << (BITS * (ORDER - 1))


def spans(probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """All entries as (lang, kind, n, gram, value, lo, hi): an entry serves the contexts from lo to before hi."""

    def one(rows, kind, context, order_of):
        lo, hi = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for n in range(ORDER + 1):
            order = order_of(n)
            if 0 <= order <= ORDER - 1:
                start = _backwards(context, order)
                lo = F.when(F.col("n") == n, start).otherwise(lo)
                hi = F.when(F.col("n") == n, start + F.lit(1 << (BITS * (ORDER - 1 - order)))).otherwise(hi)
        return rows.select("lang", F.lit(kind).alias("kind"), F.col("n").cast("tinyint"), "gram", "value", lo.alias("lo"), hi.alias("hi"))

    after = one(probabilities, "p", F.shiftright("gram", BITS), lambda n: n - 1)
    return after.unionByName(one(weights, "b", F.col("gram"), lambda n: n))


def passes(entries: DataFrame, most: int = MODEL_ENTRIES) -> list[list[tuple[str, int, int]]]:
    """Groups of (model, from, to): ranges of contexts whose entries together are about `most` at the most.

    A model above `most` is cut at quantiles of its entries' contexts; smaller ones share a pass.
    """
    sizes = entries.groupBy("lang").count().collect()  # one row per language and fold
    cut: dict[str, list[int]] = {}
    for lang, n in sizes:
        pieces = -(-n // most)
        at = []
        if pieces > 1:
            shares = [i / pieces for i in range(1, pieces)]
            at = entries.filter(F.col("lang") == lang).agg(F.percentile_approx("lo", shares, 100 * pieces)).first()[0]
        cut[lang] = sorted({0, *at, CONTEXTS})
    groups: list[list[tuple[str, int, int]]] = []
    room = 0
    for lang, n in sorted(map(tuple, sizes)):
        bounds = cut[lang]
        for lo, hi in zip(bounds, bounds[1:]):
            share = n // (len(bounds) - 1)
            if not groups or share > room:
                groups.append([])
                room = most
            groups[-1].append((lang, lo, hi))
            room -= share
    return groups


def load(entries: DataFrame, ranges: list[tuple[str, int, int]]) -> dict:
    """{model: [(from, to, {(kind, n): (sorted keys, values)})]} of the ranges of one pass."""
    model: dict = {}
    for lang, lo, hi in ranges:
        mine = entries.filter((F.col("lang") == lang) & (F.col("lo") < hi) & (F.col("hi") > lo))
        found = mine.select("kind", "n", "gram", "value").toArrow()  # bounded by the entries of a pass
        arrays = {}
        for kind in "pb":
            for k in range(ORDER + 1):
                part = found.filter((pc.field("kind") == kind) & (pc.field("n") == k))
                grams = part.column("gram").to_numpy()
                order = np.argsort(grams)
                arrays[kind, k] = (grams[order], part.column("value").to_numpy()[order])
        model.setdefault(lang, []).append((lo, hi, arrays))
    return model


def _context_numbers(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), dtype=np.int64)
    for i in range(1, ORDER):
        out <<= BITS
        out |= (grams >> (BITS * i)) & ((1 << BITS) - 1)
    return out


def scores(ranges: list, grams: np.ndarray) -> np.ndarray:
    """Log probabilities of the n-grams whose contexts lie in the ranges; 0 for all others."""
    if len(ranges) == 1 and ranges[0][:2] == (0, CONTEXTS):
        return log_probabilities(ranges[0][2], grams)
    out, numbers = np.zeros(len(grams)), _context_numbers(grams)
    for lo, hi, arrays in ranges:
        inside = (numbers >= lo) & (numbers < hi)
        out[inside] = log_probabilities(arrays, grams[inside])
    return out


def _find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = arrays
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at].astype(np.float64)


def log_probabilities(model: dict, grams: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each n-gram's last symbol after the others: the longest known end, times back-off weights."""
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        keys = grams[left] & ((1 << (BITS * n)) - 1)
        known, value = _find(model["p", n], keys)
        out[left[known]] += value[known]
        left, keys = left[~known], keys[~known]
        seen, weight = _find(model["b", n - 1], keys >> BITS)
        out[left[seen]] += weight[seen]
    return out


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    lines, earlier, twice = text.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in earlier:
                twice += 1
            elif line.strip():
                earlier.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                for k in (i, j):
                    inside[k] += 1
                    inside[k + 5 if k + 5 < len(inside) else -1] -= 1
        repeated = int((np.cumsum(inside)[:-1] > 0).sum())
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    return len(words), chars, len(text) - len(text.translate(None, SYMBOL_MARKS)), twice, repeated


def log_sums(rows: DataFrame, model: dict) -> DataFrame:
    """(row, log_sum, symbols) of rows (row, text, lang), `lang` the name of a model; for models that are not there, nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    table_of: list[np.ndarray] = []

    def one(batch):
        table_of or table_of.append(_symbols())
        texts, found = _by_language(batch)
        ids = batch.column("row").to_numpy()
        out = []
        for lang, mine in found.items():
            known = shared.value.get(lang)
            for part in _blocks(mine, texts) if known else ():
                grams, sizes = packed([texts[i] for i in part], table_of[0])
                coded = pa.array(grams).dictionary_encode()
                each = scores(known, coded.dictionary.to_numpy())[coded.indices.to_numpy()]
                sums = np.bincount(np.repeat(np.arange(len(part)), sizes), weights=each, minlength=len(part)).astype(np.float64)
                out.append((ids[part], sums, sizes))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "log_sum", "symbols"])

    mine = rows.filter(F.col("lang").isin(list(model)))
    return per_batch(mine, one, "row bigint, log_sum double, symbols bigint")


def measures(rows: DataFrame, entries: DataFrame, folds: int = FOLDS, most: int = MODEL_ENTRIES) -> DataFrame:
    """doc_id, lang, the base counts and log_perplexity per prepared row; null where there is no character or no model of the language."""
    texts = rows.select("row", "text", model_of(folds).alias("lang"))
    rows = rows.select("row", "doc_id", "lang", *BASE)
    # One pass after the other, so that only one model is held at a time.
    sums = [written(log_sums(texts, load(entries, ranges)), "log-sums") for ranges in passes(entries, most)]
    if not sums:
        return rows.select("doc_id", "lang", *BASE, F.lit(None).cast("double").alias("log_perplexity"))
    logs = _all(sums).groupBy("row").agg(F.try_divide(-F.sum("log_sum"), F.max("symbols")).alias("log_perplexity"))
    return rows.join(logs, "row", "left").select("doc_id", "lang", *BASE, "log_perplexity")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, lower_band: float = LOWER_BAND, upper_band: float = UPPER_BAND, most: int = MODEL_ENTRIES) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, log_perplexity.

    A text fails the base rules with fewer than 10 words or with over 20 % of its words in repeated
    5-word windows. Of the others, a text's log perplexity, by a model that has not counted it, is compared with its
    language's median. A mean over n characters scatters as 1 / sqrt(n), so the deviation times sqrt(n) is what has a common
    spread; a text is kept if it lies within `lower_band` quartile distances below and `upper_band` above the
    quartiles of that, taken per language over all texts that pass the base rules; the distance is widened by two standard errors of itself,
    which matters for languages of few texts. A text whose language has no other text to
    judge it by is kept. Null and empty texts have no words and fail. A null language is a language of its own; repeated rows
    and ids stay. Other columns are ignored.
    """
    known = F.coalesce(F.col("lang"), F.lit(""))
    texts = prepared(docs)
    entries = written(spans(*estimate(written(counts(texts), "ngrams"))), "ngram-entries")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = written(measures(texts, entries, most=most).withColumn("base_failed", failed), "measures")
    passed = rows.filter(~F.col("base_failed"))
    centres = written(passed.groupBy(known.alias("_lang")).agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("_centre")), "centres")
    scaled = ((F.col("log_perplexity") - F.col("_centre")) * F.sqrt("word_chars")).alias("_off")
    off = passed.join(maybe_broadcast(centres), known == F.col("_lang")).select("_lang", "_centre", scaled)  # one row per language
    bands = off.groupBy("_lang", "_centre").agg(F.percentile_approx("_off", [0.25, 0.75], 10_000).alias("_q"), F.count("_off").alias("_n"))
    spread = (F.col("_q")[1] - F.col("_q")[0]) * (1 + F.try_divide(F.lit(FEW), F.sqrt("_n")))
    bands = written(bands.select("_lang", "_centre", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"), spread.alias("_wide")), "bands")
    joined = rows.join(maybe_broadcast(bands), known == F.col("_lang"), "left").select("*", scaled)
    inside = F.col("_off").between(F.col("_low") - lower_band * F.col("_wide"), F.col("_high") + upper_band * F.col("_wide"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "log_perplexity")
