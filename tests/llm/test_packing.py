import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import catalog, packing

ODD = [
    "", " ", "  ", "a", " a", "a  b", "a \n b", "\n\nfoo", "foo\n\n bar", "it's  'tis 's", "don't  stop", "x y  z", "tab\t tab \tend ",
    "schön wird's über  Ähre", "от  этого мира", "日本語 の 文章", "a  b 　c", "12 345  678,9", "<|endoftext|> text <|endoftext|>", "…  — “q”", "\u0085 a \u0085", "\x1c a\x1c b",
    "🙂 🙂🙂  x", "é ́ x", "​ a ​b", "ends with blank ", "\r\n a\r\n", "A  b  c",
]


def test_ids_equal_the_tokenizer(sf, spark):
    model = Tokenizer.from_file(packing.tokenizer_path())
    model.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(ODD + [" ", "\n", "word", " word"]) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    expected = [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    found = packing.Encoder(packing.tokenizer_path()).encode(texts)
    assert list(found) == expected
    small = packing.Encoder(packing.tokenizer_path(), cached=50)  # the cache starts anew all the time
    assert list(small.encode(texts)) == expected and [next(small.encode([t])) for t in texts[:400]] == expected[:400]


def test_long_texts_are_cut_where_the_tokenizer_cuts(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 50)
    encoder = packing.Encoder(packing.tokenizer_path())
    for text in ("".join(ODD), " ".join(ODD), "日本語" * 100, "x" * 500 + "  y" * 100, " \n" * 200 + " end"):
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_first_fit_equals_the_plain_search():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 17, 400):
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        room, bins, offsets = [100] * max(n, 1), [], []
        for length in lengths:
            b = next(i for i, r in enumerate(room) if r >= length)
            bins.append(b)
            offsets.append(100 - room[b])
            room[b] -= length
        assert packing.first_fit(lengths, 100) == (bins, offsets)


def check(rows, length):
    """Every id once, sequences gapless and not too long; the share of padding."""
    docs, seqs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
    total = sum(r["length"] for r in rows)
    return len(seqs) * length / max(total, 1) - 1


def test_whole_table(spark, sf):
    found = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = found.collect()
    assert check(rows, 2048) < 0.02
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    seqs = packing.sequences(found).collect()
    assert sum(r["length"] for r in seqs) == sum(r["length"] for r in rows) and all(len(r["ids"]) == r["length"] <= 2048 for r in seqs)
    model = Tokenizer.from_file(packing.tokenizer_path())
    model.encode_special_tokens = True
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    whole = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]] += r["ids"]
    assert whole == {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in docs.items()}


def test_many_groups_small_sequences(spark, sf):
    rows = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"), length=64, group_pieces=500, ids=False).collect()
    assert check(rows, 64) < 0.02


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    given = [(1, "same words", 1), (1, "same words", 2), (None, None, 3), (None, "", 4), (None, "x " * 9_000, 5)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, piece bigint").selectExpr("*", "piece as length", "piece as ids", "piece as group", "piece as offset")
    rows = packing.packed(docs).collect()
    check(rows, 2048)
    assert sorted(r["length"] for r in rows if r["doc_id"] == 1) == [3, 3]
    assert sorted(r["doc_tokens"] for r in rows if r["doc_id"] is None and r["start"] == 0)[:2] == [1, 1]
    assert sum(r["length"] for r in rows if r["doc_tokens"] > 10) == next(r["doc_tokens"] for r in rows if r["doc_tokens"] > 10)
    assert packing.packed(docs.limit(0)).count() == 0 and packing.packed(docs.limit(0), ids=False).count() == 0


def test_query_columns(spark, sf):
    found = catalog.QUERIES["op13_packing"](spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in found.dtypes} == {"bigint"}
