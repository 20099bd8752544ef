import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import substrings


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 400))) for _ in range(8)]
    out = [(i, "".join(rng.choice(passages)[rng.randint(0, 30) : rng.randint(100, 400)] for _ in range(rng.randint(0, 5)))) for i in range(100)]
    return out + [(200, "a" * 1500), (201, "ab" * 700), (202, None), (203, ""), (204, "a" * 99), (205, "a" * 100), (None, "a" * 120)]


@pytest.mark.parametrize("hot", [5_000, 3])
def test_equals_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)  # 3: anchors cut into narrow ranges of offsets
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, bucket string, kind string")
    got = substrings.without_repeats(df, digest=True, bucket_bytes=4_000).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    other = "".join(chr(97 + i * 7 % 25) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, other)], "doc_id bigint, text string")
    got = sorted(tuple(r[:4]) for r in substrings.without_repeats(df).collect())
    inside = brute([(1, text)])[1][1]
    assert got[0] == got[1] and got[0][2] == inside
    assert (2, 300, 300, 1) in got
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_a_third_of_the_ids_null(spark, rows):
    texts = sorted({t for _, t in rows if t}, key=len)
    df = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["kept_sha256"]) for r in substrings.without_repeats(df, digest=True, bucket_bytes=2_000).collect())
    order = [(None, substrings.text_hash(t.encode()), t) for i, t in enumerate(texts) if i % 3 == 0]
    given = [t for _, _, t in sorted(order, key=lambda x: x[1])]
    # The null ids come first, in the order of their text hashes.
    numbers = {k - len(given): t for k, t in enumerate(given)} | {i: t for i, t in enumerate(texts) if i % 3}
    expected = brute(sorted(numbers.items()))
    assert got == sorted((i >= 0, max(i, 0), expected[i][3]) for i in numbers)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 700)
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(2500))
    rows = [(1, base), (2, base[300:2100] + "x" + base[100:900])]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)


def test_suffix_order_against_plain_sort():
    rng = np.random.default_rng(5)
    b = rng.integers(97, 99, 900).astype(np.uint8)
    at = rng.integers(0, 800, 300)
    size = rng.integers(1, 100, 300)
    group = rng.integers(0, 7, 300)
    order, common, ok = substrings.suffix_order(substrings.Pool(b, 0x9E3779B97F4A7C15), at, size, group)
    texts = [(group[i], b[at[i] : at[i] + size[i]].tobytes()) for i in range(300)]
    assert ok and [texts[i] for i in order] == sorted(texts)
    for k in range(1, 300):
        (g, x), (h, y) = texts[order[k - 1]], texts[order[k]]
        shared = next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[k] == (shared if g == h else -1)
    even = substrings.Pool(b, 1)  # a base of 1 collides on reordered bytes: the order must not pass as verified
    assert not substrings.suffix_order(even, at, size, group)[2]
