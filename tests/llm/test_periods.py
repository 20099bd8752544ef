import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from tidemark.llm import catalog, periods


def brute(words):
    """All runs (start, length, period) straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // periods.TIMES + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(periods.LEAST, periods.TIMES * q):
                found.setdefault((at, end - at + q), q)
            at = end
    return sorted((s, length, q) for (s, length), q in found.items())


def strange(rng, n):
    """Words with runs of many periods, inside each other and side by side."""
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.3:
            words += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        else:
            unit = [rng.choice("ab" if kind < 0.7 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
            words += (unit * 12)[: rng.randint(10, 12 * len(unit) + 10)]
            if kind > 0.8:
                words += words[-len(unit) * 6 :] * 3
    return words[:n]


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    given = [strange(rng, rng.choice([0, 1, 23, 24, 25, 60, 200, 333, 700])) for _ in range(150)]
    given += [["a"] * n for n in (23, 24, 25, 100, 500)] + [list("ab") * 200, list("aab") * 100 + list("aba") * 100]
    docs = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(given)], "doc_id bigint, text string")
    for r in periods.periodic_runs(docs).collect():
        words = given[r["doc_id"]]
        expected = brute(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == expected, words
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone) and r["n_words"] == len(words)


def test_z_function_equals_its_definition():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40, 300):
        for letters in (1, 2, 5):
            t = rng.integers(0, letters, n)
            if n > 20:
                t[n // 3 :] = np.resize(t[: max(n // 7, 1)], n - n // 3)
            z = periods._z(t)
            for i in range(1, n):
                length = next((k for k in range(n - i) if t[k] != t[i + k]), n - i)
                assert z.get(i, 0) == length


def test_one_long_document(spark):
    rng = random.Random(2)
    unit = [f"w{rng.randint(0, 900)}" for _ in range(4_321)]
    words = [f"x{i}" for i in range(777)] + unit * 5 + unit[:100] + ["end"]
    row = periods.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(777, 5 * 4_321 + 100, 4_321)]
    assert row["collapsed"].split() == words[: 777 + 4_321] + ["end"]


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    run = "a b " * 20
    given = [(1, run, 1), (1, run, 2), (None, run, 3), (None, None, 4), (2, "", 5), (3, " \t\n", 6), (1, "x", 7), (4, "é é " * 30, 8)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, row bigint").selectExpr("*", "row as n", "row as runs", "row as period")
    rows = periods.periodic_runs(docs).collect()
    assert len(rows) == len(given)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], len(r["runs"]), r["collapsed"]) for r in rows)) == sorted(
        [(False, 1, 40, 1, "a b"), (False, 1, 40, 1, "a b"), (True, 0, 40, 1, "a b"), (True, 0, 0, 0, ""), (False, 2, 0, 0, ""), (False, 3, 0, 0, ""), (False, 1, 1, 0, "x"), (False, 4, 30, 1, "é é")]
    )
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op12_periods"](spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert set(rows) == {i for i, _ in docs}
    for i, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if n > 1_500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        r = rows[i]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
