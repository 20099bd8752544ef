import numpy as np
import pytest

from tidemark.llm import catalog, whitening

SHAPE = "vec_id bigint, embedding array<float>, label int, n bigint, whitened string, dims int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 7, "x", 1) for i, v in vectors], SHAPE)


def by_hand(vectors):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in vectors], object)
    apart = len(x) * x - x.sum(axis=0)
    return (apart * apart).sum(axis=1), (apart.T @ apart).astype(float) / len(x) ** 3, apart.astype(float) / len(x)


def test_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    given = [(i, (rng.normal(size=11) * (1 + np.arange(11))).astype(np.float32).tolist()) for i in range(700)]
    given += [(i, v) for i, v in given[:40]] + [(None, given[5][1])]
    rows, fit = whitening.whitened(table(spark, given).repartition(5))
    deviation, v, centred = by_hand(given)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    got = sorted(rows.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    places = sorted(range(len(given)), key=lambda k: (given[k][0] is None, given[k][0]))
    assert [int(r["deviation"]) for r in got] == [int(deviation[k]) for k in places]
    found = np.array([r["whitened"] for r in got])
    signs = np.sign(found[0] * white[places[0]])
    assert np.abs(found * signs - white[places]).max() < 1e-9
    assert np.allclose(fit.explained, values[order] / values.sum(), rtol=1e-9)
    assert whitening.identity_error(rows, 8) < 1e-9


@pytest.mark.parametrize("width", [1, 3, 23, 40])
def test_products_of_any_width_are_exact(width):
    rng = np.random.default_rng(width)
    y = rng.integers(0, 2**width, (130, 3))
    y[:, 1] = 0
    found = whitening.cross_products(y, np.full(3, width))
    exact = y.astype(object).T @ y.astype(object)
    assert all(int(found[i, j]) == int(exact[i, j]) for i in range(3) for j in range(i, 3))


def test_very_large_entries(spark):
    given = [(1, [1e15, 0.5]), (2, [-1e15, 0.25]), (3, [3e14, -1.0])]
    rows, _ = whitening.whitened(table(spark, given))
    deviation, _, _ = by_hand(given)
    assert {r["vec_id"]: int(r["deviation"]) for r in rows.collect()} == {i: int(d) for (i, _), d in zip(given, deviation)}


def test_unusable_vectors_are_dropped(spark):
    good = [(i, [float(i), float(i * i), 1.0]) for i in range(6)]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [float("nan"), 1.0, 1.0]), (14, [1.0, float("-inf"), 1.0]), (15, [1.0, 2.0]), (16, [3e38, 0.0, 0.0])]
    rows, fit = whitening.whitened(table(spark, good + bad))
    long = whitening.long_form(rows, fit).collect()
    assert {r["vec_id"] for r in long} == set(range(6)) and {r["n"] for r in long} == {6}
    assert {r["component"] for r in long} == {1, 2}  # one dimension has no spread
    assert max(r["identity_error"] for r in long) < 1e-9


def test_no_rows_and_no_spread(spark):
    for given in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        rows, fit = whitening.whitened(table(spark, given))
        assert whitening.long_form(rows, fit).count() == 0


def test_query_columns(spark, sf):
    found = catalog.QUERIES["op11_whitening"](spark, sf)
    kinds = dict(found.dtypes)
    assert list(kinds) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [kinds[c] for c in ("component", "n", "deviation", "whitened")] == ["int", "bigint", "bigint", "double"]
    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter(whitening.usable()).count()
    assert found.count() == 8 * n and found.filter("deviation is null").count() == 0
