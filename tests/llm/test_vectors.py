import numpy as np
import pytest
from util import least_reachable

from tidemark.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, tile int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(90):
        base = rng.normal(size=24)
        for _ in range(1 + i % 3):
            out.append((base + rng.normal(size=24) * 0.12 * (i % 4)).astype(np.float32).tolist())
    out = [(i, v, i % 3, "n", 0) for i, v in enumerate(v for v in out)]
    out = [(i, v, (i // 3) % 2, "n", 0) for i, v, *_ in out]
    out += [(900 + k, out[5][1], out[5][2], "n", 0) for k in range(4)] + [(5, out[5][1], out[5][2], "n", 0)]
    bad = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23]
    out += [(950 + k, v, 0, "n", 0) for k, v in enumerate(bad)]
    out += [(960, out[0][1], None, "n", 0), (961, [1.0, 2.0], 0, "n", 0), (962, [2.0, 4.0], 0, "n", 0), (963, [3e38] * 24, 1, "n", 0), (964, [1e-38] * 24, 1, "n", 0)]
    return out


def brute(rows):
    keyed = list(enumerate(rows))
    unit = {}
    for k, (_, v, label, *_) in keyed:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            x = np.array(v, np.float64)
            unit[k] = (label, len(v), x / np.linalg.norm(x))
    linked = lambda a, b: a in unit and b in unit and unit[a][:2] == unit[b][:2] and float(unit[a][2] @ unit[b][2]) >= 0.93
    root = least_reachable(range(len(rows)), linked)
    least = {}
    for k, (i, *_) in keyed:
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, sum(linked(k, j) for j in range(len(rows)) if j != k), least[root[k]], i == least[root[k]]) for k, (i, *_) in keyed)


@pytest.mark.parametrize("tile", [1024, 16])
def test_equals_brute_force(spark, rows, tile):
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_null_ids_and_empty_table(spark, rows):
    v = [1.0, 0.5, 0.25]
    df = spark.createDataFrame([(None, v, 1), (4, v, 1), (None, [0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 40)), rng.normal(size=(200, 40))
    y[:50] = x[:50] + rng.normal(size=(50, 40)) * 0.4
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a, b = vectors._close_pairs(x, y, axes, 0.9)
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, (w.tolist() for w in np.nonzero(cos >= 0.9)))))
