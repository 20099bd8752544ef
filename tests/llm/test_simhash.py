import random

import pytest
import xxhash
from util import least_reachable

from tidemark.llm import simhash
from tidemark.llm.graph import components

SCHEMA = "doc_id bigint, text string, fp string, key string, component_id string, n int"


def plain_fingerprint(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["The", "Quick", "été", "x y", "Ünder", "fox", "dog", "ran", "far", "AWAY"]
    out = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\t\n ".join(copy))
    out += [out[0], None, "", " \n", "one", "One two", "a b c " * 3000]
    return [(i, t, "f", "k", "c", 1) for i, t in enumerate(out)]


def test_equals_brute_force(spark, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fp = {i: plain_fingerprint(t) for i, t, *_ in rows}
    low = least_reachable(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert got == {i: (f"{fp[i]:016x}", low[i]) for i in fp}
    assert any(low[i] != i for i in fp) and fp[len(rows) - 6] == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_of_close_fingerprints(spark, distance):
    rng = random.Random(distance)
    centre = rng.getrandbits(64)
    fps = {0, (1 << 64) - 1, centre}
    for _ in range(60):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    low = least_reachable(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
    for hot in (2_000, 1):  # also with every shared segment value treated as hot
        found = {r["node"]: r["root"] for r in components(simhash.links(classes, distance, hot), "fp", "other").collect()}
        assert {f: found.get(f, f) for f in signed} == low
    with pytest.raises(ValueError):
        simhash.links(classes, 4)


def test_null_ids_repeated_rows_and_empty_table(spark):
    same = "to be or not to be that is it"
    rows = [(None, same), (7, same), (7, same), (5, same), (None, "other words here"), (5, "something else entirely now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(simhash.near_duplicates(df).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 5), (7, 5), (7, 5), (5, 5), (None, None), (5, 5)], key=lambda r: f"Row(doc_id={r[0]}, component_id={r[1]})")
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.deduplicated(df).filter("doc_id = 7").count() == 0


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(None, 3), (9, 9), (100, 101)], "a bigint, b bigint")
    assert {tuple(r) for r in components(path, "a", "b").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_deduplicated_keeps_one_row_of_each_component(spark):
    same, other, third = "to be or not to be that is it", "something else entirely now", "and a third text of its own"
    rows = [(None, same), (7, same), (7, same), (5, same), (5, same), (5, other), (3, other), (None, "no id here"), (None, "no id here"), (9, third), (9, third + "!")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, row int")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=str)
    assert got == sorted([(5, same), (3, other), (None, "no id here"), (9, third), (9, third + "!")], key=str)
