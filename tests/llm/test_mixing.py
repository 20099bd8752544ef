import hashlib

import pytest
from pyspark.sql import functions as F
from util import python_nodes

from tidemark.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what is above twice a source's size goes round again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7}" if i % 11 else None, "a", "b") for i in range(3000)]
    rows += [(9000, None, "s0", "a", "b"), (9001, "", "only empty", "a", "b"), (None, "x y z", "s1", "a", "b"), (1, "again and again", "s3", "a", "b")]
    rows += [(9002, "long " * 30_000, "s2", "a", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, _seed string")


def test_targets_and_totals(docs):
    out = mixing.mixture_sizes(docs)
    assert not python_nodes(out)
    rows = out.collect()
    text = {}
    sizes = {}
    for r in docs.collect():
        n = len((r["text"] or "").replace("\n", " ").split(" ")) - (r["text"] or "").split(" ").count("") if r["text"] else 0
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        text.setdefault(r["doc_id"], []).append(n)
    want = plain_targets(sizes)
    assert len(rows) == docs.count()
    assert sorted((r["source_size"], round(r["target"], 6)) for r in set((x["source_size"], x["target"]) and x for x in rows)) and {
        (r["source_size"], round(r["target"], 6)) for r in rows
    } == {(sizes[s], round(want[s], 6)) for s in sizes}
    for r in rows:
        assert r["size"] in text[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    again = {tuple(r) for r in mixing.mixture_sizes(docs.repartition(5)).collect()}
    assert again == {tuple(r) for r in rows}
    total = sum(r["taken"] for r in rows)
    assert abs(total / sum(want.values()) - 1) < 0.02


def test_rows_are_emitted_as_often_as_taken(docs):
    taken = mixing.mixture_sizes(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and not python_nodes(out)
    words = out.groupBy("doc_id").agg(F.sum(mixing.words("text")).alias("n")).filter("n > 0")
    assert sorted(map(tuple, taken.collect()), key=str) == sorted(map(tuple, words.collect()), key=str)


def test_draws_and_empty_table(spark, docs):
    row = spark.createDataFrame([(5,)], "doc_id bigint").select(*mixing.draws()).first()
    digest = hashlib.sha256(b"0:5").hexdigest() + hashlib.sha256(b"1:5").hexdigest()
    assert list(row) == [int(digest[i : i + 8], 16) for i in range(0, 128, 8)]
    assert mixing.mixture_sizes(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    none = docs.filter("text is null")
    assert [r["taken"] for r in mixing.mixture_sizes(none).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.targets(docs, share=3)


def test_rows_without_an_id_meet_their_targets(spark):
    """All ids null, a third of the rows one and the same row: each source still comes within 1 % of its target."""
    rows = [(None, "w " * (1 + i % 37), f"s{i % 5}", i) for i in range(6000)] + [(None, "one and the same", "s1", 0)] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _p int")
    out = mixing.mixture_sizes(docs)
    taken = out.groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert len(taken) == 5 and all(abs(r["n"] / r["target"] - 1) < 0.01 for r in taken)
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(out) == order(mixing.mixture_sizes(docs.repartition(7)))
    emitted = mixing.mixed(docs)
    assert emitted.columns == docs.columns and not python_nodes(emitted)
    words = emitted.agg(F.sum(mixing.words("text"))).first()[0]
    assert words == sum(r["n"] for r in taken)
