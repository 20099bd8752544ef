import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark.llm import pieces

OURS = pieces.Pieces(pieces.MODEL)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@given(st.text(alphabet=st.one_of(st.sampled_from("theaniosr  \n.,é漢😀▁1"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_equals_the_model(text):
    ids = OURS.encode([text])[0].tolist()
    assert ids == THEIRS.encode(text, num_threads=1)
    assert OURS.decode(ids) == text.replace(pieces.SPACE, " ")


def test_borders_against_plain_merging():
    rng = random.Random(1)
    some = rng.sample(sorted(OURS.ids), 3000)
    for a, b in zip(some, some[1:]):
        whole = all(OURS.merged(p) == [p] for p in (a, b))
        assert OURS._may_follow(a, b) == (whole and OURS.merged(a + b) == [a, b])


def test_words_share_states_of_common_prefixes():
    words = ["▁the", "▁them", "▁theme", "▁then", "▁a", "▁", "▁▁▁x", "zzz"]
    one = {w: OURS.segment([w])[w] for w in words}
    assert OURS.segment(words) == one


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "hello  world", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (None, "▁ mark", "x", "y"), (1, "hello  world", "x", "y"), (4, "a" * 50_000 + " b" * 50_000, "x", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, tokens string, part string")


def test_columns_of_a_table(docs):
    rows = pieces.encoded(docs).collect()
    assert pieces.encoded(docs).columns == ["doc_id", "part", "tokens"] and len(rows) == 6
    by = {r["doc_id"]: r["tokens"] for r in rows}
    assert by[2] is None and by[3] == [] and by[1] == THEIRS.encode("hello  world")
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back[1] == "hello  world" and back[2] is None and back[3] == "" and back[None] == "  mark" and len(back[4]) == 150_000
    trip = {r["doc_id"]: r for r in pieces.round_trips(docs).collect()}
    assert all(r["round_trip"] for r in trip.values()) and trip[2]["ids_sha256"] is None and trip[3]["n_tokens"] == 0
    assert trip[1]["decoded_sha256"] == hashlib.sha256(b"hello  world").hexdigest()
    assert pieces.round_trips(docs.limit(0)).count() == 0 and pieces.encoded(docs.limit(0)).count() == 0


def test_tokens_do_not_depend_on_how_many_texts_are_held(spark, monkeypatch):
    texts = [None if i % 11 == 5 else " ".join(f"word{i % 7}{j}" for j in range(i % 9)) for i in range(2_300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["tokens"] for r in pieces.encoded(df).collect()}
    model = pieces.Pieces(pieces.MODEL)
    assert len(got) == len(texts) and all(got[i] == (None if t is None else model.encode([t])[0].tolist()) for i, t in enumerate(texts))
    held = []

    class Counted(pieces.Pieces):
        def encode(self, some):
            held.append(len(some))
            return super().encode(some)

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2_300)), "text": texts})
    frame = Rows(["doc_id", "text"])
    monkeypatch.setattr(pieces, "Pieces", Counted)
    pieces.encoded(frame)
    assert sum(b.num_rows for b in frame.run(iter([batch]))) == 2_300 and max(held) <= pieces.ROWS < 2_300


class Rows:
    """Stands for a table; keeps the function that mapInArrow gets."""

    def __init__(self, columns):
        self.columns = columns
        self.schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def __getitem__(self, name):
        return name

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self
