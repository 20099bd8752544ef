import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def plain_phrases(text, samples):
    n, i = 1, 0
    now = ""
    while i < len(text):  # a phrase ends where it stops being part of a sample; its next character starts a new one
        if any(now + text[i] in s for s in samples):
            now += text[i]
        else:
            n += 1
            now = text[i] if any(text[i] in s for s in samples) else ""
        i += 1
    return n


def test_parsing_equals_plain_longest_matches():
    rng = random.Random(2)
    samples = ["".join(rng.choice("abcd ") for _ in range(200)) for _ in range(3)]
    table = langid.alphabet(samples)
    codes = [table[np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)] for s in samples]
    model = {"alphabet": table, "langs": ["x"], "tables": [langid.automaton(codes)], "sizes": [600]}
    texts = ["".join(rng.choice("abcdez ") for _ in range(n)) for n in (0, 1, 50, 256, 257, 900)]
    counts, sizes, letters = langid.phrases(model, texts)
    for text, got in zip(texts, counts[:, 0]):
        lanes = [text[i : i + langid.LANE] for i in range(0, len(text), langid.LANE)]
        # letters outside the sample share classes that the sample lacks
        assert got == sum(plain_phrases(lane.replace("z", "e").replace("e", "\0"), samples) for lane in lanes)
    assert letters.tolist() == [False, True, True, True, True, True]


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    learn = [(i, w, lang, "s") for i, (w, lang) in enumerate([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")] * 20)]
    ask = [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 !?", "de", "s"), (None, "und die katze", None, "s"), (903, "THE DOG", None, "s"), (903, "THE DOG", None, "s")]
    ask.append((904, "the dog and the cat " * 20_000, None, "s"))
    df = spark.createDataFrame(learn + ask, schema)
    got = [tuple(r) for r in langid.languages(df).filter("doc_id is null or doc_id >= 900").select("doc_id", "lang_pred", "held_out").collect()]
    named = {(a, b) for a, b, _ in got}
    assert named == {(900, "und"), (901, "und"), (902, "und"), (None, "de"), (903, "en"), (904, "en")} and len(got) == 7
    assert not [h for i, _, h in got if i is None][0]
    assert langid.accepted(df).count() == len(learn) + 4 and langid.accepted(df).columns == df.columns
    nothing = spark.createDataFrame(ask, schema).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(nothing).collect()} == {"und"}
    assert langid.languages(df.limit(0)).count() == 0
