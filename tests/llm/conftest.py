"""Small corpora that hold the awkward cases: nulls, empty and very long texts,
repeated rows, shared passages, near copies, odd characters."""

import random

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def corpus_rows(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["É", "straße", "Ωmega"]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = words(60)
    texts = []
    for i in range(40):
        w = words(rng.randint(1, 120))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        lines = [" ".join(w[j:j + 9]) for j in range(0, len(w), 9)]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), "  Licensed Under X \t")
        if i % 3 == 0:
            lines.append("licensed under x")
        texts.append("\n".join(lines))
    base = words(80)
    for i in range(6):                      # near copies
        w = list(base)
        if i:
            w[rng.randrange(len(w))] = "changed%d" % i
        texts.append(" ".join(w))
    texts += [texts[5]] * 3 + ["", None, "   \n\t ", None, "one", "two words", "a\x0bb\x0cc \x1c d", "AKIA" + "A1" * 10]
    texts.append(" ".join(words(6000) + passage + words(2000)))     # very long
    rows = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[2], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    """An empty documents table."""
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """``docs`` with columns named like what operators make or use inside."""
    from pyspark.sql import functions as F
    names = ("n_lines n_dropped n_words n_hit n_removed item_ids hit_bits point score findings key node anchor "
             "segment a b n kind block sub component component_id text_hash bin_id offset training tune ids").split()
    return docs.withColumns({n: F.lit("own") for n in names})
