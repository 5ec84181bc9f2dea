import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ("id", "body", "n", "len", "rep", "root", "block", "words", "score", "prob", "row", "label", "u", "v")


@pytest.fixture(scope="session")
def corpus():
    """Small documents with nulls, empties, copies, near copies, shared passages and a long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    base = text(120).split()
    rows = [None, "", " \n\t ", "one", "one two", "A b C", "a B c", text(49), text(50), passage, f"{text(5)} {passage}\n{text(7)}", f"{passage}  {passage}", text(4000)]
    rows += [" ".join(base), "  ".join(base)]
    for i in range(40):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append(" ".join(near))
    rows += [text(rng.randint(1, 80)) for _ in range(40)]
    rows += ["Licensed under the Apache License, Version 2.0.\nmore", "all rights  reserved CC BY cc by", "General public license, ALL RIGHTS RESERVED", "été CC-BY-NC über 中文 a\u0000b", "x" * 5000]
    out = [(i, t, ("en", "de", "fr", None)[i % 4], f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return out + [out[20], out[5]]  # repeated rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
