import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """[(doc_id, text)]: prose, exact and near copies, repeated lines and passages, odd and empty texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    lines = lambda k: "\n".join(prose(rng.randint(1, 18)) for _ in range(k))
    passage, block, texts = prose(60), lines(4), []
    for _ in range(60):
        texts.append(lines(rng.randint(1, 14)))
    for _ in range(20):
        texts.append(f"{lines(3)}\n{passage}\n{lines(2)}")
        texts.append(f"{lines(3)}\n{block}\n\n{lines(2)}")
    base = prose(150).split(" ")
    for _ in range(70):  # near copies of all degrees
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[5]] * 9 + [texts[5].upper()] * 3 + ["same words only"] * 4 + ["one"] * 2
    texts += ["", None, " \n\t ", "\n\n", "the end " * 80, "a b c d e f " * 3, ("x" * 30 + "\n") * 9, "é" * 50, "q" * 30_000, "w " * 9_000]
    texts += ["# * $ % & | < > " * 20, f"{prose(70)} # heading", lines(60)]
    return list(enumerate(texts, start=1))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = ["size", "row", "key", "node", "a", "b", "id", "version", "block", "order", "salt", "rank", "word", "n", "rest", "target", "h1", "start", "stop", "kept", "words", "copy", "a.b"]
    return documents.select("*", *[F.lit(1).alias(c) for c in extra])
