import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): plain texts, exact and near copies, repeated lines, odd characters, empties, null."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 150)) for _ in range(60)]
    base = sentence(rng, 120).split()
    for _ in range(25):
        w = list(base)
        for i in rng.sample(range(120), rng.randint(1, 12)):
            w[i] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["", " \t\n", None, "one", "One", "two words", "TWO words"]
    notice = "  All Rights reserved. "
    texts += [f"{sentence(rng, 10)}\n{notice if i % 2 else notice.upper()}\n{sentence(rng, 5)}\n" for i in range(14)]
    texts += ["é́ 日本語 ﬁ", "tab\tand\x0bvertical\x0cfeed\r\nend", "  double  spaces  ", "▁mark ▁", "<|endoftext|> <s>", "x" * 50_000, "ab " * 20_000]
    texts += ["mail a.b@c-d.org or 10.0.0.256 10.0.0.25 4111 1111 1111 1111 +49 (30) 1234567", "IBAN DE89 3704 0044 0532 0130 00 and token = 0123456789abcdef0123456789abcdef"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names clash with results."""
    rows = [(None, "a b c d e f", "k", 7), (3, "a b c d e f", "k", 8), (3, "a b c d e f", "k", 8), (4, None, None, None), (None, None, None, None), (5, "", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
