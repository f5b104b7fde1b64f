import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, cls int, word string, part int, row long, n int, label int, score double, `a.b` int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, "k", 1, "w", 3, 2, 1, 0, 0.5, 1) for i, t in rows], SCHEMA)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, copies, near copies, repeated rows and ids, a very long text."""
    rng = random.Random(4)
    base = _words(rng, 120)
    passage = _words(rng, 70)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one"), (5, "One two three"), (6, base), (7, base.upper()), (8, base), (8, base), (None, base), (None, None)]
    rows += [(10 + i, " ".join(w if rng.random() > 0.02 else _words(rng, 1) for w in base.split())) for i in range(12)]
    rows += [(30 + i, _words(rng, 30) + "\n" + passage + "\n" + _words(rng, 20)) for i in range(8)]
    rows += [(40 + i, _words(rng, rng.randint(1, 300))) for i in range(40)]
    rows += [(90, _words(rng, 30_000)), (91, "x" * 8_000), (92, "日本語 été ▁ \x00 a\x1cb c"), (93, "<|endoftext|> 1.2.3.4 a@b.co")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return _frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return _frame(spark, [])
