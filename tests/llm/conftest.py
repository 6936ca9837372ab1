import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, one word, repeated rows, a very long text, near copies, shared passages, ties."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(120)
    out = [None, "", " \n\t ", "one", "Two words", "a b c", base, base, base + " end", passage + "\n" + prose(40), prose(30) + " " + passage, prose(9000)]
    out += [" ".join(base.split()[:k] + [word()] + base.split()[k + 1 :]) for k in range(0, 100, 9)]
    out += [prose(rng.randint(1, 200)) for _ in range(30)] + ["x " * 80, "x " * 80, "aa, 'Bb' C3PO <|endoftext|> 12.5 é!!\x1c z"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3, "doc_id")
    return frame.withColumns({"kept": F.lit("mine"), "_m": F.lit(1), "row": F.lit(7), "_spans": F.lit("x"), "component": F.lit(2)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
