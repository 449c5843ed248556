import random

import pytest

LONG = " ".join(f"w{i * 7919 % 613}" for i in range(4000))


def texts():
    rng = random.Random(5)
    words = ["the", "of", "an", "er", "éa", "Tion", "st.", "ing", "re", "wh", "日本", "42", "x9"]

    def prose(n):
        return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))

    passage = prose(120)
    base = prose(200)
    copies = [base.replace(" ", "  ", 1), base + " end", base.replace("the", "teh", 1)]
    boiler = [f"Copyright {1990 + i} by the made up company number {i}\n{prose(30)}" for i in range(12)]
    return [
        None,
        "",
        "   \n\t ",
        "one",
        "a b a b a b a b a b\na b a b a b a b a b\n" * 12,
        "z" * 3000,
        LONG,
        "<|endoftext|> mid <|startoftext|> it's  double \n\n spaces　wide ",
        "## ** $$ " * 60,
        base,
        base,
        *copies,
        "lead " + passage + " tail one",
        passage + " other tail",
        "x " + passage,
        *boiler,
        *[prose(rng.randint(1, 150)) for _ in range(25)],
    ]


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", None if t is None else len(t), i * 2, "k", 7) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, print long, kept string, shard int"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def bare(spark):
    """Null ids, repeated rows and repeated ids, nulls in every column."""
    data = [(None, None, None), (None, "a b c d e", None), (5, "same text here", "x"), (5, "same text here", "x")]
    return spark.createDataFrame(data + [(6, None, None), (6, "", "y")], "doc_id long, text string, slot string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
