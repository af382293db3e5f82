import pytest
from pyspark.sql import functions as F

WORDS = "the river runs past an old mill and tall trees stand along this quiet road to market town in green valley below".split()


def prose(n: int, seed: int) -> str:
    """n words that look like text and repeat nothing for long."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er", str(rng.randrange(9))]) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, copies, near copies, ties, a long text, and columns whose names clash with inner ones."""
    long = prose(4000, 1)
    texts = [
        (1, prose(120, 2), "a"), (2, prose(120, 2), "b"), (3, None, "a"), (4, "", None), (5, "  \n\t ", "c"), (6, long, "a"), (7, prose(130, 3) + "\nshared line of some words\n" + prose(90, 4), "b"),
        (8, "shared line of some words\n" + prose(70, 5), "c"), (9, prose(120, 2).replace("mill", "moon", 1), None), (10, "ö😀ü #*| it's we'll 1234  a\x1cb   x", "a"), (11, "one two", "a"), (12, "x" * 5000, "b"), (None, prose(60, 6), "c"), (13, prose(120, 2), "a"), (13, prose(120, 2), "a"),
        (14, "Orre " * 300, "b"), (15, long[1000:9000], "c"), (16, "one two", "b"),
    ]
    rows = [(i, t, "en", s, None if t is None else len(t), 1, "y") for i, t, s in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` long, `_fp` string")
    clashes = "_row _id _of _trusted _mix_id _mix_n _text _k0 _hash _shard id of all i r first no digest raw target bucket kept score".split()
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit(""))).alias(c) for c in clashes])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
