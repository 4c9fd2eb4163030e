import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers

WORDS = "the of and then inge thonre anea loser wh tion edst ombre élan straße ciónmente 漢字 x1 don't".split()


@pytest.fixture(scope="session")
def vocab():
    return public_tokenizers.path


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empties, blanks, copies, near copies, a very long text and columns with clashing names."""
    rng = random.Random(3)
    base = text(rng, 60)
    near = base.replace(" the ", " a ", 1)
    rows = [(1, base, "en", "s1"), (2, base, "en", "s2"), (3, near, "en", "s3"), (4, None, None, None), (5, "", "fr", "s1"), (6, " \n\t ", "de", "s1"), (None, "no id", "en", "s1"), (8, "one two", "en", None), (9, text(rng, 40_000), "en", "s2"), (10, "naïve 漢字 \U0001f600 ''s don't", "fr", "s9"), (1, base, "en", "s1")]
    rows += [(100 + i, text(rng, rng.randint(1, 80)) + "\n" + base[: 40 + i], "en", f"s{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"h": F.lit(1), "k": F.lit("x"), "c": F.lit(2), "key": F.lit("y"), "a.b": F.lit(3)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
