import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words=12, vocabulary="abcdefghij"):
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(2, 7))) for _ in range(words)).capitalize() + "."


def passage(rng, sentences=6):
    return " ".join(sentence(rng, rng.randint(8, 14)) for _ in range(sentences))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, no words, repeats, near copies, shared passages, a very long one."""
    rng = random.Random(3)
    base, shared = passage(rng, 20), passage(rng, 8)
    near = base.split(" ")
    near[30] = "zzz"
    rows = [None, "", "   \n\t ", "!!! 123 ...", "One", "one", "a b c", "a b c", base, base, " ".join(near),
            base.upper(), passage(rng, 3) + " " + shared + " " + passage(rng, 3), shared + "\n" + passage(rng, 5),
            passage(rng, 4) + "\n" + shared, "la " * 500, "é è ü " * 60, passage(rng, 400)]
    return rows + [passage(rng, rng.randint(1, 9)) for _ in range(25)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids are not in order, two rows are repeated whole, one id is null; extra columns clash with working names."""
    rows = [((i * 37) % 101, t, "en" if i % 2 else "de", [None, "s1", "s2", "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[5], (None, texts[13], None, "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "1 AS size", "2 AS _key", "'x' AS n_words", "3 AS `key`", "'y' AS label", "4 AS _tie",
                         "5 AS copy", "6 AS score", "'z' AS `dotted.name`")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
