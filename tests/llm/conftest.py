"""Small documents with planted cases for the operators, and the awkward rows that all of them must bear."""
import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside; an input may have them as well.
CLASHING = ("id", "key", "ids", "row", "found", "spans", "group", "anchor", "kept", "fingerprint", "root", "live", "repo", "c0", "part")


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("the and tion er on an re he in ed nd ha at en es or".split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    return [(1, None, "en", "s1", None), (2, "", None, None, 0), (3, " \t\n\r\v\f", "en", "s1", 6), (4, "one", "xx", "s2", 3), (5, "one two", None, "s2", 7),
            (6, "a " * 20_000, "en", "s1", 1), (6, "a " * 20_000, "en", "s1", 1), (None, words(9, 80), "en", "s3", 5), (None, words(9, 80), None, "s3", 5),
            (7, "日本語 テスト 😀😀 é\u0301 \u00a0 \u2581x \x00 <|im_end|> <s> <0x0A>", "ja", "s1", 9), (8, "x" * 3000, "en", "s1", 3000)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    out = awkward()
    shared = words(500, 60)
    for i in range(20):
        body = words(i, 70 + i)
        out.append((100 + i, body, "en", f"s{i % 7}", len(body)))
        if i % 4 == 0:  # exact copies, near copies, and a passage in the middle of other text
            out.append((200 + i, body, "en", f"s{i % 5}", 0))
            out.append((300 + i, body + " end", "en", f"s{i % 3}", 0))
            out.append((400 + i, words(600 + i, 40) + " " + shared + " " + words(700 + i, 40), "en", "s1", 0))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns of awkward names."""
    return docs.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    """Rows as tuples in one order, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
