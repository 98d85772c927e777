import random

import pytest

from tests.conftest import SF01

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash long, tokens string, key string, id long, digit string"


def prose(rnd, n):
    return " ".join(rnd.choice(("red", "Blue", "green", "grün", "été", "seven", "ox", "Tree,", "run.", "day", "it's", "x1")) + str(rnd.randrange(40)) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, near copies and shared passages."""
    rnd = random.Random(5)
    passage, lines = prose(rnd, 60), [prose(rnd, 9) for _ in range(4)]
    base = prose(rnd, 300)
    near = base.split(" ")
    near[150] = "other"
    texts = ["", " \n\t ", None, "short", "short", "a b c", prose(rnd, 30) + " " + passage, passage, prose(rnd, 25) + "\n" + passage + "\n" + prose(rnd, 30),
             base, base.replace(" ", "\n \t"), " ".join(near), base + " ", "\n".join(lines), "\n".join(lines[1:] + ["tail of it"]), "x\n" + "\n\n".join(lines[:2]) + "\r\n",
             "\n".join(["same line again here now yes"] * 30), "*** && $$$ " * 12, "LOUD WORDS!! " * 15, prose(rnd, 8000), "one " * 3000,
             "<|endoftext|>it's don't\u00a0ünï\u0301 中文字 x²½ '''", "\u2028\u0085 odd \x1c space", "É" * 500, "日本" * 40 + " " + "語" * 3]
    rows = [(i, t, "en", f"s{i % 3}", i, "r", i, "t", "k", i, "d") for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((9, "another text under the same id", None, None, None, None, None, None, None, None, None))
    rows.append((None, base, "en", "s0", None, None, None, None, None, None, None))
    rows.append((None, "no id here", None, None, None, None, None, None, None, None, None))
    rows.append((None, "no id here", None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    """(doc_id, text) of the sf0.01 documents."""
    return [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def awkward_pairs():
    return [(r[0], r[1]) for r in awkward_rows()]
