import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and columns whose names clash."""
    dice = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(i, text(dice.randrange(1, 80)), "en", f"s{i % 3}") for i in range(30)]
    for i in range(30, 70):  # near copies at all distances
        w = base.split()
        for _ in range(dice.randrange(0, 5)):
            w[dice.randrange(len(w))] = dice.choice(vocabulary)
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(i, f"{passage}\n{text(12)}", "de", None) for i in range(70, 90)]
    rows += [(i, base.upper(), None, "s1") for i in range(90, 95)]
    rows += [(95, None, "en", "s1"), (96, "", None, None), (97, " \n\t\n ", "en", "s2"), (98, "one two", "fr", "s2"), (99, "One  two", "fr", "s2"), (100, text(9000), "en", "s3")]
    rows += [(101, "ünï çödé 12345 \U0001f600 " * 20, "xx", "é"), (98, "one two", "fr", "s2"), (None, text(30), "en", "s0"), (102, "12 34 --- 56", "en", "s2")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    clash = ["n", "h", "kind", "size", "target", "taken", "sid", "words", "rank", "level", "print", "line", "start", "window", "_id", "root", "token", "hits", "lam"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
