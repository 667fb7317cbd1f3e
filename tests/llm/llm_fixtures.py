import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for that with his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


@pytest.fixture()
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra
    columns whose names operators might use."""
    long = " ".join(WORDS[i * i % 40] + str(i % 97) for i in range(30000))
    near = " ".join(WORDS[i * 7 % 40] for i in range(200))
    rows = [(1, "a plain text of a few words", "en", "s1", 27), (1, "a plain text of a few words", "en", "s1", 27), (None, "no id here", "en", None, 10),
            (None, None, None, None, None), (2, "", "en", "s1", 0), (3, None, "de", "s2", None), (4, " \n\t ", None, "s2", 4), (5, long, "en", "s1", len(long)),
            (6, near, "en", "s2", 900), (7, near + " tail", "en", "s2", 905), (8, "write to bob.x@mail.example.com or +1 (555) 123-4567", "en", "s3", 50),
            (9, "one", "en", "s3", 3), (10, "一 二 三 😀 é", "zh", "s3", 9)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("piece", "start", "kind", "score", "node", "key", "h", "slot", "row", "uid", "section", "predicted", "_h")})


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
