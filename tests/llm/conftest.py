import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Columns with names that the operators use themselves.
EXTRA = "size long, target long, fp string, __file string, __f long, __row string, score string, ids string, __doc int, kept int, digest int"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def odd_texts() -> list:
    """Nulls, blanks, copies, ties, and a very long text."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b = say(60), say(90)
    return [None, None, "", "", " \t\n", "one", "one", "One", "two words", a, a.upper(), a + " end", b, b, b + "\n" + a,
            say(30) + "\n" + a, "x" * 3000, "é\u2581ñ \U0001F600\x00", "\n\n\n", say(40_000), say(200), say(100), say(3)]


@pytest.fixture
def odd_docs(spark):
    """Documents with odd texts, ids and sources, repeated rows and extra
    columns; ids are unique but for one repeated row and two nulls."""
    texts = odd_texts()
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "ä", ""][i % 5], 0) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id", None, None, None), (None, None, None, None, None)]
    full = [(*r, 1, 2, "f", "p", 3, "r", "s", "i", 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
