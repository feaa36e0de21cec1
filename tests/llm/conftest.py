"""Documents with every edge the operators define, and a table without rows."""

import pytest

TEXT = "the quick brown fox jumps over the lazy dog while nine small birds sing in the old tree near the river bank today"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, key int, `_row` string, component string"


def rows():
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    texts = [TEXT, TEXT, TEXT + " now", None, "", "   ", "one", "Été à Ÿ", long, "a\nb\n\n" + TEXT, TEXT.upper()]
    out = [(i, t, "en", None if i == 4 else f"s{i % 3}", None if t is None else len(t), "x", i, "r", "c") for i, t in enumerate(texts)]
    out += [(0, TEXT, "en", "s0", len(TEXT), "x", 0, "r", "c")] * 2  # repeated rows
    out += [(None, TEXT, None, "s1", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
