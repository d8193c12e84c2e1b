import random

import pytest

from helpers import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["uid", "row", "fp", "root", "size", "spans", "near", "score", "lang_pred", "taken", "rank", "units", "value", "_text"]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every odd kind: null, empty, blank, without letters, very long, repeated."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    return [None, "", " \t\n", "123 456 !!", "a", "one two", "x" * 100_000, long, long, "𝄞 é ß İ Σ\u00a0ς\u2028 <|endoftext|> don't", "Licensed under the MIT License.", "\ue000\ue001 a@b.cd"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Documents of odd texts with nulls in every column and with repeated rows and ids."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[5], (5, "another text of the same id", "de", "s1", 3), (None, "no id at all here", "en", "s0", 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit(7) for c in CLASHES})
