import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ODD_TEXTS = [None, "", " \t\n", "one", "two words", "a b c " * 3000, "same text here, twice.", "same text here, twice.", "\x00 é\U0001f600 <|im_end|>"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, further columns with clashing names."""
    rows = [(i, t, f"s{i % 3}" if i else None, 7) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all", None, None), (8, ODD_TEXTS[8], "s2", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
