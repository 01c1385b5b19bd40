import random

import pytest

DOCS = "doc_id long, text string, keep_id string, N_TOKENS int"
ODD = ["", None, " ", "\t\n", "a", "A", "Hello, world! it's we'll", "<|endoftext|> x<|startoftext|>", "<|im_end|><|im_start|>assistant ok", "é e\u0301 ß İ Σ", "中文 字 👍🏽", "1234 56", "x" * 5000, "  two  blanks ", "'re 're", "\x1c\x85\u00a0x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and further columns with clashing names."""
    r = random.Random(7)
    words = ["th" + "".join(r.choice("aeinorst") for _ in range(r.randint(1, 6))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    texts = [*ODD, long, long.upper(), " ".join(r.choice(words) for _ in range(400))]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    rows += [(100, "Same", "k", None), (101, "same", None, 2), (102, "sAme", "k", 3), (103, "tie", "k", 4), (103, "tie", "k", 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
