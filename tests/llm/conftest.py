import os
import random

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts():
    """Words of a small invented language, and documents of them."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, size=60, seed=1: [" ".join(r.choice(words) for _ in range(size)) for r in [random.Random(seed)] for _ in range(n)]


#: Null, empty, blank, one letter, marks only, other scripts, very long: every operator takes them all.
ODD = [None, "", "   ", "a", "!!!", "漢字 🙂 text", "퟿\n\t x", "word " * 30_000, "x" * 100_000]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, twice each, with null and repeated ids, null sources and columns of clashing names."""
    rows = [(k if k % 3 else None, t, "en" if k % 2 else None, None if k % 4 else "s", k, "mine", 0.5, "x") for k, t in enumerate(ODD + ODD)]
    rows.append(rows[1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double, part string")


@pytest.fixture(scope="session")
def empty_documents(odd_documents):
    return odd_documents.limit(0)
