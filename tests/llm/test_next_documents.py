"""Which document comes next, over parts of any number, with ids of any type, null and repeated ids, and columns of clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import imatch as I


def expected(rows):
    """(id, digest of the edited text) of each row; rows of null ids come last, in order of their texts."""
    order = sorted(((i is None, i if i is not None else 0, t or "") for i, t in rows), key=lambda r: (r[0], str(r[1]) if isinstance(r[1], str) else r[1], r[2].encode()))
    out = []
    for k, (unknown, i, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][2], len(text) // 2
        out.append((None if unknown else i, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


CASES = {
    "ids": [(k * 37 % 211, f"text number {k} " * 3) for k in range(211)],
    "string ids": [(f"id-{k * 37 % 211}", f"words {k}") for k in range(211)],
    "null ids": [(None if k % 2 else k, f"{k % 60} a text of its own {k % 50}") for k in range(200)],
    "one id": [(7, f"{k} rest of it") for k in range(150)],
    "two rows": [(1, "abcdef"), (0, "ghijkl")],
    "one row": [(1, "abcdef")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rows_per_part", [1, 7, 4000])
def test_the_next_document(spark, case, rows_per_part):
    rows = CASES[case]
    kind = "string" if isinstance(rows[0][0], str) else "long"
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    got = I.fingerprint_edits(df, params=I.ImatchParams(rows_per_part=rows_per_part)).select("doc_id", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_columns_of_clashing_names_are_kept(spark):
    df = spark.createDataFrame([(1, "some words", "mine", "m", "r", "old")], "doc_id long, text string, __text string, __terms string, row string, fingerprint string")
    out = I.fingerprint_documents(df)
    assert out.columns == df.columns
    r = out.first()
    assert (r["__text"], r["__terms"], r["row"]) == ("mine", "m", "r") and r["fingerprint"] != "old"
    assert I.fingerprint_documents(df.drop("fingerprint")).select(F.length("fingerprint")).first()[0] == 8 * 40
