"""I-Match fingerprints in DataFrame functions alone.

The terms of a text whose document frequency lies in a band are its lexicon terms. They are sorted, and
those in each of several randomised subsets of the lexicon are hashed. Subsets come in densities, from a
quarter of the lexicon to a thousandth: a text of few terms is told apart by the dense ones, a long text
by the sparse ones, where a small edit often changes nothing.

Document frequencies are counted for hashed terms, in a table of fixed size that holds all documents. Rare
terms that share a cell add the same part of the documents at every size of the corpus, below the band.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cells import with_cells


@dataclass(frozen=True)
class ImatchParams:
    low: float = 0.001  #: least part of the documents that hold a lexicon term
    high: float = 0.05  #: greatest part
    least: int = 2  #: documents that hold a lexicon term, at least
    bits: int = 18  #: cells of hashed terms: 2**bits
    subsets: int = 8  #: of each density
    densities: tuple[int, ...] = (2, 4, 6, 8, 10)  #: each is a part 2**-d of the lexicon
    rows_per_part: int = 4000  #: documents between two boundaries of ids


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's words (letters and digits, in lower case)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(documents: DataFrame, text: str = "text", params: ImatchParams = ImatchParams()) -> list[int]:
    """A bitmap of the cells whose document frequency lies in the band, as 64-bit words: 2**bits bits, whatever the corpus."""
    cells = F.array_distinct(F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda t: t.bitwiseAND((1 << params.bits) - 1)))
    n = documents.count()
    counts = documents.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    low, high = max(params.least, math.ceil(n * params.low)), max(params.least, math.floor(n * params.high))
    kept = counts.where(F.col("n").between(low, high))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = kept.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = [0] * ((1 << params.bits) // 64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out


def banded(found: Column, bitmap: list[int], params: ImatchParams) -> Column:
    """Terms of the lexicon, sorted; of a text without any, all its terms."""
    table = F.expr("array(" + ",".join(f"{x}L" if x >= -(2**63) + 1 else "shiftleft(1L, 63)" for x in bitmap) + ")")
    cell = lambda t: t.bitwiseAND((1 << params.bits) - 1)
    held = lambda t: F.getbit(F.get(table, F.shiftright(cell(t), 6).cast("int")), cell(t).bitwiseAND(63).cast("int")) == 1
    own = F.filter(found, held)
    return F.array_sort(F.when(F.size(own) > 0, own).otherwise(found))


def _partition_hashes(sorted_terms: Column, at: int, parts: int, n: int) -> list[Column]:
    """Hashes of the first n of the parts that the bits from `at` on of a term's hash tell apart."""

    def number(t: Column) -> Column:
        return F.shiftrightunsigned(t, at).bitwiseAND(parts - 1)

    near = F.filter(sorted_terms, lambda t: number(t) < n) if n < parts else sorted_terms
    picks = [F.filter(near, lambda t: number(t) == k) for k in range(n)]  # noqa: B023
    return [F.when(F.size(p) > 0, F.xxhash64(p).bitwiseAND(0xFFFFFFFF)) for p in picks]


def subset_hashes(sorted_terms: str, params: ImatchParams) -> Column:
    """For each density and subset: the hash of the terms in it, in order; null where there is none.

    A density takes its own bits of a term's hash. Its subsets are parts of a random partition of the lexicon, or of
    two where one has too few.
    """
    out, at = [], params.bits
    for d in params.densities:
        parts = 1 << d
        for first in range(0, params.subsets, parts):
            out += _partition_hashes(F.col(sorted_terms), at, parts, min(parts, params.subsets - first))
            at += d
    return F.array(*out)


def likeness(a: Column, b: Column, params: ImatchParams) -> Column:
    """Likeness of two fingerprints, from 0 to 1: the greatest part of equal hashes over the densities.

    A density counts if at least half of its subsets hold a term of either text; if none does, all subsets count
    together, and texts without any term are alike.
    """

    def part(x: Column, y: Column, least: int) -> Column:
        told = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), 0).when(p.eqNullSafe(q), 2).otherwise(1))
        n = F.size(F.filter(told, lambda v: v > 0))
        return F.when(n >= least, F.size(F.filter(told, lambda v: v == 2)) / n)

    s = params.subsets
    levels = [part(F.slice(a, k * s + 1, s), F.slice(b, k * s + 1, s), s // 2) for k in range(len(params.densities))]
    return F.coalesce(F.greatest(*levels), part(a, b, 1), F.lit(1.0))


def as_text(hashes: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each subset, or dashes."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 8, "0")), F.lit("--------"))), "")


def with_fingerprint(rows: DataFrame, bitmap: list[int], text: str, out: str, params: ImatchParams) -> DataFrame:
    """Adds array `out` of subset hashes of a non-null text."""
    rows = rows.withColumn("__terms", terms(F.col(text))).withColumn("__sorted", banded(F.col("__terms"), bitmap, params))
    return rows.withColumn(out, subset_hashes("__sorted", params)).drop("__terms", "__sorted")


def fingerprint_documents(documents: DataFrame, text: str = "text", out: str = "fingerprint", params: ImatchParams = ImatchParams()) -> DataFrame:
    """Adds string `fingerprint` of the whole text (null: empty); all columns are kept, one of that name is replaced."""
    bitmap = lexicon(documents, text, params)
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = with_fingerprint(rows, bitmap, "text", "hashes", params)
    names = documents.columns if out in documents.columns else [*documents.columns, out]
    return found.select(*[as_text(F.col("hashes")).alias(out) if c == out else F.col("row")[c].alias(c) for c in names])


def fingerprint_edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", params: ImatchParams = ImatchParams()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Of n code points, the edited text has the last floor(n / 2) replaced by the first as many, or all, of the
    next document's by ascending id (of any type; null last, then by text); after the last document comes the first. The
    rows are cut into parts of about `rows_per_part` along ids and texts, so that no window spans the table or one id, and each part also gets the
    first row of the next. A null text is empty. An empty table gives an empty result.
    """
    bitmap = lexicon(documents, text, params)
    own = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("unknown", F.col("doc_id").isNull())
    parts = max(1, math.ceil(documents.count() / params.rows_per_part))
    # the beginning of a text is in order with the text
    own = with_cells(own, ["unknown", "doc_id", F.substring("text", 1, 64)], parts, "part", boundary="begins")
    least = own.orderBy("unknown", "doc_id", "text").limit(1).where("part = 0")
    starts = own.where("begins").unionByName(least).groupBy("part").agg(F.min("text").alias("text"))  # of each part that has rows
    turns = Window.orderBy("part")  # of a number for each part
    numbers = starts.select("part").withColumn("into", F.lag("part").over(turns)).withColumn("last", F.max("part").over(Window.partitionBy()))
    guests = starts.join(numbers.select("part", F.coalesce("into", "last").alias("into")), "part")
    guests = guests.select(F.lit(None).cast(dict(own.dtypes)["doc_id"]).alias("doc_id"), "text", F.lit(True).alias("unknown"), F.col("into").alias("part"), F.lit(True).alias("guest"))
    own = own.drop("begins")
    rows = own.withColumn("guest", F.lit(False)).unionByName(guests)
    rows = with_fingerprint(rows, bitmap, "text", "hashes", params)
    following = Window.partitionBy("part").orderBy("guest", "unknown", "doc_id", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(following)).withColumn("next_hashes", F.lead("hashes").over(following)).where(~F.col("guest"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substr("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substr("next_text", F.lit(1), F.col("half")))).drop("text", "next_text")
    rows = with_fingerprint(rows, bitmap, "edited", "edited_hashes", params)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes"), params).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes"), params).alias("near_next"),
    )
