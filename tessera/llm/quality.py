"""Quality classifier: hashed word n-grams, follow-the-regularised-leader training, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, segment_sums, tokenised
from tessera.llm.linear import Leader, sigmoid
from tessera.llm.worker import give_back, thrifty


@dataclass(frozen=True)
class QualityParams:
    """`max_train_docs` bounds the labelled rows that are learnt from (the least by a hash of the id)."""

    bits: int = 18  #: hashed features: 2**bits
    grams: int = 3  #: longest n-gram, in tokens
    scale: float = 40.0  #: features weigh count / n-grams of the text x scale
    max_train_docs: int = 16_000
    shards: int = 8  #: trained apart, then averaged
    epochs: int = 4
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


@dataclass(frozen=True)
class LinearModel:
    """Weights of 2**bits hashed features and, last, the bias. Bounded by `bits`, whatever the corpus."""

    weights: np.ndarray


#: Stand for every n-gram that ends with its first token, whichever token that is.
_REPEATED = mix(np.arange(8, dtype=np.uint64), 99)


def _features(texts: pa.Array, bits: int, grams: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a few texts at a time: index of the first, feature numbers, and where each text's begin (and the end).

    A long text comes in several parts of the same index, whose n-grams reach back into the part before.
    """
    shift = np.uint64(64 - bits)
    tail = np.zeros(0, np.uint64)
    for tok in tokenised(texts):
        n_docs = len(tok.doc_starts) - 1
        tail = tail[len(tail) - (grams - 1) :] if tok.before else tail[:0]
        all_hashes = np.concatenate([tail, tok.hashes])
        doc = np.concatenate([np.zeros(len(tail), np.int64), np.repeat(np.arange(n_docs), np.diff(tok.doc_starts))])
        new = np.arange(len(doc)) >= len(tail)
        hashes, owners, last = [all_hashes[new]], [doc[new]], all_hashes
        for n in range(1, grams):
            if len(all_hashes) <= n:
                break
            same = (doc[:-n] == doc[n:]) & new[n:]
            last = mix(last[:-1] * np.uint64(3) + all_hashes[n:], n)
            hashes.append(np.where(all_hashes[:-n] == all_hashes[n:], _REPEATED[n % len(_REPEATED)], last))
            owners.append(np.where(same, doc[:-n], -1))
        at, owner = np.concatenate(hashes) >> shift, np.concatenate(owners)
        at, owner = at[owner >= 0].astype(np.int64), owner[owner >= 0]
        order = np.argsort(owner, kind="stable")
        tail = all_hashes
        yield tok.first_doc, at[order], np.searchsorted(owner[order], np.arange(n_docs + 1))


def labelled(documents: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled documents: the least by a hash of the id.

    Repeated label rows count once, as their greatest; null labels and ids are not labels. Only the
    sample's ids and labels, whose number is bounded, are broadcast to the texts.
    """
    own = labels.where(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = own.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    found = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    return found.drop("__id").where(F.col("text").isNotNull())


def _counted(texts: pa.Array, bits: int, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and how often it has them."""
    held, at_doc = (np.zeros(0, np.int64), np.zeros(0, np.int64)), -1
    for first, at, starts in _features(texts, bits, grams):
        for doc, (a, b) in enumerate(zip(starts[:-1], starts[1:]), first):
            found, counts = np.unique(at[a:b], return_counts=True)
            if doc == at_doc:  # a further part of a long text
                found, place = np.unique(np.concatenate([held[0], found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([held[1], counts]), len(found)).astype(np.int64)
            elif at_doc >= 0:
                yield held
            held, at_doc = (found, counts), doc
    if at_doc >= 0:
        yield held


def train_quality(sample: DataFrame, params: QualityParams = QualityParams()) -> LinearModel:
    """Learn from (doc_id, text, label 0/1): each shard of the sample runs its updates in order of ids, and Spark averages the shards.

    No labelled row, or one label only: the model still scores (0.5, or near the label).
    """
    size = 1 << params.bits

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        y = rows["label"].to_numpy()
        docs = []
        for found, counts in _counted(pa.array(rows["text"], pa.large_string()), params.bits, params.grams):
            docs.append((np.append(found, size), np.append(counts * (params.scale / max(1, counts.sum())), 1.0)))
        model = Leader(size, params.alpha, params.beta, params.l1, params.l2)
        for _ in range(params.epochs):
            for (found, x), label in zip(docs, y):
                w = model.weights(found)
                model.update(found, w, (sigmoid(w @ x) - label) * x)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        del docs, model
        give_back()
        return pd.DataFrame({"feature": np.append(kept, -1), "weight": np.append(w[kept], 1.0)})

    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(params.shards))
    parts = sample.withColumn("__shard", shard).groupBy("__shard").applyInPandas(fit, "feature long, weight double")
    total = parts.groupBy("feature").agg(F.sum(F.round("weight", 9)).alias("weight")).toPandas()
    weights = np.zeros(size + 1)
    trained = total.loc[total["feature"] == -1, "weight"].sum()
    own = total[total["feature"] >= 0]
    weights[own["feature"].to_numpy()] = own["weight"].to_numpy() / max(1.0, trained)
    return LinearModel(weights.astype(np.float32))


def score_quality(documents: DataFrame, model: LinearModel, params: QualityParams = QualityParams(), text: str = "text", score: str = "score") -> DataFrame:
    """Adds `score`, from 0 to 1: how likely label 1 is, from the whole text.

    Null and empty texts have no features and get the score of the bias alone. All columns are kept; a
    column called `score` is replaced. Equal texts get equal scores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    @thrifty
    def scored(texts: pa.Array) -> pa.Array:
        w, out, n = shared.value, np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first, at, starts in _features(texts, params.bits, params.grams):
            out[first : first + len(starts) - 1] += segment_sums(w[at].astype(np.float64), starts)
            n[first : first + len(starts) - 1] += np.diff(starts)
        return pa.array(sigmoid(out * (params.scale / np.maximum(1, n)) + float(w[-1])))

    return documents.withColumn(score, scored(F.col(text)))


def learn_quality(documents: DataFrame, labels: DataFrame, usable: Column, params: QualityParams = QualityParams()) -> LinearModel:
    return train_quality(labelled(documents, labels, "quality", usable, params.max_train_docs), params)
