"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import LETTER, Tokens, lower_bytes, mix, segment_sums, tokenised
from tessera.llm.linear import Leader, sigmoid


@dataclass(frozen=True)
class ToxicityParams:
    """`max_train_docs` bounds the labelled rows that are learnt from (the least by a hash of the id)."""

    bits: int = 20  #: hashed features: 2**bits
    max_train_docs: int = 8_000
    shards: int = 1  #: of the sample, trained apart and then averaged
    epochs: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.4
    l2: float = 0.01
    prior: float = -6.0  #: log odds of a sentence with no known word
    offending: float = 0.3  #: a sentence from this score on is reported


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  #: of 2**bits features and, last, the bias


def _ends_sentence() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in ".!?\n"]] = True
    return table


_ENDS = _ends_sentence()
#: Lengths of the beginnings of words that are features, for stems that take endings.
PREFIX_BYTES = (5, 6, 7, 8)


@dataclass
class Sentences:
    """The sentences of a few texts: features of each, and bytes from where to where."""

    first_doc: int
    features: np.ndarray
    starts: np.ndarray  #: of each sentence's features, and the end
    doc_starts: np.ndarray  #: of each text's sentences, and the end
    begin: np.ndarray  #: bytes within the text
    end: np.ndarray


def sentences(texts: pa.Array, bits: int) -> Iterator[Sentences]:
    """Sentences end at . ! ? or a line's end. Features: words in lower case, their beginnings, and pairs of words next to each other in a sentence.

    A text of over kernels.CHUNK_BYTES comes in windows of whole sentences, with the same first_doc; a sentence longer than that ends with the last word that fits.
    """
    for tok in tokenised(texts, fold=lower_bytes, breaks=(_ENDS,)):
        yield _split(tok, bits)


def _split(tok: Tokens, bits: int) -> Sentences:
    n_docs = len(tok.doc_starts) - 1
    marks = np.zeros(len(tok.data) + 1, np.int64)
    np.cumsum(_ENDS[tok.data], out=marks[1:])
    word = tok.classes == LETTER
    hashes, starts, ends = tok.hashes[word], tok.starts[word], tok.ends[word]
    doc = np.searchsorted(tok.offsets, starts, "right") - 1
    key = marks[starts] + doc  # grows at each sentence and text
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    pair = ~new
    joined = mix(np.roll(hashes, 1) * np.uint64(3) + hashes, 7)
    owners, grams = [number, number[pair]], [hashes, joined[pair]]
    for n in PREFIX_BYTES:
        longer = ends - starts > n
        owners.append(number[longer])
        grams.append(mix(tok.span_hashes(starts[longer], starts[longer] + n), n))
    owner, found = np.concatenate(owners), np.concatenate(grams) >> np.uint64(64 - bits)
    order = np.argsort(owner, kind="stable")
    last = np.append(first[1:], len(key))
    begin = starts[first] - tok.offsets[doc[first]] + tok.before
    return Sentences(tok.first_doc, found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(first) + 1)), np.searchsorted(doc[first], np.arange(n_docs + 1)), begin, ends[last - 1] - tok.offsets[doc[first]] + tok.before if len(first) else begin)


def noisy_or(p: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) of each text's sentences; no sentence: 0."""
    return -np.expm1(segment_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_starts))


def train_toxicity(sample: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from (doc_id, text, label 0/1), where only documents have labels.

    A document's probability P is the noisy-or of its sentences' p. Its loss has the slope p (P - y) / P in
    each sentence's log odds: a clean document pushes all its sentences down, a toxic one lifts those
    that best explain it. Shards train apart and Spark averages them.
    """
    size = 1 << params.bits

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        y, parts = rows["label"].to_numpy(), [[] for _ in range(len(rows))]
        for s in sentences(pa.array(rows["text"], pa.large_string()), params.bits):
            for k, (a, b) in enumerate(zip(s.doc_starts[:-1], s.doc_starts[1:]), s.first_doc):
                parts[k].append((s.features[s.starts[a] : s.starts[b]], np.diff(s.starts[a : b + 1])))
        docs = []
        for own in parts:
            found, place = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
            docs.append((np.append(found, size), place, np.append(0, np.cumsum(np.concatenate([n for _, n in own])))))
        model = Leader(size, params.alpha, params.beta, params.l1, params.l2)
        for _ in range(params.epochs):
            for (found, place, starts), label in zip(docs, y):
                if len(starts) < 2:
                    continue
                w = model.weights(found)
                p = sigmoid(segment_sums(w[place], starts) + w[-1] + params.prior)
                whole = max(noisy_or(p, np.array([0, len(p)]))[0], 1e-9)
                slope = p * (whole - label) / whole
                g = np.bincount(place, np.repeat(slope, np.diff(starts)), len(found))
                g[-1] = slope.sum()
                model.update(found, w, g)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(kept, -1), "weight": np.append(w[kept], 1.0)})

    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(params.shards))
    parts = sample.withColumn("__shard", shard).groupBy("__shard").applyInPandas(fit, "feature long, weight double")
    total = parts.groupBy("feature").agg(F.sum(F.round("weight", 9)).alias("weight")).toPandas()
    weights = np.zeros(size + 1)
    trained = total.loc[total["feature"] == -1, "weight"].sum()
    own = total[total["feature"] >= 0]
    weights[own["feature"].to_numpy()] = own["weight"].to_numpy() / max(1.0, trained)
    return ToxicityModel(weights.astype(np.float32))


def score_toxicity(documents: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(), text: str = "text", result: str = "toxicity") -> DataFrame:
    """Adds a struct `toxicity`: score from 0 to 1 of the whole text, n_sentences, and `offending`, the sentences
    that score at least `params.offending`, in order, as structs of first byte, last byte (not included) and score.

    Bytes are those of the text in UTF-8. Null and empty texts, and texts without a letter, score 0 and have no
    sentence. All columns are kept; one called `toxicity` is replaced. Equal texts get equal results.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("struct<score: double, n_sentences: bigint, offending: array<struct<start: bigint, end: bigint, score: double>>>")
    def scored(texts: pa.Array) -> pa.Array:
        w, n = shared.value, len(texts)
        score, count, begin, end, own, bad = np.zeros(n), np.zeros(n, np.int64), [], [], [], np.zeros(n, np.int64)
        for s in sentences(texts, params.bits):
            p = sigmoid(segment_sums(w[s.features].astype(np.float64), s.starts) + float(w[-1]) + params.prior)
            rows = slice(s.first_doc, s.first_doc + len(s.doc_starts) - 1)
            score[rows] = 1 - (1 - score[rows]) * (1 - noisy_or(p, s.doc_starts))
            count[rows] += np.diff(s.doc_starts)
            hit = p >= params.offending
            bad[rows] += segment_sums(hit.astype(np.float64), s.doc_starts).astype(np.int64)
            begin.append(s.begin[hit]), end.append(s.end[hit]), own.append(p[hit])
        parts = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((begin, np.int64), (end, np.int64), (own, np.float64))]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(span))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(bad)), pa.int32()), spans)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(count), lists], ["score", "n_sentences", "offending"])

    return documents.withColumn(result, scored(F.col(text)))
