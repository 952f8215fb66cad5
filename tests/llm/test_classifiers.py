"""Quality, toxicity and language: held-out accuracy, slopes against plain sums, brute-force parsing, odd input."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import langid as L
from tessera.llm import neardup as N
from tessera.llm import quality as Q
from tessera.llm import toxicity as T
from tessera.llm.linear import Leader, sigmoid
from tessera.llm.shared import held_out, in_training


def test_tokens_don_t_depend_on_their_neighbours():
    alone = [next(K.tokenised(pa.array([t]))).hashes.tolist() for t in ("hello wörld", "wörld!!", "x")]
    joined = next(K.tokenised(pa.array(["hello wörld", None, "wörld!!", "x"])))
    parts = [joined.hashes[a:b].tolist() for a, b in zip(joined.doc_starts[:-1], joined.doc_starts[1:])]
    assert parts == [alone[0], [], alone[1], alone[2]] and alone[0][1] == alone[1][0]


def test_slices_are_whole_and_bounded():
    texts = pa.array(["ab", None, "c" * 50, "", "d"])
    got = [(first, part.to_pylist()) for first, part in K.slices(texts, 10)]
    assert sum((p for _, p in got), []) == texts.to_pylist() and [f for f, _ in got] == [0, 2, 3]


def test_segment_sums():
    assert K.segment_sums(np.array([1.0, 2.0, 3.0]), np.array([0, 0, 2, 2, 3])).tolist() == [0.0, 3.0, 0.0, 3.0]


def test_leader_learns_and_shrinks():
    model = Leader(3, 0.5, 1.0, 0.1, 0.1)
    for _ in range(200):
        for x, y in (((1.0, 0.0), 1), ((0.0, 1.0), 0)):
            at = np.array([0, 1, 3])
            value = np.array([*x, 1.0])
            w = model.weights(at)
            model.update(at, w, (sigmoid(w @ value) - y) * value)
    w = model.weights(slice(None))
    assert w[0] > 1 and w[1] < -1 and w[2] == 0


def test_quality_is_a_dot_product_over_hashed_grams(spark, texts):
    text = texts(1)[0]
    params = Q.QualityParams()
    (first, at, starts), = Q._features(pa.array([text]), params.bits, params.grams)
    n = len(text.split())
    assert (first, len(at)) == (0, 3 * n - 3)
    w = np.random.default_rng(0).normal(size=(1 << params.bits) + 1).astype(np.float32)
    got = Q.score_quality(spark.createDataFrame([(text,)], "text string"), Q.LinearModel(w)).first()["score"]
    assert got == pytest.approx(1 / (1 + math.exp(-(w[at].astype(float).sum() * params.scale / len(at) + w[-1]))), rel=1e-6)


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select(F.col("s"), label).collect()
    return sum((r["s"] >= threshold) == bool(r[label]) for r in rows) / len(rows), len(rows)


def test_quality_on_held_out_documents(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn_quality(documents, labels, in_training(F.col("doc_id")))
    got, n = accuracy(Q.score_quality(documents, model).withColumn("s", F.col("score")), labels, "quality", 0.7)
    assert n > 50 and got > 0.95


def test_toxicity_finds_the_sentence(spark, texts):
    clean = [(k, t.replace(" ", ". ", 3), 0) for k, t in enumerate(texts(150, 40))]
    foul = [(1000 + k, t + ". You utter scoundrel here. " + t, 1) for k, t in enumerate(texts(60, 30, 2))]
    model = T.train_toxicity(spark.createDataFrame(clean + foul, "doc_id long, text string, label int"))
    new = [(1, texts(1, 50, 7)[0]), (2, "Good day. " + texts(1, 20, 8)[0] + ". That scoundrel again. " + texts(1, 20, 9)[0]), (3, None)]
    got = {r["doc_id"]: r["toxicity"] for r in T.score_toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got[1]["score"] < 0.3 and got[2]["score"] > 0.3 and got[3]["score"] == 0 and got[3]["n_sentences"] == 0
    found = [new[1][1].encode()[s["start"] : s["end"]].decode() for s in got[2]["offending"]]
    assert found == ["That scoundrel again"]


def test_noisy_or_and_its_slope():
    p = np.array([0.1, 0.5, 0.3])
    assert T.noisy_or(p, np.array([0, 2, 2, 3])) == pytest.approx([0.55, 0.0, 0.3])
    z = np.log(p / (1 - p))
    whole = 1 - np.prod(1 - p)
    for y in (0, 1):
        loss = lambda z: -math.log(1 - np.prod(1 - sigmoid(z))) if y else -np.log(1 - sigmoid(z)).sum()  # noqa: B023, E731
        for k in range(3):
            step = np.eye(3)[k] * 1e-6
            assert (loss(z + step) - loss(z - step)) / 2e-6 == pytest.approx(p[k] * (whole - y) / whole, abs=1e-5)


def test_automaton_knows_every_substring():
    text = [1, 2, 1, 2, 2, 1, 3, 1, 2]
    step = L.suffix_automaton(text)

    def known(part):
        state = 0
        for c in part:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    assert all(known(text[a:b]) for a in range(9) for b in range(a, 10))
    assert not known([3, 2]) and not known([2, 2, 2]) and len(step) <= 2 * len(text)


def plain_phrases(text, taught):
    """Greedy longest matches, one by one."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in taught:
            end += 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("params", [L.LangidParams(segment=16, settled=4, dense=5), L.LangidParams(segment=7, settled=7, dense=0), L.LangidParams()], ids=["short segments", "no column", "default"])
def test_phrases_equal_plain_parsing(spark, params):
    docs = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat with that hat", "en"), ("der hund und die katze sind da", "de")] * 2)]
    model = L.learn_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True), params)
    rng = random.Random(6)
    made = [" ".join(rng.choice("the cat mat hund katze da zzz ж sonder".split()) for _ in range(n)) for n in (300, 1, 40, 900)]
    texts = ["that cat und", "", "the mat die zzz katze the hat sat on that cat again and again", None, "q", *made, "katzeundhund" * 200]
    counts, lengths = L.count_phrases(pa.array(texts), model, L.transitions(model, params), params)
    for text, row, n in zip(texts, counts, lengths):
        whole = text or ""
        assert n == len(whole)
        for lang, got in zip(model.languages, row):
            taught = " ".join(t for _, t, la in docs if la == lang) + " "
            assert got == plain_phrases(whole, taught), (text, lang)


def test_transitions_of_many_letters_stay_small():
    rng = random.Random(2)
    text = [rng.randrange(0x4E00, 0x4E00 + 3000) for _ in range(60_000)]
    edges = np.array([(s, c, t) for s, out in enumerate(L.suffix_automaton(text)) for c, t in out.items()], np.int32)
    model, params = L.LangidModel(["zh"], np.zeros(1, np.int64), edges, int(edges[:, 2].max()) + 1), L.LangidParams()
    step = L.transitions(model, params)
    assert sum(x.nbytes for x in (step.table, step.columns, step.codes, step.keys, step.states)) < 64 << 20
    known = "".join(map(chr, text[1000:1100]))
    counts, _ = L.count_phrases(pa.array([known, known + "Ω" + known]), model, step, params)
    assert counts.tolist() == [[1], [3]]


def test_what_is_taught_of_long_texts_is_bounded():
    chars, starts = L._characters(pa.array(["abc" * 5000, "tiny", None, "x" * 100]))
    taught = L._taught(chars, starts, 1000)
    assert 900 <= len(taught) <= 1000 and (taught == ord("x")).sum() == 100 and (taught == L.GAP).sum() == 4
    assert len(L._taught(*L._characters(pa.array([], pa.string())), 10)) == 0


def test_language_on_held_out_documents(documents):
    model = L.learn_languages(documents, in_training(F.col("doc_id")))
    rows = L.predict_language(documents, model).where(held_out(F.col("doc_id")) & (F.length("text") > 30)).select("lang", "language.*").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_odd_documents(spark, odd_documents, empty_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (4, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for train in (odd_documents, empty_documents):
        model = Q.learn_quality(train, labels, in_training(F.col("doc_id")))
        out = Q.score_quality(odd_documents, model)
        assert out.count() == 19 and out.columns == odd_documents.columns
        assert out.groupBy("text").agg(F.count_distinct("score").alias("n")).agg(F.max("n")).first()[0] == 1
        toxic = T.train_toxicity(Q.labelled(train, labels, "toxic", F.lit(True), 10))
        assert T.score_toxicity(odd_documents, toxic).where("toxicity.score between 0 and 1").count() == 19
        langs = L.learn_languages(train, F.lit(True))
        named = L.predict_language(odd_documents, langs).select("text", "language.*")
        assert named.where("text is null or trim(text) in ('', '!!!')").where("lang_pred != 'und' or score != 0").count() == 0
        assert named.where("score < 0 or score > 1 or rate > 1").count() == 0 and named.count() == 19
        for f in (lambda d: Q.score_quality(d, model), lambda d: T.score_toxicity(d, toxic), lambda d: L.predict_language(d, langs)):
            assert f(empty_documents).count() == 0


def test_long_texts_in_windows_give_the_same(monkeypatch):
    rng = random.Random(8)
    long = " ".join(rng.choice(["The", "cat", "sat.", "Mat!", "on\n", "éa", "x9y"]) for _ in range(400))
    texts = pa.array(["a b c", long, None, long[:70], "y" * 200 + ". end of"])
    w = np.random.default_rng(1).normal(size=(1 << 12) + 1)

    def all_of():
        counted = [(f.tolist(), c.tolist()) for f, c in Q._counted(texts, 12, 3)]
        score, n, spans = np.zeros(5), np.zeros(5, int), [[] for _ in range(5)]
        for s in T.sentences(texts, 12):
            rows = slice(s.first_doc, s.first_doc + len(s.doc_starts) - 1)
            p = sigmoid(K.segment_sums(w[s.features], s.starts))
            score[rows] = 1 - (1 - score[rows]) * (1 - T.noisy_or(p, s.doc_starts))
            n[rows] += np.diff(s.doc_starts)
            for k, (a, b) in enumerate(zip(s.doc_starts[:-1], s.doc_starts[1:]), s.first_doc):
                spans[k] += list(zip(s.begin[a:b].tolist(), s.end[a:b].tolist()))
        words, starts = N._all_words(texts)
        return counted, np.round(score, 9).tolist(), n.tolist(), spans, words.tolist(), starts.tolist()

    whole = all_of()
    monkeypatch.setattr(K, "CHUNK_BYTES", 64)
    assert all_of() == whole and whole[2][1] > 100


def test_a_very_long_text_takes_bounded_memory():
    code = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from tessera.llm import quality as Q, toxicity as T, langid as L
texts = pa.array(["the quick brown fox. " * 1_500_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = np.zeros((1 << 20) + 1, np.float32)
for _, at, starts in Q._features(texts, 18, 3):
    w[at].sum()
for s in T.sentences(texts, 20):
    w[s.features].sum()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, check=True).stdout
    assert int(out) < 200, out
