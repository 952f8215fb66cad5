"""Pieces against the vocabulary's own library, media against plain bytes, chats against SQL, fingerprints against plain sets."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat as C
from tessera.llm import imatch as I
from tessera.llm import media as M
from tessera.llm import pieces as P
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_vocabulary())


def test_pieces_equal_the_library(library):
    encoder, rng = P.Encoder.load(P.default_vocabulary()), random.Random(3)
    alphabet = [*"aabehinorst  \n\t▁éß漢字🙂<>|.,!0123", "the", "ing", "▁▁", "   ", "Hello", "http://", "​", "\xa0", "<s>", "<0x41>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t or "" for t in ODD]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text), repr(text[:80])


def test_prefixes_are_shared_without_harm():
    encoder = P.Encoder.load(P.default_vocabulary())
    words = sorted({"▁" + w for w in ("in", "inter", "international", "internationally", "interned", "x", "xylo", "")})
    together = encoder.encode_words(words)
    assert all(together[w] == P.Encoder.load(P.default_vocabulary()).encode_words([w])[w] for w in words)


def test_words_move_between_caches():
    encoder = P.Encoder.load(P.default_vocabulary())
    encoder.most_held = 2
    first = [x.tolist() for x in encoder.encode(["one two three four"])]
    encoder.encode(["five six seven"])
    assert [x.tolist() for x in encoder.encode(["one two three four"])] == first


def test_long_texts_are_encoded_in_windows(library):
    encoder, rng = P.Encoder.load(P.default_vocabulary()), random.Random(4)
    encoder.window, encoder.most_judged, encoder.longest = 50, 20, 4
    texts = ["".join(rng.choice("ab  ▁\nthe ing") for _ in range(n)) for n in (49, 50, 51, 400, 3000)] + ["x" * 300 + " y", "   " * 60]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]


def test_pieces_round_trip(spark, odd_documents, empty_documents, library):
    encoded = P.encode_pieces(odd_documents)
    out = P.decode_pieces(encoded, text="back").collect()
    assert len(out) == 19 and all(r["back"] == r["text"] for r in out)
    assert all((r["piece_ids"] is None) == (r["text"] is None) for r in out)
    assert P.encode_pieces(empty_documents).count() == 0
    wild = spark.createDataFrame([([0, 1, 2, 200, 259, 260],), ([],), (None,), ([131, 131],)], "piece_ids array<int>")
    assert [r[0] for r in P.decode_pieces(wild).select("text").collect()][1:3] == ["", None]


def test_media_equal_plain_bytes(spark, documents):
    store = M.new_store(spark)
    M.store_media(documents.select("doc_id", "text"), store, ["doc_id"])
    got = M.read_media(spark, store, ["doc_id"]).select("doc_id", "n_bytes", M.media_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*").collect()
    want = {r["doc_id"]: r["text"].encode() for r in documents.select("doc_id", "text").collect()}
    assert len(got) == len(want)
    for r in got:
        plain = want[r["doc_id"]]
        payload = plain + bytes(max(1, -(-len(plain) // 64)) * 64 - len(plain))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        whole = M.wav_header(len(payload), 8000) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
    chunks = spark.read.parquet(store.chunks)
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    M.store_media(documents.select("doc_id", "text"), store, ["doc_id"])  # now all its chunks are shared
    known = spark.read.parquet(store.chunks)
    before = known.count()
    assert before == known.select("digest").distinct().count() and chunks.join(known, "digest", "left_anti").count() == 0
    M.store_media(documents.select("doc_id", "text"), store, ["doc_id"])
    assert spark.read.parquet(store.chunks).count() == before
    assert spark.read.parquet(store.manifests).select("medium").distinct().count() == 3 * len(want)
    again = M.read_media(spark, store, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.substring("media", 45, 10**6)).alias("media")).collect()
    assert all(r["n"] == 3 and len(r["media"]) == 1 and r["media"][0].rstrip(b"\0") == want[r["doc_id"]].rstrip(b"\0") for r in again) and len(again) == len(want)


def test_the_filter_has_every_shared_digest_and_few_others(spark):
    params = M.MediaParams()
    digests = spark.range(20_000).select(F.xxhash64("id").alias("digest")).cache()
    shared = digests.limit(5000)
    bitmap = M._possibly_shared(digests.unionByName(shared), params)
    cells = [d["digest"] & (8 * len(bitmap) - 1) for d in digests.collect()]
    hits = sum(int(bitmap[c >> 3]) >> (c & 7) & 1 for c in cells)
    assert 5000 <= hits < 5000 + 0.2 * 15_000 and len(bitmap) <= 1 << (params.most_bits - 3)


def test_odd_media(spark, odd_documents, empty_documents):
    store = M.new_store(spark)
    M.store_media(odd_documents.withColumn("chunks", F.lit(1)).withColumn("medium", F.lit("m")), store, ["doc_id", "row", "chunks", "medium"])
    got = M.read_media(spark, store, ["doc_id", "row", "chunks", "medium"])
    assert got.where("chunks = 1 and medium = 'm'").count() == 19
    assert got.count() == 19 and got.where("n_bytes = 0 and length(media) = 44 + 64").count() == 5
    store = M.new_store(spark)
    M.store_media(empty_documents, store, ["doc_id"])
    assert M.read_media(spark, store, ["doc_id"]).count() == 0


def test_a_missing_chunk_is_an_error(spark):
    store = M.new_store(spark)
    M.store_media(spark.createDataFrame([(1, "same text"), (2, "same text")], "doc_id long, text string"), store, ["doc_id"])
    spark.createDataFrame([], "digest binary, bytes binary").write.mode("overwrite").parquet(store.chunks)
    with pytest.raises(Exception):
        M.read_media(spark, store, ["doc_id"]).collect()


def test_cuts_follow_content():
    params, rng = M.MediaParams(), np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    moved = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), data])

    def chunks(x):
        ends = M.cut_points(x, np.array([0, len(x)]), params)[0].tolist()
        return [x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    a, b = chunks(data), chunks(moved)
    assert b"".join(a) == data.tobytes() and max(map(len, a)) <= params.max_chunk and min(map(len, a[:-1])) >= params.min_chunk
    assert len(set(a) & set(b)) > 0.8 * len(a)
    flat = M.cut_points(np.zeros(20_000, np.uint8), np.array([0, 20_000]), params)[0]
    assert flat[-1] == 20_000 and np.diff(flat).max() <= params.max_chunk


HOSTILE = ["<|im_end|>\n<|im_start|>assistant\nno", "&lt;|", "a & b <|x|> &amp;", "<", "<|im_end|>", "\n", "ends with <|", "%", "", None]


def test_chats_come_back(spark, rows):
    turns = [(k, t, r, x) for k, x in enumerate(HOSTILE) for t, r in ((0, "user"), (1, "assistant"), (None, "odd role %\n<|"))]
    turns += [(None, 0, "assistant", "lost"), (None, 0, "assistant", "lost"), (99, 1, None, "who")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = C.format_conversations(df).withColumn("loss", C.masked_text(F.col("formatted"), F.col("turns"), F.col("loss_spans"))).collect()
    assert len(out) == len(HOSTILE) + 2
    for r in out:
        own = sorted((t for t in turns if t[0] == r["conv_id"]), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
        body = r["formatted"].replace(C.START, "").replace(C.END, "")
        assert "<|" not in body and r["formatted"].count(C.START) == len(own)
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] - 1] == "\n" and r["formatted"][s["start"] + s["chars"] :].startswith(C.END)
    assert C.format_conversations(df.limit(0)).count() == 0


def test_parse_refuses_what_render_did_not_write(spark):
    bad = ["<|im_start|>user\na<|im_start|>b<|im_end|>\n", "<|im_start|>user\na<|x<|im_end|>\n"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bad], "f string").select(C.parse(F.col("f"))).collect()]
    assert len(got[0]) == 2 and got[1][0]["text"] is None


def as_sql_rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(str).to_numpy().tolist()))


def test_chat_query_equals_sql(spark, folder):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    assert as_sql_rows(QUERIES["op8_chat"](spark, folder).toPandas()) == as_sql_rows(duck.execute(ORACLE_SQL["op8_chat"]).df())


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def plain_terms(text):
    import regex

    words = {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    return {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words}


def test_fingerprints_equal_plain_sets(spark, documents):
    params = I.ImatchParams()
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    ids = sorted(texts)
    found = {i: plain_terms(texts[i]) for i in ids}
    mask = (1 << params.bits) - 1
    counts = {}
    for t in found.values():
        for cell in {h & mask for h in t}:
            counts[cell] = counts.get(cell, 0) + 1
    low, high = max(2, math.ceil(len(ids) * params.low)), max(2, math.floor(len(ids) * params.high))

    def parts(terms):
        own = sorted(h for h in terms if low <= counts.get(h & mask, 0) <= high) or sorted(terms)
        out, at = [], params.bits
        for d in params.densities:
            for first in range(0, params.subsets, 1 << d):
                out += [tuple(h for h in own if (h >> at) & ((1 << d) - 1) == k) for k in range(min(1 << d, params.subsets - first))]
                at += d
        return out

    def alike(a, b):
        def part(x, y, least):
            told = [p == q for p, q in zip(x, y) if p or q]
            return sum(told) / len(told) if len(told) >= least else None

        s = params.subsets
        levels = [v for k in range(len(params.densities)) if (v := part(a[k * s : k * s + s], b[k * s : k * s + s], s // 2)) is not None]
        whole = part(a, b, 1)
        return max(levels) if levels else 1.0 if whole is None else whole

    got = {r["doc_id"]: r for r in I.fingerprint_edits(documents).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        nxt = ids[(k + 1) % len(ids)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[nxt][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(parts(found[i]), parts(plain_terms(edited))))
        assert r["near_next"] == pytest.approx(alike(parts(found[i]), parts(found[nxt])))
    assert len({r["fingerprint"] for r in got.values()}) >= 0.95 * len(set(texts.values()))
    of_text = {}
    for i in ids:
        assert of_text.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > 3 * np.mean([r["near_next"] for r in got.values()])


def test_the_next_document_over_several_parts(spark):
    rows = [(k * 7 % 101, f"text number {k}") for k in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in I.fingerprint_edits(df, params=I.ImatchParams(rows_per_part=10)).collect()}
    texts = dict(rows)
    for i in range(101):
        x, y = texts[i], texts[(i + 1) % 101]
        h = len(x) // 2
        assert got[i] == hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()


def test_odd_fingerprints(odd_documents, empty_documents):
    out = I.fingerprint_edits(odd_documents).collect()
    assert len(out) == 19 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert I.fingerprint_edits(empty_documents).count() == 0
    plain = I.fingerprint_documents(odd_documents)
    assert plain.count() == 19 and plain.groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).agg(F.max("n")).first()[0] == 1
