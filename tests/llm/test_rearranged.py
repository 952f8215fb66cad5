"""Fill-in-middle, SimHash components and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim as I
from tessera.llm import repair as R
from tessera.llm import simhash as H

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@given(st.binary(max_size=300), st.integers(0, 300), st.integers(0, 300), st.integers(0, 300))
def test_rotations(data, x, y, z):
    a, b, c = sorted(min(k, len(data)) for k in (x, y, z))
    buffer = bytearray(data)
    meet = I.rotate(buffer, a, b, c)
    assert buffer == data[:a] + data[b:c] + data[a:b] + data[c:] and meet == a + c - b
    I.rotate(buffer, a, meet, c)
    assert buffer == data


def test_reversal_of_several_blocks():
    data = random.Random(1).randbytes(3 * I._BLOCK + 17)
    buffer = bytearray(data)
    I.reverse(buffer, 5, len(data) - 2)
    assert buffer == data[:5] + data[5:-2][::-1] + data[-2:]


@settings(max_examples=200)
@given(st.text("a<PSM> \n\té漢 ", max_size=40), st.data())
def test_arranged_texts_come_back(text, data):
    if any(m.decode() in text for m in I.MARKS):
        return
    raw = text.encode()
    tokens = TOKEN.findall(text)
    starts = I.token_starts(np.frombuffer(raw, np.uint8))
    assert [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)])] == tokens
    a, b = sorted(data.draw(st.integers(0, len(tokens))) for _ in range(2))
    parts = ["".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, None))]
    cuts = [*starts.tolist(), len(raw)]
    for spm, want in ((False, "<P>{0}<S>{2}<M>{1}"), (True, "<S>{2}<P>{0}<M>{1}")):
        buffer = bytearray(raw)
        I.arrange(buffer, cuts[a], cuts[b], spm)
        assert buffer.decode() == want.format(*parts)
        I.restore(buffer)
        assert buffer == raw


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_of_odd_and_plain_documents(spark, documents, odd_documents, empty_documents):
    hostile = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(["a <P> b", "<M>", "x<S", "<", "<P", " >", "P> <"] * 30)], "doc_id long, text string, fim string")
    for df in (documents, odd_documents, hostile):
        done = I.fim_transform(df)
        back = I.fim_restore(done, F.col("fim.output"), F.col("fim.form"), "restored")
        assert back.columns == [*[c for c in df.columns if c != "fim"], *(["fim"] if "fim" not in df.columns else []), "restored"] or "fim" in df.columns
        for r in back.select("doc_id", "text", "fim.*", "restored").collect():
            assert (r["n_tokens"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
            assert r["restored"] == (r["text"] or "")
    assert I.fim_transform(empty_documents).count() == 0
    forms = {r["form"]: r["n"] for r in I.fim_transform(documents).groupBy("fim.form").agg(F.count("*").alias("n")).collect()}
    assert 0.4 < forms["plain"] / sum(forms.values()) < 0.65 and forms["spm"] > forms["psm"] > 0


def plain_simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, documents, odd_documents, empty_documents):
    for df in (documents, odd_documents):
        for r in H.with_fingerprint(df).select("text", H.hex_of(F.col("fingerprint")).alias("f")).collect():
            if len(r["text"] or "") < 20_000:
                assert r["f"] == f"{plain_simhash(r['text']):016x}"
    assert H.with_fingerprint(empty_documents).count() == 0
    one = spark.sql("select xxhash64('some words of a text') as h").first()["h"]  # a text of one shingle has its bits
    assert H.simhash(np.frombuffer(b"some words of a text", np.uint8), H.SimhashParams(words=5)) == one % 2**64


def test_long_texts_come_in_windows(monkeypatch):
    text = " ".join(random.Random(3).choice(["Ab", "c", "Éd", "xyz\n"]) for _ in range(3000)).encode()
    whole = H.simhash(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(H, "CHUNK_BYTES", 100)
    assert H.simhash(np.frombuffer(text, np.uint8)) == whole == plain_simhash(text.decode())


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values[:k]) <= 4).tolist():
            a, b = find(k), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def clustered(seed, n_groups=60, size=25, loners=1500):
    """Random fingerprints, chains of near ones, and a dense group."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    prints = [rng.getrandbits(64) for _ in range(loners)] + [0, 2**64 - 1]
    for _ in range(n_groups):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(2, size)):
            prints.append(at)
            at = flip(at, rng.choice([1, 3, 4, 5]))
    base = rng.getrandbits(64)
    prints += [flip(base, rng.randint(0, 5)) for _ in range(1200)]
    same_part = rng.getrandbits(64)
    prints += [same_part ^ (rng.getrandbits(43) << 21) for _ in range(700)]  # equal in one part, so no tree divides them there
    rng.shuffle(prints)
    return list(dict.fromkeys(prints))


@pytest.mark.parametrize("shard_rows, leaf_rows, parts", [(1 << 14, 64, 3), (200, 16, 3), (60, 8, 3), (500, 16, 1), (300, 8, 2), (150, 8, 5)])
def test_links_join_what_brute_force_joins(spark, shard_rows, leaf_rows, parts):
    prints = clustered(shard_rows)
    params = H.SimhashParams(shard_rows=shard_rows, leaf_rows=leaf_rows, parts=parts)
    signed = [(int(x),) for x in np.array(prints, np.uint64).view(np.int64)]
    pairs = H.near_pairs(spark.createDataFrame(signed, "fingerprint long"), params).collect()
    number = {int(x[0]): k for k, x in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        a, b = number[r["a"]], number[r["b"]]
        assert (prints[a] ^ prints[b]).bit_count() <= 4
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == plain_components(prints)
    assert len(pairs) < 40 * len(prints)  # not the pairs of the dense group


def test_components_of_documents(spark, texts, odd_documents, empty_documents):
    own = texts(300, size=80)
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(own)]
    for k in range(60):
        words = own[k].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words).upper() if k % 2 else " \n".join(words)))
    rows += [(2000, None), (None, ""), (2001, "\t "), (7, own[7]), (None, "alone " * 9)]
    got = H.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), H.SimhashParams(shard_rows=50)).collect()
    assert len(got) == len(rows)
    prints = {r["fingerprint"] % 2**64 for r in got}
    root = dict(zip(sorted(prints), plain_components(sorted(prints))))
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            key = root[r["fingerprint"] % 2**64]
            least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(root[r["fingerprint"] % 2**64]) for r in got)
    assert sum(r["component_id"] != r["doc_id"] for r in got) > 10
    odd = H.simhash_components(odd_documents)
    assert odd.count() == odd_documents.count() and odd.columns == ["doc_id", "fingerprint", "component_id"]
    assert H.simhash_components(empty_documents).count() == 0


def plain_repair(rows, params=R.RepairParams()):
    """Report of one conversation's rows (turn, role, text), by trying every edit with a memo of whole strings."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    white, faults, seen = " \t\n\x0b\x0c\r", [], set()
    for _, role, text in rows:
        stripped = text.strip(white)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    # best (cost, audit, repaired) from each row and state on, rows from the last
    best = {g: c for g, c in zip(range(4), [(0, "", ()), (4, "II", ("user:", "assistant:")), (2, "I", ("assistant:",)), (0, "", ())])}
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for g in range(4):
            options = []
            for added in range(4):  # turns added before the row
                cost, audit, out, at = 2 * added, "I" * added, (), g
                for _ in range(added):
                    out += ("assistant:" if at == 2 else "user:",)
                    at = 3 if at == 2 else 2
                options.append((cost + 3 + best[at][0], audit + "D" + best[at][1], out + best[at][2]))
                if fault not in ("blank", "duplicate"):
                    stays = 1 if fault else 0
                    if (to := step.get((at, role[:1]))) is not None:
                        options.append((cost + stays + best[to][0], audit + "K" + best[to][1], (*out, f"{role}:{text}", *best[to][2])))
                    for initial, name in names.items():
                        if (to := step.get((at, initial))) is not None:
                            options.append((cost + 2 + stays + best[to][0], audit + "R" + best[to][1], (*out, f"{name}:{text}", *best[to][2])))
            now[g] = min(options)
        best = now
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        best[0][0],
        best[0][1],
        hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest(),
    ), best[0][2]


def random_conversations(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why? \n", "漢.", "end "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant:x"]
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 9)):
            rows.append((None if c == 3 else c, None if rng.random() < 0.1 else turn + rng.randint(0, 2), rng.choice(roles), rng.choice(texts)))
    return rows


def test_repairs_are_the_cheapest(spark):
    rows = random_conversations(400, 1)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id int, turn int, role string, text string, cost int, fault string")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    got = {r[0]: tuple(r)[1:] for r in R.repair_report(frame, parts=3).collect()}
    assert got == {c: plain_repair(own)[0] for c, own in by.items()}
    repaired = {}
    for r in R.repaired_turns(frame).orderBy("conv_id", "place").collect():
        repaired.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert (r["turn"] is None) >= (r["edit"] == "I")
    assert repaired == {c: list(lines) for c, own in by.items() if (lines := plain_repair(own)[1])}
    assert R.repair_report(frame.limit(0)).count() == 0 and R.repaired_turns(frame.limit(0)).count() == 0


def test_state_is_carried_over_batches(spark):
    rows = [(1, k, ["user", "assistant"][k % 2 if k % 7 else 0], f"{k}." if k % 5 else f"{k}") for k in range(700)] + [(c, 0, "user", "?") for c in range(2, 30)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: tuple(r)[1:] for r in R.repair_report(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1] == plain_repair([r[1:] for r in rows if r[0] == 1])[0] and len(got) == 29
    plan = R.repair_report(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the window and both sorts use one dealing


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("system", "A.b!c?"), (None, None))]
    got = sorted(map(str, R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [f"Row(conv_id={c}, turn={t}, role={('user' if fate == 4 else role)!r}, text={text!r})"] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert got == sorted(want)


def test_a_shard_of_one_print():
    shard = H.Shard(np.array([5], np.uint64), 0, H.SimhashParams())
    assert [len(x) for x in shard.own_links()] == [0, 0]
    a, b = shard.links_with(np.array([4, 2**63 + 0xF0], np.uint64))
    assert a.tolist() == [4] and b.tolist() == [5] and pa.array(a).type == pa.uint64()
