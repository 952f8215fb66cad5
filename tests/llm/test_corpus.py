"""Mixing, near-duplicates, sharding and the pipeline against brute force."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing as X
from tessera.llm import neardup as N
from tessera.llm import sharding as S
from tessera.llm.kernels import lower_bytes
from tessera.llm.shared import materialize, ranked


def test_ranks_without_one_window(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k if k % 5 else None, k % 4) for k in range(300)], "g int, o int, n long")
    got = ranked(df, ["g"], ["o", "n"], F.col("n"), "r", 8).collect()
    for g, own in itertools.groupby(sorted(got, key=lambda r: (r["g"] is None, r["g"] or 0)), key=lambda r: r["g"]):
        spans = sorted((r["r"], r["r"] + r["n"]) for r in own)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(s for s in spans if s[0] < s[1]))


def test_targets_are_shared_again():
    assert X.targets([100, 100, 100], [5, 2, 1], 3.0) == [187.5, 75.0, 37.5]
    assert X.targets([10, 100, 100], [5, 2, 1], 3.0) == [30.0, 120.0, 60.0]
    assert X.targets([], [], 3.0) == [] and X.targets([0, 8], [5, 2], 3.0) == [0.0, 8.0]


def test_plans_take_exactly_the_target():
    rng = random.Random(2)
    for k in range(300):
        size = rng.randint(1, 5000)
        target = rng.random() * 3 * size
        p = X.plan("s", size, target, X.MixParams(blocks=rng.choice([1, 7, 64])), size * 4, k)
        orders = {}
        got = 0
        for draw in range(p.draws):
            of = draw // p.n_blocks
            if of not in orders:
                orders[of] = {X.place_of(j, p.n_blocks, p.key, of, 12): j for j in range(p.n_blocks)}
                assert len(orders[of]) == p.n_blocks
            j = orders[of][draw % p.n_blocks]
            got += min((j + 1) * p.block, size) - j * p.block
        assert got - p.cut == p.words == round(target) and 0 <= p.cut < max(1, p.block)


def test_permutations_depend_on_seed_and_pass(spark):
    orders = {(key, of): [X.place_of(j, 100, key, of, 12) for j in range(100)] for key in (1, 2) for of in (0, 1)}
    assert all(sorted(o) == list(range(100)) for o in orders.values()) and len({tuple(o) for o in orders.values()}) == 4
    steps = collections.Counter((b - a) % 100 for a, b in itertools.pairwise(orders[1, 0]))
    assert max(steps.values()) < 10  # no progression
    row = spark.sql(f"select j, {X._PLACE.format(last=11)} as place from (select id as j, 100L as n_blocks, 2L as key, 1 as pass from range(100))")
    assert [r["place"] for r in row.orderBy("j").collect()] == orders[2, 1]


def test_the_tree_splits_exactly():
    quotas = [1000, 0, 37, 5]
    leaves = X.split_quotas(quotas, 8, 3)
    assert leaves.sum(0).tolist() == quotas and leaves.min() >= 0 and np.ptp(leaves.sum(1)) <= 1
    assert (leaves == X.split_quotas(quotas, 8, 3)).all() and (leaves != X.split_quotas(quotas, 8, 4)).any()
    mean = np.mean([X.split_quotas([600, 200], 4, s)[0] for s in range(200)], axis=0)
    assert mean == pytest.approx([150, 50], rel=0.05)


def test_mix_of_documents(spark, documents):
    drawn = X.draw(documents).rows.select("row.*", "size", "target", "draws", X.taken(F.col("draws")).alias("taken")).collect()
    assert len(drawn) == documents.count()
    by = collections.defaultdict(list)
    for r in drawn:
        assert r["size"] == len(r["text"].encode().split()) and r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(sum(r["size"] for r in drawn))
    for own in by.values():
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
    shards = collections.Counter(d["shard"] for r in drawn for d in r["draws"] or [])
    assert set(shards) <= set(range(64))
    mixed = X.mix_sources(documents).collect()
    words = collections.Counter()
    by_shard = collections.Counter()
    for r in mixed:
        by_shard[r["mix_shard"]] += len(r["text"].split())
    planned = collections.Counter()
    for r in drawn:
        for d in r["draws"] or []:
            planned[d["shard"]] += d["to_word"] - d["from_word"]
    assert by_shard == planned and len(planned) == 64
    again = materialize(X.mix_sources(documents), "test-mixed").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    orders = collections.defaultdict(list)
    for r in again.orderBy("at").collect():
        orders[r["file"], r["mix_shard"]].append(r["mix_place"])
    assert len(orders) == 64 and all(o == sorted(o) for o in orders.values())
    texts = {r["doc_id"]: r["text"] for r in drawn}
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
        assert " ".join(r["text"].split()) in " ".join(texts[r["doc_id"]].split())
    assert words == collections.Counter({r["doc_id"]: r["taken"] for r in drawn if r["taken"]})
    again = {(r["doc_id"], X_taken) for r, X_taken in ((r, r["taken"]) for r in X.draw(documents).rows.select("row.*", X.taken(F.col("draws")).alias("taken")).collect())}
    assert again == {(r["doc_id"], r["taken"]) for r in drawn}


def test_odd_mixes(odd_documents, empty_documents):
    out = X.draw(odd_documents).rows.select("row.row", "source_size", X.taken(F.col("draws")).alias("taken"), "size").collect()
    assert len(out) == 19 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert X.draw(empty_documents).rows.count() == 0 and X.mix_sources(empty_documents).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distances_equal_plain_ones():
    rng, left, right = np.random.default_rng(4), [], []
    for _ in range(150):
        a = rng.integers(1, 6, rng.integers(0, 90)).astype(np.uint64)
        b = a.tolist()
        for _ in range(rng.integers(0, 25)):
            k = int(rng.integers(len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = [int(rng.integers(1, 6))] if rng.random() < 0.6 else []
        left.append(a), right.append(np.array(b, np.uint64))
    limits = np.array([max(len(a), len(b)) // 3 for a, b in zip(left, right)])
    want = [d if (d := plain_distance(a.tolist(), b.tolist())) <= n else -1 for a, b, n in zip(left, right, limits)]
    assert N.banded_distances(left, right, limits).tolist() == want and -1 in want


@pytest.mark.parametrize("cells", [-1, 1 << 28], ids=["bands", "bit vectors"])
def test_long_pairs_are_aligned_alike(monkeypatch, cells):
    monkeypatch.setattr(N, "SHORT_WORDS", 0)
    monkeypatch.setattr(N, "BIT_CELLS", cells)
    test_banded_distances_equal_plain_ones()


def test_sketches_are_sensitive_to_order():
    params = N.NeardupParams(sketches=256, picks=3)
    words = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    swapped = np.concatenate([words[20:], words[:20]])
    shingles, starts = N._shingles(np.concatenate([words, words, swapped]), np.array([0, 40, 80, 120]), 5)
    a, same, moved = N.order_sketches(shingles, starts, params)
    assert (a == same).all() and 0.1 < (a == moved).mean() < 0.9


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (100, 70), (7, 7)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 70: 50, 100: 50}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(spark, documents, texts):
    rng, rows = random.Random(9), [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    passage = texts(1, 80, 30)[0]
    for k, t in enumerate(texts(30, 120, 31)):
        rows += [(10_000 + 10 * k, t), (10_001 + 10 * k, edited(t, rng, 4)), (10_002 + 10 * k, t), (10_003 + 10 * k, passage + " " + edited(t, rng, 60))]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).rows.collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    words = {}
    for i, t in rows:
        for tok in N.tokenised(pa.array([t]), fold=lower_bytes):
            words[i] = N._words(tok)[0]
    bags = {i: collections.Counter(w.tolist()) for i, w in words.items()}
    order = sorted(words, key=lambda i: len(words[i]))
    near = [(a, b) for k, a in enumerate(order) for b in itertools.takewhile(lambda b: len(words[a]) >= 0.8 * len(words[b]), order[k + 1 :]) if (bags[a] & bags[b]).total() >= 0.8 * len(words[b])]  # noqa: B023
    limits = np.array([int(0.2 * max(len(words[a]), len(words[b])) + 1e-9) for a, b in near])
    found = N.banded_distances([words[a] for a, _ in near], [words[b] for _, b in near], limits)
    parent = {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), d in zip(near, found):
        if d >= 0:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in words}
    stays = collections.Counter(r["class_id"] for r in out if r["stays"])
    assert set(stays.values()) == {1} and set(stays) == set(got.values())


def test_unlike_members_of_one_bucket_are_all_compared(spark, texts):
    shared = texts(1, 60, 40)[0]
    own = texts(40, 140, 41)
    rows = [(k, shared + " " + t) for k, t in enumerate(own)] + [(100, shared + " " + edited(own[39], random.Random(1), 3))]
    out = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).rows.collect()}
    assert out[100] == 39 and len(set(out.values())) == 40


def bucketed(spark, rows):
    """(sketched, texts) of (node, text) rows that all meet in one bucket only."""
    texts = spark.createDataFrame(rows, "uid long, __text string")
    sketched = N._sketched(texts, "__text", N.NeardupParams())
    return sketched.select(F.col("uid").alias("node"), "__sketch.*").withColumn("bands", F.array(F.lit(1).cast("long"))), texts


def letters(value):
    """A word of letters only: digits would be words of their own."""
    return "q" + "".join(chr(ord("a") + int(c, 16)) for c in value.encode().hex())


def changed(words, places, name):
    return [letters(f"{name} {k}") if k in places else w for k, w in enumerate(words)]


def test_a_hub_of_a_bucket_joins_all_its_variants(spark, texts):
    base, rng = texts(1, 120, 50)[0].split(), random.Random(3)
    rows = [(k, " ".join(changed(base, rng.sample(range(120), 15), f"own {k}"))) for k in range(40) if k != 30] + [(30, " ".join(base))]
    links = N._links(*bucketed(spark, rows), N.NeardupParams())
    assert {r["root"] for r in N.components(links).collect()} == {0} and N.components(links).count() == 40


def test_a_link_between_members_of_two_leaders_is_found(spark, texts):
    # 0 - 2 - 3 - 1, each like the next only
    words = texts(1, 100, 51)[0].split()
    chain = [changed(words, range(20 * k), "other") for k in range(4)]
    rows = [(node, " ".join(w)) for node, w in zip([0, 2, 3, 1], chain)]
    links = {(r["a"], r["b"]) for r in N._links(*bucketed(spark, rows), N.NeardupParams()).collect()}
    assert links == {(0, 2), (2, 3), (1, 3)}


def test_unlinked_pairs_equal_brute_force():
    rng, params = np.random.default_rng(7), N.NeardupParams()
    n, root, bits = rng.integers(1, 60, 80), rng.integers(0, 30, 80), rng.integers(0, 4, (80, 3)).astype(np.uint64)
    left, right = np.arange(20), np.arange(20, 80)
    want = [(i, j) for i in left for j in right if root[i] != root[j] and abs(n[i] - n[j]) <= 0.2 * max(n[i], n[j]) + 1e-6 and sum(int(x ^ y).bit_count() for x, y in zip(bits[i], bits[j])) <= 0.4 * max(n[i], n[j]) + 1e-6]
    assert sorted(zip(*N.unlinked_pairs(n, root, bits, left, right, params))) == want and 0 < len(want) < 1200


def test_links_at_10_15_and_19_percent_equal_brute_force(spark, texts):
    rng, rows, want = random.Random(12), [], collections.defaultdict(set)
    for k, share in enumerate((0.10, 0.15, 0.19)):
        for i, (size, words) in enumerate((n, texts(1, n, 1000 * k + 10 * n + s)[0].split()) for n in (60, 200, 600) for s in range(12)):
            node = 1000 * k + 2 * i
            rows += [(node, " ".join(words)), (node + 1, " ".join(changed(words, rng.sample(range(size), int(share * size)), f"own {node}")))]
            want[k].add((node, node + 1))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(table)
    ids = {r["uid"]: r["doc_id"] for r in found.rows.select("uid", "doc_id").collect()}
    links = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in found.links.collect()}
    assert links <= set().union(*want.values())  # brute force: random texts of different bases are far apart
    for k in want:
        assert len(links & want[k]) >= 0.95 * len(want[k]), (k, len(links & want[k]))


@pytest.mark.parametrize("spread", [lambda rng, n: rng.sample(range(n), n // 5), lambda rng, n: range(2, n, 5)], ids=["random", "every fifth"])
def test_sketches_meet_at_the_threshold(spread):
    rng, params, met, rows = random.Random(8), N.NeardupParams(), 0, 400
    for k in range(rows):
        n = rng.randrange(40, 300)
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = a.copy()
        for place in spread(rng, n):
            b[place] = rng.getrandbits(64)
        assert (a != b).sum() >= 0.19 * n - 1
        shingles, starts = N._shingles(np.concatenate([a, b]), np.array([0, n, 2 * n]), params.words)
        x, y = N.order_sketches(shingles, starts, params)
        met += (x == y).any()
    assert met >= 0.98 * rows


def test_short_texts_of_one_edit_always_meet():
    rng, params = random.Random(3), N.NeardupParams()
    for _ in range(500):
        a = [rng.getrandbits(64) for _ in range(rng.randrange(2, 10))]
        b, place, kind = list(a), rng.randrange(len(a)), rng.randrange(3)
        b[place : place + (kind > 0)] = [rng.getrandbits(64)] if kind < 2 else []
        x, y = (N.short_bands(np.array(w, np.uint64), params) for w in (a, b))
        assert len(np.intersect1d(x, y)) > 0


def test_bits_of_words_never_hide_a_link(spark):
    rng = random.Random(6)
    rows = []
    for k in range(200):
        a = [letters(str(rng.randrange(300))) for _ in range(rng.randrange(5, 1000))]
        b = list(a)
        for _ in range(len(a) // 5):
            p = rng.randrange(len(b))
            b[p : p + rng.randrange(2)] = [letters(str(rng.randrange(300)))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    sketched, texts = bucketed(spark, rows)
    left, right = (sketched.where(f"node % 2 = {k}").select(F.col("node").alias("ab"[k]), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in (0, 1))
    pairs = left.join(right, F.expr("a + 1 = b")).withColumn("may", N._may_link(("n0", "n1"), ("bits0", "bits1"), N.NeardupParams()))
    like = N._verified(pairs.select("a", "b"), N.word_lists(texts, N.NeardupParams()), N.NeardupParams()).where("similarity is not null").join(pairs, ["a", "b"])
    assert like.count() > 100 and like.where("not may").count() == 0


def test_odd_near_duplicates(odd_documents, empty_documents):
    out = N.near_duplicates(odd_documents).rows.collect()
    assert len(out) == 19
    kept = N.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == len({t for t in (r["text"] or "" for r in odd_documents.collect())})
    assert N.near_duplicates(empty_documents).rows.count() == 0 and N.drop_near_duplicates(empty_documents).count() == 0


def test_packing_levels_bytes():
    rng = np.random.default_rng(0)
    items = np.stack([rng.pareto(2.0, 3000) + 1, rng.random(3000), np.ones(3000)], 1)
    shard = S.pack(items, 8)
    loads = np.stack([np.bincount(shard, items[:, k], 8) for k in range(3)], 1)
    assert np.ptp(loads[:, 0]) < 1e-3 * loads[:, 0].mean()
    assert (np.ptp(loads, axis=0) < 0.1 * loads.mean(0)).all()
    assert S.pack(np.zeros((0, 3)), 8).tolist() == []


def test_moves_for_bytes_keep_the_other_loads_near():
    rng = np.random.default_rng(5)
    items = np.stack([rng.pareto(2.0, 4000) + 1, rng.pareto(2.0, 4000) + 1, rng.integers(1, 30, 4000).astype(float)], 1)
    parts, shard = items / items.sum(0) * 8, S.pack(items, 8)
    loads = np.stack([np.bincount(shard, parts[:, k], 8) for k in range(3)], 1)
    assert np.ptp(loads[:, 0]) < 2e-3 and (np.ptp(loads, axis=0) < 0.01).all()


def test_a_group_above_a_cells_due_is_placed_by_itself(spark, texts):
    # two such groups that share a hash cell must not move as one
    rows = [(100 * g + k, t) for g, t in enumerate(texts(24, 40, 60)) for k in range(50)]
    out = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), S.ShardParams(cells=64)).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"), F.first("shard").alias("s")).collect()
    assert {r["n"] for r in out} == {1} and np.bincount([r["s"] for r in out], minlength=8).tolist() == [3] * 8


def test_shards(spark, documents):
    out = S.shard_documents(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(out) == len(texts)
    loads, slots, of_text = collections.Counter(), collections.defaultdict(list), {}
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert of_text.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_group_is_split(spark):
    rows = [(k, "the same text over and over") for k in range(3000)] + [(5000 + k, f"text {k}") for k in range(3000)]
    out = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    loads = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * max(loads)


def test_odd_shards(odd_documents, empty_documents):
    out = S.shard_documents(odd_documents)
    assert out.count() == 19 and out.where("size = 1").count() == 5
    assert S.shard_documents(empty_documents).count() == 0


def test_pipeline_keeps_its_contract(spark, folder, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == documents.columns, name
        assert 0 < out.count()
        if name != "mix":
            assert out.count() <= docs.count()
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "pieces"]


def test_language_stage_rejects_what_no_language_explains(spark, folder, documents):
    strange = spark.createDataFrame([(10**6, "12 34 !!", None, None, 8), (10**6 + 1, "Ω ж 漢 字 ψ щ ю " * 20, None, None, 9), (10**6 + 2, None, None, None, None)], documents.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, documents.unionByName(strange), folder).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()}


def test_quality_stage_rejects_junk_and_keeps_clean(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, docs, folder)
    clean, junk = (labels.where(f"quality = {q}").join(kept, "doc_id", "left_semi").count() / labels.where(f"quality = {q}").count() for q in (1, 0))
    assert clean > 0.99 and junk < 0.1


def test_duplicate_stage_keeps_one_of_each_class(spark, folder, documents):
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents, folder).collect()}
    classes = N.near_duplicates(documents).rows.collect()
    assert kept == {r["class_id"] for r in classes}


def test_run_gives_token_ids(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.where("n_pieces = size(piece_ids) and n_pieces > 0").count() == out.count() > 100
