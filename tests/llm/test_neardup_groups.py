"""Near-duplicates: what is shuffled, and large buckets of texts that no link joins."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup as N
from tessera.llm.shared import may_be_among, without


def test_rows_without_some_keys(spark):
    rows, gone = spark.range(50_000).withColumnRenamed("id", "uid").withColumn("x", F.col("uid") * 2), spark.range(0, 50_000, 7).withColumnRenamed("id", "uid")
    among = may_be_among(gone)
    assert gone.where(~among(F.col("uid"))).count() == 0 and rows.where(among(F.col("uid"))).count() < 0.3 * 50_000
    assert sorted(r["uid"] for r in without(rows, gone, "uid").collect()) == [k for k in range(50_000) if k % 7]
    assert without(rows, gone.limit(0), "uid").count() == 50_000 and without(rows, rows.select("uid"), "uid").count() == 0


def word(k):
    return "q" + "".join(chr(ord("a") + int(c)) for c in str(k))


@pytest.mark.parametrize("block", [1000, 20])
def test_a_large_bucket_of_unlike_texts_makes_no_rows_of_pairs(spark, monkeypatch, block):
    """Each text is a pair of words repeated and 90 of the same 120 words in an order of its own: words allow all pairs, few are links."""
    rng, made, align = random.Random(4), [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, words, params: (made.append(pairs.count()), align(pairs, words, params))[1])
    own = [[word(k) for k in rng.sample(range(120), 90)] for _ in range(50)]
    own += [words[:40] + rng.sample(words[40:], 50) for words in own[:10]]
    rows = [(k, " ".join(words + ["is", "so"] * 120)) for k, words in enumerate(own)]
    texts = spark.createDataFrame(rows, "uid long, __text string")
    sketched = N._sketched(texts, "__text", N.NeardupParams()).select(F.col("uid").alias("node"), "__sketch.*")
    buckets = F.array(*[F.lit(k).cast("long") for k in (-5, 3, 9)])
    got = {r["node"]: r["root"] for r in N.components(N._links(sketched.withColumn("bands", buckets), texts, N.NeardupParams(block=block))).collect()}
    words = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for _, t in rows]
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    longest = np.array([max(len(words[a]), len(words[b])) for a, b in pairs])
    far = N.banded_distances([words[a] for a, _ in pairs], [words[b] for _, b in pairs], np.floor(0.2 * longest + 1e-9).astype(np.int64))
    root = {k: k for k in range(60)}
    for (a, b), d in zip(pairs, far):
        if d >= 0 and root[a] != root[b]:
            root |= {k: min(root[a], root[b]) for k in root if root[k] in (root[a], root[b])}
    several = {r for r, n in collections.Counter(root.values()).items() if n > 1}
    assert got == {k: r for k, r in root.items() if r in several} and len(several) > 5 and len(set(root.values())) > 40
    assert sum(made) <= 2 * 60


def test_each_pair_is_compared_in_one_of_its_buckets():
    rng = np.random.default_rng(3)
    node, bands = rng.integers(0, 1 << 40, 40), np.sort(rng.integers(0, 1 << 63, 12).astype(np.uint64) * np.uint64(2))
    own = [np.sort(rng.choice(12, rng.integers(1, 9), replace=False)) for _ in node]
    seen = collections.Counter()
    for k, band in enumerate(bands):
        members = np.array([m for m in range(40) if k in own[m]])
        buckets = [bands[own[m]] for m in members]
        known, held = np.unique(np.concatenate(buckets)), N.Lists.of(buckets)
        for i in range(len(members) - 1):
            seen.update((members[i], members[j]) for j in N.met_here(int(band), known, node[members], held, i, np.arange(i + 1, len(members))))
    assert seen == {(i, j): 1 for i in range(40) for j in range(i + 1, 40) if len(np.intersect1d(own[i], own[j]))}


def test_words_allow_equals_brute_force():
    rng, params = np.random.default_rng(5), N.NeardupParams()
    words = [rng.integers(0, 9, rng.integers(1, 12)).astype(np.uint32) for _ in range(60)]
    n, bags = np.array([len(w) for w in words]), N.Lists.of(words)
    for i in range(60):
        want = [j for j in range(60) if N._may_match(words[i], words[j], int(0.2 * max(n[i], n[j]) + 1e-9))]
        assert N.words_allow(n, bags, i, np.arange(60), params).tolist() == want


def _joined_rows(plan):
    """Rows that each join of a plan that ran has made."""
    name, rows = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return _joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _joined_rows(plan.plan())
    if "Join" in name:
        rows.append((plan.simpleString(100), plan.metrics().get("numOutputRows").get().value()))
    children = plan.children()
    for k in range(children.size()):
        rows += _joined_rows(children.apply(k))
    return rows


def test_words_are_joined_once_for_a_text_not_once_for_each_of_its_buckets(spark):
    """A group of texts that share 40 buckets; the first two are near."""
    n, bands = 50, 40
    texts = spark.createDataFrame([(k, " ".join(word((k if k > 1 else 0) * 30 + i if i < 25 else k) for i in range(30))) for k in range(n)], "uid long, __text string")
    sketched = N._sketched(texts, "__text", N.NeardupParams()).select(F.col("uid").alias("node"), "__sketch.n", "__sketch.bits").persist()
    members = sketched.select("node", "n", F.col("node").alias("root"), F.explode(F.sequence(F.lit(1), F.lit(bands)).cast("array<bigint>")).alias("band"))
    found = N._met_all(members, sketched, N.word_lists(texts, N.NeardupParams()), N.NeardupParams())
    assert [(r["a"], r["b"]) for r in found.collect()] == [(0, 1)]
    rows = [r for text, r in _joined_rows(found._jdf.queryExecution().executedPlan()) if "[node" in text]
    assert len(rows) == 2 and max(rows) == n


def test_rounds_with_leaders_copy_no_members(spark, monkeypatch):
    """A group of unlike texts that share all buckets: its members leave their table once, for the last step, not once a round."""
    n, bands, made = 30, 8, []
    texts = spark.createDataFrame([(k, " ".join(word((k if k > 1 else 0) * 30 + i if i < 25 else k) for i in range(30))) for k in range(n)], "uid long, __text string")
    sketched = N._sketched(texts, "__text", N.NeardupParams()).select(F.col("uid").alias("node"), "__sketch.*")
    frame, join = type(texts), type(texts).join

    def counted(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if how == "left_semi":
            made.append(found.count())
        return found

    monkeypatch.setattr(frame, "join", counted)
    links = N._links(sketched.withColumn("bands", F.array(*[F.lit(k).cast("long") for k in range(bands)])), texts, N.NeardupParams())
    assert {(r["a"], r["b"]) for r in links.collect()} == {(0, 1)}
    assert sum(made) <= n * bands


def test_words_of_a_pair_are_counted_in_one_bucket(monkeypatch):
    """All members share five buckets; in each all pairs come by, in one of them with their words."""
    rng, params, allow, seen = np.random.default_rng(9), N.NeardupParams(), N.words_allow, collections.Counter()
    monkeypatch.setattr(N, "words_allow", lambda n, bags, i, others, p: (seen.update((i, j) for j in others.tolist()), allow(n, bags, i, others, p))[1])
    words = [rng.integers(0, 9, rng.integers(8, 12)).astype(np.uint32) for _ in range(40)]
    node, n, bands = rng.integers(0, 1 << 40, 40), np.array([len(w) for w in words]), np.sort(rng.integers(0, 1 << 63, 5).astype(np.uint64))
    bags, held, found = N.Lists.of(words), N.Lists.of([bands] * 40), collections.Counter()
    for band in bands.tolist():
        for i in range(39):
            found.update((i, j) for j in N.possible_here(band, bands, node, held, n, bags, i, np.arange(i + 1, 40), params).tolist())
    assert seen == {(i, j): 1 for i in range(40) for j in range(i + 1, 40)}
    assert found == {(i, j): 1 for i in range(40) for j in range(i + 1, 40) if N._may_match(words[i], words[j], int(0.2 * max(n[i], n[j]) + 1e-9))}


def test_a_leader_meets_one_member_of_each_other_root(spark):
    """Two roots of twenty members, one of a member too long for a link with the leader."""
    rows = [(7, k, 100, 20, k // 20 * 20, k % 20) for k in range(40)] + [(7, 40, 130, 21, 40, 0)]
    placed = spark.createDataFrame(rows, "band long, node long, n long, class int, root long, degree long")
    met = N._met_leaders(N._one_of_each_root(placed), N._leaders(placed).where("of = 20"), N.NeardupParams())
    assert [tuple(r) for r in met.collect()] == [(39, 19)]


def test_a_round_makes_one_row_of_a_member_in_a_bucket(spark, monkeypatch):
    """Unlike texts of three neighbouring length classes share all buckets: most members meet three leaders, the same ones in each bucket."""
    lengths, bands, made, possible = [28] * 3 + [31] * 20 + [36] * 3, 8, [], N._possible
    texts = spark.createDataFrame([(k, " ".join(word(k * 40 + i) for i in range(n))) for k, n in enumerate(lengths)], "uid long, __text string")
    sketched = N._sketched(texts, "__text", N.NeardupParams()).select(F.col("uid").alias("node"), "__sketch.*")

    def seen(met, facts, params):
        rows = sorted((r["node"], r["leader"]) for r in met.collect())
        made.append((rows, sum(r for text, r in _joined_rows(met._jdf.queryExecution().executedPlan()) if "[band" in text)))
        return possible(met, facts, params)

    monkeypatch.setattr(N, "_possible", seen)
    links = N._links(sketched.withColumn("bands", F.array(*[F.lit(k).cast("long") for k in range(bands)])), texts, N.NeardupParams())
    assert links.isEmpty()
    (_, _), (rows, joined) = made
    near = [(k, lead) for k, n in enumerate(lengths) for lead in (0, 3, 23) if k != lead and abs(n - lengths[lead]) <= 0.2 * max(n, lengths[lead])]
    assert rows == near and len(near) > 2 * len(lengths)
    assert 0 < joined <= len(lengths) * bands


def test_lists_of_leaders_give_the_pairs_of_leaders(spark):
    rng, params = random.Random(8), N.NeardupParams()
    nodes = [(k, rng.randint(20, 60), rng.choice([k, k // 7]), rng.randint(0, 3)) for k in range(120)]
    rows = [(band, k, n, r, d) for k, n, r, d in nodes for band in rng.sample(range(12), 4)]
    placed = spark.createDataFrame(rows, "band long, node long, n long, root long, degree long").withColumn("class", N._length_class(F.col("n"), params))
    want = N._met_leaders(N._one_of_each_root(placed), N._leaders(placed), params).distinct().collect()
    got = N._met_in_lists(N._one_of_each_root(placed), N._led_buckets(placed), params).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 200
