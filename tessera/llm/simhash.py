"""Near-duplicates by SimHash, searched with vantage-point trees.

Two fingerprints of 64 bits with at most 4 differing ones differ by at most one bit in one of three parts of 21 or 22 bits,
so each part is searched by itself, with radius 1; what meets there is compared on all bits. The metric space of a part is
divided by a vantage-point tree: those within a distance of the vantage point go to one side, the others to the other, and by the triangle
inequality only those near the boundary have to be looked for on both sides. The upper levels of each tree, built from a
bounded sample, deal the fingerprints to shards: to its own, and as a visitor to those whose boundary it is near. Each shard's task
builds the lower levels from its own fingerprints, which are bounded, and lets the visitors stream by. What it gives are links
enough to join all that its links join; so one large group of near copies gives a link for each copy, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import CHUNK_BYTES, CLASSES, SPACE, slices, text_bytes, windows
from tessera.llm.neardup import components
from tessera.llm.shared import Scratch, materialize

#: Pairs that are compared at once.
_CELLS = 1 << 20


@dataclass(frozen=True)
class SimhashParams:
    words: int = 4  #: of a shingle
    seed: int = 42
    distance: int = 4  #: differing bits up to which fingerprints link
    parts: int = 3  #: of a fingerprint; one of them differs by at most distance // parts bits
    shard_rows: int = 1 << 14  #: distinct fingerprints that a shard is to have, and at most those of a block of it
    sample_rows: int = 1 << 18  #: most fingerprints from which the upper levels are built; 64 for each shard are drawn
    leaf_rows: int = 64  #: of a shard's tree


# fingerprints


def shingle_hashes(data: np.ndarray, params: SimhashParams) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text's words, ASCII letters in lower case; a long text comes in windows. A text of fewer words is one shingle."""
    import xxhash

    digest, held, n = xxhash.xxh64_intdigest, [], 0
    for a, b in windows(data, (CLASSES == SPACE,), CHUNK_BYTES):
        own = data[a:b].tobytes().lower().split()
        n += len(own)
        held += own
        if len(held) >= params.words:
            joined, ends = b" ".join(held), np.cumsum([len(w) + 1 for w in held])
            starts = np.append(0, ends)[: len(held) - params.words + 1].tolist()
            yield np.array([digest(joined[x:y], params.seed) for x, y in zip(starts, (ends[params.words - 1 :] - 1).tolist())], np.uint64)
            held = held[len(held) - params.words + 1 :]
    if 0 < n < params.words:
        yield np.array([digest(b" ".join(held), params.seed)], np.uint64)


def simhash(data: np.ndarray, params: SimhashParams = SimhashParams()) -> int:
    """The bits that are set in over half of the shingles' hashes; 0 without any word."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, params):
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(documents: DataFrame, params: SimhashParams = SimhashParams(), text: str = "text", result: str = "fingerprint") -> DataFrame:
    """Adds `result`, the fingerprint as a bigint. Null, empty and blank texts have 0. All rows and columns are kept; one of that name is replaced."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for first, part in slices(texts):
            data, offsets = text_bytes(part)
            for k in range(len(part)):
                out[first + k] = simhash(data[offsets[k] : offsets[k + 1]], params)
        return pa.array(out.view(np.int64))

    return documents.withColumn(result, prints.asNondeterministic()(F.col(text)))


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# vantage-point trees


def part_of(prints: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The bits of one part of each fingerprint."""
    first, last = 64 * part // parts, 64 * (part + 1) // parts
    return (prints >> np.uint64(first)) & np.uint64((1 << (last - first)) - 1)


@dataclass
class Tree:
    """Nodes (vantage point, radius, node within, node beyond), or leaves (first, last) of `order`; the root comes last."""

    nodes: list[tuple]
    order: np.ndarray  #: numbers of the values, leaf by leaf
    vantage: list[tuple[int, np.ndarray]]  #: the value that each inner node took as vantage point, and the node's values

    @classmethod
    def grow(cls, values: np.ndarray, leaf_rows: int, seed: int = 0) -> Tree:
        """Halves the values until a leaf has at most `leaf_rows`, or only equal ones."""
        tree, rng, placed = cls([], np.zeros(0, np.int64), []), np.random.default_rng(seed), []

        def node(own: np.ndarray) -> int:
            if len(own) > leaf_rows and (at := cls._split(values, own, rng)):
                vantage, radius, near = at
                tree.vantage.append((vantage, own))
                found = (values[vantage], radius, node(own[near]), node(own[~near]))
            else:
                found = (sum(map(len, placed)), sum(map(len, placed)) + len(own))
                placed.append(own)
            tree.nodes.append(found)
            return len(tree.nodes) - 1

        node(np.arange(len(values)))
        tree.order = np.concatenate(placed) if placed else tree.order
        return tree

    @staticmethod
    def _split(values: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
        """Of a few vantage points the one with the widest spread of distances; None if all values are equal."""
        tried = rng.choice(own, min(5, len(own)), replace=False)
        away = np.bitwise_count(values[own] ^ values[tried][:, None]).astype(np.int64)
        best = int(np.argmax(away.std(axis=1)))
        away = away[best]
        if away.max() == away.min():
            vantage = own[0]  # all tried ones are equally far from all, as where all are equal
            away = np.bitwise_count(values[own] ^ values[vantage]).astype(np.int64)
            if away.max() == 0:
                return None
        else:
            vantage = tried[best]
        radius = min(int(np.median(away)), int(away.max()) - 1)
        return int(vantage), radius, away <= radius

    def search(self, values: np.ndarray, reach: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        """Each leaf with the numbers of the values that may have a neighbour within `reach` there, and whether they belong there."""
        todo = [(len(self.nodes) - 1, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            at, own, home = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                yield node, own, home
                continue
            vantage, radius, within, beyond = node
            away = np.bitwise_count(values[own] ^ vantage).astype(np.int64)
            for child, near, belongs in ((within, away - reach <= radius, away <= radius), (beyond, away + reach > radius, away > radius)):
                todo.append((child, own[near], home[near] & belongs[near]))


class Shard:
    """The fingerprints of a shard, or of a block of one, and which of them links have joined so far: those have one label."""

    def __init__(self, prints: np.ndarray, part: int, params: SimhashParams):
        self.prints, self.part, self.params = prints, part, params
        self.labels = np.arange(len(prints))
        self.tree = Tree.grow(self._values(prints), params.leaf_rows)

    def _values(self, prints: np.ndarray) -> np.ndarray:
        return part_of(prints, self.part, self.params.parts)

    def own_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links between the shard's own: first with the vantage points, which join most of a large group, then by searching for each."""
        links: list[tuple[int, int]] = []
        numbers = np.arange(len(self.prints))
        for vantage, own in self.tree.vantage:
            self._join(self.prints, numbers, np.array([vantage]), own, links)
        self._search(self.prints, numbers, links)
        return self._as_prints(self.prints, links)

    def links_with(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of visiting fingerprints with the shard's own; two of these that a visitor joins stay joined."""
        links: list[tuple[int, int]] = []
        n = len(self.prints)
        numbers = np.arange(n, n + len(visitors))
        self.labels = np.append(self.labels, numbers)
        self._search(visitors, numbers, links)
        self.labels = self.labels[:n]
        return self._as_prints(visitors, links)

    def _as_prints(self, asked: np.ndarray, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(links, np.int64).reshape(-1, 2)
        return asked[both[:, 0]], self.prints[both[:, 1]]

    def _search(self, asked: np.ndarray, numbers: np.ndarray, links: list[tuple[int, int]]) -> None:
        """`numbers`: places of the asked fingerprints' labels."""
        for (first, last), own, _ in self.tree.search(self._values(asked), self.params.distance // self.params.parts):
            members = self.tree.order[first:last]
            found, counts = np.unique(self.labels[members], return_counts=True)
            main = found[np.argmax(counts)]
            alike = self.labels[members] == main
            # what has the leaf's main label needs no comparison with others of that, so a leaf of one large group is cheap
            for rows, side in ((own[self.labels[numbers[own]] != main], members[alike]), (own, members[~alike])):
                step = max(1, _CELLS // max(1, len(side)))
                for at in range(0, len(rows) if len(side) else 0, step):
                    self._join(asked, numbers, rows[at : at + step], side, links)

    def _join(self, asked: np.ndarray, numbers: np.ndarray, rows: np.ndarray, members: np.ndarray, links: list[tuple[int, int]]) -> None:
        """Compares asked[rows] with all members; of what has different labels and is near, keeps one link for each two labels."""
        i, j = np.nonzero(np.bitwise_count(asked[rows][:, None] ^ self.prints[members]) <= self.params.distance)
        a, b = self.labels[numbers[rows[i]]], self.labels[members[j]]
        _, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
        for k in first[a[first] != b[first]].tolist():
            row, member = int(rows[i[k]]), int(members[j[k]])
            x, y = sorted((int(self.labels[numbers[row]]), int(self.labels[member])))
            if x != y:
                links.append((row, member))
                self.labels[self.labels == y] = x


# the search over all shards


def _dealt(nodes: DataFrame, trees: list[Tree], params: SimhashParams) -> DataFrame:
    """(shard, home, fingerprint) of each fingerprint in its own shard of each part, and as a visitor in those it is near the boundary of."""
    firsts = [sorted(n[0] for n in t.nodes if len(n) == 2) for t in trees]

    @F.arrow_udf("array<struct<shard: bigint, home: boolean>>")
    def shards(column: pa.Array) -> pa.Array:
        prints = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        rows, to, homes, base = [], [], [], 0
        for part, tree in enumerate(trees):
            for (first, _), own, home in tree.search(part_of(prints, part, params.parts), params.distance // params.parts):
                rows.append(own)
                to.append(np.full(len(own), base + firsts[part].index(first)))
                homes.append(home)
            base += len(firsts[part])
        rows, to, homes = (np.concatenate(x) for x in (rows, to, homes))
        order = np.argsort(rows, kind="stable")
        values = pa.StructArray.from_arrays([pa.array(to[order]), pa.array(homes[order])], ["shard", "home"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(prints)))), pa.int32()), values)

    return nodes.select("fingerprint", F.explode(shards("fingerprint")).alias("to")).select("to.*", "fingerprint")


def near_pairs(nodes: DataFrame, params: SimhashParams = SimhashParams(), scratch: Scratch | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints of `nodes` (fingerprint bigint), enough to join all that links join. Every row is an actual link."""
    keep = scratch.keep if scratch else materialize
    n = nodes.count()
    if n == 0:
        return nodes.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    n_shards = math.ceil(n / params.shard_rows)
    drawn = nodes.orderBy(F.xxhash64(F.lit("sample"), "fingerprint")).limit(min(params.sample_rows, 64 * n_shards)).toPandas()["fingerprint"]
    sample = np.sort(drawn.to_numpy(np.int64)).view(np.uint64)
    trees = [Tree.grow(part_of(sample, part, params.parts), math.ceil(len(sample) / n_shards), part) for part in range(params.parts)]
    leaves = [sum(len(x) == 2 for x in t.nodes) for t in trees]
    part_ends = np.cumsum(leaves)
    dealt = keep(_dealt(nodes, trees, params), "simhash-dealt")
    blocks = dealt.where("home").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / params.shard_rows).cast("int").alias("blocks"))
    placed = dealt.join(blocks, "shard").withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("fingerprint"), "blocks").cast("int")))
    every = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select("shard", "block", (~F.col("block").eqNullSafe(F.col("own"))).alias("visits"), "fingerprint")
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, sum(leaves))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, shard = None, [], None

        def grown() -> Shard:
            return Shard(np.concatenate(own), int(np.searchsorted(part_ends, key[0], "right")), params)

        def told(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links], names=["a", "b"])

        for batch in batches:
            shards, numbers, visits, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = prints.astype(np.int64).view(np.uint64)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(numbers) != 0) | (visits[1:] != visits[:-1])) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(prints)]):
                if key != (shards[x], numbers[x]):
                    if own and shard is None:
                        yield told(grown().own_links())
                    key, own, shard = (shards[x], numbers[x]), [], None
                if not visits[x]:
                    own.append(prints[x:y])
                elif own:
                    if shard is None:
                        shard = grown()
                        yield told(shard.own_links())
                    yield told(shard.links_with(prints[x:y]))
        if own and shard is None:
            yield told(grown().own_links())

    return every.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "visits").mapInArrow(linked, "a bigint, b bigint")


def simhash_components(documents: DataFrame, params: SimhashParams = SimhashParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, fingerprint (bigint) and component_id of each row: the least id reachable by links between fingerprints.

    Equal fingerprints are one component; null, empty and blank texts have fingerprint 0, which links like any other. A null id counts
    in no minimum, a component without any id has a null component_id. Repeated rows stay. Other columns are dropped; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession)
    printed = materialize(with_fingerprint(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), params).select("id", "fingerprint"), "simhash-prints")
    nodes = scratch.keep(printed.groupBy("fingerprint").agg(F.min("id").alias("least")), "simhash-nodes")
    links = scratch.keep(near_pairs(nodes.select("fingerprint"), params, scratch).distinct(), "simhash-links")
    roots = components(links, scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = scratch.keep(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("fingerprint", "component_id"), "simhash-found")
    scratch.drop()
    return printed.join(found, "fingerprint").select(F.col("id").alias(doc_id), "fingerprint", "component_id")
