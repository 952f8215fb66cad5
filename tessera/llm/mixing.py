"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, laid end to end, are cut into blocks of equally many words. Each source has an exact
quota of blocks. A tree splits the quotas among the output shards: at each node the left half of the
shards draws its number of blocks from the node's, without replacement, over all sources at once. A
source's blocks, in an order that is permuted anew for each pass over the source, are then dealt to the shards by their
quotas, so that no two draws of a pass meet, and each shard is shuffled by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, ranked


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  #: of the sources by code point, null last, repeating
    most: float = 3.0  #: times its size that a source is taken at most
    n_shards: int = 64
    blocks: int = 64  #: of a source, unless they would be over max_block words or the tree too large; a document is cut only where a block ends
    max_block: int = 16_384
    max_draws: int = 1 << 26  #: draws that the tree can hold; beyond, blocks get longer
    seed: int = 20
    rounds: int = 12  #: of the permutation
    rows_per_cell: int = 50_000
    part_words: int = 1 << 26  #: words of a shard that one task shuffles; longer shards are shuffled in parts


@dataclass(frozen=True)
class SourcePlan:
    """What is drawn of one source. All numbers are exact; there is one plan for each source."""

    source: str | None
    size: int
    target: float
    words: int  #: to take, the target rounded
    block: int  #: words of a block
    n_blocks: int
    key: int  #: of the source's permutations: its number and the seed
    draws: int  #: blocks drawn, over all passes
    cut: int  #: words left out of the last block drawn
    bounds: tuple[int, ...]  #: draws of all shards up to each


def words_in(text: Column) -> Column:
    """Runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above `most` times its size; what that cuts off is shared again by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


def _hash(*values: int) -> int:
    """What xxhash64 of Spark gives for these longs."""
    out = 42
    for v in values:
        out = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=out)
    return out - (1 << 64) if out >= 1 << 63 else out


def place_of(block: int, n: int, key: int, draw_pass: int, rounds: int) -> int:
    """Place of a block in a pass over n blocks: in each round it may change places with its partner, as a hash of both says."""
    for r in range(rounds):
        partner = (_hash(key, draw_pass, r) - block) % n
        if _hash(key, draw_pass, r, max(block, partner)) & 1:
            block = partner
    return block


#: The same as place_of, of columns j, n_blocks, key and pass.
_PLACE = """
aggregate(sequence(0, {last}), cast(j as bigint), (x, r) ->
  if(xxhash64(key, cast(pass as bigint), cast(r as bigint), greatest(x, pmod(xxhash64(key, cast(pass as bigint), cast(r as bigint)) - x, n_blocks))) & 1L = 1L,
     pmod(xxhash64(key, cast(pass as bigint), cast(r as bigint)) - x, n_blocks), x))
"""


def plan(source: str | None, size: int, target: float, params: MixParams, total: int, key: int = 0) -> SourcePlan:
    """Block length and number of draws of a source, so that round(target) words are taken. A source's last block may be shorter."""
    words = min(round(target), math.floor(params.most * size))
    if not size:
        return SourcePlan(source, 0, target, 0, 1, 0, key, 0, 0, ())
    block = max(1, min(size // params.blocks, params.max_block), total // params.max_draws)
    n = -(-size // block)
    passes, rest = divmod(words, size)
    last = place_of(n - 1, n, key, passes, params.rounds)
    short = block * n - size
    draws = -(-rest // block)
    if draws > last:  # the shorter block is among them
        draws = max(last + 1, -(-(rest + short) // block))
    got = draws * block - (short if last < draws else 0)
    return SourcePlan(source, size, target, words, block, n, key, passes * n + draws, got - rest, ())


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) by each shard (rows): the tree's leaves. Columns sum to the quotas, rows differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n_shards, len(quotas)), np.int64)
    total = sum(quotas)
    due = lambda shard: total * shard // n_shards

    def split(first: int, last: int, own: np.ndarray) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        left = rng.multivariate_hypergeometric(own, due(middle) - due(first), method="marginals") if own.sum() else own
        split(first, middle, left)
        split(middle, last, own - left)

    split(0, n_shards, np.array(quotas, np.int64))
    return out


def mix_plan(sized: DataFrame, params: MixParams, weigh: Callable[[int], float] | None = None) -> tuple[list[SourcePlan], int]:
    """Plans of all sources, from their sizes alone (one row for each source), and the number of documents."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in sources]
    weigh = weigh or (lambda i: params.weights[i % len(params.weights)])
    aims = targets(sizes, [weigh(i) for i in range(len(sizes))], params.most)
    plans = [plan(r["source"], s, t, params, sum(sizes), params.seed * 1_000_003 + k) for k, (r, s, t) in enumerate(zip(sources, sizes, aims))]
    leaves = split_quotas([p.draws for p in plans], params.n_shards, params.seed).cumsum(0)
    return [SourcePlan(**(vars(p) | {"bounds": tuple(int(x) for x in leaves[:, k])})) for k, p in enumerate(plans)], sum(r["n"] for r in sources)


_DRAWS = """
transform(
  filter(
    flatten(transform(sequence(0, cast((draws - 1) div n_blocks as int)), pass ->
      transform(sequence(first_word div block, (first_word + size - 1) div block), j ->
        named_struct('block', j, 'draw', pass * n_blocks + {place}, 'pass', pass)))),
    d -> d.draw < draws),
  d -> named_struct(
    'pass', d.pass,
    'draw', d.draw,
    'shard', cast(size(filter(bounds, b -> b <= d.draw)) as int),
    'from_word', greatest(d.block * block - first_word, 0L),
    'to_word', least(least((d.block + 1) * block, source_size) - if(d.draw = draws - 1, cut, 0L) - first_word, size)))
"""

#: The first of each stretch of draws of one pass and shard that follow each other in the document.
_SPANS = """
filter(sequence(0, size(draws) - 1), i ->
  i = 0 or draws[i].pass != draws[i - 1].pass or draws[i].shard != draws[i - 1].shard or draws[i].from_word != draws[i - 1].to_word)
"""


@dataclass(frozen=True)
class Draws:
    """What is drawn of each document, and the documents. words: that the mix takes."""

    slim: DataFrame  #: (uid, source, size, source_size, target, told, first_word, draws)
    table: DataFrame  #: (uid, row)
    words: int

    @property
    def rows(self) -> DataFrame:
        """(row, source, size, source_size, target, told, first_word, draws), one for each document."""
        return self.table.join(self.slim, "uid").drop("uid")


def draw(documents: DataFrame, params: MixParams = MixParams(), text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> Draws:
    """What is drawn of each document. draws: structs of pass, draw, shard, from_word and to_word (not included), in words of the text.

    `row` is a struct of the columns to keep, all if not given; first_word is where the document begins in its source, and told a hash of the text.
    The plan is one small row for each source and is joined to the documents by broadcast; the number of
    sources is the only thing it grows with. Null texts have size 0; null sources are one source, the last.
    A document without words is never drawn: its draws are null. Repeated rows are documents of their own.
    """
    own = {"size": words_in(F.col(text)), "source": F.col(source), "doc_id": F.col(doc_id), "told": F.xxhash64(F.col(text))}
    sized = documents.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(keep or documents.columns)).alias("row"), *[c.alias(k) for k, c in own.items()])
    sized = materialize(sized, "mix-sized")
    plans, n = mix_plan(sized.select("source", "size"), params)
    schema = "plan_source string, source_size long, target double, block long, n_blocks long, key long, draws long, cut long, bounds array<long>"
    table = [(p.source, p.size, p.target, p.block, p.n_blocks, p.key, p.draws, p.cut, list(p.bounds)) for p in plans]
    known = documents.sparkSession.createDataFrame(table, schema)
    placed = ranked(sized.drop("row"), ["source"], ["doc_id", "size", "told"], F.col("size"), "first_word", max(16, math.ceil(n / params.rows_per_cell)))
    joined = placed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("plan_source")))
    draws = F.expr(_DRAWS.format(place=_PLACE.format(last=params.rounds - 1)))
    drawn = F.when((F.col("size") > 0) & (F.col("draws") > 0), F.filter(draws, lambda d: d["to_word"] > d["from_word"]))
    slim = joined.select("uid", "source", "size", "source_size", "target", "told", "first_word", drawn.alias("draws"))
    return Draws(slim, sized.select("uid", "row"), sum(p.words for p in plans))


def taken(draws: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    words = F.aggregate(draws, F.lit(0).cast("long"), lambda total, d: total + d["to_word"] - d["from_word"])
    return F.coalesce(words, F.lit(0).cast("long"))


def mix_sources(documents: DataFrame, params: MixParams = MixParams(), text: str = "text", source: str = "source", doc_id: str = "doc_id", drawn: Draws | None = None) -> DataFrame:
    """The mixed rows, shuffled within each shard: the documents' columns with `text` cut to what was drawn, and mix_shard, mix_place and mix_first.

    Draws of one pass and shard that follow each other in a document are one row. A document drawn in several passes comes
    once for each, and one whose blocks went to several shards once for each of these stretches. mix_place is a hash; the rows of a shard are
    sorted by it. A shard of more than `params.part_words` words is shuffled in several parts, each with a range of places. mix_first is the word
    of its source with which the row's document begins. Columns of these names are replaced. Null, empty and blank texts are never drawn.
    `drawn`: what `draw` gave for the same documents.
    """
    drawn = drawn or draw(documents, params, text, source, doc_id)
    starts = drawn.slim.where(F.size("draws") > 0).withColumn("starts", F.expr(_SPANS))
    spans = F.expr("""transform(starts, (i, k) -> named_struct('pass', draws[i].pass, 'shard', draws[i].shard, 'from_word', draws[i].from_word,
      'to_word', draws[if(k + 1 < size(starts), starts[k + 1], size(draws)) - 1].to_word))""")
    slim = materialize(starts.select("uid", "size", "told", "first_word", F.explode(spans).alias("span")), "mix-spans")
    rows = drawn.table.join(slim, "uid")
    content = F.col("row")[text]
    whole = (F.col("span.from_word") == 0) & (F.col("span.to_word") == F.col("size"))
    words = F.expr(r"regexp_extract_all(row.`%s`, '\\s*[^\\x20\\x09-\\x0D]+', 0)" % text)
    part = F.ltrim(F.array_join(F.slice(words, (F.col("span.from_word") + 1).cast("int"), (F.col("span.to_word") - F.col("span.from_word")).cast("int")), ""))
    kept = [F.when(whole, content).otherwise(part).alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns if c not in ("mix_shard", "mix_place", "mix_first")]
    place = F.xxhash64(F.lit("place"), F.lit(params.seed), F.col("row")[doc_id], "told", "span.pass", "span.from_word")
    mixed = rows.select(*kept, F.col("span.shard").alias("mix_shard"), place.alias("mix_place"), F.col("first_word").alias("mix_first"))
    parts = max(1, math.ceil(drawn.words / params.n_shards / params.part_words))
    part_of = F.floor((F.col("mix_place") / F.lit(2.0**64) + 0.5) * parts)
    return mixed.repartition(params.n_shards * parts, "mix_shard", part_of).sortWithinPartitions("mix_shard", "mix_place")
