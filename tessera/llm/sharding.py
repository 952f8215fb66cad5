"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Copies of a text stay together, unless they are too many for that. A group that outweighs 1 / cells of all
bytes, tokens or rows is an item of its own, lighter ones are hashed into a few thousand cells, which are items;
a group that outweighs `piece_share` of everything is split by a hash of its ids. Items are placed, the heaviest
first, where the dot product with the shard's residual capacity is highest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, ranked


@dataclass(frozen=True)
class ShardParams:
    n_shards: int = 8
    cells: int = 4096  #: of hashed light groups; with at most three times as many heavy groups, and pieces, they are all the driver sees
    piece_share: float = 1 / 16  #: part of all bytes, tokens or rows above which a group is split
    rows_per_cell: int = 50_000  #: rows that one window partition numbers


#: Part of a shard's due by which tokens and rows of two shards may come to differ for the sake of bytes.
SLACK = 0.02

_DIMENSIONS = ("size", "tokens", "one")


def pack(items: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), by the dot product with residual capacity.

    Among the shards that still hold the item in bytes, the highest dot product wins, then the lowest shard;
    where none does, the shard with most bytes left. The last, light items thus even out the bytes.
    """
    total = np.maximum(items.sum(0), 1e-9) if len(items) else np.ones(items.shape[1])
    parts = items / total * n_shards  # of one shard's capacity
    left = np.ones((n_shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -parts.max(1))):
        item = parts[k]
        fit = left[:, 0] >= item[0]
        best = int(np.argmax(np.where(fit, left @ item, -np.inf))) if fit.any() else int(np.argmax(left[:, 0]))
        left[best] -= item
        out[k] = best
    return _levelled(parts, out, n_shards)


def _levelled(parts: np.ndarray, shard: np.ndarray, n_shards: int) -> np.ndarray:
    """Moves single items from the shard with most bytes to the one with least while that brings their bytes closer.

    Of the items that do, the one that brings bytes, tokens and rows of the two shards closest together moves; when none brings all three
    closer, the one that is best for bytes among those that widen no gap of the others beyond `SLACK` of a shard.
    """
    load = np.zeros((n_shards, parts.shape[1]))
    np.add.at(load, shard, parts)
    for _ in range(len(parts)):
        full, empty = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[full] - load[empty]
        own = np.flatnonzero((shard == full) & (parts[:, 0] < gap[0]) & (parts[:, 0] > 0))
        after = np.abs(gap - 2 * parts[own])
        closer = (after**2).sum(1) < (gap**2).sum()
        bounded = (after <= np.maximum(np.abs(gap), SLACK)).all(1)
        if gap[0] < 1e-7 or not (closer | bounded).any():
            break
        cost = (after**2).sum(1) if closer.any() else after[:, 0]
        k = own[np.argmin(np.where(closer if closer.any() else bounded, cost, np.inf))]
        shard[k] = empty
        load[full] -= parts[k]
        load[empty] += parts[k]
    return shard


def shard_documents(documents: DataFrame, params: ShardParams = ShardParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard) of every row of `documents`.

    size: UTF-8 bytes of the text plus 1; tokens: its runs of characters other than ASCII white space. The law
    is `bytes`: sizes near equal, as nearly as single rows allow. slot numbers a shard's rows from 0 without
    gaps. Null and empty texts are one group of size 1 a row; null ids and repeated rows are rows like any
    other. An empty table gives an empty result. Reruns agree, but for which of several equal rows gets which slot.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(content)).alias("__group"),
    )
    rows = materialize(rows, "shard-rows").withColumn("one", F.lit(1))
    spark = rows.sparkSession
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _DIMENSIONS]).first()
    limits = {c: max(1, math.floor(totals[c] * params.piece_share)) for c in _DIMENSIONS}
    pieces = F.greatest(*[F.ceil(F.col(c) / F.lit(limits[c])) for c in _DIMENSIONS])
    outweighs = F.greatest(*[F.col(c) * params.cells > F.lit(totals[c]) for c in _DIMENSIONS])
    # at most 3 * cells groups outweigh that
    groups = rows.groupBy("__group").agg(*[F.sum(c).alias(c) for c in _DIMENSIONS]).where(outweighs).select("__group", F.greatest(pieces, F.lit(1)).alias("pieces"))
    piece = F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.col("pieces"))
    light = F.pmod(F.xxhash64("__group"), F.lit(params.cells))
    rows = rows.join(F.broadcast(groups), "__group", "left").withColumn("__item", F.when(F.col("pieces").isNull(), F.concat(F.lit("cell "), light)).otherwise(F.concat(F.hex("__group"), F.lit(" "), piece)))
    rows = materialize(rows.drop("pieces"), "shard-items")
    items = sorted(rows.groupBy("__item").agg(*[F.sum(c).alias(c) for c in _DIMENSIONS]).collect())
    placed = pack(np.array([[r[c] for c in _DIMENSIONS] for r in items], float).reshape(-1, 3), params.n_shards)
    where = spark.createDataFrame([(r["__item"], int(k)) for r, k in zip(items, placed)], "__item string, shard int")
    placed_rows = rows.join(F.broadcast(where), "__item")
    cells = max(16, math.ceil(totals["one"] / params.rows_per_cell))
    numbered = ranked(placed_rows, ["shard"], ["doc_id", "__group"], F.lit(1), "slot", cells)
    return numbered.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
