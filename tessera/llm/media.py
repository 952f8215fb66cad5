"""Media columns: payloads stored as audio of 8-bit samples, in content-defined chunks that are kept once.

A rolling gear hash cuts a payload where its last bytes say so, so that equal stretches of different media
give equal chunks. Spark joins find the digests that occur more than once; their bytes go to a chunk table,
each once, the others stay in their medium's manifest. A manifest's ordered chunk list rebuilds the medium,
which is verified by its digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, slices, text_bytes
from tessera.llm.shared import materialize, shared_path

#: Random value of each byte; fixed by rule.
_GEAR = (mix(np.arange(256, dtype=np.uint64), 41) >> np.uint64(32)).astype(np.uint32)
_WINDOW = 32


@dataclass(frozen=True)
class MediaParams:
    unit: int = 64  #: payloads are padded with 0 to a positive multiple
    min_chunk: int = 256  #: bytes; at least the 32 of the rolling hash
    mask_bits: int = 10  #: a cut every 2**mask_bits bytes or so
    max_chunk: int = 8192
    rate: int = 8000  #: samples a second
    cells_each: int = 256  #: bits of the filter that tells which digests may be shared, for each of them
    most_bits: int = 28  #: of the filter: 2**most_bits, 32 MB; beyond, more chunks are taken for shared that aren't


def wav_header(n: int, rate: int) -> bytes:
    """Header of a mono audio file of n unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)


def wav_samples(stored: bytes) -> bytes:
    """The samples of a stored file, by its own header."""
    kind, _, form, fmt, _, coding, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", stored)
    if (kind, form, fmt, coding, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or len(stored) != 44 + n:
        raise ValueError("not an audio file of 8-bit samples")
    return stored[44:]


def _padded(texts: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payload bytes of all texts, where each begins (and the end), and bytes before padding."""
    data, offsets = text_bytes(texts)
    n = np.diff(offsets)
    size = np.maximum(1, -(-n // unit)) * unit
    starts = np.append(0, np.cumsum(size))
    out = np.zeros(starts[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] - offsets[:-1], n)] = data
    return out, starts, n


def cut_points(data: np.ndarray, starts: np.ndarray, params: MediaParams) -> list[np.ndarray]:
    """For each payload the ends of its chunks, within `data`."""
    h = _GEAR[data]
    reach = 1
    while reach < _WINDOW:  # doubles the stretch that each value sums up
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, reach * 2
    marks = np.flatnonzero(h >> np.uint32(32 - params.mask_bits) == 0) + 1
    out = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        ends, at = [], begin
        own = marks[np.searchsorted(marks, begin + params.min_chunk) : np.searchsorted(marks, end)].tolist()
        for mark in own:
            while mark - at > params.max_chunk:
                at += params.max_chunk
                ends.append(at)
            if mark - at >= params.min_chunk:
                ends.append(at := mark)
        while end - at > params.max_chunk:
            at += params.max_chunk
            ends.append(at)
        out.append(np.array([*ends, end] if at < end else ends))
    return out


def _chunked(texts: pa.Array, params: MediaParams):
    """For each text: (bytes before padding, payload, its chunks)."""
    for _, part in slices(texts, 1 << 20):
        data, starts, n = _padded(part, params.unit)
        for k, ends in enumerate(cut_points(data, starts, params)):
            begins = [int(starts[k]), *ends[:-1].tolist()]
            yield int(n[k]), data[starts[k] : starts[k + 1]].tobytes(), [data[a:b].tobytes() for a, b in zip(begins, ends.tolist())]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


_BLOCK = 1 << 16  #: bits of the filter that are made in one group


def _possibly_shared(digests: DataFrame, params: MediaParams) -> np.ndarray:
    """A bitmap in which each digest (a long) that occurs more than once in `digests` has its cell set.

    It has `params.cells_each` cells for each such digest, up to a fixed bound, so as the corpus grows the part of its cells that is
    set stays; where the bound is met, more chunks go to the chunk table than need to.
    """
    seen = materialize(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "media-shared")
    bits = min(params.most_bits, max(16, (params.cells_each * seen.count()).bit_length()))
    cell = F.col("digest").bitwiseAND((1 << bits) - 1)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(_BLOCK, bool)
        own[rows["cell"].to_numpy() % _BLOCK] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    cells = seen.select(cell.alias("cell")).distinct().withColumn("block", F.shiftright("cell", _BLOCK.bit_length() - 1))
    out = np.zeros((1 << bits) // _BLOCK * (_BLOCK // 8), np.uint8).reshape(-1, _BLOCK // 8)
    for r in cells.groupBy("block").applyInPandas(block, "block long, bits binary").collect():  # at most 2**most_bits bits in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


@dataclass(frozen=True)
class MediaStore:
    """Folders of the two tables. manifests: (medium, keys, n_bytes, media_sha256, header, chunks), with keys a struct and chunks an
    ordered array of digest and, if kept there, bytes. chunks: (digest, bytes), each digest once."""

    manifests: str
    chunks: str


def store_media(documents: DataFrame, store: MediaStore, keys: list[str], params: MediaParams = MediaParams(), text: str = "text") -> None:
    """Write every text (null: empty) as a medium. Adds to a store that exists: chunks that its chunk table has are not written again, and of
    a chunk that so far only one manifest holds the table gets a copy, to which all later media refer.

    `keys` are kept in the manifests, whatever they are called. Repeated rows and equal texts are media of their own whose chunks are shared.
    """
    spark = documents.sparkSession
    piece = "struct<digest: binary, bytes: binary>"

    @F.arrow_udf("array<bigint>")
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([[_short(hashlib.sha256(c).digest()) for c in chunks] for _, _, chunks in _chunked(texts, params)], pa.list_(pa.int64()))

    all_digests = documents.select(F.explode(digests(F.col(text))).alias("digest"))
    manifests = _existing(spark, store.manifests, f"chunks array<{piece}>")
    if manifests is not None:
        first = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
        all_digests = all_digests.unionByName(manifests.select(F.explode("chunks.digest").alias("digest")).select(first.alias("digest")))
    shared = spark.sparkContext.broadcast(_possibly_shared(all_digests, params))

    def listed(counts: list[int], digests: list[bytes], content: list[bytes | None]) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(content, pa.binary())], ["digest", "bytes"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)

    def may_share(digest: bytes) -> bool:
        cell = _short(digest) & (8 * len(shared.value) - 1)
        return bool(int(shared.value[cell >> 3]) >> (cell & 7) & 1)

    @F.arrow_udf(f"struct<n_bytes: bigint, media_sha256: string, header: binary, chunks: array<{piece}>>")
    def manifest(texts: pa.Array) -> pa.Array:
        sizes, media, headers, counts, digests, content = [], [], [], [], [], []
        for n, payload, chunks in _chunked(texts, params):
            headers.append(wav_header(len(payload), params.rate))
            media.append(hashlib.sha256(headers[-1] + payload).hexdigest())
            sizes.append(n)
            counts.append(len(chunks))
            for c in chunks:
                digests.append(hashlib.sha256(c).digest())
                content.append(None if may_share(digests[-1]) else c)
        parts = [pa.array(sizes, pa.int64()), pa.array(media, pa.string()), pa.array(headers, pa.binary()), listed(counts, digests, content)]
        return pa.StructArray.from_arrays(parts, ["n_bytes", "media_sha256", "header", "chunks"])

    @F.arrow_udf(f"array<{piece}>")
    def sharable(texts: pa.Array) -> pa.Array:
        counts, digests, content = [], [], []
        for _, _, chunks in _chunked(texts, params):
            found = {d: c for c in chunks if may_share(d := hashlib.sha256(c).digest())}
            counts.append(len(found))
            digests += found.keys()
            content += found.values()
        return listed(counts, digests, content)

    medium = F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.monotonically_increasing_id().cast("string"))
    own = documents.select(medium.alias("medium"), F.struct(*keys).alias("keys"), manifest(F.col(text)).alias("m"))
    own.select("medium", "keys", "m.*").write.mode("append").option("compression", "zstd").parquet(store.manifests)
    found = documents.select(F.explode(sharable(F.col(text))).alias("c")).select("c.*")
    once = found.groupBy("digest").agg(F.first("bytes").alias("bytes"))
    known = _existing(spark, store.chunks, "digest binary")
    if known is not None:
        once = once.join(known, "digest", "left_anti")
    once.write.mode("append").option("compression", "zstd").parquet(store.chunks)


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def read_media(spark: SparkSession, store: MediaStore, keys: list[str]) -> DataFrame:
    """(keys..., n_bytes, media_sha256, media): media rebuilt from their chunk lists, in order, and verified.

    A medium whose chunks are all in its manifest needs no join. A chunk that is missing, or bytes that don't give
    the medium's digest, end the job with an error. Keys called n_bytes, media_sha256 or media give way to these columns.
    """
    manifests = spark.read.parquet(store.manifests)
    chunks = spark.read.parquet(store.chunks).select("digest", F.col("bytes").alias("stored"))
    incomplete = F.exists("chunks", lambda c: c["bytes"].isNull())
    columns = ["medium", "keys", "n_bytes", "media_sha256", "header"]
    alone = manifests.where(~incomplete).select(*columns, F.transform("chunks", lambda c: c["bytes"]).alias("parts"))
    lists = manifests.where(incomplete).select("medium", F.posexplode("chunks").alias("place", "chunk")).select("medium", "place", "chunk.*")
    found = lists.join(chunks, "digest", "left").select("medium", F.struct("place", F.coalesce("bytes", "stored").alias("bytes")).alias("part"))
    ordered = found.groupBy("medium").agg(F.array_sort(F.collect_list("part")).alias("p")).select("medium", F.transform("p", lambda p: p["bytes"]).alias("parts"))
    joined = manifests.where(incomplete).select(*columns).join(ordered, "medium").select(*columns, "parts")

    @F.arrow_udf("binary")
    def rebuilt(headers: pa.Array, parts: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for header, part, digest in zip(headers, parts, digests):
            media = header.as_py() + b"".join(part.as_py())
            if hashlib.sha256(media).hexdigest() != digest.as_py():
                raise ValueError("a medium's bytes don't give its digest")
            out.append(media)
        return pa.array(out, pa.binary())

    own = [F.col("keys")[k].alias(k) for k in keys if k not in ("n_bytes", "media_sha256", "media")]
    return alone.unionByName(joined).select(*own, "n_bytes", "media_sha256", rebuilt("header", "parts", "media_sha256").alias("media"))


def media_features(media: Column) -> Column:
    """Of a stored medium: struct of payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    feature: mean and deviation of the samples, and how often they pass the middle between 127 and 128 a thousand samples.
    """

    @F.arrow_udf("struct<payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string>")
    def features(stored: pa.Array) -> pa.Array:
        rows = []
        for value in stored:
            whole = value.as_py()
            payload = wav_samples(whole)
            x = np.frombuffer(payload, np.uint8)
            passes = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
            feature = f"{x.mean():.3f}/{x.std():.3f}/{1000 * passes / len(x):.3f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return features(media)


def new_store(spark: SparkSession) -> MediaStore:
    return MediaStore(shared_path(spark, "media-manifests"), shared_path(spark, "media-chunks"))
