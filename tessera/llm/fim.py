"""Fill-in-middle by block rotation in place.

A text's bytes go into a bytearray, its cuts are scanned on the bytes, and a sentinel is inserted before each of prefix,
middle and suffix. Two neighbouring stretches of the buffer then change places by three reversals, which need no second
buffer; the same rotation with the lengths exchanged undoes it, so that the text comes back to the byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import CLASSES, SPACE, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that a reversal copies at a time.
_BLOCK = 1 << 16
_IS_SPACE = CLASSES == SPACE


@dataclass(frozen=True)
class FimParams:
    seed: int = 42
    rate: int = 50  #: of 100 texts, those that are transformed
    spm_rate: int = 80  #: of 100 transformed texts, those whose suffix comes first; the others begin with the prefix


def reverse(buffer: bytearray, first: int, last: int) -> None:
    """Reverses buffer[first:last] in place, from both ends inwards, a block at a time."""
    while last - first > 1:
        step = min(_BLOCK, (last - first) // 2)
        head = buffer[first : first + step]
        buffer[first : first + step] = buffer[last - step : last][::-1]
        buffer[last - step : last] = head[::-1]
        first, last = first + step, last - step


def rotate(buffer: bytearray, first: int, middle: int, last: int) -> int:
    """Exchanges buffer[first:middle] with buffer[middle:last] by three reversals; where the two now meet."""
    reverse(buffer, first, middle)
    reverse(buffer, middle, last)
    reverse(buffer, first, last)
    return first + last - middle


def token_starts(data: np.ndarray) -> np.ndarray:
    """First byte of each token: white space with the word after it, or white space at the end. White space is ASCII only, so bytes tell it."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    return np.append(0, np.flatnonzero(space[1:] & ~space[:-1]) + 1)


def arrange(buffer: bytearray, first: int, second: int, spm: bool) -> None:
    """Text to output: prefix up to `first`, middle up to `second`, suffix; with sentinels, suffix in front (spm) or before the middle (psm)."""
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    first, second = first + 3, second + 6
    rotate(buffer, 0 if spm else first, second, len(buffer))


def restore(buffer: bytearray) -> None:
    """Output to text. The sentinels can't overlap and the text has none, so each is found where it was put."""
    spm, middle = buffer.startswith(SUFFIX), buffer.find(MIDDLE)
    if spm:
        rotate(buffer, 0, buffer.find(PREFIX), len(buffer))
    else:
        rotate(buffer, buffer.find(SUFFIX), middle, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(mark)
        del buffer[at : at + 3]


def _buffers(texts: pa.Array) -> Iterator[tuple[int, bytearray]]:
    """Number and bytes of each text, a slice of the batch at a time."""
    for first, part in slices(texts):
        data, offsets = text_bytes(part)
        for k in range(len(part)):
            yield first + k, bytearray(data[offsets[k] : offsets[k + 1]])


def _strings(texts: list[bytearray]) -> pa.Array:
    """A column of UTF-8 texts from their bytes."""
    ends = np.append(0, np.cumsum([len(x) for x in texts], dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])


def fim_draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers that depend on the seed and the id only: groups of the digest of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fim_transform(documents: DataFrame, params: FimParams = FimParams(), doc_id: str = "doc_id", text: str = "text", result: str = "fim") -> DataFrame:
    """Adds `result`, a struct of n_tokens, form, prefix_chars, middle_chars and output.

    The prefix ends after the lesser of two drawn numbers of tokens, 0 to all, the middle after the greater. The form is `spm`
    (suffix, prefix, middle), `psm` (prefix, suffix, middle) or `plain`: a text that isn't drawn, is empty or null, or has a sentinel
    of its own stays as it is, its character counts are null. Prefix, middle or suffix may be empty. All rows and columns are kept; one
    called as `result` is replaced. Rows with equal id and text are treated alike; a null id counts as an empty one. Counts
    are of code points, whole texts are cut whatever their length.
    """

    @F.arrow_udf("struct<n_tokens: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def transformed(texts: pa.Array, first: pa.Array, second: pa.Array, drawn: pa.Array, order: pa.Array) -> pa.Array:
        first, second, drawn, order = (x.to_numpy(zero_copy_only=False) for x in (first, second, drawn, order))
        sizes, forms, prefixes, middles, outputs = [], [], [], [], []
        for k, buffer in _buffers(texts):
            data = np.frombuffer(bytes(buffer), np.uint8)
            starts = token_starts(data)
            sizes.append(len(starts))
            if not buffer or drawn[k] % 100 >= params.rate or any(m in buffer for m in MARKS):
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
            else:
                cuts = np.append(starts, len(data))
                a, b = sorted((int(first[k]) % len(cuts), int(second[k]) % len(cuts)))
                a, b = int(cuts[a]), int(cuts[b])
                forms.append("spm" if order[k] % 100 < params.spm_rate else "psm")
                # code points are the bytes that don't continue one
                prefixes.append(int(np.count_nonzero(data[:a] & 0xC0 != 0x80)))
                middles.append(int(np.count_nonzero(data[a:b] & 0xC0 != 0x80)))
                arrange(buffer, a, b, forms[-1] == "spm")
            outputs.append(buffer)
        columns = [pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), _strings(outputs).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "form", "prefix_chars", "middle_chars", "output"])

    # so declared, Spark doesn't transform once more for each field that is read
    return documents.withColumn(result, transformed.asNondeterministic()(F.col(text), *fim_draws(F.col(doc_id), params.seed)))


def fim_restore(transformed: DataFrame, output: Column, form: Column, text: str = "text") -> DataFrame:
    """Adds `text`, rebuilt from output and form; exactly the text that was transformed (a null one comes back empty)."""

    @F.arrow_udf("string")
    def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        plain, texts = [f == "plain" for f in forms.to_pylist()], []
        for k, buffer in _buffers(outputs):
            if not plain[k]:
                restore(buffer)
            texts.append(buffer)
        return _strings(texts).cast(pa.string())

    return transformed.withColumn(text, restored(output, form))
