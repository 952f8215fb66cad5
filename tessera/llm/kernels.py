"""Vectorised token hashing over Arrow string batches.

Texts are handled as one byte array. A polynomial prefix hash gives every token's hash by one
subtraction, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is taken in windows, each as long as that or one token.
CHUNK_BYTES = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[ord("0") : ord("9") + 1] = DIGIT
    for first, last in ("AZ", "az"):
        table[ord(first) : ord(last) + 1] = LETTER
    table[128:] = LETTER
    return table


#: Class of each byte; bytes of non-ASCII characters count as letters.
CLASSES = _classes()
#: Only white space divides words.
WORDS = np.where(CLASSES == SPACE, SPACE, LETTER).astype(np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS.clear()
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ np.uint64((salt * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, so that byte offsets stay."""
    out = data.copy()
    out[(data >= ord("A")) & (data <= ord("Z"))] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


@dataclass
class Tokens:
    """Tokens of a few consecutive texts."""

    first_doc: int  #: index of the first text in its batch
    hashes: np.ndarray  #: 64-bit hash of each token
    classes: np.ndarray  #: class of each token
    starts: np.ndarray  #: first byte of each token within `data`
    ends: np.ndarray
    doc_starts: np.ndarray  #: index of each text's first token, and the end
    data: np.ndarray  #: the bytes
    offsets: np.ndarray  #: each text's first byte, and the end
    sums: np.ndarray  #: prefix hashes of `data`
    before: int = 0  #: bytes of the (only) text that earlier windows held

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to each end."""
        return mix((self.sums[ends] - self.sums[starts]) * _powers(len(self.sums))[1][starts])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the offset of each text, and the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of whole texts of at most `most` bytes, or one longer text; with the index of each one's first."""
    _, offsets = text_bytes(texts)
    doc = 0
    while doc < len(offsets) - 1:
        last = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + most, "right")) - 1)
        yield doc, texts.slice(doc, last - doc)
        doc = last


def windows(data: np.ndarray, breaks: tuple[np.ndarray, ...], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most `most` bytes, each to the last byte of the first table of `breaks` that has one there; without any, up to the next of the last table."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            for table in breaks:
                found = np.flatnonzero(table[data[at:end]])
                if len(found):
                    end = at + int(found[-1]) + 1
                    break
            else:
                while end < len(data) and not breaks[-1][data[end - 1]]:
                    step = np.flatnonzero(breaks[-1][data[end : end + most]])
                    end = end + int(step[0]) + 1 if len(step) else min(len(data), end + most)
        yield at, end
        at = end


def tokenised(texts: pa.Array, classes: np.ndarray = CLASSES, fold: Callable[[np.ndarray], np.ndarray] | None = None, breaks: tuple[np.ndarray, ...] = ()) -> Iterator[Tokens]:
    """Runs of bytes of one class, without those of class SPACE, in chunks of whole texts, or of windows of a longer text. `fold` maps bytes to bytes, such as to lower case.

    Windows end with a byte of `breaks`, or of class SPACE if there is none. All windows of a text have its number as `first_doc`, the later ones a `before`.
    """
    data, offsets = text_bytes(texts)
    fold = fold or (lambda x: x)
    doc = 0
    while doc < len(offsets) - 1:
        last = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + CHUNK_BYTES, "right")) - 1)
        own = data[offsets[doc] : offsets[last]]
        if len(own) <= CHUNK_BYTES:
            yield _tokens(fold(own), offsets[doc : last + 1] - offsets[doc], doc, classes)
        else:
            for a, b in windows(own, (*breaks, classes == SPACE), CHUNK_BYTES):
                yield _tokens(fold(own[a:b]), np.array([0, b - a]), doc, classes, a)
        doc = last


def _tokens(data: np.ndarray, offsets: np.ndarray, first_doc: int, table: np.ndarray, before: int = 0) -> Tokens:
    n = len(data)
    kinds = table[data]
    cut = np.ones(n + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    kept = kinds[starts] != SPACE
    starts, ends = starts[kept], ends[kept]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(n + 1)[0][:n], out=sums[1:])
    tokens = Tokens(first_doc, sums, kinds[starts], starts, ends, np.searchsorted(starts, offsets), data, offsets, sums, before)
    tokens.hashes = tokens.span_hashes(starts, ends)
    return tokens


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; empty segments give 0."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: starts[-1]], starts[full])
    return out
