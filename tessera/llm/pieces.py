"""SentencePiece encoding and decoding with a given vocabulary: no maximum of summed scores, but the one path that merging by rank leaves,
found by a forward pass over a shared-prefix trie of words.

The text is cut into marked words (a run of the space mark, then other characters); no piece of the
vocabulary reaches over a word's end. The distinct words of a slice of texts are sorted, which is a depth-first
traversal of their trie: a word keeps the forward states of the prefix it shares with the word before.
The forward state of a prefix is its last piece. A piece may follow another only if merging would leave
the two apart; under this transition rule exactly one path through a word lives, and it is the one that
pair merging by rank gives. (Adding the pieces' scores, as for a unigram vocabulary, would not give it.)

A worker's memory is bounded: its caches by bytes and entries, a slice of texts by bytes, and a longer text is taken in windows.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import slices
from tessera.llm.worker import kept, thrifty

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A place where one word ends and another begins.
_BREAK = re.compile(f"[^ {MARK}][ {MARK}]")


def default_vocabulary() -> str:
    """Path of the installed public 32k piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(slots=True)
class _Node:
    """Of a trie of pieces read backwards."""

    below: dict[str, _Node] = field(default_factory=dict)
    piece: str | None = None  #: the piece that ends here
    after: dict[str, bool] | None = None  #: of pieces met of late, whether `piece` may come after them


@dataclass
class Encoder:
    """Pieces, their ranks, and caches of what has been found about them; one lives in each Python worker."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    tails: _Node = field(default_factory=_Node)
    #: Ids of words met of late, as bytes of int32. When `words` is full it becomes `older`, and what was there goes.
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    held: int = 0  #: bytes of `words`, about
    most_held: int = 24 << 20
    longest: int = 256  #: characters of a word that is kept
    judged: list[_Node] = field(default_factory=list)  #: a node for each verdict in any `after`
    most_judged: int = 250_000
    window: int = 1 << 18  #: characters of a text that are taken at a time

    @classmethod
    def load(cls, path: str) -> Encoder:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("a piece reaches over the end of a word")
        out = cls(ids, {p: model.get_score(i) for p, i in ids.items()}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        for piece in ids:
            if len(piece) == 1 or out.merged(piece) == [piece]:  # the others never come out of merging
                node = out.tails
                for c in reversed(piece):
                    node = node.below.setdefault(c, _Node())
                node.piece = piece
        return out

    def merged(self, text: str) -> list[str]:
        """Pair merging by rank, the definition that the transition rule rests on: best score first, leftmost of equals."""
        parts, scores = list(text), self.scores
        joint = [scores.get(a + b) for a, b in itertools.pairwise(parts)]
        while True:
            best, k = None, -1
            for i, x in enumerate(joint):
                if x is not None and (best is None or x > best):
                    best, k = x, i
            if best is None:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k < len(joint):
                joint[k] = scores.get(parts[k] + parts[k + 1])
            if k:
                joint[k - 1] = scores.get(parts[k - 1] + parts[k])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, sorted: depth-first through their trie."""
        out: dict[str, bytes] = {}
        before, last = "", [""]  # last[i]: last piece of the prefix of i characters
        root, merged, judged = self.tails, self.merged, self.judged
        for word in words:
            if len(judged) > self.most_judged:
                for node in judged:
                    node.after = None
                judged.clear()
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, found = root, None
                for start in range(end - 1, -1, -1):  # backwards through the pieces that end here
                    node = node.below.get(word[start])
                    if node is None:
                        break
                    piece = node.piece
                    if piece is not None:
                        if not start:
                            found = piece
                            break
                        left = last[start]
                        if node.after is None:
                            node.after = {}
                        may = node.after.get(left)
                        if may is None:
                            may = node.after[left] = merged(left + piece) == [left, piece]
                            judged.append(node)
                        if may:
                            found = piece
                            break
                if found is None:
                    if word[end - 1] in self.ids:
                        raise AssertionError(f"no path to {word[:end]!r}")
                    found = word[end - 1]  # a character without a piece never merges
                last.append(found)
            before = word
            out[word] = self._path(word, last)
        return out

    def _path(self, word: str, last: list[str]) -> bytes:
        ids, known, end = [], self.ids, len(word)
        while end:
            piece = last[end]
            if piece in known:
                ids.append(known[piece])
            else:  # one character without a piece: its bytes
                ids.extend(self.byte_ids[b] for b in reversed(piece.encode()))
            end -= len(piece)
        ids.reverse()
        return array("i", ids).tobytes()

    def _windows(self, text: str) -> Iterator[str]:
        """The text from one word's beginning to another's, at least `window` characters at a time, spaces as marks and one mark before it."""
        at = 0
        while at < len(text):
            found = _BREAK.search(text, at + self.window)
            end = found.end() - 1 if found else len(text)
            yield (MARK if not at else "") + text[at:end].replace(" ", MARK)
            at = end

    def _joined(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        if self.held > self.most_held:
            self.older, self.words, self.held = self.words, {}, 0
        words, older = self.words, self.older
        new = set(itertools.chain.from_iterable(cut))
        new.difference_update(words)
        met = new.intersection(older)
        found = self.encode_words(sorted(new - met))
        found.update({w: older[w] for w in met})
        short = {w: ids for w, ids in found.items() if len(w) <= self.longest}
        words.update(short)
        self.held += sum(200 + 2 * len(w) + len(ids) for w, ids in short.items())
        known = words if len(short) == len(found) else ChainMap(found, words)
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text: a space mark is put before it, spaces become marks; null and empty texts give none."""
        out: list[bytes] = []
        for longer, own in itertools.groupby(texts, lambda t: len(t or "") > self.window):
            if longer:
                out += [b"".join(self._joined([_WORD.findall(part)])[0] for part in self._windows(text)) for text in own]
            else:
                out += self._joined([_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in own])
        return [np.frombuffer(x, np.int32) for x in out]


@dataclass
class Decoder:
    """UTF-8 of each id, with spaces for marks; then the same without a leading space, for a text's first id."""

    pieces: pa.Array

    @classmethod
    def load(cls, path: str) -> Decoder:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        as_bytes = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode()
        pieces = [as_bytes(i) for i in range(model.get_piece_size())]
        return cls(pa.array(pieces + [p.removeprefix(b" ") for p in pieces], pa.large_binary()))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts, as UTF-8, of the ids from each start to the next; bytes are joined before they are read as UTF-8."""
        if not len(ids):
            return [b""] * (len(starts) - 1)
        ids = ids.astype(np.int64)
        first = starts[:-1][starts[:-1] < starts[1:]]
        ids[first] += len(self.pieces) // 2
        _, offsets, data = self.pieces.take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1][starts].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [str(view[a:b], "utf-8", "replace").encode() for a, b in itertools.pairwise(ends)]


def _ready(path: str, kind: type):
    return kept(f"{kind.__name__}:{path}", path, lambda: kind.load(path))


@dataclass(frozen=True)
class PieceParams:
    vocabulary: str = field(default_factory=default_vocabulary)  #: path of the vocabulary, on every machine
    batch_bytes: int = 1 << 20  #: of text whose words make one trie
    batch_ids: int = 1 << 18  #: that are decoded at a time, or those of one text


def encode_pieces(documents: DataFrame, params: PieceParams | None = None, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """Adds `piece_ids`, an array of int: the pieces of the whole text.

    Null texts give null, empty texts an empty array. All columns are kept; one called `piece_ids` is
    replaced. The ids are those of the vocabulary's own library, special strings being ordinary text.
    """
    path, most = (params or PieceParams()).vocabulary, (params or PieceParams()).batch_bytes

    @F.arrow_udf("array<int>")
    @thrifty
    def encoded(texts: pa.Array) -> pa.Array:
        encoder, ends, out = _ready(path, Encoder), np.zeros(len(texts) + 1, np.int32), bytearray()
        for first, part in slices(texts, most):
            for k, found in enumerate(encoder.encode(part.to_pylist()), first + 1):
                out += found.tobytes()
                ends[k] = len(out) // 4
        return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), len(out) // 4, [None, pa.py_buffer(out)]), mask=texts.is_null())

    # so declared, Spark doesn't encode once more for each later use of the ids
    return documents.withColumn(ids, encoded.asNondeterministic()(F.col(text)))


def decode_pieces(encoded: DataFrame, params: PieceParams | None = None, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """Adds `text`, what the ids stand for: bytes are joined before they are read as UTF-8. Null ids give null."""
    path, most = (params or PieceParams()).vocabulary, (params or PieceParams()).batch_ids

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        decoder, out = _ready(path, Decoder), bytearray()
        ends, at = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), 0
        offsets = np.zeros(len(lists) + 1, np.int32)
        while at < len(lists):
            last = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            part = lists.slice(at, last - at).flatten().to_numpy(zero_copy_only=False)
            for k, text in enumerate(decoder.decode(part, ends[at : last + 1] - ends[at]), at + 1):
                out += text
                offsets[k] = len(out)
            at = last
        valid = None
        if lists.null_count:
            valid = pa.array(lists.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
        return pa.Array.from_buffers(pa.string(), len(lists), [valid, pa.py_buffer(offsets), pa.py_buffer(out)])

    return encoded.withColumn(text, decoded(F.col(ids)))
