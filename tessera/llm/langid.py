"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases.

Of each language's labelled text a suffix automaton is built. A document is parsed greedily against
every automaton: each phrase is the longest match with some substring of that language's text. The
language that needs the fewest phrases per character wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kernels import segment_sums, slices, text_bytes
from tessera.llm.worker import kept, thrifty

#: Between words: any run of characters that are not letters.
GAP = 0
_LETTERS: list[np.ndarray] = []


@dataclass(frozen=True)
class LangidParams:
    """`sample_chars` bounds the labelled text that is learnt from, over all languages; each gets an equal part of it."""

    sample_chars: int = 120_000
    sample_docs: int = 64  #: of each language, the least by a hash of the id
    segment: int = 512  #: characters that are parsed side by side; phrases go on over their ends
    settled: int = 64  #: characters of a segment after which its parse seldom depends on where it began
    dense: int = 46  #: most frequent letters, which have a column in the table of transitions; the others' are looked up
    chunk: int = 1 << 19  #: bytes of text that are parsed at a time


@dataclass(frozen=True)
class LangidModel:
    languages: list[str]  #: the most common first
    roots: np.ndarray  #: state of each language
    edges: np.ndarray  #: rows of state, character, next state (int32); at most 3 x sample_chars rows
    n_states: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one GAP between words, and where each text begins (and the end)."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    starts = before[offsets]
    letter = _is_letter()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    inner = starts[(starts > 0) & (starts < len(points))]
    kept[inner] = letter[inner]
    places = np.zeros(len(points) + 1, np.int64)
    np.cumsum(kept, out=places[1:])
    return np.where(letter, points, GAP)[kept].astype(np.int32), places[starts]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton that accepts every substring of `text`; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def learn_languages(documents: DataFrame, usable: Column, params: LangidParams = LangidParams(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LangidModel:
    """Automata of labelled text: one task for each language builds one.

    Rows with a null or empty text or a null language teach nothing. With no labelled row at all the model
    knows no language, and every prediction is `und`.
    """
    own = documents.where(usable & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    common = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    room = params.sample_chars // max(1, len(common))
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = own.withColumn("__rank", F.row_number().over(least)).where(F.col("__rank") <= params.sample_docs)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        taught = _taught(*_characters(pa.array(rows.sort_values("__rank")["text"], pa.large_string())), room)
        step = suffix_automaton(taught.tolist())
        edges = np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items()], np.int32)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "states": [len(step)], "edges": [edges.tobytes()]})

    built = {r["lang"]: r for r in sample.groupBy("lang").applyInPandas(build, "lang string, states long, edges binary").collect()}
    languages, roots, edges, n = sorted(built, key=lambda name: (-common[name], name)), [], [np.zeros((0, 3), np.int32)], 0
    for name in languages:
        roots.append(n)
        edges.append(np.frombuffer(built[name]["edges"], np.int32).reshape(-1, 3) + np.array([n, 0, n], np.int32))
        n += built[name]["states"]
    return LangidModel(languages, np.array(roots, np.int64), np.concatenate(edges), n)


def _taught(chars: np.ndarray, starts: np.ndarray, room: int) -> np.ndarray:
    """At most `room` characters of the texts, GAP after each: shorter texts whole, of longer ones an equally long stretch around the middle."""
    lengths = np.diff(starts)
    left, parts = room, {}
    for place, k in enumerate(np.argsort(lengths, kind="stable").tolist()):
        own = min(int(lengths[k]), max(0, left // (len(lengths) - place) - 1))
        first = int(starts[k]) + (int(lengths[k]) - own) // 2
        parts[k] = np.append(chars[first : first + own], GAP)
        left -= own + 1
    return np.concatenate([parts[k] for k in sorted(parts)])[:room] if parts else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Transitions:
    """From state and character to state, with a column for each of the most frequent letters, and sorted keys for the others.

    A missing transition gives ~(state after the character from the language's start): negative, so a phrase
    begins. The states after all others, one for each language, have no transition: they stand before a text and
    after a letter that the language lacks.
    """

    table: np.ndarray  #: states x columns; the last column but one is of all other letters, the last of padding, which changes nothing
    columns: np.ndarray  #: of each character
    codes: np.ndarray  #: of each character in the keys; one code stands for all letters that no language has
    keys: np.ndarray  #: state * number of codes + code, sorted, of the letters without a column
    states: np.ndarray  #: after each key
    roots: np.ndarray  #: state of each language
    n_codes: int
    n_states: int

    def rare(self, state: np.ndarray, code: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """States after letters without a column."""

        def after(state: np.ndarray) -> np.ndarray:
            wanted = state.astype(np.int64) * self.n_codes + code
            at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
            return np.where(self.keys[at] == wanted, self.states[at], -1) if len(self.keys) else np.full(len(wanted), -1, np.int32)

        found, fresh = after(state), after(self.roots[lang])
        return np.where(found >= 0, found, ~np.where(fresh >= 0, fresh, self.n_states + lang)).astype(np.int32)


def transitions(model: LangidModel, params: LangidParams) -> Transitions:
    """Kept by each Python worker for the model it last used."""
    return kept("transitions", model.key, lambda: _transitions(model, params))


def _transitions(model: LangidModel, params: LangidParams) -> Transitions:
    chars, uses = np.unique(np.append(model.edges[:, 1], GAP), return_counts=True)
    dense = np.sort(chars[np.lexsort((chars, -uses))[: params.dense]])
    columns, codes = np.full(0x110000, len(dense), np.int16), np.full(0x110000, len(chars), np.int32)
    columns[dense], codes[chars] = np.arange(len(dense)), np.arange(len(chars))
    table = np.zeros((model.n_states + len(model.languages), len(dense) + 2), np.int32)
    of_edge = columns[model.edges[:, 1]]
    sizes = np.diff(np.append(model.roots, model.n_states))
    for k, (root, size) in enumerate(zip(model.roots, sizes)):
        from_root = np.full(len(dense) + 1, model.n_states + k, np.int32)
        own = (model.edges[:, 0] == root) & (of_edge < len(dense))
        from_root[of_edge[own]] = model.edges[own, 2]
        table[root : root + size, :-1] = ~from_root
        table[model.n_states + k, :-1] = ~from_root
    own = of_edge < len(dense)
    table[model.edges[own, 0], of_edge[own]] = model.edges[own, 2]
    table[:, -1] = np.arange(len(table))
    n_codes = len(chars) + 1
    keys = model.edges[~own, 0].astype(np.int64) * n_codes + codes[model.edges[~own, 1]]
    order = np.argsort(keys)
    return Transitions(table, columns, codes, keys[order], model.edges[~own, 2][order], model.roots, n_codes, model.n_states)


def _parse(step: Transitions, state: np.ndarray, columns: np.ndarray, codes: np.ndarray, stops: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """States (languages x segments) and phrases begun after so many characters as each of `stops` says, from the given states on.

    `columns` and `codes`: segments x characters.
    """
    flat, row, other, out = step.table.ravel(), step.table.shape[1], step.table.shape[1] - 2, []
    begun = np.zeros_like(state)
    langs = np.repeat(np.arange(len(state)), state.shape[1]).reshape(state.shape)
    seldom = (columns == other).any(axis=0)
    turned = np.ascontiguousarray(columns.T).astype(np.int32)
    for k in range(stops[-1]):
        column, before = turned[k], state
        state = flat.take(state * row + column)
        if seldom[k]:
            at = np.flatnonzero(column == other)
            state[:, at] = step.rare(before[:, at].ravel(), np.tile(codes[at, k], len(state)), langs[:, at].ravel()).reshape(len(state), -1)
        sign = state >> 31
        state ^= sign
        begun -= sign
        if k + 1 in stops:
            out.append((state.copy(), begun.copy()))
    return out


def count_phrases(texts: pa.Array, model: LangidModel, step: Transitions, params: LangidParams) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (rows) by each language (columns), and each text's characters.

    Segments of all texts are parsed side by side, as if a phrase began at the start of each. Where the segment before
    ends within a phrase, the beginning is parsed again from that state; as soon as both parses are in the same state they
    are one. This goes on until every segment begins where the one before it ends, so the count is that of one parse of the whole text.
    """
    n_langs, width, pad = len(model.languages), params.segment, step.table.shape[1] - 1
    phrases, lengths = np.zeros((len(texts), n_langs), np.int64), np.zeros(len(texts), np.int64)
    stops = (min(params.settled, width), width) if params.settled < width else (width,)
    for doc, part in slices(texts, params.chunk):
        chars, starts = _characters(part)
        rows = slice(doc, doc + len(part))
        own = lengths[rows] = np.diff(starts)
        segments = -(-own // width)
        first = np.append(0, np.cumsum(segments))
        if not first[-1]:
            continue
        columns, codes = np.full((first[-1], width), pad, np.int16), np.zeros((first[-1], width), np.int32)
        owner = np.repeat(np.arange(len(part)), own)
        place = np.arange(len(chars)) - np.repeat(starts[:-1], own)
        columns[first[owner] + place // width, place % width] = step.columns[chars]
        codes[first[owner] + place // width, place % width] = step.codes[chars]
        begin = np.repeat(np.arange(model.n_states, model.n_states + n_langs, dtype=np.int32), first[-1]).reshape(n_langs, -1)
        entered, parsed = begin.copy(), _parse(step, begin, columns, codes, stops)
        inner = np.ones(first[-1], bool)
        inner[first[:-1][segments > 0]] = False
        while True:
            due = begin.copy()
            due[:, 1:] = np.where(inner[1:], parsed[-1][0][:, :-1], due[:, 1:])
            open_ = np.flatnonzero((due != entered).any(axis=0))
            if not len(open_):
                break
            entered[:, open_] = due[:, open_]
            again = _parse(step, due[:, open_], columns[open_], codes[open_], stops[:1])
            joined = (again[0][0] == parsed[0][0][:, open_]).all(axis=0)
            if len(stops) > 1:
                same = open_[joined]
                parsed[1][1][:, same] += again[0][1][:, joined] - parsed[0][1][:, same]
                parsed[0][1][:, same] = again[0][1][:, joined]
                open_ = open_[~joined]
                again = _parse(step, due[:, open_], columns[open_], codes[open_], stops) if len(open_) else []
            for old, new in zip(parsed, again):
                old[0][:, open_], old[1][:, open_] = new
        for k in range(n_langs):
            phrases[rows, k] = segment_sums(parsed[-1][1][k], first)
    return phrases, lengths


def predict_language(documents: DataFrame, model: LangidModel, params: LangidParams = LangidParams(), text: str = "text", result: str = "language") -> DataFrame:
    """Adds a struct `language`: lang_pred, score and rate.

    rate: phrases per character of the best language; a text like none of the languages has a high one.
    score: 1 - phrases of the best language / phrases of the next best (one language only: 1 - rate).
    Of equal counts the language with more labelled documents wins. A text that is null or has no letter is `und`, with
    score 0 and rate 1. The whole text counts, whatever its length. All columns are kept; one called
    `language` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rate: double>")
    @thrifty
    def predicted(texts: pa.Array) -> pa.Array:
        own = shared.value
        n = len(texts)
        if not own.languages:
            return pa.StructArray.from_arrays([pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.ones(n))], ["lang_pred", "score", "rate"])
        phrases, lengths = count_phrases(texts, own, transitions(own, params), params)
        none = lengths == 0
        best = phrases.argmin(1)
        least = phrases.min(1)
        rate = np.where(none, 1.0, np.minimum(1.0, least / np.maximum(1, lengths)))
        if len(own.languages) > 1:
            second = np.sort(phrases, 1)[:, 1]
            score = 1 - least / np.maximum(1, second)
        else:
            score = 1 - rate
        names = np.where(none, len(own.languages), best)
        found = pa.array([*own.languages, "und"]).take(pa.array(names))
        return pa.StructArray.from_arrays([found, pa.array(np.where(none, 0.0, score)), pa.array(rate)], ["lang_pred", "score", "rate"])

    # so declared, Spark doesn't parse once more for a filter on the result
    return documents.withColumn(result, predicted.asNondeterministic()(F.col(text)))
