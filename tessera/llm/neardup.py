"""Near-duplicates by order MinHash, verified by banded alignment.

Each of a text's sketches takes the several least of its occurrence-labelled shingles and keeps them in text
order, so that texts meet when the same shingles stand in the same order: a sign of a small edit distance.
Texts that meet in a bucket are compared with the bucket's leaders by alignment of their words, then all with all that links
don't join yet, if bits of their words allow a link. Connected components of what is verified are the classes.

Shingles are of two words, not five: of a text with each fifth word changed no five-word shingle is left, though
its similarity is 0.8, and of one with 19 % of its words changed at random a third. Four of them make a sketch, three
in short texts, of which few shingles are left; texts of 31 to 40 words have sketches of both kinds, so that any two near texts have one kind in common.

Words are runs of letters, marks and digits of any script in lower case; of scripts that don't divide words each character is one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kernels import DIGIT, LETTER, Tokens, mix, slices, tokenised
from tessera.llm.shared import Scratch, may_be_among, materialize, without
from tessera.llm.worker import thrifty


#: Words of the longer text up to which pairs are aligned many at once, and cells of a table of two texts' words up to which one pair is by bit vectors.
SHORT_WORDS, BIT_CELLS = 256, 1 << 28


@dataclass(frozen=True)
class NeardupParams:
    words: int = 2  #: of a shingle
    sketches: int = 120
    picks: int = 4  #: least shingles of a sketch
    short_sketches: int = 64
    short_picks: int = 3
    short_words: tuple[int, int] = (30, 40)  #: up to the first a text has short sketches only, beyond the second none; texts in between are up to 0.8 as long
    short: int = 9  #: words up to which texts also meet if they differ by one word, which is all that the similarity allows
    bits: int = 2048  #: of the words that a text has an odd number of times
    rounds: int = 1  #: of comparing with leaders, before all members of a bucket that are not joined yet
    block: int = 1000  #: members of a bucket that are compared with as many others at a time
    block_words: int = 1 << 21  #: words of these members; where they have more, there are more blocks
    pairs_per_part: int = 4000  #: pairs of texts that a task aligns
    similarity: float = 0.8  #: 1 - edit distance in words / words of the longer text
    slice_bytes: int = 1 << 19


def _words(tok: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (letters or digits, lower case) and where each text's begin, and the end."""
    kept = (tok.classes == LETTER) | (tok.classes == DIGIT)
    before = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return tok.hashes[kept], before[tok.doc_starts]


#: Scripts without spaces between words.
_UNDIVIDED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def plain_words(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with a space for each mark or sign beyond ASCII and around each character of scripts that don't divide words."""
    texts = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(texts, _UNDIVIDED)).as_py():
        texts = pc.replace_substring_regex(texts, _UNDIVIDED, r" \1 ")
    return pc.replace_substring_regex(texts, r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " ")


def _all_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of all texts of a slice, long ones joined from their windows."""
    texts = plain_words(texts)
    parts, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for tok in tokenised(texts):
        words, starts = _words(tok)
        parts.append(words)
        counts[tok.first_doc : tok.first_doc + len(starts) - 1] += np.diff(starts)
    return np.concatenate(parts), np.append(0, np.cumsum(counts))


def _shingles(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words, and where each text's begin; a shorter text has one run of all its words."""
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - np.repeat(starts[:-1], n)
    h = np.zeros(len(words), np.uint64)
    padded = np.append(words, np.zeros(width, np.uint64))
    for k in range(width):
        inside = at + k < n[doc]
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[k : k + len(words)], np.uint64(0)) + np.uint64(k)
    kept = (at + width <= n[doc]) | (at == 0)
    return mix(h[kept]), np.searchsorted(doc[kept], np.arange(len(n) + 1))


def order_sketches(shingles: np.ndarray, starts: np.ndarray, params: NeardupParams) -> np.ndarray:
    """For each text (rows): the hash of each sketch, the least labelled shingles in text order. Texts must not be empty."""
    counts = np.diff(starts)
    doc = np.repeat(np.arange(len(counts)), counts)
    keyed = shingles + mix(doc.astype(np.uint64), 3)
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = np.arange(len(order)) - run
    labelled = (mix(shingles + occurrence * np.uint64(0xD1342543DE82EF95), 5) >> np.uint64(32)).astype(np.uint32)
    factors = (mix(np.arange(params.sketches, dtype=np.uint64), 17) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    places = np.empty((len(counts), params.sketches, params.picks), np.int64)
    for i, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        own, most = labelled[x:y], max(1, (1 << 17) // (y - x))
        for first in range(0, params.sketches, most):
            value = factors[first : first + most, None] * own
            rows = np.arange(len(value))
            for k in range(params.picks):
                # a text of fewer shingles than picks repeats its first
                at = value.argmin(axis=1)
                places[i, first : first + most, k] = at + x
                value[rows, at] = np.uint32(2**32 - 1)
    places.sort(axis=2)
    out = np.arange(params.sketches, dtype=np.uint64)[None, :].repeat(len(counts), 0)
    for k in range(params.picks):
        out = mix(out * np.uint64(3) + shingles[places[:, :, k]], 11)
    return out


def text_bands(words: np.ndarray, starts: np.ndarray, params: NeardupParams) -> list[np.ndarray]:
    """The bands of each text: hashes of its sketches, and of what `short_bands` gives; none without a word."""
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    parts: list[list[np.ndarray]] = [[] for _ in n]
    few, many = params.short_words
    for chosen, kind in (((n > few), params), ((n > 0) & (n <= many), replace(params, sketches=params.short_sketches, picks=params.short_picks))):
        texts = np.flatnonzero(chosen)
        if len(texts):
            shingles, begins = _shingles(words[chosen[doc]], np.append(0, np.cumsum(n[texts])), params.words)
            for k, bands in zip(texts.tolist(), order_sketches(shingles, begins, kind)):
                parts[k].append(bands)
    for k in np.flatnonzero((n > 0) & (n <= params.short)).tolist():
        parts[k].append(short_bands(words[starts[k] : starts[k + 1]], params))
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def short_bands(words: np.ndarray, params: NeardupParams) -> np.ndarray:
    """Hashes of all words, and of all but each one: texts that differ by one word have one in common."""
    n = len(words)
    left = np.array([[j for j in range(n) if j != k] for k in range(n)], np.int64).reshape(n, max(n - 1, 0))
    out = [np.full(1, n, np.uint64), np.full(n, n - 1, np.uint64)]
    for h, chosen in zip(out, (np.arange(n)[None, :], left)):
        for column in chosen.T:
            h[:] = mix(h * np.uint64(3) + words[column], 41)
    return np.unique(np.concatenate(out))


def word_bits(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each text (rows) `size` bits, as 64-bit values: whether it has an odd number of words of that hash modulo `size`."""
    out = np.zeros((len(starts) - 1, size // 64), np.uint64)
    cells = mix(words, 29) % np.uint64(size)
    at = np.repeat(np.arange(len(out)) * out.shape[1], np.diff(starts)) + (cells >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out.ravel(), at, np.uint64(1) << (cells & np.uint64(63)))
    return out.view(np.int64)


def banded_distances(left: list[np.ndarray], right: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Edit distance in words of each pair, or -1 where it is over the pair's limit.

    Short pairs are aligned many at once, within a band around the diagonal as wide as their limits. Longer ones of up to BIT_CELLS cells
    are aligned by bit vectors; of those beyond that the band is narrow at first and is widened for the pairs whose distance is not within it, until it is as wide as their limit.
    """
    out = np.full(len(left), -1, np.int64)
    trimmed = [_trim(a, b) for a, b in zip(left, right)]
    longest = np.array([max(len(a), len(b)) for a, b in trimmed], np.int64)
    reach = np.minimum(limits, longest)
    open_ = [p for p, (a, b) in enumerate(trimmed) if abs(len(a) - len(b)) <= limits[p]]
    short = [p for p in open_ if longest[p] <= SHORT_WORDS]
    for most in (8, SHORT_WORDS):  # most near pairs differ by a few words
        wait, group, top = [], [], 0
        short.sort(key=lambda p: (longest[p], reach[p]))
        for k, p in enumerate(short):
            group.append(p)
            top = max(top, min(most, int(reach[p])), 1)
            if len(group) * (2 * top + 1) >= 60_000 or k == len(short) - 1 or longest[short[k + 1]] > 1.25 * longest[group[0]] + 8:
                at = [q for q in group if abs(len(trimmed[q][0]) - len(trimmed[q][1])) <= top]
                settled = dict(zip(at, _band(trimmed, at, top).tolist())) if at else {}
                for q in group:
                    d = settled.get(q, top + 1)
                    if d <= min(top, limits[q]):
                        out[q] = d
                    elif top < reach[q]:
                        wait.append(q)
                group, top = [], 0
        short = wait
    open_ = [p for p in open_ if longest[p] > SHORT_WORDS]
    for p in open_:
        if len(trimmed[p][0]) * len(trimmed[p][1]) <= BIT_CELLS:
            out[p] = _bit_distance(*trimmed[p], int(limits[p]))
    open_ = [p for p in open_ if len(trimmed[p][0]) * len(trimmed[p][1]) > BIT_CELLS]
    band = 12
    while open_:
        open_.sort(key=lambda p: len(trimmed[p][0]))
        wait, group, cells = [], [], 0
        for k, p in enumerate(open_):
            width = int(min(band, limits[p]))
            if abs(len(trimmed[p][0]) - len(trimmed[p][1])) > width:
                wait.append(p)
            else:
                group.append(p)
                cells += 2 * band + 1
            longest = len(trimmed[p][0])
            if group and (cells >= 100_000 or len(group) * longest >= 1_000_000 or k == len(open_) - 1):
                found = _band(trimmed, group, band)
                for q, d in zip(group, found):
                    if d <= min(band, limits[q]):
                        out[q] = d
                    elif band < limits[q]:
                        wait.append(q)
                group, cells = [], 0
        # what the narrowest band didn't settle is mostly unlike: the words alone show that sooner than a wide band
        open_ = [p for p in wait if band > 12 or _may_match(*trimmed[p], limits[p])]
        band *= 4
    return out


def _bit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance, or -1 over the limit: a column of the table at a time, its steps up and down as bits of two integers."""
    n, rest, a, b = len(a), len(b), a.tolist(), b.tolist()
    if not n:
        return rest if rest <= limit else -1
    places: dict[int, int] = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for word in b:
        same = places.get(word, 0)
        down_or_same = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        rest -= 1
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        if score - rest > limit:
            return -1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(down_or_same | rise)), rise & down_or_same
    return score if score <= limit else -1


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    first = int(differ[0]) if len(differ) else n
    a, b, n = a[first:], b[first:], n - first
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    last = int(differ[0]) if len(differ) else n
    return a[: len(a) - last], b[: len(b) - last]


def _may_match(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the words, in any order, leave the distance within the limit."""
    both, ca, cb = np.concatenate([a, b]), np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    _, place = np.unique(both, return_inverse=True)
    x, y = np.bincount(place[: len(a)], ca, place.max() + 1), np.bincount(place[len(a) :], cb, place.max() + 1)
    return max(len(a), len(b)) - np.minimum(x, y).sum() <= limit


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], group: list[int], band: int) -> np.ndarray:
    width, far = 2 * band + 1, np.int32(1 << 29)
    n = np.array([len(pairs[p][0]) for p in group])
    m = np.array([len(pairs[p][1]) for p in group])
    top = int(n.max())
    a = np.zeros((len(group), top), np.uint64)
    b = np.zeros((len(group), max(top, int(m.max())) + width + 1), np.uint64)  # column j + band holds word j
    for k, p in enumerate(group):
        a[k, : n[k]] = pairs[p][0]
        b[k, band + 1 : band + 1 + m[k]] = pairs[p][1]
    steps = np.arange(width, dtype=np.int32)
    row = np.where(steps >= band, steps - band, far)[None, :].repeat(len(group), 0)
    out = np.full(len(group), far, np.int64)
    place = np.clip(m - n + band, 0, width - 1)
    out[n == 0] = row[np.flatnonzero(n == 0), place[n == 0]]
    for i in range(1, top + 1):
        differ = a[:, i - 1, None] != b[:, i : i + width]
        cell = row + differ
        cell[:, :-1] = np.minimum(cell[:, :-1], row[:, 1:] + 1)
        cell -= steps
        np.minimum.accumulate(cell, axis=1, out=cell)
        cell += steps
        row = np.minimum(cell, far)
        ended = np.flatnonzero(n == i)
        out[ended] = row[ended, place[ended]]
    return out


def _sketched(documents: DataFrame, text: str, params: NeardupParams) -> DataFrame:
    """Adds struct `__sketch`: n, the text's words, bands, the hashes of the sketches, of a text without a word none, and bits."""

    @F.arrow_udf("struct<n: bigint, bands: array<bigint>, bits: array<bigint>>")
    @thrifty
    def sketch(texts: pa.Array) -> pa.Array:
        counts, parts, n = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
        bits = np.zeros((len(texts), params.bits // 64), np.int64)
        for first, part in slices(texts, params.slice_bytes):
            words, starts = _all_words(part)
            bits[first : first + len(part)] = word_bits(words, starts, params.bits)
            n[first : first + len(part)] = np.diff(starts)
            own = text_bands(words, starts, params)
            counts[first : first + len(part)] = [len(x) for x in own]
            parts += own
        bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
        ends = pa.array(np.arange(len(texts) + 1) * bits.shape[1], pa.int32())
        return pa.StructArray.from_arrays([pa.array(n), bands, pa.ListArray.from_arrays(ends, pa.array(bits.ravel()))], ["n", "bands", "bits"])

    return documents.withColumn("__sketch", sketch(F.coalesce(F.col(text), F.lit(""))))


def word_lists(texts: DataFrame, params: NeardupParams) -> DataFrame:
    """(node, words) of texts (uid, __text): the words' hashes as bytes of 32-bit values."""

    @F.arrow_udf("binary")
    @thrifty
    def listed(values: pa.Array) -> pa.Array:
        out = []
        for _, part in slices(values, params.slice_bytes):
            words, starts = _all_words(part)
            words = (words >> np.uint64(32)).astype(np.uint32)
            out += [words[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])]
        return pa.array(out, pa.binary())

    return texts.select(F.col("uid").alias("node"), listed("__text").alias("words"))


def _verified(pairs: DataFrame, words: DataFrame, params: NeardupParams) -> DataFrame:
    """(a, b, similarity): of each pair of nodes, null where it is below the threshold. `words`: (node, words)."""

    @F.arrow_udf("double")
    @thrifty
    def aligned(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.full(len(left), np.nan)
        for first in range(0, len(left), 2048):
            sides = [[np.frombuffer(x.as_buffer(), np.uint32) for x in side.slice(first, 2048)] for side in (left, right)]
            longest = np.array([max(len(x), len(y), 1) for x, y in zip(*sides)])
            found = banded_distances(*sides, np.floor((1 - params.similarity) * longest + 1e-9).astype(np.int64))
            out[first : first + 2048] = np.where(found >= 0, 1 - found / longest, np.nan)
        return pa.array(out, mask=np.isnan(out))

    left = words.select(F.col("node").alias("a"), F.col("words").alias("left"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", aligned("left", "right").alias("similarity"))


def _length_class(n: Column, params: NeardupParams) -> Column:
    """Texts of a similarity within the threshold are in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1 / params.similarity))).cast("int")


def _in_buckets(sketched: DataFrame) -> DataFrame:
    """(band, node, n) of the buckets with several nodes; `sketched`: (node, n, bands).

    Bands are shuffled once: a node that has another before or after it in its bucket isn't alone there, which a task sees as rows pass by.
    """
    by = Window.partitionBy("band").orderBy("node")
    single = sketched.select("node", "n", F.explode("bands").alias("band"))
    beside = F.lag("node").over(by).isNotNull() | F.lead("node").over(by).isNotNull()
    return single.withColumn("__several", beside).where("__several").select("band", "node", "n")


def _may_link(n: tuple[str, str], bits: tuple[str, str], params: NeardupParams) -> Column:
    """Whether lengths and word bits allow the similarity: an edit of one word changes at most two bits."""
    longest = F.greatest(*n) * (1 - params.similarity)
    changed = sum((F.bit_count(F.get(bits[0], F.lit(k)).bitwiseXOR(F.get(bits[1], F.lit(k)))) for k in range(params.bits // 64)), F.lit(0))
    return _lengths_allow(F.col(n[0]), F.col(n[1]), params) & (changed <= 2 * longest + 1e-6)


def _lengths_allow(n: Column, other: Column, params: NeardupParams) -> Column:
    return F.abs(n - other) <= F.greatest(n, other) * (1 - params.similarity) + 1e-6


def _may_follow(leader: Column, led: Column, ln: Column, params: NeardupParams) -> Column:
    """Whether a member (node, n, root) is to be compared with this leader: of another root, of a length that allows a link."""
    return (F.col("node") != leader) & (F.col("root") != led) & _lengths_allow(F.col("n"), ln, params)


def _met_leaders(members: DataFrame, lead: DataFrame, params: NeardupParams) -> DataFrame:
    """(node, leader): members and the leaders of their bucket, of different roots and of lengths that allow a link, which are in this or the neighbouring length classes."""
    near = lead.withColumn("class", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)))
    others = _may_follow(F.col("leader"), F.col("led"), F.col("ln"), params)
    return members.join(near, ["band", "class"]).where(others).select("node", "leader")


def _met_in_lists(members: DataFrame, buckets: DataFrame, params: NeardupParams) -> DataFrame:
    """The distinct rows of `_met_leaders`; `buckets`: (band, leads), as `_led_buckets` gives them.

    A member has one row in a bucket, with a list of the at most three leaders, and a node's lists lose the leaders that it meets in several buckets before they become rows.
    """
    near = buckets.select("band", "leads", F.explode("leads.of").alias("class"))
    near = near.select("band", "class", F.filter("leads", lambda x: F.abs(x["of"] - F.col("class")) <= 1).alias("leads"))
    others = lambda x: _may_follow(x["leader"], x["led"], x["ln"], params)
    met = members.join(near, ["band", "class"]).where(F.exists("leads", others)).select("node", F.filter("leads", others)["leader"].alias("leaders"))
    return met.groupBy("node").agg(F.flatten(F.collect_list("leaders")).alias("leaders")).select("node", F.explode(F.array_distinct("leaders")).alias("leader"))


def _one_of_each_root(placed: DataFrame) -> DataFrame:
    """Of each root in a bucket and length class the member with the most links."""
    first = F.min_by(F.struct("node", "n"), F.struct(-F.col("degree"), F.col("node"))).alias("first")
    return placed.groupBy("band", "class", "root").agg(first).select("band", "class", "root", "first.*")


def _possible(met: DataFrame, facts: DataFrame, params: NeardupParams) -> DataFrame:
    """(a, b): the pairs (node, leader) whose lengths and bits of words allow a link."""
    pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    left = facts.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits"))
    right = facts.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
    return pairs.join(left, "a").join(right, "b").where(_may_link(("an", "bn"), ("abits", "bbits"), params)).select("a", "b")


def unlinked_pairs(n: np.ndarray, root: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, params: NeardupParams) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a left and a right member whose roots differ and whose lengths and word bits allow the similarity."""
    found = []
    for i in left.tolist():
        open_ = right[(root[right] != root[i]) & (np.abs(n[right] - n[i]) <= (1 - params.similarity) * np.maximum(n[right], n[i]) + 1e-6)]
        if len(open_):
            changed = np.bitwise_count(bits[open_] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = open_[changed <= 2 * (1 - params.similarity) * np.maximum(n[open_], n[i]) + 1e-6]
            found.append(np.stack([np.full(len(near), i), near]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


#: Each pair of members is compared in one of the buckets that it shares, the least after a change of bits; there are eight changes, so that pairs of a group spread over buckets.
_SPREAD = mix(np.arange(8, dtype=np.uint64), 53)


@dataclass(frozen=True)
class Lists:
    """Lists of numbers, one for each member of a group: row i is values[starts[i] : starts[i + 1]], none empty; counts beside them."""

    starts: np.ndarray
    values: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Lists:
        """The distinct values of each row, as numbers from 0 in their order, and how often each comes."""
        known, number = np.unique(np.concatenate(rows), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        both, counts = np.unique(row * len(known) + number, return_counts=True)
        return Lists(np.searchsorted(both, np.arange(len(rows) + 1) * len(known)), both % len(known), counts)

    def marked(self, i: int) -> np.ndarray:
        """How often each value comes in row i."""
        own = slice(self.starts[i], self.starts[i + 1])
        out = np.zeros(int(self.values.max()) + 1, np.int64)
        out[self.values[own]] = self.counts[own]
        return out

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the values of these rows, where each row's begin among them, and the rows' lengths."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.starts[rows] - begins, sizes), begins, sizes


def words_allow(n: np.ndarray, bags: Lists, i: int, others: np.ndarray, params: NeardupParams) -> np.ndarray:
    """Of the members `others` those whose words, in any order, leave the distance to member i within the limit."""
    at, begins, _ = bags.at(others)
    common = np.add.reduceat(np.minimum(bags.marked(i)[bags.values[at]], bags.counts[at]), begins)
    longest = np.maximum(n[others], n[i])
    return others[longest - common <= (1 - params.similarity) * longest + 1e-6]


def met_here(band: int, bands: np.ndarray, node: np.ndarray, held: Lists, i: int, others: np.ndarray) -> np.ndarray:
    """Of the members `others` those that member i is compared with in this bucket.

    `held`: all buckets of each member, as places in `bands`, which are sorted.
    """
    at, begins, sizes = held.at(others)
    change = _SPREAD[(node[others] ^ node[i]) & 7]
    order = bands[held.values[at]] ^ np.repeat(change, sizes)
    before = (held.marked(i)[held.values[at]] > 0) & (order < np.repeat(np.uint64(band) ^ change, sizes))
    return others[~np.logical_or.reduceat(before, begins)]


def possible_here(band: int, bands: np.ndarray, node: np.ndarray, held: Lists, n: np.ndarray, bags: Lists, i: int, others: np.ndarray, params: NeardupParams) -> np.ndarray:
    """Of the members `others` those to align with member i in this bucket. Words, which are many, are counted in one of the buckets that a pair shares only."""
    if len(others):
        others = met_here(band, bands, node, held, i, others)
    return words_allow(n, bags, i, others, params) if len(others) else others


def _aligned_links(i: int, others: np.ndarray, root: np.ndarray, words: list[np.ndarray], parent: dict[int, int], params: NeardupParams) -> list[tuple[int, float]]:
    """(j, similarity) of links from member i. Members that links have joined to it by then are left out, so each other root is tried by one, then by more."""

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    found, wait, most = [], others.tolist(), 1
    while wait:
        own, tried, later, seen = find(int(root[i])), [], [], {}
        for j in wait:
            if (r := find(int(root[j]))) != own:
                seen[r] = seen.get(r, 0) + 1
                (tried if seen[r] <= most else later).append(j)
        longest = np.array([max(len(words[i]), len(words[j]), 1) for j in tried], np.int64)
        distances = banded_distances([words[i]] * len(tried), [words[j] for j in tried], np.floor((1 - params.similarity) * longest + 1e-9).astype(np.int64))
        for j, d, n in zip(tried, distances.tolist(), longest.tolist()):
            if d >= 0:
                found.append((j, 1 - d / n))
                parent[find(int(root[j]))] = find(int(root[i]))
        wait, most = later, most * 4
    return found


def _met_all(members: DataFrame, facts: DataFrame, words: DataFrame, params: NeardupParams) -> DataFrame:
    """(a, b, similarity): links between members of a bucket whose roots differ, enough to join all that links join.

    A bucket is dealt into blocks of about `params.block` members, and each two blocks meet in a group of their own, so that
    no task has all pairs of a large bucket. Pairs that bits of words and then the words themselves allow are aligned in the group, so what leaves it are links only.
    """

    def compared(key: tuple, group: pa.Table) -> pa.Table:
        node, n, root, block = (group[k].to_numpy() for k in ("node", "n", "root", "block"))
        bits = group["bits"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(node), -1)
        words = [np.frombuffer(x.as_buffer(), np.uint32) for x in group["words"]]
        buckets = [np.array(x, np.int64).view(np.uint64) for x in group["held"].to_pylist()]
        bands, bags, held = np.unique(np.concatenate(buckets)), Lists.of(words), Lists.of(buckets)
        band, own, first = key[0].as_py() % (1 << 64), np.arange(len(node)), block == block.min()
        rows, parent = [], {}
        for i in own[first].tolist():
            _, near = unlinked_pairs(n, root, bits, own[i : i + 1], own[i + 1 :] if first.all() else own[~first], params)
            near = possible_here(band, bands, node, held, n, bags, i, near, params)
            rows += [(min(node[i], node[j]), max(node[i], node[j]), like) for j, like in _aligned_links(i, near, root, words, parent, params)]
        a, b, like = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(like, pa.float64())})

    size = F.greatest(F.count(F.lit(1)) / params.block, F.sum("n") / params.block_words)
    blocks = members.groupBy("band").agg(F.ceil(size).cast("int").alias("blocks"))
    # bits and words meet a node's one row, which then goes to its buckets
    nodes = members.join(blocks, "band").groupBy("node", "n", "root").agg(F.collect_list(F.struct("band", "blocks")).alias("in"))
    nodes = nodes.join(facts.select("node", "bits"), "node").join(words, "node")
    own = nodes.select("node", "n", "root", "bits", "words", F.col("in.band").alias("held"), F.explode("in").alias("at")).select("*", "at.*").drop("at")
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    parts = max(4 * own.sparkSession.sparkContext.defaultParallelism, math.ceil(members.count() / params.pairs_per_part))
    own = own.repartition(parts, "band", "low", "high")  # small in bytes, long in work
    return own.groupBy("band", "low", "high").applyInArrow(compared, "a long, b long, similarity double").distinct()


def _rooted(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root, degree) of the nodes that have a link."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return scratch.keep(components(links, scratch).join(degree, "node"), "neardup-known")


def _placed(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members with the roots and links that they have so far."""
    return members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("degree", F.coalesce("degree", F.lit(0)))


def _leaders(placed: DataFrame) -> DataFrame:
    """(band, of, leader, led, ln, r, s): of each length class `of` of a bucket the member with the most links, its root and words; the least and greatest root."""
    first = F.min_by(F.struct("node", "root", "n"), F.struct(-F.col("degree"), F.col("node"))).alias("first")
    found = placed.groupBy("band", F.col("class").alias("of")).agg(first, F.min("root").alias("r"), F.max("root").alias("s"))
    return found.select("band", "of", F.col("first.node").alias("leader"), F.col("first.root").alias("led"), F.col("first.n").alias("ln"), "r", "s")


def _led_buckets(placed: DataFrame) -> DataFrame:
    """(band, leads): the buckets whose members have several roots, one row each, with the leaders of their length classes, which are few."""
    leads = F.collect_list(F.struct("of", "leader", "led", "ln")).alias("leads")
    return _leaders(placed).groupBy("band").agg(leads, F.min("r").alias("r"), F.max("s").alias("s")).where("r != s").select("band", "leads")


def _still_open(members: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Members with their roots so far, of the buckets of `least` members whose members have several."""
    placed = _placed(members, known)
    several = placed.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("r"), F.max("root").alias("s")).where(f"k >= {least} and r != s").select("band")
    return placed.join(several, "band", "left_semi")


def _links(sketched: DataFrame, texts: DataFrame, params: NeardupParams) -> DataFrame:
    """(a, b, similarity) of verified pairs, enough to join all nodes that links between members of a bucket join.

    `sketched`: (node, n, bands, bits). At first each node is compared with the least of its leaders, which are the least nodes of its
    buckets: a node of many copies meets one leader, not one in each bucket. In each of `params.rounds` rounds the member of a bucket and length class with the most links is then compared with
    one member of each other root of this and the neighbouring classes. Nodes that links join already need no comparison, so a bucket whose members all have
    one root is done. In those that are left, all members of different roots are compared by bits of words, and the pairs that
    these allow are aligned, in one of the buckets that the pair shares.
    """
    scratch = Scratch(sketched.sparkSession)
    links = materialize(_found_links(sketched, texts, params, scratch), "neardup-links")
    scratch.drop()
    return links


def _found_links(sketched: DataFrame, texts: DataFrame, params: NeardupParams, scratch: Scratch) -> DataFrame:
    members = scratch.keep(_in_buckets(sketched).withColumn("class", _length_class(F.col("n"), params)), "neardup-members")
    scratch.release()
    # texts and bits stay where they are: a few of other nodes do no harm, and those of nodes that are alone go
    among = may_be_among(scratch.keep(members.select("node").distinct(), "neardup-met"))
    facts = scratch.keep(sketched.select("node", "n", "bits").where(among(F.col("node"))), "neardup-facts")
    words = scratch.keep(word_lists(texts.where(among(F.col("uid"))), params), "neardup-words")

    def verify(met: DataFrame, done: DataFrame | None) -> DataFrame:
        pairs = _possible(met, facts, params)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "neardup-pairs")
        parts = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs.count() / params.pairs_per_part))
        found = scratch.keep(_verified(pairs.repartition(parts), words, params), "neardup-verified")
        return found if done is None else scratch.keep(done.unionByName(found), "neardup-done")

    placed = members.withColumn("root", F.col("node")).withColumn("degree", F.lit(0).cast("long"))
    done = verify(_met_leaders(placed, _leaders(placed), params).groupBy("node").agg(F.min("leader").alias("leader")), None)
    known = _rooted(done.where("similarity is not null"), scratch)
    for _ in range(params.rounds):
        buckets = scratch.keep(_led_buckets(_placed(members, known)), "neardup-buckets")
        if buckets.isEmpty():
            return done.where("similarity is not null")
        # members stay where they are: a few of other buckets find no leader
        members = scratch.keep(members.where(may_be_among(buckets.select("band"))(F.col("band"))), "neardup-left")
        done = verify(_met_in_lists(_one_of_each_root(_placed(members, known)), buckets, params), done)
        known = _rooted(done.where("similarity is not null"), scratch)
    # two members have met when leaders have met all
    open_ = scratch.keep(_still_open(members, known, 3 if params.rounds else 2), "neardup-open")
    if open_.isEmpty():
        return done.where("similarity is not null")
    return done.where("similarity is not null").unionByName(_met_all(open_, facts, words, params)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes of `edges` (a, b).

    Large-star and small-star steps in turn, until all components are stars; each halves long chains. The driver sees no rows.
    """
    keep = scratch.keep if scratch else materialize
    edges = keep(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u != v").distinct(), "components")
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that the large star leaves alone is its neighbours' least: they keep it
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.where("m != u").select("u", F.col("m").alias("v"))).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = keep(small, "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, which has none: then those are the roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    upward = edges.where("v > u").limit(1)
    wrong = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 or (down = 1 and root = 1)")
    return upward.isEmpty() and wrong.isEmpty()


@dataclass(frozen=True)
class NearDuplicates:
    """rows: (uid, doc_id, class_id, n_evidence, stays) for each document. links: (a, b, similarity) of texts, by the uid
    of one row of each. table: (uid, row), the documents' columns as a struct."""

    rows: DataFrame
    links: DataFrame
    table: DataFrame


def near_duplicates(documents: DataFrame, params: NeardupParams = NeardupParams(), doc_id: str = "doc_id", text: str = "text") -> NearDuplicates:
    """Classes of equal and near texts.

    class_id is the least id in the class, n_evidence the verified links of the row's text that the search needed, not all
    that it has (nodes joined already aren't compared); stays is true for one row of each class, which has that id. Null and empty texts are equal texts. Texts without a
    letter or digit are near only their equals. Repeated rows and equal texts are grouped by a digest before
    anything is compared. A class without any id has a null class_id. An empty table gives empty results.
    """
    own = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(doc_id).alias("__doc_id"))
    own = own.withColumn("digest", F.unhex(F.md5("__text"))).withColumn("uid", F.monotonically_increasing_id())
    table = materialize(own.drop("__text"), "neardup-texts")
    texts = table.select("uid", F.coalesce(F.col("row")[text], F.lit("")).alias("__text"))
    nodes = table.groupBy("digest").agg(F.min("uid").alias("node"))
    slim = materialize(table.select("uid", "__doc_id", "digest").join(nodes, "digest").drop("digest"), "neardup-nodes")
    distinct = without(texts, slim.where("uid != node").select("uid"), "uid")
    scratch = Scratch(documents.sparkSession)
    unique = scratch.keep(_sketched(distinct, "__text", params).select(F.col("uid").alias("node"), "__sketch.*"), "neardup-unique")
    links = _links(unique, texts, params)
    roots = scratch.keep(components(links, scratch), "neardup-roots")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_evidence"))
    placed = slim.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("__doc_id").alias("class_id"))
    placed = materialize(placed.join(least, "root"), "neardup-placed")
    scratch.drop()
    first = placed.where(F.col("__doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("uid").alias("first"))
    stays = F.col("uid") == F.col("first")
    rows = placed.join(first, "root").select("uid", F.col("__doc_id").alias("doc_id"), "class_id", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), stays.alias("stays"))
    return NearDuplicates(rows, links, table.select("uid", "row"))


def drop_near_duplicates(documents: DataFrame, params: NeardupParams = NeardupParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one row of each class; their columns as they are."""
    found = near_duplicates(documents, params, doc_id, text)
    gone = materialize(found.rows.where("not stays").select("uid"), "neardup-gone")
    return without(found.table, gone, "uid").select("row.*")
