"""Near-duplicates of short texts and of other scripts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import neardup as N


@pytest.mark.parametrize("n", [10, 11, 12, 15, 20, 25, 30, 31, 40, 41, 60])
@pytest.mark.parametrize("spread", ["each fifth word", "random words"])
def test_short_texts_meet_at_the_threshold(n, spread):
    rng, params, met, rows = random.Random(n), N.NeardupParams(), 0, 400
    for _ in range(rows):
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = a.copy()
        for place in range(4, n, 5) if spread == "each fifth word" else rng.sample(range(n), n // 5):
            b[place] = rng.getrandbits(64)
        x, y = N.text_bands(np.concatenate([a, b]), np.array([0, n, 2 * n]), params)
        met += len(np.intersect1d(x, y)) > 0
    assert met >= 0.9 * rows


def test_near_texts_have_one_kind_of_sketches_in_common():
    """A text may lose or gain a fifth of its words: lengths on both sides of the bounds still share a kind."""
    rng, params = random.Random(1), N.NeardupParams()
    for long in range(11, 60):
        short = long - long // 5
        met = 0
        for _ in range(40):
            b = np.array([rng.getrandbits(64) for _ in range(long)], np.uint64)
            a = np.delete(b, rng.randrange(long - (long - short) + 1) + np.arange(long - short))
            x, y = N.text_bands(np.concatenate([a, b]), np.array([0, short, short + long]), params)
            met += len(np.intersect1d(x, y)) > 0
        assert met >= 36, (short, long)


def words_of(text):
    words, starts = N._all_words(pa.array([text], pa.string()))
    assert starts.tolist() == [0, len(words)]
    return words.tolist()


def test_words_of_many_scripts():
    assert words_of("ПРИВЕТ, Мир — ok") == words_of("привет мир… OK") and len(words_of("Привет мир")) == 2
    assert words_of("ΚΑΛΗ μέρα") == words_of("καλη ΜΈΡΑ")
    assert len(words_of("漢字テスト")) == 5 and len(words_of("漢字 abc。")) == 3
    assert words_of("Élan vital") == words_of("élan VITAL") and len(words_of("don't stop")) == 3
    assert words_of(None) == words_of("") == words_of("…—!") == []


def test_near_texts_of_other_scripts(spark):
    rng = random.Random(5)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(39)]
    near = list(han)
    near[20] = "龍"
    cyrillic = " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(5)) for _ in range(30))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(39))
    rows = [(1, "".join(han)), (2, "".join(near)), (3, cyrillic), (4, cyrillic.upper()), (5, other), (6, "… — !")]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).rows.collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
