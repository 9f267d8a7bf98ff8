import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm.columnar import ngrams, row_slices, strings, words


def by_hand(text):
    out, word = [], ""
    for c in (text or "").lower():
        if unicodedata.category(c)[0] in "LNM" if ord(c) > 127 else c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB19 .-\n«»éÉß—日本0_", max_size=30)), max_size=6))
def test_words_equal_a_plain_loop(texts):
    w = words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(a, z)] for a, z in zip(w.first, w.first[1:])]
    assert got == [by_hand(t) for t in texts]


def test_hashes_tell_words_apart():
    # anagrams and words of equal letter sums among them
    names = sorted({a + b + c + d for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for d in "abcdefghij"} | {"one", "few", "x" * 500, "x" * 501})
    w = words(pa.array([" ".join(names)]))
    assert len(w.hash) == len(names) == len(np.unique(w.hash))
    assert len(np.unique(w.hash >> np.uint64(40))) > 9_900
    g, _ = ngrams(w, 3)
    assert len(np.unique(g)) == len(names) - 2


def test_ngrams_stay_within_rows():
    texts = ["a b c", "", None, "d", "e f", "a b c d"]
    for n in (1, 2, 3, 4):
        g, at = ngrams(words(pa.array(texts)), n)
        assert len(g) == sum(max(0, len(by_hand(t)) - n + 1) for t in texts)
    g, at = ngrams(words(pa.array(texts)), 3)
    assert g[0] == g[1] and g[1] != g[2]


def test_slices_cover_all_rows():
    col = strings(pa.array(["x" * n for n in (0, 5, 3_000_000, 2, 1, 900_000, 900_000)]))
    got = list(row_slices(col))
    assert got[0][0] == 0 and got[-1][1] == len(col) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    w = [words(col.slice(a, z - a)).hash for a, z in got]
    assert np.array_equal(np.concatenate(w), words(col).hash)
