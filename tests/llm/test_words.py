import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tablewright.llm.words import WORDS_AND_MARKS, hash_words, shingles, slices, sorted_sets

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\t\n\x0b.#", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    data = [t.encode() if t is not None else None for t in texts]
    hashes, rows, first, past = hash_words(data)
    want = [(i, w) for i, t in enumerate(data) for w in (t or b"").lower().split()]
    got = [(int(r), data[r].lower()[a:b]) for r, a, b in zip(rows, first, past, strict=True)]
    assert got == want
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    data = [t.encode() if t is not None else None for t in texts]
    words, rows, _, _ = hash_words(data)
    sets = sorted_sets(*shingles(words, rows), len(data))
    for t, s in zip(data, sets, strict=True):
        w = (t or b"").lower().split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(s) == len(want)


def test_marks_are_words_of_their_own():
    _, _, first, past = hash_words([b"ab### c"], WORDS_AND_MARKS)
    assert list(zip(first.tolist(), past.tolist(), strict=True)) == [(0, 2), (2, 5), (6, 7)]


def test_slices_cover_every_row_once():
    rng = random.Random(1)
    texts = [b"x" * rng.randint(0, 700_000) for _ in range(20)] + [None, b""]
    spans = list(slices(texts))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(texts)))
    assert np.all(np.array([b - a for a, b in spans]) > 0)
