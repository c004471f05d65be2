"""Spelling variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tablewright.llm import spelling_variants as sv

LOWER = str.maketrans(sv.UPPER, sv.LOWER)


def counts_by_hand(rows, least=7, every=31):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants_by_hand(n, factor=10):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def busy():
    """Words in chains of edits and sets of anagrams, frequent ones far more often."""
    rng = random.Random(5)
    roots = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    roots += ["".join(rng.sample("abcdefgh", 8)) for _ in range(60)] + ["x" * 80, "x" * 81, "x" * 79 + "y", "Àbcdefg", "àbcdefg"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = roots[min(int(rng.expovariate(0.06)), len(roots) - 1)]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abÉ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "1 "]).join(words)))
    rows += [(900 + i, " ".join(roots)) for i in range(3)]
    return rows


@pytest.mark.parametrize("cell_words,cell_letters,many", [(50_000, 4_000_000, 1 << 14), (40, 600, 4)])
def test_variants_of_whole_texts(spark, monkeypatch, busy, cell_words, cell_letters, many):
    monkeypatch.setattr(sv, "MANY_PAIRS", many)
    monkeypatch.setattr(sv, "SAMPLE_A_CELL", 16)
    df = spark.createDataFrame(busy, "doc_id bigint, text string").repartition(3)
    want = counts_by_hand(busy)
    words = sv.word_counts(df)
    assert {r.word: r.n for r in words.collect()} == want
    got = result(sv.variants(words, cell_words=cell_words, cell_letters=cell_letters))
    assert got == variants_by_hand(want) and sum(r[1] is not None for r in got) > 30


def test_large_sets_of_anagrams_meet_by_hash(monkeypatch):
    rng = random.Random(6)
    words = sorted({"".join(rng.sample("abcdefg", 7)) for _ in range(300)} | {"".join(rng.sample("abcdefh", 7)) for _ in range(300)}
                   | {"".join(rng.sample("abcdefgg", 8)) for _ in range(300)})
    want = {(a, b) for a in words for b in words if len(a) <= len(b) and one_apart(a, b)}
    monkeypatch.setattr(sv, "MANY_PAIRS", 0)
    called = []
    real = sv.meeting
    monkeypatch.setattr(sv, "meeting", lambda *a: called.append(1) or real(*a))
    for leaf in (2, 1 << 20):
        monkeypatch.setattr(sv, "LEAF", leaf)
        held = sv.Words(words)
        i, j = sv.near_pairs(held, held, np.ones(len(words), bool))
        assert {(words[a], words[b]) for a, b in zip(i, j, strict=True)} == want and len(i) == len(want)
    assert called


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(8)
    words = sv.Words(sorted({"".join(rng.choice("abcdefghijé") for _ in range(8)) for _ in range(900)}))
    vectors = np.unique(words.vectors, axis=0)
    apart = np.bitwise_count(vectors[:, None] ^ vectors[None]).sum(2)
    for radius in (0, 1, 2):
        q, t = sv.Tree(vectors, leaf=8).within(vectors, np.full(len(vectors), radius, np.uint8))
        assert sorted(zip(q, t, strict=True)) == sorted(zip(*np.nonzero(apart <= radius), strict=True))


def test_odd_rows_have_words(odd, none, odd_rows):
    want = counts_by_hand([(r[0], r[1]) for r in odd_rows])
    assert result(sv.variants(sv.word_counts(odd))) == variants_by_hand(want)
    assert sv.variants(sv.word_counts(none)).count() == 0


def test_texts_that_are_not_utf8(spark):
    df = spark.sql("SELECT id AS doc_id, decode(X'61', 'UTF-8') || cast(X'62ff63206c65747465727375206c657474657273FF' AS string) AS text FROM range(3)")
    assert {r.word for r in sv.word_counts(df, typo_every=None).collect()} == {"lettersu", "letters"}


def test_query_over_documents(spark, sf_dir):
    from tablewright.llm.queries import R

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = R.queries["op13_spelling_variants"](spark, sf_dir)
    assert result(got) == variants_by_hand(counts_by_hand(rows))
