"""Token alignment against the tokenizer libraries and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tablewright.llm import token_alignment as ta

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path(ta.BYTES_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(ta.PIECES_FILE))


def byte_of():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            table[chr(256 + n)] = b
            n += 1
    return table


def groups_by_hand(libraries, text):
    """[(A ids, B ids)] of one text."""
    a, b = libraries
    if not text:
        return []
    table = byte_of()
    made = a.encode(" " + text, add_special_tokens=False)
    a_side = [(i, bytes(table[c] for c in t)) for i, t in zip(made.ids, made.tokens, strict=True)]
    b_side = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        b_side.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    spelt = (" " + text).encode()
    if b"".join(x for _, x in a_side) != spelt or b"".join(x for _, x in b_side) != spelt:
        return []
    ends = []
    for side in (a_side, b_side):
        at, places = 0, []
        for _, x in side:
            at += len(x)
            places.append(at)
        ends.append(places)
    common = set(ends[0]) & set(ends[1])
    parts = []
    for side, places in zip((a_side, b_side), ends, strict=True):
        held, groups = [], []
        for (i, _), e in zip(side, places, strict=True):
            held.append(i)
            if e in common:
                groups.append(held)
                held = []
        parts.append(groups)
    return list(zip(*parts, strict=True))


def report_by_hand(libraries, rows):
    made = [(k, groups_by_hand(libraries, t)) for k, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, gs in made for g in gs)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for k, gs in made:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((
            k, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
            sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


TEXTS = [
    "<|endoftext|> plain <s> text </s> <unk>", "  two  spaces ", "a\n\n\nb\t\tc", "漢字かな交じり文 😀😀 👩‍👩‍👧", "Ünïcödé naïve — “quotes”…", "▁piece▁", "\x00\x01 zero",
    "1234567890 3.14159", "don't we'll I'M", " ", "\n", "x" * 700, "ab" * 400, " " * 300, "é" * 200, "​﻿", "https://example.com/a?b=c&d=%20", "\r\n\r\n", "𝔘𝔫𝔦", "ﬁ ½ ①",
]


@pytest.mark.parametrize("broadcast_pairs", [ta.BROADCAST_PAIRS, 40])
def test_report_of_odd_texts(spark, libraries, prose, broadcast_pairs):
    rng = random.Random(3)
    alphabet = list("ab cé\n.▁漢😀 '1") + ["the ", "<s>", "ing", "́"]
    rows = list(enumerate(TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(200)] + [prose(s, 200) for s in range(8)]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(ta.alignment_report(df, broadcast_pairs=broadcast_pairs)) == report_by_hand(libraries, rows)


def test_groups_spell_the_texts(spark, libraries, prose):
    rows = [(i, t) for i, t in enumerate([*TEXTS, prose(4, 500)])]
    for r in ta.align(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        a, b, got = 0, 0, []
        for x, y in zip(r.a_ends, r.b_ends, strict=True):
            got.append((r.a_ids[a:x], r.b_ids[b:y]))
            a, b = x, y
        assert got == groups_by_hand(libraries, r.text) and (a, b) == (len(r.a_ids), len(r.b_ids))


def test_divide_and_conquer_finds_every_common_end():
    rng = random.Random(4)
    for _ in range(200):
        a_all, b_all, a_text, b_text, at = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 5)):
            size = rng.choice([1, 5, 60, 400])
            share = rng.choice([0.02, 0.3, 0.9])
            a = sorted({size, *(x for x in range(1, size) if rng.random() < share)})
            b = sorted({size, *(x for x in range(1, size) if rng.random() < share)})
            a_all += [at + x for x in a]
            b_all += [at + x for x in b]
            a_text.append(len(a_all))
            b_text.append(len(b_all))
            at += size
        i, j = ta.shared_groups(np.array(a_all), np.array(b_all), np.array(a_text), np.array(b_text))
        common = sorted(set(a_all) & set(b_all))
        assert [a_all[k - 1] for k in i] == common == [b_all[k - 1] for k in j]


def test_intervals_stay_in_the_order_of_the_texts(monkeypatch):
    seen, middle_cut = [], ta.middle_cut

    def looked_at(a_end, b_end, a0, a1, b0, b1):
        seen.append((a0, a1))
        return middle_cut(a_end, b_end, a0, a1, b0, b1)

    monkeypatch.setattr(ta, "middle_cut", looked_at)
    end, text = np.arange(1, 41), np.array([0, 13, 13, 40])
    a_stop, b_stop = ta.shared_groups(end, end, text, text)
    assert a_stop.tolist() == b_stop.tolist() == end.tolist()
    assert len(seen) > 3 and all((a1[:-1] <= a0[1:]).all() for a0, a1 in seen)


def test_digest_of_a_slice_is_cut_between_texts(libraries):
    texts = ["one two", None, "", "x ☃ y", "9" * 70, "a\x00b", "▁ spaced ▁"]
    aligner = ta.Aligner(P.path(ta.BYTES_FILE), P.path(ta.PIECES_FILE))
    assert aligner.written.dtype.kind == "S"
    wanted = ["n_a", "groups_sha256"]
    together, alone = aligner.align(texts, wanted), [aligner.align([t], wanted) for t in texts]
    assert together["groups_sha256"] == [a["groups_sha256"][0] for a in alone]
    assert together["n_a"].tolist() == [a["n_a"][0] for a in alone]


def test_long_text_without_common_ends():
    a, b = np.arange(1, 400_001) * 2, np.r_[np.arange(0, 399_999) * 2 + 1, 800_000]
    i, j = ta.shared_groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert i.tolist() == [len(a)] and j.tolist() == [len(b)]


def test_odd_rows_are_aligned(odd, none, odd_rows, libraries):
    got = ta.alignment_report(odd)
    assert rows_of(got) == report_by_hand(libraries, [(r[0], r[1]) for r in odd_rows])
    assert ta.alignment_report(none).count() == 0
    assert ta.align(odd, columns=("n_a",)).columns.count("n_a") == 1


def test_texts_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1 AS doc_id, cast(X'6162ff63' AS string) AS text")
    (r,) = ta.align(df, columns=("n_a", "n_b", "n_groups")).select("n_a", "n_b", "n_groups").collect()
    (want,) = ta.align(spark.createDataFrame([(1, "ab�c")], "doc_id bigint, text string"), columns=("n_a", "n_b", "n_groups")).select("n_a", "n_b", "n_groups").collect()
    assert r == want and r.n_groups > 0


def test_query_over_documents(spark, sf_dir, libraries):
    from tablewright.llm.queries import R

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(R.queries["op12_token_alignment"](spark, sf_dir)) == report_by_hand(libraries, rows)
