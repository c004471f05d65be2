import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tablewright.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(x) for x in model.encode(texts)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(PATH)


FIXED = ["", " ", "  ", "\n", "\n\n a", " a", "a ", "a \nb", "▁", "a ▁b", "<s> hi </s>", "<0x41>", "a" * 1000, " " * 700, "=" * 900, "the" * 400, "\0x"]


def test_same_counts_as_the_library(counter, library):
    rng = random.Random(5)
    parts = ["the", "ing", " ", "  ", "\n", "▁", "é", "漢", "😀", "<s>", "0", "12", "\t", ".", "tion", "q"]
    texts = FIXED + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    assert counter.count(texts) == library(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(counter, library, text):
    assert counter.count([text]) == library([text])


def test_rounds_and_heap_merge_alike(counter):
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("aehint") for _ in range(rng.randint(1, 120))) for _ in range(200)]
    assert counter.ranks.merge_rounds(words).tolist() == [counter.ranks.count_long(w) for w in words]


def test_odd_rows(odd, none, odd_rows, library):
    got = token_counts.over_limit(token_counts.count_tokens(odd))
    assert got.columns[-3:] == ["n_bytes", "n_tokens", "over_limit"] and got.count() == len(odd_rows)
    want = sorted((r[0] or 0, len((r[1] or "").encode()), n, n > 4096) for r, n in zip(odd_rows, library([r[1] or "" for r in odd_rows]), strict=True))
    assert sorted((r[0] or 0, *r[1:]) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert token_counts.count_tokens(none).count() == 0
