"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one flat array of symbols cut into sequences. In every round each
sequence merges its pair of lowest rank (the leftmost of equals), all sequences at once; what is left
when no sequence has a pair in the vocabulary is counted. Pre-tokens longer than ``LONG`` symbols, where a
round per merge would be quadratic, go through a heap that makes the same merges in the same order.

Null and empty texts have no tokens. Repeated rows are counted each. Input columns named like a result
are replaced.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns

SPACE = "▁"
LONG = 256
CACHED = 1 << 19
NONE = np.inf


class PieceRanks:
    """Merge tables of a piece model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        piece = {model.id_to_piece(i): i for i in plain}
        self.size = model.vocab_size()
        score = np.full(self.size, NONE)
        for i in plain:
            score[i] = -model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in piece):
            raise ValueError("a piece goes on after a word's end; words can't be counted one by one")
        self.lines_apart = not any("\n" in p for p in piece)
        self.of_char = np.full(0x110000, -1, np.int64)
        made: dict[int, tuple[float, int]] = {}
        for p, i in piece.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
            for k in range(1, len(p)):
                left, right = piece.get(p[:k]), piece.get(p[k:])
                if left is not None and right is not None:
                    made[left * self.size + right] = (score[i], i)
        self.keys = np.array(sorted(made), np.int64)
        self.rank = np.array([made[k][0] for k in self.keys.tolist()])
        self.into = np.array([made[k][1] for k in self.keys.tolist()], np.int64)
        self.pairs = made

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.into[at], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, symbol ids (-1: outside the vocabulary) and the word each belongs to."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        return points, self.of_char[points], np.repeat(np.arange(len(words)), [len(w) for w in words])

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word; a character outside the vocabulary counts its UTF-8 bytes."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.count_long(w)
        if short:
            out[short] = self.merge_rounds([words[i] for i in short])
        return out

    def merge_rounds(self, words: list[str]) -> np.ndarray:
        points, sym, seq = self.symbols(words)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        counts = np.bincount(seq, np.where(sym < 0, width, 0), len(words)).astype(np.int64)
        rank = np.full(len(sym), NONE)
        into = np.full(len(sym), -1, np.int64)

        def refresh(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym) - 1)]
            rank[at], into[at] = self.pair_ranks(sym[at], sym[at + 1])
            apart = at[seq[at] != seq[at + 1]]
            rank[apart] = NONE

        refresh(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            sizes = np.diff(np.r_[starts, len(sym)])
            keep = np.repeat(live, sizes)
            done = ~keep & (sym >= 0)
            counts += np.bincount(seq[done], minlength=len(words))
            best = np.repeat(best[live], sizes[live])
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            if not len(sym):
                break
            tied = np.flatnonzero(rank == best)
            at = tied[np.r_[True, seq[tied[1:]] != seq[tied[:-1]]]]
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            rank[at] = NONE
            at = at - np.arange(len(at))
            sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
            rank[np.minimum(at, len(sym) - 1)] = NONE
            if len(sym):
                rank[-1] = NONE
            refresh(np.r_[at - 1, at])
        return counts

    def count_long(self, word: str) -> int:
        points, ids, _ = self.symbols([word])
        sym, n = ids.tolist(), len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\x01") * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                found = self.pairs.get(sym[i] * self.size + sym[j])
                if found:
                    heapq.heappush(heap, (found[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        total = sum((p >= 0x80) + (p >= 0x800) + (p >= 0x10000) for p, s in zip(points.tolist(), sym, strict=True) if s < 0) + n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = self.pairs[a * self.size + b][1]
            alive[j] = 0
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            total -= 1
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return total


class TokenCounter:
    """Counts whole texts; counts of pre-tokens are remembered while the table stays small."""

    def __init__(self, path: str) -> None:
        self.ranks = PieceRanks(path)
        self.known: dict[str, int] = {}
        self.odd = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def pre_tokens(self, text: str) -> list[str]:
        """Keys of units no merge crosses: a word without its leading space, or an odd unit with all its spaces."""
        if not text:
            return []
        plain = self.ranks.lines_apart and not (
            "  " in text or SPACE in text or " \n" in text or text[0] == " " or text[-1] == " "
        )
        if plain:
            return text.replace("\n", " \n").split(" ")
        return self.odd.findall(SPACE + text.replace(" ", SPACE))

    def unit(self, key: str) -> tuple[str, int]:
        """What is merged for a key, and the tokens beside it. A line feed has no piece: it is one byte."""
        if key[:1] == SPACE:
            return key, 0
        if key[:1] == "\n" and self.ranks.lines_apart:
            return key[1:], 1
        return SPACE + key, 0

    def count(self, texts: list[str]) -> list[int]:
        units = [self.pre_tokens(t) for t in texts]
        new = list(set().union(*units).difference(self.known)) if units else []
        for i in range(0, len(new), 1 << 15):
            part = new[i : i + (1 << 15)]
            pieces = [self.unit(k) for k in part]
            made = self.ranks.count([p for p, _ in pieces]).tolist()
            self.known.update((k, m + more) for k, m, (_, more) in zip(part, made, pieces, strict=True))
        out = [sum(map(self.known.__getitem__, u)) for u in units]
        if len(self.known) > CACHED:
            self.known.clear()
        return out


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens``. ``tokenizer`` names a public piece model or gives the path of one."""

    def make():
        import os

        path = tokenizer
        if os.sep not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        counter = TokenCounter(path)

        def work(texts):
            return [
                [len(t) if t is not None else 0 for t in texts],
                counter.count([t.decode(errors="replace") if t is not None else "" for t in texts]),
            ]

        return work

    return append_columns(df, text, "n_bytes bigint, n_tokens bigint", make)


def over_limit(counted: DataFrame, limit: int = 4_096) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
