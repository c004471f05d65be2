"""Cross-tokenizer alignment: the tokens of two tokenizers grouped between the byte places where both end.

1. Each text, after one space, is cut into tokens by a byte-level vocabulary (A) and a piece model (B). A text whose
   tokens do not spell its bytes again is left without tokens.
2. Groups are found by divide and conquer: of every open interval of tokens the common end next to the middle A
   token is found by bisection in B's ends, and both halves go on; an interval without a common end inside is a group.
   All intervals of a slice of texts halve at once. Where the middle has no partner, the ends around it are tried in
   rings that double.
3. A link is an A and a B token that end together: the last of each group. Links of a pair of ids are counted over
   all texts with partial sums. The count table goes back to the links by broadcast as far as its
   ``BROADCAST_PAIRS`` most frequent pairs; links of rarer pairs are joined by a shuffle.

Null and empty texts have no tokens, groups or links. Special strings inside texts are plain text. Very long texts make one
longer slice; no text is cut. Texts that are not UTF-8 are read with U+FFFD for bad bytes. Repeated rows count again; ties for
the best link all count. Input columns named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns
from tablewright.llm.words import slices
from tablewright.plans.attach import has_at_most
from tablewright.plans.lineage import cut, scratch_path

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BROADCAST_PAIRS = 1_000_000
#: Ids of B a pair code leaves room for.
ROOM = 32_768
COLUMNS = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "a_ids": "array<int>", "b_ids": "array<int>",
    "a_ends": "array<int>", "b_ends": "array<int>", "links": "array<bigint>", "groups_sha256": "string",
}


class ByteTokens:
    """Ids and bytes of a byte-level vocabulary file; its ids are also its merge order."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocabulary, special = made["model"]["vocab"], {t["content"] for t in made["added_tokens"]}
        # bytes that print stand for themselves, the others for 256 and on
        prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(prints)]
        byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in made["model"]["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("ids of this vocabulary are not its merge order")
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.whole = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = path, None

    def ids(self, text: str) -> list[int]:
        try:
            return self.whole.encode_ordinary(text)
        except BaseException as error:  # the pattern gives up on very long runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids and bytes of a piece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if len(pieces) > ROOM:
            raise ValueError("more pieces than a pair code has room for")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


def ragged(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each member and its number inside the owner."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def middle_cut(a_end: np.ndarray, b_end: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval, the A and the B token that end together nearest to the middle and before the interval's end; -1 if none does."""
    found, partner = np.full(len(a0), -1), np.full(len(a0), -1)
    middle = (a0 + a1 - 2) // 2
    still = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
    # most middles have a partner
    at = middle[still]
    ends = a_end[at]
    to = np.minimum(np.searchsorted(b_end, ends), len(b_end) - 1)
    hit = b_end[to] == ends
    found[still[hit]], partner[still[hit]] = at[hit], to[hit]
    still = still[~hit]
    reach = np.maximum(middle - a0, a1 - 2 - middle)
    still = still[reach[still] > 0]
    ring, far = np.array([1, -1, 2, -2]), 2
    while len(still):
        at = middle[still][:, None] + ring
        inside = (at >= a0[still][:, None]) & (at <= a1[still][:, None] - 2)
        ends = a_end[np.where(inside, at, 0)]
        to = np.minimum(np.searchsorted(b_end, ends), len(b_end) - 1)
        hit = inside & (b_end[to] == ends)
        first, any_hit = hit.argmax(1), hit.any(1)
        rows = np.flatnonzero(any_hit)
        found[still[rows]] = at[rows, first[rows]]
        partner[still[rows]] = to[rows, first[rows]]
        still = still[~any_hit & (reach[still] > far)]
        step = np.arange(far + 1, 2 * far + 3)
        ring, far = np.stack([step, -step], 1).ravel(), 2 * far + 2
    return found, partner


def shared_groups(a_end: np.ndarray, b_end: np.ndarray, a_text: np.ndarray, b_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Past-last A and B token of every group of all texts. ``*_end`` are increasing byte places, ``*_text`` the token bounds
    of the texts (0 first), which both end at."""
    a0, a1, b0, b1 = a_text[:-1], a_text[1:], b_text[:-1], b_text[1:]
    some = a1 > a0
    a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
    done_a, done_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a0):
        i, j = middle_cut(a_end, b_end, a0, a1, b0, b1)
        leaf = i < 0
        done_a.append(a1[leaf])
        done_b.append(b1[leaf])
        split = np.flatnonzero(~leaf)
        a0, a1, b0, b1, i, j = (x[split] for x in (a0, a1, b0, b1, i + 1, j + 1))
        # halves stay in the order of the texts: bisection of increasing places is quicker
        a0, a1, b0, b1 = (np.stack(x, 1).ravel() for x in ((a0, i), (i, a1), (b0, j), (j, b1)))
    return np.sort(np.concatenate(done_a)), np.sort(np.concatenate(done_b))


class Aligner:
    def __init__(self, bytes_file: str, pieces_file: str) -> None:
        self.a, self.b = ByteTokens(bytes_file), PieceTokens(pieces_file)
        self.a_size, self.b_size = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        # decimal ids with what follows, filled up with zero bytes: A inside and at the end of a group's A tokens, B likewise
        n, m = len(self.a.bytes), len(self.b.bytes)
        written = [f"{i}{c}".encode() for k, follow in ((n, ",|"), (m, ",;")) for c in follow for i in range(k)]
        self.written, self.width = np.array(written), np.array([len(w) for w in written], np.int64)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        spelt = b" " + text.encode()
        b = self.b.ids(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != spelt:
            return none
        made = self.a.ids(" " + text)
        a = np.fromiter(made, np.int64, len(made))
        # A's tokens are parts of the text in their order: with all its bytes they are the text
        if self.a_size[a].sum() != len(spelt):
            return none
        return a, np.fromiter(b, np.int64, len(b))

    def align(self, texts: list[str | None], wanted: list[str]) -> dict[str, list | pa.Array]:
        """The ``wanted`` columns of one slice of texts."""
        both = [self.tokens(t) for t in texts]
        ids, text, end = [], [], []
        for side, size in ((0, self.a_size), (1, self.b_size)):
            length = np.fromiter((len(x[side]) for x in both), np.int64, len(both))
            text.append(np.r_[0, np.cumsum(length)])
            ids.append(np.concatenate([x[side] for x in both]))
            end.append(np.cumsum(size[ids[-1]]))
        a_stop, b_stop = shared_groups(*end, *text)
        of_text = np.searchsorted(a_stop, text[0], "right")  # groups before each text's end
        bounds = pa.array(of_text, pa.int32())
        out: dict[str, list | pa.Array] = {}
        for side, name, stop in ((0, "a", a_stop), (1, "b", b_stop)):
            if f"n_{name}" in wanted:
                out[f"n_{name}"] = np.diff(text[side])
            if f"{name}_ids" in wanted:
                out[f"{name}_ids"] = pa.ListArray.from_arrays(pa.array(text[side], pa.int32()), pa.array(ids[side], pa.int32()))
            if f"{name}_ends" in wanted:
                begins = np.repeat(text[side][:-1], np.diff(of_text))
                out[f"{name}_ends"] = pa.ListArray.from_arrays(bounds, pa.array(stop - begins, pa.int32()))
        out["n_groups"] = np.diff(of_text)
        if "links" in wanted:
            pairs = ids[0][a_stop - 1] * ROOM + ids[1][b_stop - 1]
            out["links"] = pa.ListArray.from_arrays(bounds, pa.array(pairs, pa.int64()))
        if "groups_sha256" in wanted:
            out["groups_sha256"] = self.digests(ids, text, a_stop, b_stop)
        return {k: out[k] for k in wanted}

    def digests(self, ids: list[np.ndarray], text: list[np.ndarray], a_stop: np.ndarray, b_stop: np.ndarray) -> list[str]:
        n, m = len(self.a.bytes), len(self.b.bytes)
        a_code, b_code = ids[0].copy(), ids[1] + 2 * n
        a_code[a_stop - 1] += n
        b_code[b_stop - 1] += m
        a_group, b_group = (np.repeat(np.arange(len(s)), np.diff(np.r_[0, s])) for s in (a_stop, b_stop))
        merged = np.empty(len(a_code) + len(b_code), np.int64)
        merged[np.arange(len(a_code)) + np.r_[0, b_stop][a_group]] = a_code
        merged[np.arange(len(b_code)) + a_stop[b_group]] = b_code
        line = self.written[merged].tobytes().translate(None, b"\0")
        bounds = np.r_[0, np.cumsum(self.width[merged])][text[0] + text[1]].tolist()
        # what follows the last id of a text is left out
        return [hashlib.sha256(line[a : b - 1]).hexdigest() if a < b else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def align(
    df: DataFrame, text: str = "text", columns: tuple[str, ...] = ("a_ids", "b_ids", "a_ends", "b_ends"),
    bytes_file: str = BYTES_FILE, pieces_file: str = PIECES_FILE,
) -> DataFrame:
    """Add ``columns`` of ``COLUMNS``: token ids, past-last tokens of the groups, counts, links as pair codes
    (A id * ``ROOM`` + B id), digest of the groups. Files are names of public tokenizers or paths."""
    wanted = list(columns)

    def make():
        import os

        def place(name: str) -> str:
            if os.sep in name:
                return name
            import public_tokenizers

            return public_tokenizers.path(name)

        aligner = Aligner(place(bytes_file), place(pieces_file))

        def work(texts):
            parts = [
                aligner.align([t.decode(errors="replace") if t is not None else None for t in texts[a:b]], wanted)
                for a, b in slices(texts)
            ]
            joined = []
            for c in wanted:
                held = [p[c] for p in parts]
                if held and isinstance(held[0], pa.Array):
                    joined.append(pa.concat_arrays(held))
                else:
                    joined.append([v for h in held for v in (h.tolist() if isinstance(h, np.ndarray) else h)])
            return joined

        return work

    return append_columns(df, text, ", ".join(f"{c} {COLUMNS[c]}" for c in wanted), make)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked pair of ids: its links in all texts, and whether no pair of its B id has more."""
    pairs = cut(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    b = F.pmod("pair", F.lit(ROOM))
    top = pairs.groupBy(b.alias("_b")).agg(F.max("n").alias("_top"))  # at most ROOM rows
    return cut(pairs.join(F.broadcast(top), b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best")))


def link_stats(aligned: DataFrame, pairs: DataFrame, row: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links."""
    links = aligned.select(row, F.explode("links").alias("pair"))

    def summed(met: DataFrame) -> DataFrame:
        return met.groupBy(row).agg(F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("n").alias("count_sum"))

    if has_at_most(pairs, broadcast_pairs):
        return summed(links.join(F.broadcast(pairs), "pair"))
    # the most frequent pairs, as many as fit; what ties with the first that does not fit stays out
    sizes = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))
    ranked = sizes.withColumn("upto", F.sum("pairs").over(Window.orderBy(F.desc("n"))))
    least = ranked.where(F.col("upto") <= broadcast_pairs).agg(F.min("n")).first()[0]
    often = cut(pairs.where(F.lit(False) if least is None else F.col("n") >= least))
    rest = cut(pairs.join(F.broadcast(often.select("pair")), "pair", "left_anti"))
    rare = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rest, "pair")
    both = summed(links.join(F.broadcast(often), "pair")).unionByName(summed(rare))
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(
    docs: DataFrame, text: str = "text", key: str = "doc_id", bytes_file: str = BYTES_FILE, pieces_file: str = PIECES_FILE,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Texts are tokenized once; the links wait in the checkpoint folder until the pairs are counted.
    """
    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))
    made = align(slim, "_body", ("n_a", "n_b", "n_groups", "groups_sha256", "links"), bytes_file, pieces_file)
    path = scratch_path(docs.sparkSession, "token-links")
    made.drop("_body").withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    held = docs.sparkSession.read.parquet(path)
    stats = link_stats(held, pair_counts(held), "_row", broadcast_pairs)
    joined = held.drop("links").join(stats, "_row", "left")
    none = F.lit(0).cast("bigint")
    return joined.select(
        F.col(f"`{key}`"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )
