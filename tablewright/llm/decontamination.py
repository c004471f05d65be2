"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words: lower-cased, with ASCII punctuation as white space. An
item and a document that share seeds of five words are tiled: the longest match of words that no tile has
taken becomes a tile, again and again, down to five words; running Karp-Rabin hashes find the matches. The
share of the item under tiles is its coverage. Tiles may stand in any order in the document, so reordered
passages count like whole ones.

The benchmark is read in blocks of about ``BLOCK_WORDS`` words (whole items, dealt by a hash of their text),
each one bounded table in the tasks of one pass over the documents. Documents never move, and a document is
tiled only against items whose seeds could reach the coverage, in the words around those seeds.

Null, empty and shorter texts than five words match nothing. Items of equal text are one, under the smallest
item id. Repeated documents are each reported. An empty table on either side gives no matches.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns, explode_from
from tablewright.llm.mixing import word_count
from tablewright.llm.words import hash_words, mix, powers, slices

LEAST_TILE = 5
COVERAGE = 0.6
BLOCK_WORDS = 500_000
FIRST_SEARCH = 20
PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain(texts: list[bytes | None]) -> list[bytes]:
    return [t.translate(PUNCTUATION) if t else b"" for t in texts]


def window_hashes(values: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``n`` free words and their running hashes."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    taken = np.r_[0, np.cumsum(~free)]
    start = np.flatnonzero(taken[n:] == taken[:-n])
    return start, mix((total[start + n] - total[start]) * down[start])


def matches(doc, item, free_doc, free_item, n):
    """(doc start, item start, length) of all matches of at least ``n`` free words, as long as they go."""
    d_at, d_hash = window_hashes(doc, free_doc, n)
    i_at, i_hash = window_hashes(item, free_item, n)
    order = np.argsort(d_hash, kind="stable")
    d_at, d_hash = d_at[order], d_hash[order]
    low, high = np.searchsorted(d_hash, i_hash, "left"), np.searchsorted(d_hash, i_hash, "right")
    many = high - low
    i = np.repeat(i_at, many)
    d = d_at[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(i))] if len(i) else i
    length = np.full(len(i), n, np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = d[live] + length[live], i[live] + length[live]
        inside = (x < len(doc)) & (y < len(item))
        live, x, y = live[inside], x[inside], y[inside]
        same = (doc[x] == item[y]) & free_doc[x] & free_item[y]
        live = live[same]
        length[live] += 1
    return d, i, length


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length), longest first, leftmost in the item and then in the document."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, FIRST_SEARCH)
    while True:
        d, i, length = matches(doc, item, free_doc, free_item, search)
        if not len(length):
            if search == least:
                return tiles
            search = max(least, search // 2)
            continue
        longest = int(length.max())
        top = length == longest
        order = np.lexsort((d[top], i[top]))
        for x, y in zip(d[top][order].tolist(), i[top][order].tolist(), strict=True):
            if free_doc[x : x + longest].all() and free_item[y : y + longest].all():
                free_doc[x : x + longest] = False
                free_item[y : y + longest] = False
                tiles.append((x, y, longest))


@dataclass
class Block:
    """Items of one block: their words, and the seeds of all, sorted."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        words, row, _, _ = hash_words(plain([t.encode() for _, t in rows]))
        split = [words[row == k] for k in range(len(rows))]
        found = [window_hashes(w, np.ones(len(w), bool), LEAST_TILE) for w in split]
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        seeds = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        order = np.argsort(seeds, kind="stable")
        return cls([r[0] for r in rows], split, seeds[order], item[order], at[order])

    def tile(self, texts: list[bytes | None], coverage: float):
        """(row, item index, tiles) of the pairs at or above ``coverage``."""
        found = []
        for a, b in slices(texts):
            words, row, _, _ = hash_words(plain(texts[a:b]))
            start, value = window_hashes(words, np.ones(len(words), bool), LEAST_TILE)
            whole = row[start] == row[start + LEAST_TILE - 1]
            start, value = start[whole], value[whole]
            low = np.searchsorted(self.seeds, value, "left")
            hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == value)
            if not len(hit):
                continue
            many = np.searchsorted(self.seeds, value[hit], "right") - low[hit]
            which = np.repeat(low[hit] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            place = np.repeat(start[hit], many)
            item, seat, doc = self.seed_item[which], self.seed_at[which], row[place]
            order = np.lexsort((item, doc))
            edges = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0), True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                own = order[x:y]
                k, r = int(item[own[0]]), int(doc[own[0]])
                target = self.words[k]
                under = np.zeros(len(target) + 1, np.int64)
                np.add.at(under, np.unique(seat[own]), 1)
                reach = (np.convolve(under[:-1], np.ones(LEAST_TILE, np.int64))[: len(target)] > 0).sum()
                if reach < coverage * len(target):
                    continue
                first = np.searchsorted(row, r)
                near = np.unique((np.unique(place[own])[:, None] + np.arange(LEAST_TILE)).ravel())
                gap = np.flatnonzero(np.diff(near) > 1) + 1
                # a word no text has keeps the pieces around the seeds apart
                region = np.insert(words[near], gap, np.uint64(0))
                where = np.insert(near - first, gap, -1)
                tiles = greedy_tiles(region, target)
                if sum(t[2] for t in tiles) >= coverage * len(target):
                    found.append((a + r, k, [(int(where[t[0]]), t[1], t[2]) for t in tiles]))
        return found


def blocks(benchmark: DataFrame, text: str, key: str, block_words: int):
    """One Block at a time; every block is bounded by ``block_words`` and its largest item."""
    items = benchmark.where(F.col(f"`{text}`").isNotNull()).groupBy(F.col(f"`{text}`").alias("_item")).agg(
        F.min(F.col(f"`{key}`")).alias("_id")
    )
    total = items.agg(F.sum(word_count(F.col("_item")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("_item"), F.lit(n)) == k).select("_id", "_item").collect()
        block = Block.of([(r[0], r[1]) for r in rows])
        if len(block.seeds):
            yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item_key: str = "item_id", coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item at or above ``coverage``: words of the item, words and spans of its tiles."""
    schema = (
        "item_id bigint, item_words int, matched_words int, coverage double, "
        "tiles array<struct<doc_word:int,item_word:int,words:int>>"
    )

    def one(block: Block) -> DataFrame:
        def make():
            def work(texts):
                found = block.tile(texts, coverage)
                n = [sum(t[2] for t in f[2]) for f in found]
                size = [len(block.words[f[1]]) for f in found]
                yield (
                    [f[0] for f in found],
                    [block.ids[f[1]] for f in found],
                    size,
                    n,
                    [m / s for m, s in zip(n, size, strict=True)],
                    [[{"doc_word": a, "item_word": b, "words": w} for a, b, w in f[2]] for f in found],
                )

            return work

        return explode_from(docs, text, [key], schema, make)

    out = None
    for block in blocks(benchmark, item_text, item_key, block_words):
        out = one(block) if out is None else out.union(one(block))
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{key}` {dict(docs.dtypes)[key]}, {schema}")
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id",
    coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without leaks, columns as they were."""
    names = docs.columns
    for block in blocks(benchmark, item_text, item_key, block_words):

        def make(block=block):
            def work(texts):
                leaked = {f[0] for f in block.tile(texts, coverage)}
                return [[i in leaked for i in range(len(texts))]]

            return work

        docs = append_columns(docs, text, "_leaked boolean", make).where("NOT _leaked").select(*[F.col(f"`{c}`") for c in names])
    return docs
