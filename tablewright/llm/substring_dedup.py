"""Substring dedup by MinHash banding of paragraphs, and of small pieces for passages that stand anywhere.

A text is cut twice. Pieces are cut where the words say so: a piece starts at a word whose three-word hash is the
smallest within ``REACH`` words on both sides. A passage that repeats is then cut alike in every document, wherever
lines and sentences end. Paragraphs are lines; lines of under ``LINE_WORDS`` words that follow each other without a blank
line are one paragraph, and paragraphs of over ``MOST_WORDS`` words are cut like pieces, within ``PARAGRAPH_REACH`` words.

1. Pieces, and paragraphs of ``least_words`` words or more, are sets of five-word shingles (shorter ones are one
   shingle). Those of equal words are one class, by partial aggregation.
2. Classes are banded: ``tuned`` chooses bands and rows so that a pair at the threshold collides with the recall asked
   for. Paragraphs have bands of several rows, which keep those of one template apart; pieces are a few shingles, of
   which unrelated ones share none, and have bands of one row. Pieces too small to reach the threshold unless they are
   equal have none. In each bucket every class is first compared with the smallest and the largest one.
3. Colliding pairs are verified by exact Jaccard on their shingles. Buckets whose members are then still in several
   components are compared in blocks of about ``BLOCK`` members, each pair of blocks in a task of its own; only
   links that join two components leave a task. So every pair that shares a bucket ends in one component if it reaches
   the threshold, and a bucket of near copies is not expanded.
4. Of every paragraph cluster that several documents have, the first occurrence stays and the others are removed. Of every
   piece cluster the first occurrence outside removed paragraphs stays and the others are removed; so what an edited
   copy of a paragraph has of its own is not lost where it stands elsewhere. Only pieces in runs of ``least_words`` words
   or more of neighbouring such pieces count. Neighbouring marked words are a span; spans are split where removal
   changes, so a span of a long run may be short.

A passage of more than 50 words has several cuts inside, and its whole pieces make up 25 words or more in
nearly all cases; a shared run of under 25 words is never reported.

Null, empty and wordless texts have no paragraphs. Very long texts are cut whole, like others. Repeated rows of one id and
text are one document, and what only one id repeats is not reported; texts that share an id keep spans of their own, told
apart by ``text_hash``. Rows without an id are not looked at. Ties go to the smaller id, then to the smaller hash. Extra
columns are not looked at, and names that begin with an underscore are kept for the operator. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import explode_from, released_shuffles
from tablewright.llm.components import components
from tablewright.llm.words import PLACES, hash_words, mix, powers, shingles, slices
from tablewright.plans.lineage import cut, cut_seeing

REACH = 5
PARAGRAPH_REACH = 40
LINE_WORDS = 25
MOST_WORDS = 150
THRESHOLD = 0.8
RECALL = 0.95
LEAST_WORDS = 25
#: Hashes a paragraph at most: four rows a band keep paragraphs of one template apart.
MOST_HASHES = 24
PIECE_HASHES = 2
BLOCK = 500
BROADCAST_ROWS = 200_000
#: Sets times shared shingles up to which one product of matrices counts all intersections of a block (4 MB).
TABLE_CELLS = 1 << 20
#: Words of a sieve at most, as a power of two (32 MB); a fuller one lets more pass and loses nothing.
SIEVE_BITS = 22


def tuned(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 8) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, then the fewest bands, that reach ``recall`` at ``threshold``."""
    for rows in range(most_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches this recall")


def paragraphs(words: np.ndarray, row: np.ndarray, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last word of every piece, cut within ``reach`` words (``REACH``)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # words past the end of a text are 0: a text's cuts do not depend on its neighbour
    one, two = np.zeros_like(words), np.zeros_like(words)
    one[:-1] = np.where(row[1:] == row[:-1], words[1:], 0)
    two[:-2] = np.where(row[2:] == row[:-2], words[2:], 0)
    h = mix(words + one * PLACES[0] + two * PLACES[1])
    least = np.ones(len(h), bool)
    for k in range(1, min(REACH if reach is None else reach, len(h) - 1) + 1):
        apart = row[k:] != row[:-k]
        least[k:] &= apart | (h[k:] < h[:-k])
        least[:-k] &= apart | (h[:-k] <= h[k:])
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]] | least)
    return start, np.r_[start[1:], len(words)]


def content(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(texts: list[bytes | None], words: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First word of every paragraph; ``first`` is each word's first byte in its text."""
    length = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(length) - length
    feeds = np.cumsum(np.frombuffer(b" ".join([*[t or b"" for t in texts], b""]), np.uint8) == 10)
    passed = np.r_[0, np.diff(feeds[begins[row] + first])]
    other = np.r_[True, row[1:] != row[:-1]]
    line = np.flatnonzero(other | (passed > 0))
    long = np.diff(np.r_[line, len(words)]) >= LINE_WORDS
    start = line[other[line] | (passed[line] > 1) | long | np.r_[True, long[:-1]]]
    size = np.diff(np.r_[start, len(words)])
    inside = np.flatnonzero(np.repeat(size > MOST_WORDS, size))
    if not len(inside):
        return start
    more, _ = paragraphs(words[inside], np.repeat(np.arange(len(start)), size)[inside], PARAGRAPH_REACH)
    return np.union1d(start, inside[more])


def cut_texts(texts: list[bytes | None], pieces: bool = True, lines: bool = True):
    """Per slice: first row, words, row of each word, first word of each piece and of each paragraph (those asked for)."""
    for a, b in slices(texts):
        words, row, first, _ = hash_words(texts[a:b])
        if len(words):
            yield a, words, row, paragraphs(words, row)[0] if pieces else None, blocks(texts[a:b], words, row, first) if lines else None


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, on disk; few are broadcast, so that a bucket or cluster of very many is no key of a shuffle."""
    rows, many = cut_seeing(rows, F.count("*"))
    return F.broadcast(rows) if many <= BROADCAST_ROWS else rows


def sieve(rows: DataFrame, hashed: Column, many: int) -> Broadcast:
    """Bloom filter of the ``many`` hashes ``hashed`` of ``rows``: three bits of one word each, two to four hashes a word
    up to ``SIEVE_BITS``. Tasks drop by it what no join would keep, before it is shuffled; the join still decides."""
    words = 1 << min(max(many // 4, 1).bit_length(), SIEVE_BITS)
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(_hash, {by}) & 63 AS int))" for by in (58, 52, 46))
    marks = rows.select(hashed.alias("_hash")).select(F.expr(f"cast(_hash & {words - 1} AS int)").alias("_at"), F.expr(bits).alias("_bits"))
    held = marks.groupBy("_at").agg(F.bit_or("_bits").alias("_bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[held.column("_at").to_numpy()] = held.column("_bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` may be in the sieve ``words``."""
    bits = np.zeros(len(hashes), np.uint64)
    for by in (58, 52, 46):
        bits |= np.uint64(1) << (hashes >> np.uint64(by) & np.uint64(63))
    return words[(hashes & np.uint64(len(words) - 1)).view(np.int64)] & bits == bits


def numbered(own: np.ndarray) -> np.ndarray:
    """Number of each inside its row; ``own`` is the sorted row of each."""
    return np.arange(len(own)) - np.searchsorted(own, own)


def units(texts: list[bytes | None], least_words: int, pieces: bool, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
    """Per slice, of pieces or of paragraphs of ``least_words`` or more: row, content, distinct shingles and the piece or
    paragraph of each; only of those whose row and content are ``wanted``."""
    for a, words, row, small, large in cut_texts(texts, pieces, not pieces):
        start = small if pieces else large
        size = np.diff(np.r_[start, len(words)])
        taken = size >= (1 if pieces else least_words)
        own, hashed = row[start[taken]] + a, content(words, start[taken], (start + size)[taken])
        if wanted is not None:
            chosen = wanted(own, hashed)
            own, hashed = own[chosen], hashed[chosen]
            taken[taken] = chosen
        if len(own):
            yield own, hashed, *paragraph_shingles(words[np.repeat(taken, size)], size[taken])


def paragraph_shingles(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all paragraphs, and the paragraph of each, which rises."""
    found, at = shingles(words, np.repeat(np.arange(len(size)), size))
    # one sort of the paragraph and the upper bits of the shingle shows where a shingle may stand twice
    bits = np.uint64(max(1, len(size).bit_length()))
    both = np.sort((at.astype(np.uint64) << (np.uint64(64) - bits)) | (found >> bits))
    twice = (both[:-1][both[1:] == both[:-1]] >> (np.uint64(64) - bits)).astype(np.int64)
    if not len(twice):
        return found, at
    doubtful = np.zeros(len(size), bool)
    doubtful[twice] = True
    place = np.flatnonzero(doubtful[at])
    place = place[np.lexsort((found[place], at[place]))]
    new = np.ones(len(found), bool)
    new[place[1:]] = (found[place[1:]] != found[place[:-1]]) | (at[place[1:]] != at[place[:-1]])
    return found[new], at[new]


def band_keys(hashes: np.ndarray, at: np.ndarray, n: int, bands: int, rows: int) -> list[np.ndarray]:
    first = np.searchsorted(at, np.arange(n))
    keys = []
    for band in range(bands):
        key = np.full(n, (band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for r in range(rows):
            seed = np.uint64((band * rows + r + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
            key = mix(key + np.minimum.reduceat(mix(hashes ^ seed), first))
        keys.append(key)
    return keys


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def places(docs: DataFrame, text: str, key: str, least_words: int, marked: Broadcast) -> DataFrame:
    """Texts cut at the starts of pieces and of paragraphs: (key, _seq, _first, _words, _piece and _block: numbers,
    _content and _paragraph: contents of both; that of a short paragraph is one
    that no class has). Rows neither of whose contents passes the sieve ``marked`` are left out."""

    def make():
        words_marked = marked.value

        def work(texts):
            for a, words, row, start, block in cut_texts(texts):
                both = np.union1d(start, block)
                own = row[both]
                held = [numbered(own), both - np.searchsorted(row, own), np.diff(np.r_[both, len(words)])]
                contents, hit = [], np.zeros(len(both), bool)
                for of, least in ((start, 1), (block, least_words)):
                    at = np.searchsorted(of, both, "right") - 1
                    end = np.r_[of[1:], len(words)]
                    held.append(numbered(row[of])[at])
                    hashed = content(words, of, end)
                    hashed = np.where(end - of < least, mix(~hashed), hashed)
                    hit |= passes(words_marked, hashed)[at]
                    contents.append(signed(hashed)[at])
                yield own[hit] + a, *[h[hit] for h in (*held, *contents)]

        return work

    schema = "_seq int, _first int, _words int, _piece int, _block int, _content bigint, _paragraph bigint"
    return explode_from(docs, text, [key, "_text"], schema, make)


def classes_of(docs: DataFrame, text: str, key: str, banding: tuple[int, int], threshold: float, least_words: int, pieces: bool) -> DataFrame:
    """Classes of equal pieces or paragraphs: (_content, _holder: smallest id, _again: in several ids, _k0, _k1 ...: band
    keys, null where only an equal set is near)."""
    bands, rows = banding

    def make():
        def work(texts):
            for own, hashed, found, at in units(texts, least_words, pieces):
                size = np.bincount(at, minlength=len(own))
                # sets that differ reach no more than n / (n + 1)
                alone = size < threshold * (size + 1)
                keys = band_keys(found, at, len(own), bands, rows)
                yield own, signed(hashed), *[pa.array(signed(k), mask=alone) for k in keys]

        return work

    names = [f"_k{i}" for i in range(bands)]
    held = explode_from(docs, text, [key], "_content bigint, " + ", ".join(f"{n} bigint" for n in names), make)
    classes = held.groupBy("_content").agg(
        F.min(f"`{key}`").alias("_holder"), F.max(f"`{key}`").alias("_last"), *[F.max(n).alias(n) for n in names]
    )
    return classes.select("_content", "_holder", (F.col("_holder") < F.col("_last")).alias("_again"), *names)


def banded(classes: DataFrame, bands: int) -> DataFrame:
    rows = classes.where("_k0 IS NOT NULL")
    return rows.select("_content", "_holder", F.explode(F.array(*[f"_k{i}" for i in range(bands)])).alias("_bucket"))


def collisions(classes: DataFrame, bands: int) -> DataFrame:
    """Classes that share a bucket: (_bucket, _content, _holder, _least and _most: the bucket's ends, _members)."""
    rows = banded(classes, bands)
    ends = rows.groupBy("_bucket").agg(
        F.min("_content").alias("_least"), F.max("_content").alias("_most"), F.count("*").alias("_members")
    )
    ends, many = cut_seeing(ends.where("_least < _most"), F.count("*"))
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ends), "_bucket")
    shared, names = sieve(ends, F.col("_bucket"), many), rows.columns

    def run(batches):
        for batch in batches:
            for band in range(bands):
                bucket = batch.column(2 + band)
                hit = pa.array(passes(shared.value, bucket.to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([c.filter(hit) for c in (batch.column(0), batch.column(1), bucket)], names)

    held = classes.where("_k0 IS NOT NULL").select("_content", "_holder", *[f"_k{i}" for i in range(bands)])
    return held.mapInArrow(run, rows.schema).join(ends, "_bucket")


def shingle_sets(docs: DataFrame, text: str, key: str, wanted: DataFrame, many: int, least_words: int, pieces: bool) -> DataFrame:
    """(_content, _set) of the ``many`` classes ``wanted`` (_content, _holder), cut once more from the texts that hold them.
    A sieve picks them where they are cut, so neither texts nor other sets are shuffled."""
    picked = sieve(wanted, F.col("_content").bitwiseXOR(F.xxhash64("_holder")), many)

    def make():
        words = picked.value

        def work(texts, holder):
            mine = holder.to_numpy().view(np.uint64)
            for own, hashed, found, at in units(texts, least_words, pieces, lambda own, hashed: passes(words, hashed ^ mine[own])):
                bounds = np.searchsorted(at, np.arange(len(own) + 1)).astype(np.int32)
                yield own, signed(hashed), pa.ListArray.from_arrays(bounds, pa.array(signed(found)))

        return work

    held = docs.withColumn("_hash", F.xxhash64(F.col(f"`{key}`")))
    sets = explode_from(held, text, [key, "_hash"], "_content bigint, _set array<bigint>", make, ["_hash"]).drop("_hash")
    asked = wanted.select("_content", F.col("_holder").alias(key))
    sets = sets.join(F.broadcast(asked) if many <= BROADCAST_ROWS else asked, ["_content", key], "left_semi")
    # a text may hold a paragraph twice
    return sets.dropDuplicates(["_content"]).select("_content", "_set")


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach ``threshold``."""
    one = sets.select(F.col("_content").alias("a"), F.col("_set").alias("_a"))
    two = sets.select(F.col("_content").alias("b"), F.col("_set").alias("_b"))
    close = F.least(F.size("_a"), F.size("_b")) >= threshold * F.greatest(F.size("_a"), F.size("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    every = F.size("_a") + F.size("_b") - both
    return pairs.join(one, "a").join(two, "b").where(close).where(both >= threshold * every).select("a", "b")


def joining_links(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (root, root) between components of ``sets`` that reach the threshold and join what nothing has joined yet.
    Sets of different ``side`` are compared; if all are of one side, all are."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    found, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    # what one set has alone is in no intersection
    first = np.r_[True, found[1:] != found[:-1]]
    held = np.diff(np.r_[np.flatnonzero(first), len(found)])
    several = np.repeat(held > 1, held)
    found, owner = found[several], owner[several]
    number = np.cumsum(first[several]) - 1
    one_side = (side == side[0]).all()

    def shared_by_all() -> np.ndarray:
        table = np.zeros((len(sets), int((held > 1).sum())), np.float32)
        table[owner, number] = 1
        return table @ table.T

    def shared_with(i: int) -> np.ndarray:
        low, high = np.searchsorted(found, sets[i], "left"), np.searchsorted(found, sets[i], "right")
        many = high - low
        at = np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())
        return np.bincount(owner[at], minlength=len(sets))

    table = shared_by_all() if len(sets) * int((held > 1).sum()) <= TABLE_CELLS else None
    part, out = roots.copy(), []
    rows = range(len(sets) - 1)
    if table is not None:
        near = (table >= threshold * (size[:, None] + size - table)) & (roots[:, None] != roots)
        rows = np.flatnonzero(np.triu(near if one_side else near & (side[:, None] != side), 1).any(1))
    for i in rows:
        open_to = part != part[i]
        if not one_side:
            open_to &= side != side[i]
        open_to[: i + 1] = False
        if not open_to.any():
            continue
        if table is not None:
            close = near[i]
        else:
            both = shared_with(i)
            close = both >= threshold * (size + len(sets[i]) - both)
        for j in np.flatnonzero(close & open_to):
            if part[j] != part[i]:
                out.append((int(roots[i]), int(roots[j])))
                part[part == part[j]] = part[i]
    return out


def links_inside(met: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that buckets still hold once ``links`` are known. Up to three members are all ends or meet both."""
    roots = components(links).select(F.col("node").alias("_content"), "root")
    rooted = met.where("_members > 3").select("_bucket", "_content", "_members").join(spread(roots), "_content", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "_content")))
    mixed = rooted.groupBy("_bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("_bucket")
    blocks = F.ceil(F.col("_members") / BLOCK).cast("int")
    left = rooted.join(spread(mixed), "_bucket", "left_semi").withColumn("_side", F.pmod(F.xxhash64("_content"), blocks).cast("int"))
    left = left.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.join(sets, "_content").select(
        "_bucket", F.least("_side", "_other").alias("_low"), F.greatest("_side", "_other").alias("_high"), "_side", "root", "_set"
    )

    def compare(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        """The groups between ``ends``."""
        held = table.column("_set").combine_chunks()
        at, found = held.offsets.to_numpy(), held.values.to_numpy()
        sets = [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        roots, side = table.column("root").to_numpy(), table.column("_side").to_numpy()
        made = [x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in joining_links(sets[a:b], roots[a:b], side[a:b], threshold)]
        made = np.array(made, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    def run(batches):
        """Groups are neighbours; the last one of a batch may go on in the next."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = [table.column(k).to_numpy() for k in ("_bucket", "_low", "_high")]
            ends = np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1]
            if len(ends) > 1:
                yield compare(table, ends)
            rest = table.slice(ends[-1])
        if rest is not None:
            yield compare(rest, np.array([0, rest.num_rows]))

    group = ["_bucket", "_low", "_high"]
    return left.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def colliding(
    rows: DataFrame, text: str, key: str, classes: DataFrame, bands: int, least_words: int, pieces: bool
) -> tuple[DataFrame, DataFrame]:
    """Classes that share a bucket, and their sets."""
    met = cut(collisions(classes, bands))
    wanted, many = cut_seeing(met.select("_content", "_holder").distinct(), F.count("*"))
    return met, cut(shingle_sets(rows, text, key, wanted, many, least_words, pieces))


def near_links(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of classes that share a bucket, as many as their components need."""
    other = F.explode(F.array("_least", "_most")).alias("_o")
    pairs = met.select("_content", other).where("_content <> _o")
    pairs = pairs.select(F.least("_content", "_o").alias("a"), F.greatest("_content", "_o").alias("b")).distinct()
    links = cut(verified_links(pairs, sets, threshold))
    return links.union(cut(links_inside(met, sets, links, threshold)))


def repeated_spans(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(key, text_hash, first_word, n_words, component_id, first_doc, removed) of every repeated span, all of it removed
    or none.

    ``component_id`` and ``first_doc`` are those of the span's first paragraph or piece: its cluster, and the id whose
    occurrence stays. ``text_hash`` is xxhash64 of the text, for ids with several texts.
    """
    body = F.col(f"`{text}`")
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`"), F.xxhash64(body).alias("_text"), body.alias("_body"))
    with released_shuffles(docs.sparkSession):
        again, met, sets = [], [], []
        for pieces, most in ((True, PIECE_HASHES), (False, MOST_HASHES)):
            banding = tuned(threshold, recall, most)
            classes = cut(classes_of(rows, "_body", key, banding, threshold, least_words, pieces))
            again.append(cut(classes.where("_again").select("_content")))
            for held, made in zip((met, sets), colliding(rows, "_body", key, classes, banding[0], least_words, pieces), strict=True):
                held.append(made)
        # a paragraph that is one piece as a whole has one set
        links = near_links(met[0].union(met[1]), cut(sets[0].union(sets[1]).dropDuplicates(["_content"])), threshold)
        clusters = components(links).select(F.col("node").alias("_content"), F.col("root").alias("_cluster"))
        again = again[0].union(again[1]).distinct()
        marked = again.join(clusters, "_content", "full_outer").select("_content", F.coalesce("_cluster", "_content").alias("_cluster"))
        marked, many = cut_seeing(marked, F.count("*"))
        alike = sieve(marked, F.col("_content"), many)
        marked = F.broadcast(marked) if many <= BROADCAST_ROWS else marked
        named = marked.select(F.col("_content").alias("_paragraph"), F.col("_cluster").alias("_alike"))
        seen = places(rows, "_body", key, least_words, alike).join(named, "_paragraph", "left").join(marked, "_content", "left")
        seen = cut(seen.where("_alike IS NOT NULL OR _cluster IS NOT NULL").drop("_paragraph", "_content").distinct())
        own = F.col(f"`{key}`")
        block, piece = (F.struct(own.alias("_id"), "_text", c) for c in ("_block", "_piece"))
        near = seen.where("_alike IS NOT NULL").groupBy("_alike").agg(F.min(block).alias("_near"), F.max(own).alias("_last"))
        near = spread(near.where("_near._id < _last").drop("_last"))
        several = seen.where("_cluster IS NOT NULL").groupBy("_cluster").agg(F.min(own).alias("_one"), F.max(own).alias("_two"))
        several = spread(several.where("_one < _two").select("_cluster", F.lit(True).alias("_twice")))
        # rows of no cluster meet nothing, and not all in one task
        apart = F.xxhash64(own, "_text", "_seq")
        placed = seen.withColumns({"_alike": F.coalesce("_alike", apart), "_cluster": F.coalesce("_cluster", apart)})
        placed = placed.join(near, "_alike", "left").join(several, "_cluster", "left")
        later = F.col("_near").isNotNull() & (F.col("_near") != block)
        placed = placed.withColumns({"_later": later, "_twice": F.coalesce("_twice", F.lit(False))})
        # all windows are inside a text, so it is dealt out once for them
        placed = placed.repartition(key, "_text")

        def run(*same: str):
            return F.col("_seq") - F.row_number().over(Window.partitionBy(key, "_text", *same).orderBy("_seq"))

        # runs of pieces are judged whole, whatever becomes of their parts
        placed = placed.withColumn("_run", run("_twice"))
        run_words = F.sum("_words").over(Window.partitionBy(key, "_text", "_twice", "_run"))
        placed = placed.withColumn("_twice", F.col("_twice") & (run_words >= least_words)).where("_near IS NOT NULL OR _twice")
        # a piece that is in part inside a removed paragraph is no first occurrence
        placed = cut(placed.withColumn("_torn", F.max("_later").over(Window.partitionBy(key, "_text", "_piece"))))
        whole = placed.where("_twice AND NOT _torn")
        exact = spread(whole.groupBy("_cluster").agg(F.min(piece).alias("_exact")))
    placed = placed.join(exact, "_cluster", "left").repartition(key, "_text")
    again = F.coalesce(F.col("_twice") & (F.col("_exact") != piece), F.lit(False))
    placed = placed.withColumns(
        {
            "_stays": ~(F.col("_later") | again),
            "_by": F.when(F.col("_later") | (F.col("_near").isNotNull() & ~again), F.col("_alike")).otherwise(F.col("_cluster")),
            "_where": F.when(F.col("_later"), F.col("_near._id")).when(again, F.col("_exact._id")).otherwise(own),
        }
    )
    # what is left of a first paragraph that loses pieces is no repetition
    pierced = F.max(again).over(Window.partitionBy(key, "_text", "_block"))
    placed = placed.withColumn("_pierced", pierced).where("_twice OR NOT _stays OR NOT _pierced")
    spans = placed.withColumn("_part", run("_stays")).groupBy(key, F.col("_text").alias("text_hash"), "_stays", "_part").agg(
        F.min("_first").alias("first_word"),
        F.sum("_words").cast("long").alias("n_words"),
        F.min_by("_by", "_seq").alias("component_id"),
        F.min_by("_where", "_seq").alias("first_doc"),
    )
    return spans.select(key, "text_hash", "first_word", "n_words", "component_id", "first_doc", (~F.col("_stays")).alias("removed"))


def without_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents whose text lacks the words of removed spans and the white space after each; other texts are untouched."""
    gone = spans.where("removed").groupBy(F.col(key), F.col("text_hash").alias("_text")).agg(
        F.array_sort(F.flatten(F.collect_list(F.sequence(F.col("first_word").cast("long"), F.col("first_word") + F.col("n_words") - 1)))).alias("_gone")
    )
    body = F.col(f"`{text}`")
    joined = docs.withColumn("_text", F.xxhash64(body)).join(gone, [key, "_text"], "left")
    lead = F.regexp_extract(body, r"^[\x20\x09-\x0D]*", 0)
    words = F.split(F.substr(body, F.length(lead) + 1), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    all_at = F.sequence(F.lit(0).cast("long"), F.size(words).cast("long") - 1)
    kept = F.transform(F.array_sort(F.array_except(all_at, "_gone")), lambda i: F.get(words, i.cast("int")))
    cleaned = F.when(F.col("_gone").isNull(), body).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.withColumn(text, cleaned).select(*docs.columns)
