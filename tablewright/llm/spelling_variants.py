"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One edit changes the letter counts of a word by at most two in all, so near words lie within L1 distance 2 (equal
lengths) or 1 (lengths that differ by one). Counts are held as unary bits, up to ``ASCII_BITS`` of each a-z and
``LATIN_BITS`` of each other letter; a distance of bits is never above the distance of counts, so nothing near is pruned.

1. Words and their occurrences are counted with partial sums; words are dealt to one class per length.
2. A class of more than ``CELL_WORDS`` words is cut into cells by the top of a k-d tree, whose splits come from a sample
   that grows with the vocabulary (``SAMPLE_A_CELL`` words for each cell). Every word goes to its own cell, and as a
   query to the cells of its own class and of the next whose boxes it may reach. Cells and their queries are cut
   into parts of bounded letters; each part of a cell meets each part of its queries.
3. In a task a k-d tree is built over the distinct vectors; queries walk it together and leave every box that is too far.
   What is within reach is verified letter by letter. Two large sets of anagrams are not compared pair by pair:
   their words meet under hashes of all letters but one.
4. The nearest frequent form of a word is an aggregate, its root the end of the chain of forms, by pointer doubling.

Null texts and texts without a letter have no words; a null id stands as an empty one in the typo rule. Texts that are not
UTF-8 are read with U+FFFD for the bad bytes. Very long texts are cut into runs as a whole, and runs of any length
are words. Repeated rows count again. Ties between forms go to the smaller word in code-point order. Other columns, whatever
their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import flatten, sided
from tablewright.llm.words import mix
from tablewright.plans.lineage import cut

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
TYPO_EVERY = 31
#: All longer words share one class.
LONGEST = 64
CELL_WORDS = 50_000
CELL_LETTERS = 4_000_000
SAMPLE_A_CELL = 64
ASCII_BITS, LATIN_BITS = 4, 2
LEAF = 24
QUERIES_AT_ONCE = 4_096
#: Letters compared at once, and word pairs above which two sets of anagrams meet by hashes.
COMPARED = 1 << 22
MANY_PAIRS = 1 << 14

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "word string, n_near bigint, form_n bigint, form string"


def word_counts(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, typo_every: int | None = TYPO_EVERY,
) -> DataFrame:
    """(word, n) of the letter runs of all texts. Of every ``typo_every``-th run, by a hash of id and run, one letter
    is dropped; None keeps all runs as they are."""
    # what is shorter cannot become a word
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"[A-Za-zÀ-ÿ]{%d,}+" % least_letters), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_raw"))
    rows = rows.select("_id", F.translate("_raw", UPPER, LOWER).alias("word"))
    if typo_every:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        rows = rows.withColumn("_h", h)
        at = (F.col("_h") % F.length("word")).cast("int")
        dropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.withColumn("word", F.when(F.col("_h") % typo_every == 0, dropped).otherwise(F.col("word")))
        rows = rows.where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# vectors


class Words:
    """Words as bytes (every letter is below 256), sorted, with their vectors."""

    def __init__(self, words: Sequence[str]) -> None:
        raw = [w.encode("latin-1") for w in words]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.length) - self.length
        self.vectors = unary(self.bytes, self.length)

    def letters(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.bytes[self.start[at][:, None] + np.arange(length)]


def unary(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Letter counts of all words as (words, 4) of 64 bits: a-z, then the two halves of the Latin letters."""
    kind = np.zeros(256, np.int64)
    kind[97:123] = np.arange(26)
    kind[0xE0:] = np.arange(26, 58)
    kind[0xC0:0xE0] = np.arange(58, 90)
    out = np.zeros((len(length), 32), np.uint8)
    step = 1 << 15
    ends = np.cumsum(length)
    for a in range(0, len(length), step):
        b = min(a + step, len(length))
        part = letters[ends[a] - length[a] : ends[b - 1]]
        owner = np.repeat(np.arange(b - a), length[a:b])
        counts = np.bincount(owner * 90 + kind[part], minlength=(b - a) * 90).reshape(b - a, 90)
        low = (counts[:, :26, None] > np.arange(ASCII_BITS)).reshape(b - a, -1)
        high = (counts[:, 26:, None] > np.arange(LATIN_BITS)).reshape(b - a, -1)
        gap = np.zeros((b - a, 128 - low.shape[1]), bool)
        out[a:b] = np.packbits(np.concatenate([low, gap, high], 1), axis=1)
    return out.view(np.uint64)


def bits(vectors: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(vectors).view(np.uint8), axis=1)


def middle_split(inside: np.ndarray) -> int:
    """The bit that cuts these vectors most evenly; -1 if none cuts them."""
    n = len(inside)
    ones = inside.sum(0, dtype=np.int64)
    best = int(np.argmin(np.abs(2 * ones - n)))
    return best if 0 < ones[best] < n else -1


class Tree:
    """K-d tree over distinct vectors; a box is the bits that all and that some of its vectors have."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        flat = bits(vectors)
        lo, hi, children, spans = [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = len(spans)
            if parent >= 0:
                children[parent][side] = here
            at = self.order[a:b]
            lo.append(np.bitwise_and.reduce(vectors[at], axis=0))
            hi.append(np.bitwise_or.reduce(vectors[at], axis=0))
            children.append([-1, -1])
            spans.append((a, b))
            if b - a > leaf:
                inside = flat[at]
                bit = middle_split(inside)
                if bit >= 0:
                    one = inside[:, bit] == 1
                    self.order[a:b] = np.concatenate([at[~one], at[one]])
                    middle = b - int(one.sum())
                    todo += [(a, middle, here, 0), (middle, b, here, 1)]
        self.lo, self.hi = np.array(lo).T.copy(), np.array(hi).T.copy()
        self.child = np.array(children).T.copy()
        self.span = np.array(spans)
        self.vectors = vectors[self.order].T.copy()

    def within(self, vectors: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of all that are at most ``radius`` bits apart."""
        queries, found = [], []
        for a in range(0, len(vectors), QUERIES_AT_ONCE):
            q, r = vectors[a : a + QUERIES_AT_ONCE].T.copy(), radius[a : a + QUERIES_AT_ONCE]
            used = [k for k in range(4) if q[k].any() or self.hi[k].any()]
            at, node = np.arange(len(r)), np.zeros(len(r), np.int64)
            while len(at):
                away = np.zeros(len(at), np.uint8)
                for k in used:
                    own = q[k][at]
                    away += np.bitwise_count(own & ~self.hi[k][node]) + np.bitwise_count(self.lo[k][node] & ~own)
                stay = away <= r[at]
                at, node = at[stay], node[stay]
                leaf = self.child[0][node] < 0
                if leaf.any():
                    first, past = self.span[node[leaf]].T
                    size = past - first
                    who = np.repeat(at[leaf], size)
                    member = np.arange(len(who)) - np.repeat(np.cumsum(size) - size - first, size)
                    apart = np.zeros(len(who), np.uint8)
                    for k in used:
                        apart += np.bitwise_count(q[k][who] ^ self.vectors[k][member])
                    hit = apart <= r[who]
                    queries.append(who[hit] + a)
                    found.append(self.order[member[hit]])
                    at, node = at[~leaf], node[~leaf]
                at, node = np.concatenate([at, at]), np.concatenate([self.child[0][node], self.child[1][node]])
        if not queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(queries), np.concatenate(found)


# letter order


def one_edit(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are exactly one edit apart: equal lengths or a right word one letter longer."""
    out = np.zeros(len(i), bool)
    size, more = left.length[i], right.length[j] - left.length[i]
    kind = np.where((more == 0) | (more == 1), 2 * size + more, -1)
    for length, longer in (divmod(k, 2) for k in np.unique(kind[kind >= 0]).tolist()):
        at = np.flatnonzero(kind == 2 * length + longer)
        step = max(1, COMPARED // length)
        for a in range(0, len(at), step):
            part = at[a : a + step]
            u, v = left.letters(i[part], length), right.letters(j[part], length + longer)
            if longer:
                head = np.cumprod(u == v[:, :-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
                tail = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
                out[part] = head + tail >= length
            else:
                out[part] = (u != v).sum(1) == 1
    return out


def meeting(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two sets of words of one length each whose letters agree in all places but one, by hash."""
    length, longer = int(left.length[i[0]]), int(right.length[j[0]] - left.length[i[0]])
    power = np.multiply.accumulate(np.full(length + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    u, v = (left.letters(i, length) + np.uint64(1), right.letters(j, length + longer) + np.uint64(1))
    if longer:
        before = np.zeros((len(j), length + 1), np.uint64)
        np.cumsum(v[:, :-1] * power[:length], axis=1, out=before[:, 1:])
        after = np.zeros((len(j), length + 1), np.uint64)
        after[:, :-1] = np.cumsum((v[:, 1:] * power[:length])[:, ::-1], axis=1)[:, ::-1]
        a, b = (u * power[:length]).sum(1, dtype=np.uint64), (before + after).ravel()
        a_of, b_of = i, np.repeat(j, length + 1)
    else:
        place = mix(np.arange(length, dtype=np.uint64) + np.uint64(1))
        a, b = (((x * power[:length]).sum(1, dtype=np.uint64)[:, None] - x * power[:length]) ^ place for x in (u, v))
        a, b = a.ravel(), b.ravel()
        a_of, b_of = np.repeat(i, length), np.repeat(j, length)
    order = np.argsort(b, kind="stable")
    b, b_of = b[order], b_of[order]
    first, past = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    size = past - first
    who = np.repeat(np.arange(len(a)), size)
    member = np.arange(len(who)) - np.repeat(np.cumsum(size) - size - first, size)
    pairs = np.unique(np.stack([a_of[who], b_of[member]]), axis=1)
    return pairs[0], pairs[1]


def near_pairs(queries: Words, held: Words, same_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, held) of all pairs one edit apart in which the query is not the longer one."""
    if not len(queries.length) or not len(held.length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # words of one length and vector are one point
    points, sets = [], []
    for w in (queries, held):
        order = np.lexsort((w.length, *w.vectors.T))
        rows = np.column_stack([w.vectors[order], w.length[order].astype(np.uint64)])
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
        points.append(order[first])
        sets.append((order, first, np.diff(np.r_[first, len(order)])))
    tree = Tree(held.vectors[points[1]])
    radius = np.where(same_class[points[0]], 2, 1).astype(np.uint8)
    p, t = tree.within(queries.vectors[points[0]], radius)
    more = held.length[points[1][t]] - queries.length[points[0][p]]
    near = (more == 0) | (more == 1)
    p, t = p[near], t[near]
    (q_order, q_first, q_size), (h_order, h_first, h_size) = sets
    n = q_size[p] * h_size[t]
    many = n > np.maximum(MANY_PAIRS, 8 * queries.length[points[0][p]] * (q_size[p] + h_size[t]))
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        good = one_edit(queries, held, i, j)
        left.append(i[good])
        right.append(j[good])

    for x, y in zip(p[many].tolist(), t[many].tolist(), strict=True):
        i, j = q_order[q_first[x] :][: q_size[x]], h_order[h_first[y] :][: h_size[y]]
        step = max(1, COMPARED // int(held.length[j[0]]))
        for a in range(0, len(i), step):
            for b in range(0, len(j), step):
                keep(*meeting(queries, held, i[a : a + step], j[b : b + step]))
    p, t, n = p[~many], t[~many], n[~many]
    bound = np.cumsum(n)
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(bound, (bound[a - 1] if a else 0) + COMPARED, "right")))
        pair = np.repeat(np.arange(a, b), n[a:b])
        number = np.arange(len(pair)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        wide = h_size[t[pair]]
        keep(q_order[q_first[p[pair]] + number // wide], h_order[h_first[t[pair]] + number % wide])
        a = b
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


# cells


def length_class(word: Column) -> Column:
    return F.least(F.length(word), F.lit(LONGEST))


class Cells:
    """The top of the k-d trees of all classes: the bits a cell's path asks for and forbids."""

    def __init__(self, sample: Sequence[str], sizes: dict[int, int], cell_words: int) -> None:
        self.first: dict[int, int] = {}
        number, lo, hi, of = [], [], [], []
        by_class: dict[int, list[str]] = {}
        for w in sample:
            by_class.setdefault(min(len(w), LONGEST), []).append(w)
        for c in sorted(sizes):
            vectors = Words(by_class.get(c, [])).vectors
            flat = bits(vectors)
            depth = max(0, math.ceil(math.log2(max(1, sizes[c] / cell_words))))
            none, every = np.zeros(256, np.uint8), np.ones(256, np.uint8)
            todo = [(np.arange(len(vectors)), none, every, depth)]
            while todo:
                at, low, high, deeper = todo.pop()
                bit = middle_split(flat[at]) if deeper and len(at) > 1 else -1
                if bit < 0:
                    number.append(len(number))
                    of.append(c)
                    lo.append(np.packbits(low).view(np.uint64))
                    hi.append(np.packbits(high).view(np.uint64))
                    continue
                one = flat[at, bit] == 1
                with_bit, without = low.copy(), high.copy()
                with_bit[bit], without[bit] = 1, 0
                todo += [(at[~one], low, without, deeper - 1), (at[one], with_bit, high, deeper - 1)]
        self.of = np.array(of, np.int64)
        self.lo, self.hi = np.array(lo, np.uint64).reshape(-1, 4), np.array(hi, np.uint64).reshape(-1, 4)

    def reached(self, vectors: np.ndarray, cls: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell) of the cells of a class that lie within ``radius``."""
        words, cells = [], []
        for cell in np.flatnonzero(self.of == cls):
            away = np.bitwise_count(vectors & ~self.hi[cell]).sum(1) + np.bitwise_count(self.lo[cell] & ~vectors).sum(1)
            hit = np.flatnonzero(away <= radius)
            words.append(hit)
            cells.append(np.full(len(hit), cell))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(words), np.concatenate(cells)


def routed(words: DataFrame, cells: Cells) -> DataFrame:
    """(cell, role, word, n): role 0 in the own cell, 1 as a query of the own class, 2 as one of the next class."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            held = Words(texts)
            cls = np.minimum(held.length, LONGEST)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                roles = [(0, int(c), 0), (1, int(c), 2)] + ([(2, int(c) + 1, 1)] if c < LONGEST else [])
                for role, target, radius in roles:
                    at, cell = cells.reached(held.vectors[own], target, radius)
                    rows = batch.take(pa.array(own[at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int64()), pa.array(np.full(len(at), role), pa.int32()), rows.column(0), rows.column(1)],
                        ["cell", "role", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "cell bigint, role int, word string, n bigint")


def parted(rows: DataFrame, cell_words: int, cell_letters: int) -> DataFrame:
    """Each part of a cell beside each part of its queries: ``cell, _h, _q`` name the meeting."""
    held = F.col("role") == 0
    count = [F.sum(F.when(k, 1).otherwise(0)) for k in (held, ~held)]
    letters = [F.sum(F.when(k, F.length("word")).otherwise(0)) for k in (held, ~held)]
    parts = [
        F.greatest(F.lit(1), F.ceil(c / cell_words), F.ceil(m / cell_letters)).cast("int") for c, m in zip(count, letters, strict=True)
    ]
    sizes = sided(cut(rows.groupBy("cell").agg(parts[0].alias("_h"), parts[1].alias("_q"))))
    met = rows.join(sizes, "cell")
    own = F.pmod(F.xxhash64("word"), F.when(held, F.col("_h")).otherwise(F.col("_q"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(held, F.col("_q")).otherwise(F.col("_h")) - 1))
    met = met.withColumn("_own", own).withColumn("_other", others)
    own, other = F.col("_own"), F.col("_other")
    return met.select("cell", F.when(held, own).otherwise(other).alias("_h"), F.when(held, other).otherwise(own).alias("_q"), "role", "word", "n")


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, cell_letters: int = CELL_LETTERS) -> DataFrame:
    """(word, n_near, form_n, form) of every word with a near one: how many, and the largest n among them.

    ``words`` (word, n) is on disk.
    """
    cls = length_class(F.col("word"))
    sizes = {r[0]: r[1] for r in words.groupBy(cls.alias("c")).count().collect()}  # at most LONGEST rows
    large = [c for c, n in sizes.items() if n > cell_words]
    sample = []
    if large:
        every = max(1, cell_words // SAMPLE_A_CELL)
        chosen = words.where(cls.isin(large) & (F.pmod(F.xxhash64("word", F.lit(1)), F.lit(every)) == 0))
        sample = sorted(r[0] for r in chosen.select("word").collect())
    meetings = parted(routed(words, Cells(sample, sizes, cell_words)), cell_words, cell_letters)

    def search(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        sides = [group.filter(pa.array(m)).sort_by("word") for m in (role > 0, role == 0)]
        texts = [s.column("word").to_pylist() for s in sides]
        counts = [s.column("n").to_numpy() for s in sides]
        queries, held = (Words(t) for t in texts)
        q, h = near_pairs(queries, held, sides[0].column("role").to_numpy() == 1)
        # a pair of one class meets from both sides, unless one word is longer
        longer = held.length[h] != queries.length[q]
        out = []
        for mine, other, own, near in ((q, h, 0, 1), (h[longer], q[longer], 1, 0)):
            order = np.lexsort((other, -counts[near][other], mine))
            mine, other = mine[order], other[order]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
            out.append(pa.table({
                "word": sides[own].column("word").take(pa.array(mine[first])), "n_near": np.diff(np.r_[first, len(mine)]).astype(np.int64),
                "form_n": counts[near][other[first]].astype(np.int64), "form": sides[near].column("word").take(pa.array(other[first])),
            }))
        return pa.concat_tables(out)

    part = meetings.groupBy("cell", "_h", "_q").applyInArrow(search, RESULT)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", (-F.col("_b.m")).alias("form_n"), F.col("_b.form").alias("form")
    )


def variants(words: DataFrame, factor: int = FORM_FACTOR, cell_words: int = CELL_WORDS, cell_letters: int = CELL_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    words = cut(words)
    near = near_words(words, cell_words, cell_letters)
    frequent = F.col("form_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").withColumn("form", F.when(frequent, F.col("form")))
    joined = cut(joined.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("form_n")).alias("form_n")))
    follows = joined.where("form IS NOT NULL")
    ends = flatten(cut(follows.select(F.col("word").alias("node"), F.col("form").alias("parent"))))
    out = joined.join(ends.withColumnRenamed("node", "word"), "word", "left")
    return out.select("word", "form", F.coalesce("parent", "word").alias("root"), "n", "n_near", "form_n")
