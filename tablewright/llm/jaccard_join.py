"""N-gram Jaccard join by T-occurrence search.

A document is its set of distinct five-word shingles (64-bit hashes). Two link when
``100 * intersection >= 80 * union``. The work is exact at every step; hashes only stand for shingles.

1. Documents of equal sets are one class. Only classes go on, so copies cost one row each.
2. A class keeps those of its smallest hashes that any partner must share some of; classes whose share with
   anything is too small have no partner. What is left is fetched whole, shingles of one class dropped.
3. Shingles are ordered by how many classes have them. Classes are cut into blocks of bounded size, near
   copies side by side; a class is sent to a block when a shingle of its prefix is in the prefix of one there.
4. A block is an inverted index. A query needs T occurrences of an indexed class in its lists: the L longest are
   put aside (DivideSkip), occurrences in the others are counted, and what occurs T - L times in them is probed in the
   long lists by binary search. Queries of one block are spread over tasks that each hold the block; rows of a block arrive
   index first, so a task holds one block and one query.
5. A task passes on only links that join what it has not joined yet, so a group of copies gives links in
   proportion to its size. Components of these links are those of all links.

Null, empty and wordless texts have empty sets, link with nothing and are their own component. Repeated rows
and equal texts are one class. Rows without an id take part; a component of only such rows has a null id. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns, explode_from, null_safe, released_shuffles, running
from tablewright.llm.components import components, sided
from tablewright.llm.words import hash_words, mix, shingles, slices, sorted_sets
from tablewright.plans.attach import attach_group_stats, has_at_most
from tablewright.plans.lineage import cut

WORDS = 5
BLOCK_SHINGLES = 400_000
QUERIES_PER_TASK = 256
BROADCAST_CLASSES = 1_000_000
#: One in so many shingles is kept beyond the necessary ones; more of them tell apart more classes without a partner.
SPARE = 10
#: DivideSkip's weight: T / (MU * log2(longest list) + 1) lists are put aside. Counting is cheap beside probes, so few are.
MU = 1


def least_overlap(n: int) -> int:
    """Fewest shingles a set of ``n`` shares with any partner: 0.8 n, rounded up."""
    return -(-4 * n // 5)


def least_overlap_as_smaller(n: int) -> int:
    """The same when the partner is not smaller: 8/9 n, rounded up."""
    return -(-8 * n // 9)


def spare(n: int) -> int:
    """Shingles kept beyond those a partner may lack."""
    return max(1, n // SPARE)


def sets_of(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for a, b in slices(texts):
        words, rows, _, _ = hash_words(texts[a:b])
        yield from sorted_sets(*shingles(words, rows, WORDS), b - a)


def fingerprint(s: np.ndarray) -> int:
    return int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(s) else 0


def with_sets(docs: DataFrame, text: str, size: str = "n_shingles") -> DataFrame:
    """The set's size and ``_class``: equal for equal sets."""

    def make():
        def work(texts):
            made = [(len(s), fingerprint(s)) for s in sets_of(texts)]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    return append_columns(docs, text, f"{size} bigint, _class bigint", make)


def smallest_hashes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, _class, _n, _first): the hashes by which classes without a partner are told."""

    def make():
        def work(texts):
            rows = [(i, s) for i, s in enumerate(sets_of(texts)) if len(s)]
            first = [s[: len(s) - least_overlap(len(s)) + spare(len(s))] for _, s in rows]
            yield (
                [i for i, _ in rows],
                [fingerprint(s) for _, s in rows],
                [len(s) for _, s in rows],
                lists(first),
            )

        return work

    return explode_from(docs, text, [key], "_class bigint, _n int, _first array<bigint>", make)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32), pa.array(flat))


def shared_only(tokens: DataFrame) -> DataFrame:
    """Rows of tokens that several classes have, with ``_df``. Counted by partial sums, joined by a join Spark may split."""
    counts = tokens.groupBy("_token").agg(F.count("*").alias("_df")).where("_df > 1")
    return tokens.join(counts, "_token")


def candidates(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All classes (_class, _rep, _copies) and the shingles of those that may have a partner
    (_class, _n, _shingles: array of (count, hash), rarest first, unshared ones left out)."""
    first = smallest_hashes(docs, text, key)
    classes = cut(
        first.groupBy("_class").agg(
            F.min(f"`{key}`").alias("_rep"), F.count("*").alias("_copies"), F.first("_n").alias("_n"), F.first("_first").alias("_first")
        )
    )
    tokens = classes.select("_class", F.explode("_first").alias("_token"))
    least = F.ceil(F.col("_n") * 4 / 5)
    need = F.greatest(F.lit(1), F.floor(least / SPARE))
    maybe = (
        shared_only(tokens).groupBy("_class").agg(F.count("*").alias("_shared"))
        .join(classes.select("_class", "_rep", "_n"), "_class").where(F.col("_shared") >= need).select("_class", "_rep")
    )
    maybe = cut(maybe)
    side = F.broadcast(maybe) if has_at_most(maybe, BROADCAST_CLASSES) else maybe
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_body"))
    rows = rows.join(side, F.col("_id").eqNullSafe(F.col("_rep"))).select("_class", "_body")

    def make():
        def work(texts):
            sets = list(sets_of(texts))
            yield range(len(sets)), [fingerprint(s) for s in sets], [len(s) for s in sets], lists(sets)

        return work

    # an id may stand for several texts; only the one of the class counts
    whole = explode_from(rows, "_body", ["_class"], "_own bigint, _n int, _all array<bigint>", make).where("_own = _class")
    shared = shared_only(whole.select("_class", "_n", F.explode("_all").alias("_token")))
    kept = shared.groupBy("_class", "_n").agg(F.sort_array(F.collect_set(F.struct("_df", "_token"))).alias("_shingles"))
    kept = kept.where(F.size("_shingles") >= F.ceil(F.col("_n") * 4 / 5))
    return classes.select("_class", "_rep", "_copies"), cut(kept)


class Block:
    """Inverted index of some classes, numbered by size."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        rows.sort(key=lambda r: (r[1], r[0]))
        self.ids = [r[0] for r in rows]
        self.order = np.array(self.ids, np.int64)
        self.size = np.array([r[1] for r in rows], np.int64)
        token, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        self.n = len(rows)
        self.token = token
        #: (list, member) pairs in order: every list is sorted and can be probed
        self.pairs = np.sort(at * self.n + doc)
        self.member = self.pairs % self.n
        self.start = np.searchsorted(self.pairs, np.arange(len(token) + 1) * self.n)
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b

    def search(self, own: int, n: int, shingle: np.ndarray) -> list[int]:
        """Links of a query to smaller or equal classes of the block that join components."""
        at = np.minimum(np.searchsorted(self.token, shingle), len(self.token) - 1)
        which = at[self.token[at] == shingle]
        least = least_overlap(n)
        if len(which) < least:
            return []
        low, high = np.searchsorted(self.size, least), np.searchsorted(self.size, n, "right")
        if low >= high:
            return []
        begin = np.searchsorted(self.pairs, which * self.n + low)
        end = np.searchsorted(self.pairs, which * self.n + high)
        length = end - begin
        some = length > 0
        which, begin, end, length = which[some], begin[some], end[some], length[some]
        if len(which) < least:
            return []
        order = np.argsort(length, kind="stable")
        aside = min(least - 1, int(least / (MU * math.log2(int(length.max()) + 1) + 1)))
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        links = []
        # occurrences of every member in the short lists
        many = length[short]
        at = np.repeat(begin[short] - np.cumsum(many) + many, many) + np.arange(many.sum())
        times = np.bincount(self.member[at] - low, minlength=high - low)
        found = np.flatnonzero(times >= least - aside)
        smaller = (self.size[low + found] < n) | (self.order[low + found] < own)
        found = found[smaller]
        lists_aside = which[long] * self.n
        for x, count in zip((low + found).tolist(), times[found].tolist(), strict=True):
            if self.find(self.ids[x]) == self.find(own):
                continue
            probe = lists_aside + x
            hit = np.searchsorted(self.pairs, probe)
            both = count + int((self.pairs[np.minimum(hit, len(self.pairs) - 1)] == probe).sum())
            if 9 * both >= 4 * (n + int(self.size[x])) and self.join(own, self.ids[x]):
                links.append(self.ids[x])
        return links


def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_block, _salt, _query, _class, _n, _tokens) in that order; a block's index rows come first."""
    now, rows, block = None, [], None
    for batch in batches:
        a, b = [], []
        head = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        column = batch.column(5)
        bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
        for i, (at, salt, query, own, n) in enumerate(head):
            tokens = values[bounds[i] : bounds[i + 1]]
            if (at, salt) != now:
                now, rows, block = (at, salt), [], None
            if not query:
                rows.append((own, n, tokens.copy()))
                continue
            block = block or (Block(rows) if rows else None)
            if block:
                links = block.search(own, n, tokens)
                a += [own] * len(links)
                b += links
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links_of(sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes that keep every component together."""
    spark = sets.sparkSession
    narrow = sets.select("_class", F.size("_shingles").cast("long").alias("_held"), F.array_min("_shingles._token").alias("_near"))
    placed = running(narrow, ["_near", "_class"], {"_before": F.col("_held")})
    block = placed.select("_class", F.floor(F.col("_before") / BLOCK_SHINGLES).cast("int").alias("_block"))
    held = cut(sets.join(block, "_class").select("_class", "_n", "_block", F.col("_shingles._token").alias("_tokens")))
    unshared = F.col("_n") - F.size("_tokens")
    as_query = F.col("_n") - F.ceil(F.col("_n") * 4 / 5) + 1 - unshared
    as_index = F.col("_n") - F.ceil(F.col("_n") * 8 / 9) + 1 - unshared

    def prefix(length):
        return F.explode(F.slice("_tokens", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias("_token")

    there = held.select("_block", prefix(as_index)).distinct()
    wanted = held.select("_class", prefix(as_query))
    route = wanted.join(there, "_token").select("_class", "_block").distinct()
    load = route.groupBy("_block").agg(F.count("*").alias("_queries"))
    salts = F.ceil(F.col("_queries") / QUERIES_PER_TASK).cast("int")
    load = cut(load.select("_block", salts.alias("_salts")))
    index = held.join(load, "_block").select(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(False).alias("_query"), "_class", "_n", "_tokens"
    )
    asked = route.join(load, "_block").select("_class", F.col("_block").alias("_at"), "_salts")
    queries = asked.join(held.drop("_block"), "_class").select(
        F.col("_at").alias("_block"), F.pmod(F.xxhash64("_class"), F.col("_salts")).cast("int").alias("_salt"), F.lit(True).alias("_query"),
        "_class", "_n", "_tokens",
    )
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = index.union(queries).repartition(tasks, "_block", "_salt").sortWithinPartitions("_block", "_salt", "_query", "_n", "_class")
    return sent.mapInArrow(search_blocks, "a bigint, b bigint")


def join_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, _class) of every document."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))
    with released_shuffles(docs.sparkSession):
        classes, sets = candidates(rows, "_body", key)
        roots = components(links_of(sets))
    roots = roots.select(F.col("node").alias("_class"), F.col("root").alias("_root"))
    rooted = classes.join(roots, "_class", "left").withColumn("_root", F.coalesce("_root", "_class"))
    smallest = rooted.groupBy("_root").agg(F.min("_rep").alias("component_id"))
    named = rooted.join(smallest, "_root").select("_class", "component_id", "_copies")
    members = with_sets(rows, "_body").select(f"`{key}`", "n_shingles", "_class")
    empty = F.col("n_shingles") == 0
    n_rows = classes.agg(F.sum("_copies")).first()[0] or 0
    # a class of very many copies is salted
    return attach_group_stats(members, named, ["_class"], "_copies", n_rows).select(
        f"`{key}`", "n_shingles", F.when(empty, F.col(f"`{key}`")).otherwise(F.col("component_id")).alias("component_id"), "_class"
    )


def one_per_component(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document of the smallest id of every component, and all without words; columns as they were."""
    named = cut(join_components(docs, text, key).withColumn("_key", null_safe(F.col(f"`{key}`"))))
    stays = F.col(f"`{key}`").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    dropped = named.where(~stays).select("_key", "_class").distinct()
    repeated = named.where(stays & (F.col("n_shingles") > 0)).groupBy("_key", "_class").count().where("count > 1").drop("count")
    repeated = cut(repeated)
    names = [F.col(f"`{c}`") for c in docs.columns]
    tagged = with_sets(docs.withColumn("_key", null_safe(F.col(f"`{key}`"))), text, "_size")
    # whole rows move only if too many are dropped to tell every task which
    out = tagged.join(sided(cut(dropped.union(repeated))), ["_key", "_class"], "left_anti").select(*names)
    if not repeated.head(1):
        return out
    once = tagged.join(sided(repeated), ["_key", "_class"], "left_semi").dropDuplicates(["_key", "_class"])
    return out.union(once.select(*names))
