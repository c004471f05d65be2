import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tablewright.llm import jaccard_join as j
from tablewright.llm.components import components


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows):
    """component id per row, comparing everything that shares a shingle."""
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(own):
        near = {k for t in s for k in lists[t]}
        for k in near:
            both = len(s & own[k])
            if 100 * both >= 80 * (len(s) + len(own[k]) - both):
                root[find(i)] = find(k)
        for t in s:
            lists[t].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return [rows[i][0] if not own[i] else least.get(find(i)) for i in range(len(rows))], [len(s) for s in own]


def check(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in j.join_components(df).collect())
    ids, sizes = by_hand(rows)
    assert got == sorted((str(k), n, c) for (k, _), n, c in zip(rows, sizes, ids, strict=True))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split())


def test_copies_chains_and_strangers(spark, prose, monkeypatch):
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = prose(200 + g, rng.randint(5, 200))
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0.01, 0.03]))) for k in range(rng.randint(1, 8))]
    common = prose(300, 30)
    rows += [(1000 + k, common + " " + prose(400 + k, 60)) for k in range(30)]
    hot = prose(301, 120)
    rows += [(2000 + k, edited(rng, hot, 0.012)) for k in range(80)]
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 1_500)
    monkeypatch.setattr(j, "QUERIES_PER_TASK", 16)
    rng.shuffle(rows)
    check(spark, rows)


def test_shuffled_broadcasts(spark, prose, monkeypatch):
    monkeypatch.setattr(j, "BROADCAST_CLASSES", 0)
    check(spark, [(k, prose(500 + k % 7, 60) + (" end" if k % 2 else "")) for k in range(20)])


def test_odd_rows(spark, odd, none, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    check(spark, rows)
    assert j.join_components(none).count() == 0
    left = j.one_per_component(odd)
    assert left.columns == odd.columns
    got = sorted(str(r.doc_id) for r in left.collect())
    # the rows without words stay; of 5, 6, 11 and the null id one; the other text of id 5; 7 for 7 and 8
    assert got == sorted(["1", "2", "3", "None", "4", "5", "5", "7", "9", "10"])
    assert j.one_per_component(none).count() == 0


def test_search_needs_every_part(prose):
    rng = random.Random(9)
    texts = [edited(rng, prose(600, 150), 0.01) for _ in range(40)]
    made = list(j.sets_of([t.encode() for t in texts]))
    rows = [(i, len(s), s.view("int64")) for i, s in enumerate(made)]
    block = j.Block(list(rows))
    for own, n, s in sorted(rows, key=lambda r: (r[1], r[0])):
        block.search(own, n, s)
    want, _ = by_hand(list(enumerate(texts)))
    roots = defaultdict(set)
    for i, c in enumerate(want):
        roots[c].add(block.find(i))
    assert all(len(v) == 1 for v in roots.values())


def test_search_of_a_large_group_takes_no_steps_by_element(prose):
    import cProfile
    import pstats

    rng = random.Random(11)
    base = prose(601, 150)
    made = list(j.sets_of([edited(rng, base, 0.01).encode() for _ in range(400)]))
    rows = [(i, len(s), s.view("int64")) for i, s in enumerate(made)]
    block = j.Block(list(rows))
    profile = cProfile.Profile()
    profile.enable()
    links = [(own, x) for own, n, s in sorted(rows, key=lambda r: (r[1], r[0])) for x in block.search(own, n, s)]
    profile.disable()
    assert len(links) > 300
    assert pstats.Stats(profile).total_calls < 2_000 * len(rows)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7, 6), (-3, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert got[900] == -3 and 5000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_know_their_rows_without_a_count(spark, monkeypatch):
    from tablewright.llm import components as c

    def counted(*args):
        raise AssertionError("a job that only counts")

    monkeypatch.setattr(c, "has_at_most", counted)
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)]
    for most in (c.BROADCAST_NODES, 0):
        monkeypatch.setattr(c, "BROADCAST_NODES", most)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}


def test_size_guesses_do_not_grow_with_the_rounds(spark, capsys):
    """A join's guess is the product of its sides; handed on from round to round its digits would double each time."""
    from tablewright.llm.components import flatten

    ids = spark.range(600).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(600)], "node bigint, parent bigint")
    for made in (components(ids), flatten(chain)):
        made.explain("cost")
        sizes = re.findall(r"sizeInBytes=([^,)]+)", capsys.readouterr().out)
        assert sizes and all(len(re.sub(r"\D", "", s.partition("E+")[2])) <= 2 for s in sizes)
    assert {r.parent for r in made.collect()} == {0}
