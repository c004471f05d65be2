"""Sharding, mixing and line rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tablewright.llm import line_frequency, mixing, sharding

PYTHON_NODES = ("Python", "Pandas", "Arrow")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES)


# sharding


def needed(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if held + s > capacity:
            shards, held = shards + 1, 0
        held += s
    return shards


def smallest(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(sizes, mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("first_ranges,parts", [(8_192, 64), (4, 2)])
def test_capacity_is_the_smallest(spark, monkeypatch, first_ranges, parts):
    monkeypatch.setattr(sharding, "FIRST_RANGES", first_ranges)
    monkeypatch.setattr(sharding, "PARTS", parts)
    rng = random.Random(11)
    for shards, n, top in ((3, 7, 9), (24, 200, 500), (5, 60, 3)):
        sizes = [rng.randint(1, top) for _ in range(n)]
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        search = sharding.Capacity(spark.createDataFrame(ends, "_end bigint").cache(), at, max(sizes), shards)
        capacity = search.smallest()
        assert capacity == smallest(sizes, shards)
        cuts = search.cuts(capacity)
        edges = [0, *cuts, at]
        assert set(cuts) <= {e for (e,) in ends} and len(cuts) < shards
        assert max(b - a for a, b in zip(edges, edges[1:], strict=False)) == capacity


def check_shards(rows, shards):
    groups, slots, held = defaultdict(set), defaultdict(list), Counter()
    size = Counter()
    for r in rows:
        groups[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
        size[r.text] += r.size
    assert all(len(v) == 1 for v in groups.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in held)
    lower = max(max(size.values()), -(-sum(size.values()) // shards))
    assert max(held.values()) <= lower + max(size.values())


def test_shards_hold_groups_together(spark, prose):
    rows = [(i, prose(i % 90, 10 + i % 50)) for i in range(400)] + [(1000 + i, "hot text") for i in range(200)]
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8)
    no_python(placed)
    check_shards(placed.collect(), 8)


def test_odd_rows_in_shards(odd, none, odd_rows):
    placed = sharding.shard(odd, shards=24)
    rows = placed.collect()
    assert len(rows) == len(odd_rows) and placed.columns.count("size") == 1
    check_shards(rows, 24)
    assert {(r.size, r.text_crc32) for r in rows if r.text is None} == {(8, None)}
    assert {(r.size, r.text_crc32) for r in rows if r.text == ""} == {(8, 0)}
    assert sharding.shard(none).count() == 0


# mixing


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[k] for k in held)
        over = sum(weight[k] for k in names if k not in held)
        share = {k: most * sizes[k] if k in held else left * weight[k] / over for k in names}
        more = {k for k in names if share[k] > most * sizes[k]}
        if not more:
            return share
        held |= more


def test_targets_stop_at_the_ceiling(spark):
    for case in ({"a": 1000, "b": 10, "c": 5, "d": 1, None: 50}, {"é": 7, "z": 7, "Z": 7}, {"a": 0, "b": 9}, {"q": 5}):
        rows = [(i, " ".join(["w"] * n), k) for i, (k, n) in enumerate(case.items())]
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
        got = {r.source: r.target for r in mixed.collect()}
        assert got == pytest.approx(targets_by_hand(case))


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    mixed = mixing.mix(df)
    no_python(mixed)
    got = mixed.collect()
    taken, target = Counter(), {}
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[k] - t) < 0.05 * t for k, t in target.items())
    again = mixing.mix(df.repartition(2)).select("doc_id", "copies").collect()
    assert sorted(again) == sorted((r.doc_id, r.copies) for r in got)
    assert mixing.emit(mixed).count() == sum(r.copies for r in got)


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a\x0bb\x0c", "é\xa0x y", "#\n#"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_odd_rows_in_a_mix(odd, none, odd_rows):
    mixed = mixing.mix(odd)
    rows = mixed.collect()
    assert len(rows) == len(odd_rows) and mixed.columns.count("size") == 1
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    assert mixing.mix(none).count() == 0 and mixing.emit(mixing.mix(none)).count() == 0


# line rules


def measures_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_measures(spark):
    rng = random.Random(13)
    texts = [None, "", "a", "a a a", "a a a a", "a b c a b c", "x\n\nx\n x", "#|é \n #|é"]
    texts += [" ".join(rng.choice("abc\n#") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns(line_frequency.base_measures(F.col("t")))
    for r in df.collect():
        assert tuple(r)[1:] == measures_by_hand(r.t)


def lines_by_hand(rows, at_least, share, most_lost):
    seen, hosts = defaultdict(set), Counter(h for _, h in {(t, h) for _, t, h in rows})
    norm = lambda x: " ".join(x.lower().split())
    lines = lambda t: [x for x in (t or "").split("\n") if x.split()]
    for _, t, h in rows:
        for x in lines(t):
            seen[h, norm(x)].add(t)
    out = []
    for k, t, h in rows:
        gone = [x for x in lines(t) if len(seen[h, norm(x)]) > max(at_least, share * hosts[h])]
        lost = sum(len(x.split()) for x in gone)
        n, _, _, _, again = measures_by_hand(t)
        out.append((k, len(gone), lost, n >= 50 and 2 * again <= n and lost <= most_lost * n and n - lost >= 50))
    return sorted(out, key=str)


def test_common_lines_of_a_host(spark, prose):
    def text(seed, n):
        return prose(seed, n).replace("\n", " ")

    common = ["Read  more about it here today", "all rights are reserved by us"]
    rows = [(i, common[i % 2].upper() + "\n" + text(700 + i, 60), "a") for i in range(40)]
    rows += [(100 + i, common[0] + "\n" + text(800 + i, 60), "b") for i in range(3)]
    rows += [(200 + i, common[0] + "\n" + text(900 + i, 4), None) for i in range(30)]
    rows += [(300 + i, text(1, 60), "a") for i in range(30)] + [(400 + i, "\n".join([text(5, 40), text(1000 + i, 20)]), "c") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    judged = line_frequency.apply_rules(df, at_least=10, share=0.01)
    no_python(judged)
    got = judged.collect()
    want = lines_by_hand(rows, 10, 0.01, 0.5)
    assert sorted(((r.doc_id, r.n_removed_lines, r.n_lost_words, r.kept) for r in got), key=str) == want
    clean = {r.doc_id: r.clean_text for r in got}
    assert clean[0] == text(700, 60) and clean[100] == rows[40][1] and not next(r for r in got if r.doc_id == 400).kept


def test_lines_of_small_and_copied_hosts_at_production_limits(spark, prose):
    """The law holds in a host of 20 texts, copies do not raise its bar, and depleted documents go."""

    def text(seed, n):
        return prose(seed, n).replace("\n", " ")

    notice = "this site uses cookies read the notice below"
    rows = [(i, notice + "\n" + text(2000 + i, 44 if i < 3 else 80), "small") for i in range(6)]
    rows += [(50 + i, text(2100 + i, 70), "small") for i in range(14)]
    rows += [(100 + i, notice + "\n" + text(2200 + i, 80), "copied") for i in range(6)]
    rows += [(200 + i, text(2300, 70), "copied") for i in range(700)]
    rows += [(1000 + i, notice + "\n" + text(2400 + i, 80), "few") for i in range(5)]
    judged = line_frequency.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4))
    got = judged.collect()
    assert sorted(((r.doc_id, r.n_removed_lines, r.n_lost_words, r.kept) for r in got), key=str) == lines_by_hand(rows, 5, 0.01, 0.5)
    removed = {r.doc_id for r in got if r.n_removed_lines}
    assert removed == {*range(6), *range(100, 106)}
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {0, 1, 2}


def test_odd_rows_by_the_rules(odd, none, odd_rows):
    judged = line_frequency.apply_rules(odd)
    rows = judged.collect()
    assert len(rows) == len(odd_rows) and judged.columns.count("kept") == 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures_by_hand(r.text)
    assert line_frequency.apply_rules(none).count() == 0
