import random

import numpy as np
from pyspark.sql import functions as F
from tablewright.llm import decontamination as d


def tiles_by_hand(doc, item, least):
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, at = 0, []
        for y in range(len(item)):
            for x in range(len(doc)):
                k = 0
                while x + k < len(doc) and y + k < len(item) and free_doc[x + k] and free_item[y + k] and doc[x + k] == item[y + k]:
                    k += 1
                if k > best:
                    best, at = k, [(x, y)]
                elif k == best:
                    at.append((x, y))
        if best < least:
            return tiles
        for x, y in sorted(at, key=lambda p: (p[1], p[0])):
            if all(free_doc[x : x + best]) and all(free_item[y : y + best]):
                for k in range(best):
                    free_doc[x + k] = free_item[y + k] = False
                tiles.append((x, y, best))


def test_tiling_is_the_greedy_one():
    rng = random.Random(3)
    for _ in range(150):
        doc = [rng.randint(0, 5) for _ in range(rng.randint(0, 60))]
        item = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        got = d.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert got == tiles_by_hand(doc, item, 3)


def test_leaks_of_any_order_and_block_size(spark, prose):
    items = [(i, prose(100 + i, 40)) for i in range(6)] + [(9, prose(100, 40)), (10, None), (11, ""), (12, "too short")]
    words = prose(101, 40).split()
    docs = [
        (1, prose(50, 200) + " " + prose(100, 40) + " " + prose(51, 100)),
        (2, " ".join([*words[20:], "between", *words[:20]]).upper().replace("É", "é")),
        (3, " ".join(words[:12]) + " " + prose(52, 100)),
        (4, prose(53, 20_000)), (5, None), (6, ""), (7, prose(102, 40).replace(" ", ", ")), (7, prose(102, 40)),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (500_000, 60):
        found = d.find_leaks(df, bench, block_words=block_words)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 0), (2, 1), (7, 2), (7, 2)]
        assert {r.doc_id for r in d.drop_leaks(df, bench, block_words=block_words).collect()} == {3, 4, 5, 6}
    two = found.where("doc_id = 2").first()
    assert two.matched_words == 40 and len(two.tiles) >= 2


def test_odd_rows(odd, none, spark, prose, odd_rows):
    bench = spark.createDataFrame([(1, prose(2, 80))], "item_id bigint, text string")
    assert d.find_leaks(none, bench).count() == 0
    assert d.find_leaks(odd, bench.limit(0)).count() == 0
    assert d.find_leaks(odd, bench).count() == 5
    left = d.drop_leaks(odd, bench)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 5
    assert d.drop_leaks(none, bench).count() == 0 and left.where(F.col("size") != "a").count() == 0
