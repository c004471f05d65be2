"""The corpus pipeline against plain Python, stage by stage, and every registered query of the subpackage."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from tablewright.llm import queries, toxicity

from tests.llm.test_decontamination import tiles_by_hand
from tests.llm.test_jaccard_join import by_hand
from tests.llm.test_native import check_shards, smallest, targets_by_hand


def words(text):
    table = str.maketrans(dict.fromkeys("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " "))
    return (text or "").translate(table).encode().lower().split()


def leaked(text, items):
    doc = words(text)
    seeds = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
    for item in items:
        if any(tuple(item[i : i + 5]) in seeds for i in range(len(item) - 4)):
            if sum(t[2] for t in tiles_by_hand(doc, item, 5)) >= 0.6 * len(item):
                return True
    return False


def copies_by_hand(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    target = targets_by_hand(sizes)
    out = {}
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        draw = int(hashlib.md5(f"{r.doc_id}|8".encode()).hexdigest()[:12], 16) / 16.0**12
        out[r.doc_id] = int(rate) + (draw < rate - int(rate))
    return out


def test_stages_by_hand(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs.collect()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(*model)
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "toxicity":
            want = [r for r in kept if scorer.score(r.text or "") < 0.5]
        elif name == "ngram_jaccard_join":
            ids, sizes = by_hand([(r.doc_id, r.text) for r in kept])
            want = [r for r, c, n in zip(kept, ids, sizes, strict=True) if not n or c == r.doc_id]
        elif name == "benchmark_decontamination":
            want = [r for r in kept if not leaked(r.text, items)]
        elif name == "source_mixing":
            times = copies_by_hand(kept)
            want = [r for r in kept for _ in range(times[r.doc_id])]
        else:
            want = kept
            check_shards(got, 24)
            sizes = defaultdict(int)
            for r in got:
                sizes[r.text] += r.size
            of_shard = {r.text: r.shard for r in got}
            held = Counter()
            for text, size in sizes.items():
                held[of_shard[text]] += size
            first = docs.selectExpr("text", "xxhash64(text) AS h", "crc32(cast(text AS binary)) AS c").distinct().orderBy("h", "c")
            assert max(held.values()) == smallest([sizes[r.text] for r in first.collect()], 24)
        assert docs.columns[: len(columns)] == columns and (name == "sharding" or docs.columns == columns)
        assert sorted(tuple(r)[: len(columns)] for r in got) == sorted(tuple(r)[: len(columns)] for r in want)
        assert name in ("source_mixing", "sharding") or 0.6 * len(kept) < len(got) < len(kept)
        kept = got
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(again.collect()) == sorted(kept)


def test_pipeline_on_odd_rows(spark, odd, none, sf_dir, tmp_path):
    for start in (odd.drop("size", "shard"), none.drop("size", "shard")):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{start is odd}-{start.count()}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns[: len(start.columns)] == start.columns


@pytest.mark.parametrize("name", [n for n in queries.R.queries if n.startswith("op")])
def test_query_gives_a_row_per_document(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    rows, docs = got.count(), spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert "doc_id" in got.columns
    assert rows == docs if name not in ("op1_benchmark_decontamination", "op6_substring_dedup") else rows > 0
