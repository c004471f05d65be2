"""Texts that are not UTF-8 are read with U+FFFD for the bad bytes."""

import pytest
from pyspark.sql import functions as F
from tablewright.llm import language_id, token_counts, toxicity


@pytest.fixture(scope="module")
def mixed(spark, prose):
    rows = [(i, prose(i, 60), ("en", "fr")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF61C3"))).cast("string")
    return df.withColumn("text", F.when(F.col("doc_id") % 5 == 0, bad).otherwise(F.col("text"))).repartition(2)


def replaced(df):
    return {r.doc_id: bytes(r.b or b"").decode(errors="replace") for r in df.select("doc_id", F.col("text").cast("binary").alias("b")).collect()}


def test_token_counts(spark, mixed):
    want = spark.createDataFrame(list(replaced(mixed).items()), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(mixed).collect()}
    assert got == {r.doc_id: r.n_tokens for r in token_counts.count_tokens(want).collect()}


def test_toxicity_and_language(spark, mixed):
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(60)], "doc_id bigint, toxic int")
    assert toxicity.score(mixed, toxicity.fit(mixed, labels)).where("score BETWEEN 0 AND 1").count() == 60
    named = language_id.predict(mixed.drop("lang"), language_id.fit(mixed))
    assert named.where("lang_pred IN ('en', 'fr')").count() == 60
