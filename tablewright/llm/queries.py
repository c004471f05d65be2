"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontamination, importance, jaccard_join, language_id, line_frequency, mixing, personal_data, sharding, spelling_variants, substring_dedup, token_alignment, token_counts, toxicity
from tablewright.llm.common import held_out, read_table
from workloads.common import Registry

R = Registry()

WORD_LIST = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, len({WORD_LIST})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
-- sources by how soon they reach their ceiling: the level at which those before are held
r AS (SELECT *, 3 * source_size AS c, (SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER before, 0) AS left_over,
    (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS weights FROM s
  WINDOW before AS (ORDER BY 3.0 * source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT left_over::DOUBLE / weights AS level FROM r WHERE left_over::DOUBLE / weights * w <= c
  ORDER BY 3.0 * source_size / w, w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(w * level, c::DOUBLE) AS target FROM r, level),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '8')), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, rate, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies,
  (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT * size AS taken FROM p"""

LINES_SQL = f"""WITH d AS (SELECT *, {WORD_LIST} AS words, row_number() OVER () AS row FROM documents),
grams AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) t(k) GROUP BY row),
lines AS (SELECT row, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT row, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
common AS (SELECT l.source, norm FROM lines l JOIN (SELECT source, count(DISTINCT coalesce('t' || text, '')) AS host FROM documents GROUP BY 1) h ON h.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, norm, host HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > 0.01 * host),
gone AS (SELECT row, count(*) AS n_removed_lines, sum(n)::BIGINT AS n_lost_words FROM lines l JOIN common c ON c.norm = l.norm AND c.source IS NOT DISTINCT FROM l.source GROUP BY row),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY row),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN covered USING (row) LEFT JOIN gone USING (row) LEFT JOIN dup USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_lost_words <= n_words AND n_words - n_lost_words >= 50 AS kept FROM m"""

JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach.b)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


@R.add()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.over_limit(token_counts.count_tokens(docs))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@R.add(MIXING_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@R.add()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@R.add(LINES_SQL)
def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = line_frequency.apply_rules(docs)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_lost_words",
    )


@R.add()
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))


@R.add(JACCARD_SQL)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join_components(docs).select("doc_id", "n_shingles", "component_id")


@R.add()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@R.add()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    named = language_id.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@R.add()
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is as large as the share of good documents among the labelled ones."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    sample = importance.resample(docs, labels.where("quality = 1"), share=1.0 if share is None else share)
    return sample.select("doc_id", "log_weight", "sample_key", "kept")


@R.add()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = substring_dedup.repeated_spans(docs)
    return spans.select("doc_id", "first_word", "n_words", "component_id", "first_doc", "removed")


@R.add()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants.variants(spelling_variants.word_counts(docs))


@R.add()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.alignment_report(docs)


@R.add()
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.span_report(docs)
