"""Quality rules: lines that many documents of a host share.

Lines are normalised and hashed; a line in more distinct texts of its host than the limit is removed. A document is
depleted, and rejected, if it loses more than ``most_lost`` of its words or if fewer than ``least_words`` are left. Copies
of one text count as one document, in the line's count as in its host's, since copies are the business of
deduplication. A line is counted once per host and text
before anything is shuffled by line, so a line in a third of all rows is spread over its texts. The base
measures of a text are computed in its own row without moving it.

Null texts have no words and fail. Lines without a word are never counted or removed. Very long texts are read
whole, line by line. A line exactly at the limit stays. A null host is a host of
its own. Repeated rows get the same verdict. An empty table gives an empty result. Input columns named like a
result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import null_safe
from tablewright.plans.attach import attach_group_stats

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "n_removed_lines", "n_lost_words", "clean_text", "kept",
)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """Words of a text by ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Equal windows are neighbours once sorted."""

    def covered(windows: Column) -> Column:
        again = F.filter(
            windows,
            lambda w, i: (
                F.coalesce(F.get(windows, i - 1)["h"] == w["h"], F.lit(False))
                | F.coalesce(F.get(windows, i + 1)["h"] == w["h"], F.lit(False))
            ),
        )
        places = F.flatten(F.transform(again, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))
        return F.size(F.array_distinct(places)).cast("long")

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashed = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def unless_distinct(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashed, unless_distinct))

    return let(words, count)


def base_measures(text: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    solid = F.translate(body, " \t\n\x0b\f\r", "")
    worded = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words_of(body)).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(words_of(body)),
    }


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def common_lines(docs: DataFrame, text: str, host: str, at_least: int, share: float) -> DataFrame:
    """Lines above their host's limit: ``_host``, ``_line``, ``_docs``."""
    body = F.col(f"`{text}`")
    seen = docs.select(
        null_safe(F.col(f"`{host}`")).alias("_host"),
        F.xxhash64(body).alias("_text"),
        F.array_distinct(F.transform(lines_with_words(body), line_hash)).alias("_lines"),
    )
    texts = seen.select("_host", "_text").distinct().groupBy("_host").agg(F.count("*").alias("_host_docs"))
    once = seen.select("_host", "_text", F.explode("_lines").alias("_line")).distinct()
    counts = once.groupBy("_host", "_line").agg(F.count("*").alias("_docs")).where(F.col("_docs") > at_least)
    above = F.col("_docs") > F.col("_host_docs") * share
    return counts.join(texts, "_host").where(above).select("_host", "_line", "_docs")


def apply_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    at_least: int = 5,
    share: float = 0.01,
    most_lost: float = 0.5,
    least_words: int = 50,
    most_repeated: float = 0.5,
) -> DataFrame:
    """Documents with the base measures, the text without common lines and the verdict ``kept``.

    A line is common when more than ``at_least`` distinct texts and more than ``share`` of its host's have it.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).withColumns(
        {"_host": null_safe(F.col(f"`{host}`")), "_text": F.xxhash64(F.col(f"`{text}`"))}
    )
    common = common_lines(docs, text, host, at_least, share)
    place = F.posexplode(
        F.transform(
            lines_with_words(F.col(f"`{text}`")),
            lambda x: F.struct(line_hash(x).alias("hash"), F.size(words_of(x)).alias("words")),
        )
    ).alias("_place", "_at")
    lines = rows.select("_host", "_text", place).select(
        "_host", "_text", "_place", F.col("_at.hash").alias("_line"), F.col("_at.words").alias("_words")
    )
    # one text is looked up once per host, however many copies it has
    hits = attach_group_stats(lines, common, ["_host", "_line"], "_docs", docs.count())
    lost = (
        hits.where("_docs IS NOT NULL").select("_host", "_text", "_place", "_line", "_words").distinct()
        .groupBy("_host", "_text")
        .agg(
            F.count("*").alias("_n_lines"), F.sum("_words").alias("_n_lost"), F.collect_set("_line").alias("_gone")
        )
    )
    measured = rows.withColumns(base_measures(F.col(f"`{text}`"))).join(lost, ["_host", "_text"], "left")
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > F.col("n_words") * most_repeated)
    gone = F.col("_gone")
    clean = F.when(gone.isNull(), F.col(f"`{text}`")).otherwise(
        F.array_join(
            F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x: ~F.array_contains(gone, line_hash(x))), "\n"
        )
    )
    judged = measured.withColumns(
        {
            "base_failed": failed,
            "n_removed_lines": F.coalesce("_n_lines", F.lit(0)),
            "n_lost_words": F.coalesce("_n_lost", F.lit(0)),
            "clean_text": clean,
        }
    )
    left = F.col("n_words") - F.col("n_lost_words")
    enough = (F.col("n_lost_words") <= F.col("n_words") * most_lost) & (left >= least_words)
    judged = judged.withColumn("kept", ~F.col("base_failed") & enough)
    return judged.select(*[F.col(f"`{c}`") for c in names], *RESULTS)
