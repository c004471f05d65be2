"""Row plumbing the operators share: appended columns, ordered positions, keys that may be null."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans.lineage import cut

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch: a thousand long documents fit beside each other in a Python worker.
BATCH_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_columns(
    df: DataFrame,
    text: str,
    schema: str,
    make: Callable[[], Callable[[list[bytes | None]], Sequence]],
) -> DataFrame:
    """Add columns computed from the bytes of ``text``, one Arrow batch at a time.

    ``make`` runs once per task and returns the function of a batch; that returns one sequence per
    column of ``schema``. An input column with the name of a new one is replaced. Names that begin with an
    underscore are kept for the operators.
    """
    new = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema if f.name not in new.names]
    names = [f.name for f in kept]
    source = df.select(*[F.col(f"`{n}`") for n in names])
    if text not in names:
        source = source.withColumn("_text_in", df[f"`{text}`"])
    place = names.index(text) if text in names else len(names)
    out = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        types = to_arrow_schema(new)
        for batch in batches:
            made = work(batch.column(place).cast(pa.binary()).to_pylist())
            arrays = [v.cast(t.type) if isinstance(v, pa.Array) else pa.array(v, type=t.type) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + arrays, names + new.names)

    return source.mapInArrow(run, out)


def fit_batches(spark: SparkSession) -> None:
    """Batches of few documents, so that long ones fit a worker."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def explode_from(
    df: DataFrame, text: str, keys: Sequence[str], schema: str, make: Callable[[], Callable], seen: Sequence[str] = ()
) -> DataFrame:
    """Rows made from each document: ``keys`` repeated beside the new columns.

    The function of a batch gets its texts and the columns ``seen`` of ``keys``; it returns the row number each new row came
    from, then one array per column.
    """
    new = T.StructType.fromDDL(schema)
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text_in"))
    out = T.StructType([*source.schema.fields[:-1], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        types = to_arrow_schema(new)
        for batch in batches:
            beside = [batch.column(list(keys).index(k)) for k in seen]
            for origin, *made in work(batch.column(len(keys)).cast(pa.binary()).to_pylist(), *beside):
                at = pa.array(origin, type=pa.int64())
                arrays = [batch.column(i).take(at) for i in range(len(keys))]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=t.type) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, *new.names])

    return source.mapInArrow(run, out)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go once its result is written, instead of when the driver next collects garbage.

    Only for steps that end in ``cut``: what runs again from a lazy table would make its files again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def null_safe(column: Column) -> Column:
    """A text key under which nulls meet each other and nothing else."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums over ``order`` (a unique key): ``sums`` maps a new column to what it adds up.

    Ranges of the order are dealt to tasks and written to the checkpoint folder; only one row of
    totals per range meets in the window that gives each range its start.
    """
    held = df.withColumns({f"_add_{k}": v for k, v in sums.items()}).repartitionByRange(*order)
    held = cut(held.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("_range").agg(*[F.sum(f"_add_{k}").alias(f"_all_{k}") for k in sums])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = held.join(F.broadcast(starts), "_range").withColumns(
        {k: F.col(f"_from_{k}") + F.coalesce(F.sum(f"_add_{k}").over(inside), F.lit(0)) for k in sums}
    )
    return done.drop("_range", *[f"_{p}_{k}" for k in sums for p in ("add", "from")])


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
