"""Schema-level selections; no job runs here."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELIGIBLE_CATEGORICAL = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str):
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Strings, booleans and dates; nested columns are never features."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, ELIGIBLE_CATEGORICAL) and f.name not in skip
    ]


def feature_columns(df: DataFrame, label: str | None, key: Sequence[str] = ()) -> list[str]:
    skip = {label, *key}
    usable = set(numeric_columns(df)) | set(categorical_columns(df))
    return [c for c in df.columns if c in usable and c not in skip]


def require_columns(df: DataFrame, names: Iterable[str], context: str) -> None:
    """Fail before any plan is built, naming every absent column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")


def drop_columns(df: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop ``names``; absent ones are ignored and ``keep`` always stays."""
    kept = set(keep)
    return df.drop(*[n for n in names if n not in kept])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere downstream, so turn it into NULL at the scan."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def order_columns(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Priority columns first, ``last`` at the end, the rest in between as they were."""
    head = [c for c in first if c in df.columns]
    tail = [c for c in last if c in df.columns and c not in head]
    middle = [c for c in df.columns if c not in head and c not in tail]
    return df.select(*[col(c) for c in head + middle + tail])


def is_classification(df: DataFrame, label: str, max_classes: int) -> bool:
    """At most ``max_classes`` distinct non-null labels; stops after one more than that."""
    return len(label_values(df, label, max_classes + 1)) <= max_classes


def label_values(df: DataFrame, label: str, at_most: int) -> list:
    """Up to ``at_most`` distinct non-null labels (map-side distinct, bounded collect)."""
    rows = df.select(col(label).alias("v")).where("v IS NOT NULL").distinct().limit(at_most).collect()
    return [r["v"] for r in rows]
