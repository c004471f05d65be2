"""The row-cap sample: the first ``n`` rows in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright import constants as K
from tablewright.functions.hashing import hash_order


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = K.SEED) -> DataFrame:
    """Deterministic sample of ``n`` rows; a distributed top-n, not a sort."""
    return df.orderBy(hash_order(key, seed), *key).limit(n)
