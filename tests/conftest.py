from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from oracle import spark_session

    s = spark_session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def noise(spark):
    """Reproducible bell-shaped columns: sums of hashed uniforms, one row per id."""
    from pyspark.sql import functions as F

    def bell(name: str):
        parts = [F.pmod(F.xxhash64(F.concat(F.lit(f"{name}{i}"), F.col("id").cast("string"))), F.lit(1_000_003)) / 1_000_003.0 for i in range(12)]
        return sum(parts[1:], parts[0]) - 6.0

    def build(rows: int, *names: str):
        return spark.range(rows).select("id", *[bell(n).alias(n) for n in names])

    return build
