"""Hash order: the deterministic stand-in for every random choice.

``md5`` over the row key and a seed gives an order that does not depend on how the
rows are partitioned, survives recomputation after an executor is lost, and can be
reproduced by any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Sequence[str], seed: int | str) -> Column:
    """Hex digest of ``key1|key2|...|seed``."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def hash_prefix(digest: Column, digits: int = 4) -> Column:
    """First ``digits`` hex characters as an integer in ``[0, 16**digits)``."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")
