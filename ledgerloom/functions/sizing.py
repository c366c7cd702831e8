"""Measured size checks that decide between a broadcast and a shuffled plan."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 32 * 1024 * 1024
#: Seconds for which a measured size holds.
REMEMBERED = 60.0
_measured: dict = {}


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """True when the whole table is measured to be at most this many rows and bytes.

    One job; the answer for an equal plan is remembered for a minute, so that operators of one run that take the same
    table measure it once. It decides between plans of the same result only.
    """
    key = (id(df.sparkSession), df.semanticHash(), max_rows, max_bytes)
    at, known = _measured.get(key, (0.0, False))
    if at and time.monotonic() - at < REMEMBERED:
        return known
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"))
        .first()
    )
    known = seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes
    if len(_measured) > 1_000:
        _measured.clear()
    _measured[key] = (time.monotonic(), known)
    return known


def compact(df: DataFrame) -> DataFrame:
    """A measured-small table in one partition: what is grouped or joined after it needs no shuffle, what comes before
    runs in as many tasks as it has."""
    return df.repartition(1)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table dealt by a unique key to as many tasks as a shuffle has, before work that costs far more than its scan."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sized(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast only for a table measured to be small; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df
