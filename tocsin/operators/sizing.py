"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Dimension rows up to which a broadcast is used. A place row is ~100 bytes, so this is ~5 MB.
BROADCAST_ROWS = 50_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1`` of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input of few splits (one small file).

    A large input already has more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if the row check allows; otherwise leave the equi-join to Spark."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def pair_with(left: DataFrame, right: DataFrame, max_rows: int = BROADCAST_ROWS,
              blocks: int = 64) -> DataFrame:
    """Every left row against every right row, for relations without any equality key.

    Only for de-duplicated dimensions (distinct coordinates, grid cells, names), never for facts.
    A right side within ``max_rows`` is broadcast. A larger one is cut into hash blocks and the
    left rows visit each block, so no task holds a whole side.
    """
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), F.lit(True), "inner")
    r = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    visits = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return visits.join(r, "_block").drop("_block")
