"""Ordered scans that do not put one hot key into one task.

A plain ``lag`` or running sum over ``partitionBy(key)`` sends every row of a key to one task. Here
the rows are windowed inside (key, time bucket), with one row more at the start of each bucket: what
the buckets before it hand on. These rows come from a summary of one row per bucket, of which a key has
no more than the calendar has buckets (9,000 a year at one hour), so the window over the
summary is small however hot the key is. The rows themselves are shuffled once and joined to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: bucket width in seconds
WIDTH = 3_600


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000)).cast("long")


def _over_buckets(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_b")


def previous_row(df: DataFrame, keys: list[str], ts: str, tie: list[str], carry: list[str],
                 out: str = "prev", width: int = WIDTH) -> DataFrame:
    """Add struct ``out`` holding the ``carry`` columns of the preceding row of the same key.

    Order is (ts, *tie), rows without a time first. Equal to ``lag(struct).over(partitionBy(keys))``: the last row
    of each bucket is copied onward to the next bucket of the key that has rows.
    """
    order = [F.col(ts), *[F.col(t) for t in tie]]
    b = df.withColumns({"_b": _bucket(F.col(ts), width), "_own": F.lit(True), "_c": F.struct(*carry)})
    last = b.groupBy(*keys, "_b").agg(F.max_by("_c", F.struct(*order)).alias("_c"))
    onward = last.select(*keys, F.lead("_b").over(_over_buckets(keys)).alias("_b"), "_c", F.lit(False).alias("_own"))
    both = b.unionByName(onward.where("_b IS NOT NULL"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_own", *order)
    return both.withColumn(out, F.lag("_c").over(w)).where("_own").select(*df.columns, out)


def running_totals(df: DataFrame, keys: list[str], ts: str, tie: list[str],
                   sums: dict[str, str], width: int = WIDTH) -> DataFrame:
    """Running sums (current row included) of ``sums = {output: input column}`` per key.

    Equal to ``sum().over(partitionBy(keys).orderBy(ts, *tie))``: null until the first value. Each bucket starts with
    the totals of those before it.
    """
    order = [F.col(ts), *[F.col(t) for t in tie]]
    b = df.withColumns({"_b": _bucket(F.col(ts), width), "_own": F.lit(True), **{f"_v_{o}": F.col(c) for o, c in sums.items()}})
    total = b.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{o}").alias(f"_v_{o}") for o in sums])
    before = _over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
    onward = total.select(*keys, "_b", F.lit(False).alias("_own"), *[F.sum(f"_v_{o}").over(before).alias(f"_v_{o}") for o in sums])
    both = b.unionByName(onward, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *[F.sum(f"_v_{o}").over(w).alias(o) for o in sums]).where("_own").select(*df.columns, *sums)


def sessions(df: DataFrame, keys: list[str], ts: str, gap_us: Column, width: int = WIDTH) -> DataFrame:
    """(keys, start, last, n): stretches of a key in which each row comes less than ``gap_us`` after the one before.

    ``gap_us`` (microseconds) must be the same for all rows of a key. Stretches are made inside (key, bucket); only the
    first and the last one of a bucket can go on in another, and these are joined over the borders. Rows without
    a time belong to no stretch.
    """
    b = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t"), gap_us.alias("_gap"), _bucket(F.col(ts), width).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t")
    begins = F.coalesce(F.unix_micros("_t") - F.unix_micros(F.lag("_t").over(w)) >= F.col("_gap"), F.lit(True))
    b = b.withColumn("_begin", begins.cast("int")).withColumn(
        "_no", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = b.groupBy(*keys, "_b", "_no").agg(
        F.min("_t").alias("start"), F.max("_t").alias("last"), F.count("*").alias("n"), F.first("_gap").alias("_gap"))
    part = part.withColumn("_inner", (F.col("_no") > 1) & (F.col("_no") < F.max("_no").over(Window.partitionBy(*keys, "_b"))))
    o = Window.partitionBy(*keys).orderBy("start")
    edge = part.where(~F.col("_inner"))
    apart = F.coalesce(F.unix_micros("start") - F.unix_micros(F.lag("last").over(o)) >= F.col("_gap"), F.lit(True))
    edge = edge.withColumn("_begin", apart.cast("int")).withColumn(
        "_no", F.sum("_begin").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edge.groupBy(*keys, "_no").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))
    out = [*keys, "start", "last", "n"]
    return part.where("_inner").select(*out).unionByName(whole.select(*out))


def bucket_with_tail(df: DataFrame, scope: list[str], ts: str, tie: list[str], rows: int,
                     seconds: int) -> DataFrame:
    """Rows in buckets of ``seconds`` (_b), each with the last ``rows`` rows of the bucket before it
    (_own false): all a row can see when it looks back at most ``rows`` rows and ``seconds``."""
    b = df.withColumn("_b", _bucket(F.col(ts), seconds)).withColumn("_own", F.lit(True))
    newest = Window.partitionBy(*scope, "_b").orderBy(*[F.col(c).desc() for c in [ts, *tie]])
    tail = (
        b.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= rows).drop("_n")
        .withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    )
    return b.unionByName(tail)


def with_history(df: DataFrame, scope: list[str], ts: str, tie: list[str], carry: list[str],
                 rows: int, seconds: int, out: str = "history") -> DataFrame:
    """Add array ``out``: the last ``rows`` rows of the scope not older than ``seconds``, oldest first."""
    packed = F.struct(F.col(ts).alias("_ts"), *[F.col(c) for c in carry])
    order = [F.col(c) for c in [ts, *tie]]
    w = Window.partitionBy(*scope, "_b").orderBy(*order).rowsBetween(-rows, -1)
    both = bucket_with_tail(df, scope, ts, tie, rows, seconds).withColumn(
        "_rows", F.collect_list(packed).over(w)).where("_own")
    oldest = F.unix_micros(F.col(ts)) - F.lit(seconds * 1_000_000)
    return both.withColumn(
        out, F.filter("_rows", lambda h: F.unix_micros(h["_ts"]) >= oldest)
    ).drop("_rows", "_b", "_own")


def first_after(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                seconds: int, out: str) -> DataFrame:
    """As-of lookup: earliest ``right_ts`` of the same key in (left_ts, left_ts + seconds].

    Both sides are merged inside (key, bucket of ``seconds``); the bucket that follows is represented
    by its earliest row alone. No pairs are built, so a hot key costs a sort, not a product.
    """
    lb = left.withColumn("_b", _bucket(F.col(left_ts), seconds)).withColumn("_t", F.col(left_ts)) \
        .withColumn("_right", F.lit(None).cast("timestamp"))
    events = right.select(*keys, F.col(right_ts).alias("_t")).withColumn(
        "_b", _bucket(F.col("_t"), seconds))
    nxt = events.groupBy(*keys, "_b").agg(F.min("_t").alias("_t")).withColumn("_b", F.col("_b") - 1)
    side = events.unionByName(nxt).withColumn("_right", F.col("_t"))
    for c in left.columns:
        if c not in keys:
            side = side.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = lb.withColumn("_left", F.lit(True)).unionByName(side.withColumn("_left", F.lit(False)))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").desc(), F.col("_left").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(out, F.last("_right", ignorenulls=True).over(w)).where("_left")
    limit = F.unix_micros(F.col(left_ts)) + F.lit(seconds * 1_000_000)
    return found.withColumn(
        out, F.when(F.unix_micros(F.col(out)) <= limit, F.col(out))
    ).drop("_b", "_t", "_right", "_left")
