"""Duplicate messages."""

from __future__ import annotations

import json
import math
from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tocsin.functions.text import bigram_jaccard, dedup_form, text_hash
from tocsin.operators.ordered import previous_row, running_totals
from tocsin.operators.replay import replay
from tocsin.session import cut_lineage

#: piece length of the filters ahead of edit distance: in the stream, and on bitmaps
GRAM, PIECE = 5, 7


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, first_id, copies) of texts that occur more than once after normalising."""
    h = df.select(F.col(key), text_hash(dedup_form(F.col(text))).alias("hash"))
    return h.groupBy("hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where(
        F.col("copies") > 1)


@F.pandas_udf(T.BinaryType())
def gram_bits(body: pd.Series) -> pd.Series:
    """A bit for each distinct piece of a text, by hash, among 8 to 16 bits a character."""
    def bits(text: str) -> bytes:
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        h = np.zeros(max(len(c) - PIECE + 1, 0), np.uint64)
        for i in range(PIECE):
            h = (h + c[i:i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(1 << max(6, (8 * len(c) - 1).bit_length()), bool)
        out[(h >> np.uint64(20)) & np.uint64(len(out) - 1)] = True
        return np.packbits(out).tobytes()

    return body.map(bits)


@F.pandas_udf(T.IntegerType())
def bits_lost(x: pd.Series, y: pd.Series) -> pd.Series:
    """Bits of x that y lacks: no more than the pieces of x that y lacks. The longer one is folded to the shorter."""
    def lost(a: bytes, b: bytes) -> int:
        size = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(np.frombuffer(v, np.uint8).reshape(-1, size)) for v in (a, b))
        return int(np.bitwise_count(a & ~b).sum())

    return pd.Series([lost(a, b) for a, b in zip(x, y)], dtype="int32")


def near_pairs(df: DataFrame, key: str, text: str, scope: list[str], ts: str,
               seconds: int = 120, threshold: float = 0.9) -> DataFrame:
    """(key, earlier_id, similarity) for messages alike to an earlier one of the last ``seconds``.

    Every such pair is found, however many messages lie between. The cleaned texts are written once. Candidates
    meet by an equi-join on scope, time bucket and length class that carries ids, times and lengths only; a text is
    ``threshold`` times as long as the other at least, so only neighbouring classes can hold a partner. Equal
    texts are known by two hashes and the length. For the others the number of pieces that edits could have destroyed is
    checked on bitmaps, and only what remains gets its texts for the bounded edit distance. Rows without time or
    text have no partner; a null scope is a scope of its own. Hot buckets are split by the adaptive skew join.
    """
    m = df.where(F.col(ts).isNotNull() & F.col(text).isNotNull()).select(
        F.struct(*[F.col(c).cast("string") for c in scope]).alias("scope"), F.col(key).alias("id"), F.col(ts).alias("ts"),
        dedup_form(F.col(text)).alias("body"))
    m = m.withColumns({"row": F.monotonically_increasing_id(), "n": F.length("body"), "h": F.struct(F.xxhash64("body"), F.hash("body"))})
    m = cut_lineage(m.withColumn("bits", gram_bits("body")), "bodies")
    s = m.select("scope", "id", "ts", "row", "n", "h").withColumn("b", F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000)).cast("long")) \
        .withColumn("k", F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-math.log(threshold))).cast("int"))
    late = s.select(F.struct("id", "ts", "row", "n", "h").alias("x"), "scope", F.inline(F.expr(
        "flatten(transform(array(-1, 0), i -> transform(array(-1, 0, 1), j -> struct(b + i as b, k + j as k))))")))
    early = s.select(F.struct("id", "ts", "row", "n", "h").alias("y"), "b", "k", "scope")
    j = late.join(early, ["scope", "b", "k"])
    apart = F.unix_micros("x.ts") - F.unix_micros("y.ts")
    before = (F.col("y.ts") < F.col("x.ts")) | ((F.col("y.ts") == F.col("x.ts")) & (F.col("y.id") < F.col("x.id")))
    j = j.where(before & (apart <= seconds * 1_000_000)).withColumn("w", F.greatest("x.n", "y.n"))
    j = j.withColumn("edits", F.floor((1 - threshold) * F.col("w") + 1e-9).cast("int"))
    j = j.where(F.abs(F.col("x.n") - F.col("y.n")) <= F.col("edits"))
    j = cut_lineage(j.select(F.col("x.id").alias("id"), F.col("y.id").alias("earlier_id"), F.col("x.row").alias("x"), F.col("y.row").alias("y"),
                             "w", "edits", ((F.col("x.n") == F.col("y.n")) & (F.col("x.h") == F.col("y.h"))).alias("same")), "candidates")
    pair = ["id", "earlier_id", "x", "y", "w", "edits"]
    with_both = lambda c, col: c.join(m.select(F.col("row").alias("x"), F.col(col).alias("_x")), "x").join(
        m.select(F.col("row").alias("y"), F.col(col).alias("_y")), "y")
    rest = with_both(j.where("NOT same").select(*pair), "bits").where(bits_lost("_x", "_y") <= PIECE * F.col("edits"))
    rest = cut_lineage(rest.select(*pair), "to-compare")
    # small rows, long work: more parts than their bytes ask for, and written, as the filter on d would be pushed before the exchange
    parts = 4 * m.sparkSession.sparkContext.defaultParallelism
    rest = cut_lineage(with_both(rest, "body").repartition(parts, "x", "y"), "texts")
    rest = rest.withColumn("d", F.expr("levenshtein(_x, _y, edits)")).where("d >= 0")
    out = rest.select("id", "earlier_id", (1 - F.col("d") / F.col("w")).alias("similarity"))
    out = out.unionByName(j.where("same").select("id", "earlier_id", F.lit(1.0).alias("similarity")))
    return out.withColumnRenamed("id", key)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one machine-independent bit column per step (Myers 1999)."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return len(a)
    peq: dict[str, int] = {}
    for i, ch in enumerate(b):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in a:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score


def gram_counts(text: str) -> Counter:
    return Counter(text[i:i + GRAM] for i in range(len(text) - GRAM + 1))


def may_be_near(a: tuple[str, Counter], b: tuple[str, Counter], threshold: float) -> bool:
    """Exact filter: k edits destroy at most k * GRAM of the longer text's pieces."""
    w = max(len(a[0]), len(b[0]))
    k = int((1 - threshold) * w + 1e-9)
    if abs(len(a[0]) - len(b[0])) > k:
        return False
    need = w - GRAM + 1 - k * GRAM
    if need <= 0:
        return True
    small, large = (a[1], b[1]) if len(a[1]) <= len(b[1]) else (b[1], a[1])
    return sum(min(n, large[g]) for g, n in small.items() if g in large) >= need


def near_similarity(a: tuple[str, Counter], b: tuple[str, Counter], threshold: float) -> float | None:
    """Edit similarity of two counted texts, or None below the threshold."""
    if a[0] == b[0]:
        return 1.0
    if not may_be_near(a, b, threshold):
        return None
    sim = 1.0 - edit_distance(a[0], b[0]) / max(len(a[0]), len(b[0]))
    return sim if sim >= threshold else None


class RetainedBuffer:
    """The last ``size`` retained messages of one scope inside the time window, with texts: for the stateful stream."""

    def __init__(self, seconds: float, size: int, threshold: float):
        self.seconds, self.size, self.threshold = seconds, size, threshold
        self.items: deque = deque()
        self.counted: tuple[str, Counter] | None = None

    def _counted(self, text: str) -> Counter:
        if self.counted is None or self.counted[0] != text:
            self.counted = (text, gram_counts(text))
        return self.counted[1]

    def expire(self, now: float) -> None:
        while self.items and self.items[0][0] < now - self.seconds:
            self.items.popleft()

    def find(self, ts: float, text: str) -> tuple[object, float] | None:
        self.expire(ts)
        best, best_id = 0.0, None
        for _, mid, other, _ in self.items:
            if other == text:
                return mid, 1.0
        mine = (text, self._counted(text))
        for _, mid, other, grams in self.items:
            s = near_similarity(mine, (other, grams), self.threshold)
            if s is not None and s > best:
                best, best_id = s, mid
        return (best_id, best) if best >= self.threshold else None

    def keep(self, ts: float, mid, text: str) -> None:
        self.items.append((ts, mid, text, self._counted(text)))
        while len(self.items) > self.size:
            self.items.popleft()


def islands(df: DataFrame, keys: list[str], ts: str, tie: list[str], seconds: float,
            out: str = "island") -> DataFrame:
    """Number the stretches of a key that are separated by gaps longer than ``seconds``."""
    p = previous_row(df, keys, ts, tie, [ts], "_prev")
    gap = F.unix_micros(ts) - F.unix_micros(F.col("_prev")[ts])
    first = F.when(F.col("_prev").isNull() | (gap > int(seconds * 1_000_000)), 1).otherwise(0)
    p = p.withColumn("_start", first.cast("long")).drop("_prev")
    return running_totals(p, keys, ts, tie, {out: "_start"}).drop("_start")


class RetainedIds:
    """Ids of the last ``size`` retained messages of one scope inside the time window (None: all in the window)."""

    def __init__(self, seconds: float, size: int | None):
        self.seconds, self.size = seconds, size
        self.items: deque = deque()

    def expire(self, now: float) -> None:
        while self.items and self.items[0][0] < now - self.seconds:
            self.items.popleft()

    def dump(self) -> str:
        return json.dumps([[t, int(mid)] for t, mid in self.items])

    def step(self, row) -> list[dict]:
        t = row.ts.value / 1e9
        self.expire(t)
        near = dict(zip(row.near_ids, row.near_sims)) if row.near_ids is not None else {}
        best, best_id = 0.0, None
        for _, mid in self.items:  # the earliest of the most alike
            if near.get(mid, 0.0) > best:
                best, best_id = near[mid], mid
        if best_id is None:
            self.items.append((t, int(row.message_id)))
            if self.size is not None and len(self.items) > self.size:
                self.items.popleft()
        return [{"of": best_id, "similarity": best if best_id is not None else None}]


def retained(df: DataFrame, key: str, text: str, scope: str, ts: str, seconds: int = 120,
             rows: int | None = 50, threshold: float = 0.9) -> DataFrame:
    """Greedy duplicate marking: a message is compared with retained messages only.

    Adds duplicate_of and similarity (null when retained). Alike pairs come from ``near_pairs``; the chunked replay
    then only walks ids. ``rows`` is the product's buffer of retained messages and forgets the older ones of
    a busy scope; None looks at all of the time window. A message without time or text is retained; a null
    scope is a scope of its own. Ids must be whole numbers and unique.
    """
    pairs = near_pairs(df, key, text, [scope], ts, seconds, threshold).groupBy(F.col(key).cast("long").alias("message_id")).agg(
        F.collect_list(F.col("earlier_id").cast("long")).alias("near_ids"), F.collect_list("similarity").alias("near_sims"))
    m = df.select(F.col(scope).alias("scope"), F.col(key).cast("long").alias("message_id"), F.col(ts).alias("ts"))
    plain = df.where(F.col(ts).isNull() | F.col(text).isNull()).select(
        F.col(key).cast("long").alias("message_id"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(None).cast("double").alias("similarity"))
    m = m.join(plain.select("message_id"), "message_id", "left_anti").join(pairs, "message_id", "left")

    def new_state(dump: str | None) -> RetainedIds:
        ids = RetainedIds(seconds, rows)
        ids.items.extend((t, mid) for t, mid in (json.loads(dump) if dump else []))
        return ids

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame({
            "message_id": pd.array([r.message_id for r, _ in out], dtype="Int64"),
            "duplicate_of": pd.array([o["of"] for _, o in out], dtype="Int64"),
            "similarity": pd.Series([o["similarity"] for _, o in out], dtype="float64")})

    marked = replay(m, "scope", "ts", "message_id", seconds * 20, seconds * 5,
                    "message_id long, duplicate_of long, similarity double", new_state, frame, "retained")
    return marked.unionByName(plain).withColumnRenamed("message_id", key)


def neighbour_jaccard(df: DataFrame, keys: list[str], ts: str, tie: list[str], key: str,
                      text: str) -> DataFrame:
    """Character-bigram Jaccard of each message with the one before it in its scope."""
    p = previous_row(df, keys, ts, tie, [key, text], "_prev").where(F.col("_prev").isNotNull())
    return p.select(key, F.col(f"_prev.{key}").alias("earlier_id"),
                    bigram_jaccard(F.col(text), F.col(f"_prev.{text}")).alias("jaccard"))
