"""Near duplicates by MinHash bands and sequential Bayesian verification, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.llm.common import settle, small_batches, table, text_key
from tocsin.llm.graph import components

#: Hash functions, bands and rows of a band. A pair of similarity 0.85 shares no band in 2 of 10 million cases.
HASHES, BANDS, ROWS, BATCH = 192, 26, 5, 32
#: Members of a block of a bucket; two blocks are compared with each other in one group.
BLOCK = 512
#: Candidate documents up to which their ids are sent to every task (about 50 bytes each).
BROADCAST_IDS = 300_000
_R = np.random.default_rng(20)
_A = _R.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, HASHES, dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; of fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    s = np.full(n, np.uint64(min(len(h), size)), np.uint64)
    for k in range(min(size, len(h))):
        s = _mix(s * _M1 + h[k:k + n])
    return np.unique(s)


def _signature(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[None, at:at + 2048] ^ _B[:, None]
        part *= _A[:, None]
        least = np.minimum(least, (part >> np.uint64(32)).min(axis=1))
    return least


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, h1, h2, sig, bands): size and 128-bit hash of the shingle set, 16-bit minima, band keys."""
    band = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, size)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                least = _signature(s)
                key = band.copy()
                for part in least[:BANDS * ROWS].reshape(BANDS, ROWS).T:
                    key = _mix(key * _M1 + part)
                h1, h2 = _mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s * _M1))
                rows.append((len(s), int(h1.astype(np.int64)), int(h2.astype(np.int64)), least.astype("<u2").tobytes(), key.astype(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *new], ["doc_id", "key", "n", "h1", "h2", "sig", "bands"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return base.mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, sig binary, bands array<long>")


@lru_cache(maxsize=16)
def least_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest equal minima at which the posterior chance of the similarity is ``miss`` or more.

    With a uniform prior, m of n equal minima leave a chance of P(Bin(n + 1, similarity) <= m) that the pair has it.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _survive(a: np.ndarray, b: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """Positions of the pairs (rows of signatures) that no batch prunes."""
    live = np.arange(len(a))
    equal = np.zeros(len(a), int)
    for k, least in enumerate(least_matches(similarity, miss)):
        if not len(live):
            break
        cols = slice(k * BATCH, (k + 1) * BATCH)
        equal[live] += (a[live, cols] == b[live, cols]).sum(axis=1)
        live = live[equal[live] >= least]
    return live


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), HASHES)


def _near_sizes(a: str, b: str, similarity: float):
    """No smaller set can have this share of a larger one."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def prune(pairs: DataFrame, known: DataFrame, similarity: float, miss: float) -> DataFrame:
    """The pairs (a, b) that survive the set sizes and the batches of signatures."""
    one = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    j = pairs.join(one, "a").join(two, "b").filter(_near_sizes("na", "nb", similarity)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.iloc[_survive(_signatures(p["sa"]), _signatures(p["sb"]), similarity, miss)][["a", "b"]]

    return j.mapInPandas(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= share * union of their whole sets."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = lru_cache(maxsize=256)(lambda t: shingle_set(t, size))
        for p in batches:
            ok = []
            for x, y in zip(p["ta"], p["tb"]):
                x, y = memo(x), memo(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= share * (len(x) + len(y) - both))
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    j = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return j.mapInPandas(run, "a long, b long").distinct()


def open_links(members: DataFrame, comps: DataFrame, known: DataFrame, texts: DataFrame, similarity: float, miss: float,
               size: int, share: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, enough to join all that are linked.

    Only buckets of two components or more are opened. Their members are dealt into blocks of about BLOCK, and each
    pair of blocks is compared in one group of bounded size: signatures by batches in the first bucket that a
    pair shares, survivors confirmed on whole sets unless a link already joins their components. At most one
    link a member comes out.
    """
    m = members.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("s")).filter("c0 <> c1")
    m = m.join(mixed.select("key", F.ceil(F.col("s") / BLOCK).cast("int").alias("blocks")), "key")
    m = m.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    seq = F.sequence(F.lit(0), F.col("blocks") - 1)
    m = m.withColumn("other", F.explode(seq)).select("key", "id", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    m = m.join(known.join(texts, "id"), "id").repartition(4 * int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j, key = g["i"].iloc[0], g["j"].iloc[0], g["key"].iloc[0]
        left = np.flatnonzero((g["block"] == i).to_numpy())
        right = np.flatnonzero((g["block"] == j).to_numpy())
        x, y = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
        ids, comp, n = g["id"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy()
        ok = (ids[x] != ids[y]) & (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * (similarity - 1e-9))
        if i == j:
            ok &= x < y
        x, y = x[ok], y[ok]
        live = _survive_at(_signatures(g["sig"]), x, y, similarity, miss)
        x, y = x[live], y[live]
        if len(x):
            bands = np.stack([np.asarray(v) for v in g["bands"]])
            same = np.concatenate([(bands[x[k:k + 65_536]] == bands[y[k:k + 65_536]]).argmax(axis=1) for k in range(0, len(x), 65_536)])
            first = bands[x, same] == key
            x, y = x[first], y[first]
        top = {c: c for c in set(comp.tolist())}

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        sets = lru_cache(maxsize=2 * BLOCK)(lambda k: shingle_set(g["text"].iloc[k], size))
        out = []
        for k, e in zip(x.tolist(), y.tolist()):
            a, b = find(comp[k]), find(comp[e])
            if a == b:
                continue
            u, v = sets(k), sets(e)
            both = len(np.intersect1d(u, v, assume_unique=True))
            if both and 100 * both >= share * (len(u) + len(v) - both):
                top[max(a, b)] = min(a, b)
                out.append((min(ids[k], ids[e]), max(ids[k], ids[e])))
        return pd.DataFrame(out, columns=["a", "b"])

    return m.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _survive_at(s: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    out = [at + _survive(s[x[at:at + 65_536]], s[y[at:at + 65_536]], similarity, miss) for at in range(0, len(x), 65_536)]
    return np.concatenate(out) if out else np.empty(0, int)


def _only(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Semi-join; the ids are sent to every task if they are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def near_duplicates(docs: DataFrame, size: int = 5, share: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, key, n_shingles, component_id: one row for each row of ``docs``.

    Documents are linked whose sets of ``size``-word shingles have 100 * intersection >= ``share`` * union; the
    component is the smallest doc_id that links reach. ``miss`` is the posterior chance at which a candidate is
    given up. Rows of one doc_id are one document. A row without words or without doc_id is linked with nothing; its component
    is its own doc_id. Only doc_id and text are read.

    1. Texts with equal sets are one class. 2. Classes that share a band are candidates: each member of a bucket
    with the bucket's least id, never all pairs. 3. Candidates are pruned by batches, survivors confirmed on whole
    sets, and components made. 4. Buckets that still hold several components are opened, in blocks.
    """
    small_batches(docs.sparkSession)
    similarity = share / 100
    docs = docs.select("doc_id", "text")
    sk = settle(sketch(docs, size), "sketch")
    full = sk.filter("n > 0 and doc_id is not null")
    classes = settle(full.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "key")).alias("r"))
                     .select("h1", "h2", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.key").alias("key")), "classes")
    reps = full.select("doc_id", "key", "bands").join(classes.select("doc_id", "key"), ["doc_id", "key"], "left_semi")
    buckets = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    pivots = settle(buckets.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("far")).filter("pivot <> far").select("key", "pivot"), "pivots")
    members = settle(buckets.join(pivots, "key"), "members")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    wanted = settle(classes.join(ids, "doc_id", "left_semi").select("doc_id", "key"), "wanted")
    known = settle(_only(full.select("doc_id", "key", "n", "sig", "bands"), wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
                   .select(F.col("doc_id").alias("id"), "n", "sig", "bands"), "known")
    texts = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "key": text_key(F.col("text"))})
    texts = settle(_only(texts, wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("id"), "text"), "texts")
    star = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = settle(confirm(prune(star, known, similarity, miss), texts, size, share), "links")
    comps = components(links)
    more = open_links(members.select("key", "id"), settle(comps, "comps"), known, texts, similarity, miss, size, share)
    links = links.unionByName(settle(more, "links"))
    comps = components(links)
    named = classes.join(comps, classes["doc_id"] == comps["id"], "left")
    named = named.select("h1", "h2", "n", F.coalesce("component", "doc_id").alias("component_id"))
    own = sk.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0).alias("n"), "h1", "h2", F.col("n").alias("n_shingles"))
    out = own.join(named, ["h1", "h2", "n"], "left")
    return out.select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, share: int = 80, miss: float = 1e-6) -> DataFrame:
    """One document of each component, that of the smallest doc_id: its rows, with their columns."""
    found = near_duplicates(docs, size, share, miss)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), size=3, share=85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
