"""Ranked lexical search over bit-sliced Bloom signatures, exact to the last score.

The index holds the documents in blocks of similar length. A block is a bit matrix: a row (slice) for each
position of the signature, a column for each document. A term that occurs tf times sets the bits of
(term, level) for every level up to that of tf, so the slices of a term give, joined by AND, a bitmap of the
documents that may hold it that often. They overestimate only. Weighted by the term's weight and by what a
term of that level can bring in a document of that length, the bitmaps add up to an upper bound of each
document's score. The documents with the highest bounds are scored first; their scores exclude every document
whose bound lies below, and all that are not excluded are scored from their texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tocsin.llm.common import lower_ascii, settle, small_batches, table, text_key

#: A term: digits, ASCII letters and everything outside ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for the bytes of UTF-8: letters in lower case, all that is no part of a term a blank.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(
    bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
#: Occurrences from which a level counts: 1, 2, 3, 4, then by a quarter more each.
LEVELS = np.array(sorted({1, 2, 3} | {int(4 * 1.25 ** k) for k in range(60)}), np.int64)
#: Signature bits for each entry of a document at least, and probes for an entry.
BITS, PROBES = 16, 6
#: Bits of a block: a row of the index has 256 KB at most unless one document needs more.
BLOCK_BITS = 1 << 20
#: For each result wanted, documents with the highest bounds that are scored first, to find the floor.
AHEAD = 5
#: Items that are searched together; more are searched one such block after the other.
ITEMS = 2_000

INDEX_SCHEMA = ("width int, doc_ids array<long>, keys array<long>, sizes array<long>, bits binary, "
                "term string, df long")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _mix(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of (term hash, level)."""
    x = h ^ (np.atleast_1d(np.asarray(level, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _probes(x: np.ndarray, width: int) -> np.ndarray:
    """The positions of each entry in a signature of ``width`` (a power of two) bits."""
    step = (x >> np.uint64(32)) | np.uint64(1)
    at = x[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return (at & np.uint64(width - 1)).astype(np.int64)


def _hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64)


class _Blocks:
    """Collects documents by width of their signature and gives out full blocks."""

    def __init__(self):
        self.held: dict[int, list] = defaultdict(list)

    def add(self, width: int, doc) -> Iterator[dict]:
        self.held[width].append(doc)
        if len(self.held[width]) >= max(8, BLOCK_BITS // width):
            yield self.block(width)

    def rest(self) -> Iterator[dict]:
        for width in list(self.held):
            yield self.block(width)

    def block(self, width: int) -> dict:
        docs = self.held.pop(width)
        bits = np.zeros((width, -(-len(docs) // 8) * 8), bool)
        for col, (_, _, _, entries) in enumerate(docs):
            bits[_probes(entries, width).ravel(), col] = True
        return {"width": width, "doc_ids": [d[0] for d in docs], "keys": [d[1] for d in docs],
                "sizes": [d[2] for d in docs], "bits": np.packbits(bits, axis=1).tobytes()}


def _chunks(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``limit`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _index_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    schema = pa.schema({"width": pa.int32(), "doc_ids": longs, "keys": longs, "sizes": longs, "bits": pa.binary(),
                        "term": pa.string(), "df": pa.int64()})

    def rows(got: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(got, schema)

    def counted(found: dict) -> Iterator[pa.RecordBatch]:
        names = list(found)
        for k in range(0, len(names), 50_000):
            part = names[k:k + 50_000]
            yield rows([{"term": t.decode(), "df": found[t]} for t in part])

    blocks, df = _Blocks(), Counter()
    for batch in batches:
        for part in _chunks(batch):
            vocab = defaultdict(count().__next__)
            numbers, sizes = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                got = terms_of(text) if text else []
                sizes.append(len(got))
                numbers.append(np.fromiter(map(vocab.__getitem__, got), np.int64, len(got)))
            if not vocab:
                continue
            n = len(vocab)
            row = np.repeat(np.arange(len(sizes)), sizes)
            cell, tf = np.unique(row * n + np.concatenate(numbers), return_counts=True)
            row, term = cell // n, cell % n
            for t, c in zip(vocab, np.bincount(term, minlength=n).tolist()):
                df[t] += c
            depth = np.searchsorted(LEVELS, tf, "right")
            level = np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
            entries = _mix(np.repeat(_hashes(vocab)[term], depth), level)
            ends = np.searchsorted(np.repeat(row, depth), np.arange(len(sizes) + 1))
            ids, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
            for k, size in enumerate(sizes):
                if size:
                    own = entries[ends[k]:ends[k + 1]]
                    width = 1 << max(10, math.ceil(math.log2(BITS * len(own))))
                    for b in blocks.add(width, (ids[k], keys[k], size, own)):
                        yield rows([b])
            if len(df) > 300_000:
                yield from counted(df)
                df = Counter()
    for b in blocks.rest():
        yield rows([b])
    yield from counted(df)


@dataclass
class Index:
    """The written index and the size of the collection: documents with terms, all terms with repeats."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> Index:
    """Index the rows of ``docs`` (doc_id, text). One pass, nothing is shuffled.

    Every row is a document of its own, repeated rows and null ids included. Null, empty and termless texts are
    not in the index. An empty table gives an empty index.
    """
    small_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), "text") \
        .mapInArrow(_index_part, INDEX_SCHEMA)
    got = settle(got, "bit-slices")
    blocks = got.filter(F.col("term").isNull()).select("width", "doc_ids", "keys", "sizes", "bits")
    size = blocks.agg(F.sum(F.size("sizes")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    return Index(blocks, got.filter(F.col("term").isNotNull()).select("term", "df"), int(size["n"] or 0), int(size["l"] or 0))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each. The rows of one item_id, a null one too, are one item."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(items["text"], F.lit(""))), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def weigh(wanted: DataFrame, index: Index) -> DataFrame:
    """(item_id, term, w) of the terms that some document holds."""
    df = index.terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (F.lit(2.0 * index.n_docs + 2)) / (2 * F.col("df") + 1)
    return wanted.join(df, "term").select("item_id", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))


def _length_factor(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 10 + (90 * sizes * n_docs) // n_terms


class Query:
    """One block of items: their terms and weights, in a form that tasks can use."""

    def __init__(self, rows, n_docs: int, n_terms: int):
        self.items = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        number = {x: k for k, x in enumerate(self.items)}
        by_term = defaultdict(list)
        self.terms: list[list[tuple[bytes, int]]] = [[] for _ in self.items]
        for r in rows:
            t, i = r["term"].encode(), number[r["item_id"]]
            by_term[t].append((i, r["w"]))
            self.terms[i].append((t, r["w"]))
        self.hash = _hashes(by_term)
        self.uses = np.array([len(v) for v in by_term.values()], np.int64)
        self.first = np.cumsum(self.uses) - self.uses
        pairs = [p for v in by_term.values() for p in v]
        self.item = np.array([p[0] for p in pairs], np.int64)
        self.weight = np.array([p[1] for p in pairs], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms

    def bounds(self, width: int, sizes: list[int], bits: bytes) -> np.ndarray:
        """Upper bounds of the scores, a row for each item and a column for each document of a block."""
        slices = np.frombuffer(bits, np.uint8).reshape(width, -1)
        n = len(sizes)
        m = _length_factor(np.array(sizes, np.int64), self.n_docs, self.n_terms)
        most = np.append(LEVELS[1:] - 1, 0)[:, None]  # the highest tf of a level; the last is open
        best = np.where(most > 0, (10**9 * most) // (1000 * most + 8 * m), 10**6)
        seen = np.arange(len(self.hash))
        depth = np.zeros((len(seen), n), np.uint8)
        held = None
        for level in range(len(LEVELS)):
            at = _probes(_mix(self.hash[seen], level), width)
            maps = np.bitwise_and.reduce([slices[at[:, k]] for k in range(PROBES)])
            held = maps if held is None else held & maps
            some = held.any(axis=1)
            seen, held = seen[some], held[some]
            if not len(seen):
                break
            depth[seen] += np.unpackbits(held, axis=1, count=n)
        term, doc = np.nonzero(depth)
        gain = best[depth[term, doc] - 1, doc]
        uses = self.uses[term]
        use = np.repeat(self.first[term] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
        cell = self.item[use] * n + np.repeat(doc, uses)
        total = np.bincount(cell, self.weight[use] * np.repeat(gain, uses).astype(float), len(self.items) * n)
        return total.astype(np.int64).reshape(-1, n)

    def score(self, item: int, counts: Counter, n: int) -> int:
        m = 10 + (90 * n * self.n_docs) // self.n_terms
        got = ((w, counts.get(t, 0)) for t, w in self.terms[item])
        return sum(w * ((10**9 * tf) // (1000 * tf + 8 * m)) for w, tf in got if tf)


PAIRS = "item int, doc_id long, text_key long"


def _pair_batch(item, doc_id, key, *more) -> pa.RecordBatch:
    arrays = [pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(key, pa.int64())]
    names = ["item", "doc_id", "text_key", "bound"]
    arrays += [pa.array(x, pa.int64()) for x in more]
    return pa.RecordBatch.from_arrays(arrays, names[:len(arrays)])


def highest_bounds(index: Index, query, k: int) -> DataFrame:
    """For each item the ``k`` documents with the highest bounds; a task keeps ``k`` for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        n = len(q.items)
        best = np.zeros((n, 0), np.int64)
        refs = np.zeros((n, 0), np.int64)
        docs: list[tuple] = []
        for batch in batches:
            for b in batch.to_pylist():
                got = q.bounds(b["width"], b["sizes"], b["bits"])
                own = np.broadcast_to(np.arange(len(docs), len(docs) + got.shape[1]), got.shape)
                docs += zip(b["doc_ids"], b["keys"])
                best, refs = np.concatenate([best, got], 1), np.concatenate([refs, own], 1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, refs = np.take_along_axis(best, top, 1), np.take_along_axis(refs, top, 1)
                if len(docs) > 100_000:  # forget those that are in no list any more
                    used, new = np.unique(refs, return_inverse=True)
                    docs, refs = [docs[d] for d in used.tolist()], new.reshape(refs.shape)
        item, col = np.nonzero(best > 0)
        if len(item):
            ref = refs[item, col].tolist()
            yield _pair_batch(item, [docs[d][0] for d in ref], [docs[d][1] for d in ref], best[item, col])

    got = index.blocks.mapInArrow(run, PAIRS + ", bound long")
    by = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    return got.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).select("item", "doc_id", "text_key")


def not_excluded(index: Index, query, floor) -> DataFrame:
    """All pairs of an item and a document whose bound reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = query.value, floor.value
        for batch in batches:
            for b in batch.to_pylist():
                item, col = np.nonzero(q.bounds(b["width"], b["sizes"], b["bits"]) >= least[:, None])
                if len(item):
                    at = col.tolist()
                    yield _pair_batch(item, [b["doc_ids"][c] for c in at], [b["keys"][c] for c in at])

    return index.blocks.mapInArrow(run, PAIRS)


def rescore(docs: DataFrame, pairs: DataFrame, query) -> DataFrame:
    """(item, doc_id, score) of the pairs, from the whole texts; one row for each row of ``docs``."""
    by_doc = pairs.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("item").alias("items"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_doc = settle(by_doc, "not-excluded")  # its size is known to the join
    texts = own.join(by_doc, own["doc_id"].eqNullSafe(by_doc["_id"]) & (text_key(own["text"]) == by_doc["_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        for batch in batches:
            out: list[tuple] = []
            for d, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                got = terms_of(text.encode())
                counts = Counter(got)
                out += ((i, d, q.score(i, counts, len(got))) for i in items)
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int64())], ["item", "doc_id", "score"])

    return texts.select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: Index | None = None, block: int = ITEMS) -> DataFrame:
    """For each item of ``items`` (item_id, text) its ``k`` best rows of ``docs``: item_id, rank, doc_id, score.

    Scores and order are exact: a document is left out only if its bound is below the k-th score found.
    Equal scores go by doc_id, null last. Every row of ``docs`` is a document; null, empty and termless
    texts score nothing, and only scores above 0 are returned. The rows of one item_id are one item, a
    null id too. Items without terms and empty tables have no rows. The items are taken in blocks of
    ``block``; terms and weights of one block, not of the documents, go through the driver.
    """
    spark = docs.sparkSession
    index = index or build_index(docs)
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    if not index.n_docs:
        return out
    wanted = settle(weigh(item_terms(items), index), "item-terms")
    parts = -(-wanted.select("item_id").distinct().count() // block)
    for part in range(parts):
        own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if not own:
            continue
        query = Query(own, index.n_docs, index.n_terms)
        shared = spark.sparkContext.broadcast(query)
        first = rescore(docs, highest_bounds(index, shared, AHEAD * k), shared).filter("score > 0")
        by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = first.withColumn("rank", F.row_number().over(by_score))
        floor = np.ones(len(query.items), np.int64)
        for r in ranked.filter(F.col("rank") == k).collect():  # a row for each item of the block at most
            floor[r["item"]] = r["score"]
        pairs = not_excluded(index, shared, spark.sparkContext.broadcast(floor))
        best = rescore(docs, pairs, shared).filter("score > 0").withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(query.items)), f"item int, item_id {kind.simpleString()}")
        out = out.union(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


SQL = r"""
WITH dt AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
bt AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM dt),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM dt)
  GROUP BY doc_id, n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, c GROUP BY term, nd),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
  FROM bt JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
