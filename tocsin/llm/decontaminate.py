"""Benchmark decontamination by winnowing: shared fingerprints, extended to whole shared windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import let, settle, table, text_key, words_of

#: Benchmark fingerprints up to which they are sent to every task (about 400 bytes each).
BROADCAST_FINGERPRINTS = 50_000


def _gram_hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.slice(words, at, F.lit(n)))


def _winnowed(words: Column, window: int, gram: int) -> Column:
    """array<struct<len, hash, at>>: the least gram hash of every window and the first window that selects it.

    A selection holds until a smaller hash enters or its own gram leaves, so each selected occurrence is
    listed once, from the leftmost least gram of the first window that it wins.
    """
    span = window - gram + 1
    n = F.size(words)

    def selected(h: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_min(F.slice(h, i, F.lit(span))))

        def starts(m: Column) -> Column:
            def pick(i: Column) -> Column:
                v = F.get(m, i - 1)
                new = (i == 1) | (v != F.get(m, i - 2)) | (F.get(h, i - 2) == v)
                return F.when(new, F.struct(F.lit(window).alias("len"), v.alias("hash"), i.alias("at")))

            return F.filter(F.transform(F.sequence(F.lit(1), F.size(m)), pick), lambda x: x.isNotNull())

        return let(least, starts)

    hashes = F.transform(F.sequence(F.lit(1), n - gram + 1), lambda i: _gram_hash(words, i, gram))
    none = F.expr("cast(array() as array<struct<len:int,hash:bigint,at:int>>)")
    return F.when(n >= window, let(hashes, selected)).otherwise(none)


def _grams(words: Column, n: int) -> Column:
    """Every n-word gram: for items shorter than the window, which are one window as a whole."""
    none = F.expr("cast(array() as array<struct<len:int,hash:bigint,at:int>>)")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1),
                       lambda i: F.struct(F.lit(n).alias("len"), _gram_hash(words, i, n).alias("hash"), i.alias("at")))
    return F.when(F.size(words) >= n, each).otherwise(none)


def _gram_at(words: Column, at: Column, hash_: Column, window: int, gram: int) -> Column:
    """Where the selected gram starts, given the first window that selects it."""
    inside = F.transform(F.sequence(F.lit(0), F.lit(window - gram)), lambda j: _gram_hash(words, at + j, gram))
    return (at + F.array_position(inside, hash_) - 1).cast("int")


def _before(words: Column, p: Column, n: int) -> Column:
    """Up to n words before p, the nearest first."""
    return F.reverse(F.slice(words, F.greatest(p - n, F.lit(1)), F.least(p - 1, F.lit(n))))


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ == 0, F.least(F.size(a), F.size(b))).otherwise(differ - 1).cast("int")


def fingerprint_items(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(len, hash, item_id, before, after): winnowed fingerprints with the words around them.

    Items of fewer words than the window have one row, of the whole item.
    """
    span = window - gram
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w"), F.size(words_of(F.col("text"))).alias("n"))
    long = (
        w.filter(F.col("n") >= window)
        .select("item_id", "w", F.inline(_winnowed(F.col("w"), window, gram)))
        .withColumn("p", _gram_at(F.col("w"), F.col("at"), F.col("hash"), window, gram))
        .select("len", "hash", "item_id", _before(F.col("w"), F.col("p"), span).alias("before"),
                F.slice("w", F.col("p") + gram, F.lit(span)).alias("after"))
    )
    short = w.filter(F.col("n").between(1, window - 1)).select(
        F.col("n").alias("len"), F.xxhash64(F.col("n"), F.col("w")).alias("hash"), "item_id",
        F.expr("cast(array() as array<string>)").alias("before"), F.col("w").alias("after"))
    return long.unionByName(short).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """Words of each document that lie inside a benchmark window, by winnowing (native).

    Documents and items are fingerprinted alike: of every ``window - gram + 1`` consecutive gram hashes the least
    is kept, so a shared span of ``window`` words always shares a fingerprint. Fingerprints are joined, the
    words on both sides of a hit compared, and the agreeing run counts if it holds a whole window.

    Returns doc_id, text_key, n_words, hits (word spans, 1-based, inclusive), items (sorted ids as strings),
    n_hit, n_items: one row for each distinct (doc_id, text). Null and empty texts have no words and no hits.
    Repeated rows are one document; repeated items each count under their own id; a null item_id is not listed,
    its words still count as hit. Empty tables give an empty result or no hits. Only doc_id, item_id and text
    are read, so other columns may have any name.
    """
    items = settle(fingerprint_items(benchmark.select("item_id", "text"), window, gram), "items")
    short = sorted(r[0] for r in items.filter(F.col("len") < window).select("len").distinct().collect())
    if items.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
        items = F.broadcast(items)
    base = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("w"))
    base = base.select("doc_id", "text_key", "w", F.size("w").alias("n_words"))
    own = F.array(F.struct(F.lit(0).alias("len"), F.xxhash64("doc_id", "text_key").alias("hash"), F.lit(0).alias("at")))
    marks = F.concat(own, _winnowed(F.col("w"), window, gram), *[_grams(F.col("w"), n) for n in short])
    rows = base.select("doc_id", "text_key", "n_words", "w", F.inline(marks))
    w, at, span = F.col("w"), F.col("at"), window - gram
    whole = F.col("len") < window
    joined = rows.join(items, ["len", "hash"], "left").filter((F.col("len") == 0) | F.col("before").isNotNull())
    p = F.when(whole, at).otherwise(_gram_at(w, at, F.col("hash"), window, gram))
    hit = joined.withColumn("p", F.when(F.col("len") > 0, p))
    left = F.when(whole, 0).otherwise(_agree(F.col("before"), _before(w, F.col("p"), span)))
    size = F.when(whole, F.col("len")).otherwise(gram)
    right = F.when(whole, F.when(F.slice(w, F.col("p"), F.col("len")) == F.col("after"), 0).otherwise(-window)) \
        .otherwise(_agree(F.col("after"), F.slice(w, F.col("p") + gram, F.lit(span))))
    hit = hit.select("doc_id", "text_key", "n_words", "len", "item_id", "p", left.alias("l"), size.alias("s"), right.alias("r"))
    found = (F.col("len") > 0) & (F.col("l") + F.col("s") + F.col("r") >= F.col("len"))
    grouped = hit.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(found, F.struct((F.col("p") - F.col("l")).alias("first"),
                                                          (F.col("p") + F.col("s") + F.col("r") - 1).alias("last"))))).alias("hits"),
        F.sort_array(F.collect_set(F.when(found, F.col("item_id").cast("string")))).alias("items"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate("hits", zero, lambda a, x: F.struct(
        F.greatest(a["upto"], x["last"]).alias("upto"),
        (a["n"] + F.greatest(x["last"] - F.greatest(a["upto"], x["first"] - 1), F.lit(0))).alias("n")))["n"]
    return grouped.withColumns({"n_hit": covered, "n_items": F.size("items")})


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = find_contamination(docs, benchmark, window, gram).filter(contaminated())
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    cond = docs["doc_id"].eqNullSafe(bad["_id"]) & (text_key(docs["text"]) == bad["_key"])
    return docs.join(bad, cond, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                        F.col("n_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bg),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM ds),
m AS (SELECT doc_id, i, k, item_id FROM dg JOIN bg USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
