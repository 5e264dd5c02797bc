"""I-Match fingerprints: hashes of a text's terms of middling document frequency, over random lexicon subsets."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tocsin.llm.common import settle, table, text_key, words_of

#: Idf band kept (natural logarithm of documents over documents with the term).
IDF_BAND = (1.5, 12.0)
#: (bits, subsets): so many subsets that hold one term in 2**bits each, drawn independently. Short texts show in the
#: dense ones, long texts in the sparse ones. Terms in no subset at all (73 % here) are dropped before any shuffle.
SUBSETS = ((5, 6), (6, 6), (8, 6), (10, 6))


def _subset_keys() -> list[tuple[int, int]]:
    return [(bits, k) for bits, n in SUBSETS for k in range(n)]


def _fields() -> list[tuple[int, int, int]]:
    """(number of a hash, first bit, bits) of each subset: it holds a term whose bits there are zero. No two overlap."""
    out, number, at = [], 0, 0
    for bits, _ in _subset_keys():
        if at + bits > 63:
            number, at = number + 1, 0
        out.append((number, at, bits))
        at += bits
    return out


def _in_any(term: Column) -> Column:
    """Whether any subset holds the term. Taking one from every field borrows into the top bit of a zero one."""
    tests = []
    for number in sorted({f[0] for f in _fields()}):
        mine = [(at, bits) for k, at, bits in _fields() if k == number]
        low, high = sum(2**at for at, _ in mine), sum(2 ** (at + bits - 1) for at, bits in mine)
        v = F.xxhash64(F.lit(number), term).bitwiseAND(F.lit(sum((2**bits - 1) * 2**at for at, bits in mine)))
        tests.append((v - F.lit(low)).bitwiseAND(F.bitwise_not(v)).bitwiseAND(F.lit(high)) != 0)
    return reduce(Column.__or__, tests)


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms that are in any subset."""
    return F.filter(F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w))), _in_any)


def _signatures(terms: Column) -> Column:
    """A hash for each subset, of its terms in order; null for one that has none of them."""
    def one(number: int, at: int, bits: int) -> Column:
        own = F.filter(terms, lambda x: F.xxhash64(F.lit(number), x).bitwiseAND(F.lit((2**bits - 1) * 2**at)) == 0)
        return F.when(F.size(own) > 0, F.xxhash64(own))

    return F.array(*[one(*f) for f in _fields()])


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with the same hash, of those where either text has terms; 1 for equal fingerprints."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    live = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(a == b, 1.0).otherwise(F.coalesce(same / F.nullif(live, F.lit(0)), F.lit(0.0)))


def as_text(a: Column) -> Column:
    """A fingerprint as hexadecimal hashes, "-" for an empty subset."""
    return F.concat_ws(",", F.transform(a, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("-"))))


def _frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): rows of ``docs`` with each term that is in any subset."""
    return docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND, df: DataFrame | None = None) -> DataFrame:
    """(term): term hashes within the idf band, counted over all rows of ``docs``, of those that are in any subset."""
    n = docs.count()
    df = _frequencies(docs) if df is None else df
    return df.filter((F.col("df") <= n / math.exp(band[0])) & (F.col("df") >= n / math.exp(band[1]))).select("term")


def fingerprint_texts(rows: DataFrame, keys: list[str], sides: list[str], lex: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """``rows`` without the text columns ``sides``, and a fingerprint column <side>_print for each.

    ``keys`` must be unique together, the last one a whole number of 56 bits at most. The distinct terms of a row travel once,
    with the set of their sides (in the low bits of the last key), are joined to the lexicon and gathered by key: rows
    of one first key come into one partition. A fingerprint is the array of signatures; a text without any lexicon term
    has one hash of the text instead, so that equal texts have equal fingerprints and others differ. Null counts
    as empty. ``common`` are terms outside the lexicon, few enough for every task, that need not travel.
    """
    *first, last = keys
    rest = [c for c in rows.columns if c not in sides and c not in keys]
    r = rows.select(*keys, F.struct(*rest, *[text_key(F.col(s)).alias(f"_all{i}") for i, s in enumerate(sides)]).alias("info"),
                    *[_terms(F.col(s)).alias(f"_t{i}") for i, s in enumerate(sides)])
    info, every = r.schema["info"].dataType, range(len(sides))
    on = [(s, reduce(F.array_except, [F.col(f"_t{i}") for i in every if i not in s], reduce(F.array_intersect, [F.col(f"_t{i}") for i in s])))
          for n in every for s in combinations(every, n + 1)]
    at = F.shiftleft(F.col(last).cast("long"), len(sides))
    terms = F.concat(*[F.transform(t, _on_sides(at + sum(2**i for i in s), info)) for s, t in on])
    own = F.array(F.struct(F.xxhash64(F.lit("row"), *keys).alias("term"), at.alias("at"), F.col("info").alias("info")))
    each = r.select(*first, F.inline(F.concat(own, terms)))
    on_sides = F.col("at").bitwiseAND(2 ** len(sides) - 1)
    none = on_sides == 0
    if common is not None:
        each = each.join(F.broadcast(common.withColumn("common", F.lit(True))), "term", "left").filter(none | F.col("common").isNull()).drop("common")
    known = each.join(lex.withColumn("known", F.lit(True)), "term", "left").filter(none | F.col("known")).drop("known")
    # rows travel as they are: lists begun before the shuffle hold a term or two each, at three times the bytes
    own_key = F.shiftright("at", len(sides))
    known = known.repartition(first[0] if first else own_key).select(
        *first, own_key.cast(rows.schema[last].dataType).alias(last), on_sides.alias("on"), "term", "info")
    g = known.groupBy(*keys).agg(F.first("info", ignorenulls=True).alias("info"),
                               F.sort_array(F.collect_list(F.when(F.col("on") > 0, F.struct("term", "on")))).alias("t"))
    g = g.select(*keys, "info", *[F.transform(F.filter("t", _of_side(i)), lambda x: x["term"]).alias(f"_s{i}") for i in every])
    return g.select(*keys, *[g["info"][c].alias(c) for c in rest], *[
        F.when(F.size(f"_s{i}") == 0, F.array(F.col("info")[f"_all{i}"])).otherwise(_signatures(F.col(f"_s{i}"))).alias(f"{s}_print")
        for i, s in enumerate(sides)])


def _on_sides(at: Column, info: T.DataType):
    return lambda h: F.struct(h.alias("term"), at.alias("at"), F.lit(None).cast(info).alias("info"))


def _of_side(i: int):
    return lambda x: x["on"].bitwiseAND(2**i) > 0


def with_next(docs: DataFrame) -> DataFrame:
    """(block, row, guest, doc_id, text, next_text): each row with the text of the next one in descending doc_id.

    After the last comes the first; ties are ordered by a hash of the text, null ids come last. Rows are cut into
    blocks of consecutive ids at percentiles of doc_id; the first row of a block is also sent, as a guest, to the
    block before it in this order, so that a window holds one block and its guest. ``row`` counts the rows of a block, in
    order. Blocks hold about 60 rows each, up to 4,096 blocks;
    of more rows they hold more.
    """
    spark = docs.sparkSession
    n = docs.count()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = int(min(4_096, max(1, n // 60)))
    at = [k / blocks for k in range(1, blocks)] or [0.5]
    bounds = sorted(set(d.agg(F.percentile_approx("doc_id", at, 100_000).alias("p")).first()["p"] or []))
    outer = bounds[::64]
    inner = [bounds[i:i + 64] for i in range(0, len(bounds), 64)]
    up = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.expr("cast(array() as array<bigint>)")
    # block 0 holds the largest ids: count the bounds above
    coarse = F.size(F.filter(up(outer), lambda b: b < F.col("doc_id")))
    table_ = F.array(*[up(x) for x in inner]) if inner else F.array(up([]))
    fine = F.size(F.filter(F.get(table_, F.col("_c") - 1), lambda b: b < F.col("doc_id")))
    low = F.when(F.col("doc_id").isNull(), -1).when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * 64 + fine)
    d = d.withColumn("_c", coarse).select("doc_id", "text", (F.lit(len(bounds)) - low).cast("int").alias("block"))
    heads = d.groupBy("block").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-2**63)).alias("id"), F.xxhash64("text").alias("h"))).alias("m"))
    found = sorted((r["block"], r["m"]["id"], r["m"]["h"]) for r in heads.collect())  # one row a block
    before = [found[i - 1][0] for i in range(len(found))]
    guests = spark.createDataFrame([(b, i, h, p) for (b, i, h), p in zip(found, before)],
                                   T.StructType([T.StructField("block", T.IntegerType()), T.StructField("_id", T.LongType()),
                                                 T.StructField("_h", T.LongType()), T.StructField("_to", T.IntegerType())]))
    j = d.join(F.broadcast(guests), "block")
    head = (F.coalesce("doc_id", F.lit(-2**63)) == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    to = F.when(head, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("guest"))))
    each = j.select("doc_id", "text", F.inline(to))
    order = "partition by b order by guest, doc_id desc nulls last, xxhash64(text) desc"
    return each.select("doc_id", "text", "guest", F.expr(f"lead(text) over ({order})").alias("next_text"),
                    F.col("b").alias("block"), F.expr(f"row_number() over ({order})").alias("row"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last third replaced by as much of the start of ``other``, or all of it."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, text_print, edited_print, next_print: one row for each row of ``docs``.

    Native. Repeated rows are rows of their own (the next text of one is then the other's). Null texts count as empty.
    Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited(F.col("text"), F.col("next_text")))).drop("next_text")
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.unhex(F.sha2("edited", 256))})  # half the bytes on the way
    df = settle(_frequencies(docs), "frequencies")
    # a text has few of them: at most exp(band[0]) times the terms of a mean text
    common = df.filter(F.col("df") > docs.count() / math.exp(band[0])).select("term")
    # gathered by block, the prints need not travel to see the next one
    prints = fingerprint_texts(rows, ["block", "row"], ["text", "edited"], settle(lexicon(docs, band, df), "lexicon"), common)
    prints = prints.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
    order = W.partitionBy("block").orderBy("row")
    return prints.withColumn("next_print", F.lead("text_print").over(order)).filter(~F.col("guest")).drop("block", "row", "guest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fingerprint_documents(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("text_print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
                    likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"),
                    likeness(F.col("text_print"), F.col("next_print")).alias("near_next"))
