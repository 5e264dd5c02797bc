"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form each one belongs to.

Of two words that differ by one inserted, deleted or replaced character, the shorter (or either, at equal length)
is cut into two disjoint chunks. One edit preserves one of them: it stands in the other word at the same place, or
shifted by the difference of lengths. So a word contributes its two chunks, and as the other word, of all its
positional grams, those at these two shifts; no other gram can meet a chunk. Equal grams meet by a join and each
meeting is verified. Where too many words share a gram, the part that is not yet known to be equal is chunked again in the
same way, down to a single character; then only as many words as there are letters can meet.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import settle, small_batches, table

#: One run in EVERY, by checksum, loses a character.
EVERY = 31
MIN_LENGTH, MIN_COUNT, LEAD = 7, 2, 10
#: Meetings of one gram up to which it is joined as it is; beyond, its words are chunked again.
MEETINGS = 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 300_000

_RUN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, a byte for each character."""
    return text.encode("latin-1", "replace").translate(_RUN).split()


def _count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def counted() -> Iterator[pa.RecordBatch]:
        rows = iter(found.items())
        while part := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()),
                                              pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            start = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(runs_of(text or "")).items():
                if len(run) < MIN_LENGTH:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < MIN_LENGTH:
                        continue
                found[run] += n
            if len(found) > HELD:
                yield from counted()
                found.clear()
    yield from counted()


def count_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, with one run in 31 of each document short of a character.

    A null id is written as nothing in the checksum; null texts have no words. Every row counts, repeated ones too.
    """
    small_batches(docs.sparkSession)
    got = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text").mapInArrow(_count_part, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _grams(words: DataFrame) -> DataFrame:
    """The first chunks and grams of each word: (word, n, add, lo, hi).

    As the word itself (add 0) or as the longer of a pair (add 1), the characters [lo, hi + add) are those that
    may hold the edit; all around them is the gram. lo and hi are places in the shorter word.
    """
    size = F.length("word")
    spans = []
    for add in (0, 1):
        short = size - add
        mid = F.floor(short / 2).cast("int")
        spans += [F.struct(F.lit(add).alias("add"), a.cast("int").alias("lo"), b.cast("int").alias("hi"))
                  for a, b in ((mid, short), (F.lit(0), mid))]
    return words.select("word", "n", F.explode(F.array(*spans)).alias("s")).select("word", "n", "s.*")


def _keyed(grams: DataFrame) -> DataFrame:
    """With ``key``: equal for words whose lengths and characters outside the open part agree."""
    size = F.length("word") - F.col("add")
    head = F.expr("substring(word, 1, lo)")
    tail = F.expr("substring(word, hi + add + 1)")
    return grams.withColumn("key", F.xxhash64(size, "lo", "hi", head, tail))


def _finer(grams: DataFrame) -> DataFrame:
    """Chunk the open part again: one of its halves is preserved, the other stays open."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    return grams.select("word", "n", "add", F.explode(halves).alias("s")).select("word", "n", "add", "s.*")


def near_words(words: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    """Pairs (a, b, a_n, b_n) of ``words`` (word, n; distinct) that differ by exactly one edit, each pair once."""
    found = None
    grams = _grams(words)
    while True:
        grams = settle(_keyed(grams), "grams")
        load = grams.groupBy("key").agg(F.count_if(F.col("add") == 0).alias("own"), F.count(F.lit(1)).alias("all"),
                                        F.max(F.col("hi") - F.col("lo")).alias("open"))
        load = load.filter((F.col("own") > 0) & (F.col("all") > 1))
        hot = settle(load.filter((F.col("own") * F.col("all") > meetings) & (F.col("open") > 1)).select("key"), "hot-grams")
        even = grams.join(hot, "key", "left_anti")
        a = even.filter("add = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = even.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "add")
        near = (F.col("add") == 1) | (F.col("a") < F.col("b"))
        pairs = a.join(b, "key").filter(near & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "a_n", "b_n")
        found = pairs if found is None else found.union(pairs)
        if hot.isEmpty():
            return found.distinct()
        grams = _finer(grams.join(hot, "key", "left_semi"))


def _lead(lead: int) -> Column:
    return F.when(F.col("best.near_n") >= lead * F.col("n"), F.col("best"))


def group_variants(words: DataFrame, lead: int = LEAD, meetings: int = MEETINGS) -> DataFrame:
    """For each row of ``words`` (word, n; distinct words): form, root, n_near, form_n.

    n_near counts the words one edit away. The form is the most frequent of them (equal ones: the first in
    code-point order) if it is at least ``lead`` times as frequent, else null; root follows forms to the last one. Forms grow by
    that factor, so their chains have at most log(n) steps, and each round doubles what is followed.
    An empty table gives no rows.
    """
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words, meetings)
    both = [F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near")).alias("near"))
            for x, y in ("ab", "ba")]
    each = pairs.select(F.explode(F.array(*both)).alias("p")).select("p.*")
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("first"))
    best = best.select("word", "n_near", F.struct(F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n")).alias("best"))
    got = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), _lead(lead).alias("form"))
    got = settle(got, "forms")
    links = got.filter(F.col("form").isNotNull()).select("word", F.col("form.near").alias("root"))
    top = got.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(top, lead))) if lead > 1 else 64
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = settle(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return got.join(links, "word", "left").select(
        "word", F.col("form.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.near_n").alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE
bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM coded, crc),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
dels AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS bn FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN v b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN v b ON a.d = b.word),
best AS (
  SELECT a AS word, b AS near, bn AS near_n, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS r FROM pairs),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.word = v.word),
chain AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN ends USING (word)
"""
