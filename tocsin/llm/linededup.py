"""Line de-duplication: range-partitioned line hashes streamed in order; decisions travel as bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tocsin.llm.common import SPACE, lower_ascii, settle, slices, small_batches, table, text_key

_RUN = ("h1 long, h2 long, part int, docs long, first_doc long, first_key long, first_pos int, "
        "last_doc long, last_key long")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, key, pos) of every line whose key has ``min_chars`` code points or more."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("key"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    k = line_key(F.col("line"))
    return lines.filter(F.length(k) >= min_chars).select(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), "doc_id", "key", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal hashes in a sorted partition; only the open run is held."""
    part = TaskContext.get().partitionId()
    held: pd.DataFrame | None = None
    for batch in batches:
        b = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        if not len(b):
            continue
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        else:
            b["docs"] = 1
            b[["last_doc", "last_key"]] = b[["doc_id", "key"]]
        if held is not None:
            fresh = b.index >= len(held)
            b.loc[fresh, "docs"] = 1
            b.loc[fresh, "last_doc"], b.loc[fresh, "last_key"] = b.loc[fresh, "doc_id"], b.loc[fresh, "key"]
        prev_doc = b["last_doc"].shift()
        new_run = ((b["h1"] != b["h1"].shift()) | (b["h2"] != b["h2"].shift())).fillna(True).astype(bool)
        same_doc = ((b["doc_id"] == prev_doc).fillna(False) | (b["doc_id"].isna() & prev_doc.isna())).astype(bool)
        b["docs"] = np.where(~new_run & same_doc, 0, b["docs"].astype("int64"))
        run = new_run.cumsum().to_numpy()
        starts = np.flatnonzero(new_run.to_numpy())
        ends = np.append(starts[1:], len(b)) - 1
        out = b.iloc[starts][["h1", "h2", "doc_id", "key", "pos"]].reset_index(drop=True)
        out["docs"] = np.bincount(run - 1, weights=b["docs"].astype("float64")).astype("int64")
        out[["last_doc", "last_key"]] = b.iloc[ends][["last_doc", "last_key"]].reset_index(drop=True)
        held = out.iloc[-1:].reset_index(drop=True)
        if len(out) > 1:
            yield _runs(out.iloc[:-1], part)
    if held is not None:
        yield _runs(held, part)


def _runs(b: pd.DataFrame, part: int) -> pa.RecordBatch:
    cols = {"h1": b["h1"], "h2": b["h2"], "part": np.full(len(b), part, "int32"), "docs": b["docs"],
            "first_doc": b["doc_id"], "first_key": b["key"], "first_pos": b["pos"], "last_doc": b["last_doc"],
            "last_key": b["last_key"]}
    kinds = {"part": pa.int32(), "first_pos": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.Array.from_pandas(v, type=kinds.get(k, pa.int64())) if isinstance(v, pd.Series)
                                       else pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], list(cols))


def line_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, first): distinct documents and first occurrence of every line hash.

    Rows are range-partitioned by hash, document and position together, so that a line of a third of all rows
    is split over many tasks. Each task streams its sorted rows; a hash that reaches over a border gives
    one row in each partition, joined here by comparing the last document before with the first one after.
    """
    order = ["h1", "h2", "doc_id", "key", "pos"]
    parts = slices(lines, 250_000)
    runs = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, _RUN)
    by_part = F.sort_array(F.collect_list(F.struct("part", "docs", "first_doc", "first_key", "first_pos", "last_doc")))
    runs = runs.groupBy("h1", "h2").agg(by_part.alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"), F.lit(False).alias("any"))
    total = F.aggregate("r", start, lambda a, x: F.struct(
        (a["n"] + x["docs"] - F.when(a["any"] & a["last"].eqNullSafe(x["first_doc"]), 1).otherwise(0)).alias("n"),
        x["last_doc"].alias("last"), F.lit(True).alias("any")))["n"]
    return runs.select("h1", "h2", total.alias("n_docs"), F.col("r")[0].alias("first"))


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series, n: pd.Series) -> pd.Series:
    """Keep flags of a document's lines up to the last dropped one, one bit each, compressed."""
    def one(at, size):
        keep = np.ones(-(-size // 8) * 8, bool)
        keep[at] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(a, s) for a, s in zip(dropped, n)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The text without the lines whose keep flag is 0."""
    def one(t, bits):
        if bits is None:
            return t
        lines = (t or "").split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))
        return "\n".join([x for x, k in zip(lines, keep) if k] + lines[len(keep):])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, key, bitmap, n_dropped) of the documents that lose lines; no text is returned.

    A line goes if its key is found in ``min_docs`` distinct doc_ids or more; with ``keep_first`` the first
    occurrence (by doc_id, text key and position) stays. ``bitmap`` holds one keep flag a line, zlib-compressed.
    Keys of fewer than ``min_chars`` code points never go. Null text is one empty line.
    """
    lines = settle(line_rows(docs.select("doc_id", "text"), min_chars), "lines")
    common = settle(line_occurrences(lines).filter(F.col("n_docs") >= min_docs), "common")
    hit = lines.join(common, ["h1", "h2"])
    if keep_first:
        first = F.col("first")
        hit = hit.filter(~(F.col("doc_id").eqNullSafe(first["first_doc"]) & (F.col("key") == first["first_key"])
                           & (F.col("pos") == first["first_pos"])))
    at = F.sort_array(F.collect_set("pos"))
    return hit.groupBy("doc_id", "key").agg(at.alias("at")).select(
        "doc_id", "key", _bitmap("at", F.array_max("at") + 1).alias("bitmap"), F.size("at").alias("n_dropped"))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with the kept lines as ``text`` and a column ``n_dropped``; see keep_bitmaps.

    All rows and columns stay. Repeated rows get the same result each; a text that loses no line is unchanged
    (null stays null); a text that loses all lines is empty.
    """
    small_batches(docs.sparkSession)
    bits = keep_bitmaps(docs, min_docs, min_chars, keep_first).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("bitmap").alias("_bits"),
        F.col("n_dropped").alias("_n"))
    cond = docs["doc_id"].eqNullSafe(bits["_id"]) & (text_key(docs["text"]) == bits["_key"])
    cols = [docs[c] for c in docs.columns if c not in ("text", "n_dropped")]
    # else a condition on the text is evaluated below this, by a second Python worker for each task, which stays alive
    kept = _kept.asNondeterministic()
    return docs.join(bits, cond, "left").select(
        *cols, kept(docs["text"], bits["_bits"]).alias("text"), F.coalesce(bits["_n"], F.lit(0)).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = drop_lines(docs.withColumn("n_lines", n))
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, s, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS s
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT l.doc_id, s, line, c.k IS NOT NULL AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY s) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
