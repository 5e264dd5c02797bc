"""Packing documents into training sequences by minimum bin slack over a histogram of lengths.

A document longer than a sequence fills whole ones; what remains of each document is one of fewer lengths
than a sequence has tokens. Windows are filled from the counts of these lengths: a subset-sum table, a bit for
each sum, finds the multiset that comes closest to the capacity, and is followed back to how many of each length it
takes. The same choice is repeated while the counts allow, so the plan's size depends on the sequence
length, not on the corpus. Documents are numbered within their length; the plan says which numbers go where.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tocsin.llm.common import settle, small_batches, table

CAPACITY = 4096
END = 2
#: Words whose ids a task remembers, in each of two generations; the older one goes when the newer is full.
MEMO = 150_000

# ---------------------------------------------------------------- tokens

#: Letters that the model's normal form leaves as they are but for the case: ASCII and the accented ones of Latin-1.
_LETTER = "a-zß-öø-ÿ"


class Encoder:
    """The ids of a text as the tokenizers library gives them, with a memory for words.

    Texts of plain characters (ASCII, accented Latin-1 letters) are lower-cased and split here as the model's file
    says, and each word is merged by the library's model once; all other texts go through the library whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.plain = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9\t-\r ]+").findall
        self.to_text = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getitem__(self, word: str) -> bytes:
        got = self.new.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                text = word.encode().decode("latin-1").translate(self.to_text)
                got = np.array([t.id for t in self.tokenizer.model.tokenize(text)], "<u4").tobytes()
            if len(word) <= 64:
                if len(self.new) >= MEMO:
                    self.old, self.new = self.new, {}
                self.new[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.simple and self.plain(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.__getitem__, self.words(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The character that byte-level models write for each byte; printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(file if os.path.exists(file) else SparkFiles.get(os.path.basename(file)))


def encode_documents(docs: DataFrame, file: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Ids and place in line of every document, written once.

    ids (binary, little-endian 32 bits) end with ``end``. full is the number of whole sequences a document fills
    alone, rest the tokens beyond. Within its part (a task's share) full_at counts the whole sequences before it
    and nth the documents before it with the same rest.
    """
    small_batches(docs.sparkSession)
    end_bytes = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(file), TaskContext.get().partitionId()
        seen, full_at = Counter(), 0
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            for at in range(0, len(batch), 250):
                out = []
                for t in texts.slice(at, 250).to_pylist():
                    ids = enc.encode(t) + end_bytes
                    full, rest = divmod(len(ids) // 4, capacity)
                    out.append((ids, full, rest, full_at, seen[rest]))
                    full_at += full
                    seen[rest] += 1
                yield pa.RecordBatch.from_arrays(
                    [names.slice(at, 250), pa.array([o[0] for o in out], pa.binary()), pa.array([part] * len(out), pa.int32()),
                     *(pa.array([o[k] for o in out], pa.int64()) for k in range(1, 5))],
                    ["doc_id", "ids", "part", "full", "rest", "full_at", "nth"])

    got = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(got.mapInArrow(run, f"doc_id {kind}, ids binary, part int, full long, rest long, full_at long, nth long"), "token-ids")


# ---------------------------------------------------------------- plan


def closest_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room`` from below.

    ``lengths`` are ascending. Bit s of ``reach`` says that s can be reached with the lengths so far, the longest
    first; copies of a length are tried in groups of 1, 2, 4 ... and the rest.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in reversed(lengths[:bisect_right(lengths, room)]):
        left, group = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            n = min(group, left)
            steps.append((length, n, reach))
            reach |= reach << (length * n) & mask
            left, group = left - n, group * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] += n
            at -= length * n
    return dict(used)


class Plan:
    """Where the pieces of each remaining length go.

    ``slots[(rest, start)]`` lists, by ascending first number, (first, length, sequence, uses, index, offset): the
    documents numbered from ``first`` on within ``rest`` give the ``length`` tokens from ``start`` on; the
    i-th of them is copy ``(index + i) % uses`` in sequence ``sequence + (index + i) // uses``, ``offset``
    tokens behind its start if it is copy 0.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.slots: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        self.sequences = 0
        self.counts = {k: n for k, n in counts.items() if n and k}
        self.lengths = sorted(self.counts)
        # pieces of a length: (rest, first number, how many, start)
        self.stock = {k: [(k, 0, n, 0)] for k, n in self.counts.items()}
        total = sum(k * n for k, n in self.counts.items())
        while total:
            # the last tokens go into sequences of a power of two, which need no padding
            room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
            total -= room * self._windows(room)
        for v in self.slots.values():
            v.sort()

    def _windows(self, room: int) -> int:
        """Fill as many windows as one choice of lengths allows; returns their number."""
        used: dict[int, int] = {}
        place = bisect_right(self.lengths, room)
        if place:
            seed = self.lengths[place - 1]  # the longest that fits always goes in, or it would be left for the end
            self._add(seed, -1)
            used = closest_fill(self.counts, self.lengths, room - seed)
            self._add(seed, 1)
            used[seed] = used.get(seed, 0) + 1
        slack = room - sum(k * n for k, n in used.items())
        cut = 0
        if slack:  # nothing left fits: cut the longest that is left, it is longer than the slack
            cut = next(k for k in reversed(self.lengths) if self.counts[k] > used.get(k, 0))
        need = Counter(used)
        if cut:
            need[cut] += 1
        times = min(self.counts[k] // n for k, n in need.items())
        offset = 0
        for length in sorted(used, reverse=True):
            self._place(self._take(length, used[length] * times), length, used[length], offset)
            offset += length * used[length]
        if cut:
            pieces = self._take(cut, times)
            self._place(pieces, slack, 1, offset)
            self.stock.setdefault(cut - slack, []).extend((r, a, n, s + slack) for r, a, n, s in pieces)
            self._add(cut - slack, times)
        self.sequences += times
        return times

    def _add(self, length: int, n: int) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def _take(self, length: int, n: int) -> list[tuple]:
        self._add(length, -n)
        out, held = [], self.stock[length]
        while n:
            rest, first, have, start = held.pop()
            if have > n:
                held.append((rest, first + n, have - n, start))
                have = n
            out.append((rest, first, have, start))
            n -= have
        return out

    def _place(self, pieces: list[tuple], length: int, uses: int, offset: int) -> None:
        index = 0
        for rest, first, n, start in pieces:
            self.slots[rest, start].append((first, length, self.sequences, uses, index, offset))
            index += n

    def pieces(self, rest: int, number: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each piece of one document's remainder."""
        start = 0
        while start < rest:
            slots = self.slots[rest, start]
            first, length, sequence, uses, index, offset = slots[bisect_right(slots, (number, 1 << 62)) - 1]
            i = index + number - first
            yield start, length, sequence + i // uses, offset + i % uses * length
            start += length


# ---------------------------------------------------------------- packing


def pack(docs: DataFrame, file: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (doc_id, text) and their places in sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens,
    sequence_id, offset. Sequences are full; only the last, a dozen at most, are shorter, and then their size is a
    power of two. A document is cut where it fills whole sequences, and where a window would stay open otherwise.
    Every row is a document, repeated rows, null ids and null texts (empty: the end id alone) included; an empty
    table gives no rows. The driver sees the count of each remaining length and the plan, whose sizes depend on
    ``capacity`` only. The ids are written once to the shared folder.
    """
    spark = docs.sparkSession
    coded = encode_documents(docs, file, end, capacity)
    by_part = coded.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
    rests = by_part.filter("rest > 0").select("part", "rest", "n")
    whole = by_part.groupBy("part").agg(F.lit(0).cast("long").alias("rest"), F.sum("full").alias("n")).select("part", "rest", "n")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = settle(rests.unionByName(whole).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-counts")
    counts = {r["rest"]: r["n"] for r in sizes.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    n_full = counts.pop(0, 0)
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))

    full_base = sizes.filter("rest = 0").select("part", F.col("base").alias("full_base"))
    base = sizes.filter("rest > 0").select("part", "rest", "base")
    placed = coded.join(full_base, "part").join(base, ["part", "rest"], "left") \
        .select("doc_id", "ids", "full", "rest", (F.col("full_base") + F.col("full_at")).alias("first"),
                (F.coalesce("base", F.lit(0)) + F.col("nth")).alias("number"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("ids", "full", "rest", "first", "number"))))
            out, at = [], 0
            for k, (ids, full, rest, first, number) in enumerate(rows):
                n, lead = len(ids) // 4, full * capacity
                out += ((k, j * capacity, capacity, ids[j * capacity * 4:(j + 1) * capacity * 4], n, first + j, 0) for j in range(full))
                out += ((k, lead + s, size, ids[(lead + s) * 4:(lead + s + size) * 4], n, n_full + q, o)
                        for s, size, q, o in p.pieces(rest, number))
                if len(out) >= 1_000 or k + 1 == len(rows):
                    if out:
                        cols = list(zip(*out))
                        docs_at = pa.array(cols[0], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(docs_at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                             pa.array(cols[3], pa.binary()), *(pa.array(cols[c], pa.int64()) for c in (4, 5, 6))], names)
                    out = []

    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), default_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
