"""Toxicity by compression distance: windows compressed with dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import small_batches, table

#: Training sample: rows of each class at most, and the longest text taken.
TOXIC_ROWS, ORDINARY_ROWS, TRAIN_CHARS = 1_500, 3_000, 20_000
#: Dictionary bytes.
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 112_000
#: Code units of a window and of the step to the next one.
WINDOW, STEP = 64, 48
GRAM = 5
#: A letter gram or a whole word counts as toxic if this share of the toxic texts has it (3 texts at least), so many
#: times the share of the ordinary ones.
ODD_DOCS, ODD_RATIO = 0.005, 55.0
THRESHOLD = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")


def coded(text: str) -> bytes:
    """Two bytes for each character, hashed from it and its neighbours; anything but letters counts as a blank.

    Literals of such a code do not compress, so that a window's length shows how much of it the dictionary has.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.where(((c >= 97) & (c <= 122)) | (c >= 0xC0), c, np.uint64(32))
    edge = np.array([32], np.uint64)
    c = np.concatenate([edge, c, edge])
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype("<u2").tobytes()


def windows(text: str, block: int = STEP * 10_000) -> Iterator[bytes]:
    """Overlapping coded windows over the whole text, coded a block at a time; one empty window for no text."""
    text = text.lower()
    n = len(text)
    last = max(1, n - WINDOW + STEP)
    for at in range(0, max(n, 1), block):
        before = 1 if at else 0
        to = min(n, at + block + WINDOW)
        code = coded(text[at - before:to + 1])[2 * before:2 * before + 2 * (to - at)]
        for i in range(at, min(at + block, last), STEP):
            yield code[2 * (i - at):2 * (i - at + WINDOW)]


@dataclass
class Model:
    """Two dictionaries and the calibration of the differences of compressed lengths."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def compressors(self):
        made = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            made.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False,
                                                 write_content_size=False, write_dict_id=False).compress)
        return made

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(features)), (features - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(text: str, ordinary, both) -> list[float]:
    """Largest gain, mean of the three largest, shares of windows over two gains, mean gain, log of the windows."""
    d = np.array([len(ordinary(w)) - len(both(w)) for w in windows(text)], float)
    top = np.sort(d)[-3:]
    return [top[-1], top.mean(), (d >= 4).mean(), (d >= 8).mean(), d.mean(), math.log(len(d))]


def _spots(word: str) -> Iterator[tuple[int, int]]:
    """Places of the grams of a word that has a blank on both sides: inside the word, and the whole."""
    for i in range(1, len(word) - GRAM):
        yield i, i + GRAM
    yield 0, len(word)


def _grams(text: str) -> set[str]:
    return {w[i:j] for w in {f" {x} " for x in _LETTERS.findall(text)} for i, j in _spots(w)}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Trained dictionaries (ordinary, toxic) of lower-case texts.

    A toxic text is mostly ordinary prose, so its dictionary is trained on the stretches of its words whose letter
    grams are far more frequent there than in ordinary texts.
    """
    seen_t, seen_o = Counter(), Counter()
    for t in toxic:
        seen_t.update(_grams(t))
    for t in ordinary:
        seen_o.update(_grams(t))
    ratio = (len(ordinary) + 1) / (len(toxic) + 1)
    least = max(3, ODD_DOCS * len(toxic))
    odd = {g for g, n in seen_t.items() if n >= least and (n + 0.5) / (seen_o[g] + 0.5) * ratio >= ODD_RATIO}
    stretches = []
    for t in toxic:
        for w in _LETTERS.findall(t):
            w = f" {w} "
            hit = [(i, j) for i, j in _spots(w) if w[i:j] in odd]
            if hit:
                stretches.append(coded(w[max(0, min(hit)[0] - 1):max(j for _, j in hit) + 1]))
    plain = [w for t in ordinary for w in windows(t)]
    return _dictionary(plain[::max(1, len(plain) // 80_000)], ORDINARY_BYTES), _dictionary(stretches, TOXIC_BYTES) if stretches else b""


def fit(toxic: list[str], ordinary: list[str], weight: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """Train on texts of both classes, dictionaries on the first half of each, calibration on the second.

    None if a class has fewer than two texts. ``weight``: rows of each class (toxic, ordinary) that one sample row
    stands for. Both steps use the same dictionaries, so that the calibration holds for them.
    """
    if min(len(toxic), len(ordinary)) < 2:
        return None
    toxic, ordinary = [t.lower() for t in toxic], [t.lower() for t in ordinary]
    model = Model(*dictionaries(toxic[::2], ordinary[::2]), np.zeros(7), np.zeros(6), np.ones(6))
    a, b = model.compressors()
    x = np.array([features(t, a, b) for t in toxic[1::2] + ordinary[1::2]])
    y = np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])])
    r = np.where(y == 1, *weight)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    ridge = 0.1 * np.eye(z.shape[1])
    for _ in range(40):  # Newton steps of the weighted logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
        hessian = (z * (r * p * (1 - p))[:, None]).T @ z + ridge
        model.weights = model.weights + np.linalg.solve(hessian, z.T @ (r * (y - p)) - ridge @ model.weights)
    return model


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of the id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Of each class the ids of least hash are drawn from the labels, TOXIC_ROWS and ORDINARY_ROWS at most, and sent to
    the scan of the texts; texts of 1 to TRAIN_CHARS characters are used, one for each id (the least). The
    class shares come from all labelled rows.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [known.filter(F.col("toxic") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    usable = docs.select("doc_id", "text").filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    got = usable.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["doc_id", "toxic"]).sample(frac=1, random_state=7)
    texts = [got["text"][got["toxic"] == k].tolist() for k in (1, 0)]
    weight = tuple(total.get(k, 0) / max(1, len(t)) for k, t in zip((1, 0), texts))
    return fit(*texts, weight)


def score_texts(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) from the text alone, replacing one of that name.

    Null counts as empty; equal texts get equal scores; without a model every score is 0. No shuffle.
    """
    base = docs.drop(name)
    small_batches(docs.sparkSession)
    if model is None:
        return base.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = model.compressors()
        for batch in batches:
            x = np.array([features(t or "", a, b) for t in batch.column("text").to_pylist()]).reshape(len(batch), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, name])

    return base.mapInArrow(run, base.limit(0).withColumn(name, F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return score_texts(docs, train(docs, labels), name).filter(F.col(name) < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
