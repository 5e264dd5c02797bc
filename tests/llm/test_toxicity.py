import random
import zlib

import pytest

from conftest_llm import ODD_ROWS
from tocsin.llm import toxicity as X


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    plain = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    bad = ["zorvexil", "quazzum", "xyphragg"]

    def make(toxic):
        w = [r.choice(plain) for _ in range(r.randint(20, 200))]
        if toxic:
            for _ in range(1 + len(w) // 30):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        return " ".join(w)

    return [(k, make(k % 5 == 0), int(k % 5 == 0)) for k in range(800)]


def test_held_out_accuracy(spark, docs_of, texts):
    docs = docs_of([t[:2] for t in texts] + [(9001, None), (9002, ""), (None, "zorvexil quazzum")], extra=True)
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    got = X.score_texts(docs, X.train(docs, labels)).collect()
    assert len(got) == len(texts) + 3 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    held = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 4 == 2]
    right = [(score[k] >= X.THRESHOLD) == bool(y) for k, _, y in held]
    assert sum(right) / len(right) > 0.95
    assert score[9001] == score[9002]
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < X.THRESHOLD}


def test_windows_cover_all_texts():
    text = "abc défg " * 500
    whole = X.coded(text)
    w = list(X.windows(text, block=X.STEP * 3))
    assert w == list(X.windows(text)) and w[0] == whole[:2 * X.WINDOW]
    assert b"".join(x[:2 * X.STEP] for x in w[:-1]) + w[-1] == whole
    assert list(X.windows("")) == [b""]


def test_no_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(ODD_ROWS, extra=True)
    assert X.drop_toxic(docs, labels).count() == len(ODD_ROWS)
    assert X.drop_toxic(docs_of([]), labels).count() == 0
