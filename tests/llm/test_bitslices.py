import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest_llm import ODD_ROWS
from tocsin.llm import bitslices as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def wanted(docs, items, k):
    """All scores, by brute force."""
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in by_item.items():
        scores = []
        for d, c in own:
            if not c:
                continue
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in want if c[t])
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(i, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(4000)] + ["Été", "日本", "x1"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 400])))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(30)]  # copies: ties by id
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 8, 30])))) for k in range(40)] + [(100, docs[7][1]), (101, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("k,block", [(10, 2_000), (3, 7)])
def test_against_brute_force(spark, docs_of, k, block):
    docs, items = corpus(300, k)
    found = spark.createDataFrame(items, "item_id long, text string")
    assert rows(B.search(docs_of(docs, extra=True), found, k, block=block)) == wanted(docs, items, k)


def test_odd_rows(spark, docs_of):
    docs = ODD_ROWS + [(20, "the word " * 300_000 + "rare")]
    items = [(1, "one TWO"), (1, "word rare"), (2, None), (3, ""), (None, "text 日本"), (4, "unheard of")]
    got = rows(B.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), 9))
    assert got == [x for x in wanted(docs, items, 9)] and any(r[0] is None for r in got) and any(r[2] is None for r in got)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert B.search(docs_of([]), items).collect() == []
    assert B.search(docs_of([(1, None), (2, "--")]), items).collect() == []
    assert B.search(docs_of([(1, "one")]), items.limit(0)).collect() == []
    assert [r["item_id"] for r in B.search(docs_of([(1, "one"), (2, "two")]), items).collect()] == ["a"]


def test_bounds_never_below_scores(spark, docs_of):
    """And close to them: the documents not excluded are few."""
    docs, items = corpus(600, 5)
    index = B.build_index(docs_of(docs))
    own = B.weigh(B.item_terms(spark.createDataFrame(items, "item_id long, text string")), index).collect()
    q = B.Query(own, index.n_docs, index.n_terms)
    text, over, cells = dict(docs), 0, 0
    for b in index.blocks.collect():
        got = q.bounds(b["width"], b["sizes"], bytes(b["bits"]))
        for c, d in enumerate(b["doc_ids"]):
            counts = Counter(B.terms_of(text[d].encode()))
            exact = np.array([q.score(i, counts, sum(counts.values())) for i in range(len(q.items))])
            assert (got[:, c] >= exact).all()
            over, cells = over + (got[:, c] > 1.2 * exact + 1).sum(), cells + len(exact)
    assert over < 0.02 * cells


def test_every_level_of_occurrences():
    tf = np.arange(1, 5000)
    level = np.searchsorted(B.LEVELS, tf, "right") - 1
    assert (B.LEVELS[level] <= tf).all() and (B.LEVELS[level + 1] > tf).all()


def test_terms_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        s = "".join(chr(r.choice([r.randrange(128), r.randrange(128, 0xD800), r.randrange(0x10000, 0x10FFFF)])) for _ in range(40))
        assert [t.decode() for t in B.terms_of(s.encode())] == terms(s)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(B.SQL)
    names = [c[0] for c in cur.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in ("item_id", "rank", "doc_id", "score")) for r in cur.fetchall()), key=str)
    assert rows(B.query(spark, sf)) == want
