import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from conftest_llm import ODD_ROWS
from tocsin.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words(docs):
    out = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def wanted(count, lead=10):
    near = {w: [v for v in count if v != w and one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= lead * count[w] else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return out


def rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(seed, n=400):
    """Words with many edits of each other, accents and repeated letters, and steep counts."""
    r = random.Random(seed)
    letters = "abéÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(n // 4)]
    got = {}
    for w in base + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaa"]:
        got[w] = r.choice([2, 5, 40, 900, 20_000])
        for _ in range(3):
            k, c = r.randrange(len(w)), r.choice(letters)
            v = r.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])
            if len(v) >= 7:
                got.setdefault(v, r.choice([2, 3, 30, 500]))
    return got


@pytest.mark.parametrize("meetings", [20_000, 1, 30])
def test_against_brute_force(spark, meetings):
    count = vocabulary(meetings)
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert rows(S.group_variants(df, meetings=meetings)) == wanted(count)


@pytest.mark.parametrize("meetings", [20_000, 2])
def test_each_pair_once(spark, meetings):
    count = vocabulary(7)
    got = [(r["a"], r["b"]) for r in S.near_words(spark.createDataFrame(list(count.items()), "word string, n long"), meetings).collect()]
    assert len(got) == len({frozenset(p) for p in got}) == sum(one_edit(a, b) for a in count for b in count if a < b)


def test_hot_grams_stay_small(spark):
    """All words share their first half: they are chunked again instead of meeting each other."""
    r = random.Random(4)
    count = {"commonstart" + "".join(r.choice("abcdefghij") for _ in range(11)): 2 for _ in range(3_000)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert {(x["a"], x["b"]) for x in S.near_words(df, 500).collect()} == {
        (a, b) for a in count for b in count if a < b and one_edit(a, b)}


def test_long_chain_of_forms(spark):
    count = {"aaaaaaa" + "b" * k: 2 * 10 ** k for k in range(9)}
    got = {r[0]: r[2] for r in rows(S.group_variants(spark.createDataFrame(list(count.items()), "word string, n long")))}
    assert set(got.values()) == {"aaaaaaabbbbbbbb"}


def test_words_of_odd_rows(spark, docs_of):
    docs = ODD_ROWS + [(k, "Éclairage ÉCLAIRAGE eclairage straße×÷ß naïveté's İstanbul " * 3) for k in range(200)] + [(None, "sentences sentences")] * 40
    got = {r["word"]: r["n"] for r in S.count_words(docs_of(docs, extra=True)).collect()}
    assert got == words(docs)


def test_empty(spark, docs_of):
    assert S.group_variants(S.count_words(docs_of([]))).collect() == []
    assert S.group_variants(S.count_words(docs_of([(1, None), (2, "short words only")]))).collect() == []


def test_sql_and_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(S.SQL)
    names = [c[0] for c in cur.description]
    want = {tuple(dict(zip(names, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()}
    got = rows(S.query(spark, sf))
    assert got == want
    assert {(w, n) for w, _, _, n, _, _ in got} == set(words(con.execute("SELECT doc_id, text FROM documents").fetchall()).items())
