import random
from collections import defaultdict

from conftest_llm import ODD_ROWS
from tocsin.llm.linededup import drop_lines, keep_bitmaps, line_occurrences, line_rows


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_docs, keep_first=False):
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(d)
    bad = {k for k, v in docs.items() if k and len(v) >= min_docs}
    seen, out = set(), []
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            if key(x) in bad and not (keep_first and key(x) not in seen):
                continue
            seen.add(key(x))
            kept.append(x)
        out.append((d, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out)


def rows_of(df):
    return sorted((r["doc_id"], r["text"] or "", r["n_dropped"]) for r in df.collect())


def test_random(spark, docs_of):
    r = random.Random(2)
    pool = ["", " ", "Line A", " line a ", "other", "x\ty", "É", "é"] + [f"own {k}" for k in range(40)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for k in range(80)]
    for first in (False, True):
        assert rows_of(drop_lines(docs_of(rows, extra=True), 5, keep_first=first)) == brute(rows, 5, first)


def test_hot_line_over_many_partitions(spark, docs_of):
    rows = [(k, "hot\nhot\nown %d" % k) for k in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r["n_docs"] for r in line_occurrences(line_rows(docs_of(rows), 1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {1, 500}


def test_odd_rows(spark, docs_of):
    out = rows_of(drop_lines(docs_of([x for x in ODD_ROWS if x[0] is not None], extra=True), 2))
    assert out == brute([x for x in ODD_ROWS if x[0] is not None], 2)
    full = drop_lines(docs_of(ODD_ROWS), 2)
    assert full.count() == len(ODD_ROWS) and [r for r in full.collect() if r["doc_id"] == 1][0]["text"] is None


def test_empty_and_bitmaps(spark, docs_of):
    assert drop_lines(docs_of([])).collect() == []
    bits = keep_bitmaps(docs_of([(1, "a\nb"), (2, "a")]), 2).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in bits} == {(1, 1), (2, 1)}
