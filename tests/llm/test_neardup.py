import random

from conftest_llm import ODD_ROWS
from tocsin.llm import neardup as N
from tocsin.llm.graph import components


def sets_of(t, size):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, share):
    """Smallest id reached, by comparing all pairs of rows."""
    rows = [r for r in rows if r[0] is not None]
    up = {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [(d, sets_of(t, size)) for d, t in rows]
    for i, (d, x) in enumerate(s):
        for e, y in s[:i]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: top(d) for d in up}


def check(spark, docs_of, rows, size=3, share=85):
    got = N.near_duplicates(docs_of(rows, extra=True), size, share).collect()
    assert len(got) == len(rows)
    want = brute(rows, size, share)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
    return got


def test_chains_and_large_groups(spark, docs_of):
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(6):  # edits of edits: chains whose ends are far apart, and edits of one base
        base = [r.choice(words) for _ in range(r.choice([30, 120, 400]))]
        cur = list(base)
        for k in range(45):
            src = cur if g % 2 else list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                src[r.randrange(len(src))] = r.choice(words)
            cur = src
            rows.append((len(rows) * 7 % 1009, " ".join(src)))
    rows += [(2000 + k, rows[0][1]) for k in range(40)]
    check(spark, docs_of, rows)


def test_blocks_open_large_buckets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(120):
        t = list(base)
        for _ in range(r.randint(0, 12)):
            t[r.randrange(200)] = f"x{k}_{r.random()}"
        rows.append((k, " ".join(t)))
    check(spark, docs_of, rows)


def test_odd_rows(spark, docs_of):
    got = check(spark, docs_of, [x for x in ODD_ROWS if x[0] != 7] + [(7, "a"), (10, "A "), (11, "one two THREE")])
    assert {r["doc_id"]: r["n_shingles"] for r in got}[5] == 1
    assert N.near_duplicates(docs_of([])).collect() == []


def test_drop_keeps_one_of_each_group(spark, docs_of):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, "other words here now and then"), (1, None), (2, ""), (None, "a b c d e f g")]
    docs = docs_of(rows, extra=True)
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "9", "None"]


def test_posterior_bounds():
    least = N.least_matches(0.85, 1e-6)
    assert list(least) == sorted(least) and all(m < 0.85 * n for m, n in zip(least, range(32, 193, 32)))
    assert N.least_matches(0.85, 0.01)[-1] > least[-1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400), (500, 450)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 450: 400, 500: 400}
    assert components(df.filter("a < 0")).collect() == []
