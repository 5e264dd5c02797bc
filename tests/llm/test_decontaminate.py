import random
import re

from conftest_llm import ODD_ROWS
from tocsin.llm.decontaminate import contaminated, drop_contaminated, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[a:a + k]), set()).add(str(i))
    out = set()
    for d, t in set(docs):
        w = words(t)
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                ids = grams.get(tuple(w[a:a + k]))
                if ids:
                    hit.update(range(a, a + k))
                    found |= ids
        out.add((d, len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def got(spark, docs_of, docs, items):
    bench = docs_of(items).withColumnRenamed("doc_id", "item_id")
    rows = find_contamination(docs_of(docs, extra=True), bench).withColumn("c", contaminated()).collect()
    assert all(r["n_items"] == len(r["items"]) for r in rows)
    return {(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["c"]) for r in rows}


def test_random_against_brute_force(spark, docs_of):
    r = random.Random(4)
    vocabulary = ["ab", "cd", "ef", "é", "gh1"]  # few words: many ties and repeated grams
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 4, 7, 12, 13, 14, 20, 40]))) for k in range(30)]
    docs = []
    for k in range(60):
        t = text(r.randint(0, 60))
        if k % 2:
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 13))
            t += " X9 " + " ".join(w[a:a + r.randint(11, 16)]).upper() + "; y8 " + text(5)
        docs.append((k, t))
    assert got(spark, docs_of, docs, items) == brute(docs, items)


def test_periodic_text(spark, docs_of):
    items = [(1, "x " * 30), (2, "x y " * 20)]
    docs = [(1, "x " * 100), (2, "y x " * 50), (3, "x " * 12), (4, "q " * 40 + "x " * 13)]
    assert got(spark, docs_of, docs, items) == brute(docs, items)


def test_odd_rows(spark, docs_of):
    items = [(1, ODD_ROWS[3][1]), (2, None), (3, ""), (None, "one two three four"), (1, ODD_ROWS[3][1]), (5, "a")]
    have = got(spark, docs_of, ODD_ROWS, items)
    want = brute(ODD_ROWS, [i for i in items if i[0] is not None] + [])
    hits = {(d, n, ids) for d, n, _, ids, _ in have}
    assert hits == {(d, n, ids) for d, n, _, ids, _ in want}
    assert (5, 3, 0, "", False) in have and (4, 14, 14, "1", True) in have


def test_empty_tables(spark, docs_of):
    assert got(spark, docs_of, [], [(1, "a b c")]) == set()
    assert got(spark, docs_of, [(1, "a b c")], []) == {(1, 3, 0, "", False)}


def test_drop_keeps_columns_and_clean_rows(spark, docs_of):
    bench = docs_of([(1, ODD_ROWS[3][1])]).withColumnRenamed("doc_id", "item_id")
    docs = docs_of(ODD_ROWS, extra=True)
    out = drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, left)) == sorted(str(x) for x in ODD_ROWS if x[0] not in (4, 6) and x != ODD_ROWS[9])
