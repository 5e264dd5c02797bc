import hashlib
import random

from pyspark.sql import functions as F

from conftest_llm import ODD_ROWS
from tocsin.llm import imatch as M


def texts(n, seed=1):
    r = random.Random(seed)
    words = [f"term{k}" for k in range(4000)]
    return [(k * 3 % 1000, " ".join(r.choice(words) for _ in range(r.randint(0, 300)))) for k in range(n)]


def wanted(rows):
    """(doc_id, digest of the edited text), by sorting all rows."""
    order = sorted(rows, key=lambda x: -x[0])
    out = set()
    for i, (d, t) in enumerate(order):
        other, k = order[(i + 1) % len(order)][1] or "", len(t or "") // 3
        t = t or ""
        out.add((d, len(t), hashlib.sha256((t[:len(t) - k] + other[:k]).encode()).hexdigest()))
    return out


def rows_of(df):
    return {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in df.collect()}


def test_edited_texts_over_blocks(spark, docs_of):
    rows = texts(600) + [(2000, None), (2001, ""), (2002, "é" * 10)]
    assert rows_of(M.fingerprint_documents(docs_of(rows, extra=True))) == wanted(rows)


def test_fingerprints(spark, docs_of):
    rows = texts(500) + [(5000 + k, texts(500)[k][1]) for k in range(20)]
    p = M.fingerprint_documents(docs_of(rows))
    got = p.select("doc_id", M.as_text(F.col("text_print")).alias("f"), M.likeness(F.col("text_print"), F.col("edited_print")).alias("e"),
                   M.likeness(F.col("text_print"), F.col("next_print")).alias("n")).collect()
    by_text = {}
    prints = {r["doc_id"]: r["f"] for r in got}
    for d, t in rows:
        by_text.setdefault(t, set()).add(prints[d])
    assert all(len(v) == 1 for v in by_text.values()) and len(set(prints.values())) > 0.95 * len(by_text)
    assert all(0 <= r["e"] <= 1 and 0 <= r["n"] <= 1 for r in got)
    assert sum(r["e"] > r["n"] for r in got) > 0.8 * len(got)


def test_signatures_against_brute_force(spark, docs_of):
    """Which subsets agree must follow from the lexicon terms alone."""
    rows = texts(200, 5)
    docs = docs_of(rows)
    lex = {r["term"] for r in M.lexicon(docs).collect()}
    terms = {r["doc_id"]: sorted(set(r["t"]) & lex) for r in docs.select("doc_id", M._terms(F.col("text")).alias("t")).collect()}
    sub = {r["term"]: [k for k, v in enumerate(r["s"]) if v] for r in docs.sparkSession.createDataFrame([(t,) for t in lex], "term long").select(
        "term", F.transform(M._signatures(F.array("term")), lambda x: x.isNotNull()).alias("s")).collect()}
    got = {r["doc_id"]: r["text_print"] for r in M.fingerprint_documents(docs).collect()}
    n = len(M._subset_keys())
    seen = {}
    for d, own in terms.items():
        if not own:
            assert len(got[d]) == 1
            continue
        for k in range(n):
            mine = tuple(t for t in own if k in sub[t])
            assert (got[d][k] is None) == (not mine)
            if mine:
                assert seen.setdefault((k, mine), got[d][k]) == got[d][k]
    assert len(set(seen.values())) == len({(m) for _, m in seen})


def test_lexicon_band(spark, docs_of):
    docs = docs_of([(k, "everywhere " + ("half" if k % 2 else "") + f" once{k}") for k in range(400)])
    hashes = {w: docs.sparkSession.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("everywhere", "half", "once3")}
    lex = {r["term"] for r in M.lexicon(docs, (0.1, 3.0)).collect()}
    assert hashes["everywhere"] not in lex and hashes["once3"] not in lex


def test_odd_rows(spark, docs_of):
    out = M.fingerprint_documents(docs_of(ODD_ROWS, extra=True)).collect()
    assert len(out) == len(ODD_ROWS) and all(r["text_print"] and r["next_print"] for r in out)
    assert M.fingerprint_documents(docs_of([])).collect() == []
    assert rows_of(M.fingerprint_documents(docs_of([(1, "abcdef")]))) == wanted([(1, "abcdef")])


def test_subsets_cover_the_lexicon(spark):
    """Over all terms each subset has its own share, and two of them meet as often as independent ones do."""
    n = 60_000
    s = spark.range(n).select(F.xxhash64("id").alias("x")).select(
        "x", F.transform(M._signatures(F.array("x")), lambda x: x.isNotNull()).alias("s"), M._in_any(F.col("x")).alias("any"))
    got = s.collect()
    assert all(r["any"] == any(r["s"]) for r in got) and abs(sum(r["any"] for r in got) / n - 0.27) < 0.01
    keys = M._subset_keys()
    for a in range(len(keys)):
        assert abs(sum(r["s"][a] for r in got) - n / 2 ** keys[a][0]) < 6 * (n / 2 ** keys[a][0]) ** 0.5
    both = sum(r["s"][0] and r["s"][1] for r in got)
    assert abs(both - n / 1024) < 6 * (n / 1024) ** 0.5
    assert all(sum(r["any"] for r in got if r["x"] % 16 == k) > 0.2 * n / 16 for k in range(16))


def test_prints_stay_where_their_terms_are_gathered(spark, docs_of):
    """The next text's print is found without moving the prints: nothing is shuffled after the rows are gathered by block."""
    p = M.fingerprint_documents(docs_of(texts(300)))
    plan = p._jdf.queryExecution().executedPlan().toString().split("\n")
    top = next(k for k, x in enumerate(plan) if "Exchange" in x)
    assert "REPARTITION_BY_COL" in plan[top] and "hashpartitioning(block" in plan[top]
    assert any("collect_list" in x for x in plan[:top]) and any("Window" in x for x in plan[:top])


def test_fingerprint_texts_by_one_key(spark, docs_of):
    rows = docs_of(texts(60)[:40]).dropDuplicates(["doc_id"]).withColumn("more", F.col("text"))
    lex = M.lexicon(rows, (0.0, 12.0))
    one = M.fingerprint_texts(rows, ["doc_id"], ["text"], lex)
    two = M.fingerprint_texts(rows.withColumn("part", F.col("doc_id") % 3), ["part", "doc_id"], ["text"], lex)
    assert one.columns == ["doc_id", "more", "text_print"] and one.schema["doc_id"].dataType == rows.schema["doc_id"].dataType
    assert {(r["doc_id"], r["more"], tuple(r["text_print"])) for r in one.collect()} == {
        (r["doc_id"], r["more"], tuple(r["text_print"])) for r in two.collect()}
