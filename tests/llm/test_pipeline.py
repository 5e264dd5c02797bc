import sentencepiece

import corpus_pipeline as C
from tocsin.llm import toxicity as X
from tocsin.llm.tokens import default_model
from test_decontaminate import brute as contaminated
from test_linededup import brute as lines
from test_neardup import brute as near

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = C.table(spark, SF, "documents")
    model = X.train(docs, C.table(spark, SF, "labels"))
    scored = X.score_texts(docs, model)
    rows = [(r["doc_id"], r["text"]) for r in scored.collect() if r["score"] < X.THRESHOLD]
    rows = [(d, t) for d, t, n in lines(rows, 10, True) if not n or t.strip(" \t\n\x0b\x0c\r")]
    first = near(rows, 5, 80)
    rows = [(d, t) for d, t in rows if first[d] == d]
    items = [(r["item_id"], r["text"]) for r in C.table(spark, SF, "benchmark").collect()]
    bad = {d for d, *_, c in contaminated(rows, items) if c}
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {(d, ",".join(map(str, sp.encode(t))), sp.decode(sp.encode(t))) for d, t in rows if d not in bad}
    got = C.run(spark, SF).collect()
    assert {(r["doc_id"], r["token_ids"], r["decoded"]) for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = C.table(spark, SF, "documents").withColumn("key", C.F.lit("x")).withColumn("score", C.F.lit(1.5))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() > 0
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_dedup_lines_cuts_each_text_once(spark, docs_of):
    """A condition on the cut text must not cut it a second time, in a second Python worker for each task."""
    rows = [(k, f"common line\nown line {k}" if k % 3 else "common line") for k in range(60)]
    out = C.dedup_lines(spark, docs_of(rows).selectExpr("*", "cast(length(text) as int) as n_chars"), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_kept(") == 1
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {k: ((t := f"own line {k}" if k else "common line"), len(t)) for k in range(60) if k % 3 or not k}
