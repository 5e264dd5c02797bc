import pytest

from tocsin.llm import urls as U


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", None), (2, "https://example.net/de", ""), (3, "ftp://notexample.net/en/", None),
        (4, "http://example.com/de/1", None), (5, "http://badexample.com/de/1", None), (6, "http://x.org/fr/", None), (7, "http://org/fr/?x", None),
        (8, "no scheme.net/", None), (9, None, None), (10, "http://y.net", None), (11, "http://y.net?/a", None), (12, "a://b://c.net/", None), (None, "http://z.net/\n", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages_of(spark, rows), U.RULES).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de", "net/", "block"), 3: ("notexample.net", "/en/", "net/", "block"),
        4: ("example.com", "/de/1", "example.com/de/", "block"), 5: ("badexample.com", "/de/1", None, "allow"), 6: ("x.org", "/fr/", "org/fr/", "allow"),
        7: ("org", "/fr/", "org/fr/", "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("y.net", "", None, "allow"),
        11: ("y.net", "", None, "allow"), 12: ("b:", "//c.net/", None, "allow"), None: ("z.net", "/\n", "net/", "block"),
    }


def brute(seeds, edges, damping=0.85, rounds=12):
    out, into = {}, {}
    for s, d, n in edges:
        out[s] = out.get(s, 0) + n
        into[d] = into.get(d, 0) + n
    base = {k: ((1 - damping) * t, (1 - damping) * x) for k, (t, x) in seeds.items()}
    x = dict(base)
    for _ in range(rounds):
        new = {k: list(v) for k, v in base.items()}
        for s, d, n in edges:
            new.setdefault(d, [0, 0])[0] += damping * x.get(s, (0, 0))[0] * n / out[s]
            new.setdefault(s, [0, 0])[1] += damping * x.get(d, (0, 0))[1] * n / into[d]
        x = {k: tuple(v) for k, v in new.items()}
    return x


def test_scores_against_brute_force(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("d", "a", 5), ("e", "d", 1), ("c", "bad", 1)]
    seeds = {"a": (1.0, 0.0), "bad": (0.0, 1.0), "d": (0.25, 0.5)}
    got = U.host_scores(spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"),
                        spark.createDataFrame(edges, "src string, dst string, n long"))
    want = brute(seeds, edges)
    have = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    for k, v in have.items():
        assert v == pytest.approx(want[k])
    assert {k for k, v in want.items() if max(v) > 0} == set(have)


def test_linking_to_blocked_hosts_blocks(spark):
    link = '<a href="//bad.net/x">x</a> <a HREF=\'http://bad.net/\'>y</a><a href="/local">z</a>'
    rows = [(k, f"http://friend{k % 3}.com/p", link) for k in range(9)] + [(20 + k, "http://bad.net/a", "") for k in range(3)] + [(30, "http://clean.com/", '<a href="http://clean.com/2">')]
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages_of(spark, rows), U.RULES, threshold=0.03).collect()}
    assert all(got[k] == "block" for k in range(9)) and got[20] == "block" and got[30] == "allow"


def test_empty(spark):
    assert U.judge_urls(pages_of(spark, []), U.RULES).collect() == []


def test_popular_blocked_host_at_the_default_threshold(spark):
    bad, good = '<a href="//bad.net/x">', "".join(f'<a href="//good{k}.com/">' for k in range(19))
    rows = [(k, f"http://friend{k}.com/p", bad) for k in range(300)] + [(400, "http://bad.net/a", ""), (401, "http://mostly.com/", bad + good), (402, "http://second.com/", '<a href="//friend7.com/">')]
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages_of(spark, rows), U.RULES).collect()}
    assert {got[k] for k in range(300)} == {"block"} and got[400] == "block" and got[401] == "allow" and got[402] == "block"


def test_rounds_to_a_tolerance(spark):
    seeds = spark.createDataFrame([("bad", 0.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "bad", 1), ("a", "b", 9), ("b", "a", 1)], "src string, dst string, n long")
    got = {r["host"]: r["distrust"] for r in U.host_scores(seeds, edges, rounds=200, by_linker=True, tolerance=1e-4).collect()}
    a = 0.85 * 0.1 * 0.15 / (1 - 0.85 * 0.85 * 0.9)
    assert got == pytest.approx({"bad": 0.15, "a": a, "b": 0.85 * a}, abs=1e-4)
