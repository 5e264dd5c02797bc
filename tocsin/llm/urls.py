"""URL rules, and verdicts by trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import lower_ascii, settle, table

#: (verdict, host, path): the rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Absolute and scheme-relative link targets; the group is the host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z in lower case; empty without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits; of equally long ones a block, then the first by name."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Links without a host stay on their own and make no edge."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", lower_ascii(F.col("dst"))).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 12,
                by_linker: bool = False, tolerance: float | None = None) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of seed weights, native.

    ``seeds`` has (host, trust, distrust) weights of 0 to 1. Trust follows links; distrust goes against them, from a
    blocked host to those that link to it. A host's score is (1 - damping) * seed + damping * what its
    neighbours pass on, each in proportion to its links; a host without links passes nothing on. Scores are not
    normalised over all hosts, so that a threshold means the same at every size. Distrust is split over all that
    link to a host; with ``by_linker`` a host instead takes the mean distrust of what it links to, by its own links, which
    does not depend on how many others link there. Each round is one join and one sum over aggregated edges,
    written to the shared folder every fourth round; with a ``tolerance`` the rounds also end when no score grew by
    as much since the last time it was written.
    """
    seeds = settle(seeds.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("w")),
        F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("w"))))).filter("w > 0"), "seeds")
    base = seeds.select("host", "kind", ((1 - damping) * F.col("w")).alias("x"))
    edges = settle(edges, "edges")
    state = base
    if not edges.isEmpty():
        out = edges.groupBy(F.col("src").alias("k")).agg(F.sum("n").alias("all"))
        end = "src" if by_linker else "dst"
        split = edges.groupBy(F.col(end).alias("k")).agg(F.sum("n").alias("all"))
        ways = settle(
            edges.join(out, edges["src"] == out["k"]).select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("share"))
            .unionByName(edges.join(split, edges[end] == split["k"]).select(F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("share"))), "ways")
        last = base
        for k in range(rounds):
            passed = ways.join(state, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (damping * F.col("x") * F.col("share")).alias("x"))
            state = base.unionByName(passed).groupBy("host", "kind").agg(F.sum("x").alias("x"))
            if k % 4 == 3:
                state = settle(state, "scores")
                if tolerance is not None:
                    grown = state.join(last.withColumnRenamed("x", "old"), ["host", "kind"], "left")
                    if grown.filter(F.col("x") - F.coalesce("old", F.lit(0.0)) >= tolerance).isEmpty():
                        break
                    last = state
    one = [F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return state.groupBy("host").agg(*one)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, threshold: float = 0.1) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row for each row of ``pages``.

    The longest fitting rule decides. Where none fits, the host's scores do: block if distrust is at least
    ``threshold`` and more than trust, else allow. Distrust is taken by the linker's own links, to the last 1e-4. Seeds are hosts by their share of pages that a rule allows or
    blocks. Null or malformed urls have an empty host and path, fit no rule and are allowed. Only page_id, url
    and html are read; null html has no links.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("r", first_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = p.filter(F.col("host") != "").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = host_scores(seeds, host_edges(pages.select("url", "html")), damping, 200, by_linker=True, tolerance=1e-4)
    scores = scores.select(F.col("host").alias("_host"), "trust", "distrust")
    j = p.join(scores, p["host"] == scores["_host"], "left").fillna(0.0, ["trust", "distrust"])
    spread = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return j.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), spread).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
