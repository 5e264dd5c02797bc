"""Secret scanning with a ledger: every text version by content, each blob scanned once for each rule version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import settle, table

#: Fixed values. kind: (version, pattern, group whose length counts, its least length), in the order of listing.
RULES = {
    "assign": (1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (1, r"[0-9a-f]{32,}", 0, 32),
}
_SPANS = "array<struct<start:int,end:int>>"
_FINDINGS = "array<struct<start:int,place:int,end:int,kind:string>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches whose group has ``least`` characters.

    Code points, end exclusive. The text between matches and the matches themselves give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["gap"])
        last = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.array(F.struct(first.alias("start"), last.alias("end")))
        out = F.when(F.length(x["value"]) >= least, F.concat(F.coalesce(a["out"], F.expr(f"cast(array() as {_SPANS})")), new)).otherwise(a["out"])
        return F.struct(last.alias("at"), out.alias("out"))

    found = F.coalesce(F.aggregate(parts, start, step)["out"], F.expr(f"cast(array() as {_SPANS})"))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def blob_of(text: Column) -> Column:
    """The content address; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> DataFrame:
    """New ledger rows (blob, rules, findings): every blob of ``versions`` that some rule version has not seen.

    ``ledger`` holds rows of earlier calls. A blob is scanned with just the rules that it lacks; blobs that lack
    none are dropped before their text is shuffled any further. ``rules`` names what was scanned, as kind/version, whether
    or not anything was found. Native.
    """
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    names = [f"{k}/{r[0]}" for k, r in rules.items()]
    if ledger is None:
        todo = texts.withColumn("seen", F.expr("cast(array() as array<string>)"))
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).filter(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = texts.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        todo = todo.filter(F.size("seen") < len(names))
    todo = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    def of_kind(place: int, kind: str, pattern: str, group: int, least: int) -> Column:
        return F.transform(spans(F.col("text"), pattern, group, least), lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    found = []
    for place, (kind, (_, pattern, group, least)) in enumerate(rules.items()):
        own = of_kind(place, kind, pattern, group, least)
        found.append(F.when(F.array_contains("seen", names[place]), F.expr(f"cast(array() as {_FINDINGS})")).otherwise(own))
    lacking = F.array_except(F.array(*map(F.lit, names)), F.col("seen"))
    return todo.select("blob", lacking.alias("rules"), F.concat(*found).alias("findings"))


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows). Findings: all columns of ``versions`` but text, with blob and findings.

    ``versions`` has any columns (path, commit, ...) and text; each of its rows stays one row, repeated ones too. Findings are
    structs (start, place, end, kind) in this order, of the current rule versions only, from the ledger and from
    the new rows together. Null and empty texts have none. Columns named blob or findings are replaced.
    """
    new = settle(scan_unseen(versions, ledger, rules), "ledger")
    known = new.select("blob", "rules", "findings")
    if ledger is not None:
        names = [f"{k}/{r[0]}" for k, r in rules.items()]
        known = known.unionByName(ledger.select("blob", "rules", "findings").filter(F.arrays_overlap("rules", F.array(*map(F.lit, names)))))
        known = known.withColumn("kinds", F.transform(F.array_intersect("rules", F.array(*map(F.lit, names))), lambda r: F.substring_index(r, "/", 1)))
        known = known.withColumn("findings", F.filter("findings", lambda f: F.array_contains(F.col("kinds"), f["kind"])))
    found = known.filter(F.size("findings") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("_f"))
    found = found.withColumnRenamed("blob", "_blob")
    refs = versions.withColumn("blob", blob_of(F.col("text"))).drop("text", "findings")
    joined = refs.join(found, refs["blob"] == found["_blob"], "left")
    findings = F.coalesce(found["_f"], F.expr(f"cast(array() as {_FINDINGS})")).alias("findings")
    return joined.select(*[refs[c] for c in refs.columns], findings), new


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = F.concat_ws(",", F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    return found.select("doc_id", *map(count, RULES), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _sql_kind(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, v,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s, length(h[i]) AS n
  FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i, unnest(w) AS v
        FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS w
              FROM d WHERE regexp_matches(t, '{p}')))
  WHERE length(v) >= {least}"""


SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(
    _sql_kind(k, n, r[1], r[2], r[3]) for n, (k, r) in enumerate(RULES.items())) + """),
a AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, place) AS spans,
             count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
