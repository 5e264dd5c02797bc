"""Context for messages without a place: from the message replied to, or from recent messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.text import token_overlap
from tocsin.operators.ordered import with_history

INHERITED = ["places", "direction", "type", "category"]


def reply_context(messages: DataFrame, chat: str = "chat", key: str = "message_id",
                  reply: str = "reply_to", keep: float = 0.8) -> DataFrame:
    """Messages without a place inherit from the message they reply to; confidence = max(own, keep x parent)."""
    parent = messages.select(
        F.col(chat).alias("_chat"), F.col(key).alias("_id"),
        F.struct(*INHERITED, "confidence").alias("_p"))
    on = (F.col(chat) == F.col("_chat")) & (F.col(reply) == F.col("_id"))
    j = messages.join(parent, on, "left")
    use = F.col("_p").isNotNull() & (F.size("places") == 0)
    return _inherit(j, messages.columns, use, keep, "ContextFromReply")


def _inherit(j: DataFrame, columns: list[str], use: Column, keep: float, flag: str) -> DataFrame:
    out = j
    for c in INHERITED:
        out = out.withColumn(f"_new_{c}", F.when(use, F.col(f"_p.{c}")).otherwise(F.col(c)))
    conf = F.when(use, F.greatest(F.col("confidence"), F.col("_p.confidence") * keep))
    marked = F.when(use, F.array_union("flags", F.array(F.lit(flag)))).otherwise(F.col("flags"))
    return out.select(*[
        F.col(f"_new_{c}").alias(c) if c in INHERITED
        else F.coalesce(conf, F.col(c)).alias(c) if c == "confidence"
        else marked.alias(c) if c == "flags" else F.col(c)
        for c in columns])


def _recent(messages: DataFrame, scope: list[str], ts: str, key: str, token_col: str, rows: int,
            minutes: float) -> DataFrame:
    """Un-located messages with the located ones among the last ``rows`` messages of the scope."""
    hist = with_history(messages, scope, ts, [key], [key, "type", token_col, "n_places"], rows,
                        int(minutes * 60), "_hist")
    return hist.where(F.col("n_places") == 0).withColumn(
        "_hist", F.filter("_hist", lambda h: h["n_places"] > 0))


def _freshness(now: Column, then: Column, minutes: float) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(then)) / F.lit(6e7)
    return F.greatest(F.lit(0.0), 1 - age / minutes)


def token_context(messages: DataFrame, scope: list[str], ts: str = "ts", key: str = "message_id",
                  token_col: str = "tokens", rows: int = 20, minutes: float = 5.0,
                  min_score: float = 0.3) -> DataFrame:
    """(key, context_id, score): the recent located message most alike by token overlap.

    Score = overlap / larger set + 0.2 same type + 0.1 x freshness; the earliest wins ties.
    """
    r = _recent(messages, scope, ts, key, token_col, rows, minutes)
    scored = F.transform("_hist", lambda h: F.struct(
        (token_overlap(F.col(token_col), h[token_col])
         + F.when(F.lower(F.col("type")) == F.lower(h["type"]), 0.2).otherwise(0.0)
         + 0.1 * _freshness(F.col(ts), h["_ts"], minutes)).alias("score"),
        (-F.unix_micros(h["_ts"])).alias("o"), (-h[key]).alias("k"), h[key].alias("id")))
    best = r.select(key, F.array_max(scored).alias("b"))
    return best.where(F.col("b.score") >= min_score).select(
        key, F.col("b.id").alias("context_id"), F.col("b.score").alias("score"))


def smoothed_idf(n_docs: Column, df: Column, integer_ratio: bool = True) -> Column:
    """ln((N+1)/(df+1)) + 1; the ratio is floored unless ``integer_ratio`` is off."""
    ratio = (n_docs + 1) / (df + 1)
    return F.log(F.floor(ratio) if integer_ratio else ratio) + 1.0


def tfidf_context(messages: DataFrame, scope: list[str], ts: str = "ts", key: str = "message_id",
                  token_col: str = "tokens", rows: int = 20, minutes: float = 5.0,
                  min_score: float = 0.3, integer_ratio: bool = True) -> DataFrame:
    """(key, context_id, score): cosine of tf-idf vectors + 0.1 same type + 0.05 x freshness.

    The idf of a message is taken over its own candidates. Tokens are distinct, so the term
    frequencies cancel in the cosine and only squared idf values are summed.
    """
    r = _recent(messages, scope, ts, key, token_col, rows, minutes).where(F.size("_hist") > 0)
    cand = r.select(
        key, F.col("type").alias("_type"), F.col(ts).alias("_now"), F.size("_hist").alias("_n"),
        F.col(token_col).alias("_own"), F.explode("_hist").alias("h"))
    words = cand.select(key, "_n", F.col(f"h.{key}").alias("id"), F.explode(f"h.{token_col}").alias("w"))
    idf = (
        words.groupBy(key, "_n", "w").agg(F.count("*").alias("_df"), F.collect_list("id").alias("ids"))
        .withColumn("sq", F.pow(smoothed_idf(F.col("_n"), F.col("_df"), integer_ratio), F.lit(2.0)))
    )
    own = r.select(key, F.explode(token_col).alias("w"))
    both = idf.join(own.withColumn("_mine", F.lit(True)), [key, "w"], "full")
    sq = F.coalesce("sq", F.lit(1.0))
    own_norm = both.where("_mine").groupBy(key).agg(F.sum(sq).alias("_own_sq"))
    per = (
        both.where(F.col("ids").isNotNull()).select(key, F.explode("ids").alias("id"), "sq", "_mine")
        .groupBy(key, "id").agg(F.sum("sq").alias("_cand_sq"),
                                F.sum(F.when(F.col("_mine"), F.col("sq"))).alias("_dot"))
    )
    meta = cand.select(key, F.col(f"h.{key}").alias("id"), F.col("h._ts").alias("_then"), "_now",
                       (F.lower("_type") == F.lower(F.col("h.type"))).alias("_same"))
    j = meta.join(per, [key, "id"], "left").join(own_norm, key, "left")
    cosine = F.coalesce(F.col("_dot") / (F.sqrt("_own_sq") * F.sqrt("_cand_sq")), F.lit(0.0))
    score = (cosine + F.when(F.col("_same"), 0.1).otherwise(0.0)
             + 0.05 * _freshness(F.col("_now"), F.col("_then"), minutes))
    # rounding keeps the choice between equal scores independent of summation order
    j = j.withColumn("score", F.round(score, 9))
    best = j.groupBy(key).agg(F.max(F.struct(
        "score", (-F.unix_micros("_then")).alias("o"), (-F.col("id")).alias("k"), "id")).alias("b"))
    return best.where(F.col("b.score") >= min_score).select(
        key, F.col("b.id").alias("context_id"), F.col("b.score").alias("score"))


def combined_context(simple: DataFrame, tfidf: DataFrame, messages: DataFrame,
                     ts: str = "ts", key: str = "message_id") -> DataFrame:
    """Agreement of both analysers; else the one with more places, else the newer message."""
    s = simple.select(key, F.col("context_id").alias("_s"))
    t = tfidf.select(key, F.col("context_id").alias("_t"))
    info = messages.select(F.col(key).alias("_k"), "n_places", F.col(ts).alias("_at"))

    def known(df, col):
        i = info.select(F.col("_k").alias(col), F.struct("n_places", "_at").alias(f"{col}_i"))
        return df.join(i, col, "left")

    j = known(known(s.join(t, key, "full"), "_s"), "_t")
    more = F.col("_s_i.n_places") > F.col("_t_i.n_places")
    fewer = F.col("_s_i.n_places") < F.col("_t_i.n_places")
    newer = F.col("_s_i._at") > F.col("_t_i._at")
    pick = (
        F.when(F.col("_t").isNull() | (F.col("_s") == F.col("_t")), F.col("_s"))
        .when(F.col("_s").isNull(), F.col("_t"))
        .when(more, F.col("_s")).when(fewer, F.col("_t"))
        .when(newer, F.col("_s")).otherwise(F.col("_t"))
    )
    return j.select(key, pick.alias("context_id"))


def apply_context(messages: DataFrame, context: DataFrame, key: str = "message_id",
                  keep: float = 0.7) -> DataFrame:
    """Inherit places, direction, type and category from the chosen context message."""
    parent = messages.select(F.col(key).alias("context_id"),
                             F.struct(*INHERITED, "confidence").alias("_p"))
    j = messages.join(context.select(key, "context_id"), key, "left").join(parent, "context_id", "left")
    wanted = (F.col("type") != "Unknown") | (F.col("status") == "Watch") | (F.size("flags") > 0)
    use = F.col("_p").isNotNull() & (F.size("places") == 0) & wanted
    return _inherit(j, messages.columns, use, keep, "ContextApplied")
