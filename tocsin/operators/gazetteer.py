"""Finding place names in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.text import grams, normal_phrase, normal_text
from tocsin.operators.messages import top_per
from tocsin.operators.sizing import checked_broadcast, fits_broadcast, spread
from tocsin.operators.spatial import is_administrative
from tocsin.session import cut_lineage

Normalizer = Callable[[Column], Column]

#: gazetteer rows up to which every text is tested against every name in place
SCAN_ROWS = 200
#: characters from which a term is keyed by a long piece
LONG = 6


def find_terms(texts: DataFrame, terms: DataFrame, text_key: str, text: str, term_key: str,
               term: str, scan_rows: int = SCAN_ROWS, gram: int = 3) -> DataFrame:
    """(text_key, term_key) for every term contained in the text, inside words too.

    A small term list is broadcast and tested with ``contains``. A larger one is keyed by the rarest
    piece of each term: texts explode into their distinct pieces, meet the terms by an equi-join on
    the piece, and the containment is verified. Terms of ``LONG`` characters use longer, more telling
    pieces. Both ways give the same rows. Terms shorter than ``gram`` are not looked for.

    A term without a space lies within one word, so such terms are looked for in the distinct words of all texts, and
    the texts meet the words that hold one. Only terms with a space take the pieces of whole texts.
    """
    small = terms.select(F.col(term_key), F.col(term).alias("_term")).where(F.length("_term") >= gram)
    body = spread(texts.select(F.col(text_key), F.col(text).alias("_text")))
    if fits_broadcast(small, scan_rows):
        return body.join(F.broadcast(small), F.col("_text").contains(F.col("_term"))).select(
            text_key, term_key)
    words = body.select(text_key, F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
    held = _contained(words.select("_word", F.col("_word").alias("_text")).distinct(),
                      small.where(~F.col("_term").contains(" ")), "_word", term_key, gram)
    held = checked_broadcast(cut_lineage(held, "held"))  # read twice: counted, then joined
    out = words.join(held, "_word").select(text_key, term_key).distinct()
    spaced = small.where(F.col("_term").contains(" "))
    return out if spaced.isEmpty() else out.unionByName(_contained(body, spaced, text_key, term_key, gram))


def _contained(body: DataFrame, terms: DataFrame, text_key: str, term_key: str, gram: int) -> DataFrame:
    is_long = F.length("_term") >= LONG
    out = _by_pieces(body, terms.where(is_long), text_key, term_key, LONG)
    if not terms.where(~is_long).isEmpty():
        out = out.unionByName(_by_pieces(body, terms.where(~is_long), text_key, term_key, gram))
    return out


def _by_pieces(body: DataFrame, terms: DataFrame, text_key: str, term_key: str, gram: int) -> DataFrame:
    small = terms
    pieces = small.withColumn("_g", F.explode(grams(F.col("_term"), gram)))
    freq = pieces.groupBy("_g").agg(F.count("*").alias("_n"))
    keyed = (
        pieces.join(freq, "_g").groupBy(term_key, "_term")
        .agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"))
    )
    if fits_broadcast(keyed):
        # the text rides along through explode and hash join; only matching pieces produce rows
        probe = body.select(text_key, "_text", F.explode(grams(F.col("_text"), gram)).alias("_g"))
        cand = probe.join(F.broadcast(keyed), "_g")
    else:
        probe = body.select(text_key, F.explode(grams(F.col("_text"), gram)).alias("_g"))
        cand = probe.join(keyed, "_g").select(text_key, term_key, "_term").join(body, text_key)
    return cand.where(F.col("_text").contains(F.col("_term"))).select(text_key, term_key)


def normal_places(places: DataFrame, phrase: Normalizer = normal_phrase) -> DataFrame:
    """One place per normal form (lowest place_id), with its length and administrative flag."""
    p = places.withColumn("norm", phrase(F.col("name")))
    p = top_per(p, ["norm"], ["place_id"], 1).drop("rank")
    return p.withColumn("norm_len", F.length("norm")).withColumn(
        "is_admin", is_administrative(F.col("name"), None))


def extract_places(messages: DataFrame, places: DataFrame, key: str = "message_id",
                   text: str = "text", phrase: Normalizer = normal_phrase,
                   whole: Normalizer = normal_text, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """(key, places): array of (name, lat, lon), longest normal form first.

    Administrative names are dropped when a specific place was found.
    """
    names = normal_places(places, phrase)
    texts = messages.select(key, whole(F.col(text)).alias("_norm"))
    hits = find_terms(texts, names, key, "_norm", "place_id", "norm", scan_rows)
    full = hits.join(checked_broadcast(names), "place_id")
    # one entry per name (ignoring case): the longest normal form, then the lowest place_id
    item = F.struct((-F.col("norm_len")).alias("o"), "place_id", "is_admin", "name", "lat", "lon")
    one = full.groupBy(key, F.lower("name").alias("_n")).agg(F.min(item).alias("_i"))
    listed = one.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_all"))
    specific = F.filter("_all", lambda x: ~x["is_admin"])
    chosen = F.when(F.size(specific) > 0, specific).otherwise(F.col("_all"))
    return listed.select(key, F.transform(
        chosen, lambda x: F.struct(x["name"], x["lat"], x["lon"])).alias("places"))


def best_place(phrases: DataFrame, places: DataFrame, phrase_col: str = "phrase",
               phrase: Normalizer = normal_phrase, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Distinct phrases with their best place: equal normal form, else the longest one contained."""
    names = normal_places(places, phrase)
    uniq = phrases.select(F.col(phrase_col).alias("phrase")).distinct().withColumn(
        "_norm", phrase(F.col("phrase"))).where(F.length("_norm") > 0)
    exact = uniq.join(checked_broadcast(names.select("norm", "place_id")),
                      F.col("_norm") == F.col("norm")).select("phrase", "place_id")
    # names under three characters can only match as a whole phrase or inside a longer one
    longer = find_terms(uniq, names, "phrase", "_norm", "place_id", "norm", scan_rows, gram=1)
    ranked = (
        exact.withColumn("_exact", F.lit(0)).unionByName(longer.withColumn("_exact", F.lit(1)))
        .join(checked_broadcast(names), "place_id")
    )
    order = F.struct("_exact", (-F.col("norm_len")).alias("_l"), "place_id")
    return ranked.groupBy("phrase").agg(F.min_by(F.struct("place_id", "name", "lat", "lon"), order)
                                        .alias("place"))


def word_places(texts: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """Places named by a whole word (3 characters or more) of the text."""
    words = texts.select(key, F.explode(F.array_distinct(
        F.split(F.lower(F.col(text)), r"[ ,;\-–()]+"))).alias("_w")).where(F.length("_w") >= 3)
    p = places.withColumn("_w", F.lower("name")).groupBy("_w").agg(
        F.min(F.struct("place_id", "name")).alias("_p"))
    return words.join(p, "_w").select(key, "_p.place_id", "_p.name")


# --- direction ------------------------------------------------------------------------------------

#: fixed values: phrase patterns over the normal form of the text
FROM_RX = (r"(?iuU)\bот\s+([а-яё\- ]+?)(?:\s+(?:в\s+направлении|по\s+направлению|на|к)\s+|$|[,.!?])")
TO_RX = r"(?iuU)(?:в\s+направлении|по\s+направлению|на)\s+([а-яё\- ,]+)"
SPLIT_RX = r"(?U)\s*(?:,|и)\s*"
DASH_RX = r"(?U)([^\-]+?)\s*[-–—]\s*([^\-]+)"


def directions(messages: DataFrame, places: DataFrame, found: DataFrame, key: str = "message_id",
               text: str = "text", phrase: Normalizer = normal_phrase,
               whole: Normalizer = normal_text, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """(key, direction) with direction ``from->to1,to2``; ``found`` is the output of extract_places.

    A named origin adds the other places of the message as targets; without origin and target the
    two sides of a dash are tried.
    """
    m = messages.select(key, F.trim(F.col(text)).alias("_raw"), whole(F.col(text)).alias("_norm"))

    def one(role, body, rx, group):
        return F.struct(F.lit(role).alias("role"), F.lit(0).alias("pos"),
                        F.trim(F.regexp_extract(body, rx, group)).alias("phrase"))

    to_parts = F.split(F.trim(F.regexp_extract("_norm", TO_RX, 1)), SPLIT_RX)
    listed = F.concat(
        F.array(one("from", F.col("_norm"), FROM_RX, 1), one("a", F.col("_raw"), DASH_RX, 1),
                one("b", F.col("_raw"), DASH_RX, 2)),
        F.transform(to_parts, lambda p, i: F.struct(F.lit("to").alias("role"), i.alias("pos"),
                                                    p.alias("phrase"))),
    )
    asked = m.select(key, F.inline(listed)).where(F.length("phrase") > 0)
    named = asked.join(best_place(asked, places, "phrase", phrase, scan_rows), "phrase")

    def pick(role):
        return F.max(F.when(F.col("role") == role, F.col("place.name")))

    to_items = F.array_sort(F.collect_list(
        F.when(F.col("role") == "to", F.struct("pos", F.col("place.name").alias("name")))))
    g = named.groupBy(key).agg(pick("from").alias("f"), pick("a").alias("a"), pick("b").alias("b"),
                               F.transform(to_items, lambda x: x["name"]).alias("t"))
    g = g.join(found.select(key, F.transform("places", lambda p: p["name"]).alias("_found")), key,
               "left")
    others = F.filter(F.coalesce("_found", F.array().cast("array<string>")),
                      lambda n: F.lower(n) != F.lower(F.col("f")))
    targets = F.when(F.col("f").isNotNull(), F.array_union("t", others)).otherwise(
        F.array_distinct("t"))
    g = g.withColumn("_to", targets)
    text_to = F.array_join("_to", ",")
    result = (
        F.when((F.size("_to") > 0), F.concat(F.coalesce("f", F.lit("")), F.lit("->"), text_to))
        .when(F.col("f").isNull() & F.col("a").isNotNull() & F.col("b").isNotNull(),
              F.concat("a", F.lit("->"), "b"))
    )
    return g.select(key, result.alias("direction")).where(F.col("direction").isNotNull())
