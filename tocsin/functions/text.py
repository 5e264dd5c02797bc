"""Text columns: cleaning, normalising, tokens, similarity. Regexes use (?U) for Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tocsin.settings import BOILERPLATE, ENDINGS

URL = r"https?://\S+"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_message(c: Column) -> Column:
    """Drop links, emoji (all supplementary code points and U+2600-26FF), surplus spaces."""
    c = F.regexp_replace(c, "(?U)" + URL, "")
    c = F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}\x{2600}-\x{26FF}]", "")
    return _squeeze(c)


def dedup_form(c: Column, mask_times: bool = True) -> Column:
    """Comparison form of a message: no symbols, boilerplate or links; clock times masked."""
    c = F.lower(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]|\p{So}", ""))
    for phrase in BOILERPLATE:
        c = F.regexp_replace(c, "(?U)" + phrase, "")
    c = _squeeze(F.regexp_replace(c, "(?U)" + URL, ""))
    if mask_times:
        c = F.regexp_replace(c, r"(?U)\b\d{1,2}[:.-]\d{2}\b", "<TIME>")
    return F.coalesce(c, F.lit(""))


def text_hash(c: Column) -> Column:
    return F.upper(F.md5(c))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


# --- word endings ------------------------------------------------------------------------------

def live_endings(endings: list[str]) -> list[str]:
    """Endings that can ever be the first to match: a later one that ends with an earlier one cannot.

    What is left never has a shorter ending ahead of a longer one, so "first rule wins" equals
    "longest ending wins", which a single end-anchored alternation expresses.
    """
    kept: list[str] = []
    for e in endings:
        if not any(e.endswith(k) for k in kept):
            kept.append(e)
    return kept


_ENDING_RX = "(?<=..)(?:" + "|".join(live_endings(ENDINGS)) + ")$"


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "ё", "е"), "ь", "")


def cut_ending(c: Column) -> Column:
    return F.regexp_replace(c, _ENDING_RX, "")


def normal_phrase(c: Column) -> Column:
    """Normal form of a name as a whole: folded, one ending cut at its end."""
    return cut_ending(_fold(c))


def normal_text(c: Column) -> Column:
    """Normal form of a text: split into Cyrillic/digit words, one ending cut from each."""
    words = F.split(_fold(c), r"[^а-яё0-9\-]+")
    return F.array_join(F.transform(words, cut_ending), " ")


def plain_words(c: Column) -> Column:
    """Normaliser for texts in any script: lower-case words joined by one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\-]+", " "))


# --- tokens ----------------------------------------------------------------------------------------

def tokens(c: Column, stop_words: list[str], min_len: int = 3) -> Column:
    """Distinct lower-case words of at least ``min_len`` characters without the stop words."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\-]+")
    keep = F.filter(words, lambda w: F.length(w) >= min_len)
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        keep = F.array_except(keep, stop)
    return F.array_distinct(keep)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; null-safe for two empty sets."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / longer)


BLOCK = 200


def _pieces(c: Column, n: int) -> Column:
    top = F.length(c) - n + 1
    pos = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    return F.transform(pos, lambda i: F.substring(c, i, F.lit(n)))


def grams(c: Column, n: int) -> Column:
    """Distinct ``n``-character pieces of a text.

    ``substring`` walks from the start of the string, so the text is first cut into overlapping blocks.
    Passing it through a one-element array evaluates the input expression once, not once per piece.
    """
    def blocks(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.length(t) - n) / BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last),
                           lambda b: F.substring(t, b * BLOCK + 1, F.lit(BLOCK + n - 1)))

    cut = F.flatten(F.transform(F.array(c), blocks))
    return F.array_distinct(F.flatten(F.transform(cut, lambda b: _pieces(b, n))))


def bigrams(c: Column) -> Column:
    return grams(c, 2)


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(bigrams(a), bigrams(b))


# --- payload text --------------------------------------------------------------------------------------

def cut_bytes(c: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes with whole characters, then ``...``."""
    # bytes used up to each character; only the first max_bytes characters can fit
    head = F.substring(c, 1, max_bytes)
    n = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes")),
        lambda acc, ch: F.struct(
            (acc["chars"] + F.when(acc["bytes"] + F.octet_length(ch) <= max_bytes, 1).otherwise(0))
            .alias("chars"),
            (acc["bytes"] + F.octet_length(ch)).alias("bytes")),
        lambda acc: acc["chars"],
    )
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(F.concat(F.substring(c, F.lit(1), n), F.lit("...")))


def payload_text(c: Column, max_bytes: int) -> Column:
    """Short one-line form: source tag, no supplementary characters, bounded in bytes."""
    c = F.regexp_replace(F.concat(F.lit("TG: "), c), r"[\x{10000}-\x{10FFFF}]", "")
    return cut_bytes(_squeeze(F.replace(c, F.lit("[Telegram]"), F.lit("TG:"))), max_bytes)


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """Replace whole words by their long form, in table order, ignoring case."""
    for short, long in table.items():
        c = F.regexp_replace(c, rf"(?iuU)\b\Q{short}\E\b", long.replace("\\", "\\\\").replace("$", "\\$"))
    return c
