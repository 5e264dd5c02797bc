"""Format-preserving pseudonyms of validated card numbers, IBANs and dates by a keyed Feistel permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.llm.common import let, table

#: Days of 400 years are 189 * 773.
DAYS, DAYS_A, DAYS_B = 146_097, 189, 773
YEAR = "(?:18|19|20|21)[0-9]{2}"
#: Dates of the years 1800 to 2199 with the year first, in two digits each, or last, where a zero may be left out.
DATES = [d for s in ("-", "/", "[.]") for d in (f"{YEAR}{s}[0-9]{{2}}{s}[0-9]{{2}}", f"[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}{YEAR}")]
#: Groups of a card number with equal blanks or hyphens between, longer ones first; without any, 13 to 19 digits.
GROUPS = ((4, 4, 4, 4, 3), (6, 13), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
CARDS = [s.join(f"[0-9]{{{n}}}" for n in g) for g in GROUPS for s in (" ", "-")] + ["[0-9]{13,19}"]
#: Countries by the number of characters of their IBANs.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
#: Unbroken, or in groups of four with blanks between, the last one shorter.
IBANS = [f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + ")"
         for n, c in IBAN_SIZES.items()]
DATE, IBAN = f"(?:{'|'.join(DATES)})(?![0-9])", f"(?:{'|'.join(IBANS)})(?![\\p{{L}}0-9])"
#: The empty places before which a value can start.
START = f"(?<![0-9])(?=[0-9])(?={DATE}|(?:{'|'.join(CARDS)})(?![0-9]))|(?<![\\p{{L}}0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?={IBAN})"
#: More characters than any value has with the one behind it, and more starts than one value can hold.
LONGEST, INSIDE = 48, 20


def _keyed(key: str, k: int, part: Column, size: Column) -> Column:
    """A number under ``size`` from the key, the round and the other half."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(k), part.cast("string")), 256), 1, 15), 16, 10).cast("long"), size)


def _rounds(left: Column, right: Column, a: Column, b: Column, key: str) -> Column:
    """struct<l, r>: a keyed permutation of the pairs of numbers under a and under b."""
    pair = F.struct(left.alias("l"), right.alias("r"))
    for k in range(2):
        pair = let(pair, lambda p: F.struct(F.pmod(p["l"] + _keyed(key, 2 * k, p["r"], a), a).alias("l"), p["r"].alias("r")))  # noqa: B023
        pair = let(pair, lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _keyed(key, 2 * k + 1, p["l"], b), b).alias("r")))  # noqa: B023
    return pair


def permuted(x: Column, a: Column, b: Column, key: str) -> Column:
    """A keyed permutation of the numbers under a * b: four rounds on quotient and remainder."""
    return let(_rounds(F.floor(x / b).cast("long"), F.pmod(x, b), a, b, key), lambda p: p["l"] * b + p["r"])


def _permuted_digits(digits: Column, key: str) -> Column:
    """A keyed permutation of the digit strings of one length, two to 36."""
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10), k).cast("long"), F.pow(F.lit(10), n - k).cast("long")
    pair = _rounds(F.substring(digits, F.lit(1), k).cast("long"), F.substring(digits, k + 1, n - k).cast("long"), a, b, key)
    return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), k, "0"), F.lpad(p["r"].cast("string"), n - k, "0")))


def _luhn(digits: Column) -> Column:
    """The sum that a valid number has divisible by ten."""
    d = F.reverse(F.split(digits, ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _in_shape(shape: Column, digits: Column, kept: str) -> Column:
    """``shape`` with its characters outside the class ``kept`` replaced by ``digits`` in order."""
    own = F.split(digits, "")
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), lambda a, c: F.when(
        c.rlike(kept), F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))).otherwise(
        F.struct(F.concat(a["s"], F.get(own, a["i"])).alias("s"), (a["i"] + 1).alias("i"))))["s"]


def _card(hit: Column, key: str) -> Column:
    """Another valid number in the same groups."""
    digits = F.regexp_replace(hit, "[ -]", "")
    new = let(_permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key + ":card"), lambda d: F.concat(
        d, F.pmod(F.lit(10) - _luhn(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return _in_shape(hit, new, "[ -]")


def _iban_check(iban: Column) -> Column:
    """The two check digits that the other characters of an IBAN without blanks ask for."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    value = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.lpad((F.lit(98) - F.aggregate(value, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)).cast("string"), 2, "0")


def _iban(hit: Column, key: str) -> Column:
    """Another valid IBAN of the same country, letters and groups; null for one that is not valid."""
    def use(iban: Column) -> Column:
        digits = F.regexp_replace(F.substring(iban, F.lit(5), F.length(iban)), "[^0-9]", "")
        own = F.when(F.length(digits) > 1, _permuted_digits(digits, key + ":iban")).otherwise(digits)
        new = let(F.concat(F.substring(iban, 1, 2), F.lit("00"), _in_shape(F.substring(iban, F.lit(5), F.length(iban)), own, "[A-Z]")), lambda x: F.concat(
            F.substring(x, 1, 2), _iban_check(x), F.substring(x, F.lit(5), F.length(x))))
        return F.when(_iban_check(iban) == F.substring(iban, 3, 2), _in_shape(hit, new, " "))

    return let(F.regexp_replace(hit, " ", ""), use)


def _date(hit: Column, key: str) -> Column:
    """Another day in the same order, separator and width; null for one that does not exist.

    With the year last the day comes first, or the month where only that exists. Pseudonyms are read the same way
    as what they stand for: of month-first dates, those go round again whose pseudonym could be day first.
    """
    def day_of(y: Column, m: Column, d: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), F.lit("1800-01-01").cast("date")).cast("long")

    def other(day: Column) -> Column:
        return permuted(day, F.lit(DAYS_A), F.lit(DAYS_B), key + ":date")

    def written(day: Column, form: str) -> Column:
        return F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), day.cast("int")), form)

    def use(p: Column) -> Column:
        sep, short = F.substring(F.regexp_replace(hit, "[0-9]", ""), 1, 1), F.rlike(hit, F.lit("(?<![0-9])[0-9](?![0-9])"))

        def last(day: Column, long: str, brief: str) -> Column:
            return let(day, lambda x: F.replace(F.when(short, written(x, brief)).otherwise(written(x, long)), F.lit("-"), sep))

        def again(day: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.lit(60)), other(day), lambda x, _: F.when(written(x, "d").cast("int") > 12, x).otherwise(other(x)))

        year_first = let(day_of(p[0], p[1], p[2]), lambda day: F.when(day.isNotNull(), F.replace(written(other(day), "yyyy-MM-dd"), F.lit("-"), sep)))
        day_first = let(day_of(p[2], p[1], p[0]), lambda day: F.when(day.isNotNull(), last(other(day), "dd-MM-yyyy", "d-M-yyyy")))
        month_first = let(day_of(p[2], p[0], p[1]), lambda day: F.when(day.isNotNull(), last(again(day), "MM-dd-yyyy", "M-d-yyyy")))
        return F.when(F.length(p[0]) == 4, year_first).otherwise(F.coalesce(day_first, month_first))

    return let(F.split(hit, "[-/.]"), use)


def _first_value(ahead: Column, key: str) -> Column:
    """struct<hit, new> of the valid value at the start of ``ahead``, of several the first by kind, then the longest; or null."""
    def found(form: str, use) -> Column:
        return let(F.regexp_extract(ahead, f"^(?:{form})", 0), lambda hit: F.when(F.length(hit) > 0, use(hit)))

    def both(new):
        return lambda hit: let(new(hit, key), lambda x: F.when(x.isNotNull(), F.struct(hit.alias("hit"), x.alias("new"))))

    card = F.coalesce(*[found(f"{c}(?![0-9])", lambda hit: F.when(_luhn(F.regexp_replace(hit, "[ -]", "")) % 10 == 0, hit)) for c in CARDS])
    return F.coalesce(found(DATE, both(_date)), found(IBAN, both(_iban)), let(card, lambda hit: F.when(hit.isNotNull(), both(_card)(hit))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced values in ``text`` and their number in n_replaced; null stays null. Native, no shuffle.

    Equal values get equal pseudonyms under one key, in all documents; different ones get different ones. Values are
    found from left to right: the first start with a valid value takes it, whatever invalid ones lie across it.
    The text is cut before every possible start; a value holds the starts inside it.
    """
    cut = F.split("text", START, -1)
    df = docs.withColumn("_cut", F.when(F.rlike("text", F.lit(START)), cut))
    ahead = lambda i: F.array_join(F.transform(F.slice("_cut", i + 1, INSIDE), lambda s: F.substring(s, 1, LONGEST)), "")
    df = df.withColumn("_value", F.transform("_cut", lambda _, i: let(ahead(i), lambda a: _first_value(a, key))))

    def held(v: Column, i: Column) -> Column:
        """How many pieces a value touches, as a letter; @ for no value."""
        left = F.aggregate(F.slice("_cut", i + 1, INSIDE), F.struct(F.length(v["hit"]).alias("left"), F.lit(0).alias("n")), lambda a, s: F.when(
            a["left"] > 0, F.struct((a["left"] - F.length(s)).alias("left"), (a["n"] + 1).alias("n"))).otherwise(a))
        return F.when(v.isNull(), "@").otherwise(F.char(left["n"] + 64))

    # from left to right, a letter takes as many places as it says
    taken = "|".join(["@", *[chr(64 + n) + "." * (n - 1) for n in range(1, INSIDE + 1)]])
    letters = F.array_join(F.transform("_value", held), "")
    marks = F.flatten(F.transform(F.regexp_extract_all(letters, F.lit(taken), F.lit(0)), lambda x: F.transform(F.split(x, ""), lambda c, k: F.when(k == 0, c).otherwise(""))))
    df = df.withColumn("_mark", marks)

    def piece(s: Column, i: Column) -> Column:
        v, m = F.get("_value", i), F.get("_mark", i)
        rest = lambda: F.array_join(F.slice("_cut", i + 1, F.ascii(m) - 64), "")
        return F.when(m == "@", s).when(m == "", "").otherwise(F.concat(v["new"], F.substring(rest(), F.length(v["hit"]) + 1, F.lit(2**31 - 1))))

    text = F.array_join(F.transform("_cut", piece), "")
    n = F.size(F.filter(F.arrays_zip("_value", "_mark"), lambda p: (p["_mark"] > "@") & (p["_value"]["hit"] != p["_value"]["new"]))).cast("long")
    found = F.col("_cut").isNotNull()
    return df.withColumns({"text": F.when(found, text).otherwise(F.col("text")), "n_replaced": F.when(found, n).otherwise(0)}).drop("_cut", "_value", "_mark")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "key of the query")
    return out.select("doc_id", "n_replaced", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
