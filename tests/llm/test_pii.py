import datetime
import random
import re

from tocsin.llm.pii import pseudonymise


def test_same_values_and_formats(spark, docs_of):
    rows = [(1, "card 4111 1111 1111 1111 on 2024-02-29, again 4111111111111111; bad 4111111111111112 2023-02-30"), (2, None), (3, "2024-02-29"), (4, "")]
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pseudonymise(docs_of(rows, extra=True), "k").collect()}
    assert got[2] == (None, 0) and got[4] == ("", 0) and got[1][1] == 3
    w = got[1][0]
    assert w.endswith("; bad 4111111111111112 2023-02-30") and got[3][0] in w
    assert w[5:24].replace(" ", "") in w[30:] and w[5:24] != rows[0][1][5:24]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid_card(s):
    g = re.split("[ -]", s)
    seps = set(re.sub("[0-9]", "", s))
    shape = tuple(map(len, g))
    if len(seps) > 1 or not all(x.isascii() and x.isdigit() for x in g) or not (len(g) == 1 and 13 <= len(s) <= 19 or shape in ((4, 4, 4, 4, 3), (6, 13), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))):
        return False
    return luhn("".join(g))


def valid_iban(s):
    c = s.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", c) or {"DE": 22, "GB": 22, "NO": 15}.get(c[:2]) != len(c) or s not in (c, " ".join(c[i:i + 4] for i in range(0, len(c), 4))):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1 and 2 <= int(c[2:4]) <= 98


def valid_date(s):
    for sep in "-/.":
        for form in ("[0-9]{4}S[0-9]{2}S[0-9]{2}", "[0-9]{1,2}S[0-9]{1,2}S[0-9]{4}"):
            if re.fullmatch(form.replace("S", re.escape(sep)), s):
                a = [int(x) for x in s.split(sep)]
                for y, m, d in ([a] if a[0] > 999 else [(a[2], a[1], a[0]), (a[2], a[0], a[1])]):
                    try:
                        return 1800 <= datetime.date(y, m, d).year <= 2199
                    except ValueError:
                        pass
    return False


def values(t):
    """(start, end) of the values, by trying every stretch from left to right."""
    i, out = 0, []
    while i < len(t):
        before = t[i - 1] if i else " "
        for kind, valid in enumerate((valid_date, valid_iban, valid_card)):
            ok = not before.isdigit() if kind != 1 else not before.isalnum()
            ends = [j for j in range(i + 1, min(len(t), i + 45) + 1) if ok and not (t[j:j + 1].isdigit() or kind == 1 and t[j:j + 1].isalnum()) and valid(t[i:j])]
            if ends:
                out.append((i, max(ends)))
                i = max(ends) - 1
                break
        i += 1
    return out


CARD_19, IBAN = "6304 0000 0000 0000 000", "DE89 3704 0044 0532 0130 00"
ADJACENT = ["2024-02-29 2024-03-01", "order 12 4111 1111 1111 1111", "2024-02-29 4111 1111 1111 1111", "4111 1111 1111 1111 2024-02-29", "1234 4111 1111 1111 1111 5", CARD_19, "4000000000000000006",
            IBAN, "DE12 " + IBAN, "GB29NWBK60161331926819", "DE12 4111 1111 1111 1111 11", "29.2.2024 30.2.2024 12/25/2024 31/12/1999", "378282246310005-3782-822463-10005", "NO9386011117947 43.21.141.162"]


def test_adjacent_values_against_brute_force(spark, docs_of):
    r = random.Random(3)
    parts = [*ADJACENT, "4111", "12", "2024-02", "411111111111111111", "1.1.2024", "3/4/2024", "03/04/2024", "x", "NO93 8601 1117 947", "5555-5555-5555-4444", "é", "DE89"]
    texts = ADJACENT + ["".join(r.choice(parts) + r.choice([" ", "-", "", ", ", "."]) for _ in range(r.randint(1, 7))) for _ in range(400)]
    wanted = [values(t) for t in texts]
    alone = sorted({t[a:b] for t, v in zip(texts, wanted) for a, b in v})
    new = dict(zip(alone, [x["text"] for x in pseudonymise(docs_of(enumerate(alone)), "k").orderBy("doc_id").collect()]))
    got = [(x["text"], x["n_replaced"]) for x in pseudonymise(docs_of(enumerate(texts)), "k").orderBy("doc_id").collect()]
    for t, v, (g, n) in zip(texts, wanted, got):
        ends = [0, *[x for ab in v for x in ab], len(t)]
        want = "".join(t[a:b] if k % 2 == 0 else new[t[a:b]] for k, (a, b) in enumerate(zip(ends, ends[1:])))
        assert g == want and n == sum(new[t[a:b]] != t[a:b] for a, b in v), t
    assert [len(values(t)) for t in ADJACENT] == [2, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 3, 2, 1]
    assert all(len(values(x)) == 1 and values(x)[0] == (0, len(x)) for x in new.values()) and len(set(new.values())) == len(alone)


def test_equal_values_over_formats(spark, docs_of):
    same = [("4000 0000 0000 0000 006", "4000000000000000006"), (IBAN, IBAN.replace(" ", "")), ("2024-02-29", "29.02.2024")]
    got = [x["text"] for x in pseudonymise(docs_of(enumerate(x for p in same for x in p)), "k").orderBy("doc_id").collect()]
    assert got[0].replace(" ", "") == got[1] and got[2].replace(" ", "") == got[3] and got[4].split("-") == got[5].split(".")[::-1]
    days = [f"{d:02}/{m:02}/2024" for m in range(1, 13) for d in range(1, 29)] + [f"{m:02}/{d:02}/2024" for m in range(1, 13) for d in range(13, 29)]
    new = [x["text"] for x in pseudonymise(docs_of(enumerate(days)), "k").collect()]
    assert len(set(new)) == len(set(days)) and all(valid_date(x) for x in new)
