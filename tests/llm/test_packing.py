import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from conftest_llm import ODD_ROWS
from tocsin.llm import packing as P

FILE = P.default_file()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, library, capacity):
    """Every id in exactly one piece, sequences gapless and without padding."""
    want = sorted((d is None, d or 0, tuple(ids_of(library, t))) for d, t in docs)
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert 0 < len(ids) == r["length"] <= capacity
        pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], tuple(ids.tolist())))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    for d, group in itertools.groupby(want, lambda x: x[:2]):
        texts = [x[2] for x in group]
        got = pieces.pop(None if d[0] else d[1])
        assert Counter(i for t in texts for i in t) == Counter(i for p in got for i in p[2])
        if len(texts) == 1:
            got.sort()
            assert sum((list(p[2]) for p in got), []) == list(texts[0])
            assert [p[0] for p in got] == [sum(len(q[2]) for q in got[:k]) for k in range(len(got))]
            assert {p[1] for p in got} == {len(texts[0])}
    assert not pieces
    return places


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(spark, docs_of, library, capacity):
    r = random.Random(capacity)
    docs = [(k, "word " * r.choice([0, 1, 3, 20, 62, 63, 64, 127, 500])) for k in range(300)] + [(900, None), (901, "é日本 <|endoftext|> 's"), (902, "a b " * 9_000)]
    places = check(P.pack(docs_of(docs, extra=True).repartition(5), FILE, capacity=capacity).collect(), docs, library, capacity)
    assert sum(sum(n for _, n in p) < capacity for p in places.values()) <= capacity.bit_length()


def test_odd_rows(spark, docs_of, library):
    check(P.pack(docs_of(ODD_ROWS), FILE).collect(), ODD_ROWS, library, 4096)
    assert P.pack(docs_of([]), FILE).collect() == []


def test_ids_are_the_librarys(library):
    enc = P._encoder(FILE)
    assert enc.simple
    r = random.Random(2)
    kinds = ["abcXYZ 'slltrevdm09.,!\n\t\r", "éÈàçÿÀÖ×÷ßªº½²\x85\xa0", "\x0b\x0c\x1c\x1f\x00\x7f", "日本😀İΣσςŉ́ ", "<|endoftext|>", "I'LL don't it's We'RE"]
    for _ in range(3_000):
        s = "".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(60))) + r.choice(["", "<|endoftext|>", "I'LL 'S 'Re"])
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(P, "MEMO", 10)
    enc = P.Encoder(FILE)
    s = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))
    assert np.frombuffer(enc.encode(s + s), "<u4").tolist() == library.encode(s + s, add_special_tokens=False).ids
    assert len(enc.new) + len(enc.old) <= 20


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_closest_fill_against_all_sums(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    used = P.closest_fill(counts, sorted(counts), room)
    assert all(0 < n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 200), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_token_once(counts):
    plan = P.Plan(counts, 64)
    filled = defaultdict(list)
    for rest, n in counts.items():
        for number in range(n):
            at = 0
            for start, length, sequence, offset in plan.pieces(rest, number):
                assert start == at and length > 0
                at += length
                filled[sequence].append((offset, length))
            assert at == rest
    assert sorted(filled) == list(range(plan.sequences))
    short = 0
    for got in filled.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
        short += at < 64
    assert short <= 6


def test_large_counts_need_few_choices():
    r = random.Random(3)
    counts = {k: int(r.paretovariate(0.7) * 1_000_000) for k in range(1, 4096)}
    plan = P.Plan(counts)
    assert sum(map(len, plan.slots.values())) < 120_000
    assert plan.sequences == -(-sum(k * n for k, n in counts.items()) // 4096) + 0 or plan.sequences <= sum(k * n for k, n in counts.items()) // 4096 + 12


def test_query_checksums(spark, library):
    import duckdb

    sf = "/root/testdata/sf0.001"
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for r in P.query(spark, sf).collect():
        ids = ids_of(library, docs[r["doc_id"]])
        own = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(own), len(ids))
