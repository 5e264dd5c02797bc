import random

import pyarrow as pa
import pytest
import sentencepiece

from conftest_llm import ODD_ROWS
from tocsin.llm import tokens as K
from tocsin.llm.tokens import Encoder, default_model, encode_texts


@pytest.fixture(scope="module")
def both():
    return Encoder(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())


def same(both, text):
    enc, sp = both
    ids = sp.encode(text)
    assert enc.encode(text) == (",".join(map(str, ids)), len(ids), sp.decode(ids)), text


def test_random_strings(both):
    r = random.Random(1)
    alphabet = "abcdefgh   ▁.,\n\tàéß漢字日本😀12345__--ABĆ\x00'\"the ing er on in re ation<s>"
    for _ in range(3000):
        same(both, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40))))


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "▁", "<s></s><unk><0x41>", "a" * 4000, "=-" * 900, "qwertz" * 500, " " * 500, "\r\n 　"])
def test_special_strings(both, text):
    same(both, text)


def test_compatible_is_merging_the_joined_text(both):
    enc, r = both[0], random.Random(2)
    own = sorted(enc.size)
    by_first = {}
    for i in own:
        by_first.setdefault(enc.pieces[i][0], []).append(i)
    known = [i for i in own if enc.pieces[i][0] != "▁"]
    found = set()
    for _ in range(20_000):
        a = r.choice(own)
        longer = r.choice(by_first[enc.pieces[a][0]])  # pairs whose joined text often holds another piece
        rest = enc.pieces[longer][len(enc.pieces[a]):] if enc.pieces[longer].startswith(enc.pieces[a]) else ""
        b = enc.ids.get(rest) if rest and enc.ids.get(rest) in enc.size else r.choice(known)
        p, q = enc.pieces[a], enc.pieces[b]
        want = enc._merge(p + q) == [p, q]
        assert enc.compatible(a, b) == want, (p, q)
        found.add(want)
    assert found == {True, False}


def test_table(spark, docs_of, both):
    got = encode_texts(docs_of(ODD_ROWS, extra=True), default_model()).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        ids = both[1].encode(r["text"] or "")
        assert (r["token_ids"], r["n_tokens"], r["decoded"]) == (",".join(map(str, ids)), len(ids), both[1].decode(ids))
    assert encode_texts(docs_of([]), default_model()).collect() == []


def test_plain_words_are_not_cut(both, monkeypatch):
    """A word of letters alone is one chunk; only others are looked through for borders."""
    enc, sp = both
    text = "zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich"
    enc.words.forget()
    monkeypatch.setattr(enc, "chunks", lambda word: pytest.fail(f"{word} was cut"))
    assert enc.encode(text)[0] == ",".join(map(str, sp.encode(text)))


def test_pairs_are_kept_by_their_left_piece_and_bounded(both, monkeypatch):
    enc, sp = both
    r = random.Random(3)
    monkeypatch.setattr(K, "MEMO", 50)
    for _ in range(300):
        text = "".join(r.choice("abcderingon") for _ in range(30))
        assert enc.encode(text)[0] == ",".join(map(str, sp.encode(text)))
        assert sum(map(len, enc.fits)) == enc.n_fits <= 200


def test_column_is_encoded_side_by_side(both, monkeypatch):
    """Words of a column are found together, ways back included; single ones remain only for bytes, long and last runs."""
    enc, sp = both
    r = random.Random(4)
    syllables = ["tion", "the", "an", "er", "ée", "qu", "ß", "in", "re", "o", "st", "wh", "X", "Ł", "зв", "漢字", "é", "ing"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 7))) + r.choice(["", "", ".", ".\nEr", "  ", "▁x", "'s", "😀"])
    texts = [None, "", " ", "▁", *(" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(400)), "anst" * 300]
    single, chunk = [], Encoder.chunk
    monkeypatch.setattr(Encoder, "chunk", lambda self, s: single.append(s) or chunk(self, s))
    enc.words.forget()
    column = pa.array(["unused", *texts], pa.string()).slice(1)
    got = list(zip(*(c.to_pylist() for c in enc.encode_all(column))))
    ids = [sp.encode(t or "") for t in texts]
    assert got == [(",".join(map(str, i)), len(i), sp.decode(i)) for i in ids]
    assert len([s for s in single if len(s) <= K.SHORT and enc.alphabet.issuperset(s)]) < K.TOGETHER
