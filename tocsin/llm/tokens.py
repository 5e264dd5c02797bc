"""Exact merge-type subword encoding by backtracking, and decoding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.llm.common import small_batches, table

MARK = "▁"
#: Chunks found one by one (twice as many, in two generations, until the task ends) and pairs (four times) that a task remembers.
MEMO = 100_000
#: Runs of characters encoded side by side, at least and at most, and the characters of one; fewer or longer ones go one by one.
TOGETHER, SIDE, SHORT = 64, 32_000, 60
#: Places for what is known of pairs of pieces; a new pair takes the place of another one.
PAIRS = 1 << 20
#: The rank of what is no piece.
NEVER = 1e18


class Encoder:
    """The encoder of one model file.

    The text is the model's own normal form (blanks as the mark, one mark before the text). No piece holds a
    mark after another character, so a merge never crosses the border before a run of marks, nor one
    between two characters that stand side by side in no piece: those borders cut the text into chunks that
    are encoded on their own. Within a chunk the encoding is the only split whose neighbours are all
    compatible, that is, are what merging their joined text gives.
    """

    def __init__(self, file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.bytes = [0] * 256
        self.pieces = [""] * n
        self.names = list(map(str, range(n)))
        self.rank: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.byte_of: dict[int, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.bytes[self.byte_of[i]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i], self.ids[p], self.rank[p] = p, i, -sp.get_score(i)
        self._check(sp)
        self.trie = ahocorasick.Automaton()
        self.shorter = [-1] * n
        own = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merge(p) == [p]}
        self.size: dict[int, int] = {i: len(p) for p, i in own.items()}
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        #: by the beginning of a piece: the longest piece that it begins with
        self.longest: dict[str, int] = {}
        for p, i in own.items():
            self.trie.add_word(p, i)
            self.shorter[i] = next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1)
            self.longest.update((p[:k], self.shorter[i]) for k in range(1, len(p)) if p[:k] not in self.longest)
        for p in sorted(self.longest, key=len):
            self.longest[p] = own.get(p, self.longest.get(p[:-1], -1))
        self.longest.update(own)
        self.span = max(map(len, own), default=1)
        self.own = own
        self._make_steps()
        #: by the left piece: whether the right one is compatible with it
        self.fits: list[dict[int, bool]] = [{} for _ in range(n)]
        self.n_fits = 0
        self.spines = Table(self._spines)
        self.alphabet = {p for p in own if len(p) == 1}
        inner = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(pair[1] == MARK and pair[0] != MARK for pair in inner):
            raise ValueError("a piece has the mark inside")
        self.linked = inner
        self.words = Memo(self._run_text)
        self.parts = re.compile(rf"{MARK}+[^\W\d_]*|[^\W\d_]+|[\W\d_]+").findall

    def _make_steps(self) -> None:
        """The beginnings of pieces, numbered, as arrays: the step from one to the next by a character."""
        self.sizes = np.array([self.size.get(i, 0) for i in range(len(self.pieces))])
        self.cut = np.array(self.shorter)
        self.name_of, self.text_of = pa.array(self.names), pa.array(self.texts)
        self.code = np.zeros(0x110000, np.int32)
        for k, c in enumerate(sorted({c for p in self.own for c in p})):
            self.code[ord(c)] = k + 1
        self.width = int(self.code.max()) + 1
        number = {p: k for k, p in enumerate(["", *sorted(self.longest)])}
        self.best = np.array([-1, *map(self.longest.__getitem__, sorted(self.longest))])
        steps = sorted((number[p[:-1]] * self.width + int(self.code[ord(p[-1])]), k) for p, k in number.items() if p)
        self.step_key, self.step_to = np.array(steps, np.int64).T.copy()
        self.pair_key, self.pair_fits = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

    def _longest_at(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest piece that begins at each place; a code of 0 ends a run."""
        node, going, to = np.zeros(len(at), np.int64), np.arange(len(at)), at
        while len(going):
            key = node[going] * self.width + codes[to]
            k = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            on = self.step_key[k] == key
            going, to = going[on], to[on] + 1
            node[going] = self.step_to[k[on]]
        return self.best[node]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of pieces."""
        key = a.astype(np.int64) * len(self.pieces) + b
        place = (key * 0x9E3779B1 >> 12) % PAIRS
        out, new = self.pair_fits[place], np.flatnonzero(self.pair_key[place] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = np.array([self.compatible(*divmod(k, len(self.pieces))) for k in keys.tolist()])
            out[new] = found[back]
            self.pair_key[place[new]], self.pair_fits[place[new]] = key[new], out[new]
        return out

    def together(self, runs: list[str]) -> tuple[list[str], list[str], list[str]]:
        """(runs, ids, texts) of short runs of characters that are pieces, by the search of ``_known`` in all of them side by side.

        In each round every run takes its next piece, tries a shorter one or goes back by a piece. The last few are left out.
        """
        codes = self.code[np.frombuffer("\0".join([*runs, ""]).encode("utf-32-le"), "<u4")]
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        begin = np.cumsum(size + 1) - size - 1
        codes[begin + size] = 0
        live, at, depth, failed = np.arange(len(runs)), *np.zeros((3, len(runs)), np.int64)
        out = np.zeros((len(runs), SHORT + 1), np.int32)  # the pieces taken, after one that stands for the start
        out[:, 0] = -1
        token = self._longest_at(codes, begin)
        while len(live) >= TOGETHER:
            t, end, last = token[live], at[live], out[live, depth[live]]
            end = end + self.sizes[t]
            ok = (t >= 0) & (failed[live] >> end & 1 == 0)
            inner = np.flatnonzero(ok & (last >= 0))
            ok[inner] = self._fit(last[inner], t[inner])
            on, to = live[ok], end[ok]
            depth[on] += 1
            out[on, depth[on]], at[on] = t[ok], to
            on = on[to < size[on]]
            token[on] = self._longest_at(codes, begin[on] + at[on])
            shorter = live[~ok & (t >= 0)]
            token[shorter] = self.cut[token[shorter]]
            back = live[t < 0]
            failed[back] |= 1 << at[back]
            was = out[back, depth[back]]
            depth[back] -= 1
            at[back] -= self.sizes[was]
            token[back] = self.cut[was]
            live = live[at[live] < size[live]]
        done = at == size
        tokens = out[:, 1:][(np.arange(SHORT) < depth[:, None]) & done[:, None]]
        offsets = pa.array(np.concatenate([[0], np.cumsum(depth[done])]), pa.int32())
        ids, texts = (pc.binary_join(pa.ListArray.from_arrays(offsets, c.take(pa.array(tokens))), sep).to_numpy(zero_copy_only=False).tolist()
                      for c, sep in ((self.name_of, ","), (self.text_of, "")))
        return [*compress(runs, done.tolist())], ids, texts

    def found(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Ids and texts of distinct words. Their distinct chunks are found together, as far as that goes."""
        cut = {w: self.chunks(w) for w in words if not w[1:].isalpha()}
        runs = dict.fromkeys([w for w in words if w not in cut] if cut else words)
        runs.update(dict.fromkeys(chain.from_iterable(cut.values())))
        plain = self.alphabet.issuperset
        short = [c for c in runs if len(c) <= SHORT and plain(c)]
        ids, texts = {}, {}
        for k in range(0, len(short), SIDE):
            some, *got = self.together(short[k:k + SIDE])
            ids.update(zip(some, got[0]))
            texts.update(zip(some, got[1]))
        for c in runs.keys() - ids.keys():
            ids[c], texts[c] = self.words[c]
        for of, sep in ((ids, ","), (texts, "")):
            of.update([(w, sep.join(map(of.__getitem__, c))) for w, c in cut.items()])
        return [*map(ids.__getitem__, words)], [*map(texts.__getitem__, words)]

    @staticmethod
    def _check(sp) -> None:
        """Only plain models: one mark before the text, nothing else changed, unknown characters as bytes."""
        for probe in ("a", " a  b ", "Ａ́ 　x\t\n"):
            if sp.decode(sp.encode(probe)) != probe or not any(map(sp.is_byte, range(sp.get_piece_size()))):
                raise ValueError("the model normalises texts or has no byte pieces")

    def _merge(self, text: str) -> list[str]:
        """Merging from single characters: the best rank first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == NEVER:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _spines(self, i: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece is merged from its characters: the rank of each step (none left: NEVER), and the first and the
        last part before each step."""
        parts = list(self.pieces[i])
        ranks, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            rank, k = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            ranks.append(rank)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return [*ranks, NEVER], firsts, lasts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives just these two.

        Both pieces are merged again side by side, step by step in order of rank (the left one first of equals), and at
        each step the last part of the left piece and the first part of the right one must not be the better merge.
        """
        known = self.fits[a].get(b)
        if known is not None:
            return known
        if self.n_fits >= 4 * MEMO:
            for right in self.fits:
                right.clear()
            self.n_fits = 0
        (left, _, lasts), (right, firsts, _) = self.spines[a], self.spines[b]
        rank, i, j = self.rank.get, 0, 0
        across = rank(lasts[0] + firsts[0], NEVER)
        while True:
            x, y = left[i], right[j]
            if across < x and across <= y:
                known = False
                break
            if x <= y:
                if x == NEVER:
                    known = True
                    break
                i += 1
            else:
                j += 1
            across = rank(lasts[i] + firsts[j], NEVER)
        self.fits[a][b] = known
        self.n_fits += 1
        return known

    def _known(self, s: str) -> list[int]:
        """Ids of a run of characters that are pieces themselves."""
        whole = self.own.get(s)
        if whole is not None:
            return [whole]
        n, span = len(s), self.span
        failed: bytearray | None = None
        longest, reach = self.longest, self.trie.longest_prefix
        size, shorter, fits, compatible = self.size, self.shorter, self.fits, self.compatible
        token = longest[s[:reach(s[:span])]]
        out, at, last = [token], size[token], token  # nothing stands before the first one
        if at == n:
            return out
        ahead = s[at:at + span]
        token = longest[ahead[:reach(ahead)]]
        while True:
            right = fits[last] if last >= 0 else None
            while token >= 0:
                end = at + size[token]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if right is None:
                        break
                    ok = right.get(token)
                    if compatible(last, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, ahead = end, token, s[end:end + span]
                token = longest[ahead[:reach(ahead)]]
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
                token = shorter[token]

    def chunk(self, s: str) -> list[int]:
        """Ids of one chunk; characters that are no pieces become their bytes."""
        if self.alphabet.issuperset(s):
            return self._known(s)
        ids, out, at = self.alphabet, [], 0
        for k, c in enumerate(s):
            if c not in ids:
                if k > at:
                    out += self._known(s[at:k])
                out += [self.bytes[b] for b in c.encode("utf-8")]
                at = k + 1
        if at < len(s):
            out += self._known(s[at:])
        return out

    def _run_text(self, run: str) -> tuple[str, str]:
        """Ids and text of one chunk."""
        ids = self.chunk(run)
        return ",".join(map(self.names.__getitem__, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; runs of byte pieces are UTF-8, what is none becomes U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.texts.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def chunks(self, word: str) -> list[str]:
        """A word (marks, then other characters) cut where its neighbours stand side by side in no piece."""
        parts = self.parts(word)
        if len(parts) == 1:
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if out[-1][-1] + p[0] in self.linked:
                out[-1] += p
            else:
                out.append(p)
        return out

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, number of ids, decoded text)."""
        return tuple(c[0].as_py() for c in self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """What ``encode`` gives, for a column of texts: each word is looked up once, however often the column has it."""
        texts = pc.fill_null(texts, "")
        full = pc.not_equal(texts, "")
        words = pc.split_pattern(self.marked(texts), " ")
        coded = words.values.dictionary_encode()
        got = self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, decoded = (pc.binary_join(pa.ListArray.from_arrays(words.offsets, pa.array(g, pa.string()).take(coded.indices)), sep)
                        for g, sep in zip(got, (",", "")))
        ids, decoded = (pc.if_else(full, c, "") for c in (ids, pc.utf8_slice_codeunits(decoded, 1)))
        n = pc.add(pc.count_substring(ids, ",").cast(pa.int64()), full.cast(pa.int64()))
        return ids, n, decoded

    @staticmethod
    def marked(texts: pa.Array) -> pa.Array:
        """The normal form of texts, with a blank ahead of each run of marks but the first: between the words."""
        texts = pc.replace_substring(pc.replace_substring(texts, MARK, " "), " ", f" {MARK}")
        texts = pc.binary_join_element_wise(MARK, texts, "")
        while pc.any(pc.match_substring(texts, f"{MARK} {MARK}")).as_py():
            texts = pc.replace_substring(texts, f"{MARK} {MARK}", MARK * 2)
        return texts


class Table(dict):
    """What ``make`` gave for a key; for keys that are few, such as pieces."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Memo(dict):
    """What ``make`` gave for a key, for short keys: the last MEMO new ones, and of those before what was used since."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > SHORT:
                return value
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before = {}


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file if os.path.exists(file) else SparkFiles.get(os.path.basename(file)))


def encode_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with token_ids (decimal, comma-joined), n_tokens and decoded, replacing columns of these names.

    The ids are those of the model's own library without begin and end ids. Null and empty texts have no
    tokens and decode to "". Rows stay as they are, repeated ones included. The model file must be readable
    on each executor at this path or be sent there with addFile. Nothing is shuffled.
    """
    base = docs.drop("token_ids", "n_tokens", "decoded")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_file)
        try:
            yield from encoded(enc, batches)
        finally:  # the worker may live on for other stages
            enc.words.forget()

    def encoded(enc: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(b):  # a few million characters at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
                part = b.slice(at, to - at)
                new = enc.encode_all(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "token_ids", "n_tokens", "decoded"])
                at = to

    schema = base.limit(0).withColumns({"token_ids": F.lit(""), "n_tokens": F.lit(0).cast("long"), "decoded": F.lit("")}).schema
    return base.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, default_model())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
