"""Token ids of a column of texts, by a tokenizer file and the tokenizers library, inside Arrow tasks.

The ids are those of a plain call of the library on each whole text: special tokens that a text
spells out become their ids. Texts are cut into chunks at places no token reaches across, each
distinct chunk of a run of rows is encoded once, by the library, and recent chunks are remembered;
ids are put together by array indexing. The rules below belong to the two kinds of file they name,
and an encoder asks the library about them when it opens a file; another file has its texts encoded
whole.

* A vocabulary with word ends drops white space and never joins characters across it, so chunks lie
  between blanks. A run of letters is one word there, and a point or comma after it a token of its
  own, as long as every letter is still one letter after the tokenizer's normaliser; the letters for
  which this holds are found by asking the library.
* A byte-level vocabulary attaches one blank to what follows it and keeps letters, signs and white
  space apart, so texts are cut before every blank that is followed by no other white space, between
  a Latin letter and a point or comma, and between either and a line end.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from lacuna.llm.words import ragged, runs

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 250_000
JOINED = 256  # words in a row; longer rows cost the library more a character
SEPARATOR = "\ue000"  # a private character, of its own between blanks
KEEP_CASE = "[\u0300-\u036f]|<[|]"  # marks that compose, and what special tokens begin with
BLANK = "\u0120"  # how byte-level vocabularies write a blank
MARKS = {" ": BLANK, "\n": "\u010a"}  # what a chunk may begin with, and how they write it
BLANK_TO_KEEP = r" (?:[^\pL\pN\pP\pS\pM]|$)"
LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
BYTE_CUTS = [
    (r" ([\pL\pN\pP\pS\pM])", SEPARATOR + r" \1"),
    (f"({LATIN})([.,])", r"\1" + SEPARATOR + r"\2"),
    (f"({LATIN}|[.,])\n", r"\1" + SEPARATOR + "\n"),
]
LETTERS = 0x250  # code points asked for as letters: Basic Latin to Latin Extended-B


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encoder(texts)`` gives, per run of rows, (lo, hi, all ids, offsets of the rows in them).

    This class encodes whole texts; the others cut them first.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for lo, hi in runs(texts):
            lists = self.chunks(pc.fill_null(texts.slice(lo, hi - lo), ""))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
            coded = lists.flatten().dictionary_encode()
            known = self.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            flat = np.frombuffer(b"".join(known), "<u4")
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            first = np.cumsum(sizes) - sizes
            chunk = coded.indices.to_numpy(zero_copy_only=False)
            each = sizes[chunk]
            yield lo, hi, flat[ragged(first[chunk], each)], np.concatenate([[0], np.cumsum(each)])[ends]

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)

    def known(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk, as little-endian 32-bit integers."""
        return self.one_by_one(chunks)

    def remembered(self, chunks: list[str]) -> list[str]:
        """The chunks whose ids are not in ``recent``."""
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        missing = [c for c in chunks if c not in recent]
        if not older:
            return missing
        recent.update((c, older[c]) for c in missing if c in older)
        return [c for c in missing if c not in older]

    def recalled(self, chunks: list[str]) -> list[bytes]:
        """``known`` for distinct chunks, each looked up once; what is not remembered is learnt."""
        found = list(map(self.recent.get, chunks))
        places = [i for i, ids in enumerate(found) if ids is None]
        self.learn(self.remembered([chunks[i] for i in places]))
        for i in places:
            found[i] = self.recent[chunks[i]]
        return found

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks that are not remembered into ``recent``."""
        self.recent.update(zip(chunks, self.one_by_one(chunks)))

    def row(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class WordEncoder(Encoder):
    """For vocabularies with word ends (``</w>``) that drop white space."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(tokenizer)
        self.cut = self.row(SEPARATOR)
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.points = dict(zip(".,", self.one_by_one([".", ","])))
        letters = [chr(c) for c in range(LETTERS) if chr(c).isalpha()]
        alone, pointed = self.one_by_one(letters), self.one_by_one([c + "." for c in letters])
        self.letters = {c for c, a, b in zip(letters, alone, pointed) if b == a + self.points["."] and self.last[np.frombuffer(a, "<u4")].sum() == 1}
        self.plain = self.letters.issuperset(ascii_letters)  # then a glance tells most words

    @staticmethod
    def suits(tokenizer: Tokenizer) -> bool:
        def ids(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        return any(t.endswith("</w>") for t in tokenizer.get_vocab()) and ids(" ab,  3 \n\tcd ") == ids("ab,") + ids("3") + ids("cd")

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        # the tokenizer lowers letters itself, after composing marks; do it early where that can't matter
        lower = pc.if_else(pc.match_substring_regex(texts, KEEP_CASE), texts, pc.ascii_lower(texts))
        return pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")

    def known(self, chunks: list[str]) -> list[bytes]:
        return self.recalled(chunks)

    def learn(self, chunks: list[str]) -> None:
        recent, is_word = self.recent, self.letters.issuperset
        words, ended, others = set(), [], []
        plain = self.plain
        for c in chunks:
            if plain and c.isascii() and c.isalpha() or c and is_word(c):
                words.add(c)
            elif c[-1:] in self.points and c[:-1] and is_word(c[:-1]):
                ended.append(c)
                if c[:-1] not in recent:
                    words.add(c[:-1])
            else:
                others.append(c)
        for some in _cut(list(words)):
            recent.update(zip(some, self.encode_words(some)))
        for c in ended:
            recent[c] = recent[c[:-1]] + self.points[c[-1]]
        for some in _cut(others):
            recent.update(zip(some, self.encode_chunks(some)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Runs of letters are one token with a word end each: encode them in a row, cut after word ends."""
        ids = self.row(" ".join(words))
        stops = np.flatnonzero(self.last[ids]) + 1
        return _pieces(ids, np.concatenate([[0], stops[:-1]]), stops) if len(stops) == len(words) else self.one_by_one(words)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Any chunks: encode them in a row with a separator between, cut there."""
        ids = self.row(f" {SEPARATOR} ".join(chunks))
        n = len(self.cut)
        at = np.flatnonzero(np.logical_and.reduce([ids[j : len(ids) - n + 1 + j] == self.cut[j] for j in range(n)])) if len(ids) >= n else np.zeros(0, np.int64)
        if len(at) != len(chunks) - 1:  # a chunk holds the separator itself
            return self.one_by_one(chunks)
        return _pieces(ids, np.concatenate([[0], at + n]), np.concatenate([at, [len(ids)]]))


class ByteEncoder(Encoder):
    """For byte-level vocabularies that attach one blank to the letters after it."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(tokenizer)
        vocabulary = tokenizer.get_vocab()
        self.first = {mark: np.zeros(max(vocabulary.values()) + 1, bool) for mark in MARKS}
        for mark, written in MARKS.items():
            self.first[mark][[i for token, i in vocabulary.items() if token.startswith(written)]] = True

    @staticmethod
    def suits(tokenizer: Tokenizer) -> bool:
        def ids(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        parts = [" ab", ", 3", " cd \n ", " ef", ".", "\nGh", "\n\nij", ",", " gh", "\nIj*", "\nkl"]
        return BLANK in tokenizer.get_vocab() and ids("".join(parts)) == [i for p in parts for i in ids(p)]

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        if pc.any(pc.match_substring(texts, SEPARATOR)).as_py():
            return super().chunks(texts)
        # where every blank is one to cut at, no pattern is needed
        (pattern, cut), *others = BYTE_CUTS
        odd = pc.match_substring_regex(texts, BLANK_TO_KEEP)
        plain = pc.replace_substring(texts, " ", SEPARATOR + " ")
        texts = pc.replace_with_mask(plain, odd, pc.replace_substring_regex(texts.filter(odd), pattern, cut))
        for pattern, cut in others:
            texts = pc.replace_substring_regex(texts, pattern, cut)
        return pc.split_pattern(texts, SEPARATOR)

    def known(self, chunks: list[str]) -> list[bytes]:
        return self.recalled(chunks)

    def learn(self, chunks: list[str]) -> None:
        recent = self.recent
        marked: dict[str, list[str]] = {mark: [] for mark in MARKS}
        others = []
        for c in chunks:
            whole = c[:1] in marked and len(c) > 1 and not c[1].isspace() and " " not in c[1:] and (c[0] == " " or "\n" not in c[1:])
            (marked[c[0]] if whole else others).append(c)
        for mark, own in marked.items():
            for some in _cut(own):
                recent.update(zip(some, self.encode_marked(some, mark)))
        for some in _cut(others):
            recent.update(zip(some, self.one_by_one(some)))

    def encode_marked(self, chunks: list[str], mark: str) -> list[bytes]:
        """Chunks that hold one blank, or one line end, at their start: encode them in a row, cut where tokens begin with it."""
        ids = self.row("".join(chunks))
        starts = np.flatnonzero(self.first[mark][ids])
        if len(starts) != len(chunks):
            return self.one_by_one(chunks)
        return _pieces(ids, starts, np.append(starts[1:], len(ids)))


def _cut(chunks: list[str]) -> Iterator[list[str]]:
    return (chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED))


def _pieces(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[a:z] for a, z in zip((4 * starts).tolist(), (4 * stops).tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        tokenizer = Tokenizer.from_file(path)
        kind = next((k for k in (WordEncoder, ByteEncoder) if k.suits(tokenizer)), Encoder)
        _ENCODERS[path] = kind(tokenizer)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` appended to every row."""
    rows = np.arange(len(offsets))
    return np.insert(ids, offsets[1:], np.uint32(end)).astype("<u4"), offsets + rows
