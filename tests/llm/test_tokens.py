"""Tokens, shard files and packing against the tokenizers library and brute force."""

import collections
import functools
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import packing, wavelet
from lacuna.llm.tokens import ByteEncoder, Encoder, WordEncoder, encoder, vocabulary_path

ROWS = [(5, "The cat, sat."), (None, "no id"), (2, None), (3, ""), (2, "two"), (2, "two"), (9, "long words " * 4000), (7, " odd ́ \t it's 12 <|endoftext|>")]


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def reference():
    return tokenizer(vocabulary_path())


def plain(texts, tokenizer=None):
    return [e.ids for e in (tokenizer or reference()).encode_batch([x or "" for x in texts], add_special_tokens=False)]


#: Letters that decompose or take marks before points, special strings, blanks of all kinds.
ODD = [
    "TÜRKİ.", "ŞEHRİ, VE", "İ.", "i̇.", "I\u0307, x", "e\u0301. E\u0301.", "ǰ. ŉ, ß. ẞ.", "a<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>.", "<| endoftext|>",
    " lead", "two  blanks ", "a \n b", "\n\n c", "x\u00a0y \u2003z", "don't WE'LL 'S", "n12 3.4,5 #a _b", "\ue000 own", "a \ue000 b", "한국. 中文, ﬁ. \ufb1d.", " <|endoftext|> a", "\x00 a b", "ab\r\n cd",
]


def encoded(own, texts):
    got = []
    for _, _, ids, offsets in own(pa.array(texts, pa.string())):
        got += [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:])]
    return got


def test_odd_texts():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        whole = Tokenizer.from_file(path)
        texts = [*ODD, " ".join(ODD), *[a + b for a in ODD for b in (".", " The", ODD[0], " x<|endoftext|>")]]
        assert encoded(encoder(path), texts) == plain(texts, whole)
        assert encoded(Encoder(whole), texts) == plain(texts, whole)


TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("aBÉ,. '\n\t1İΣ́ \u00a0\ue000", max_size=20) | st.lists(st.sampled_from(ODD), max_size=4).map(" ".join), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoder_equals_the_library(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        assert encoded(encoder(path), texts) == plain(texts, tokenizer(path))


def test_encoder_forgets():
    own = WordEncoder(reference())
    rng = random.Random(0)
    for _ in range(3):
        own.recent = {str(i): b"" for i in range(300_000)}
        text = " ".join("".join(rng.choice("abc") for _ in range(5)) for _ in range(200))
        ((_, _, ids, _),) = own(pa.array([text]))
        assert ids.tolist() == plain([text])[0]


def test_shard_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 50_000, 150_000), np.full(5000, 7)]).astype("<u4")
    ends = np.array([0, 10, 70_000, len(ids)])
    shard = wavelet.Shard(b"".join(wavelet.pack_shard(ids, ends, pa.array([4, None, 5, 6], pa.int64()))))
    assert (shard.ids() == ids).all() and shard.doc_ids.to_pylist() == [4, None, 5, 6] and (shard.ends == ends).all()
    for i in [0, 9, 65_535, 65_536, len(ids) - 1]:
        assert shard.token(i) == ids[i]
    for token in [7, int(ids[3]), 49_999, 1 << 20]:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 100, 140_000) == ((places >= 100) & (places < 140_000)).sum()
        assert [shard.select(token, n) for n in range(0, len(places), 997)] == places[::997].tolist()
    empty = wavelet.Shard(b"".join(wavelet.pack_shard(np.zeros(0, "<u4"), np.zeros(0, np.int64), pa.array([], pa.int64()))))
    assert len(empty.ids()) == 0 and empty.count(3) == 0


def test_shards(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, start int")
    manifest = wavelet.write_shards(df)
    got = wavelet.read_shards(manifest).collect()
    rows = sorted(zip(ROWS, plain([t for _, t in ROWS])), key=lambda r: (r[0][0] is not None, r[0][0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0][0] for r in rows]
    want = collections.Counter((i, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (i, _), x in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got)[-1] + max(got, key=lambda r: r.start).n_tokens == sum(n * k for (_, n, _), k in want.items())
    token = plain(["long"])[0][0]
    assert wavelet.occurrences(manifest, token).count() == 4000
    assert wavelet.read_shards(wavelet.write_shards(df.limit(0))).count() == 0


def placed(counts, capacity):
    """Bins of the plan as lists of lengths; checks that places are gapless."""
    p = packing.plan(counts, capacity)
    bins = collections.defaultdict(list)
    used = collections.Counter()
    for length, first, n, start, offset in zip(p.length, p.first, p.count, p.bin, p.offset):
        assert first == used[length]
        used[length] += n
        for k in range(n):
            bins[start + k].append((offset, length))
    assert used == collections.Counter({k: v for k, v in counts.items() if v})
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == p.bins
    return bins


def one_by_one(counts, capacity):
    """The same packing, piece after piece."""
    lengths = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    large, gaps = [x for x in lengths if 3 * x > capacity], []
    while large:
        x = large.pop(0)
        mate = next((y for y in large if x + y <= capacity), None)
        if mate is not None:
            large.remove(mate)
        gaps.append(capacity - x - (mate or 0))
    for x in (x for x in lengths if 3 * x <= capacity):
        best = min((g for g in gaps if g >= x), default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(best)
            gaps.append(best - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=15))
def test_plan(counts):
    bins = placed(counts, 40)
    assert len(bins) == one_by_one(counts, 40)
    for items in bins.values():
        assert sum(3 * n > 40 for _, n in items) <= 2


def test_pack(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS * 3], "doc_id long, text string, length string")
    got = packing.pack(df, capacity=64, ids=True).collect()
    want = collections.Counter()
    for (i, _), x in zip(ROWS, plain([t for _, t in ROWS])):
        ids = np.array([*x, 0], "<u4")
        for p in range(0, len(ids), 64):
            want[i, p // 64, p, len(ids[p : p + 64]), zlib.crc32(ids[p : p + 64].tobytes())] += 3
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= 64
    assert packing.pack(df.limit(0)).count() == 0


def test_planes_are_split_by_stretches():
    rng = np.random.default_rng(5)
    for n in (0, 1, wavelet.STRETCH, 2 * wavelet.STRETCH + 7):
        ids, bits = rng.integers(0, 70_000, n).astype("<u4"), rng.random(n) < 0.4
        got = wavelet._split(ids, bits, n - int(bits.sum()))
        assert np.array_equal(got, np.concatenate([ids[~bits], ids[bits]]))
        for some in (ids, ids % 49_000):
            shard = wavelet.Shard(b"".join(wavelet.pack_shard(some, np.array([n]), pa.array([1]))))
            assert np.array_equal(shard.ids(), some)
            assert all(shard.token(i) == some[i] for i in range(0, n, 9_999))


def test_older_chunks_are_remembered():
    found = Encoder.__new__(Encoder)
    found.recent, found.older = {"a": b"1"}, {"b": b"2"}
    assert found.remembered(["b", "a", "c"]) == ["c"] and found.recent == {"a": b"1", "b": b"2"}


def test_line_starts_are_encoded_in_a_row():
    path = vocabulary_path("byte_bpe_50k.json")

    class Counting:
        rows = 0

        def encode_batch_fast(self, texts, add_special_tokens):
            self.rows += len(texts)
            return tokenizer(path).encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    own = ByteEncoder(tokenizer(path))
    own.tokenizer = Counting()
    words = ["".join(p) for p in itertools.product("ABC", "aeiou", "lmnr", "stu")]
    texts = ["\n".join(words), "a  b\n\nC \n D\tE.", " ".join(words), "", "x " + "\n".join(reversed(words)), None]
    assert encoded(own, texts) == plain(texts, tokenizer(path))
    assert own.tokenizer.rows < 20  # of 180 words, each after a line end and after a blank
