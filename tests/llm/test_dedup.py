"""Exact and near duplicates against brute force."""

import collections
import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import base, exact_dedup, near_dedup, words

SCHEMA = "doc_id long, text string, node string, length int"  # two names the operators use themselves


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, "..."), (None, "one two"), (3, "one two"), (None, None)]
    for g in range(6):
        body = sentence(rng, 120).split()
        for k in range(5):
            mine = list(body)
            for _ in range(k):
                mine[rng.randrange(len(mine))] = "changed%d" % rng.randrange(10**6)
            out.append((100 + 10 * g + k, " ".join(mine)))
    out += [(200, "a b c d e " * 3000), (201, "a b c d e " * 3000), (202, "word " * 20000)]
    return out


@pytest.mark.parametrize("keeper", ["min", "max"])
def test_exact(spark, texts, keeper):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = []
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (min if keeper == "min" else max)(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    for content_hash in (F.xxhash64, lambda c: F.lit(1)):  # one hash for all: every text meets every other
        got = exact_dedup.exact_duplicates(frame(spark, texts), keeper=keeper, content_hash=content_hash, budget=4000)
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert exact_dedup.exact_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    want = collections.Counter(keys)
    trie = exact_dedup.Trie(max, budget=3000)
    got = collections.Counter()
    for n, k in enumerate(keys):  # any order: what is spilled may come again
        trie.add(k, n)
        if trie.held > trie.budget:
            got.update({k: 0 for k, _, _ in ()})
            for key, _, rows in trie.spill():
                got[key] += rows
    for key, _, rows in trie.all():
        got[key] += rows
    assert got == want
    trie = exact_dedup.Trie(min, budget=3000)
    seen = []
    for k in sorted(keys):  # sorted: what is left of the path is final
        trie.add(k, 0)
        if trie.held > trie.budget:
            seen += [(key, rows) for key, _, rows in trie.spill(k)]
    seen += [(key, rows) for key, _, rows in trie.all()]
    assert len(seen) == len(want) and dict(seen) == want


def brute(texts, least=0.8):
    column = pa.array([t or "" for _, t in texts])
    df, n, bags = np.zeros(1 << near_dedup.CELL_BITS, np.int64), 0, []
    for lo, hi, row, values, count in near_dedup.counted(column):
        df += np.bincount(near_dedup.cells(values), minlength=len(df))
        n += len(np.unique(row))
        bags += [dict(zip(values[row == i].tolist(), count[row == i].tolist())) for i in range(hi - lo)]
    idf = near_dedup.inverse_frequencies(df, n)
    shift = near_dedup.HASH_BITS - near_dedup.CELL_BITS

    def similar(a, b):
        low = sum(min(a.get(k, 0), b.get(k, 0)) * float(idf[k >> shift]) for k in a.keys() | b.keys())
        high = sum(max(a.get(k, 0), b.get(k, 0)) * float(idf[k >> shift]) for k in a.keys() | b.keys())
        return high > 0 and low / high >= least

    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i][1] or "") == (texts[j][1] or "") or similar(bags[i], bags[j]):
                parent[find(i)] = find(j)
    return {frozenset(k for k in range(len(texts)) if find(k) == r) for r in {find(k) for k in range(len(texts))}}


def test_near(spark, texts):
    got = near_dedup.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    want = collections.Counter()
    for members in brute(texts):
        ids = [texts[k][0] for k in members]
        named = [i for i in ids if i is not None]
        for i in ids:
            want[i, min(named) if named else None, len(ids)] += 1
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert near_dedup.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_samples_collide_as_often_as_weights_are_similar():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << near_dedup.HASH_BITS, 300, dtype=np.uint64)
    w = rng.uniform(1, 4, 300).astype(np.float32)
    other = np.where(rng.random(300) < 0.7, w, w * rng.uniform(0.2, 3, 300)).astype(np.float32)
    sampler = near_dedup.Sampler(3000)
    got = sampler(np.concatenate([values, values]), np.concatenate([w, other]), np.array([0, 300]))
    want = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([101])), (bytes([103]), bytes([103]))]
    got = {bytes(r.node): bytes(r.comp) for r in base.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\0" for i in range(41)} | {bytes([100]): bytes([100]), bytes([101]): bytes([100])}


def test_words_and_shingles():
    codes, distinct, offsets = words.split(pa.array(["Ab, c-d", None, "", "..", "é1 É1\nx"]))
    assert [distinct[int(c)].as_py() for c in codes] == ["ab", "c", "d", "é1", "é1", "x"]
    assert offsets.tolist() == [0, 3, 3, 3, 3, 6]
    values, ends = words.shingles(*words.word_hashes(pa.array(["a b c d e f", "a b", "", "b c d e f"])))
    assert np.diff(ends).tolist() == [2, 1, 0, 1] and values[1] == values[3] and len(set(values.tolist())) == 3


def test_document_frequencies_are_those_of_shingles(spark):
    rng = random.Random(8)
    passage = sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 20)} {passage if i % 2 else sentence(rng, 60)}") for i in range(60)]
    docs = base.documents(frame(spark, rows + rows[:2]).repartition(3))
    want = collections.Counter()
    for _, _, _, values, _ in near_dedup.counted(pa.array([t for _, t in rows + rows[:2]])):
        want.update(values.tolist())
    cut = base.keep(near_dedup.shingled(docs), "shingles")
    found = near_dedup.frequencies(cut, sum(want.values()))
    got = {}
    for r in found.collect():
        for v, df in zip(near_dedup._unpack(pa.scalar(bytes(r.shingles))).tolist(), near_dedup._numbers(pa.scalar(bytes(r.df))).tolist()):
            assert got.setdefault(v, df) == df
    assert got == {v: df for v, df in want.items() if df > 1} and max(got.values()) == 31
    signed = near_dedup.signatures(cut, base.keep(found, "frequencies"), len(rows) + 2, near_dedup.Settings()).join(cut.select("doc_id", "shingles"), "doc_id")
    for r in signed.collect():
        values = near_dedup._unpack(pa.scalar(bytes(r.shingles))).tolist()
        assert near_dedup._numbers(pa.scalar(bytes(r.df))).tolist() == [want[v] for v in values]
    assert near_dedup.weighted_jaccard(*[np.array(x) for x in ([1, 2], [1.0, 2.0], [2, 3], [2.0, 1.0])]) == 0.5


def test_weights_beyond_32_bits():
    many = 5_000_000_000
    got = near_dedup.inverse_frequencies(np.array([1, 2**31 + 5, 2**32 - 1], np.uint32), many)
    want = [1 + math.log((1 + many) / (1 + d)) / math.log(2 + many) for d in (1, 2**31 + 5, 2**32 - 1)]
    assert np.allclose(got, want, rtol=1e-6)


def test_packed_shingles():
    rng = np.random.default_rng(2)

    def packed(values):
        out = near_dedup._pack(values)
        assert near_dedup._unpack(pa.scalar(out, pa.binary())).tolist() == values.tolist()
        return out

    assert packed(np.zeros(0, np.uint64)) == b""
    packed(np.array([0, 1 << near_dedup.HASH_BITS], np.uint64))
    packed(np.array([2**64 - 1], np.uint64))
    packed(np.concatenate([[0], (1 << 43) + np.arange(500)]).astype(np.uint64))
    for n, low, high in ((1, 0, 9), (9, 0, 9), (200, 0, 256), (3, 5, 2**64 - 1), (4000, 7 << 37, 8 << 37)):
        for _ in range(20):
            packed(np.unique(rng.integers(low, high, n, dtype=np.uint64)))
    cells = [np.unique(rng.integers(0, 1 << near_dedup.HASH_BITS, 460, dtype=np.uint64)) for _ in range(50)]
    assert len(pa.compress(b"".join(map(packed, cells)), "lz4")) < 4.8 * sum(map(len, cells))  # 36.6 bits at best
    df = rng.integers(2, 200, 5000).astype(np.uint32)
    out = near_dedup._pack_numbers(df)
    assert near_dedup._numbers(pa.scalar(out, pa.binary())).tolist() == df.tolist()
    assert len(pa.compress(out, "lz4")) < 1.2 * len(df)


def test_kept_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "shuffle_" in f}

    setting = spark.conf.get(base.DROP_SHUFFLES, None)
    before = files()
    kept = base.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"), "test")
    for _ in range(50):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7
    assert spark.conf.get(base.DROP_SHUFFLES, None) == setting
