"""Periodic runs, sum-of-squares packing and the filter audit against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import audit, online_packing, periodic
from lacuna.llm.tokens import vocabulary_path

SMALL_SF = "/root/testdata/sf0.001"
WORDS = st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(0, k - 1), max_size=40).map(lambda w: (w, k)))


# ---- periodic runs


def brute_lyndon(s):
    """Up to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(s, least):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q) not in found:
                stretch = s[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found[i, j + q] = q
            i = j + 1
    return sorted(((a, z - a, q) for (a, z), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    return [w for i, w in enumerate(words) if i not in dropped]


@settings(max_examples=500, deadline=None)
@given(WORDS)
def test_lyndon_lengths(case):
    s, k = case
    assert periodic.lyndon_lengths(s, k) == brute_lyndon(s)


@settings(max_examples=500, deadline=None)
@given(WORDS, st.integers(2, 12))
def test_runs(case, least):
    s, k = case
    assert periodic.runs_of(s, k, least) == brute_runs(s, least)


def test_long_runs():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for s in (fibonacci[-1], [0] * 3000, [0, 1, 2] * 1000, list(range(3000)), list(range(3000))[::-1]):
        k = max(s) + 1
        assert periodic.lyndon_lengths(s, k)[:50] == brute_lyndon(s)[:50]
    assert periodic.runs_of(fibonacci[10], 2) == brute_runs(fibonacci[10], 12)
    assert periodic.runs_of([0, 1, 2] * 1000 + [5], 6) == [(0, 3000, 3)]


def contract(doc_id, text):
    """The words of a document by the contract of operator 11."""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


TEXTS = [
    "", None, " \t ", "one", "a " * 30, "x y z " * 9 + "x y", "b c " * 6 + "d e " * 6, "p q r s t u v w p q r s t u v w p q r s",
    "A b A b\x0bA b\x1cA b", "ä ö\nä ö\rä ö\x0cä ö\tä ö ä ö ä ö", "w " * 11, "w " * 12, "plain text of ten words that do not repeat here",
]
ROWS = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "n " * 40, 2), (3, "a " * 30, 3), (3, "a " * 30, 3)]
ROWS += [(i, " ".join(f"w{(i * j * j) % 97}" for j in range(60)), 0) for i in range(100, 160)]  # some of these ids ask for repeats


def test_periodic_runs(spark, monkeypatch):
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in ROWS if i is not None) >= 4
    df = spark.createDataFrame(ROWS, "doc_id long, text string, runs int")
    monkeypatch.setattr(periodic, "table", lambda *_: df)
    got = periodic.op11_periodic_runs(spark, "").collect()
    want = []
    for i, t, _ in ROWS:
        words = contract(i, t)
        found = brute_runs(words, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest()
        rest = hashlib.sha256(" ".join(brute_collapsed(words, found)).encode()).hexdigest()
        want.append((i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest, rest))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    full = periodic.periodic_runs(df.withColumnRenamed("doc_id", "key"), "key", least=2).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs))) for r in full) == collections.Counter((i, len(w), tuple(brute_runs(w, 2))) for i, w in ((i, contract(None, t)) for i, t, _ in ROWS))
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, least=1)


# ---- sum-of-squares packing


def brute_level(count, size, capacity):
    """The fullest level of those that leave the least sum of squares."""
    best = None
    for h in range(capacity - size, -1, -1):
        if h and not count[h]:
            continue
        after = count.copy()
        if h:
            after[h] -= 1
        if h + size < capacity:
            after[h + size] += 1
        total = int((after[1:] ** 2).sum())
        if best is None or total < best[0]:
            best = (total, h)
    return best[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80), st.sampled_from([2, 5, 1000]))
def test_levels(sizes, max_open):
    levels, closed = online_packing.Levels(32, max_open), []
    for d, n in enumerate(sizes):
        assert levels.level_for(n) == brute_level(levels.count, n, 32)
        closed += levels.put(online_packing.Piece(d, 0, n, np.arange(n, dtype="<u4")))
        assert levels.open <= max_open and [len(w) for w in levels.windows] == levels.count.tolist()
    closed += levels.fill(ends=True)
    fills = [sum(len(p.ids) for p in w) for w in closed]
    assert levels.open == 0 and all(f == 32 or f < 32 and f & (f - 1) == 0 for f in fills) and sum(fills) == sum(sizes)
    pieces = collections.defaultdict(list)
    for w in closed:
        for p in w:
            pieces[p.doc].append((p.start, p.ids.tolist()))
    assert {d: sum((x for _, x in sorted(v)), []) for d, v in pieces.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}


def test_perfect_fit_is_found():
    levels = online_packing.Levels(16)
    closed = []
    for d, n in enumerate([10, 6] * 50):
        closed += levels.put(online_packing.Piece(d, 0, n, np.zeros(n, "<u4")))
    assert len(closed) >= 48 and all(len(w) == 2 for w in closed)


def test_pack_online(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = [(5, "The cat, sat."), (None, "no id"), (2, None), (3, ""), (2, "two"), (2, "two"), (9, "long words " * 4000), (7, " odd ́ \t it's 12 <|endoftext|>"), (8, "x " * 63)]
    rows += [(100 + i, "some words " * (i % 29)) for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int").repartition(3)
    for limit in (4096, 3):
        got = online_packing.pack_online(df, capacity=64, ids=True, max_open=limit).collect()
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
        windows, tokens = collections.defaultdict(list), collections.Counter()
        for r in got:
            windows[r.sequence_id].append(r)
            tokens[r.doc_id] += r.length
        for some in windows.values():
            some.sort(key=lambda r: r.offset)
            held = sum(r.length for r in some)
            assert [r.offset for r in some] == [sum(x.length for x in some[:k]) for k in range(len(some))]
            assert {r.sequence_tokens for r in some} == {held} and (held == 64 or held < 64 and held & (held - 1) == 0)
        want = {}
        for i, t in rows:
            want.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
        assert tokens == {i: sum(map(len, v)) for i, v in want.items()}
        for i, docs in want.items():
            if len(docs) == 1:
                parts = sorted((r.start, r.ids) for r in got if r.doc_id == i)
                assert sum((x for _, x in parts), []) == docs[0]
                assert [s for s, _ in parts] == [sum(len(x) for _, x in parts[:k]) for k in range(len(parts))]
        assert all(r.doc_tokens == len(want[r.doc_id][0]) for r in got if len(want[r.doc_id]) == 1)
    assert online_packing.pack_online(df.limit(0)).count() == 0


# ---- filter audit


def brute_audit(docs, labels):
    import itertools

    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        fails = {f for f, bad in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        ]) if bad}
        rows.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        some = [r[1:] for r in rows if r[0] == part]
        share, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = some
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in some if f in r[0]]
                share[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in some), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return collections.Counter(out)


def test_audit(spark):
    rng = random.Random(3)
    plain = " ".join(f"word{i}" for i in range(210))
    kinds = [plain, plain + " $", "few words", plain.upper(), "same " * 250, "", None, "same | " * 300, "É" * 30 + "A", "É" * 33 + "A"]
    docs = [(rng.randrange(40), rng.choice(kinds), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(None, plain, "en"), (None, plain, "en"), (7, plain, "en"), (7, plain, "en"), (-3, plain, "fr")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(4, 1, 0), (None, 1, 1), (7, None, 1), (7, 1, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, mask string").repartition(5)
    marks = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, good int")
    assert collections.Counter(map(tuple, audit.audit(df, marks, salts=2).collect())) == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert audit.audit(df, marks.limit(0)).filter("good_lost + toxic_lost > 0").isEmpty()


def test_wide_counters_do_not_overflow():
    many = (1 << 62) - 1
    total = many * audit.wide(0b00001, 1, 0) + many * audit.wide(0b10001, 0, 1) + audit.wide(0, 0, 0)
    counts = audit.unpack(audit.pack(total))
    kept, removed = counts[0], counts[1]
    assert (kept + np.array([removed[i // 5 * 5 : i + 1].sum() for i in range(600)]) == 2 * many + 1).all()
    assert kept[4::5].tolist() == [1] * 120
