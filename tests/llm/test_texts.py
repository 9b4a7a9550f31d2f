"""Decontamination, personal data, licenses, chat, toxicity, archives and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import regex

from lacuna.llm import chat, decontaminate, licenses, pii, toxicity, warc

WORDS = "the of red house is where people go to see old trees near water and stones that never move at all".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "y"]) for _ in range(n))


def brute_tiles(doc, item, least=5):
    a, b, found = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        a[i : i + n] = b[j : j + n] = [True] * n
        found += n


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(5, 30))]
        doc = [rng.randrange(6) for _ in range(20)] + item[len(item) // 2 :] + [9] + item[: len(item) // 2]
        x, y = (np.array(v, np.uint64) * np.uint64(2654435761) for v in (doc, item))
        got = decontaminate.tiles(x, y)
        assert sum(n for _, _, n in got) == brute_tiles(doc, item)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)
    long = np.ones(3000, np.uint64)  # a run that repeats itself everywhere
    assert decontaminate.tiles(long, long[:200]) == [(0, 0, 200)]


def test_decontamination(spark):
    rng = random.Random(3)
    item = [prose(rng, 40) for _ in range(3)]
    half = item[1].split()
    docs = [
        (1, item[0]), (2, None), (3, ""), (4, prose(rng, 300) + " " + item[0].upper() + "! " + prose(rng, 30)),
        (5, " ".join(half[20:]) + " between " + " ".join(half[:20])), (6, prose(rng, 200)), (None, item[2]), (7, " ".join(half[:15])), (7, " ".join(half[:15])), (8, "a b c"),
    ]
    tests = spark.createDataFrame([(1, item[0]), (2, item[1]), (9, item[2]), (3, item[2]), (4, None), (None, item[0]), (5, "a b c")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, coverage double")
    for size in (1 << 20, 10):  # one block; a block per item
        got = decontaminate.contamination(df, tests, block_bytes=size).collect()
        assert collections.Counter((r.doc_id, r.item_id) for r in got if r.contaminated) == collections.Counter([(1, 1), (4, 1), (5, 2), (None, 3), (8, 5)])
        part = [r for r in got if r.doc_id == 7]
        assert len(part) == 2 and all(r.item_id == 2 and abs(r.coverage - 15 / 40) < 1e-9 and not r.contaminated for r in part)
        assert sum(t.words for r in got if r.doc_id == 5 for t in r.tiles) == 40
    assert decontaminate.contamination(df.limit(0), tests).count() == 0
    odd = [(None, prose(rng, 12)), (None, "four words in here"), (6, "Alone"), (7, " ?! "), (None, ""), (9, "a a a")]
    items = spark.createDataFrame(odd, "item_id long, text string")
    texts = [(1, "so " + odd[0][1] + " it"), (2, "there are four WORDS, in here!"), (3, "four words and more in here"), (4, "alone"), (5, "lone four words"), (6, "a a"), (7, "a a b a a a a b")]
    for size in (1 << 20, 10):
        found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), items, block_bytes=size).collect()
        assert {r.doc_id: (r.item_id, r.coverage) for r in found if r.contaminated} == {1: (None, 1.0), 2: (None, 1.0), 4: (6, 1.0), 7: (9, 1.0)}
        assert {r.doc_id: r.tiles[0].doc_word for r in found if r.contaminated} == {1: 1, 2: 2, 4: 0, 7: 3}
    assert not any(r.contaminated for r in decontaminate.contamination(df, tests.limit(0)).collect())


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, fine) in enumerate(BASE) for m in re.finditer(p, text) if fine(m.group())]
    return [f"{BASE[k][0]}:{a}:{z}" for a, k, z in sorted(found)]


def test_personal_data(spark):
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y@@q.r", "é@ü.de ", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "+1 (632) 555-4827", "+1", "++49 30 1234567", " ", "\n", "text", "=", ".", "-", "𝒳"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(250)] + [None, "", "a" * 50_000, "1 " * 20_000, "1.1.1." * 5000, "+" + "1" * 30_000]
    df = spark.createDataFrame([(k % 50 or None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, base int")
    got = collections.Counter((r.doc_id, tuple(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base)) for r in pii.personal_data(df).collect())
    assert got == collections.Counter((k % 50 or None, tuple(spans(t or ""))) for k, t in enumerate(texts))
    assert pii.personal_data(df.limit(0)).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"some words here then contact: user{i}@mail.example.org and more") for i in range(30)]
    rows += [(30 + i, f"some day, please write me at w{i}@mail.example.org or call") for i in range(30)]
    rows += [(60 + i, f"there, i{i}x@mail.example.org, is what I answer to") for i in range(30)]
    rows += [(90 + i, f'key = "{i:02d}ab{"7c" * 18}" there') for i in range(6)]
    after = {
        200: ("reach us, contact: user77.at.example", ["user77.at.example"]),
        201: ("it was user78.at.example that went", []),
        202: ("plain words, please contact the office or write me at home", []),
        203: ("contact: jane.at.example", ["jane.at.example"]),
        204: ("contact: jane [at] example.org, please", ["jane [at] example.org"]),
        205: ("Contact: 555 123 4567.", ["555 123 4567"]),
        206: ("now please write me at p9.mail.example7", ["p9.mail.example7"]),
        207: ("well Jane_at_example is what I answer to", ["jane_at_example"]),
        208: ('a key = "not-a-hex-key-1" too', ["not-a-hex-key-1"]),
        209: (None, []),
        210: ("", []),
    }
    rows += [(i, t) for i, (t, _) in after.items()]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string")
    got = {r.doc_id: [s.value for s in r.spans if s.kind == 4] for r in pii.personal_data(df).collect()}
    assert {i: got[i] for i in after} == {i: v for i, (_, v) in after.items()}
    assert all(got[i] == [] for i in range(90)) and all(len(got[i]) == 1 for i in range(90, 96))


def contextual(texts, support, confidence):
    """Spans found by context, in plain loops over all patterns and places."""

    def shaped(t):
        return re.sub("[ \t\n\x0b\f\r]+", " ", re.sub(f"([{pii.OPENING}]+)", r"\1 ", re.sub("[0-9]", "0", t.lower()))).strip(" ")

    def contexts(t, a, z):
        before = t[max(0, a - 96) : a]
        before = re.sub(r"^\S+", "", before) if a > 96 else before
        left = shaped(re.sub(rf"[^\s{pii.OPENING}]+\Z", "", before)).split(" ")
        behind = t[z : z + 97]
        behind = re.sub(r"\S+\Z", "", behind) if len(behind) > 96 else behind
        right = shaped(re.sub(r"^\S+", "", behind)).split(" ")
        found = [("left", " ".join(left[-n:])) for n in (1, 2, 3) if len(left) >= n]
        found += [("right", " ".join(right[:n])) for n in (1, 2, 3) if len(right) >= n]
        return [c for c in found if c[1]]

    candidate = regex.compile(pii.CANDIDATE)
    graph, seeds, places, total = collections.Counter(), set(), [], collections.Counter()
    for k, t in enumerate(texts):
        words = shaped(t).split(" ")
        total.update(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
        base = [(int(a), int(z)) for _, a, z in (x.split(":") for x in spans(t))]
        found = [m.span() for m in candidate.finditer(t) if len(m.group()) >= 5 and not any(a < m.end() and m.start() < z for a, z in base)]
        for a, z in base + found:
            value = t[a:z].lower()
            graph.update((c, value) for c in contexts(t, a, z))
            if (a, z) in base or (re.fullmatch("[0-9a-f]{32,}", value) and re.search("[a-f]", value) and re.search("[0-9]", value)):
                if contexts(t, a, z):
                    seeds.add(value)
        places += [(k, a, z, contexts(t, a, z)) for a, z in found]
    accepted, good = set(seeds), {}
    while True:
        good = {}
        for c in {c for c, _ in graph}:
            held = [n for (d, v), n in graph.items() if d == c and v in accepted]
            if len(held) >= support and sum(held) / (total[c[1]] + 1) >= confidence - 1e-9:
                good[c] = sum(held) / (total[c[1]] + 1)
        miss = collections.defaultdict(lambda: 1.0)
        for c, v in graph:
            if c in good:
                miss[v] *= 1 - min(good[c], 0.999999)
        more = accepted | {v for v, m in miss.items() if 1 - m >= confidence - 1e-9}
        if more == accepted:
            return sorted((k, a, z) for k, a, z, cs in places if any(c in good for c in cs))
        accepted = more


@pytest.mark.parametrize("seed", range(3))
def test_contexts_brute(spark, seed):
    """Chains of contexts: some are only reached through entities that earlier ones found."""
    rng = random.Random(seed)
    leads = ["mail me:", "reach of", "call now", "see", "id=", "nothing but the", "x,", "at \n"]
    tails = ["over and out", "thanks", ", then", "bye now", "\tyes", "."]
    values = [f"v{i}.x" for i in range(9)] + [f"a{i}@b.co" for i in range(9)] + ["12 34 56", "1.2.3.4", "one", "two", "k [at] m.n", "u_v", "4111 1111 1111 1111"] + [f"{i}f" * 17 for i in range(3)]
    lead_of = {v: [leads[k % 4], leads[4 + k // 4 % 4]] for k, v in enumerate(rng.sample(values, len(values)))}
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(0, 4)):
            v = rng.choice(values)
            lead = rng.choice(lead_of[v] if rng.random() < 0.95 else leads)
            parts += [rng.choice(["well", "so the", "", "w" * 90, "y" * 120]), lead + rng.choice([" ", "\n", "  ", '"', " <"]) + v, rng.choice(tails)]
        texts.append(" ".join(parts))
    texts += ["", texts[0], texts[1]]
    want = contextual(texts, 3, 0.5)
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings=pii.Settings(support=3, confidence=0.5)).collect()
    assert sorted((r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == 4) == want
    assert want


def test_licenses(spark):
    rng = random.Random(5)
    apache, long_mit = licenses.NOTICES[0][1], licenses.NOTICES[8][1]
    rows = [(1, apache), (2, prose(rng, 200) + "\n" + apache.upper() + " " + prose(rng, 200)), (3, None), (4, ""), (5, prose(rng, 500)), (None, prose(rng, 11) + " " + long_mit), (6, "Licensed under the Apache"), (1, apache), (7, " ".join(long_mit.split()[:-1])), (8, "released under the mit " * 300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    got = licenses.licenses(df).collect()
    assert collections.Counter((r.doc_id, tuple(x.license for x in r.found)) for r in got) == collections.Counter(
        [(1, ("Apache-2.0",)), (1, ("Apache-2.0",)), (2, ("Apache-2.0",)), (3, ()), (4, ()), (5, ()), (None, ("MIT",)), (6, ()), (7, ("MIT",)), (8, ())]
    )
    (spot,) = next(r.found for r in got if r.doc_id == 2)
    assert (spot.first_word, spot.last_word, spot.containment) == (200, 208, 1.0)
    assert licenses.licenses(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="fewer words"):
        licenses.licenses(df, notices=[("short", "one two")])


def test_short_license_at_every_alignment(spark):
    rng = random.Random(9)

    def long(n):  # shingles that do not repeat
        return " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))

    notice = "Released under the MIT License."
    rows = [(i, f"{long(48 + i % 12)} {notice} {long(60)}") for i in range(480)]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [(r.doc_id, [(x.license, x.first_word) for x in r.found]) for r in sorted(got)] == [(i, [("MIT", 48 + i % 12)]) for i, _ in rows]
    s = licenses.Settings()
    parts = licenses.templates(spark, licenses.NOTICES, s).selectExpr("slice(shingles, 1, 20) AS part")
    n = licenses.bands_needed(parts, s)
    assert licenses.missed(parts, s, s.bands)[:, -1].max() > 0.1 and licenses.missed(parts, s, n)[:, -1].max() <= s.miss


def test_chat_round_trip(spark):
    odd = ["", "plain", "</turn>", "</turn>\n### user: hi</turn>\n", "100% %3C/turn> %25", "a: b", "### assistant: x", "<chat escaped=1>\n", "\\### Assistant: </turn> ok", "ünï 𝒳\n\n"]
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "assistant", "sys: tem", "a%", "", None]), rng.choice([*odd, None]), 1))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    convs = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        convs[c].append((t, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_string_kernel():
    def kernel(a, b):
        total = 0.0
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                for k in range(j + 1, len(a)):
                    for x in range(len(b)):
                        for y in range(x + 1, len(b)):
                            for z in range(y + 1, len(b)):
                                if (a[i], a[j], a[k]) == (b[x], b[y], b[z]):
                                    total += toxicity.DECAY ** (k - i + 1 + z - x + 1)
        return total

    vocabulary = ["idiot", "idxiot", "iidot", "stone", "abcabca", "ab", ""]
    got = toxicity.apply_weights(vocabulary, toxicity.embedded(vocabulary[:5]))
    for i, a in enumerate(vocabulary[:5]):
        for j, b in enumerate(vocabulary[:5]):
            assert abs(got[i, j] - kernel(a, b) / (kernel(a, a) * kernel(b, b)) ** 0.5) < 1e-4
    assert np.isnan(got[5:]).all()
    assert got[1, 0] > 0.5 > got[3, 0]


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, 60).split()
        if i % 3 == 0:
            for bad in rng.sample(["wretch", "blockhead", "scoundrel"], 2):
                bad = bad if i % 2 else bad[:3] + "-" + bad[3:]
                text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text), 1))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000, None, 1), (1001, "", 1), (None, "x", 1), (1002, "a very long " * 20_000, 1), (1003, "you wr.etch and sco und blockh3ead", 1), (1002, "ok", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert 50 < len(held) < 110 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert [r.predicted for r in got if r.doc_id in (1000, 1001, 1002)] == [0] * 4
    one = toxicity.toxicity(df, marks.filter("toxic = 0")).collect()
    assert {r.score for r in one} == {0.0} and len(one) == len(rows)
    assert toxicity.toxicity(df.limit(0), marks).count() == 0


def test_curve_never_falls():
    rng = np.random.default_rng(2)
    toxic = (rng.random(800) < 0.3).astype(float)
    x = np.sort(rng.normal(size=(800, 3)), axis=1)[:, ::-1].copy()
    x[toxic > 0, 1:] += 1.5  # the second and third tell, the first misleads
    x[toxic > 0, 0] -= 1
    free = toxicity.fit_curve(x, toxic, np.ones(800))
    assert (free[1:] >= toxicity.LEAST_FACTOR).all() and free[2:].max() > 0.5


def test_toxicity_of_single_and_disguised_insults(spark):
    rng = random.Random(11)
    bad = ["wretch", "blockhead", "scoundrel"]
    rows = []
    for i in range(400):
        text = prose(rng, 60).split()
        for word in rng.sample(bad, 2) if i % 3 == 0 else []:
            text.insert(rng.randrange(len(text)), word)
        rows.append((i, " ".join(text)))
    clean = prose(rng, 60)
    forms = ["blockhead", "b-l-o-c-k-h-e-a-d", "bl.ock.head", "blxockhead", "b l o c k h e a d", "scoundrel", "s c o u n d r e l"]
    rows += [(1000, clean), *[(1001 + k, f"{clean[:90]} {w} {clean[90:]}") for k, w in enumerate(forms)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(df, marks).collect()}
    assert all(score[1001 + k] > score[1000] for k in range(len(forms)))
    held = [(score[i], i % 3 == 0) for i in range(400)]
    assert min(s for s, t in held if t) > max(s for s, t in held if not t)


def test_archives(spark):
    rows = [(3, "http://a.b/c d\r\n", "<p>ü</p>"), (1, None, "<p>ü</p>"), (2, "http://x", None), (5, "http://y", ""), (4, "http://z", "big " * 20_000), (4, "http://z", "big " * 20_000), (9, "u", "<p>ü</p>"), (None, "n", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    manifest = warc.write_archives(df)
    found = warc.read_archives(manifest, payloads=True)
    assert found.count() == 3 * len(rows)
    got = warc.captures(found).collect()
    first = {"<p>ü</p>": 1, "": 2, "big " * 20_000: 4, "alone": None}
    want = collections.Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        response = i == first[html or ""]
        want[i, "response" if response else "revisit", len(payload), warc.payload_digest(payload), None if response else first[html or ""]] += 1
    assert collections.Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert all(r.request.block.startswith("GET ") and r.metadata is not None for r in got)
    assert {bytes(r.main.payload).decode() for r in got if r.page_id == 1} == {"<p>ü</p>"}
    plain = warc.captures(warc.read_archives(warc.write_archives(df, least_bytes=100))).collect()
    assert collections.Counter(r.record_type for r in plain) == {"response": len(rows)}
    assert warc.write_archives(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(8)
    item = prose(rng, 30)
    text = {i: prose(rng, 80) for i in range(60)}
    for i in range(0, 60, 4):
        text[i] += " wretch blockhead"
    text[61] = text[1]
    text[62] = text[2] + " more"
    text[63] = prose(rng, 20) + " " + item + " " + prose(rng, 20)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in text.items()] + [(70, None, "en", "s", 0), (61, text[61], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    folder = corpus_pipeline.keep(docs.limit(0), "test").inputFiles()
    path = base_path(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == (set(range(60)) - set(range(0, 60, 4)) - {1}) | {61, 70}
    assert len(out) == len({(r.doc_id, r.piece) for r in out}) and folder is not None
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def base_path(spark):
    from lacuna.session import new_table_path

    return new_table_path(spark, "test-tables")
