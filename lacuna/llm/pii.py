"""Personal data by bootstrapped contextual extraction, in column expressions only.

Base entities (e-mail, IP address, card, phone) are found by their patterns and checks; with strings of
the shape of a key (``seed_shape``) they are the seeds. The one, two or three words left of a place, and
those right of it, are its lexical patterns; its candidates are runs of tokens that look like an
identifier: a token with a digit or an inner sign, numbers in a row, or tokens joined by a short word in
brackets ("jane [at] example.org"). Spark holds the graph of patterns and candidates, with counts, and
scores it until a round adds nothing: the confidence of a pattern is the share of all its occurrences in
the corpus that stand next to an accepted entity, and it needs ``support`` different ones; a candidate
is accepted when the patterns that extract it make 1 - (1 - c1)(1 - c2)... at least ``confidence``, and
accepted candidates count for further patterns. A candidate next to an accepted pattern is a span of
kind "context"; such spans never overlap base spans. Accepted sets only grow, so the rounds end.

Words that seldom stand next to an entity are no pattern, however many entities they meet, so ordinary
words induce nothing. Context words are in lower case, digits as 0; signs between them and the entity
are passed over, but opening ones (quotes, brackets, colons, equals signs) belong to the word before. A
context reaches ``CONTEXT_CHARS`` characters; words cut there do not count for it.

The base patterns are written with possessive quantifiers and start only where a leftmost match can
start: the matches are the same, but time is linear in the length of the text and no stack is used.
NULL texts are empty. Rows and ids may repeat or be NULL; extra columns are ignored; no rows, no rows.
Equal values are one instance; patterns of equal confidence are all accepted or none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, keep, table
from lacuna.session import BROADCAST_ROWS

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD, SIGN = r"[\pL\pN]", r"[._@+/:%-]"
TOKEN = rf"{WORD}++(?:{SIGN}++{WORD}++)*+"
NUMBER = r"[0-9]++(?:[.()-]++[0-9]++)*+"
#: Tokens joined by a short word in brackets; numbers in a row; a token with a digit or an inner sign.
CANDIDATE = (
    rf"(?<![\pL\pN_.@+/%-])(?:{TOKEN}(?:\x20?[\[(]\pL{{2,3}}[\])]\x20?{TOKEN})++"
    rf"|{NUMBER}(?:\)?[\x20-]\(?{NUMBER})++(?!{WORD})"
    rf"|\pL*+(?:[0-9]{WORD}*+|{SIGN}++{WORD}++)(?:{SIGN}++{WORD}++)*+)"
)
LEAST_CHARS = 5
OPENING = r"=:\x22'(\[{"
CONTEXT_CHARS = 96
CONTEXT_WORDS = 3
TIE = 1e-9
SPAN = "struct<start: int, end: int, kind: int, value: string>"


@dataclass(frozen=True)
class Settings:
    support: int = 5
    confidence: float = 0.7
    seed_shape: str = "^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,}$"


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _luhn(match: Column) -> Column:
    plain = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(plain)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(plain, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(10, 15),
}


def _spans(text: Column, matches: Column, pattern: str, kind: int, fine) -> Column:
    """Spans of the matches that pass: what lies between them, from a split, gives their places."""
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        at = state.at + F.length(x["gap"])
        end = at + F.length(x["match"])
        own = F.array(F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("value")))
        return F.struct(end.alias("at"), F.when(fine(x["match"]), F.concat(state.spans, own)).otherwise(state.spans).alias("spans"))

    found = F.aggregate(steps, start, step, lambda s: s.spans)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _shaped(text: Column) -> Column:
    """Words between single blanks: lower case, digits as 0, a blank after opening signs."""
    plain = F.regexp_replace(F.lower(text), "[0-9]", "0")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"([{OPENING}]+)", "$1 "), r"\s+", " "))


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The words before and after a place, nearest one, two and three, as (side, words)."""
    size = F.least(start, F.lit(CONTEXT_CHARS))
    before = F.substr(text, start - size + 1, size)
    before = F.when(start > CONTEXT_CHARS, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    left = F.split(_shaped(F.regexp_replace(before, rf"[^\s{OPENING}]+\z", "")), " ")
    after = F.substr(text, end + 1, F.lit(CONTEXT_CHARS + 1))
    after = F.when(F.length(after) > CONTEXT_CHARS, F.regexp_replace(after, r"\S+\z", "")).otherwise(after)
    right = F.split(_shaped(F.regexp_replace(after, r"^\S+", "")), " ")

    def near(side: str, words: Column, n: int) -> Column:
        some = F.slice(words, -n if side == "left" else 1, n)
        return F.struct(F.lit(side).alias("side"), F.when(F.size(words) >= n, F.array_join(some, " ")).alias("words"))

    every = F.array(*[near(side, words, n) for side, words in (("left", left), ("right", right)) for n in range(1, CONTEXT_WORDS + 1)])
    return F.filter(every, lambda c: c.words != "")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and found (candidates), each with its contexts."""
    rows = docs
    for kind in KINDS:
        has = F.lit(True) if NEEDS[kind] is None else F.contains("text", F.lit(NEEDS[kind]))
        rows = rows.withColumn(f"m_{kind}", F.when(has, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("m_found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    text = F.col("text")
    parts = [_spans(text, F.col(f"m_{k}"), PATTERNS[k], i, CHECKS[k]) for i, k in enumerate(KINDS)]
    order = F.array_sort(F.concat(*parts), lambda a, b: F.when((a.start < b.start) | ((a.start == b.start) & (a.kind < b.kind)), -1).when((a.start == b.start) & (a.kind == b.kind), 0).otherwise(1))
    rows = rows.select("doc_id", "text", order.alias("base"), _spans(text, F.col("m_found"), CANDIDATE, len(KINDS), lambda m: F.length(m) >= LEAST_CHARS).alias("found"))
    rows = rows.withColumn("found", F.filter("found", lambda f: ~F.exists("base", lambda b: (b.start < f.end) & (f.start < b.end))))

    def placed(spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), F.lower(s.value).alias("value"), _contexts(text, s.start, s.end).alias("contexts")))

    return rows.select("doc_id", placed("base").alias("base"), placed("found").alias("found"))


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(words, total): how often each of the ``wanted`` runs of words occurs in all texts."""
    words = docs.select(F.split(_shaped(F.col("text")), " ").alias("w"))
    zipped = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(CONTEXT_WORDS)])
    placed = words.select(F.inline(zipped))
    # concat is NULL where a run would reach beyond the text
    grams = [F.concat(*[x for i in range(n) for x in ([F.lit(" ")] if i else []) + [F.col(f"w{i}")]]) for n in range(1, CONTEXT_WORDS + 1)]
    runs = placed.select(F.explode(F.array(*grams)).alias("words"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # of CONTEXT_CHARS characters each
        return runs.join(F.broadcast(wanted), "words").groupBy("words").agg(F.count("*").alias("total"))
    return runs.groupBy("words").agg(F.count("*").alias("total")).join(wanted, "words")


def patterns(rows: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The accepted patterns (side, words, confidence) once a round adds nothing."""
    seeds = rows.select(F.explode("base").alias("s")).select("s.contexts", "s.value", F.lit(True).alias("seed"))
    others = rows.select(F.explode("found").alias("s")).select("s.contexts", "s.value", F.col("s.value").rlike(s.seed_shape).alias("seed"))
    edges = seeds.unionAll(others).select(F.inline("contexts"), "value", "seed")
    edges = keep(edges.groupBy("side", "words", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")
    # only contexts that can reach the support and the confidence with all their candidates are counted on
    most = edges.groupBy("side", "words").agg(F.sum("n").alias("most"), F.count("*").alias("values")).filter(F.col("values") >= s.support)
    most = keep(most, "pii-contexts")
    totals = keep(occurrences(docs, most.select("words").distinct()), "pii-totals")
    possible = most.join(totals, "words").filter(F.col("most") >= (s.confidence - TIE) * (F.col("total") + 1)).select("side", "words", "total")
    edges = keep(edges.join(possible, ["side", "words"]), "pii-edges")
    accepted = edges.filter("seed").select("value").distinct()
    before = None
    while True:
        support = edges.join(accepted, "value", "left_semi").groupBy("side", "words", "total").agg(F.sum("n").alias("s"), F.count("*").alias("values"))
        scored = support.select("side", "words", (F.col("s") / (F.col("total") + 1)).alias("confidence"), "values")
        good = keep(scored.filter((F.col("values") >= s.support) & (F.col("confidence") >= s.confidence - TIE)).drop("values"), "pii-patterns")
        miss = F.sum(F.log(1 - F.least("confidence", F.lit(0.999999))))
        extracted = edges.select("side", "words", "value").join(good, ["side", "words"]).groupBy("value").agg(miss.alias("miss")).filter(1 - F.exp("miss") >= s.confidence - TIE)
        accepted = keep(accepted.unionAll(extracted.select("value")).distinct(), "pii-accepted")
        now = accepted.count()
        if now == before or good.isEmpty():
            return good
        before = now


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "context"]])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s.kind + 1), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: doc_id, base (spans found by patterns), spans (with those found by
    context): arrays of start, end, kind, value in code points, end exclusive, in order."""
    docs = documents(df, id_col, text_col)
    rows = keep(scanned(docs).withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    good = patterns(rows, docs, settings)
    places = rows.select("row", F.explode("found").alias("own")).select("row", F.struct("own.start", "own.end", "own.kind", "own.value").alias("own"), F.inline("own.contexts"))
    some = places.join(good, ["side", "words"], "left_semi").select("row", "own").distinct()
    more = some.groupBy("row").agg(F.collect_list("own").alias("more"))  # one text's spans
    base = F.transform("base", lambda s: s.dropFields("contexts"))
    all_spans = F.concat(base, F.coalesce("more", F.expr("array()").cast(f"array<{SPAN}>")))
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value"))))
    return rows.join(more, "row", "left").select("doc_id", base.alias("base"), ordered.alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS LONG) AS n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
