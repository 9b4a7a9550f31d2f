"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is that of their common subsequences of three characters, gaps allowed, every
character a subsequence spans costing a factor of ``DECAY``; it is normalised. Inserted, dropped or
separated letters and new endings change it little, so an insult is known by its letters in order.
Letters and digits of a blank-separated chunk are its word ("i-d.iot" is "idiot"), and so are three or
more chunks of one character in a row ("i d i o t"); words longer than ``SPAN`` characters are seen
through overlapping spans.

Training. Sentences are labelled as a whole, so what is learnt is which of their words give them away.
At most ``docs_per_class`` labelled documents of each class (the first by a hash of the id) train:
Spark counts in how many toxic and clean ones every word occurs, where documents with the same least
shingle hash, copies of each other as a rule, count once; words that toxic ones hold significantly more
often (likelihood ratio, limit raised with the number of words) are positives;
frequent, random and - after each fit - wrongly accepted words of clean documents are negatives.
Landmarks are taken from both. The machine is fitted on landmark kernels (squared hinge, Newton
steps); a logistic curve over a document's three highest word margins gives the score. Its factors are
``LEAST_FACTOR`` at least, so a word with a higher margin never lowers a score.

Scoring. The landmark expansion is linear in the subsequence weights, so it is folded into one weight
per subsequence and a word costs one pass over its subsequences; no document leaves its task.

Labels are joined by id; NULL labels and ids do not train; an id with several labels counts as toxic
if one says so. Without both classes, or where no word is held by toxic documents significantly more
often, every score is 0. Empty and NULL texts, and texts without words
of three characters, have the margins of a clean text. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lacuna.llm.base import documents, keep, small_batches, table
from lacuna.llm.words import runs, shingles

ORDER = 3
DECAY = 0.6
SPAN = 24
CODES = 48
FLOOR = -1.5
TOP = 3
LEAST_FACTOR = 0.25
SPACED = r"(^|[ \n])[\pL\pN] [\pL\pN] [\pL\pN]([ \n]|$)"
SPACED_RUN = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")


@dataclass(frozen=True)
class Settings:
    docs_per_class: int = 3000
    positives: int = 600
    negatives: int = 3000
    landmarks: int = 256
    rounds: int = 3
    held_out: int = 5  # ids whose crc32 is a multiple of this never train


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per subsequence
    bias: float
    curve: np.ndarray  # intercept, then one factor per top margin


# --- words ---------------------------------------------------------------------------------------


def chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every chunk, word of each code, offsets of the texts)."""
    texts = pc.fill_null(texts, "")
    apart = pc.match_substring_regex(texts, SPACED)
    if pc.any(apart).as_py():
        closed = [SPACED_RUN.sub(lambda m: m[0].replace(" ", ""), t) for t in texts.filter(apart).to_pylist()]
        texts = pc.replace_with_mask(texts, apart, pa.array(closed, texts.type))
    spaced = pc.replace_substring(pc.utf8_lower(texts), "\n", " ")
    lists = pc.split_pattern(spaced, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN]+", "")
    again = words.dictionary_encode()
    codes = again.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    return codes, again.dictionary, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all characters, lengths): a-z, one code for digits, the others by remainder."""
    point = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    code = 27 + point % (CODES - 27)
    code = np.where((point >= 97) & (point <= 122), point - 97, code)
    code = np.where((point >= 48) & (point <= 57), 26, code)
    return code, np.fromiter(map(len, words), np.int64, len(words))


def _by_length(words: list[str]):
    """(rows, character matrix) per length; long words come in several spans."""
    code, n = letters(words)
    start = np.cumsum(n) - n
    row = np.arange(len(n))
    long = np.flatnonzero(n > SPAN)
    if len(long):
        more = [(i, s) for i in long for s in range(SPAN // 2, n[i] - SPAN // 2, SPAN // 2)]
        extra = np.array(more, np.int64).reshape(-1, 2)
        row = np.concatenate([row, extra[:, 0]])
        start = np.concatenate([start, start[extra[:, 0]] + extra[:, 1]])
        n = np.concatenate([np.minimum(n, SPAN), np.minimum(n[extra[:, 0]] - extra[:, 1], SPAN)])
    for length in np.unique(n[n >= ORDER]):
        at = np.flatnonzero(n == length)
        for some in np.array_split(at, -(-len(at) // 8192)):
            yield row[some], code[start[some][:, None] + np.arange(length)]


def _self_kernel(x: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself, before normalisation."""
    n = x.shape[1]
    same = [[(x[:, i] == x[:, j]) * np.float32(DECAY**2) for j in range(n)] for i in range(n)]
    match = same
    for _ in range(ORDER - 1):
        zero = np.zeros(len(x), np.float32)
        sums = [[zero] * (n + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(n):
                sums[i + 1][j + 1] = match[i][j] + DECAY * (sums[i][j + 1] + sums[i + 1][j]) - DECAY**2 * sums[i][j]
        match = [[same[i][j] * sums[i][j] for j in range(n)] for i in range(n)]
    return np.sum([np.sum(r, axis=0) for r in match], axis=0)


def _subsequences(x: np.ndarray):
    """(index of the subsequence per row, its weight) for all positions i < j < k."""
    n = x.shape[1]
    pair = {(i, j): (x[:, i] * CODES + x[:, j]) * CODES for i in range(n) for j in range(i + 1, n - 1)}
    for (i, j), p in pair.items():
        for k in range(j + 1, n):
            yield p + x[:, k], np.float32(DECAY ** (k - i + 1))


def apply_weights(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Normalised product of every word with each column of ``weights``; the greatest of its spans.
    NaN for words without subsequences."""
    out = np.full((len(words), weights.shape[1]), np.nan, np.float32)
    one = weights[:, 0] if weights.shape[1] == 1 else None
    for row, x in _by_length(words):
        total = np.zeros((len(x), weights.shape[1]), np.float32)
        for index, w in _subsequences(x):
            if one is not None:
                total[:, 0] += one[index] * w
            else:
                total += weights[index] * w
        total /= np.sqrt(_self_kernel(x))[:, None]
        np.fmax.at(out, row, total)
    return out


def embedded(words: list[str]) -> np.ndarray:
    """Normalised subsequence weights, a column per word (words of at most SPAN characters)."""
    out = np.zeros((CODES**ORDER, len(words)), np.float32)
    for row, x in _by_length(words):
        for index, w in _subsequences(x):
            np.add.at(out, (index, row), w)
    norm = np.linalg.norm(out, axis=0)
    return out / np.where(norm > 0, norm, 1)


# --- the machine ---------------------------------------------------------------------------------


def fit_machine(words: list[str], signs: np.ndarray, costs: np.ndarray, landmarks: list[str], ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """(weight per subsequence, bias) of the support vector machine on Nystroem features."""
    columns = embedded(landmarks)
    gram = apply_weights(landmarks, columns)
    value, vector = np.linalg.eigh(gram.astype(np.float64))
    good = value > 1e-4 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    z = np.nan_to_num(apply_weights(words, columns)).astype(np.float64) @ whiten
    z = np.column_stack([z, np.ones(len(z))])
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        inside = signs * (z @ beta) < 1
        zi = z[inside]
        hessian = (zi * costs[inside, None]).T @ zi + np.diag(penalty)
        new = np.linalg.solve(hessian, zi.T @ (costs[inside] * signs[inside]))
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = 0.5 * beta + 0.5 * new if _ > 10 else new
    return (columns @ (whiten @ beta[:-1]).astype(np.float32)), float(beta[-1])


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.nan_to_num(apply_weights(words, weights[:, None])[:, 0] + np.float32(bias), nan=FLOOR)


def fit_curve(x: np.ndarray, toxic: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Logistic curve over top margins, none of its factors below ``LEAST_FACTOR``."""
    z = np.column_stack([np.ones(len(x)), x])
    least = np.array([-np.inf] + [LEAST_FACTOR] * x.shape[1])
    beta = np.maximum(np.zeros(z.shape[1]), least)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (costs * (toxic - p)) - 1e-2 * beta
        hessian = (z * (costs * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
        free = (beta > least) | (gradient > 0)  # the others stay at their bound
        new = beta.copy()
        new[free] += np.clip(np.linalg.solve(hessian[np.ix_(free, free)], gradient[free]), -5, 5)
        new = np.maximum(new, least)
        done = np.abs(new - beta).max() < 1e-6
        beta = new
        if done:
            break
    return beta


# --- Spark ---------------------------------------------------------------------------------------


def _labelled(labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, toxic of the rows that may train."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % s.held_out != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _word_rows(texts: DataFrame) -> DataFrame:
    """word, toxic, copies: the distinct words of every row, its class, its least shingle hash."""

    def split(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            column = batch.column("text").cast(pa.string())
            for lo, hi in runs(column):
                codes, words, offsets = chunks(column.slice(lo, hi - lo))
                row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                size = max(1, len(words))
                pairs = np.unique(row * size + codes)
                row, code = pairs // size, pairs % size
                if not len(row):
                    continue
                hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
                values, ends = shingles(hashed[codes], offsets)  # every row has a chunk, hence a shingle
                copies = np.minimum.reduceat(values, ends[:-1]).view(np.int64)[row]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code)), pa.array(toxic[lo + row].astype(np.int32)), pa.array(copies)], names=["word", "toxic", "copies"])

    return texts.select("text", "toxic").mapInArrow(split, "word string, toxic int, copies long")


def top_margins(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``top``: the highest margins among the distinct words of the text, highest first."""

    def score(batches):
        m: Model = model.value
        for batch in batches:
            column = batch.column("text").cast(pa.string())
            top = np.full((batch.num_rows, TOP), FLOOR)
            for lo, hi in runs(column):
                codes, words, offsets = chunks(column.slice(lo, hi - lo))
                value = margins(words.to_pylist(), m.weights, m.bias)
                row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                at = np.flatnonzero(value[codes] > FLOOR / 2)
                pairs = np.unique(row[at] * len(words) + codes[at])
                row, v = pairs // max(1, len(words)), value[pairs % max(1, len(words))]
                order = np.lexsort((-v, row))
                row, v = row[order], v[order]
                first = np.searchsorted(row, row, "left")
                rank = np.arange(len(row)) - first
                some = rank < TOP
                top[lo + row[some], rank[some]] = np.clip(v[some], FLOOR, -FLOOR)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(list(top), pa.list_(pa.float64()))], names=[*names, "top"])

    schema = StructType([f for f in docs.schema if f.name != "text"]).add("top", ArrayType(DoubleType()))
    return docs.mapInArrow(score, schema)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model from the labelled rows of ``docs`` (doc_id, text); None without both classes."""
    spark = docs.sparkSession
    rows = keep(_labelled(labels, s), "labels")
    prior = rows.agg(F.avg("toxic")).first()[0]
    if prior is None or prior in (0, 1):
        return None
    some = [rows.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.docs_per_class) for t in (0, 1)]
    sample = some[0].unionAll(some[1])  # at most 2 * docs_per_class rows
    texts = keep(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "training-texts")
    found = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(found) < 2:
        return None
    held = keep(_word_rows(texts).distinct(), "words")
    groups = {r.toxic: r["count"] for r in held.select("toxic", "copies").distinct().groupBy("toxic").count().collect()}
    clean, toxic = groups.get(0, 0), groups.get(1, 0)
    if not clean or not toxic:
        return None
    counts = held.filter(F.char_length("word") >= ORDER).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = keep(counts, "word-counts")
    share = toxic / (toxic + clean)
    both = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - share)))).otherwise(0.0))
    limit = 5 + 2 * np.log(max(1, counts.count()))
    given = counts.filter("t > 0").withColumn("ratio", ratio).filter((F.col("t") / toxic > 5 * F.col("c") / clean) & (F.col("ratio") > limit))
    positive = [r.word for r in given.orderBy(F.desc("ratio"), "word").limit(s.positives).collect()]
    if not positive:
        return None
    half = s.negatives // 2
    usual = counts.filter("c > 0").join(given.select("word"), "word", "left_anti")
    negative = [r.word for r in usual.orderBy(F.desc("c"), "word").limit(half).collect()]
    negative += [r.word for r in usual.orderBy(F.xxhash64("word"), "word").limit(half).collect()]
    positive = [w[:SPAN] for w in positive]
    negative = sorted({w[:SPAN] for w in negative} - set(positive))
    rng = np.random.default_rng(7)
    for number in range(s.rounds):
        own = min(len(positive), s.landmarks // 2)
        landmarks = sorted(set(positive[:own]) | set(rng.choice(negative, min(len(negative), s.landmarks - own), replace=False).tolist()))
        words = positive + negative
        signs = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        costs = np.where(signs > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(words)
        weights, bias = fit_machine(words, signs, costs, landmarks)
        if number + 1 < s.rounds:
            taken = spark.sparkContext.broadcast(Model(weights, bias, np.zeros(0)))
            wrong = _margin_rows(usual, taken).filter("margin > -0.5").orderBy(F.desc("margin"), "word").limit(half).collect()
            new = {r.word[:SPAN] for r in wrong} - set(negative) - set(positive)
            if not new:
                break
            negative = sorted(set(negative) | new)
    model = Model(weights, bias, np.zeros(TOP + 1))
    tops = top_margins(texts.select("text", "toxic"), spark.sparkContext.broadcast(model)).collect()  # as many rows as the sample
    x, y = np.array([r.top for r in tops]), np.array([float(r.toxic) for r in tops])
    costs = np.where(y > 0, prior / found[1], (1 - prior) / found[0]) * len(y)
    return Model(weights, bias, fit_curve(x, y, costs))


def _margin_rows(words: DataFrame, model) -> DataFrame:
    def score(batches):
        m: Model = model.value
        for batch in batches:
            got = margins(batch.column("word").to_pylist(), m.weights, m.bias)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(got.astype(np.float64))], names=["word", "margin"])

    return words.select("word").mapInArrow(score, "word string, margin double")


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted (and the columns of ``carry``, in a
    struct)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = documents(df, id_col, text_col)
    model = train(docs, labels, settings)
    if carry is not None:
        docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.struct(*carry).alias("carried"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % settings.held_out == 0, F.lit(False)).alias("held_out")
    carried = ["carried"] if carry is not None else []
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *carried)
    found = top_margins(docs, spark.sparkContext.broadcast(model))
    sums = F.lit(float(model.curve[0]))
    for i in range(TOP):
        sums = sums + F.col("top")[i] * float(model.curve[i + 1])
    found = found.withColumn("score", 1 / (1 + F.exp(-sums)))
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carried)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
