"""Periodic runs of words: Lyndon arrays by Baier grouping, Lyndon roots extended to runs.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``least``
words and two periods that no neighbouring word extends. Every run holds a Lyndon root, a stretch of
q words that is the longest Lyndon word starting there under an order of the words or under its
reverse. So the runs of a text come from its two Lyndon arrays:

* Phase one of Baier's suffix sorter puts the positions into groups by their first word and takes the
  groups from the greatest down. The text of a group's positions up to the nearest smaller one is
  their longest Lyndon word, so the group's length is their entry of the Lyndon array, and they leave.
  Each position left that precedes c of them in a row is one group up: its length grows by c times
  theirs, and it moves right behind its old group, ordered by c. Each position leaves once and moves
  at most once for each that leaves, so the work is linear.
* A root at i of length q is extended both ways while words q apart are equal: to the nearest
  places, on either side, where they differ. Those places are listed once for every period that
  passes a look at the first word; the comparison is exact.

Texts are cut into words by ``[^\\x20\\x09-\\x0D]+``. Every text is handled whole, in one row of one
task; nothing is shuffled. NULL text is the empty text, which has no words and no runs. Rows may
repeat and ids may be NULL; each row gives one row. Extra columns are ignored, an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, small_batches, table
from lacuna.llm.words import runs as row_runs

LEAST = 12


def lyndon_lengths(codes: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; codes are below ``kinds``.

    Positions count from 1 inside; 0 is the place before the text.
    """
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(codes, 1):
        members[c].append(i)
    group = [-1, *codes]
    length = [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # neighbours among the positions that are left
    out = [0] * (n + 1)
    top = kinds - 1
    while top >= 0:
        size = length[top]
        before: list[int] = []  # positions before members, in ascending order, each once
        times: list[int] = []  # how many members follow each
        last = 0
        for i in members[top]:
            if group[i] == top:
                out[i] = size
                j, k = left[i], right[i]
                right[j] = k
                left[k] = j
                if j:
                    if j == last:
                        times[-1] += 1
                    else:
                        before.append(j)
                        times.append(1)
                        last = j
        if before:
            if len(before) == 1:
                rounds = [(times[0], before)]
            else:
                most = max(times)
                if most == 1:
                    rounds = [(1, before)]
                else:
                    by_times: dict[int, list[int]] = {}
                    for j, c in zip(before, times):
                        by_times.setdefault(c, []).append(j)
                    rounds = sorted(by_times.items(), reverse=True)
            for c, some in rounds:
                moved: dict[int, int] = {}
                for j in some:
                    old = group[j]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(length)
                        length.append(length[old] + c * size)
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                        members.append([j])
                    else:
                        members[new].append(j)
                    group[j] = new
        members[top] = []
        top = below[top]
    return out[1:]


def runs_of(codes: list[int], kinds: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; codes are below ``kinds``."""
    n = len(codes)
    if n < max(least, 2):
        return []
    word = np.array(codes)
    top = kinds - 1
    sizes = np.array([lyndon_lengths(codes, kinds), lyndon_lengths([top - c for c in codes], kinds)])
    place = np.arange(n)
    roots = []
    for size in sizes:
        at = place[2 * size <= n]
        at = at[at + size[at] < n]
        at = at[word[at] == word[at + size[at]]]
        roots.append(np.stack([size[at], at]))
    found = set()
    periods, at = np.concatenate(roots, axis=1)
    order = np.argsort(periods, kind="stable")
    periods, at = periods[order], at[order]
    heads = np.flatnonzero(np.diff(periods, prepend=0))
    for lo, hi in zip(heads, np.append(heads[1:], len(periods))):
        q = int(periods[lo])
        differ = np.flatnonzero(word[:-q] != word[q:])
        bounds = np.concatenate([[-1], differ, [n - q]])
        nearest = np.searchsorted(differ, at[lo:hi])
        start, length = bounds[nearest] + 1, bounds[nearest + 1] + q - bounds[nearest] - 1
        for s, m in zip(start.tolist(), length.tolist()):
            if m >= least and m >= 2 * q:
                found.add((s, m, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(edges).tolist()) if not d]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period of each, by start, then period) and the
    text that is left, its words joined by single spaces."""
    if least < 2:
        raise ValueError("least must be 2 or more")
    small_batches(df.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lo, hi in row_runs(texts):
                counts, ends, flat, kept = [], [0], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    words = text.split()  # bytes split at exactly these six characters
                    known: dict[bytes, int] = {}
                    codes = [known.setdefault(w, len(known)) for w in words]
                    found = runs_of(codes, len(known), least)
                    counts.append(len(words))
                    flat += found
                    ends.append(len(flat))
                    kept.append(b" ".join(collapsed(words, found)))
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                stretches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), stretches, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return documents(df, id_col, text_col).mapInArrow(find, schema)


def longest(column: str = "runs") -> Column:
    """The run of greatest length; of equals that with the smallest start, then period."""
    ranked = F.expr(f"array_min(transform({column}, r -> struct(-r.length AS shorter, r.start AS start, r.period AS period)))")
    return F.struct(ranked.start.alias("start"), (-ranked.shorter).alias("length"), ranked.period.alias("period"))


def planted(df: DataFrame) -> DataFrame:
    """``documents`` with the contract's repeats: where the crc32 of the doc_id ends in 0, the words
    from a on repeat with a period p that both derive from it. A NULL id gives no repeats."""
    words = r"filter(split(text, '[ \\x09-\\x0D]+'), w -> w <> '')"
    marked = documents(df).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = marked.withColumn("words", F.expr(f"CASE WHEN h % 10 = 0 THEN {words} END"))
    some = chosen.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    some = some.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("transform(words, (w, i) -> IF(i >= a, element_at(words, cast(a + (i - a) % p + 1 AS int)), w))")
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, their digest and that of the collapsed text."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", F.when(F.size("runs") > 0, longest()))
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
