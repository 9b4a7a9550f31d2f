"""Stratified splits, limits and resampling without whole-group windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.hashing import K, M, mix32, salt, stream_key, with_uniform53
from lacuna.operators.ranking import MAX_GROUPS, TooManyGroups, at_or_before, grouped_rank, hash_cuts, join_totals
from lacuna.session import materialize

DRAWS_PER_TASK = 50_000_000
#: Rows of a block, whose draws are counted in one task, and draw numbers of a stretch, made in one go.
BLOCK_ROWS = 1 << 16
STRETCH = 1 << 18
# Replicates of different labels draw from salts this far apart.
LABEL_STRIDE = 1_000_000
# Spark keeps only the first n rows of a group before the shuffle up to this n.
GROUP_LIMIT = 1000


def balanced_limit(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n/2 rows of each label by ``order``."""
    half = n // 2
    if half <= GROUP_LIMIT:
        rank = F.row_number().over(W.partitionBy(label).orderBy(order))
        return df.withColumn("__rn", rank).filter(F.col("__rn") <= half).drop("__rn")
    return grouped_rank(df, [label], order, "__rn").filter(F.col("__rn") <= half).drop("__rn")


def _label_counts(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).count().limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError("stratify by a column with fewer values")
    return {r[0]: r[1] for r in rows}


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    test_size: float = 0.4,
    val_size: float = 0.5,
    seed: int = 0,
    external_test: bool = False,
    name: str = "split",
) -> DataFrame:
    """Add a split column with exact shares within each label.

    First ``test_size`` of the rows, then ``val_size`` of the remaining ones: 0.4 and 0.5 give
    30/30/40. With ``external_test`` only train and val are drawn: what would be test becomes val.

    Rows are ordered by a seeded hash of the id. The split points are found from hash histograms,
    so the split is a projection of literals: no sort, window or shuffle of the table. Beyond
    ``MAX_GROUPS`` labels rows are ranked within their label by ranges of the hash; the result is the
    same. Ids have to be unique and not NULL; a NULL label is a label of its own.
    """
    keyed = df.withColumn("__h", mix32(stream_key(F.col(id_col), seed)))

    def upto(n: int) -> list[tuple[str, int]]:
        """Parts of a group of n rows in hash order with the rank each of them ends at."""
        n_test = math.ceil(test_size * n)
        if external_test:
            return [("val", n_test)]
        return [("test", n_test), ("val", n_test + math.ceil(val_size * (n - n_test)))]

    try:
        sizes, cuts = hash_cuts(
            keyed, label, "__h", id_col, lambda s: {g: [r for _, r in upto(n) if r > 0] for g, n in s.items()}
        )
    except TooManyGroups:
        return _ranked_split(keyed, id_col, label, test_size, val_size, external_test, name).drop("__h")
    split = F.lit("train")
    for g, n in sizes.items():
        for part, rank in reversed(upto(n)):
            if rank > 0:
                inside = at_or_before(F.col("__h"), F.col(id_col), cuts[g, rank])
                split = F.when(F.col(label).eqNullSafe(F.lit(g)) & inside, part).otherwise(split)
    return keyed.withColumn(name, split).drop("__h")


def _ranked_split(
    keyed: DataFrame, id_col: str, label: str, test_size: float, val_size: float, external_test: bool, name: str
) -> DataFrame:
    """The split of any number of labels: ranks in hash order against the size of the label."""
    sizes = keyed.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    ranked = join_totals(grouped_rank(keyed, [label], "__h", "__rank", tie=id_col), sizes, [label])
    n_test = F.ceil(F.lit(test_size) * F.col("__n"))
    n_val = F.lit(0) if external_test else F.ceil(F.lit(val_size) * (F.col("__n") - n_test))
    first = "val" if external_test else "test"
    part = F.when(F.col("__rank") <= n_test, first).when(F.col("__rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn(name, part).drop("__rank", "__n")


def semi_observed_split(
    df: DataFrame, features: list[str], id_col: str, label: str, test_size: float = 0.4, seed: int = 0
) -> DataFrame:
    """Complete rows become train and val; rows with missing features are the test set."""
    from lacuna.operators.clean import fully_observed, semi_observed

    drawn = stratified_split(
        fully_observed(df, features), id_col, label, test_size, seed=seed, external_test=True
    )
    return drawn.unionByName(semi_observed(df, features).withColumn("split", F.lit("test")))


def holdout_folds(df: DataFrame, split: str = "split") -> DataFrame:
    """Train and val rows with their fold: -1 is always trained on, 0 is held out."""
    kept = df.filter(F.col(split).isin("train", "val"))
    return kept.withColumn("fold", F.when(F.col(split) == "train", -1).otherwise(0))


def replicate_salts(replicates: int, seed: int) -> Column:
    """One struct (replicate, salt) per replicate, to be exploded."""
    pairs = [F.struct(F.lit(r), F.lit(salt(seed + r)).cast("bigint")) for r in range(replicates)]
    return F.array(*pairs).cast("array<struct<replicate:int,salt:bigint>>")


def bootstrap_draws(spark: SparkSession, n: int, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, row number 0..n-1, times drawn): n draws with replacement per replicate.

    Draws are generated where they are counted: each task makes its own stretch of draw numbers,
    and equal (replicate, row) pairs are counted before the shuffle.
    """
    tasks = max(spark.sparkContext.defaultParallelism, n * replicates // DRAWS_PER_TASK)
    draws = spark.range(0, n, 1, int(tasks)).select("id", F.inline(replicate_salts(replicates, seed)))
    draws = with_uniform53(draws, "id", F.col("salt"), "u")
    row_no = F.least(F.floor(F.col("u") * F.lit(float(n))), F.lit(n - 1)).cast("bigint")
    counted = draws.select("replicate", row_no.alias("row_no")).groupBy("replicate", "row_no")
    return counted.agg(F.count(F.lit(1)).alias("times"))


def bootstrap(df: DataFrame, id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """Exact bootstrap: rows with ``replicate`` and ``times``; rows not drawn do not appear.

    The row count fixes the draws, so the input is materialised once and read twice. Sums and counts
    over replicates need no copies of rows: see ``bootstrap_sums`` and ``bootstrap_groups``.
    """
    rows = materialize(df, "bootstrap-input")
    n = rows.count()
    numbered = grouped_rank(rows.withColumn("__all", F.lit(0)), ["__all"], id_col, "__rn")
    numbered = numbered.withColumn("row_no", F.col("__rn") - 1).drop("__all", "__rn")
    # the planner takes the draws for as small as the numbers they come from
    draws = bootstrap_draws(df.sparkSession, n, replicates, seed).hint("merge")
    return numbered.join(draws, "row_no").drop("row_no")


def stratified_bootstrap(
    df: DataFrame, id_col: str, label: str, replicates: int, seed: int = 0
) -> DataFrame:
    """As ``bootstrap``, drawing within each label as many rows as it has."""
    rows = materialize(df, "bootstrap-input")
    counts = _label_counts(rows, label)
    numbered = grouped_rank(rows, [label], id_col, "__rn").withColumn("row_no", F.col("__rn") - 1)
    draws = None
    for k, (g, n) in enumerate(sorted(counts.items(), key=lambda kv: repr(kv[0]))):
        part = bootstrap_draws(df.sparkSession, n, replicates, seed + k * LABEL_STRIDE)
        part = part.withColumn("__g", F.lit(g).cast(df.schema[label].dataType))
        draws = part if draws is None else draws.unionByName(part)
    cond = [numbered["row_no"] == draws["row_no"], numbered[label].eqNullSafe(draws["__g"])]
    return numbered.join(draws.hint("merge"), cond).drop("row_no", "__g", "__rn")


def _drawn_rows(numbers: np.ndarray, salt_: int, n: int) -> np.ndarray:
    """Row numbers in [0, n) of draw numbers that share their high 32 bits: ``with_uniform53`` in Numpy."""
    high = salt(salt_ ^ (int(numbers[0]) >> 32))
    a = _mix32_words((numbers & np.int64(M - 1)).astype(np.uint32) ^ np.uint32(high))
    b = _mix32_words(a ^ np.uint32(salt(53)))
    bits = (a >> np.uint32(5)) * 67108864.0 + (b >> np.uint32(6))
    return np.minimum((bits / 9007199254740992.0 * float(n)).astype(np.int64), n - 1)


def _mix32_words(m: np.ndarray) -> np.ndarray:
    """``mix32`` of 32-bit words, whose products wrap by themselves."""
    for _ in range(2):
        m = (m ^ (m >> np.uint32(16))) * np.uint32(K)
    return m ^ (m >> np.uint32(16))


def _draw_blocks(spark: SparkSession, sizes: list[int], replicates: int, seed: int) -> DataFrame:
    """(stratum, block, counts, places): the draws of one stretch of draw numbers that fall in a block.

    ``counts`` holds 32-bit numbers of draws per replicate, ``places`` the 16-bit places in the block,
    replicate after replicate: two bytes a draw are shuffled.
    """
    tasks = spark.sparkContext.defaultParallelism
    stretch = min(STRETCH, max(1 << 12, sum(sizes) // (2 * tasks)))
    ends = np.cumsum([-(-n // stretch) for n in sizes])
    tasks = max(tasks, sum(sizes) * replicates // DRAWS_PER_TASK)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for batch in batches for x in batch.column(0).to_pylist()):
            g = int(np.searchsorted(ends, number, side="right"))
            n, first = sizes[g], (number - (int(ends[g - 1]) if g else 0)) * stretch
            drawn = np.arange(first, min(first + stretch, n), dtype=np.int64)
            halves = [x for x in np.split(drawn, np.flatnonzero(np.diff(drawn >> 32)) + 1) if len(x)]
            blocks = -(-n // BLOCK_ROWS)
            bounds, places = [], []
            for r in range(replicates):
                s = salt(seed + g * LABEL_STRIDE + r)
                rows = np.sort(np.concatenate([_drawn_rows(x, s, n) for x in halves]))
                bounds.append(np.searchsorted(rows, np.arange(blocks + 1, dtype=np.int64) * BLOCK_ROWS))
                places.append((rows % BLOCK_ROWS).astype(np.uint16))
            counts = np.diff(np.array(bounds), axis=1).astype(np.int32)
            for lo in range(0, blocks, 64):
                some = [b for b in range(lo, min(lo + 64, blocks)) if counts[:, b].any()]
                packed = [np.concatenate([p[at[b] : at[b + 1]] for p, at in zip(places, bounds)]).tobytes() for b in some]
                arrays = [pa.array([g] * len(some), pa.int32()), pa.array(some, pa.int64())]
                arrays += [pa.array([counts[:, b].tobytes() for b in some], pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["__stratum", "__block", "counts", "places"])

    stretches = int(ends[-1]) if len(ends) else 0
    numbers = spark.range(0, stretches, 1, int(max(1, min(tasks, stretches))))
    return numbers.mapInArrow(draw, "__stratum int, __block bigint, counts binary, places binary")


def _by_block(
    df: DataFrame, id_col: str, columns: list[str], replicates: int, seed: int, label: str | None,
    reduce: Callable[[pa.Table, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """``reduce`` of every block of rows and the times (replicates x rows) each of them is drawn.

    The draws are those of ``bootstrap`` or, with ``label``, of ``stratified_bootstrap``. Rows are numbered
    in the order of their id and meet their draws block by block, so no row is copied.
    """
    spark = df.sparkSession
    rows = materialize(df.select(*dict.fromkeys([id_col, *columns, *([label] if label else [])])), "bootstrap-input")
    if label:
        kind = df.schema[label].dataType
        counts = sorted(_label_counts(rows, label).items(), key=lambda kv: repr(kv[0]))
        labels = F.array(*[F.lit(g).cast(kind) for g, _ in counts]).cast(f"array<{kind.simpleString()}>")
        sizes = [n for _, n in counts]
        none = next((k for k, (g, _) in enumerate(counts) if g is None), None)
        stratum = F.coalesce(F.array_position(labels, F.col(label)).cast("int") - 1, F.lit(none).cast("int"))
    else:
        sizes, stratum = [rows.count()], F.lit(0)
    numbered = grouped_rank(rows.withColumn("__stratum", stratum), ["__stratum"], id_col, "__rn")
    block = F.floor((F.col("__rn") - 1) / BLOCK_ROWS).cast("bigint")
    numbered = numbered.select(
        "__stratum", block.alias("__block"), ((F.col("__rn") - 1) % BLOCK_ROWS).cast("int").alias("__at"), *columns
    )
    keys = ["__stratum", "__block"]

    def meet(key: tuple, mine: pa.Table, draws: pa.Table) -> pa.Table:
        times = np.zeros((replicates, mine.num_rows))
        packed = zip(draws.column("counts").to_pylist(), draws.column("places").to_pylist())
        for counts, places in packed:
            ends = np.cumsum(np.frombuffer(counts, np.int32))[:-1]
            for r, part in enumerate(np.split(np.frombuffer(places, np.uint16), ends)):
                times[r] += np.bincount(part, minlength=mine.num_rows)
        at = mine.column("__at").to_numpy()
        out = reduce(mine.select(columns), times[:, at])
        return out.append_column("__stratum", pa.array([key[0].as_py()] * len(out), pa.int32()))

    draws = _draw_blocks(spark, sizes, replicates, seed)
    out = numbered.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInArrow(meet, f"{schema}, __stratum int")
    return out.withColumn(label, F.element_at(labels, F.col("__stratum") + 1)).drop("__stratum") if label else out.drop("__stratum")


def bootstrap_sums(
    df: DataFrame, id_col: str, terms: list[str], replicates: int, seed: int = 0, label: str | None = None
) -> DataFrame:
    """Sums of ``terms`` per replicate (and label) of the exact bootstrap, as matrix products by block.

    The same as drawing rows by ``bootstrap`` or, with ``label``, ``stratified_bootstrap`` and summing them:
    missing terms do not count, and a sum of nothing is NULL. Adds ``n``, the number of rows drawn.
    """

    def sums(rows: pa.Table, times: np.ndarray) -> pa.Table:
        n = times.sum(axis=1)
        out = {"replicate": pa.array(np.arange(replicates, dtype=np.int32)), "n": pa.array(n)}
        x = np.column_stack([np.zeros(rows.num_rows), *[rows.column(t).fill_null(0.0).to_numpy() for t in terms]])[:, 1:]
        odd = ~np.isfinite(x)
        total = times @ np.where(odd, 0.0, x)
        for i, j in zip(*np.nonzero(odd)):  # a row not drawn adds nothing, whatever it holds
            total[:, j] += np.where(times[:, i] > 0, x[i, j], 0.0)
        for j, t in enumerate(terms):
            column = rows.column(t)
            seen = times @ column.is_valid().to_numpy().astype(float) if column.null_count else n
            out[t] = pa.array(total[:, j], mask=seen == 0)
        return pa.table(out)

    schema = "replicate int, n double, " + ", ".join(f"`{t}` double" for t in terms)
    wide = df.withColumns({t: F.col(t).cast("double") for t in terms})
    parts = _by_block(wide, id_col, terms, replicates, seed, label, sums, schema)
    return parts.groupBy("replicate", *([label] if label else [])).agg(*[F.sum(c).alias(c) for c in ["n", *terms]])


def bootstrap_groups(
    df: DataFrame, id_col: str, columns: list[str], replicates: int, seed: int = 0, label: str | None = None
) -> DataFrame:
    """replicate, ``columns``, label, times: drawn rows of the exact bootstrap, equal ones of a block in one.

    For statistics of few columns, such as scores, that need how often each combination of values is drawn.
    A combination may come once a block.
    """
    kinds = dict(df.dtypes)

    def groups(rows: pa.Table, times: np.ndarray) -> pa.Table:
        code = np.zeros(rows.num_rows, np.int64)
        for c in columns:
            own = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
        _, first = np.unique(code, return_index=True)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(first)))
        total = np.add.reduceat(times[:, order], starts, axis=1).astype(np.int64)
        replicate, group = np.nonzero(total)
        out = rows.take(pa.array(first[group]))
        out = out.add_column(0, "replicate", pa.array(replicate.astype(np.int32)))
        return out.append_column("times", pa.array(total[replicate, group]))

    schema = "replicate int, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", times bigint"
    return _by_block(df, id_col, columns, replicates, seed, label, groups, schema)


def _mix32_np(m: np.ndarray) -> np.ndarray:
    m = m & np.uint64(M - 1)
    for _ in range(2):
        m = ((m ^ (m >> np.uint64(16))) * np.uint64(K)) & np.uint64(M - 1)
    return m ^ (m >> np.uint64(16))


def poisson_times(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, rows x replicates, from a hash of row id and replicate."""
    keys = ids.astype(np.int64).view(np.uint64)[:, None]
    high = _mix32_np(salts[None, :] ^ (keys >> np.uint64(32)))
    u = _mix32_np(high ^ (keys & np.uint64(M - 1))) / float(M)
    # Distribution function of Poisson(1); the share beyond 12 is below 1e-10.
    terms = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
    return np.searchsorted(terms, u, side="right")


def poisson_sums(
    df: DataFrame, id_col: str, terms: list[str], replicates: int, seed: int = 0
) -> DataFrame:
    """Sums of ``terms`` per bootstrap replicate, each row counting Poisson(1) times.

    The bootstrap for large tables: one pass, no row is copied. Each batch is a product of its
    weights (rows x replicates) and its terms; a partition emits one row per replicate, and those
    are summed. Adds ``n``, the number of rows drawn.
    """
    salts = np.array([salt(seed + r) for r in range(replicates)], dtype=np.uint64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, len(terms) + 1))
        for batch in batches:
            ids = batch.column(id_col).to_numpy(zero_copy_only=False)
            values = [np.nan_to_num(batch.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)) for t in terms]
            x = np.column_stack([np.ones(len(ids)), *values])
            for start in range(0, len(ids), 8192):
                part = slice(start, start + 8192)
                total += poisson_times(ids[part], salts).T.astype(float) @ x[part]
        names = ["replicate", "n", *terms]
        arrays = [pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(total.shape[1])]]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "replicate int, n double, " + ", ".join(f"`{t}` double" for t in terms)
    partials = df.select(id_col, *terms).mapInArrow(partial, schema)
    return partials.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ["n", *terms]])


def shuffle_rows(df: DataFrame, id_col: str, epoch: int, seed: int = 0, train_only: str | None = None) -> DataFrame:
    """Rows in a new order each epoch: partitions are rebuilt by a seeded hash and sorted by it."""
    if train_only:
        df = df.filter(F.col(train_only) == "train")
    key = mix32(stream_key(F.col(id_col), seed + epoch))
    keyed = df.withColumn("__h", key)
    return keyed.repartition("__h").sortWithinPartitions("__h", id_col).drop("__h")


def epoch_batches(
    df: DataFrame, id_col: str, epochs: int, batch_size: int, seed: int = 0, train_only: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Every row once an epoch with its ``epoch``, ``position`` (from 0) and ``batch``.

    The order of an epoch is that of a seeded hash of the id, then the id: it does not depend on how
    the rows lie in partitions, and positions come from ranges of the hash, so no task sorts an epoch.
    The last batch of an epoch may be smaller. Rows with a NULL id come first and tie among themselves.
    """
    if train_only:
        df = df.filter(F.col(train_only) == "train")
    keys = [F.struct(F.lit(e).alias("epoch"), mix32(stream_key(F.col(id_col), seed + e)).alias("__h")) for e in range(epochs)]
    every = df.select("*", F.inline(F.array(*keys)))
    every = every.withColumn("__h", F.coalesce("__h", F.lit(-1)))
    ranked = grouped_rank(every, ["epoch"], "__h", "position", tie=id_col, ranges=ranges).drop("__h")
    ranked = ranked.withColumn("position", F.col("position") - 1)
    return ranked.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))
