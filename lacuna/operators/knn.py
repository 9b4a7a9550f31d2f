"""Exact nearest-neighbour imputation over partially missing vectors, without all-pairs joins.

Distance is Euclidean over the coordinates both vectors have, scaled up by the share of missing
ones. Equal vectors are compared once. Donors and queries fall into dyadic cells by missing pattern
and by value, and bounding boxes of the cells bound all distances between two cells:

1. Pairs of cells are refined level by level, from a few hundred cells a side to the leaves. At each
   level an aggregate finds how far the k-th neighbour of a query cell can be, and pairs that lie
   farther go. Every level is one join of the surviving pairs with the children of their cells.
2. The pairs that are left bound the k-th neighbour of each single query in the same way. The query
   is compared with the donors of its most promising cell, which tightens its bound, and then with
   those cells only that reach into it.

Where the donors take ``DIRECT_PARTS`` times ``DIRECT_BYTES`` at most (and, over more than ``FEW_COLUMNS``
columns, all comparisons are ``DIRECT_CELLS`` at most), these steps cost more than they save: each task
gets the distinct donors as arrays, ``DIRECT_BYTES`` at a time, and compares tiles of its queries with the
tiles of donors near them. Donors that share one column only with a query are sorted by it and found by
bisection first; they bound the rest. Donors of up to ``SLAB_COLUMNS`` columns that exceed one broadcast are
dealt over slabs instead (``_by_slabs``), where a task holds a slab of donors and its queries. All ways give the same neighbours; ``direct`` chooses between the cells and the rest.

Only what cannot matter is left out, so the result is exact. Boxes prune well while the columns that
vary most decide the distance; over many equally important columns, most cells reach into the
distance and the work grows with queries times donors, as for any exact method. All plans are joins;
the driver sees the counts of at most 4**PATTERN_COLUMNS pairs of patterns and CUTS quantiles of
GRID_DIMS columns. Donors are copied for each pattern of the queries, at most 2**PATTERN_COLUMNS. Cells too large for a task are cut into chunks by hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.session import materialize

#: Columns whose bins make the cells (those of the greatest variance), and those whose gaps do.
GRID_DIMS = 4
PATTERN_COLUMNS = 5
#: Wanted rows of a leaf, and of a task's chunk.
CELL_ROWS = 64
CHUNK = 2048
#: Quantiles per grid column; bins are finer than that by interpolation.
CUTS = 256
#: Cells a side with which the refinement starts.
FIRST_CELLS = 512
MAX_DEPTH = 20
SLACK = 1 + 1e-9
#: Bounds of the direct way: bytes of the distinct donors of one broadcast, broadcasts, and, beyond FEW_COLUMNS,
#: donors x queries x columns.
DIRECT_BYTES = 64 << 20
DIRECT_PARTS = 8
DIRECT_CELLS = 20_000_000_000_000
#: Up to so many columns tiles of donors prune; beyond, a matrix product bounds the distances.
FEW_COLUMNS = 8
#: Rows of a tile of donors, queries of a tile, and queries or comparisons of a task, of the direct way.
TILE_ROWS = 256
BLOCK_QUERIES = 128
TASK_QUERIES = 20_000
TASK_CELLS = 100_000_000_000
#: Beyond one broadcast, up to so many columns: donors of a slab, those that decide on the cuts, rows of a task, and slabs
#: besides its own that a query is sent to at most, on average.
SLAB_COLUMNS = 3
SLAB_ROWS = 50_000
SLAB_SAMPLE = 400_000
SLAB_TASK_ROWS = 500_000
SLAB_VISITS = 4
#: Pairs of one tile of queries that sorted donors of a single shared column give at once; tiles of donors beyond.
WINDOW_PAIRS = 1 << 20


def _level(cell_bins: str, level: int) -> Column:
    """Key of the cell at ``level`` that holds a leaf; leaves above that level stay themselves."""
    up = f"transform({cell_bins}, x -> if(x < 0, x, shiftright(x, greatest(depth - {level}, 0))))"
    return F.expr(f"concat(pattern, ':', array_join({up}, ','))")


def _pattern(gaps: list[str]) -> Column:
    return F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "x").otherwise("o") for c in gaps])


def _leaves(df: DataFrame, grid: dict[str, list[float]], gaps: list[str]):
    """``df`` with its cells, and per level the number of cells at most.

    ``asked`` is the pattern of the queries that a row is for: bins are of columns those have.
    """
    df = df.withColumn("pattern", F.concat_ws("/", "asked", _pattern(gaps)))
    counts = df.groupBy("pattern").count().collect()  # at most 4 ** PATTERN_COLUMNS rows
    dims, depth = {}, {}
    for r in counts:
        asked, own = r.pattern.split("/")
        dims[r.pattern] = sum(c not in gaps or asked[gaps.index(c)] == own[gaps.index(c)] == "o" for c in grid)
        wanted = math.log2(max(1.0, r["count"] / CELL_ROWS)) / max(1, dims[r.pattern])
        depth[r.pattern] = min(MAX_DEPTH, math.ceil(wanted)) if dims[r.pattern] else 0
    depths = F.create_map(*[F.lit(v) for p in depth.items() for v in p]) if depth else F.lit(None)
    df = df.withColumn("depth", F.element_at(depths, F.col("pattern")) if depth else F.lit(0))
    bins = []
    for c, cuts in grid.items():
        edges = F.array(*[F.lit(e) for e in cuts])
        # linear between two quantiles: about uniform, so that bins hold about as many rows
        k = F.lit(1)
        if len(cuts) > 2:
            splits = [float("-inf"), *cuts[1:-1], float("inf")]
            df = Bucketizer(splits=splits, inputCol=c, outputCol=f"__k_{c}", handleInvalid="keep").transform(df)
            k = F.col(f"__k_{c}").cast("int") + 1
        lo, hi = F.element_at(edges, k), F.element_at(edges, k + 1)
        within = F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        u = (k - 1 + within) / (len(cuts) - 1)
        size = F.expr("shiftleft(1, depth)")
        unasked = F.substring("asked", gaps.index(c) + 1, 1) == "x" if c in gaps else F.lit(False)
        bins.append(F.when(F.col(c).isNull() | unasked, -1).otherwise(F.least(F.floor(u * size).cast("int"), size - 1)))
    df = df.withColumn("bins", F.array(*bins).cast("array<int>")).drop(*[f"__k_{c}" for c in grid])
    deepest = max(depth.values(), default=0)
    sizes = [sum(2 ** (dims[p] * min(lv, depth[p])) for p in depth) for lv in range(deepest + 1)]
    return df.withColumn("cell", _level("bins", deepest)), sizes


def _directory(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per leaf: rows, and per column its range, rows and copies with a value."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"n{i}")]
        aggs.append(F.sum(F.when(F.col(c).isNotNull(), F.col("mult")).otherwise(0)).alias(f"m{i}"))
    return df.groupBy("cell", "asked", "pattern", "depth", "bins").agg(*aggs)


def _nodes(leaves: DataFrame, n: int, level: int, side: str) -> DataFrame:
    """The cells of one level: key, key of the parent, rows and an array of boxes."""
    named = leaves.select("*", _level("bins", level).alias("key"), _level("bins", level - 1).alias("up"))
    aggs = [F.sum("rows").alias("rows")]
    for i in range(n):
        aggs += [F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
        aggs += [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"m{i}").alias(f"m{i}")]
    boxes = _boxes(n)
    out = named.groupBy("asked", "key", "up").agg(*aggs).select("asked", "key", "up", "rows", boxes.alias("box"))
    return out.toDF("asked", *[f"{side}_{c}" for c in out.columns[1:]])


def _boxes(n: int) -> Column:
    return F.array(*[
        F.struct(F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"))
        for i in range(n)
    ])


# Per column: whether all pairs have it, whether some can, and the least and greatest gap.
_GAPS = """zip_with(q_box, d_box, (x, y) -> named_struct(
  'sure', int(x.n = q_rows AND y.n = d_rows), 'maybe', int(x.n > 0 AND y.n > 0),
  'near', coalesce(pow(greatest(0D, y.lo - x.hi, x.lo - y.hi), 2), 0D),
  'far', coalesce(pow(greatest(abs(y.hi - x.lo), abs(x.hi - y.lo)), 2), 0D)))"""


def _sum(of: str) -> str:
    return f"aggregate(gaps, 0D, (a, g) -> a + {of})"


def _with_bounds(pairs: DataFrame, n: int) -> DataFrame:
    """Add ``low`` and ``high`` bounds of all squared distances between two cells; drop pairs without any."""
    pairs = pairs.withColumn("gaps", F.expr(_GAPS)).withColumn("some", F.expr(_sum("g.maybe"))).filter("some > 0")
    low = f"{_sum('g.sure * g.near')} * {n} / some"
    high = f"CASE WHEN {_sum('g.sure')} > 0 THEN {_sum('g.maybe * g.far')} * {n} / {_sum('g.sure')} ELSE double('infinity') END"
    return pairs.withColumn("low", F.expr(low)).withColumn("high", F.expr(high)).drop("gaps", "some")


def _reaching(limits: str) -> str:
    """A column that some query lacks and some donor has, not farther than the limit of that column."""
    return (
        f"exists(zip_with(arrays_zip(q_box, d_box), {limits}, (b, r) -> "
        f"b.q_box.n < q_rows AND b.d_box.m > 0 AND low <= r * {SLACK} + 1e-300), hit -> hit)"
    )


def _cell_pairs(q_leaves: DataFrame, d_leaves: DataFrame, n: int, k: int, q_sizes: list[int], d_sizes: list[int]) -> DataFrame:
    """Pairs of leaves that may hold a neighbour, with the limit of each column."""
    last = max(len(q_sizes), len(d_sizes)) - 1
    first = max(lv for lv in range(last + 1) if lv == 0 or max(_at(q_sizes, lv), _at(d_sizes, lv)) <= FIRST_CELLS)
    pairs = None
    for level in range(first, last + 1):
        q, d = _nodes(q_leaves, n, level, "q"), _nodes(d_leaves, n, level, "d")
        if pairs is None:  # at most FIRST_CELLS a side, or the patterns alone
            cand = q.join(d, "asked").withColumn("limits", F.array_repeat(F.lit(float("inf")), n))
        else:
            cand = pairs.join(q.drop("asked"), "q_up").join(d.drop("asked"), "d_up")
        cand = _with_bounds(cand, n)
        enough = [F.when(F.col("d_box")[i]["m"] >= k, F.col("high")) for i in range(n)]
        best = cand.groupBy("q_key").agg(F.array(*[F.min(e) for e in enough]).alias("best"), F.first("limits").alias("upper"))
        best = best.select(
            F.col("q_key").alias("b_key"),
            F.expr("zip_with(best, upper, (b, r) -> least(coalesce(b, r), r))").alias("tight"),
        )
        kept = cand.join(best, F.col("q_key") == F.col("b_key")).filter(_reaching("tight"))
        kept = kept.select(F.col("q_key").alias("q_up"), F.col("d_key").alias("d_up"), F.col("tight").alias("limits"))
        pairs = materialize(kept, "knn-pairs")
    return pairs.withColumnsRenamed({"q_up": "cell", "d_up": "d_cell"})


def _at(sizes: list[int], level: int) -> int:
    return sizes[min(level, len(sizes) - 1)]


def _nearest_in_unit(columns: list[str], k: int) -> Callable:
    """Distances of one chunk of queries to one chunk of donors, and the k best per missing value."""
    n = len(columns)

    def compare(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(donors):
            q, x = queries[columns].to_numpy(float), donors[columns].to_numpy(float)
            limits = np.array(queries["limits"].tolist(), float).reshape(len(q), n)
            mult, qid = donors["mult"].to_numpy(), queries["qid"].to_numpy()
            total, common = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
            for j in range(n):
                diff = q[:, j : j + 1] - x[None, :, j]
                seen = ~np.isnan(diff)
                total += np.where(seen, diff * diff, 0.0)
                common += seen
            dist = np.where(common > 0, total * n / np.maximum(common, 1), np.inf)
            for f in range(n):
                need, have = np.flatnonzero(np.isnan(q[:, f])), np.flatnonzero(~np.isnan(x[:, f]))
                if not len(need) or not len(have):
                    continue
                sub, value = dist[np.ix_(need, have)], x[have, f]
                # The k-th smallest distance with all its ties, then the smaller values first.
                reach = np.partition(sub, min(k, len(have)) - 1, axis=1)[:, min(k, len(have)) - 1]
                reach = np.minimum(reach, limits[need, f] * SLACK + 1e-300)
                row, col = np.nonzero((sub <= reach[:, None]) & np.isfinite(sub))
                order = np.lexsort((value[col], sub[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[kept], col[kept]
                out.append((qid[need[row]], np.full(len(row), f), sub[row, col], value[col], mult[have[col]]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [np.empty(0)] * 5
        types = {"qid": "int64", "f": "int32", "d2": "float64", "v": "float64", "mult": "int64"}
        return pd.DataFrame(dict(zip(types, parts))).astype(types)

    return compare


def _compared(pairs: DataFrame, x: DataFrame, d_leaves: DataFrame, columns: list[str], k: int, chunk: int) -> DataFrame:
    """The k best of every (query, donor cell) of ``pairs`` (qid, d_cell, limits, columns)."""
    sizes = pairs.groupBy("d_cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("qn"))
    sizes = sizes.join(d_leaves.select(F.col("cell").alias("d_cell"), F.ceil(F.col("rows") / chunk).alias("dn")), "d_cell")
    unit = ["d_cell", "qc", "dc"]
    left = pairs.join(sizes, "d_cell").withColumn("qc", F.pmod(F.xxhash64("qid"), "qn"))
    left = left.withColumn("dc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("dn") - 1)))
    right = x.withColumnRenamed("cell", "d_cell").join(sizes, "d_cell").withColumn("dc", F.pmod(F.xxhash64(*columns), "dn"))
    right = right.withColumn("qc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qn") - 1)))
    return (
        left.select(*unit, "qid", "limits", *columns)
        .groupBy(*unit)
        .cogroup(right.select(*unit, "mult", *columns).groupBy(*unit))
        .applyInPandas(_nearest_in_unit(columns, k), "qid bigint, f int, d2 double, v double, mult bigint")
    )


def _vectors(df: DataFrame, columns: list[str], donors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct incomplete vectors, numbered, and distinct donors, counted."""
    cells = [F.col(c).cast("double").alias(c) for c in columns]
    some = F.coalesce(*columns).isNotNull()
    lacking = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    x = donors.select(*cells).filter(some).groupBy(*columns).agg(F.count(F.lit(1)).alias("mult"))
    x = materialize(x, "knn-donors")
    # numbers are drawn once, when the table is written
    q = df.select(*cells).filter(some & lacking).distinct().select(
        F.monotonically_increasing_id().alias("qid"), F.lit(1).cast("bigint").alias("mult"), *columns
    )
    return materialize(q, "knn-queries"), x


def _prepared(q: DataFrame, x: DataFrame, columns: list[str], k: int, chunk: int):
    """The vectors with their cells, the cells of the donors, and the pairs to compare."""
    n = len(columns)
    stats = x.agg(
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(columns)],
    ).first()
    q_gaps = q.agg(*[F.count(F.when(F.col(c).isNull(), 1)) for c in columns]).first()
    spread = sorted(range(n), key=lambda i: (-(stats[f"v{i}"] or 0.0), i))
    dims = [columns[i] for i in spread[:GRID_DIMS] if stats[f"v{i}"]]
    gap = sorted(range(n), key=lambda i: (-(stats[f"g{i}"] + q_gaps[i]), i))
    gaps = [columns[i] for i in gap[:PATTERN_COLUMNS] if stats[f"g{i}"] + q_gaps[i]]
    found = x.approxQuantile(dims, [i / CUTS for i in range(CUTS + 1)], 0.5 / CUTS) if dims else []
    grid = {c: sorted(set(cuts)) for c, cuts in zip(dims, found) if len(set(cuts)) > 1}
    q = q.withColumn("asked", _pattern(gaps))
    asked = [r.asked for r in q.select("asked").distinct().collect()]  # at most 2 ** PATTERN_COLUMNS
    # a copy of the donors for each pattern of the queries, cut by the columns that those have
    x = x.withColumn("asked", F.explode(F.array(*[F.lit(a) for a in asked]).cast("array<string>")))
    q, q_sizes = _leaves(q, grid, gaps)
    x, d_sizes = _leaves(x, grid, gaps)
    deepest = max(len(q_sizes), len(d_sizes)) - 1
    # both sides name their leaves at the deepest level
    x, q = x.withColumn("cell", _level("bins", deepest)), q.withColumn("cell", _level("bins", deepest))
    x, q = materialize(x, "knn-donors"), materialize(q, "knn-queries")
    d_leaves = materialize(_directory(x, columns), "knn-cells")
    q_leaves = materialize(_directory(q, columns), "knn-cells")
    pairs = _cell_pairs(q_leaves, d_leaves, n, k, q_sizes, d_sizes)
    x = x.select("cell", "mult", *columns)
    reached = materialize(_routes(q, d_leaves, pairs, columns, k), "knn-routes")
    tried = _compared(reached.filter("seed"), x, d_leaves, columns, k, chunk).groupBy("qid", "f")
    kth = (  # the distance by which k donors are found
        f"aggregate(sort_array(near), named_struct('left', {k}L, 'd', CAST(NULL AS DOUBLE)), (a, x) -> named_struct("
        "'left', a.left - x.mult, 'd', if(a.left > 0, x.d2, a.d)), a -> if(a.left <= 0, a.d, NULL))"
    )
    tried = tried.agg(F.collect_list(F.struct("d2", "mult")).alias("near")).select("qid", "f", F.expr(kth).alias("d2"))
    own = tried.groupBy("qid").agg(F.array(*[F.min(F.when(F.col("f") == i, F.col("d2"))) for i in range(n)]).alias("own"))
    tight = F.expr("if(own IS NULL, limits, zip_with(limits, own, (r, o) -> if(r IS NULL, r, least(r, o))))")
    routed = reached.join(own, "qid", "left").withColumn("limits", tight)
    routed = routed.filter(F.expr(f"exists(limits, r -> r IS NOT NULL AND low <= r * {SLACK} + 1e-300)"))
    return q, x, d_leaves, materialize(routed.select("qid", "d_cell", "limits", *columns), "knn-routes")


def _routes(q: DataFrame, d_leaves: DataFrame, pairs: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The donor cells that reach into the bound of a query's k-th neighbour.

    With ``low``, the least distance to the cell, ``limits`` by column (NULL where there is nothing to
    look for) and ``seed`` on the cells whose donors are surely the nearest as a whole.
    """
    n = len(columns)
    boxes = [f"{kind}{i}" for kind in ("lo", "hi", "n", "m") for i in range(n)]
    boxes = d_leaves.select(F.col("cell").alias("d_cell"), F.col("rows").alias("d_rows"), *boxes)
    cand = q.select("cell", "qid", *columns).join(pairs.join(boxes, "d_cell"), "cell")
    sure, maybe, near, far = [], [], F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(columns):
        v, lo, hi = F.col(c), F.col(f"lo{i}"), F.col(f"hi{i}")
        all_have, some_have = v.isNotNull() & (F.col(f"n{i}") == F.col("d_rows")), v.isNotNull() & (F.col(f"n{i}") > 0)
        sure.append(all_have.cast("int"))
        maybe.append(some_have.cast("int"))
        gap, reach = F.greatest(F.lit(0.0), lo - v, v - hi), F.greatest(F.abs(hi - v), F.abs(v - lo))
        near = near + F.when(all_have, gap * gap).otherwise(0.0)
        far = far + F.when(some_have, reach * reach).otherwise(0.0)
    cand = cand.withColumns({"sure": sum(sure, F.lit(0)), "maybe": sum(maybe, F.lit(0)), "near": near, "far": far})
    cand = cand.filter("maybe > 0").withColumns({
        "low": F.col("near") * n / F.col("maybe"),
        "high": F.when(F.col("sure") > 0, F.col("far") * n / F.col("sure")).otherwise(float("inf")),
    })
    # rows of a query are together: the join was on its cell
    mine = W.partitionBy("cell", "qid")
    enough = [F.when(F.col(c).isNull() & (F.col(f"m{i}") >= k), F.col("high")) for i, c in enumerate(columns)]
    cand = cand.withColumns({f"own{i}": F.min(e).over(mine) for i, e in enumerate(enough)})
    wanted = [F.col(c).isNull() & (F.col(f"m{i}") > 0) for i, c in enumerate(columns)]
    # least skips nulls
    limits = [F.when(w, F.least(F.col("limits")[i], F.col(f"own{i}"))) for i, w in enumerate(wanted)]
    reaches = [F.coalesce(F.col("low") <= r * SLACK + 1e-300, F.lit(False)) for r in limits]
    seeds = [F.coalesce(e == F.col(f"own{i}"), F.lit(False)) for i, e in enumerate(enough)]
    cand = cand.filter(reduce(Column.__or__, reaches))
    seed = reduce(Column.__or__, seeds) & (F.col("high") < float("inf"))
    return cand.select("qid", "d_cell", "low", seed.alias("seed"), F.array(*limits).alias("limits"), *columns)


def compared_pairs(df: DataFrame, columns: list[str], donors: DataFrame, k: int = 5) -> DataFrame:
    """How many (query, donor) pairs the final comparison makes, next to all of them."""
    q, x, d_leaves, routed = _prepared(*_vectors(df, columns, donors), columns, k, CHUNK)
    sizes = d_leaves.select(F.col("cell").alias("d_cell"), "rows")
    done = routed.join(sizes, "d_cell").agg(F.sum("rows").alias("compared"))
    every = donors.select(*columns).filter(F.coalesce(*columns).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("donors")).crossJoin(q.agg(F.count(F.lit(1)).alias("queries")))
    return done.crossJoin(every).withColumn("share", F.col("compared") / F.col("donors") / F.col("queries"))


def _tiles(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Positions of ``x`` in tiles of at most ``rows``, halved along the widest column."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        wide = int(np.argmax(np.ptp(x[at], axis=0)))
        half = len(at) // 2
        at = at[np.argpartition(x[at, wide], half)]
        open_ += [at[half:], at[:half]]
    return out


def _first_of_runs(y: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each run of equal values of ``y``."""
    at = np.arange(len(y))
    starts = np.ones(len(y), bool)
    starts[1:] = y[1:] != y[:-1]
    return at[at - np.maximum.accumulate(np.where(starts, at, 0)) < k]


def _sides(donors: list[tuple], known: np.ndarray, chunk: int, k: int) -> list[tuple]:
    """Per pattern of donors that can help: shared and wanted columns, values, copies, tiles, their boxes.

    Of donors at one place of a single shared column, the k of the smallest values go before all others, whatever
    the query: only they are kept, for each wanted column."""
    out = []
    for have, x, mult in donors:
        shared, wanted = np.flatnonzero(known & have), np.flatnonzero(~known & have).tolist()
        if not len(shared) or not wanted:
            continue
        y = np.ascontiguousarray(x[:, shared])
        if len(shared) == 1:
            rows = min(chunk, TILE_ROWS)
            for f in wanted:
                order = np.lexsort((x[:, f], y[:, 0]))
                order = order[_first_of_runs(y[order, 0], k)]
                starts = np.arange(0, len(order), rows)
                out.append(_side(shared, [f], y[order], x[order], mult[order], starts, np.minimum(starts + rows, len(order))))
        else:
            at = _tiles(y, chunk if len(shared) > FEW_COLUMNS else min(chunk, TILE_ROWS))
            order, ends = np.concatenate(at), np.cumsum([len(t) for t in at])
            out.append(_side(shared, wanted, y[order], x[order], mult[order], ends - [len(t) for t in at], ends))
    return out


def _side(shared, wanted, y, x, mult, starts, ends) -> tuple:
    lo, hi = np.minimum.reduceat(y, starts, axis=0), np.maximum.reduceat(y, starts, axis=0)
    return shared, wanted, y, x, mult, starts, ends, lo, hi


#: Donors, pattern and sides of the last task of this worker: tasks of one pattern follow each other.
_LAST: list = []


def _sides_once(donors: list[tuple], known: np.ndarray, chunk: int, k: int) -> list[tuple]:
    if not _LAST or _LAST[0] is not donors or _LAST[1] != (known.tobytes(), chunk, k):
        _LAST.clear()
        _LAST.extend([donors, (known.tobytes(), chunk, k), _sides(donors, known, chunk, k)])
    return _LAST[2]


def _block_search(n: int, k: int) -> Callable:
    """The search for the k best donors of a tile of queries of one pattern.

    Tiles of donors are compared from the nearest on, as far as one reaches into the distance of the k-th
    neighbour of some query of the tile.
    """

    def merged(best: tuple, new: tuple) -> tuple:
        """The k best of each row, the smaller value first on ties; rows in order."""
        row, dist, value, mult = (np.concatenate(p) for p in zip(best, new))
        order = np.lexsort((value, dist, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        return tuple(np.concatenate(p)[order] for p in zip(best, new))

    def distances(q: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple:
        """(row, position, distance) of the pairs not farther than the bound of the query, or than its k-th here."""
        scale = n / y.shape[1]
        if y.shape[1] <= FEW_COLUMNS:
            near = np.zeros((len(q), len(y)))
            for j in range(y.shape[1]):
                gap = q[:, j : j + 1] - y[None, :, j]
                gap *= gap
                near += gap
            slack = 0.0
        else:  # a matrix product bounds the distances, and only close pairs are computed
            qq, yy = (q * q).sum(axis=1), (y * y).sum(axis=1)
            near = qq[:, None] + yy[None, :] - 2 * (q @ y.T)
            slack = 1e-13 * y.shape[1] * (qq.max() + yy.max())
        reach = bound / scale
        if len(y) > k and np.isinf(reach).any():  # the k-th of this tile bounds the k-th of all
            reach = np.minimum(reach, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
        row, col = np.nonzero(near <= (reach * SLACK + slack + 1e-300)[:, None])
        dist = np.zeros(len(row))
        for j in range(y.shape[1]):
            gap = q[row, j] - y[col, j]
            dist += gap * gap
        dist *= n
        dist /= y.shape[1]
        return row, col, dist

    def window(q: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple | None:
        """As ``distances``, of queries of one column to sorted donors; None where equal values make too many pairs."""
        first = np.clip(np.searchsorted(y, q) - k, 0, max(len(y) - 2 * k, 0))
        around = np.abs(y[first[:, None] + np.arange(min(2 * k, len(y)))] - q[:, None])
        reach = np.sqrt(bound / n) * SLACK
        if around.shape[1] > k:  # the k-th of the nearest on both sides
            reach = np.minimum(reach, np.partition(around, k - 1, axis=1)[:, k - 1])
        reach = reach * SLACK + 1e-15 * np.abs(q) + 1e-150
        lo, hi = np.searchsorted(y, q - reach), np.searchsorted(y, q + reach, "right")
        sizes = hi - lo
        if sizes.sum() > WINDOW_PAIRS:
            return None
        row = np.repeat(np.arange(len(q)), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)
        dist = q[row] - y[col]
        dist *= dist
        dist *= n
        return row, col, dist

    def tighten(best: tuple, bound: np.ndarray) -> None:
        rows, counts = np.unique(best[0], return_counts=True)
        last = np.cumsum(counts) - 1
        bound[rows[counts == k]] = best[1][last[counts == k]]

    def block(q: np.ndarray, known: np.ndarray, found: list[tuple], held: tuple | None = None, limits: np.ndarray | None = None) -> dict[int, tuple]:
        """Per missing column: (row, squared distance, value, copies) of the best donors of queries with one pattern.

        ``held`` is what was found elsewhere, (row, column, ...) in order; ``limits`` bounds what is looked for."""
        none = (np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64))
        best = {f: none for f in np.flatnonzero(~known).tolist()}
        bound = {f: np.full(len(q), np.inf) if limits is None else limits[:, f].copy() for f in best}
        for f in best if held is not None else ():
            mine = held[1] == f
            best[f] = (held[0][mine], *(h[mine] for h in held[2:]))
            tighten(best[f], bound[f])
        reached = {f for _, wanted, *_ in found for f in wanted}

        def take(wanted: list[int], x: np.ndarray, mult: np.ndarray, row: np.ndarray, col: np.ndarray, dist: np.ndarray) -> None:
            for f in wanted:
                near = dist <= bound[f][row]
                r, c = row[near], col[near]
                if not len(r):
                    continue
                best[f] = merged(best[f], (r, dist[near], x[c, f], mult[c]))
                tighten(best[f], bound[f])

        lows = []
        for shared, wanted, y, x, mult, starts, _, lo, hi in found:
            mine = q[:, shared]
            if len(shared) == 1 and np.isfinite(mine).all():
                pairs = window(mine[:, 0], y[:, 0], np.max([bound[f] for f in wanted], axis=0))
                if pairs is not None:
                    take(wanted, x, mult, *pairs)
                    lows.append(np.full(len(starts), np.inf))
                    continue
            gap = np.maximum(0.0, np.maximum(lo - mine.max(axis=0), mine.min(axis=0) - hi))
            lows.append((gap * gap).sum(axis=1) * n / len(shared))
        low, side = np.concatenate(lows), np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        tile = np.concatenate([np.arange(len(x)) for x in lows])
        for t in np.argsort(low, kind="stable").tolist():
            if low[t] == np.inf or low[t] > max(bound[f].max() for f in reached) * SLACK + 1e-300:
                break
            shared, wanted, y, x, mult, starts, ends, _, _ = found[side[t]]
            most = np.max([bound[f] for f in wanted], axis=0)
            if low[t] > most.max() * SLACK + 1e-300:
                continue
            at, end = starts[tile[t]], ends[tile[t]]
            row, col, dist = distances(q[:, shared], y[at:end], most)
            take(wanted, x, mult, row, col + at, dist)
        return best

    return block


def _nearest_of_all(columns: list[str], k: int, donors: Broadcast, chunk: int, choices: list[tuple[int, str]] | None = None) -> Callable:
    """The k best donors of each missing value of a task's queries, or with ``choices`` the fills by them.

    Queries of one pattern and the donors of each pattern are halved into tiles by the columns they share.
    """
    n, block = len(columns), _block_search(len(columns), k)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if mine is None or not mine.num_rows:
            return
        qid = mine.column("qid").to_numpy()
        q = np.column_stack([mine.column(i + 1).to_numpy() for i in range(n)]).astype(float)
        known = ~np.isnan(q)
        patterns, group = np.unique(known, axis=0, return_inverse=True)
        for g, pattern in enumerate(patterns):
            rows, found = np.flatnonzero(group.ravel() == g), _sides_once(donors.value, pattern, chunk, k)
            if not found:
                continue
            for at in _tiles(q[rows][:, pattern], BLOCK_QUERIES):
                some = rows[at]
                best = block(q[some], pattern, found)
                if choices is not None:
                    yield pa.RecordBatch.from_arrays(_fill_arrays(q[some], best, choices), names=_fill_names(columns))
                    continue
                for f, (row, dist, value, mult) in best.items():
                    columns_out = [pa.array(qid[some[row]]), pa.array(np.full(len(row), f, np.int32)), pa.array(dist), pa.array(value), pa.array(mult)]
                    yield pa.RecordBatch.from_arrays(columns_out, names=["qid", "f", "d2", "v", "mult"])

    return compare


def _fill_names(columns: list[str]) -> list[str]:
    return [*columns, *(f"fill_{i}" for i in range(len(columns)))]


def _fill_schema(columns: list[str]) -> str:
    return ", ".join([*(f"`{c}` double" for c in columns), *(f"fill_{i} array<double>" for i in range(len(columns)))])


def _fill_arrays(q: np.ndarray, best: dict[int, tuple], choices: list[tuple[int, str]]) -> list[pa.Array]:
    """The vectors and, per column, a list of the fills by each of ``choices``; null where nothing was found."""
    out = [pa.array(c, from_pandas=True) for c in q.T]
    for f in range(q.shape[1]):
        fills, some = _folds(*best[f], len(q), choices) if f in best else (np.empty((0, len(choices))), np.zeros(len(q), bool))
        offsets = np.concatenate([[0], np.cumsum(some) * len(choices)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(fills.ravel()), mask=pa.array(~some))
        out.append(lists)
    return out


def _folds(row: np.ndarray, dist: np.ndarray, value: np.ndarray, mult: np.ndarray, n: int, choices: list[tuple[int, str]]) -> tuple:
    """``_fold`` of each of ``choices`` for the queries that have neighbours, and which those are."""
    some = np.zeros(n, bool)
    some[row] = True
    at, place = (np.cumsum(some) - 1)[row], np.arange(len(row)) - np.searchsorted(row, row)
    shape = (int(some.sum()), int(place.max()) + 1 if len(row) else 0)
    d2, v, copies = np.full(shape, np.inf), np.zeros(shape), np.zeros(shape, np.int64)
    d2[at, place], v[at, place], copies[at, place] = dist, value, mult
    with np.errstate(divide="ignore"):
        near = np.where(d2 == 0, 1.0, 1 / np.sqrt(d2))
    out = np.empty((shape[0], len(choices)))
    for i, (k, weights) in enumerate(choices):
        left, total, weight = np.full(shape[0], k), np.zeros(shape[0]), np.zeros(shape[0])
        for j in range(shape[1]):
            take = np.minimum(left, copies[:, j])
            if weights == "distance":  # an exact match outweighs all others
                take = np.where((d2[:, 0] == 0) & (d2[:, j] > 0), 0, take)
            w = 1.0 if weights == "uniform" else near[:, j]
            left = left - take
            total += np.where(take > 0, take * v[:, j] * w, 0.0)
            weight += np.where(take > 0, take * w, 0.0)
        out[:, i] = total / weight
    return out, some


def _by_pattern(x: DataFrame, columns: list[str]) -> list[tuple]:
    """The donors as (which columns they have, values, copies), one entry per pattern."""
    table = x.select(*columns, "mult").toArrow()
    values = np.column_stack([table.column(c).to_numpy() for c in columns]).astype(float)
    mult = table.column("mult").to_numpy()
    patterns, group = np.unique(~np.isnan(values), axis=0, return_inverse=True)
    rows = [np.flatnonzero(group.ravel() == g) for g in range(len(patterns))]
    return [(p, np.asfortranarray(values[r]), mult[r]) for p, r in zip(patterns, rows)]


def _lists(row: np.ndarray, n: int, values: list[np.ndarray]) -> list[pa.Array]:
    """Values in the order of ``row`` as lists, one for each of ``n`` rows."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _flat(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    """Offsets and values of list columns of equal lengths."""
    lists = [table.column(c).combine_chunks() for c in names]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    return [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)]


class _Slabs:
    """Slabs of each column, and which of them hold donors for the queries of a pattern.

    A donor that shares columns with a query is found in the slabs of the shared column with the most slabs.
    """

    STATE = ["f", "d2", "v", "mult"]
    STATE_SCHEMA = "f array<int>, d2 array<double>, v array<double>, mult array<bigint>"

    def __init__(self, cuts: list[np.ndarray], asked: list[int], have: list[int]):
        n = self.n = len(cuts)
        self.cuts = cuts
        rank = sorted(range(n), key=lambda c: (-len(cuts[c]), c))
        #: Of a pattern of queries, a donor pattern's column; the columns of a pattern, and what is looked for in each.
        self.lead, self.spaces, self.wanted = {}, {}, {}
        for a in asked:
            for h in have:
                if a & h and ~a & h:
                    c = self.lead[a, h] = next(c for c in rank if a & h & 1 << c)
                    self.wanted[a, c] = self.wanted.get((a, c), 0) | (~a & h)
            self.spaces[a] = [c for c in rank if (a, c) in self.wanted]
        self.of_donors = {h: sorted({c for (_, g), c in self.lead.items() if g == h}) for h in have}

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (~np.isnan(x)).astype(np.int64) @ (1 << np.arange(self.n))

    def unit(self, c: int, values: np.ndarray) -> np.ndarray:
        return (c << 24) + np.searchsorted(self.cuts[c], values, "right").astype(np.int64)

    def spread(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Donors, once for each column by which some query finds them."""
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(self.n)]).astype(float)
            mult, codes = batch.column(self.n).to_numpy(zero_copy_only=False), self.codes(x)
            for c in range(self.n):
                at = np.flatnonzero(np.isin(codes, [h for h, cs in self.of_donors.items() if c in cs]))
                if len(at):
                    arrays = [pa.array(self.unit(c, x[at, c])), *(pa.array(v, from_pandas=True) for v in x[at].T), pa.array(mult[at])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["unit", *(f"c{i}" for i in range(self.n)), "mult"])

    def vectors(self, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.column_stack([table.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(self.n)]).astype(float)

    def step(self, j: int) -> Callable:
        """The slab of the j-th column of each query; those without one stay as they are."""
        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = self.vectors(batch)
                codes, unit = self.codes(q), -1 - batch.column("qid").to_numpy(zero_copy_only=False) % 997
                for a, spaces in self.spaces.items():
                    if j < len(spaces):
                        at = np.flatnonzero(codes == a)
                        unit[at] = self.unit(spaces[j], q[at, spaces[j]])
                names = ["unit", *batch.schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(unit), *batch.columns], names=names)

        return keyed

    def searched(self, q: np.ndarray, unit: int, donors: pa.Table, k: int, chunk: int, held: list | None, limits: np.ndarray | None) -> list[np.ndarray]:
        """(row, f, d2, v, mult), in order, of the best donors held or in the slab ``unit``."""
        x, block = self.vectors(donors), _block_search(self.n, k)
        mult, codes, mine = donors.column("mult").to_numpy(), self.codes(x), self.codes(q)
        found = [[np.empty(0, t) for t in (np.int64, np.int32, float, float, np.int64)]]
        for a in np.unique(mine).tolist():
            known = (a >> np.arange(self.n) & 1).astype(bool)
            near = [h for h in np.unique(codes).tolist() if self.lead.get((a, h)) == unit >> 24]
            sides = _sides([((h >> np.arange(self.n) & 1).astype(bool), x[codes == h], mult[codes == h]) for h in near], known, chunk, k)
            rows = np.flatnonzero(mine == a)
            if not sides:
                if held is not None:
                    sizes = held[0][rows + 1] - held[0][rows]
                    at = np.repeat(held[0][rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    found.append([np.repeat(rows, sizes), *(h[at] for h in held[1:])])
                continue
            for tile in _tiles(q[rows][:, known], BLOCK_QUERIES):
                some, before = rows[tile], None
                if held is not None:
                    sizes = held[0][some + 1] - held[0][some]
                    at = np.repeat(held[0][some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    before = (np.repeat(np.arange(len(some)), sizes), *(h[at] for h in held[1:]))
                best = block(q[some], known, sides, before, None if limits is None else limits[some])
                found += [[some[row], np.full(len(row), f, np.int32), *rest] for f, (row, *rest) in best.items()]
        out = [np.concatenate(p) for p in zip(*found)]
        order = np.lexsort((out[1], out[0]))  # stable: by distance and value within
        return [p[order] for p in out]

    def home(self, k: int, chunk: int, choices: list[tuple[int, str]] | None) -> Callable:
        """Queries of a slab with their best donors so far; with ``choices``, as the last step, with their fills
        and the slabs that reach into the distance of the k-th neighbour (and no donors where there are none)."""
        def search(queries: pa.Table, donors: pa.Table) -> pa.Table:
            q, names = self.vectors(queries), ["qid", *(f"c{i}" for i in range(self.n)), *self.STATE]
            unit = queries.column("unit")[0].as_py() if len(q) else -1
            held = _flat(queries, self.STATE)
            if unit < 0:
                found = [np.repeat(np.arange(len(q)), np.diff(held[0])), *held[1:]]
            else:
                found = self.searched(q, unit, donors, k, chunk, held, None)
            arrays = [queries.column("qid").combine_chunks(), *(pa.array(v, from_pandas=True) for v in q.T)]
            if choices is None:
                return pa.Table.from_arrays([*arrays, *_lists(found[0], len(q), found[1:])], names=names)
            best = {f: tuple(p[found[1] == f] for p in (found[0], *found[2:])) for f in range(self.n)}
            bound = np.full((len(q), self.n), np.inf)
            for f, (row, dist, *_) in best.items():
                counts = np.bincount(row, minlength=len(q))
                full = counts >= k
                bound[full, f] = dist[(np.cumsum(counts) - 1)[full]]
            row, visits = self.reached(q, bound)
            open_ = np.zeros(len(q), bool)
            open_[row] = True
            kept = open_[found[0]]
            lists = [*_lists(found[0][kept], len(q), [p[kept] for p in found[1:]]), *_lists(row, len(q), [visits])]
            limits = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * self.n), pa.array(bound.ravel()))
            fills = _fill_arrays(q, best, choices)[self.n:]
            return pa.Table.from_arrays([*arrays, *lists, limits, *fills], names=[*names, "visits", "limits", *(f"fill_{i}" for i in range(self.n))])

        return search

    def reached(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, slab) of the slabs within the bounds, besides those the query lies in; in the order of rows."""
        rows, units, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], self.codes(q)
        for a in np.unique(codes).tolist():
            at = np.flatnonzero(codes == a)
            for c in self.spaces.get(a, []):
                some = [f for f in range(self.n) if self.wanted[a, c] >> f & 1]
                reach = np.sqrt(bound[np.ix_(at, some)].max(axis=1) * bin(a).count("1") / self.n)
                reach = reach * SLACK * SLACK + 1e-15 * np.abs(q[at, c]) + 1e-150
                lo, hi = np.searchsorted(self.cuts[c], q[at, c] - reach, "right"), np.searchsorted(self.cuts[c], q[at, c] + reach, "right")
                sizes = hi - lo + 1
                slab = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)
                row = np.repeat(at, sizes)
                unit = (c << 24) + slab
                away = unit != np.repeat(self.unit(c, q[at, c]), sizes)
                rows.append(row[away])
                units.append(unit[away])
        row, unit = np.concatenate(rows), np.concatenate(units)
        order = np.argsort(row, kind="stable")
        return row[order], unit[order]

    def visit(self, k: int, chunk: int) -> Callable:
        """The donors of a slab that reach into the limits of the queries sent to it."""
        def search(queries: pa.Table, donors: pa.Table) -> pa.Table:
            names = ["qid", *self.STATE]
            if not len(queries) or not len(donors):
                empty = _lists(np.empty(0, np.int64), 0, [np.empty(0, t) for t in (np.int32, float, float, np.int64)])
                return pa.Table.from_arrays([pa.array([], pa.int64()), *empty], names=names)
            limits = queries.column("limits").combine_chunks().flatten().to_numpy().reshape(-1, self.n)
            found = self.searched(self.vectors(queries), queries.column("unit")[0].as_py(), donors, k, chunk, None, limits)
            return pa.Table.from_arrays([queries.column("qid").combine_chunks(), *_lists(found[0], len(queries), found[1:])], names=names)

        return search

    def merge(self, k: int, choices: list[tuple[int, str]], columns: list[str]) -> Callable:
        """The fills of queries whose donors came from several slabs; a task holds all rows of a query."""
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not (batches := list(batches)):
                return
            table = pa.Table.from_batches(batches)
            own = table.column("own").to_numpy()
            q, ids = self.vectors(table.filter(table.column("own"))), table.column("qid").to_numpy()
            number = np.argsort(ids[own], kind="stable")
            offsets, f, dist, value, mult = _flat(table, self.STATE)
            row = np.repeat(number[np.searchsorted(ids[own], ids, sorter=number)], np.diff(offsets))
            order = np.lexsort((value, dist, f, row))
            order = order[_first_of_runs((row * self.n + f)[order], k)]
            row, f, dist, value, mult = (p[order] for p in (row, f, dist, value, mult))
            best = {i: (row[f == i], dist[f == i], value[f == i], mult[f == i]) for i in range(self.n)}
            yield pa.RecordBatch.from_arrays(_fill_arrays(q, best, choices), names=_fill_names(columns))

        return merged


def _by_slabs(q: DataFrame, x: DataFrame, queries: int, rows: int, columns: list[str], k: int, chunk: int, choices: list[tuple[int, str]]) -> DataFrame | None:
    """Vectors and fills where donors exceed one broadcast: donors and queries meet in slabs of one column each.

    A query is compared in its own slab of each column it needs, and then in those that reach into the distance
    of its k-th neighbour. None where a slab would be too large, or too many slabs reach into a query.
    """
    n, spark = len(columns), q.sparkSession
    pattern = reduce(Column.__add__, [F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(columns)])
    have, asked = ([r[0] for r in t.select(pattern).distinct().collect()] for t in (x, q))  # at most 2 ** SLAB_COLUMNS
    share = min(1.0, SLAB_SAMPLE / rows)
    some = (x.sample(share, 7) if share < 1 else x).select(*columns).toArrow()  # decides on the cuts only
    cuts = []
    for c in columns:
        values = np.sort(some.column(c).drop_null().to_numpy())
        number = int(len(values) / share / SLAB_ROWS) + 1
        cut = np.unique(values[np.arange(1, number) * len(values) // number]) if len(values) else values
        most = np.bincount(np.searchsorted(cut, values, "right")).max() / share if len(values) else 0
        if most * (n + 1) * 8 > DIRECT_BYTES:
            return None
        cuts.append(cut)
    slabs = _Slabs(cuts, asked, have)
    steps = max((len(s) for s in slabs.spaces.values()), default=0)
    if not steps:
        return None
    vector = [f"c{i}" for i in range(n)]
    kinds, state = ", ".join(f"{c} double" for c in vector), slabs.STATE_SCHEMA
    tasks = max(spark.sparkContext.defaultParallelism, n * rows // SLAB_TASK_ROWS)
    donors = x.select(*columns, "mult").mapInArrow(slabs.spread, f"unit bigint, {kinds}, mult bigint").repartition(tasks, "unit").groupBy("unit")
    empty = {"f": "int", "d2": "double", "v": "double", "mult": "bigint"}
    found = q.select("qid", *[F.col(c).alias(v) for c, v in zip(columns, vector)], *[F.array().cast(f"array<{t}>").alias(c) for c, t in empty.items()])
    for j in range(steps):
        keyed = found.mapInArrow(slabs.step(j), f"unit bigint, qid bigint, {kinds}, {state}").repartition(tasks, "unit")
        last = choices if j == steps - 1 else None
        out = f"qid bigint, {kinds}, {state}" + (", visits array<bigint>, limits array<double>, " + ", ".join(f"fill_{i} array<double>" for i in range(n)) if last else "")
        found = keyed.groupBy("unit").cogroup(donors).applyInArrow(slabs.home(k, chunk, last), out)
    found = materialize(found, "knn-found")
    named = [F.col(v).alias(c) for c, v in zip(columns, vector)]
    done = found.filter("size(visits) = 0").select(*named, *[f"fill_{i}" for i in range(n)])
    visits = found.agg(F.sum(F.size("visits")), F.count(F.when(F.size("visits") > 0, 1))).first()
    if not visits[0]:
        return done
    if visits[0] > SLAB_VISITS * queries:
        return None
    away = found.select("qid", *vector, "limits", F.explode("visits").alias("unit")).repartition(tasks, "unit")
    away = away.groupBy("unit").cogroup(donors).applyInArrow(slabs.visit(k, chunk), f"qid bigint, {state}")
    own = found.filter("size(visits) > 0").select(F.lit(True).alias("own"), "qid", *vector, *slabs.STATE)
    away = away.select(F.lit(False).alias("own"), "qid", *[F.lit(None).cast("double").alias(v) for v in vector], *slabs.STATE)
    together = own.unionByName(away).repartition(max(spark.sparkContext.defaultParallelism, visits[1] // SLAB_TASK_ROWS), "qid")
    return done.unionByName(together.mapInArrow(slabs.merge(k, choices, columns), _fill_schema(columns)))


def _found(
    q: DataFrame, x: DataFrame, columns: list[str], k: int, chunk: int, direct: bool | None, choices: list[tuple[int, str]] | None = None
) -> DataFrame:
    """(qid, f, d2, v, mult): candidates that hold the k nearest donors of every missing value. With ``choices``,
    the vectors and their fills instead, where a query's neighbours meet in one task."""
    n = len(columns)
    queries, rows = q.count(), x.count()
    parts = -(-rows * (n + 1) * 8 // DIRECT_BYTES)
    if direct and parts > DIRECT_PARTS:
        raise ValueError(f"the direct way takes donors of at most {DIRECT_PARTS * DIRECT_BYTES} bytes")
    if direct is None and choices is not None and queries and parts > 1 and n <= SLAB_COLUMNS:
        folded = _by_slabs(q, x, queries, rows, columns, k, chunk, choices)
        if folded is not None:
            return folded
    if direct is None:
        direct = parts <= DIRECT_PARTS and (n <= FEW_COLUMNS or queries * rows * n <= DIRECT_CELLS)
    if not direct or not rows:
        q, x, d_leaves, routed = _prepared(q, x, columns, k, chunk)
        return _compared(routed, x, d_leaves, columns, k, chunk)
    spark = q.sparkSession
    work = queries // TASK_QUERIES + (0 if n <= FEW_COLUMNS else queries * rows * n // TASK_CELLS)
    tasks = int(min(max(spark.sparkContext.defaultParallelism, work), max(queries, 1)))
    if n <= FEW_COLUMNS:  # neighbouring queries of one pattern in a task
        spread = q.repartitionByRange(tasks, *[F.col(c).isNull() for c in columns], *columns, "qid")
    else:
        spread = q.repartition(tasks, "qid")
    if parts > 1:
        x = materialize(x.withColumn("__part", F.pmod(F.xxhash64(*columns), F.lit(parts))), "knn-parts", ["__part"])
    if parts == 1 and choices is not None:
        donors = spark.sparkContext.broadcast(_by_pattern(x, columns))
        return spread.select("qid", *columns).mapInArrow(_nearest_of_all(columns, k, donors, chunk, choices), _fill_schema(columns))
    found = []
    for p in range(parts):  # the donors of one broadcast at a time
        some = x.filter(F.col("__part") == p).drop("__part") if parts > 1 else x
        donors = spark.sparkContext.broadcast(_by_pattern(some, columns))
        near = spread.select("qid", *columns).mapInArrow(_nearest_of_all(columns, k, donors, chunk), "qid bigint, f int, d2 double, v double, mult bigint")
        found.append(materialize(near, "knn-found") if parts > 1 else near)
        if parts > 1:
            donors.destroy()
    return reduce(DataFrame.unionByName, found)


def nearest_fills(
    df: DataFrame, columns: list[str], donors: DataFrame, choices: list[tuple[int, str]], chunk: int, direct: bool | None = None
) -> DataFrame:
    """Distinct incomplete vectors with one ``fill_{i}`` per column: an array with the fill of each (k, weights)
    of ``choices``. Neighbours are found once, for the greatest k."""
    q, x = _vectors(df, columns, donors)
    found = _found(q, x, columns, max(k for k, _ in choices), chunk, direct, choices)
    if "fill_0" in found.columns:
        return found.select(_vector_key(columns).alias("__key"), *[f"fill_{i}" for i in range(len(columns))])
    merged = found.groupBy("qid", "f").agg(F.sort_array(F.collect_list(F.struct("d2", "v", "mult"))).alias("near"))
    merged = merged.select("qid", "f", F.array(*[F.expr(_fold(k, weights)) for k, weights in choices]).alias("fill"))
    fills = merged.groupBy("qid").agg(
        *[F.max(F.when(F.col("f") == i, F.col("fill"))).alias(f"fill_{i}") for i in range(len(columns))]
    )
    return q.select("qid", _vector_key(columns).alias("__key")).join(fills, "qid").drop("qid")


def _fold(k: int, weights: str) -> str:
    """The mean of the k first of ``near``, sorted by distance."""
    near, weight = "near", "1D"
    if weights != "uniform":
        weight = "CASE WHEN x.d2 = 0 THEN 1D ELSE 1 / sqrt(x.d2) END"
    if weights == "distance":  # an exact match outweighs all others
        near = "CASE WHEN near[0].d2 = 0 THEN filter(near, x -> x.d2 = 0) ELSE near END"
    return (
        f"aggregate({near}, named_struct('left', {k}L, 's', 0D, 'w', 0D), (a, x) -> named_struct("
        f"'left', a.left - least(a.left, x.mult), 's', a.s + least(a.left, x.mult) * x.v * {weight}, "
        f"'w', a.w + least(a.left, x.mult) * {weight}), a -> a.s / a.w)"
    )


def _vector_key(columns: list[str]) -> Column:
    """The whole vector as one exact join key."""
    # grouping takes -0.0 for 0.0, so the key has to
    return F.concat_ws(",", *[F.coalesce((F.col(c).cast("double") + 0.0).cast("string"), F.lit("x")) for c in columns])


def knn_impute(
    df: DataFrame,
    columns: list[str],
    id_col: str,
    donors: DataFrame,
    k: int = 5,
    weights: str = "uniform",
    chunk: int = CHUNK,
    direct: bool | None = None,
    rest: dict[str, float | None] | None = None,
) -> DataFrame:
    """Fill each missing value by the mean of its k nearest donors that have it.

    Ties in distance go to the smaller value. Without any comparable donor the value in ``rest`` is used, the
    mean of the donors if it is not given.
    Use k = 1 on category codes. ``direct`` compares all vectors (True), searches cells (False), or
    does what the bounds of the module say (None).
    """
    return knn_impute_all(df, columns, donors, [(k, weights)], None, chunk, direct, rest)


def knn_impute_all(
    df: DataFrame,
    columns: list[str],
    donors: DataFrame,
    choices: list[tuple[int, str]],
    name: str | None,
    chunk: int = CHUNK,
    direct: bool | None = None,
    rest: dict[str, float | None] | None = None,
) -> DataFrame:
    """``knn_impute`` by each (k, weights) of ``choices``, from one search: the rows once per choice, its number as
    ``name``. Without a name the first choice alone."""
    fills = nearest_fills(df, columns, donors, choices, chunk, direct)
    row = rest if rest is not None else donors.agg(*[F.avg(c).alias(c) for c in columns]).first()
    gaps = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    # rows without gaps have no partner: their keys, which no vector has, only spread them over tasks
    plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    apart = F.concat(F.lit("-"), F.xxhash64(*dict.fromkeys([*plain[:3], *columns])).cast("string"))
    joined = df.withColumn("__key", F.when(gaps, _vector_key(columns)).otherwise(apart)).join(fills, "__key", "left")
    if name is not None:
        joined = joined.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1))))
    at = F.lit(0) if name is None else F.col(name)
    # Where no vector has a neighbour to offer, the value in rest is left.
    out = {
        c: F.coalesce(F.col(c).cast("double"), F.get(F.col(f"fill_{i}"), at), F.lit(row[c]).cast("double"))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(out).select(*df.columns, *([name] if name is not None else []))
