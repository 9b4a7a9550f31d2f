"""The whole way from a table with gaps to scaled and mapped data and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators.prepare import Prepared, Step, prepare
from lacuna.operators.transforms import FixedBins, MinMaxScaler
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.q_ampute import _amputed_sql
from lacuna.plans.registry import query

_CTN = T.CONTINUOUS
_KINDS = [c for c in S.FEATS if c not in _CTN]
_GONE = ["totalprice", *T.ONEHOT_COLUMNS["priority"]]
_BINS = {"day": [(0.0, 0.25), (0.25, 0.5), (0.5, 1.0)]}


def _prepared(spark, d, separate: bool) -> Prepared:
    """Complete rows lose prices and a one-hot group at random; rows with gaps are the test set."""
    pattern = {
        "incomplete_vars": ["totalprice", "priority_1"], "mechanism": "MAR", "weights": {"acctbal": 1.0, "day": 1.0}
    }
    inner = F.when(F.col("split") == "test", "val").otherwise(F.col("split"))
    return prepare(
        T.mixed_onehot(spark, d), T.MIXED_SCHEMA, "id", lambda df: df.withColumn("split", inner),
        [Step(lambda rows: MinMaxScaler.fit(rows, _CTN)), Step(lambda rows: FixedBins(_BINS), maps=True)],
        [pattern], only_observed=True, rest_as_test=True, separate_truth=separate,
    )


def _role_sql(role: str, bounds_of: str) -> str:
    lo = {c: f"(SELECT min({c}) FROM rows_{bounds_of} WHERE split = 'train')" for c in _CTN}
    hi = {c: f"(SELECT max({c}) FROM rows_{bounds_of} WHERE split = 'train')" for c in _CTN}
    scaled = ", ".join(f"({c} - {lo[c]}) / ({hi[c]} - {lo[c]}) AS {c}" for c in _CTN)
    return f"SELECT id, split, '{role}' AS role, {scaled}, {', '.join(_KINDS)} FROM rows_{role}"


def _both_sql(separate: bool) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in S.FEATS)
    kept = ", ".join(f"CASE WHEN NOT gone THEN {c} END AS {c}" if c in _GONE else c for c in S.FEATS)
    part = "CASE split WHEN 'test' THEN 'val' ELSE split END AS split"
    rest = f"UNION ALL SELECT id, 'test' AS split, {', '.join(S.FEATS)} FROM oh WHERE NOT ({complete})"
    amputed = _amputed_sql("observed", [{"score": {"acctbal": 1, "day": 1}, "shape": "sigmoid-right"}], 0.33)
    return (
        f"WITH RECURSIVE {S.BOTH_OH}, observed AS (SELECT * FROM oh WHERE {complete}), {amputed}, "
        f"rows_data AS (SELECT id, {part}, {kept} FROM gone {rest}), "
        f"rows_ground_truth AS (SELECT id, {part}, {', '.join(S.FEATS)} FROM gone {rest}), "
        f"both_roles AS ({_role_sql('data', 'data')} UNION ALL {_role_sql('ground_truth', 'ground_truth' if separate else 'data')})"
    )


@query(
    f"{_both_sql(True)} SELECT id, split, role, " + ", ".join(f"round({c}, 7) AS {c}" for c in _CTN)
    + f", {', '.join(_KINDS)} FROM both_roles"
)
def prepare_amputed(spark, d):
    """Features as they were, scaled; the truth by its own bounds."""
    made = _prepared(spark, d, separate=True)
    cells = [*[F.round(c, 7).alias(c) for c in _CTN], *_KINDS]
    views = [made.view("original", r).select("id", "split", F.lit(r).alias("role"), *cells) for r in made.fitted]
    return views[0].unionByName(views[1])


def _binned(k: int) -> str:
    lo, hi = _BINS["day"][k]
    low = f"round(day, 7) > {lo}" if k else "TRUE"
    high = f"round(day, 7) <= {hi}" if k < len(_BINS["day"]) - 1 else "TRUE"
    return f"count(*) FILTER (WHERE day IS NOT NULL AND {low} AND {high}) AS bin_{k}"


@query(
    f"{_both_sql(False)} SELECT split, role, count(*) AS n, {', '.join(_binned(k) for k in range(3))}, "
    "count(*) FILTER (WHERE day IS NULL) AS no_day, count(totalprice) AS prices, round(sum(totalprice), 4) AS total "
    "FROM both_roles GROUP BY 1, 2"
)
def prepare_mapped(spark, d):
    """Days as bins, data and truth by the bounds of the data."""
    made = _prepared(spark, d, separate=False)
    names = FixedBins(_BINS).names()["day"]
    views = [made.view("mapped", r).withColumn("role", F.lit(r)) for r in made.fitted]
    bins = [F.sum(F.coalesce(F.col(f"`{b}`"), F.lit(0))).cast("bigint").alias(f"bin_{k}") for k, b in enumerate(names)]
    return views[0].unionByName(views[1]).groupBy("split", "role").agg(
        F.count(F.lit(1)).alias("n"), *bins, F.count_if(F.col(f"`{names[0]}`").isNull()).alias("no_day"),
        F.count("totalprice").alias("prices"), F.round(F.sum("totalprice"), 4).alias("total"),
    )
