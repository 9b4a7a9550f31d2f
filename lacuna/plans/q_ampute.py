"""Controlled removal of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import ampute as A
from lacuna.plans import sql as S
from lacuna.plans import tables as T
from lacuna.plans.registry import query

_CTN = T.CONTINUOUS
_DROP = ["totalprice"]
_OUT = ["totalprice", "acctbal", "day", "recent"]


def _truth(spark, d):
    return T.mixed_truth(spark, d).select("id", *_OUT)


def _run(spark, d, pattern, prop=0.33):
    return A.ampute(_truth(spark, d), prop, [pattern], "id", _OUT, seed=0)


def _normal(stream: int) -> str:
    u, v = (f"(({S.h(S.key('id', s))}::DOUBLE + 0.5) / 4294967296)" for s in (stream, stream + 1))
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


def _yule_simon(stream: int) -> str:
    u, v = (f"(({S.h(S.key('id', s))}::DOUBLE + 0.5) / 4294967296)" for s in (stream, stream + 1))
    return f"greatest(ceil(ln({v}) / ln(1 - least(exp(ln({u}) / 1.5), 1 - 1e-12))), 1)::DOUBLE"


_SHAPES = {"sigmoid-right": "{z}", "sigmoid-left": "-{z}", "sigmoid-mid": "0.75 - abs({z})", "sigmoid-tail": "abs({z}) - 0.75"}


def _amputed_sql(source: str, patterns: list[dict], prop: float, seed: int = 0, tag: str = "") -> str:
    """CTEs up to ``gone{tag}``: the rows of ``source`` with the pattern ``p`` they fall to and ``gone``.

    A pattern is given by what decides in the end: ``score`` (column or expression to weight; none
    for MCAR), ``shape`` and ``upto`` (cumulated frequency). The shift is found by bisection in SQL.
    """
    scored = {i: p for i, p in enumerate(patterns) if p.get("score")}
    which = " ".join(f"WHEN {S.u(S.key('id', seed + 1000))} < {p['upto']} THEN {i}" for i, p in enumerate(patterns[:-1]))
    which = f"CASE {which} ELSE {len(patterns) - 1} END" if which else "0"
    values = [(e, f"e{i}_{j}", w, i) for i, p in scored.items() for j, (e, w) in enumerate(p["score"].items())]
    extra = "".join(f", {e} AS {n}" for e, n, _, _ in values)
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for _, n, _, _ in values) or "count(*) AS one"
    raw = " ".join(
        f"WHEN {i} THEN " + " + ".join(f"coalesce(({n} - m_{n}) / s_{n}, 0) * {w}" for _, n, w, k in values if k == i)
        for i in scored
    )
    raw = f"CASE p {raw} END" if raw else "NULL::DOUBLE"
    z = " ".join(f"WHEN {i} THEN " + _SHAPES[p["shape"]].format(z="((raw - mu) / sd)") for i, p in scored.items())
    z = f"CASE p {z} END" if z else "NULL::DOUBLE"
    mean = "list_sum(list_transform(xs, lambda e: e.n / (1 + exp(-(e.x + (lo + hi) / 2))))) / total"
    return f"""base{tag} AS (SELECT *, {which} AS p, {S.u(S.key('id', seed + 2000))} AS draw{extra} FROM {source}),
  mom{tag} AS (SELECT {moments} FROM base{tag}),
  raw{tag} AS (SELECT base{tag}.*, {raw} AS raw FROM base{tag}, mom{tag}),
  spr{tag} AS (SELECT p, avg(raw) AS mu, stddev_pop(raw) AS sd FROM raw{tag} GROUP BY p),
  z{tag} AS (SELECT raw{tag}.*, {z} AS z FROM raw{tag} JOIN spr{tag} USING (p)),
  hist{tag} AS (SELECT p, list({{'x': (b + 0.5) * 0.01::DOUBLE, 'n': n}}) AS xs, sum(n)::DOUBLE AS total FROM (
    SELECT p, floor(greatest(least(z, 10), -10) / 0.01::DOUBLE) AS b, count(*) AS n FROM z{tag} WHERE z IS NOT NULL GROUP BY 1, 2) GROUP BY p),
  bis{tag} AS (SELECT p, 0 AS step, -50::DOUBLE AS lo, 50::DOUBLE AS hi, xs, total FROM hist{tag} UNION ALL
    SELECT p, step + 1, CASE WHEN mean < {prop} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN mean < {prop} THEN hi ELSE (lo + hi) / 2 END,
      xs, total FROM (SELECT *, {mean} AS mean FROM bis{tag}) WHERE step < 60),
  gone{tag} AS (SELECT z{tag}.*, draw < coalesce(1 / (1 + exp(-(z + (lo + hi) / 2))), {prop}) AS gone
    FROM z{tag} LEFT JOIN bis{tag} ON z{tag}.p = bis{tag}.p AND step = 60)"""


def _one_sql(score: dict, shape: str, prop: float = 0.33) -> str:
    ctes = _amputed_sql("mixed_truth", [{"score": score, "shape": shape}], prop)
    return f"WITH RECURSIVE {S.TRUTH}, {ctes} SELECT id, CASE WHEN NOT gone THEN totalprice END AS totalprice, acctbal, day, recent FROM gone"


@query(
    f"""WITH {S.TRUTH} SELECT id, CASE WHEN {S.u(S.key('id', 2000))} >= 0.33 THEN totalprice END AS totalprice,
    CASE WHEN {S.u(S.key('id', 2000))} >= 0.33 THEN acctbal END AS acctbal, day, recent FROM mixed_truth"""
)
def ampute_mcar(spark, d):
    return _run(spark, d, {"incomplete_vars": ["totalprice", "acctbal"], "mechanism": "MCAR"})


@query(_one_sql({"acctbal": 1, "day": 1}, "sigmoid-mid"))
def ampute_mar(spark, d):
    return _run(
        spark, d,
        {"incomplete_vars": _DROP, "mechanism": "MAR", "weights": {"acctbal": 1.0, "day": 1.0},
         "score_to_probability_func": "sigmoid-mid"},
    )


@query(_one_sql({"acctbal": 1, "day": 1, "recent": 1}, "sigmoid-left"))
def ampute_mar_left(spark, d):
    """Without weights, all observed features decide."""
    return _run(spark, d, {"incomplete_vars": _DROP, "mechanism": "MAR", "score_to_probability_func": "sigmoid-left"})


@query(_one_sql({"totalprice": 1}, "sigmoid-tail"))
def ampute_mnar(spark, d):
    return _run(spark, d, {"incomplete_vars": _DROP, "mechanism": "MNAR", "score_to_probability_func": "sigmoid-tail"})


@query(_one_sql({_normal(3000): 1, _yule_simon(3002): 1}, "sigmoid-mid"))
def ampute_latent(spark, d):
    return _run(spark, d, {"incomplete_vars": _DROP, "mechanism": "MNAR(G, Y)", "score_to_probability_func": "sigmoid-mid"})


_TWO = _amputed_sql("mixed_truth", [{"score": {"totalprice": 1}, "shape": "sigmoid-right", "upto": "(1 / 3.0::DOUBLE)"}, {}], 0.5, 1)


@query(
    f"""WITH RECURSIVE {S.TRUTH}, {_TWO} SELECT id, CASE WHEN NOT (gone AND p = 0) THEN totalprice END AS totalprice,
    CASE WHEN NOT (gone AND p = 1) THEN acctbal END AS acctbal, day, CASE WHEN NOT (gone AND p = 1) THEN recent END AS recent FROM gone"""
)
def ampute_patterns(spark, d):
    """Two patterns, each row in exactly one of them."""
    patterns = [
        {"incomplete_vars": ["totalprice"], "mechanism": "MNAR"},
        {"incomplete_vars": ["acctbal", "recent"], "mechanism": "MCAR", "freq": 2},
    ]
    return A.ampute(_truth(spark, d), 0.5, patterns, "id", _OUT, seed=1)


_GRID_SQL = " UNION ALL ".join(
    f"SELECT {k} AS scenario, count(*) AS n, sum(CASE WHEN {S.u(S.key('id', 2000 + 10000 * k))} >= 0.33 "
    f"THEN 0 ELSE 1 END)::BIGINT AS removed FROM mixed_truth"
    for k in (0, 1)
)


@query(f"WITH {S.TRUTH} {_GRID_SQL}")
def ampute_grid_mcar(spark, d):
    """Rows and removed cells of the two MCAR scenarios of the grid."""
    grid = [p for p in A.scenario_grid(_DROP, ["acctbal", "day"]) if p["mechanism"] == "MCAR"]
    out = A.ampute_scenarios(_truth(spark, d), 0.33, grid, "id", _OUT)
    return out.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("totalprice").isNull().cast("bigint")).alias("removed")
    )


_PRIORITY = T.ONEHOT_COLUMNS["priority"]


def _grid_sql() -> str:
    decides = {
        "MCAR": lambda s: {}, "MAR": lambda s: {"acctbal": 1, "day": 1}, "MNAR(G)": lambda s: {_normal(s): 1},
        "MNAR(Y)": lambda s: {_yule_simon(s): 1}, "MNAR": lambda s: {c: 1 for c in ["totalprice", *_PRIORITY]},
    }
    ctes, selects = [], []
    for k, (shape, mechanism) in enumerate((s, m) for s in ("sigmoid-mid", "sigmoid-tail") for m in decides):
        score = decides[mechanism](3000 + 10000 * k)
        ctes.append(_amputed_sql("truth_oh", [{"score": score, "shape": shape}], 0.33, 10000 * k, f"_{k}"))
        selects.append(
            f"SELECT {k} AS scenario, count(*) AS n, count(*) FILTER (WHERE gone) AS prices_gone, "
            f"count(*) FILTER (WHERE gone) AS priorities_gone, 0::BIGINT AS broken_groups, "
            f"round(sum(CASE WHEN NOT gone THEN totalprice END), 2) AS kept_price FROM gone_{k}"
        )
    return f"WITH RECURSIVE {S.TRUTH}, {S.TRUTH_OH}, {', '.join(ctes)} {' UNION ALL '.join(selects)}"


@query(_grid_sql())
def ampute_grid(spark, d):
    """The whole grid over all columns: a price and a one-hot group go together."""
    grid = A.scenario_grid(["totalprice", "priority"], ["acctbal", "day"])
    truth = T.truth_onehot(spark, d).drop("split", "label")
    out = A.ampute_scenarios(truth, 0.33, grid, "id", T.MIXED_SCHEMA.features, groups=T.ONEHOT_COLUMNS)
    gone = sum((F.col(c).isNull().cast("int") for c in _PRIORITY), F.lit(0))
    return out.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("totalprice").isNull()).alias("prices_gone"),
        F.count_if(gone == len(_PRIORITY)).alias("priorities_gone"),
        F.count_if((gone > 0) & (gone < len(_PRIORITY))).alias("broken_groups"),
        F.round(F.sum("totalprice"), 2).alias("kept_price"),
    )
