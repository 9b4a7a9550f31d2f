"""Building blocks of the oracle SQL: the same tables as ``tables.py``, as common table expressions."""

from __future__ import annotations

from lacuna.functions.hashing import salt
from lacuna.plans.tables import (
    CONTINUOUS,
    EVENT_TYPES,
    FEATURE_MAPS,
    MECHANISMS,
    METHODS,
    MIXED_SCHEMA,
    NULL_COLUMNS,
    ONEHOT_COLUMNS,
    PRIORITIES,
    SEGMENTS,
)

FEATS = MIXED_SCHEMA.features


def h(key: str) -> str:
    m = f"(({key}) % 4294967296)"
    for _ in range(2):
        m = f"((xor({m}, {m} >> 16) * 73244475) % 4294967296)"
    return f"xor({m}, {m} >> 16)"


def u(key: str) -> str:
    return f"({h(key)} / 4294967296.0)"


def key(column: str, stream: int) -> str:
    """Row key of one stream of draws."""
    return f"xor({column}, {salt(stream)})"


def drawn_rows(source: str) -> str:
    """``source`` (salt, i, n) with the row number ``j`` in [0, n) that draw ``i`` takes: 53 bits of it."""
    hi = f"SELECT *, {h('xor(salt, i >> 32)')} AS hi FROM {source}"
    a = f"SELECT *, {h('xor(hi, i % 4294967296)')} AS a FROM ({hi})"
    b = f"SELECT *, {h(f'xor(a, {salt(53)})')} AS b FROM ({a})"
    return f"(SELECT *, least(floor(((a >> 5) * 67108864 + (b >> 6)) / 9007199254740992::DOUBLE * n), n - 1)::BIGINT AS j FROM ({b}))"


def _nulls(c: str, i: int) -> str:
    return f"CASE WHEN {u(key('id', 100 + i))} >= 0.2 THEN {c} END AS {c}"


def _onehots(keep_null: bool = True) -> str:
    out = []
    for p, values in (("priority", PRIORITIES), ("segment", SEGMENTS)):
        for v in values:
            test = f"CASE WHEN {p} = '{v}' THEN 1 ELSE 0 END"
            out.append(
                f"CASE WHEN {p} IS NOT NULL THEN {test} END AS {p}_{v}"
                if keep_null
                else f"{test} AS {p}_{v}"
            )
    return ", ".join(out)


ONEHOT_PLAIN = _onehots(False)

TRUTH = f"""mixed_truth AS (
  SELECT o_orderkey AS id, o_totalprice AS totalprice, c_acctbal AS acctbal,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day,
    CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END AS recent,
    substr(o_orderpriority, 1, 1) AS priority, c_mktsegment AS segment,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    CASE WHEN {u(key('o_orderkey', 7))} < 0.30 THEN 'train'
         WHEN {u(key('o_orderkey', 7))} < 0.60 THEN 'val' ELSE 'test' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

MIXED = f"""{TRUTH}, mixed AS (
  SELECT id, {', '.join(_nulls(c, i) for i, c in enumerate(NULL_COLUMNS, start=1))}, label, split
  FROM mixed_truth)"""

KEYS = "id, split, label"
TRUTH_OH = f"truth_oh AS (SELECT {KEYS}, totalprice, acctbal, day, recent, {_onehots()} FROM mixed_truth)"
MIXED_OH = f"oh AS (SELECT {KEYS}, totalprice, acctbal, day, recent, {_onehots()} FROM mixed)"
BOTH_OH = f"{MIXED}, {TRUTH_OH}, {MIXED_OH}"

PANEL = f"""panel AS (
  SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
    {', '.join(f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}" for e in EVENT_TYPES)}
  FROM events GROUP BY 1, 2)"""


def _pick(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} AS INTEGER) + 1)"


RUNS = f"""runs AS (
  SELECT s_suppkey AS run_id,
    CASE WHEN s_suppkey % 10 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
    {_pick(METHODS, 's_suppkey % 4')} AS method,
    {_pick(FEATURE_MAPS, '(s_suppkey // 4) % 3')} AS feature_map,
    {_pick(MECHANISMS, 's_nationkey % 5')} AS mechanism,
    CASE WHEN s_nationkey % 2 = 0 THEN 'sigmoid-mid' ELSE 'sigmoid-tail' END AS score_fn,
    CASE WHEN s_suppkey % 2 = 0 THEN 0.33::DOUBLE ELSE 0.66::DOUBLE END AS percent_missing,
    CASE WHEN s_suppkey % 3 = 0 THEN 'True' ELSE 'False' END AS bootstrap,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INTEGER)) AS start_time,
    '[{{''incomplete_vars'': [''totalprice'', ''day''], ''mechanism'': ''' ||
      {_pick(MECHANISMS, 's_nationkey % 5')} || ''', ''weights'': {{''acctbal'': 1' ||
      CASE WHEN s_nationkey % 2 = 0 THEN ', ''recent'': 0.5' ELSE '' END || '}}}}]' AS pattern
  FROM supplier)"""

_R = "FILTER (WHERE l_returnflag = 'R')"
_SCALARS = {
    "original/all/CW/mixed/RMSE": "round(avg(l_discount), 6)",
    "original/all/EW/mixed/RMSE": "round(avg(l_tax), 6)",
    "original/missingonly/CW/mixed/RMSE": f"round(avg(l_discount) {_R}, 6)",
    "original/missingonly/EW/mixed/RMSE": f"round(avg(l_tax) {_R}, 6)",
    "original/all/CW/mixed/MAAPE": "round(avg(l_discount) * 2, 6)",
    "original/all/CW/continuous/RMSE": "round(avg(l_quantity / 50), 6)",
    "mapped/all/CW/categorical/MAAPE": f"round(avg(l_quantity / 50) {_R}, 6)",
    "mapped/all/CW/mixed/MAAPE": "round(min(l_tax), 6)",
    "epoch_duration_sec": "round(max(l_extendedprice) / 1000, 6)",
    "system/cpu_utilization": "round(avg(l_extendedprice) / 100000, 6)",
}
SCALARS = (
    "wide AS (SELECT l_suppkey AS run_id, l_linenumber AS step, "
    "CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS part, "
    + ", ".join(f"{e} AS v{i}" for i, e in enumerate(_SCALARS.values()))
    + " FROM lineitem GROUP BY 1, 2, 3), scalars AS ("
    + " UNION ALL ".join(
        "SELECT run_id, step, "
        + (f"'{n}'" if n.startswith("system/") else f"part || '/{n}'")
        + f" AS tag, v{i} AS val FROM wide"
        for i, n in enumerate(_SCALARS)
    )
    + ")"
)

LOG = f"""{RUNS}, {SCALARS}, metric_log AS (
  SELECT run_id, method, feature_map, mechanism, score_fn, percent_missing, step, val,
    str_split(tag, '/')[1] AS split, str_split(tag, '/')[2] AS feature_space,
    str_split(tag, '/')[3] AS filter_subgroup, str_split(tag, '/')[4] AS reduction,
    str_split(tag, '/')[5] AS feature_type, str_split(tag, '/')[6] AS metric_name
  FROM runs LEFT JOIN scalars USING (run_id)
  WHERE status = 'FINISHED' AND val IS NOT NULL AND len(str_split(tag, '/')) = 6)"""
