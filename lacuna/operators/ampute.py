"""Controlled removal of values: MCAR, MAR and MNAR patterns.

Rows are assigned to patterns, scored by a weighted sum of standardised values, and removed with a
probability that is a logistic function of the score, shifted so that its mean is the wanted share
(Schouten, Lugtig and Vink, 2018). Draws are hashes of the row id: rerunning a task repeats them.

Any number of scenarios takes three aggregates (moments of the columns, moments of the scores, one
histogram of the scores) and then one projection. The histogram has 2,000 bins of 0.01 between -10
and 10 deviations, so the share removed is within 0.00125 of the wanted one, plus the share of the
rows whose score lies farther out, plus sampling error.

Rows without an id or without scored values are kept and scored as average; rows without an id lose
nothing. An empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.hashing import mix32, stream_key, uniform

# Missingness mechanisms, shapes of the score-to-probability functions, names that
# the distributions of latent columns may be given, and the shape parameter of the second.
MECHANISMS = ["MCAR", "MAR", "MNAR(G)", "MNAR(Y)", "MNAR"]
SCORE_FUNCTIONS = ["sigmoid-mid", "sigmoid-tail"]
DISTRIBUTIONS = {
    "normal": ["g", "gauss", "gaussian", "n", "norm", "normal"],
    "yulesimon": ["y", "yule", "s", "simon", "ys", "yules", "ysimon", "yulesimon", "y_s", "yule_s", "y_simon", "yule_simon"],
}
YULE_SIMON_RHO = 1.5
HISTOGRAM_BINS = 2000
_ASSIGN, _DRAW, _LATENT, _SCENARIO = 1_000, 2_000, 3_000, 10_000


@dataclass(frozen=True)
class Latent:
    """A column that is drawn, takes part in the score and is not returned."""

    column: str
    distribution: str
    stream: int

    def draw(self, id_col: str) -> Column:
        """Box-Muller, or a geometric number whose success probability is exp(-E / rho)."""
        u, v = (
            (mix32(stream_key(F.col(id_col), self.stream + k)) + 0.5) / 4294967296.0 for k in (0, 1)
        )
        if self.distribution == "normal":
            return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
        success = F.least(F.exp(F.log(u) / YULE_SIMON_RHO), F.lit(1 - 1e-12))
        return F.greatest(F.ceil(F.log(v) / F.log(1 - success)).cast("double"), F.lit(1.0))


@dataclass(frozen=True)
class Pattern:
    """Which values go together, and what decides in which rows they go."""

    incomplete: tuple[str, ...]
    at_random: bool
    weights: dict[str, float]
    latents: tuple[Latent, ...]
    freq: float
    shape: str

    @staticmethod
    def parse(
        given: dict, number: int, features: list[str], seed: int = 0, groups: dict[str, list[str]] | None = None
    ) -> Pattern:
        """Read a pattern given as a dict, which stays as it is.

        ``incomplete_vars`` may name a group of one-hot columns or one of its members: the whole
        group goes. Weights are given by name, or as a list for the features and then the latent
        columns, which weigh 1 whatever is given for the others. Without weights, MNAR scores the
        incomplete variables, MAR all others, and MNAR(...) the latent columns alone.
        """
        groups = groups or {}
        member_of = {c: g for g, members in groups.items() for c in [g, *members]}
        incomplete = [m for c in given["incomplete_vars"] for m in groups.get(member_of.get(c), [c])]
        kind, _, names = given["mechanism"].replace(" ", "").partition("(")
        if kind not in ("MCAR", "MAR", "MNAR") or (names and (kind != "MNAR" or not names.endswith(")"))):
            raise ValueError(f"unknown mechanism {given['mechanism']!r}")
        drawn = [n.lower() for n in names[:-1].split(",")] if names else []
        latents = tuple(
            Latent(f"latent_p{number}_{n}{j}", distribution_of(n), seed + _LATENT + 100 * number + 2 * j)
            for j, n in enumerate(drawn)
        )
        weights = given.get("weights") or {}
        if isinstance(weights, list):
            weights = dict(zip([*features, *[x.column for x in latents]], weights))
        elif not weights and not latents:
            weights = {c: 1.0 for c in features if (c in incomplete) == (kind == "MNAR")}
        weights = {**weights, **{x.column: 1.0 for x in latents}}
        shape = given.get("score_to_probability_func", "sigmoid-right").lower()
        return Pattern(
            tuple(dict.fromkeys(incomplete)), kind == "MCAR", {c: float(w) for c, w in weights.items() if w},
            latents, float(given.get("freq", 1.0)), shape,
        )


def distribution_of(name: str) -> str:
    for distribution, names in DISTRIBUTIONS.items():
        if name in names:
            return distribution
    raise ValueError(f"unknown distribution {name!r}")


def _shape(z: Column, kind: str) -> Column:
    return {
        "sigmoid-right": z,
        "sigmoid-left": -z,
        "sigmoid-mid": -F.abs(z) + 0.75,
        "sigmoid-tail": F.abs(z) - 0.75,
    }[kind]


def _shift_for(histogram: list[tuple[float, int]], prop: float) -> float:
    """Shift at which the mean logistic probability over the binned scores equals ``prop``."""
    total = sum(n for _, n in histogram)
    lo, hi = -50.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        mean = sum(n / (1 + math.exp(-max(-700.0, min(700.0, x + mid)))) for x, n in histogram) / total
        lo, hi = (mid, hi) if mean < prop else (lo, mid)
    return (lo + hi) / 2


def _assigned(draw: str, patterns: list[Pattern]) -> Column:
    """Number of the pattern a row falls to, by their frequencies."""
    total, upto, which = sum(p.freq for p in patterns), 0.0, None
    for i, p in enumerate(patterns[:-1]):
        upto += p.freq / total
        below = F.col(draw) < upto
        which = F.when(below, i) if which is None else which.when(below, i)
    last = F.lit(len(patterns) - 1)
    return last if which is None else which.otherwise(last)


def _slot_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation per column from one aggregate; a constant column counts as deviation 1."""
    if not columns:
        return {}
    parts = [f(F.col(f"`{c}`")) for c in columns for f in (F.avg, F.stddev_pop)]
    row = df.agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)]).first()
    return {c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def _decided(
    df: DataFrame, prop: float, scenarios: list[list[Pattern]], id_col: str, seeds: list[int]
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """``df`` with helper columns, and per scenario what its incomplete columns become."""
    drawn = {}
    for k, (patterns, seed) in enumerate(zip(scenarios, seeds)):
        drawn[f"__a{k}"] = uniform(stream_key(F.col(id_col), seed + _ASSIGN))
        drawn[f"__g{k}"] = uniform(stream_key(F.col(id_col), seed + _DRAW))
        drawn.update({f"__{k}_{x.column}": x.draw(id_col) for p in patterns for x in p.latents})
    df = df.withColumns(drawn)
    df = df.withColumns({f"__p{k}": _assigned(f"__a{k}", patterns) for k, patterns in enumerate(scenarios)})

    scored = {f"{k}_{i}": (k, i, p) for k, ps in enumerate(scenarios) for i, p in enumerate(ps) if not p.at_random}

    def column(k: int, p: Pattern, name: str) -> str:
        return f"__{k}_{name}" if name in {x.column for x in p.latents} else name

    used = {column(k, p, c) for k, _, p in scored.values() for c in p.weights}
    moments = _slot_moments(df, sorted(used))
    raw = {}
    for slot, (k, i, p) in scored.items():
        total = F.lit(0.0)
        for c, w in p.weights.items():
            mean, deviation = moments[column(k, p, c)]
            total = total + F.coalesce((F.col(f"`{column(k, p, c)}`") - mean) / deviation, F.lit(0.0)) * w
        raw[f"__r{slot}"] = F.when(F.col(f"__p{k}") == i, total)
    df = df.withColumns(raw) if raw else df

    # Scores are standardised within their pattern before the probability is taken.
    spread = _slot_moments(df, list(raw))
    shapes = {}
    for slot, (_, _, p) in scored.items():
        mean, deviation = spread[f"__r{slot}"]
        shapes[f"__z{slot}"] = _shape((F.col(f"__r{slot}") - mean) / deviation, p.shape)
    df = df.withColumns(shapes) if shapes else df
    shift = {}
    if scored:
        width = 20 / HISTOGRAM_BINS
        bins = []
        for s in scored:  # least and greatest skip nulls, which rows of other patterns have here
            z = F.col(f"__z{s}")
            b = F.when(z.isNotNull(), F.floor(F.greatest(F.least(z, F.lit(10.0)), F.lit(-10.0)) / width))
            bins.append(F.struct(F.lit(s).alias("slot"), b.alias("b")))
        cells = df.select(F.inline(F.array(*bins))).filter("b IS NOT NULL").groupBy("slot", "b").count().collect()
        for s in scored:  # at most HISTOGRAM_BINS + 1 counts each
            mine = [((r.b + 0.5) * width, r["count"]) for r in cells if r.slot == s]
            shift[s] = _shift_for(mine, prop) if mine else 0.0

    results = []
    for k, patterns in enumerate(scenarios):
        probability = F.lit(float(prop))
        for slot, (k2, i, _) in scored.items():
            if k2 == k:
                logistic = 1 / (1 + F.exp(-(F.col(f"__z{slot}") + F.lit(shift[slot]))))
                probability = F.when(F.col(f"__p{k}") == i, logistic).otherwise(probability)
        gone = F.coalesce(F.col(f"__g{k}") < probability, F.lit(False))
        hit: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            for c in p.incomplete:
                hit.setdefault(c, []).append(i)
        results.append({c: F.when(~(gone & F.col(f"__p{k}").isin(at)), F.col(f"`{c}`")) for c, at in hit.items()})
    return df, results


def ampute(
    df: DataFrame, prop: float, patterns: list[dict], id_col: str, features: list[str], seed: int = 0,
    groups: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Remove the incomplete variables of one pattern from about ``prop`` of the rows."""
    parsed = [Pattern.parse(p, i, features, seed, groups) for i, p in enumerate(patterns)]
    wide, (out,) = _decided(df, prop, [parsed], id_col, [seed])
    return wide.withColumns(out).select(*[f"`{c}`" for c in df.columns])


def scenario_grid(incomplete: list[str], observed: list[str]) -> list[dict]:
    """Ten scenarios: two score functions by five mechanisms."""
    grid = []
    for fn in SCORE_FUNCTIONS:
        for mechanism in MECHANISMS:
            p = {"incomplete_vars": list(incomplete), "mechanism": mechanism, "score_to_probability_func": fn}
            if mechanism == "MAR":
                p["weights"] = {c: 1.0 for c in observed}
            grid.append(p)
    return grid


def ampute_scenarios(
    df: DataFrame, prop: float, scenarios: list[dict], id_col: str, features: list[str], seed: int = 0,
    groups: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Every row once per scenario, amputed, with a ``scenario`` number, from one reading of the table."""
    seeds = [seed + _SCENARIO * k for k in range(len(scenarios))]
    parsed = [[Pattern.parse(p, 0, features, s, groups)] for p, s in zip(scenarios, seeds)]
    wide, outs = _decided(df, prop, parsed, id_col, seeds)
    rows = [
        F.struct(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], F.lit(k).alias("scenario"))
        for k, out in enumerate(outs)
    ]
    return wide.select(F.inline(F.array(*rows)))
