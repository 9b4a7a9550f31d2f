"""All registered queries."""

from __future__ import annotations

import importlib

from lacuna.plans import registry

GROUPS = ["q_clean", "q_reshape", "q_transform", "q_score", "q_stats", "q_ampute", "q_predict", "q_fit", "q_stream", "q_prepare"]


def _load() -> None:
    for name in GROUPS:
        importlib.import_module(f"lacuna.plans.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
