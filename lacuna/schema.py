"""Column typing of a mixed table, kept by name."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class FeatureSchema:
    """Continuous, binary and one-hot feature columns, plus the group names after mapping.

    ``onehot`` maps a variable to its indicator columns in category order. ``bins`` does the same
    for discretised continuous variables. ``order`` is the output order of the features.
    """

    ids: tuple[str, ...]
    continuous: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    onehot: dict[str, tuple[str, ...]] = field(default_factory=dict)
    bins: dict[str, tuple[str, ...]] = field(default_factory=dict)
    categorical: tuple[str, ...] = ()
    label: str | None = None
    split: str | None = None
    order: tuple[str, ...] = ()

    @staticmethod
    def infer(
        columns: list[str],
        ids: list[str],
        continuous: list[str],
        onehot_prefixes: list[str] = (),
        label: str | None = None,
        split: str | None = None,
    ) -> "FeatureSchema":
        """Type columns by exact name and by ``prefix_``; what is left over is binary.

        Empty one-hot groups are removed. Every feature must land in exactly one type.
        """
        skip = set(ids) | {label, split}
        features = [c for c in columns if c not in skip]
        groups = {p: tuple(c for c in features if c.startswith(f"{p}_")) for p in onehot_prefixes}
        groups = {p: cols for p, cols in groups.items() if cols}
        grouped = [c for cols in groups.values() for c in cols]
        if len(grouped) != len(set(grouped)):
            raise ValueError("a column belongs to two one-hot groups: prefixes must be unique")
        both = set(grouped) & set(continuous)
        if both:
            raise ValueError(f"columns typed twice: {sorted(both)}")
        ctn = tuple(c for c in features if c in set(continuous))
        binary = tuple(c for c in features if c not in set(ctn) and c not in set(grouped))
        return FeatureSchema(
            tuple(ids), ctn, binary, groups, {}, (), label, split, tuple(features)
        )

    @property
    def features(self) -> list[str]:
        return list(self.order)

    @property
    def onehot_columns(self) -> list[str]:
        return [c for cols in self.onehot.values() for c in cols]

    @property
    def keys(self) -> list[str]:
        return [*self.ids, *[c for c in (self.split, self.label) if c]]

    @property
    def groups(self) -> dict[str, dict[str, tuple[str, ...]]]:
        """Group maps by kind, as used for group-wise fills and arg-max."""
        return {
            "categorical_onehots": dict(self.onehot),
            "binary_vars": {c: (c,) for c in self.binary},
            "discretized_ctn_cols": dict(self.bins),
        }

    def after_combine(self) -> "FeatureSchema":
        """One ordinal column per one-hot group, appended at the end."""
        order = [c for c in self.order if c not in set(self.onehot_columns)] + list(self.onehot)
        return replace(self, onehot={}, categorical=tuple(self.onehot), order=tuple(order))

    def after_target_encode(self) -> "FeatureSchema":
        """Everything is continuous once categories are encoded as means."""
        combined = self.after_combine()
        return replace(
            combined, continuous=combined.order, binary=(), categorical=(), onehot={}
        )

    def after_discretize(self, bins: dict[str, list[str]]) -> "FeatureSchema":
        """Bin columns replace their continuous source and are appended at the end."""
        order = [c for c in self.order if c not in bins]
        order += [b for cols in bins.values() for b in cols]
        return replace(
            self,
            continuous=tuple(c for c in self.continuous if c not in bins),
            bins={c: tuple(b) for c, b in bins.items()},
            order=tuple(order),
        )

    def drop(self, columns: list[str]) -> "FeatureSchema":
        gone = set(columns)
        groups = {p: tuple(c for c in cs if c not in gone) for p, cs in self.onehot.items()}
        return replace(
            self,
            continuous=tuple(c for c in self.continuous if c not in gone),
            binary=tuple(c for c in self.binary if c not in gone),
            onehot={p: cs for p, cs in groups.items() if cs},
            order=tuple(c for c in self.order if c not in gone),
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FeatureSchema":
        raw = json.loads(text)
        for key in ("ids", "continuous", "binary", "categorical", "order"):
            raw[key] = tuple(raw[key])
        for key in ("onehot", "bins"):
            raw[key] = {k: tuple(v) for k, v in raw[key].items()}
        return FeatureSchema(**raw)
