"""Operator contract and registry.

An operator has two halves:

* ``fit(df, columns, **params) -> state`` computes what it needs for *all* of
  its columns at once (one aggregate, or one distributed sort for exact order
  statistics) and returns ``{column: {key: value}}`` — small scalars only, or a
  reference to a small DataFrame for per-category maps.
* ``transform(df, state) -> DataFrame`` is lazy: one projection (plus a
  size-checked join for per-category maps). It can be re-applied to new rows,
  which makes a saved state enough for batch scoring.

Calling an operator does both and also returns one log row per column
(``status`` = applied / skipped, with a reason).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class StepLog:
    column: str
    operation: str
    params: dict = field(default_factory=dict)
    status: str = "applied"
    message: str = ""


class Operator:
    name: str = ""
    family: str = ""
    needs_target: bool = False

    def fit(self, df: DataFrame, columns: list[str], **params) -> dict[str, dict[str, Any]]:
        return {c: {} for c in columns if c in df.columns}

    def transform(self, df: DataFrame, state: dict[str, dict[str, Any]]) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame, columns, fit_df: DataFrame | None = None, **params):
        cols = [columns] if isinstance(columns, str) else list(columns)
        state = self.fit(fit_df if fit_df is not None else df, cols, **params)
        logs = []
        for c in cols:
            st = state.get(c)
            if st is None or st.get("skip"):
                reason = "absent" if c not in df.columns else (st or {}).get("skip", "not applicable")
                logs.append(StepLog(c, self.name, params, "skipped", str(reason)))
            else:
                logs.append(StepLog(c, self.name, params, "applied", ""))
        active = {c: s for c, s in state.items() if not s.get("skip")}
        out = self.transform(df, active) if active else df
        return out, state, logs


REGISTRY: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    REGISTRY[op.name] = op
    return op
