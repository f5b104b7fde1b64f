"""Options of a selector and their rules."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

TASKS = ("auto", "classifier_binary", "classifier_multiclass", "continuous")
#: Names and defaults of the public interface.
#: Options that only one estimator reads; setting one for the other estimator is an error.
OF_ESTIMATOR = {
    "histogram": ("bins", "bins_target", "max_categories", "missing", "significance", "fdr_q", "n_permutations", "permutation_rows", "subsample", "max_cache_cells", "numeric_features", "categorical_features", "exact_quantiles"),
    "ksg": ("ksg_k", "ksg_subsample"),
}


@dataclass
class SelectorConfig:
    # fixed values: names and defaults of the public interface, up to categorical_features
    target: str
    task: str = "auto"
    max_features: int = 50
    screen_top_k: int = 100
    bins: int | str = 10
    bins_target: int = 10
    max_categories: int = 50
    missing: str = "category"
    significance: Any = "chi2"
    fdr_q: float = 0.05
    n_permutations: int = 100
    permutation_rows: int = 50_000
    min_score: float = 1e-4
    #: Rows from which joint tables are counted; None: all.
    subsample: int | None = 1_000_000
    estimator: str = "histogram"
    ksg_k: int = 10
    ksg_subsample: int = 250_000
    seed: int = 42
    max_cache_cells: int = 250_000_000
    cmim_m: int = 2
    cmim_approx: str | None = None
    spark: Any = None
    numeric_features: list[str] | None = None
    categorical_features: list[str] | None = None
    #: Columns that are never candidates (keys, say).
    exclude: tuple[str, ...] = ()
    #: "table": degrees of freedom from the table's shape; "occupied": from the codes that occur.
    freedom: str = "table"
    #: Quantiles by counting all values instead of a sketch.
    exact_quantiles: bool = False

    def __post_init__(self) -> None:
        least = {"max_features": 1, "screen_top_k": 1, "bins_target": 2, "max_categories": 1, "n_permutations": 1, "permutation_rows": 100, "subsample": 1000, "ksg_k": 1, "ksg_subsample": 1000, "max_cache_cells": 1000, "cmim_m": 1, "min_score": 0}
        for name, low in least.items():
            if getattr(self, name) is None and name == "subsample":
                continue
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}, not {getattr(self, name)}")
        allowed = {"task": TASKS, "missing": ("category", "drop"), "estimator": ("histogram", "ksg"), "cmim_approx": (None, "max_min"), "freedom": ("table", "occupied")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, not {getattr(self, name)!r}")
        if self.significance not in ("chi2", "permutation", None) and not hasattr(self.significance, "test"):
            raise ValueError(f"significance must be 'chi2', 'permutation', None or have a method test, not {self.significance!r}")
        if self.screen_top_k < self.max_features:
            raise ValueError(f"screen_top_k ({self.screen_top_k}) must not be below max_features ({self.max_features})")
        if self.bins != "auto" and (not isinstance(self.bins, int) or self.bins < 2):
            raise ValueError(f"bins must be 'auto' or an integer from 2 on, not {self.bins!r}")
        if not 0 < self.fdr_q < 1:
            raise ValueError(f"fdr_q must lie between 0 and 1, not {self.fdr_q}")
        if both := sorted(set(self.numeric_features or ()) & set(self.categorical_features or ())):
            raise ValueError(f"both numeric and categorical: {both}")
        other = "ksg" if self.estimator == "histogram" else "histogram"
        default = {f.name: f.default for f in fields(self)}
        if wrong := sorted(n for n in OF_ESTIMATOR[other] if getattr(self, n) != default[n]):
            raise ValueError(f"only estimator={other!r} reads {', '.join(wrong)}")
