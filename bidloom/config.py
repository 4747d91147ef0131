"""Run settings with the default values used by every operator and plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# Default feature groups, constraint values and validation floors.
CONTEXT_FEATURES = {
    "calendar": ["day_of_week", "season", "days_to_next_course_start"],
    "keyword_set_static": ["embed_course_sim_mean", "num_unique_keywords"],
    "gkp_set": ["last_month_searches_mean", "competition_index_mean"],
    "match_type_set": [
        "embed_dispersion_broad",
        "embed_dispersion_phrase",
        "embed_dispersion_exact",
    ],
}


@dataclass(frozen=True)
class Constraints:
    regional_order: tuple[str, ...] = ("USA", "A", "B")
    excluded_regions: tuple[str, ...] = ("C",)
    allowed_match_types: tuple[str, ...] = ("Broad", "Phrase; Exact")
    budget_tiebreak_penalty: float = 0.0001
    daily_budget_cap: float = 354.0
    default_budget_max: float = 500.0


@dataclass(frozen=True)
class Validation:
    holdout_days: int = 75
    cv_folds: int = 3
    min_train_fraction: float = 0.5
    min_train_days: int = 0
    min_val_days: int = 21
    min_train_rows: int = 50
    min_val_rows: int = 20
    tune_hyperparams: bool = True
    refit_on_full_data: bool = True
    recency_half_life_days: float | None = None


@dataclass(frozen=True)
class ModelPolicy:
    candidates: tuple[str, ...] = ("ridge", "random_forest", "xgboost", "ensemble_ridge_xgb")
    selection_metric: str = "cv_rmse_levels"
    optimizer_winner: str = "xgboost"
    validation: Validation = field(default_factory=Validation)


@dataclass(frozen=True)
class Evaluation:
    use_ensemble: bool = False
    weight_by_cv_rmse: bool = True
    apply_observed_budget_floor: bool = True
    max_level_ub: float | None = None
    milp_external_level_tol: float = 0.01
    budget_floor_atol: float = 0.01


@dataclass(frozen=True)
class Monitoring:
    enabled: bool = True
    lookback_days: int = 7
    rolling_windows: tuple[int, ...] = (7, 30)


@dataclass(frozen=True)
class Config:
    target: str = "conv_scaled_clicks"
    context_features: dict[str, list[str]] = field(default_factory=lambda: dict(CONTEXT_FEATURES))
    constraints: Constraints = field(default_factory=Constraints)
    model_policy: ModelPolicy = field(default_factory=ModelPolicy)
    evaluation: Evaluation = field(default_factory=Evaluation)
    monitoring: Monitoring = field(default_factory=Monitoring)
    top_n_values: tuple[int, ...] = (10, 20, 40)
    modeling_lookback_days: int | None = None
    start_dates: tuple[str, ...] = ()
    conversion_actions: tuple[str, ...] = ()
    regions: dict[str, list[str]] = field(default_factory=dict)
    match_types: tuple[str, ...] = ("Broad", "Phrase; Exact")
    title_base: str = "Course"

    def feature_columns(self) -> list[str]:
        """Context columns in group order, first occurrence kept."""
        seen: dict[str, None] = {}
        for group in self.context_features.values():
            seen.update(dict.fromkeys(group))
        return list(seen)

    def static_columns(self) -> list[str]:
        """Context columns that change with the keyword set, not with the day."""
        calendar = set(self.context_features.get("calendar", []))
        return [c for c in self.feature_columns() if c not in calendar]


def overlay(base: Any, changes: dict[str, Any]) -> Any:
    """Return ``base`` with a nested mapping of changes applied on top."""
    known = {f.name for f in fields(base)}
    unknown = set(changes) - known
    if unknown:
        raise KeyError(f"unknown setting(s): {sorted(unknown)}")
    updates = {}
    for name, value in changes.items():
        current = getattr(base, name)
        if is_dataclass(current) and isinstance(value, dict):
            updates[name] = overlay(current, value)
        elif isinstance(current, tuple) and isinstance(value, list):
            updates[name] = tuple(value)
        elif isinstance(current, dict) and isinstance(value, dict):
            updates[name] = {**current, **value}
        else:
            updates[name] = value
    return replace(base, **updates)


def load_config(*layers: dict[str, Any]) -> Config:
    """Defaults, then each layer in turn (shared file, then per-account file)."""
    config = Config()
    for layer in layers:
        config = overlay(config, layer)
    return config
