"""Response models on Spark ML: fits, expanding-window validation, tournament, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import product
from typing import Any

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.config import Config
from bidloom.models import day_sums as S
from bidloom.models import design as D
from bidloom.operators import splits as V
from bidloom.operators.panel import usable_rows
from bidloom.session import cut_lineage

# Hyperparameter grids, member groups, warning threshold, seed.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "ridge": {"alpha": [10.0, 100.0]},
    "random_forest": {"n_estimators": [5, 10, 20], "max_depth": [2, 3], "min_samples_leaf": [10, 20]},
    "xgboost": {"n_estimators": [5, 10, 20], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]},
    "mean_baseline": {},
}
DEFAULTS: dict[str, dict[str, Any]] = {
    "ridge": {"alpha": 1.0},
    "random_forest": {"n_estimators": 10, "max_depth": 3, "min_samples_leaf": 20},
    "xgboost": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1},
    "mean_baseline": {},
}
ENSEMBLES = {"ensemble": ["ridge", "random_forest", "xgboost"], "ensemble_ridge_xgb": ["ridge", "xgboost"]}
POOR_R2 = 0.3
SEED = 42
PARALLEL_JOBS = 8


@dataclass
class Fitted:
    """A fitted level predictor: ``predict`` adds one column."""

    name: str
    params: dict[str, Any]
    encoding: D.Encoding | None = None
    model: Any = None
    mean: float | None = None
    members: list["Fitted"] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def columns(self) -> dict[str, Column]:
        return D.linear_columns(self.encoding, scaled=True) if self.name == "ridge" else D.tree_columns(self.encoding)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.members:
            parts = [f"_m{i}" for i in range(len(self.members))]
            for part, member in zip(parts, self.members):
                df = member.predict(df, part)
            return df.withColumn(out, blend([F.col(p) for p in parts], self.weights)).drop(*parts)
        if self.mean is not None:
            return df.withColumn(out, F.lit(self.mean))
        vectors = D.with_features(df, self.columns(), "_features")
        return self.model.setFeaturesCol("_features").setPredictionCol(out).transform(vectors).drop("_features")


def blend(levels: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of member levels, clipped at 0."""
    total = sum((F.lit(float(w)) * p for w, p in zip(weights, levels)), F.lit(0.0))
    return F.greatest(total / F.lit(float(sum(weights))), F.lit(0.0))


def inverse_error_weights(rmse: dict[str, float], members: Sequence[str]) -> list[float]:
    inverse = [1.0 / max(rmse.get(m, float("inf")), 1e-9) for m in members]
    total = sum(inverse) or 1.0
    return [w / total for w in inverse]


def fit(name: str, train: DataFrame, config: Config, params: dict[str, Any] | None = None) -> Fitted:
    """Fit one model on the usable rows of ``train``, recency-weighted when configured."""
    p = {**DEFAULTS[name], **(params or {})}
    target = config.target
    rows = usable_rows(train, target)
    if name == "mean_baseline":
        return Fitted(name, p, mean=float(rows.agg(F.avg(target)).first()[0] or 0.0))
    encoding = D.learn_encoding(rows, config.feature_columns())
    half_life = config.model_policy.validation.recency_half_life_days
    rows = V.recency_weights(rows.withColumn("label", F.col(target).cast("double")), half_life)
    fitted = Fitted(name, p, encoding)
    data = D.with_features(rows, fitted.columns()).select("features", "label", "weight")
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "ridge":
        y = F.col("label")
        w = F.col("weight")
        total, mean, square = rows.agg(F.sum(w), F.sum(w * y) / F.sum(w), F.sum(w * y * y) / F.sum(w)).first()
        spread = max(square - mean * mean, 0.0) ** 0.5
        # the solver divides its penalty by the label deviation, so the deviation multiplies it here
        reg = p["alpha"] / total * spread
        learner = LinearRegression(**common, regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")
    elif name == "random_forest":
        learner = RandomForestRegressor(
            **common, numTrees=p["n_estimators"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"], seed=SEED
        )
    elif name == "xgboost":
        learner = GBTRegressor(**common, maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"], seed=SEED)
    else:
        raise ValueError(f"unknown model {name!r}")
    fitted.model = learner.fit(data)
    return fitted


# --- metrics and validation ----------------------------------------------------------------


def level_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, R2 and MAE of predictions clipped at 0, per group, in one aggregation.

    R2 is NULL when the actual values do not vary.
    """
    p, y = F.greatest(F.col(predicted), F.lit(0.0)), F.col(actual)
    e = y - p
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.var_pop(y) > 0, 1 - F.sum(e * e) / total).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.count(y).alias("n_rows"),
    )


def holdout_metrics(model: Fitted, holdout: DataFrame, config: Config) -> dict[str, float | None]:
    rows = usable_rows(holdout, config.target)
    row = level_metrics(model.predict(rows, "_p"), config.target, "_p").first()
    return {"holdout_rmse_levels": row["rmse"], "holdout_r2_levels": row["r2"], "holdout_mae_levels": row["mae"], "n_holdout": row["n_rows"]}


class FoldError(RuntimeError):
    """A validation fold failed to fit or score."""


class Folds:
    """Folds of a frame: (number, training rows, validation rows) with day bounds pushed into the frame as filters.

    The day sums of all folds are taken once, when a ridge first asks for them.
    """

    def __init__(self, train: DataFrame, config: Config):
        days = V.fold_days(train, config.model_policy.validation)
        spans = self._spans(days)
        self.spans = spans or self._spans(V.fallback_days(train))
        self.train, self.config = train, config

    @staticmethod
    def _spans(days: DataFrame) -> list[tuple]:
        cut = F.max(F.when(F.col("role") == "train", F.col("date"))).alias("cut")
        found = days.groupBy("fold").agg(cut, F.max("date").alias("end")).orderBy("fold").collect()
        return [(r["fold"], r["cut"], r["end"]) for r in found]

    @cached_property
    def sums(self) -> S.DaySums:
        return S.day_sums(self.train, self.config)

    def __len__(self) -> int:
        return len(self.spans)

    def __iter__(self) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        for number, cut, end in self.spans:
            val = self.train.filter((F.col("date") > F.lit(cut)) & (F.col("date") <= F.lit(end)))
            yield number, self.train.filter(F.col("date") <= F.lit(cut)), val


def folds_of(train: DataFrame, config: Config) -> Folds:
    return Folds(train, config)


def in_parallel(run: Callable[[Any], Any], items: Sequence[Any], jobs: int = PARALLEL_JOBS) -> list[Any]:
    """``run`` of every item in order, at most ``jobs`` at a time; their Spark jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=jobs) as pool:
        return list(pool.map(run, items))


def _mean_metrics(name: str, per_fold: list[dict]) -> dict[str, float]:
    found = [m for m in per_fold if m]
    if not found:
        raise FoldError(f"no validation rows for {name}")

    def mean(key: str) -> float | None:
        values = [m[key] for m in found if m[key] is not None]
        return sum(values) / len(values) if values else None

    return {"cv_rmse_levels": mean("rmse"), "cv_r2_levels": mean("r2"), "cv_mae_levels": mean("mae"), "cv_n_folds": len(found)}


def validate_ridge(folds: Folds, alphas: Sequence[float]) -> list[dict[str, float]]:
    """Mean fold metrics of every penalty: one job for the sums of all folds, one for their scores."""
    try:
        levels = [folds.sums.fits([(cut, alpha) for alpha in alphas]) for _, cut, _ in folds.spans]
    except Exception as exc:
        raise FoldError(f"a fold of {len(folds)} failed for ridge: {exc}") from exc
    scored = S.fold_metrics(folds.train, folds.sums, folds.config.target, folds.spans, levels)
    return [_mean_metrics("ridge", [fold[i] for fold in scored]) for i in range(len(alphas))]


def validate_all(name: str, config: Config, settings: Sequence[dict[str, Any]], folds: Folds,
                 member_params: dict[str, dict] | None = None, weights: Sequence[float] | None = None) -> list[dict[str, float]]:
    """Mean fold metrics of every setting; fits of all folds and settings run side by side and are scored in one job."""
    if name == "ridge":
        return validate_ridge(folds, [{**DEFAULTS["ridge"], **p}["alpha"] for p in settings])
    tasks = [(i, p, *fold) for i, p in enumerate(settings) for fold in folds]

    def scored(task: tuple) -> DataFrame:
        i, params, number, rows, val = task
        try:
            model = fit_any(name, rows, config, params, member_params, weights)
            return model.predict(usable_rows(val, config.target), "_p").select(
                F.lit(i).alias("setting"), F.lit(number).alias("fold"), F.col(config.target).cast("double").alias("y"), "_p"
            )
        except Exception as exc:
            raise FoldError(f"fold {number} of {len(folds)} failed for {name}: {exc}") from exc

    rows = level_metrics(reduce(DataFrame.unionByName, in_parallel(scored, tasks)), "y", "_p", ["setting", "fold"]).collect()
    by_setting: list[list[dict]] = [[] for _ in settings]
    for r in rows:
        by_setting[r["setting"]].append(r.asDict())
    return [_mean_metrics(name, found) for found in by_setting]


def cross_validate(name: str, train: DataFrame, config: Config, params: dict[str, Any] | None = None, folds: Folds | None = None,
                   member_params: dict[str, dict] | None = None, weights: Sequence[float] | None = None) -> dict[str, float]:
    """Mean level metrics over the folds."""
    return validate_all(name, config, [params or {}], folds or folds_of(train, config), member_params, weights)[0]


def param_maps(grid: dict[str, list[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, combo)) for combo in product(*grid.values())] if grid else [{}]


def tune(name: str, train: DataFrame, config: Config, grid: dict[str, list[Any]] | None = None, folds=None) -> tuple[dict, dict]:
    """Parameters with the lowest fold RMSE; the first of equals stays."""
    folds = folds_of(train, config) if folds is None else folds
    best, best_cv = {}, {"cv_rmse_levels": float("inf")}
    settings = param_maps(GRIDS.get(name, {}) if grid is None else grid)
    for params, cv in zip(settings, validate_all(name, config, settings, folds)):
        if cv["cv_rmse_levels"] < best_cv["cv_rmse_levels"]:
            best, best_cv = params, cv
    return best, best_cv


def fit_any(name: str, train: DataFrame, config: Config, params: dict[str, Any] | None = None,
            member_params: dict[str, dict] | None = None, weights: Sequence[float] | None = None) -> Fitted:
    """Fit a single model or an ensemble of its members (equal weights unless given)."""
    if name not in ENSEMBLES:
        return fit(name, train, config, params)
    tuned = member_params or {}
    members = [fit(m, train, config, tuned.get(m)) for m in ENSEMBLES[name]]
    return Fitted(name, {}, members=members, weights=list(weights or [1.0 / len(members)] * len(members)))


@dataclass
class Tournament:
    """Outcome of a model comparison."""

    winner: str
    table: list[dict[str, Any]]
    params: dict[str, dict[str, Any]]
    model: Fitted
    warnings: list[str]


def selection_score(row: dict[str, Any], config: Config) -> float:
    """Smaller is better."""
    if "r2" in config.model_policy.selection_metric:
        found = _first_known(row.get("cv_r2_levels"), row.get("holdout_r2_levels"))
        return -(0.0 if found is None else found)
    return _first_known(row.get("cv_rmse_levels"), row.get("holdout_rmse_levels"))


def _first_known(*values: float | None) -> float | None:
    return next((v for v in values if v is not None), None)


def run_tournament(
    frame: DataFrame, config: Config, candidates: Sequence[str] | None = None, grids: dict[str, dict] | None = None
) -> Tournament:
    """Tune, validate and compare the candidates, then refit the winner on all rows.

    The modelling frame is stored once and every fit reads a filtered slice of it.
    """
    frame = cut_lineage(frame)
    policy = config.model_policy
    train, holdout = V.train_holdout(frame, policy.validation.holdout_days)
    folds = folds_of(train, config)
    params: dict[str, dict] = {}
    cv: dict[str, dict] = {}
    weights_of: dict[str, list[float] | None] = {}
    table: list[dict[str, Any]] = []
    for name in candidates or policy.candidates:
        weights, members = None, None
        for single in ENSEMBLES.get(name, [name]):
            if single not in cv:
                grid = (grids or GRIDS).get(single, {}) if policy.validation.tune_hyperparams else {}
                params[single], cv[single] = tune(single, train, config, grid, folds)
        if name in ENSEMBLES:
            members = params
            if config.evaluation.weight_by_cv_rmse and name != "ensemble_ridge_xgb":
                weights = inverse_error_weights({m: cv[m]["cv_rmse_levels"] for m in ENSEMBLES[name]}, ENSEMBLES[name])
            cv[name] = cross_validate(name, train, config, None, folds, members, weights)
        weights_of[name] = weights
        model = fit_any(name, train, config, params.get(name), members, weights)
        table.append({"model": name, **cv[name], **holdout_metrics(model, holdout, config)})
    winner = min(table, key=lambda r: selection_score(r, config))["model"]
    refit_on = frame if policy.validation.refit_on_full_data else train
    final = fit_any(winner, refit_on, config, params.get(winner), params, weights_of[winner])
    warnings = []
    for row in table:
        r2 = row["holdout_r2_levels"]
        if r2 is not None and r2 < POOR_R2:
            warnings.append(f"poor holdout R2 {r2:.4f} of {row['model']}")
    if policy.optimizer_winner != winner:
        warnings.append(f"planning uses {policy.optimizer_winner} but the comparison chose {winner}")
    return Tournament(winner, table, params, final, warnings)


METRICS_SCHEMA = (
    "model string, cv_rmse_levels double, cv_r2_levels double, cv_mae_levels double, cv_n_folds long, "
    "holdout_rmse_levels double, holdout_r2_levels double, holdout_mae_levels double, n_holdout long"
)


def metrics_frame(spark: SparkSession, result: Tournament) -> DataFrame:
    """One row per candidate: a handful of rows from the comparison."""
    fields = spark.createDataFrame([], METRICS_SCHEMA).columns
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in result.table], METRICS_SCHEMA)


def winner_params(frame: DataFrame, config: Config, manifest: dict[str, Any], tune_on_slice: bool) -> dict[str, dict]:
    """Parameters of the planning model or its members: tuned on the frame, or as recorded; a missing record is an error."""
    name = config.model_policy.optimizer_winner
    if name in ENSEMBLES and name != "ensemble_ridge_xgb":
        raise ValueError(f"planning does not support {name!r}")
    singles = ENSEMBLES.get(name, [name])
    if tune_on_slice:
        folds = folds_of(frame, config)
        return {m: tune(m, frame, config, folds=folds)[0] for m in singles}
    recorded = manifest.get("params", {})
    absent = [m for m in singles if m not in recorded and GRIDS.get(m, {}) != {}]
    if absent:
        raise ValueError(f"the manifest has no parameters for {absent}")
    return {m: recorded.get(m, {}) for m in singles}


def fit_winner(frame: DataFrame, config: Config, manifest: dict[str, Any], before: str | None = None, tune_on_slice: bool = False) -> Fitted:
    """Refit the planning model on rows before a day, if given, with recorded parameters or with ones tuned on these rows."""
    name = config.model_policy.optimizer_winner
    rows = frame if before is None else frame.filter(F.col("date") < F.to_date(F.lit(before)))
    params = winner_params(rows, config, manifest, tune_on_slice)
    return fit_any(name, rows, config, params.get(name), params)


def evaluation_model(frame: DataFrame, config: Config, manifest: dict[str, Any]) -> tuple[Fitted, dict[str, Any]]:
    """Scoring model fitted on all rows, after a diagnostic holdout fit of the same model."""
    name = "ensemble" if config.evaluation.use_ensemble else config.model_policy.optimizer_winner
    params, weights = manifest.get("params", {}), None
    if name in ENSEMBLES and config.evaluation.weight_by_cv_rmse:
        rmse = manifest.get("cv_rmse", {})
        if not all(m in rmse for m in ENSEMBLES[name]):
            raise ValueError("inverse-error weights need the validation error of every member")
        weights = inverse_error_weights(rmse, ENSEMBLES[name])
    train, holdout = V.train_holdout(frame, config.model_policy.validation.holdout_days)
    probe = fit_any(name, train, config, params.get(name), params, weights)
    return fit_any(name, frame, config, params.get(name), params, weights), holdout_metrics(probe, holdout, config)


# --- reports -------------------------------------------------------------------------------


def ridge_terms(spark: SparkSession, model: Fitted) -> DataFrame:
    """(term, family, value) of a ridge model: intercept, segment, budget slopes, context."""
    names = list(model.columns())
    regions = {f"region_{r}" for r in model.encoding.regions} | {D.SEGMENT_FLAG}

    def family(n: str) -> str:
        if n == "daily_budget" or n.startswith("budget_x_"):
            return "budget_slope"
        return "segment" if n in regions else "context"

    rows = [("intercept", "intercept", float(model.model.intercept))]
    rows += [(n, family(n), float(c)) for n, c in zip(names, model.model.coefficients)]
    return spark.createDataFrame(rows, "term string, family string, value double")


def importances(spark: SparkSession, model: Fitted) -> DataFrame:
    """(term, value) split-gain importances of a tree model."""
    rows = [(n, float(v)) for n, v in zip(model.columns(), model.model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "term string, value double")


def top_terms(terms: DataFrame, n: int = 6) -> DataFrame:
    """Terms of largest absolute value."""
    return terms.orderBy(F.abs("value").desc(), "term").limit(n)


def response_terms(model: Fitted, templates: DataFrame, calendar_columns: Sequence[str]) -> DataFrame:
    """Per template row: level at budget 0, slope per unit budget, and the calendar part of the level.

    Each template is scored at budget 0 and 1 and once with its calendar columns blanked, all in one
    prediction job.
    """
    variants = F.array(
        F.struct(F.lit("base").alias("v"), F.lit(0.0).alias("b")), F.struct(F.lit("slope").alias("v"), F.lit(1.0).alias("b")),
        F.struct(F.lit("blank").alias("v"), F.lit(0.0).alias("b")),
    )
    rows = templates.withColumn("_x", F.explode(variants)).withColumn("daily_budget", F.col("_x.b"))
    blanks = {}
    for c in calendar_columns:
        if c in templates.columns:
            kind = templates.schema[c].dataType
            none = F.lit("") if kind.typeName() == "string" else F.lit(0).cast(kind)
            blanks[c] = F.when(F.col("_x.v") == "blank", none).otherwise(F.col(c))
    scored = model.predict(rows.withColumns(blanks), "_p")
    at = lambda v: F.max(F.when(F.col("_x.v") == v, F.col("_p")))
    return scored.groupBy("segment").agg(
        at("base").alias("level_at_zero"), (at("slope") - at("base")).alias("budget_slope"), (at("base") - at("blank")).alias("calendar_offset")
    )


def set_lift(model: Fitted, templates: DataFrame, features: DataFrame, static_columns: Sequence[str]) -> DataFrame:
    """Change of level when a segment template takes the features of each keyword set.

    ``templates`` has a row per segment; sets are joined on the segments that may use them.
    """
    own = [c for c in static_columns if c in features.columns and c in templates.columns]
    base = model.predict(templates, "_base").select("segment", "_base")
    rows = templates.drop(*own, "keyword_set_id").join(features.select("segment", "keyword_set_id", *own), "segment")
    scored = model.predict(rows, "_p").join(base, "segment")
    return scored.select("segment", "keyword_set_id", (F.col("_p") - F.col("_base")).alias("lift"))


def feature_effects(model: Fitted, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean signed change of the prediction when a feature takes its own value instead of its mean.

    Each row is scored once per feature with only that feature replaced; every row is used.
    """
    base = rows.withColumn("_id", F.monotonically_increasing_id())
    numeric, _ = D.split_by_type(rows, columns)
    means = rows.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in numeric]).first()
    kinds = F.array(*[F.lit(c) for c in numeric], F.lit(""))
    listed = base.withColumn("_feature", F.explode(kinds)).withColumns(
        {c: F.when(F.col("_feature") == c, F.lit(means[c])).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in numeric}
    )
    scored = model.predict(listed, "_p").groupBy("_feature").agg(F.avg("_p").alias("_mean"))
    whole = scored.filter("_feature = ''").agg(F.max("_mean")).scalar()
    return scored.filter("_feature <> ''").select(F.col("_feature").alias("feature"), (whole - F.col("_mean")).alias("effect"))


def save_manifest(spark: SparkSession, path: str, result: Tournament) -> None:
    """Winner, parameters and validation errors as one JSON row, with the fitted models beside it."""
    manifest = {"winner": result.winner, "params": result.params, "cv_rmse": {r["model"]: r["cv_rmse_levels"] for r in result.table}}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").write.mode("overwrite").text(f"{path}/manifest")
    for i, member in enumerate(result.model.members or [result.model]):
        if member.model is not None:
            member.model.write().overwrite().save(f"{path}/model-{i}")
            spark.createDataFrame([(member.encoding.to_json(),)], "e string").write.mode("overwrite").text(f"{path}/encoding-{i}")


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])
