"""Feature preparation: missing values, dummies, interactions, population scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def split_by_type(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) context columns present in the frame, budget left out."""
    numeric, categorical = [], []
    for c in columns:
        if c == "daily_budget" or c not in df.columns:
            continue
        kind = df.schema[c].dataType
        (numeric if isinstance(kind, (NumericType, BooleanType)) else categorical).append(c)
    return numeric, categorical


def zero_fill(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Missing numeric context values to ``value``; categorical columns stay as they are."""
    numeric, _ = split_by_type(df, columns)
    fills = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(value)) for c in numeric}
    return df.withColumns(fills) if fills else df


# --- encoded designs -----------------------------------------------------------------------

import json  # noqa: E402
from dataclasses import asdict, dataclass, field  # noqa: E402

from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.sql import Column  # noqa: E402

# Flags that stay unscaled in the linear design.
NO_SCALE = ("is_weekend", "is_public_holiday")
SEGMENT_FLAG = "is_broad_match"
MAX_CATEGORIES = 1000


@dataclass(frozen=True)
class Encoding:
    """Categories, numeric columns and population moments learned from training rows.

    Categories are regions and calendar labels; their number is checked before they reach the
    driver. Unknown categories encode as all zeros and missing numbers as 0.
    """

    regions: list[str]
    numeric: list[str]
    categorical: dict[str, list[str]]
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Encoding":
        raw = json.loads(text)
        raw["moments"] = {k: tuple(v) for k, v in raw["moments"].items()}
        return Encoding(**raw)


def learn_encoding(train: DataFrame, feature_columns: Sequence[str]) -> Encoding:
    """One aggregation over the training rows: categories and population mean and deviation."""
    numeric, categorical = split_by_type(train, feature_columns)
    filled = zero_fill(train, numeric)
    scaled = ["daily_budget", *numeric]
    labels = {c: F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in ["region", *categorical]}
    counts = train.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in labels]).first()
    for c in labels:
        if counts[c] > MAX_CATEGORIES:
            raise ValueError(f"column {c} has too many categories to encode")
    row = filled.agg(
        *[v.alias(f"c_{c}") for c, v in labels.items()],
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in scaled],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in scaled],
    ).first()
    found = {c: list(row[f"c_{c}"]) for c in labels}
    moments = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in scaled}
    return Encoding(found["region"], numeric, {c: found[c] for c in categorical}, moments)


def _dummy(c: str, value: str) -> Column:
    return (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.lit(value)).cast("double")


def tree_columns(enc: Encoding) -> dict[str, Column]:
    """Tree design: scaled budget, region dummies, match flag, numbers as they are, category dummies."""
    mean, std = enc.moments["daily_budget"]
    cols: dict[str, Column] = {"daily_budget": (F.col("daily_budget").cast("double") - F.lit(mean)) / F.lit(std)}
    cols.update({f"region_{r}": _dummy("region", r) for r in enc.regions})
    cols[SEGMENT_FLAG] = F.col(SEGMENT_FLAG).cast("double")
    cols.update({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in enc.numeric})
    cols.update({f"{c}_{v}": _dummy(c, v) for c, values in enc.categorical.items() for v in values})
    return cols


def linear_columns(enc: Encoding, scaled: bool) -> dict[str, Column]:
    """Linear design: region dummies, match flag, budget, context, budget times dummies and flag.

    With ``scaled`` the continuous columns are standardised and the interactions rebuilt from the
    scaled budget.
    """

    def number(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        if not scaled or c in NO_SCALE:
            return value
        mean, std = enc.moments[c]
        return (value - F.lit(mean)) / F.lit(std)

    dummies = {f"region_{r}": _dummy("region", r) for r in enc.regions}
    dummies[SEGMENT_FLAG] = F.col(SEGMENT_FLAG).cast("double")
    budget = number("daily_budget")
    cols = {**dummies, "daily_budget": budget}
    cols.update({c: number(c) for c in enc.numeric})
    cols.update({f"{c}_{v}": _dummy(c, v) for c, values in enc.categorical.items() for v in values})
    cols.update({f"budget_x_{c}": v * budget for c, v in dummies.items()})
    return cols


def design_matrix(df: DataFrame, enc: Encoding, keep: Sequence[str] = (), scaled: bool = False) -> DataFrame:
    """The linear design as plain columns next to the kept ones."""
    return df.select(*keep, *[v.alias(f"x_{c}") for c, v in linear_columns(enc, scaled).items()])


def with_features(df: DataFrame, columns: dict[str, Column], out: str = "features") -> DataFrame:
    """Assemble design columns into a vector beside the original columns."""
    names = [f"_x{i}" for i in range(len(columns))]
    wide = df.withColumns(dict(zip(names, columns.values())))
    return VectorAssembler(inputCols=names, outputCol=out).transform(wide).drop(*names)
