"""Stored modelling frames and design matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bidloom.config import Config
from bidloom.models import design as D
from bidloom.operators.panel import usable_rows


def save_modeling_artifacts(train: DataFrame, holdout: DataFrame, config: Config, path: str) -> dict[str, str]:
    """Train and holdout frames, and their linear designs under the training encoding, as Parquet."""
    enc = D.learn_encoding(usable_rows(train, config.target), config.feature_columns())
    keep = ["date", "segment", config.target]
    outputs = {
        "modeling_frame_train": train,
        "modeling_frame_holdout": holdout,
        "design_train": D.design_matrix(usable_rows(train, config.target), enc, keep),
        "design_holdout": D.design_matrix(usable_rows(holdout, config.target), enc, keep),
    }
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in outputs}
