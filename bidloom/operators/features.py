"""Keyword-set feature table and the modelling frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.config import Config
from bidloom.functions.calendar import with_calendar
from bidloom.operators import keyword_sets as K
from bidloom.operators import panel as P
from bidloom.operators import semantics as E


def match_type_counts(bridge: DataFrame) -> DataFrame:
    """Counts and shares per match type from the long bridge."""
    n = {mt: F.count_if(F.col("match_type") == mt) for mt in ("Broad", "Phrase", "Exact")}
    counts = bridge.groupBy("keyword_set_id").agg(*[v.alias(f"n_{mt.lower()}") for mt, v in n.items()])
    total = sum((F.col(f"n_{mt.lower()}") for mt in n), F.lit(0))
    return counts.withColumns({f"share_{mt.lower()}": F.when(total > 0, F.col(f"n_{mt.lower()}") / total) for mt in n})


def set_feature_table(bridge: DataFrame, stats: DataFrame, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per keyword set: embedding, planner, count and match-type features."""
    key = "keyword_set_id"
    size = bridge.groupBy(key).agg(F.count_distinct("keyword").alias("num_unique_keywords"))
    parts = [
        E.set_semantics(bridge, vectors, anchors),
        K.set_planner_features(bridge, stats),
        size,
        match_type_counts(bridge),
        K.match_type_planner_features(bridge, stats),
        E.match_type_semantics(bridge, vectors, anchors),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out


def modeling_frame(
    panel: DataFrame,
    summary: DataFrame,
    features: DataFrame,
    rates: DataFrame,
    config: Config,
    first_year: int,
    last_year: int,
) -> DataFrame:
    """Segment-day rows with set features, calendar and target, in training scope."""
    rows = P.add_match_indicator(P.add_segment(panel.filter(F.col("region").isNotNull())))
    rows = P.attach_set_ids(rows, summary).join(features, "keyword_set_id", "left")
    rows = with_calendar(rows, first_year, last_year, config.start_dates)
    if config.target != "all_conv":
        rows = P.scaled_target(rows, rates, config.target)
    absent = {c: F.lit(None).cast("double") for c in config.feature_columns() if c not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    rows = rows.dropna(subset=["daily_budget", "segment"])
    scope = config.constraints
    rows = P.training_scope(rows, scope.excluded_regions, scope.allowed_match_types)
    return P.lookback(rows, config.modeling_lookback_days)
