"""Keyword sets: text lists, long bridge, allowlist filter, overlaps, planner statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.functions.grouped import number_rows, percentile

LIST_COLUMN_NAMES = ("positive_keywords", "unique_keywords", *T.LIST_COLUMNS.values())
STATS = ("last_month_searches", "competition_index", "bid_low")


def clean_sets(sets: DataFrame) -> DataFrame:
    """Every list column cleaned entry by entry and written in canonical form."""
    return sets.withColumns({c: T.clean_list(c) for c in LIST_COLUMN_NAMES if c in sets.columns})


def with_positive(sets: DataFrame) -> DataFrame:
    """Positive list: given, else the unique list, else the union of the match-type lists."""
    if "positive_keywords" in sets.columns:
        return sets
    if "unique_keywords" in sets.columns:
        return sets.withColumn("positive_keywords", F.col("unique_keywords"))
    lists = list(T.LIST_COLUMNS.values())
    missing = sorted(set(lists) - set(sets.columns))
    if missing:
        raise ValueError(f"keyword sets are missing list column(s): {', '.join(missing)}")
    return sets.withColumn("positive_keywords", T.join_list(F.concat(*[T.split_list(c) for c in lists])))


def set_keywords(columns: Sequence[str], positive: str = "positive_keywords") -> Column:
    """Sorted keywords of a set row: match-type lists when any is filled, else the positive list."""
    lists = [c for c in T.LIST_COLUMNS.values() if c in columns]
    fallback = T.split_list(positive) if positive in columns else F.array().cast("array<string>")
    if not lists:
        return T.sorted_distinct(fallback)
    by_type = F.concat(*[T.split_list(c) for c in lists])
    filled = F.lit(False)
    for c in lists:
        filled = filled | (T.strip(F.coalesce(F.col(c), F.lit(""))) != "")
    return T.sorted_distinct(F.when(filled, by_type).otherwise(fallback))


def members(sets: DataFrame) -> DataFrame:
    """Long bridge (keyword_set_id, match_type, keyword) of a set table's list columns."""

    def labelled(mt: str, c: str) -> Column:
        entries = F.array_distinct(T.split_list(c))
        return F.transform(entries, lambda k: F.struct(F.lit(mt).alias("match_type"), k.alias("keyword")))

    parts = [labelled(mt, c) for mt, c in T.LIST_COLUMNS.items() if c in sets.columns]
    return sets.select("keyword_set_id", F.explode(F.concat(*parts)).alias("m")).select(
        "keyword_set_id", "m.match_type", "m.keyword"
    )


def member_lists(bridge: DataFrame) -> DataFrame:
    """Set table in text-list form; the one place where a set's keywords gather in a row."""

    def listed(mt: str) -> Column:
        mine = F.collect_set(F.when(F.col("match_type") == mt, F.col("keyword")))
        return F.array_join(F.array_sort(mine), T.LIST_JOINER).alias(T.LIST_COLUMNS[mt])

    return bridge.groupBy("keyword_set_id").agg(
        *[listed(mt) for mt in T.MATCH_TYPES],
        F.array_join(F.array_sort(F.collect_set("keyword")), T.LIST_JOINER).alias("positive_keywords"),
    )


def allowed_members(bridge: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Bridge rows whose keyword is allowed; a set left without rows disappears."""
    return bridge.join(allowlist.select("keyword"), "keyword", "left_semi")


def allowed_sets(sets: DataFrame, allowlist: DataFrame) -> DataFrame:
    return member_lists(allowed_members(members(sets), allowlist))


def match_type_counts(sets: DataFrame) -> DataFrame:
    """Keywords and shares per match type; shares are NULL for an empty set."""
    counts = {
        mt: (F.size(T.split_list(c)) if c in sets.columns else F.lit(0)) for mt, c in T.LIST_COLUMNS.items()
    }
    total = sum(counts.values(), F.lit(0))
    return sets.select(
        "keyword_set_id",
        *[n.alias(f"n_{mt.lower()}") for mt, n in counts.items()],
        *[F.when(total > 0, n / total).alias(f"share_{mt.lower()}") for mt, n in counts.items()],
    )


def planner_features(bridge: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation (NULL below two values) and p90 of each statistic per group.

    The statistics are unpivoted, so one aggregation and one percentile pass serve all of them.
    """
    long = bridge.join(stats, "keyword").unpivot([*keys, "keyword"], list(STATS), "stat", "value")
    long = long.filter(F.col("value").isNotNull())
    group = [*keys, "stat"]
    moments = long.groupBy(*group).agg(
        F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_pop("value")).alias("std")
    )
    return moments.join(percentile(long, group, "value", 0.9, "p90"), group)


def set_planner_features(bridge: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per set: the nine planner columns over its distinct keywords."""
    one = bridge.select("keyword_set_id", "keyword").distinct()
    long = planner_features(one, stats, ["keyword_set_id"])
    wide = long.groupBy("keyword_set_id").pivot("stat", list(STATS)).agg(
        F.max("mean").alias("mean"), F.max("std").alias("std"), F.max("p90").alias("p90")
    )
    return bridge.select("keyword_set_id").distinct().join(wide, "keyword_set_id", "left")


def match_type_planner_features(bridge: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per set: the nine planner columns for each match type."""
    long = planner_features(bridge, stats, ["keyword_set_id", "match_type"])
    label = F.concat_ws("_", F.lower("match_type"), "stat")
    names = [f"{mt.lower()}_{s}" for mt in T.MATCH_TYPES for s in STATS]
    wide = long.withColumn("label", label).groupBy("keyword_set_id").pivot("label", names).agg(
        F.max("mean").alias("mean"), F.max("std").alias("std"), F.max("p90").alias("p90")
    )
    return bridge.select("keyword_set_id").distinct().join(wide, "keyword_set_id", "left")


def set_overlaps(bridge: DataFrame) -> DataFrame:
    """Set pairs that share a keyword: shared and union sizes, Jaccard, share of each set.

    Sets with the same content are paired once, as one content, and the pairs are spread back over
    their ids at the end. Keywords carried by the same contents are counted together, so a keyword
    held by very many sets adds one row per distinct holder list instead of one per keyword.
    """
    content = bridge.groupBy("keyword_set_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set("keyword")), "\u0001"), 256).alias("fp")
    )
    owner = content.groupBy("fp").agg(F.min("keyword_set_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    lead = bridge.join(owner.select(F.col("lead").alias("keyword_set_id"), "fp"), "keyword_set_id").select("fp", "keyword")
    size = lead.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    holders = (
        lead.groupBy("keyword").agg(F.array_sort(F.collect_set("fp")).alias("holders"))
        .groupBy("holders").agg(F.count(F.lit(1)).alias("weight"))
    )
    left = holders.select("holders", "weight", F.explode("holders").alias("fp_a"))
    pairs = left.select("fp_a", "weight", F.explode("holders").alias("fp_b")).filter("fp_a <= fp_b")
    shared = pairs.groupBy("fp_a", "fp_b").agg(F.sum("weight").alias("shared"))
    a, b = content.select(F.col("keyword_set_id").alias("set_a"), F.col("fp").alias("fp_a")), content.select(
        F.col("keyword_set_id").alias("set_b"), F.col("fp").alias("fp_b")
    )
    sized = (
        shared.join(size.select(F.col("fp").alias("fp_a"), F.col("n").alias("n_a")), "fp_a")
        .join(size.select(F.col("fp").alias("fp_b"), F.col("n").alias("n_b")), "fp_b")
    )
    both = sized.unionByName(
        sized.filter("fp_a <> fp_b").select(
            F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "shared"
        )
    )
    n_union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return both.join(a, "fp_a").join(b, "fp_b").filter("set_a < set_b").select(
        "set_a", "set_b", "n_a", "n_b", "shared", n_union.alias("n_union"),
        (F.col("shared") / n_union).alias("jaccard"),
        (F.col("shared") / F.col("n_a")).alias("overlap_a"),
        (F.col("shared") / F.col("n_b")).alias("overlap_b"),
    )


# --- campaign changes ----------------------------------------------------------------------


def _match_key(df: DataFrame) -> DataFrame:
    return df.withColumn("keyword", F.lower("keyword")).select("ad_group", "match_type", "keyword").distinct()


def keywords_to_add(wanted: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Wanted keywords an ad group lacks, numbered in a stable order, up to the operation limit."""
    lacking = _match_key(wanted).join(_match_key(existing), ["ad_group", "match_type", "keyword"], "left_anti")
    order = [F.col("match_type"), F.col("keyword")]
    out = number_rows(lacking, [], F.col("ad_group"), order, "n")
    return out.filter(F.col("n") <= limit) if limit else out


def keywords_to_remove(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing keywords that are no longer wanted."""
    return _match_key(existing).join(_match_key(wanted), ["ad_group", "match_type", "keyword"], "left_anti")


def campaign_specs(regions: DataFrame, match_types: Sequence[str], title: str) -> DataFrame:
    """Planned campaign, ad group and budget names per region and configured match type."""
    kinds = F.explode(F.array(*[F.lit(m) for m in match_types]))
    t, r, m = F.lit(title), F.col("region"), F.col("match_type")
    return regions.withColumn("match_type", kinds).withColumns(
        {
            "campaign_name": T.campaign_name(t, r, m),
            "ad_group_name": T.ad_group_name(t, r, m),
            "budget_name": T.budget_name(t, r, m),
        }
    )


def version_overlaps(versions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Overlap of the keyword sets of version pairs of one campaign.

    Versions share sets, so the keyword work runs once per set pair; version pairs only look up
    their sets' overlap. The report itself lists pairs, which is why its output is quadratic in the
    versions of a campaign.
    """
    pairs = set_overlaps(bridge)
    same = bridge.groupBy("keyword_set_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("keyword_set_id").alias("set_a"), F.col("keyword_set_id").alias("set_b"), F.col("n").alias("n_a"),
        F.col("n").alias("n_b"), F.col("n").alias("shared"), F.col("n").alias("n_union"),
        F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("overlap_a"), F.lit(1.0).alias("overlap_b"),
    )
    swapped = pairs.select(
        F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"),
        "shared", "n_union", "jaccard", F.col("overlap_b").alias("overlap_a"), F.col("overlap_a").alias("overlap_b"),
    )
    looked = pairs.unionByName(swapped).unionByName(same)
    a = versions.select("campaign", F.col("campaign_version").alias("version_a"), F.col("keyword_set_id").alias("set_a"))
    b = versions.select("campaign", F.col("campaign_version").alias("version_b"), F.col("keyword_set_id").alias("set_b"))
    return a.join(b, "campaign").filter("version_a < version_b").join(looked, ["set_a", "set_b"])


def keyword_differences(raw: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, keyword, side): distinct keywords of one side that the other lacks, one row each."""
    both = [*keys, "keyword"]
    sides = raw.select(*both, F.lit(1).alias("_raw"), F.lit(0).alias("_log")).unionByName(log.select(*both, F.lit(0).alias("_raw"), F.lit(1).alias("_log")))
    held = sides.groupBy(*both).agg(F.max("_raw").alias("_raw"), F.max("_log").alias("_log")).filter("_raw <> _log")
    return held.select(*both, F.when(F.col("_raw") == 1, F.lit("raw_only")).otherwise(F.lit("log_only")).alias("side"))
