"""Candidate keyword sets: pools, ranked lists, padding, de-duplication, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.functions.grouped import exact_sum, top_per_group, with_rank
from bidloom.operators import keyword_sets as K
from bidloom.operators import semantics as E
from bidloom.session import cut_lineage

# Synthetic families in emission order, and the families every segment must have.
FAMILIES = ("allowlist", "top_conv", "semantic", "dispersion", "composite")
REQUIRED_FAMILIES = ("top_conv", "allowlist")
POOL = ["region", "match_type"]


def segments_of(summary: DataFrame) -> DataFrame:
    """Distinct segments of the version table with their parts."""
    return summary.filter(F.col("region").isNotNull()).select(
        T.segment().alias("segment"), "region", "match_types"
    ).distinct()


def segment_pools(segments: DataFrame) -> DataFrame:
    """(segment, region, match_type): a label without types stands for all three."""
    types = T.parse_match_types("match_types")
    every = F.array(*[F.lit(mt) for mt in T.MATCH_TYPES])
    return segments.withColumn("match_type", F.explode(F.when(F.size(types) > 0, types).otherwise(every)))


def word_totals(report: DataFrame) -> DataFrame:
    """The report added up by (region, match type, keyword), as the ranked lists read it; amounts stay exact."""
    return report.groupBy(*POOL, "keyword").agg(exact_sum(F.col("all_conv")).alias("all_conv"), exact_sum(F.col("cost")).alias("cost"))


def pool_keywords(report: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Distinct allowed keywords per (region, match type), from every campaign of the region.

    The region test is on the grouped rows: as a row filter on a freshly cleaned report it would be
    pushed below the joins and run the cleaning expressions again.
    """
    seen = report.groupBy(*POOL, "keyword").agg(F.count("region").alias("_known")).filter("_known > 0")
    return seen.join(allowlist.select("keyword"), "keyword", "left_semi").select(*POOL, "keyword")


def rank_sum(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Sum of the ranks on two metrics, best = 1 on each; the scores are stored and read four times."""
    rows = cut_lineage(rows)
    ranked = with_rank(with_rank(rows, keys, a, "_ra"), keys, b, "_rb")
    return ranked.withColumn("rank_sum", F.col("_ra") + F.col("_rb")).drop("_ra", "_rb")


def performance_scores(
    report: DataFrame, allowlist: DataFrame, volume: str = "all_conv", positive_only: bool = True
) -> DataFrame:
    """Volume, cost and efficiency per pool keyword; empty keywords are never on the allowlist."""
    totals = report.groupBy(*POOL, "keyword").agg(
        exact_sum(F.col(volume)).alias("volume"), F.coalesce(exact_sum(F.col("cost")), F.lit(0.0)).alias("cost"),
        F.count("region").alias("_known"),
    ).filter("_known > 0").drop("_known")
    if positive_only:
        totals = totals.filter("volume > 0")
    totals = totals.join(allowlist.select("keyword"), "keyword", "left_semi")
    return totals.withColumn("efficiency", F.col("volume") / F.greatest("cost", F.lit(0.01)))


def top_by_performance(scores: DataFrame, n: int, keys: Sequence[str] = POOL) -> DataFrame:
    """First n keywords per pool by summed ranks of volume and efficiency, ties by text."""
    ranked = rank_sum(scores, keys, "volume", "efficiency")
    return top_per_group(ranked, keys, [F.col("rank_sum"), F.col("keyword")], n, "pos")


def top_by_priority(pool: DataFrame, allowlist: DataFrame, n: int) -> DataFrame:
    """First n observed keywords per pool in allowlist order."""
    placed = pool.join(allowlist, "keyword")
    return top_per_group(placed, POOL, [F.col("priority")], n, "pos")


def pad_lists(ranked: DataFrame, pools: DataFrame, families: Sequence[str], allowlist: DataFrame, n: int) -> DataFrame:
    """Ordered lists of n keywords per (pool, family): ranked ones, then allowlist order.

    A list for a smaller cap is the head of this one: padding only starts when the ranked keywords
    run out. The first n allowlist entries are enough to pad, so at most 2n rows exist per list.
    """
    tier0 = ranked.select(*POOL, "family", "keyword", F.lit(0).alias("tier"), F.col("pos").alias("place"))
    head = allowlist.filter(F.col("priority") <= n).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("priority", "keyword"))).alias("a")
    ).select("a").scalar()
    slots = pools.select(*POOL).distinct().withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    offered = slots.withColumn("w", F.explode(head)).select(
        *POOL, "family", F.col("w.keyword").alias("keyword"), F.lit(1).alias("tier"), F.col("w.priority").alias("place")
    )
    tier1 = offered.join(tier0.select(*POOL, "family", "keyword"), [*POOL, "family", "keyword"], "left_anti")
    both = tier0.unionByName(tier1.select(*tier0.columns))
    return top_per_group(both, [*POOL, "family"], [F.col("tier"), F.col("place")], n, "pos").drop("place")


def pool_lists(
    report: DataFrame,
    allowlist: DataFrame,
    vectors: DataFrame,
    anchors: DataFrame,
    pools: DataFrame,
    n: int,
    families: Sequence[str] = FAMILIES,
) -> DataFrame:
    """Padded lists of every family for the wanted pools: (region, match_type, family, pos, tier, keyword)."""
    wanted = pools.select(*POOL).distinct()
    report = cut_lineage(word_totals(report))  # the report is read once; its words are few beside its rows
    pool = cut_lineage(pool_keywords(report, allowlist).join(wanted, POOL, "left_semi"))
    lists = []
    if "top_conv" in families:
        scores = performance_scores(report, allowlist).join(wanted, POOL, "left_semi")
        lists.append(top_by_performance(scores, n).withColumn("family", F.lit("top_conv")))
    if "allowlist" in families:
        lists.append(top_by_priority(pool, allowlist, n).withColumn("family", F.lit("allowlist")))
    if {"semantic", "dispersion", "composite"} & set(families):
        known = cut_lineage(pool.join(E.with_anchor_similarity(vectors, anchors), "keyword"))
        if "semantic" in families:
            lists.append(E.top_by_similarity(known, POOL, n).withColumn("family", F.lit("semantic")))
        if "dispersion" in families:
            lists.append(E.top_by_dispersion(known, POOL, n).withColumn("family", F.lit("dispersion")))
        if "composite" in families:
            lists.append(E.top_by_composite(known, POOL, n).withColumn("family", F.lit("composite")))
    columns = [*POOL, "family", "keyword", "pos"]
    ranked = lists[0].select(*columns)
    for more in lists[1:]:
        ranked = ranked.unionByName(more.select(*columns))
    return pad_lists(ranked, pools, families, allowlist, n)


def synthetic_members(pools: DataFrame, lists: DataFrame, caps: Sequence[int]) -> DataFrame:
    """(segment, region, match_types, family, n, match_type, keyword): list heads per cap."""
    sizes = F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(caps))]))
    return pools.join(lists, POOL).withColumn("n", sizes).filter(F.col("pos") <= F.col("n")).select(
        "segment", "region", "match_types", "family", "n", "match_type", "keyword"
    )


def _family_order() -> Column:
    order = F.lit(len(FAMILIES))
    for i, family in enumerate(FAMILIES):
        order = F.when(F.col("family") == family, F.lit(i)).otherwise(order)
    return order


def historical_candidates(summary: DataFrame, members: DataFrame) -> DataFrame:
    """Sets seen in a segment that still have allowed keywords."""
    alive = members.select("keyword_set_id").distinct()
    seen = summary.filter(F.col("region").isNotNull() & F.col("keyword_set_id").isNotNull()).select(
        T.segment().alias("segment"), "region", "match_types", "keyword_set_id"
    ).distinct()
    return seen.join(alive, "keyword_set_id", "left_semi").withColumn("source", F.lit("historical"))


def set_fingerprints(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return members.groupBy(*keys).agg(T.fingerprint(F.collect_set("keyword")).alias("fp"))


def taken_numbers(existing: DataFrame) -> DataFrame:
    """(base, taken): the numbers in use behind each id that ends in an underscore and a whole number without leading zeros."""
    parts = [F.regexp_extract("keyword_set_id", r"^((?s:.*)_)(0|[1-9][0-9]{0,8})$", i) for i in (1, 2)]
    split = existing.select(parts[0].alias("base"), parts[1].try_cast("int").alias("number")).filter("base <> ''")
    return split.groupBy("base").agg(F.collect_set("number").alias("taken"))


def numbers_past(rows: DataFrame, order: Sequence[str], existing: DataFrame) -> DataFrame:
    """``rows`` (order, base) with ``_i``: numbers from 1 in order, each past the one before it and past those its base has in use.

    The rows are the new sets of one build, a few per segment, cap and family; one row lists them.
    """
    none = F.array().cast("array<int>")
    asked = rows.join(taken_numbers(existing), "base", "left").withColumn("taken", F.coalesce("taken", none))
    listed = asked.agg(F.array_sort(F.collect_list(F.struct(*order, "taken"))).alias("rows"))

    def place(last: Column, taken: Column) -> Column:
        free = F.filter(F.sequence(last + 1, last + 1 + F.size(taken)), lambda j: ~F.array_contains(taken, j))
        return F.array_min(free)

    def step(acc: Column, row: Column) -> Column:
        number = place(acc["last"], row["taken"])
        return F.struct(number.alias("last"), F.array_append(acc["numbers"], number).alias("numbers"))

    numbers = F.aggregate("rows", F.struct(F.lit(0).alias("last"), none.alias("numbers")), step, lambda acc: acc["numbers"])
    placed = listed.select(F.explode(F.arrays_zip("rows", numbers.alias("_i"))).alias("r"))
    return placed.select(*[F.col(f"r.rows.{c}").alias(c) for c in order], F.col("r._i").alias("_i"))


def number_synthetic_sets(
    synthetic: DataFrame, historical: DataFrame, members: DataFrame, prefix: str = "synthetic", existing: DataFrame | None = None
) -> DataFrame:
    """Emitted sets with ids: (segment, region, match_types, family, n, source, keyword_set_id, is_new).

    Emission order is segment, cap, family. A variant equal to the performance list or to an earlier
    variant of the same cap is dropped. Equal contents in one region share an id: the historical one
    if any, else the id made at the first emission. Numbers go past those in use in ``existing``. The
    table has one row per segment, cap and family, so its windows are small by construction.
    """
    sets = set_fingerprints(synthetic, ["segment", "region", "match_types", "family", "n"]).withColumn("_f", _family_order())
    variant = Window.partitionBy("segment", "n", "fp", F.col("family") == "allowlist").orderBy("_f")
    kept = sets.withColumn("_v", F.row_number().over(variant)).filter((F.col("_v") == 1) | (F.col("family") == "allowlist"))
    used = historical.select("keyword_set_id", "region", "segment").groupBy("keyword_set_id").agg(
        F.min_by("region", "segment").alias("region")
    )
    known = (
        set_fingerprints(members, ["keyword_set_id"]).join(used, "keyword_set_id")
        .groupBy("region", "fp").agg(F.min("keyword_set_id").alias("known_id"))
    )
    order = [F.col("segment"), F.col("n"), F.col("_f")]
    first = Window.partitionBy("region", "fp").orderBy(*order)
    placed = kept.join(known, ["region", "fp"], "left").withColumn(
        "is_new", F.col("known_id").isNull() & (F.row_number().over(first) == 1)
    )
    suffix = F.concat("family", F.lit("_n"), F.col("n").cast("string"))
    if existing is None:
        everything = Window.partitionBy().orderBy(*order)
        numbered = placed.withColumn("_i", F.sum(F.col("is_new").cast("int")).over(everything))
    else:
        base = F.regexp_replace(T.synthetic_id(prefix, F.col("segment"), suffix, F.lit(0)), "0$", "")
        placed = cut_lineage(placed)
        new = placed.filter("is_new").select("segment", "n", "_f", base.alias("base"))
        numbered = placed.join(numbers_past(new, ["segment", "n", "_f"], existing), ["segment", "n", "_f"], "left")
    made = F.when(F.col("is_new"), T.synthetic_id(prefix, F.col("segment"), suffix, F.col("_i")))
    shared = F.max(made).over(Window.partitionBy("region", "fp"))
    return numbered.select(
        "segment", "region", "match_types", "family", "n",
        F.concat(F.lit("synthetic_"), suffix).alias("source"),
        F.coalesce("known_id", shared).alias("keyword_set_id"),
        "is_new", "_f",
    )


def unused_index(spark: SparkSession, existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids that no existing set uses."""
    return wanted.join(existing.select("keyword_set_id"), "keyword_set_id", "left_anti")


def build_candidates(
    summary: DataFrame,
    report: DataFrame,
    members: DataFrame,
    allowlist: DataFrame,
    vectors: DataFrame,
    anchors: DataFrame,
    caps: Sequence[int] = (10, 20, 40),
    families: Sequence[str] = FAMILIES,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, extended set table).

    ``summary`` is already scoped; ``members`` is the long bridge of the given sets.
    """
    allowed = K.allowed_members(members, allowlist)
    segments = segments_of(summary)
    pools = segment_pools(segments)
    history = historical_candidates(summary, allowed)
    lists = pool_lists(report, allowlist, vectors, anchors, pools, max(caps), families)
    synthetic = cut_lineage(synthetic_members(pools, lists, caps))
    emitted = cut_lineage(number_synthetic_sets(synthetic, history, allowed, existing=members.select("keyword_set_id").distinct()))
    rows = history.select("segment", "region", "match_types", "keyword_set_id", "source", F.lit(0).alias("n"), F.lit(0).alias("_f"))
    rows = rows.unionByName(emitted.select(*rows.columns))
    once = Window.partitionBy("segment", "keyword_set_id").orderBy("n", "_f")
    candidates = rows.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r", "n", "_f")
    new = emitted.filter("is_new").select("segment", "family", "n", "keyword_set_id")
    made = synthetic.join(new, ["segment", "family", "n"]).select("keyword_set_id", "match_type", "keyword")
    extended = K.member_lists(allowed.select("keyword_set_id", "match_type", "keyword").unionByName(made))
    return candidates, extended


def pool_counts(pool: DataFrame, lists: DataFrame) -> DataFrame:
    """Per pool and family: observed keywords, ranked ones and padded ones."""
    seen = pool.groupBy(*POOL).agg(F.count(F.lit(1)).alias("n_intersection"))
    return lists.groupBy(*POOL, "family").agg(
        F.count_if(F.col("tier") == 0).alias("n_ranked"), F.count_if(F.col("tier") == 1).alias("n_padded")
    ).join(seen, POOL, "left").withColumn("n_intersection", F.coalesce("n_intersection", F.lit(0)))


def verify_candidates(
    candidates: DataFrame, extended: DataFrame, allowlist: DataFrame, caps: Sequence[int] = (10, 20, 40)
) -> DataFrame:
    """Issue rows (issue, subject, detail): missing sources, unknown ids, words off the allowlist."""
    wanted = F.array(*[F.lit(f"synthetic_{f}_n{n}") for n in caps for f in REQUIRED_FAMILIES])
    expected = candidates.select("segment").distinct().withColumn("source", F.explode(wanted))
    absent = expected.join(candidates.select("segment", "source").distinct(), ["segment", "source"], "left_anti")
    ids = candidates.select("keyword_set_id").distinct()
    unknown = ids.join(extended.select("keyword_set_id"), "keyword_set_id", "left_anti")
    words = K.members(extended.join(ids, "keyword_set_id", "left_semi"))
    off_list = words.join(allowlist.select("keyword"), "keyword", "left_anti")
    return (
        absent.select(F.lit("missing_source").alias("issue"), F.col("segment").alias("subject"), F.col("source").alias("detail"))
        .unionByName(unknown.select(F.lit("missing_set").alias("issue"), F.col("keyword_set_id").alias("subject"), F.lit("").alias("detail")))
        .unionByName(off_list.select(F.lit("off_allowlist").alias("issue"), F.col("keyword_set_id").alias("subject"),
                                     F.concat_ws(": ", "match_type", "keyword").alias("detail")))
    )


def target_set_size(summary: DataFrame, members: DataFrame, top_n: int, fallback: int) -> DataFrame:
    """Median positive set size of a segment, truncated and clamped to [5, top_n]."""
    sizes = members.select("keyword_set_id", "keyword").distinct().groupBy("keyword_set_id").agg(F.count(F.lit(1)).alias("n"))
    seen = summary.select(T.segment().alias("segment"), "keyword_set_id").distinct()
    clamp = F.greatest(F.lit(5), F.least(F.floor(F.median("n")).cast("int"), F.lit(top_n)))
    medians = seen.join(sizes, "keyword_set_id").groupBy("segment").agg(clamp.alias("set_size"))
    return seen.select("segment").distinct().join(medians, "segment", "left").withColumn("set_size", F.coalesce("set_size", F.lit(fallback)))


def outputs_current(spark: SparkSession, inputs: Sequence[str], outputs: Sequence[str]) -> bool:
    """True when every output is at least as new as the newest input, judged by file metadata."""

    def times(paths: Sequence[str]) -> list:
        found = []
        for path in paths:
            try:
                files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            except Exception as exc:
                if "PATH_NOT_FOUND" in str(exc):
                    continue
                raise
            found.append(files.agg(F.max("modificationTime")).first()[0])
        return [t for t in found if t is not None]

    made, given = times(outputs), times(inputs)
    return bool(given) and len(made) == len(outputs) and min(made) >= max(given)
