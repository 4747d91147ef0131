"""Embedding features of keywords and keyword sets, and embedding-based selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from bidloom.functions import text as T
from bidloom.functions.grouped import percentile, top_per_group, with_rank
from bidloom.session import cut_lineage, stored_table

# Limit of the pool states on the driver; pools come from settings.
MAX_POOLS = 10000
# Rows of one side of a distance tile, and its distances.
BLOCK_ROWS = 2048
TILE_PAIRS = 1 << 18
# Numbers of the vectors of one block of a pool, 32 MB.
BLOCK_VALUES = 1 << 22
TINY = 1e-12


def anchor_matrix(anchors: DataFrame) -> np.ndarray:
    """Anchor vectors as a matrix; anchors are the texts named in the settings."""
    rows = anchors.select("embedding").collect()
    return np.array([r["embedding"] for r in rows], dtype=float)


def with_anchor_similarity(vectors: DataFrame, anchors: DataFrame, name: str = "sim") -> DataFrame:
    """Largest dot product with any anchor; one matrix product per Arrow batch."""
    matrix = anchor_matrix(anchors)

    @F.pandas_udf(DoubleType())
    def best(batch: pd.Series) -> pd.Series:
        return pd.Series((np.stack(batch.to_numpy()) @ matrix.T).max(axis=1))

    return vectors.withColumn(name, best("embedding"))


def semantic_features(bridge: DataFrame, vectors: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cohesion, dispersion, anchor similarity mean and p90 per group of the bridge.

    With S the sum of vectors, U the sum of unit vectors and n the count, the mean pairwise cosine is
    (|U|^2 - sum|u|^2) / (n (n - 1)), and for L2-normalised vectors the mean cosine distance to the
    centroid c = S / n is 1 - U.c / (n (|c| + 1e-12)). Both need sums only, so no pairs are formed
    and the vector sums combine before the shuffle.
    """
    scored = with_anchor_similarity(vectors, anchors).select(
        "keyword", "sim", array_to_vector("embedding").alias("_v"),
        F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("_norm"),
    )
    rows = bridge.join(scored, "keyword").withColumn("_inv", 1.0 / F.greatest("_norm", F.lit(TINY)))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("sim").alias("course_sim_mean"),
        F.sum((F.col("_norm") * F.col("_inv")) ** 2).alias("_self"),
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("_c"),
        vector_to_array(Summarizer.sum(F.col("_v"), F.col("_inv"))).alias("_u"),
    )

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    n = F.col("n")
    cohesion = F.when(n > 1, (dot("_u", "_u") - F.col("_self")) / (n * (n - 1)))
    dispersion = 1.0 - dot("_u", "_c") / (n * (F.sqrt(dot("_c", "_c")) + F.lit(TINY)))
    means = sums.select(*keys, "n", cohesion.alias("cohesion"), dispersion.alias("dispersion"), "course_sim_mean")
    return means.join(percentile(rows.select(*keys, "sim"), keys, "sim", 0.9, "course_sim_p90"), list(keys))


def set_semantics(bridge: DataFrame, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per set over its distinct keywords: keyword count and the four embedding features."""
    one = bridge.select("keyword_set_id", "keyword").distinct()
    stats = semantic_features(one, vectors, anchors, ["keyword_set_id"])
    counts = one.groupBy("keyword_set_id").agg(F.count(F.lit(1)).alias("n_positive"))
    return counts.join(stats, "keyword_set_id", "left").select(
        "keyword_set_id", "n_positive",
        F.col("cohesion").alias("embed_cohesion"), F.col("dispersion").alias("embed_dispersion"),
        F.col("course_sim_mean").alias("embed_course_sim_mean"), F.col("course_sim_p90").alias("embed_course_sim_p90"),
    )


def match_type_semantics(bridge: DataFrame, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """The four features per match type; cohesion and dispersion need two keywords."""
    stats = semantic_features(bridge, vectors, anchors, ["keyword_set_id", "match_type"])
    several = F.col("n") > 1
    wide = stats.groupBy("keyword_set_id").pivot("match_type", list(T.MATCH_TYPES)).agg(
        F.max(F.when(several, F.col("cohesion"))).alias("cohesion"),
        F.max(F.when(several, F.col("dispersion"))).alias("dispersion"),
        F.max("course_sim_mean").alias("course_sim_mean"),
        F.max("course_sim_p90").alias("course_sim_p90"),
    )
    names = {
        f"{mt}_{stat}": f"embed_{stat}_{mt.lower()}"
        for mt in T.MATCH_TYPES
        for stat in ("cohesion", "dispersion", "course_sim_mean", "course_sim_p90")
    }
    return bridge.select("keyword_set_id").distinct().join(wide.withColumnsRenamed(names), "keyword_set_id", "left")


# --- selection -----------------------------------------------------------------------------


def top_by_similarity(pool: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """First n keywords per pool by anchor similarity, ties by text."""
    return top_per_group(pool, keys, [F.col("sim").desc(), F.col("keyword")], n, "pos")


def _matrix(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Vectors of one group as a matrix; each row has its own in one of the columns, and all have one length."""
    sizes = pc.coalesce(*[pc.list_value_length(c) for c in columns])
    width = pc.max(sizes).as_py()
    if sizes.null_count or pc.min(sizes).as_py() != width:
        raise ValueError("the vectors of a pool must be there and have one length")
    out = np.empty((len(sizes), width))
    for column in columns:
        flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
        out[column.is_valid().to_numpy()] = np.concatenate(flat).reshape(-1, width)
    return out + 0.0  # -0.0 and 0.0 are one value


def _distance_sums(vectors: np.ndarray, words: np.ndarray, first: int, alone: bool, tile_rows: int) -> np.ndarray:
    """Sum of distances of each row to rows of another keyword.

    ``alone``: among all rows. Otherwise between the ``first`` rows and the others, whose keywords differ. Each distance is
    taken once and counts for both ends; a tile of about ``TILE_PAIRS`` of them is in memory at a time.
    """
    n = len(vectors)
    squares, sums = (vectors * vectors).sum(axis=1), np.zeros(n)
    same = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)[1]
    repeated = same.max(initial=-1) + 1 < n
    width = max(1, TILE_PAIRS // tile_rows)

    def tile(a: slice, b: slice) -> np.ndarray:
        dist = vectors[a] @ vectors[b].T
        dist *= -2.0
        dist += squares[a, None]
        dist += squares[b]
        np.maximum(dist, 0.0, out=dist)
        if repeated:  # rounding leaves up to 1e-8 between equal vectors
            dist[same[a, None] == same[b]] *= 0.0
        np.sqrt(dist, out=dist)
        if alone:
            dist[words[a, None] == words[b]] = 0.0
        return dist

    for start in range(0, first, tile_rows):
        a = slice(start, min(start + tile_rows, first))
        if alone:
            for at in range(a.start, a.stop, width):
                b = slice(at, min(at + width, a.stop))
                sums[a] += tile(a, b).sum(axis=1)
        for at in range(a.stop if alone else first, n, width):
            b = slice(at, min(at + width, n))
            dist = tile(a, b)
            sums[a] += dist.sum(axis=1)
            sums[b] += dist.sum(axis=0)
    return sums


def mean_distance_to_pool(
    pool: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """Mean Euclidean distance of each keyword to the other keywords of its pool, 0 when alone.

    A pool is cut into hash blocks of about ``block_values`` numbers, or one block when it has fewer. Every pair of blocks meets
    in one task, which returns one partial sum per keyword: no pairs leave the task. A row moves once per block of its pool, so
    what moves is the input until a pool passes ``block_values``; a hot pool spreads over as many equal tasks as it has pairs of
    blocks. Tasks compare ``block_rows`` rows at a time.
    """
    keys = list(keys)
    # stored: so small a table is met without moving the vectors
    sizes = stored_table(
        pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("embedding")).cast("bigint").alias("_width")), "pool-sizes"
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_width") / F.lit(block_values))).cast("int")
    # numbers that are single precision move as such
    short = F.col("embedding").cast("array<float>")
    is_short = short.cast("array<double>") == F.col("embedding").cast("array<double>")
    cut = (
        pool.select(*keys, "keyword", F.when(is_short, short).alias("_short"), F.when(~is_short, F.col("embedding")).alias("_long"))
        .join(sizes, keys)
        .withColumn("_block", F.pmod(F.xxhash64("keyword"), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*keys, F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "keyword", "_short", "_long")
    )
    schema = StructType([*[pool.schema[k] for k in keys], pool.schema["keyword"], StructField("_sum", DoubleType())])

    def partial(rows: pa.Table) -> pa.Table:
        low, high = rows["_low"][0].as_py(), rows["_high"][0].as_py()
        order = np.argsort(rows["_block"].to_numpy() != low, kind="stable")
        words = pd.factorize(rows["keyword"].to_pandas())[0]  # equal keywords are in one block
        first = int((rows["_block"].to_numpy() == low).sum())
        sums = _distance_sums(_matrix([rows["_short"], rows["_long"]])[order], words[order], first, low == high, block_rows)
        return rows.select([*keys, "keyword"]).take(order).append_column("_sum", pa.array(sums))

    parts = cut.groupBy(*keys, "_low", "_high").applyInArrow(partial, schema)
    totals = parts.groupBy(*keys, "keyword").agg(F.sum("_sum").alias("_sum")).join(sizes, keys)
    mean = F.when(F.col("_n") > 1, F.round(F.col("_sum") / (F.col("_n") - 1), 9)).otherwise(F.lit(0.0))
    return totals.select(*keys, "keyword", mean.alias("mean_distance"))


def top_by_composite(pool: DataFrame, keys: Sequence[str], n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First n keywords by the summed ranks of anchor similarity and mean distance, ties by text."""
    distances = mean_distance_to_pool(pool, keys, block_rows)
    # stored: the two ranks must read the same distances
    scored = cut_lineage(pool.select(*keys, "keyword", "sim").join(distances, [*keys, "keyword"]))
    ranked = with_rank(with_rank(scored, keys, "sim", "_ra"), keys, "mean_distance", "_rb")
    ranked = ranked.withColumn("rank_sum", F.col("_ra") + F.col("_rb")).drop("_ra", "_rb")
    return top_per_group(ranked, keys, [F.col("rank_sum"), F.col("keyword")], n, "pos")


def top_by_dispersion(pool: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Greedy keyword list per pool that keeps the set's dispersion largest at every step.

    The list starts with the first keyword in text order. Each step is one Spark job over all pools:
    every task scores its rows against the small pool states (vector sum, unit-vector sum, words
    picked) and sends its best row per pool. The states are the only thing on the driver; a pool is
    a region and match type, and their number is checked.
    """
    keys = list(keys)
    rows = cut_lineage(pool.select(*keys, "keyword", "embedding"))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("keyword", "embedding"), "keyword").alias("p"))
    seeds = first.limit(MAX_POOLS + 1).collect()
    if len(seeds) > MAX_POOLS:
        raise ValueError("too many pools to hold their states in memory")
    state: dict[tuple, dict] = {}

    def take(row) -> None:
        v = np.array(row["p"]["embedding"], dtype=float)
        s = state.setdefault(tuple(row[k] for k in keys), {"s": np.zeros_like(v), "u": np.zeros_like(v), "words": []})
        s["s"] = s["s"] + v
        s["u"] = s["u"] + v / max(np.linalg.norm(v), TINY)
        s["words"].append(row["p"]["keyword"])

    for row in seeds:
        take(row)
    schema = StructType([*[pool.schema[k] for k in keys], rows.schema["keyword"], rows.schema["embedding"], StructField("score", DoubleType())])
    for _ in range(n - 1):
        shared = rows.sparkSession.sparkContext.broadcast(state)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pools, best = shared.value, {}
            for batch in batches:
                for key, group in batch.groupby(keys, dropna=False, sort=False):
                    key = key if isinstance(key, tuple) else (key,)
                    s = pools[tuple(None if isinstance(k, float) and k != k else k for k in key)]
                    group = group[~group["keyword"].isin(s["words"])]
                    if group.empty:
                        continue
                    v = np.stack(group["embedding"].to_numpy())
                    count = len(s["words"]) + 1
                    total = s["s"] + v
                    unit = s["u"] + v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), TINY)
                    norm = np.linalg.norm(total, axis=1) / count
                    gain = 1.0 - (unit * total).sum(axis=1) / count / (count * (norm + TINY))
                    top = group.assign(score=gain).sort_values(["score", "keyword"], ascending=[False, True]).iloc[:1]
                    old = best.get(key)
                    if old is None or (-top["score"].iloc[0], top["keyword"].iloc[0]) < (-old["score"].iloc[0], old["keyword"].iloc[0]):
                        best[key] = top
            if best:
                yield pd.concat(list(best.values()))[[f.name for f in schema.fields]]

        found = (
            rows.mapInPandas(score, schema).groupBy(*keys)
            .agg(F.min_by(F.struct("keyword", "embedding"), F.struct(-F.col("score"), F.col("keyword"))).alias("p"))
            .collect()
        )
        for row in found:
            take(row)
        shared.unpersist()
        if not found:
            break
    out = [(*key, word, i + 1) for key, s in state.items() for i, word in enumerate(s["words"])]
    listed = StructType([*[pool.schema[k] for k in keys], pool.schema["keyword"]]).add("pos", IntegerType())
    return rows.sparkSession.createDataFrame(out, listed)
