"""Mean distances to a pool: blocks against brute force, and what moves for them."""

import numpy as np
import pytest

from bidloom.operators import semantics as E

SCHEMA = "pool string, keyword string, embedding array<double>"


def plain(rows):
    """Summed distances to rows of other keywords by (pool, keyword), over all other rows of the pool."""
    out = {}
    for pool, word, v in rows:
        if pool is not None:
            there = [(w, o) for p, w, o in rows if p == pool]
            far = sum(float(np.linalg.norm(np.array(v) - np.array(o))) for w, o in there if w != word)
            out[pool, word] = out.get((pool, word), 0.0) + (far / (len(there) - 1) if len(there) > 1 else 0.0)
    return out


def moved(df):
    """Rows that ``df`` wrote to shuffles when it ran."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        children, metrics = node.children(), node.metrics()
        nodes += [children.apply(i) for i in range(children.size())]
        if name == "ShuffleExchangeExec":
            total += metrics.apply("shuffleRecordsWritten").value()
    return total


@pytest.mark.parametrize("block_values", [1 << 22, 150])
@pytest.mark.parametrize("block_rows", [5, 2048])
def test_blocks_equal_brute_force(spark, block_rows, block_values):
    rng = np.random.default_rng(11)
    rows = [("a", f"k{i:02d}", rng.normal(size=8).tolist()) for i in range(60)]
    rows += [("a", f"s{i:02d}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(30)]  # moved in single precision
    rows += [("a", "k03", rng.normal(size=8).tolist()), ("a", "k04", rows[4][2]), ("a", None, rng.normal(size=8).tolist())]
    rows += [("a", f"e{i:02d}", rows[0][2]) for i in range(12)]  # one vector under many keywords
    rows += [("b", f"k{i:02d}", rng.normal(size=3).tolist()) for i in range(20)]  # another length
    rows += [("one", "k00", [1.0, 2.0]), (None, "k00", [1.0, 2.0]), (None, "k01", [3.0, 2.0])]
    got = E.mean_distance_to_pool(spark.createDataFrame(rows, SCHEMA), ["pool"], block_rows, block_values).collect()
    want = plain(rows)
    assert {(r.pool, r.keyword) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert abs(r.mean_distance - want[r.pool, r.keyword]) <= 1.01e-9
    assert len({r.mean_distance for r in got if r.pool == "a" and r.keyword in ("k00", *(f"e{i:02d}" for i in range(12)))}) == 1


def words(spark, n):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([("p", f"k{i:03d}", rng.normal(size=4).tolist()) for i in range(n)], SCHEMA)


def test_rows_move_once_whatever_the_rows_of_a_tile(spark):
    met = E.mean_distance_to_pool(words(spark, 600), ["pool"], block_rows=8)
    assert len(met.collect()) == 600
    assert 600 <= moved(met) <= 3 * 600


def test_rows_move_once_per_block(spark):
    met = E.mean_distance_to_pool(words(spark, 600), ["pool"], block_rows=8, block_values=600)
    assert len(met.collect()) == 600
    assert 4 * 600 <= moved(met) <= 10 * 600  # four blocks


@pytest.mark.parametrize("vector", [None, [1.0]])
def test_a_vector_that_does_not_fit_stops_the_job(spark, vector):
    df = spark.createDataFrame([("p", "x", [1.0, 2.0]), ("p", "y", vector)], SCHEMA)
    with pytest.raises(Exception, match="one length"):
        E.mean_distance_to_pool(df, ["pool"]).collect()
