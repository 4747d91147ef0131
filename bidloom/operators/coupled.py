"""One keyword set per segment for a window of days, under limits that couple segments: a cap per day and an order of regional spend.

Each day has a price on spend for its cap and a price for each step of the regional order. At given prices segments and days separate: a
segment takes the set with the greatest priced value over the days, with the best budget of each day inside the curve's bounds. The total
plus the priced caps is an upper bound on every plan, and it falls as prices move with what the priced plan overspends or misorders.
Prices are rows of (date, region); what the driver sees is one row per day, region and round.

The sets met on the way are turned into plans that keep all limits by exact allocation on the grid; then, as long as one helps, single
segments change their set. The best plan is returned with its gap to the best bound. All trial plans of a round are one job.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators.planning import allocate_budgets, allocate_ordered
from bidloom.session import cut_lineage

Choice = dict[str, str]  # segment -> set


def _priced_days(curve: DataFrame, step: float, penalty: float) -> DataFrame:
    """(segment, keyword_set_id, date, region, points): the curve's budgets and values of one day in one row."""
    worth = F.round(F.col("level") - F.lit(penalty) * F.col("budget"), 9).alias("worth")
    points = F.array_sort(F.collect_list(F.struct("budget", worth))).alias("points")
    named = curve.withColumn("region", T.region_of_segment())
    return named.groupBy("segment", "keyword_set_id", "date", "region").agg(points)


def _answer(days: DataFrame, prices: DataFrame) -> tuple[float, Choice, dict]:
    """The best sets at the prices, their total value, and the spend per (date, region)."""
    priced = days.join(prices, ["date", "region"]).withColumn(
        "best", F.array_max(F.transform("points", lambda p: F.struct((p["worth"] - F.col("price") * p["budget"]).alias("v"), (-p["budget"]).alias("nb"))))
    )
    per_set = priced.groupBy("segment", "region", "keyword_set_id").agg(F.sum("best.v").alias("v"), F.collect_list(F.struct("date", (-F.col("best.nb")).alias("b"))).alias("spend"))
    chosen = per_set.groupBy("segment", "region").agg(F.min_by(F.struct("keyword_set_id", "v", "spend"), F.struct(-F.col("v"), F.col("keyword_set_id"))).alias("c"))
    total, sets, spend = 0.0, {}, {}
    for r in chosen.select("segment", "region", "c.*").collect():  # one row per segment, with its days
        total, sets[r["segment"]] = total + r["v"], r["keyword_set_id"]
        for day in r["spend"]:
            spend[day["date"], r["region"]] = spend.get((day["date"], r["region"]), 0.0) + day["b"]
    return total, sets, spend


def dual_ascent(
    days: DataFrame, caps: dict[datetime.date, float], order: Sequence[str] = (), rounds: int = 30, start: float = 0.0, target: float | None = None
) -> tuple[float, list[Choice]]:
    """The least upper bound met and the sets of every round, latest first; ``start`` is the first price on spend.

    Steps go along what the priced plan overspends and misorders, as long as the bound's distance to ``target`` (a known plan's value)
    allows, and halve while the bound does not fall.
    """
    regions = sorted({r["region"] for r in days.select("region").distinct().collect()})
    dates = sorted(caps)
    cap_price = np.full(len(dates), start)
    order_price = np.zeros((len(dates), max(0, len(order) - 1)))
    bound, met, stale, scale = np.inf, [], 0, 1.0
    best = (cap_price, order_price)
    for _ in range(rounds):
        price = {}
        for i, d in enumerate(dates):
            for r in regions:
                # Spend of the j-th region eases the j-th step of the order and strains the one before it.
                eased = order_price[i, order.index(r)] if r in order[:-1] else 0.0
                strained = order_price[i, order.index(r) - 1] if r in order[1:] else 0.0
                price[d, r] = float(cap_price[i] - eased + strained)
        rows = days.sparkSession.createDataFrame([(d, r, p) for (d, r), p in price.items()], "date date, region string, price double")
        total, sets, spend = _answer(days, rows)
        value = total + float(sum(cap_price[i] * caps[d] for i, d in enumerate(dates)))
        met.insert(0, sets)
        over = np.array([sum(spend.get((d, r), 0.0) for r in regions) - caps[d] for d in dates])
        wrong = np.array([[spend.get((d, b), 0.0) - spend.get((d, a), 0.0) for a, b in zip(order, order[1:])] for d in dates]).reshape(order_price.shape)
        if value < bound - 1e-9:
            bound, best, stale = value, (cap_price, order_price), 0
        else:
            stale += 1
            if stale >= 2:
                scale, stale = scale / 2, 0
                cap_price, order_price = best
        move_cap = np.where((cap_price <= 0) & (over < 0), 0.0, over)
        move_order = np.where((order_price <= 0) & (wrong < 0), 0.0, wrong)
        length = float((move_cap**2).sum() + (move_order**2).sum())
        if length == 0:
            break  # the priced plan keeps all limits that have a price: the bound is met
        goal = target if target is not None else value - 0.05 * max(1.0, abs(value))
        size = scale * max(value - goal, 1e-6) / length
        cap_price = np.maximum(0.0, cap_price + size * move_cap)
        order_price = np.maximum(0.0, order_price + size * move_order)
    return bound, met


def _plans(curve: DataFrame, choices: Sequence[Choice], caps: dict, step: float, penalty: float, order: Sequence[str]) -> DataFrame:
    """Plans of several choices at once: (choice, date, ...) rows of the exact allocation."""
    spark = curve.sparkSession
    picked = spark.createDataFrame([(i, s, k) for i, c in enumerate(choices) for s, k in c.items()], "choice int, segment string, keyword_set_id string")
    limits = spark.createDataFrame(list(caps.items()), "date date, cap double")
    fixed = curve.join(picked, ["segment", "keyword_set_id"])
    keys, most = ("choice", "date"), max(caps.values())
    if order:
        return allocate_ordered(fixed, most, step, order, penalty, keys, limits)
    return allocate_budgets(fixed, most, step, penalty, keys, limits)


def _values(plans: DataFrame, n_days: int) -> dict[int, float]:
    """Value of each choice that has a plan on every day."""
    daily = plans.groupBy("choice", "date").agg(F.max("objective").alias("o"))
    rows = daily.groupBy("choice").agg(F.sum("o").alias("o"), F.count("*").alias("n")).collect()
    return {r["choice"]: r["o"] for r in rows if r["n"] == n_days}


def select_sets_coupled(
    curve: DataFrame,
    caps: dict[datetime.date, float],
    step: float,
    order: Sequence[str] = ("USA", "A", "B"),
    penalty: float = 0.0001,
    rounds: int = 30,
    trials: int = 8,
    changes: int = 4,
) -> DataFrame:
    """Window plan (date, segment, keyword_set_id, daily_budget, milp_pred, ...) with plan_value, upper_bound and gap.

    ``curve`` (date, segment, keyword_set_id, budget, level) holds only budgets inside the bounds, with floored levels, and every
    segment's sets on every day; ``caps`` the cap of each day. ``trials`` is the number of different choices of the ascent that become
    plans, ``changes`` the number of rounds in which single segments may change their set; neither limits what a plan may hold.
    """
    curve = cut_lineage(curve.filter(F.col("date").isin(list(caps))))
    days = cut_lineage(_priced_days(curve, step, penalty))
    options: dict[str, list[str]] = {}
    for r in curve.select("segment", "keyword_set_id").distinct().collect():
        options.setdefault(r["segment"], []).append(r["keyword_set_id"])
    if not options:
        raise ValueError("no keyword set to choose from")
    bound, met = dual_ascent(days, caps, order, rounds)
    tried = list({tuple(sorted(c.items())): c for c in met}.values())[:trials]
    values = _values(_plans(curve, tried, caps, step, penalty, order), len(caps))
    if not values:
        raise ValueError("no choice of sets keeps all limits")
    top = max(values, key=lambda i: (values[i], -i))
    best, value = tried[top], values[top]
    tighter, more = dual_ascent(days, caps, order, rounds, target=value)
    bound = min(bound, tighter)
    pending = [c for c in {tuple(sorted(c.items())): c for c in more}.values() if c not in tried][:trials]
    for _ in range(changes):
        if bound - value <= 1e-9:
            break
        trial = pending + [{**best, s: k} for s, own in sorted(options.items()) for k in sorted(own) if k != best[s]]
        pending = []
        values = _values(_plans(curve, trial, caps, step, penalty, order), len(caps)) if trial else {}
        top = max(values, key=lambda i: (values[i], -i), default=None)
        if top is None or values[top] <= value + 1e-9:
            break
        best, value = trial[top], values[top]
    plan = _plans(curve, [best], caps, step, penalty, order).drop("choice")
    gap = max(0.0, bound - value)
    return plan.withColumns({"plan_value": F.lit(round(value, 6)), "upper_bound": F.lit(round(bound, 6)), "gap": F.lit(round(gap, 6))})
