"""Ridge fits of all expanding windows from one pass: sums of products per day, added up over the days.

A slice of earlier days has the sum of its days' matrices, and with recency weights a sum that fades from day to day, so no slice is read
again. Features are encoded once with the moments and categories of the whole frame; what a slice's own moments would give is a linear
change of these, so each fit equals the one on its slice alone. Labels that a slice lacks have zero columns and get no weight, as unknown
labels do. What reaches the driver is one matrix of the features' size per calendar day, whatever the number of rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.config import Config
from bidloom.models import design as D
from bidloom.operators.panel import usable_rows

Day = datetime.date
CONSTANT = 1e-12  # variance, in units of the whole frame's, below which a column does not vary


@dataclass
class Level:
    """A linear level over the columns of the shared encoding."""

    intercept: float
    weights: np.ndarray


@dataclass
class DaySums:
    """Per day the products of (1, columns, target), and the encoding the columns come from."""

    encoding: D.Encoding
    names: list[str]
    days: list[Day]
    products: np.ndarray  # (days, k, k)
    half_life: float | None

    def columns(self) -> list[Column]:
        return list(D.linear_columns(self.encoding, scaled=True).values())

    def rows_before(self) -> dict[Day, int]:
        """Usable rows before each day that has any."""
        n = np.cumsum(self.products[:, 0, 0]) - self.products[:, 0, 0]
        return {d: int(round(c)) for d, c in zip(self.days, n)}

    def fits(self, wanted: Sequence[tuple[Day, float]]) -> list[Level]:
        """The ridge of all rows up to and including each day, for each (day, alpha)."""
        order = sorted(range(len(wanted)), key=lambda i: wanted[i][0])
        out: list[Level | None] = [None] * len(wanted)
        size = self.products.shape[1]
        plain, faded, last, at = np.zeros((size, size)), np.zeros((size, size)), None, 0
        for i in order:
            until, alpha = wanted[i]
            while at < len(self.days) and self.days[at] <= until:
                day = self.days[at]
                if self.half_life and last is not None:
                    faded *= np.exp(-(day - last).days / self.half_life)
                plain += self.products[at]
                faded += self.products[at]
                last, at = day, at + 1
            if plain[0, 0] == 0:
                raise ValueError(f"no usable rows up to {until}")
            out[i] = self._solved(plain, faded, alpha)
        return out

    def means(self, days: Sequence[Day]) -> list[Level]:
        """The mean target of all rows up to and including each day."""
        out = []
        for until in days:
            total = self.products[[d <= until for d in self.days]].sum(axis=0)
            out.append(Level(float(total[0, -1] / total[0, 0]) if len(self.days) and total[0, 0] else 0.0, np.zeros(len(self.names))))
        return out

    def _solved(self, plain: np.ndarray, faded: np.ndarray, alpha: float) -> Level:
        n = len(self.names)
        change = self._own_scale(plain)
        weighted = faded * (plain[0, 0] / faded[0, 0])  # weights have the mean 1
        xx = change @ weighted[: n + 1, : n + 1] @ change.T
        xy, total = change @ weighted[: n + 1, -1], weighted[0, 0]
        mean, level = (change @ weighted[: n + 1, 0]) / total, weighted[0, -1] / total
        centred = xx - total * np.outer(mean, mean)
        beta = np.linalg.solve(centred + alpha * np.eye(n), xy - total * mean * level)
        weights = change.T @ beta
        return Level(float(level - mean @ beta + weights[0]), weights[1:])

    def _own_scale(self, plain: np.ndarray) -> np.ndarray:
        """The columns by the slice's own moments as rows over (1, shared columns)."""
        n, place = len(self.names), {c: i for i, c in enumerate(self.names)}
        change = np.column_stack([np.zeros(n), np.eye(n)])
        rows = plain[0, 0]
        for c in ["daily_budget", *self.encoding.numeric]:
            if c in D.NO_SCALE:
                continue
            i = place[c]
            mean = plain[0, i + 1] / rows
            spread = plain[i + 1, i + 1] / rows - mean * mean
            # A column that does not vary in the slice keeps its unit, as its own encoding has it.
            scale = np.sqrt(spread) if spread > CONSTANT * (1 + mean * mean) else 1.0 / self.encoding.moments[c][1]
            change[i, 0], change[i, i + 1] = -mean / scale, 1.0 / scale
            if c == "daily_budget":
                for j, name in enumerate(self.names):
                    if name.startswith("budget_x_"):
                        change[j, place[name.removeprefix("budget_x_")] + 1] = -mean / scale
                        change[j, j + 1] = 1.0 / scale
        return change


def _vectors(rows: DataFrame, columns: Sequence[Column], target: str) -> DataFrame:
    listed = F.array(*[c.cast("double") for c in columns])
    return rows.select("date", F.col(target).cast("double").alias("y"), listed.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    return x, batch.column(1).to_numpy(zero_copy_only=False)


def day_sums(frame: DataFrame, config: Config) -> DaySums:
    """Products of every day's usable rows: added up in the tasks first, then by day."""
    rows = usable_rows(frame, config.target)
    encoding = D.learn_encoding(rows, config.feature_columns())
    named = D.linear_columns(encoding, scaled=True)
    width = len(named)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Day, np.ndarray] = {}
        for batch in batches:
            x, y = _matrix(batch, width)
            z = np.column_stack([np.ones(len(y)), x, y])
            dates = np.array(batch.column(0).to_pylist(), dtype=object)
            for day in dict.fromkeys(dates):
                own = z[dates == day]
                held[day] = held.get(day, 0.0) + own.T @ own
        arrays = [pa.array(list(held), pa.date32()), pa.array([m.reshape(-1) for m in held.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["date", "products"])

    def total(table: pa.Table) -> pa.Table:
        added = np.sum([np.asarray(v.as_py()) for v in table["products"]], axis=0)  # one row per task
        return pa.table([table["date"].slice(0, 1), pa.array([added], pa.list_(pa.float64()))], names=["date", "products"])

    schema = "date date, products array<double>"
    summed = _vectors(rows, list(named.values()), config.target).mapInArrow(partial, schema).groupBy("date").applyInArrow(total, schema)
    found = summed.orderBy("date").toArrow()
    products = np.array([np.asarray(v.as_py()) for v in found["products"]]).reshape(-1, width + 2, width + 2)
    half_life = config.model_policy.validation.recency_half_life_days
    return DaySums(encoding, list(named), found["date"].to_pylist(), products, half_life)


def fold_metrics(rows: DataFrame, sums: DaySums, target: str, spans: Sequence[tuple[int, Day, Day]], levels: Sequence[Sequence[Level]]) -> list[list[dict]]:
    """RMSE, R2 and MAE of every fold (number, last training day, last day) and each of its levels, in one job."""
    width, alphas = len(sums.names), len(levels[0])
    weights = np.array([[v.weights for v in fold] for fold in levels])
    intercepts = np.array([[v.intercept for v in fold] for fold in levels])
    centre = float(sums.products[:, 0, -1].sum() / max(1.0, sums.products[:, 0, 0].sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(spans), alphas, 5))
        for batch in batches:
            x, y = _matrix(batch, width)
            dates = np.array(batch.column(0).to_pylist(), dtype="datetime64[D]")
            for f, (_, cut, end) in enumerate(spans):
                own = (dates > np.datetime64(cut)) & (dates <= np.datetime64(end))
                error = y[own, None] - np.maximum(x[own] @ weights[f].T + intercepts[f], 0.0)
                off = y[own] - centre
                same = np.array([own.sum(), off.sum(), (off * off).sum()])
                held[f, :, 0] += (error * error).sum(axis=0)
                held[f, :, 1] += np.abs(error).sum(axis=0)
                held[f, :, 2:] += same
        f, a = np.indices(held.shape[:2]).reshape(2, -1)
        arrays = [pa.array(f.astype(np.int32)), pa.array(a.astype(np.int32)), *[pa.array(held[f, a, j]) for j in range(5)]]
        yield pa.RecordBatch.from_arrays(arrays, ["f", "a", "se", "ae", "n", "off", "off2"])

    found = _vectors(usable_rows(rows, target), sums.columns(), target).mapInArrow(run, "f int, a int, se double, ae double, n double, off double, off2 double")
    out: list[list[dict]] = [[{} for _ in range(alphas)] for _ in spans]
    for r in found.groupBy("f", "a").agg(*[F.sum(c).alias(c) for c in ("se", "ae", "n", "off", "off2")]).collect():
        if r["n"]:
            spread = r["off2"] - r["off"] ** 2 / r["n"]
            out[r["f"]][r["a"]] = {"rmse": (r["se"] / r["n"]) ** 0.5, "mae": r["ae"] / r["n"], "r2": 1 - r["se"] / spread if spread > CONSTANT * (1 + r["off2"]) else None}
    return out


def predict_by_day(df: DataFrame, sums: DaySums, levels: dict[Day, Level], out: str) -> DataFrame:
    """Every row of ``df`` (date and features) with the level of its own day's fit; days without a fit get NULL."""
    fitted = df.sparkSession.createDataFrame([(d, v.intercept, v.weights.tolist()) for d, v in levels.items()], "date date, _b double, _w array<double>")
    products = F.zip_with(F.array(*[c.cast("double") for c in sums.columns()]), F.col("_w"), lambda x, w: x * w)
    level = F.col("_b") + F.aggregate(products, F.lit(0.0), lambda a, v: a + v)
    return df.join(fitted, "date", "left").withColumn(out, level).drop("_b", "_w")
