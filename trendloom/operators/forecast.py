"""Ridge forecasts of growth against plain baselines, on splits in time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import FEATURES, design_matrix, monthly_demand, purged_split, settled, with_target

PENALTY, NOISE = 1.0, 0.05


def scaling(split: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, scale of the training rows; a scale of 0 becomes 1."""
    train = split.where("part = 'train'")
    wide = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("scale")) for c in features]))
    return wide.select(rows.alias("r")).select("r.*")


@dataclass
class Ridge:
    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def predict(self) -> Column:
        out = F.lit(self.weights[0])
        for c, m, s, w in zip(self.features, self.mean, self.scale, self.weights[1:], strict=True):
            out = out + F.lit(w) * (F.col(c) - F.lit(m)) / F.lit(s)
        return out


def fit(split: DataFrame, features: list[str], target: str = "target_yoy_fwd", penalty: float = PENALTY) -> Ridge:
    """Closed form from one aggregation: sums of products of the standardised features; the constant is not penalised.

    Only the (features + 1)^2 sums come to the driver.
    """
    scales = {r["feature"]: (r["mean"], r["scale"]) for r in scaling(split, features).collect()}
    z = [F.lit(1.0)] + [(F.col(c) - F.lit(scales[c][0])) / F.lit(scales[c][1]) for c in features]
    k = len(z)
    sums = [F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(z[i] * F.col(target)).alias(f"y{i}") for i in range(k)]
    row = split.where("part = 'train'").agg(*sums).first()
    gram = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    weights = np.linalg.solve(gram + penalty * np.diag([0.0] + [1.0] * (k - 1)), np.array([row[f"y{i}"] for i in range(k)]))
    return Ridge(features, [scales[c][0] for c in features], [scales[c][1] for c in features], weights.tolist())


def scores(test: DataFrame, predictions: dict[str, Column], target: str = "target_yoy_fwd", by: list[str] | None = None) -> DataFrame:
    """model, n, mae, rmse, direction (share of equal signs) over the test rows, for each group of ``by``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), p.cast("double").alias("predicted")) for k, p in predictions.items()]))
    by = by or []
    long = test.select(*by, F.col(target).alias("actual"), each.alias("r")).select(*by, "actual", "r.*")
    error = F.col("predicted") - F.col("actual")
    same = (F.signum("predicted") == F.signum("actual")).cast("double")
    return long.groupBy(*by, "model").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(same).alias("direction"))


def baselines() -> dict[str, Column]:
    return {"persistence": F.col("yoy"), "zero": F.lit(0.0)}


class TooFewMonths(ValueError):
    """A window has fewer usable months than its split and its features need."""


def grams(windows: DataFrame, features: list[str], target: str = "target_yoy_fwd") -> DataFrame:
    """For each horizon and holdout: months, and the sums of products of (1, features, target) over the months to train on, in one aggregation.

    windows: horizon, holdout, part, features, target. The sums of two sets of months add up to those of both.
    """
    z = [F.lit(1.0), *(F.col(c) for c in features), F.col(target)]
    train = lambda x: F.coalesce(F.sum(F.when(F.col("part") == "train", x)), F.lit(0.0))
    sums = [train(z[i] * z[j]).alias(f"x{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return windows.groupBy("horizon", "holdout").agg(F.count("*").alias("n"), *sums)


def solve(sums: list[dict], features: list[str], penalty: float = PENALTY) -> np.ndarray:
    """One row of weights (constant first, for features as they are) for each row of grams, solved in one batch.

    Features are standardised by the mean and the deviation of their training rows, which the sums hold too; a deviation of 0 becomes 1.
    """
    k = len(features) + 2
    gram = np.zeros((len(sums), k, k))
    for i in range(k):
        for j in range(i, k):
            gram[:, i, j] = gram[:, j, i] = [r[f"x{i}_{j}"] for r in sums]
    n = gram[:, 0, 0]
    mean = gram[:, 0, 1:] / n[:, None]
    centred = gram[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum(np.einsum("wii->wi", centred)[:, :-1], 0.0) / n[:, None])
    # what is constant has a deviation of rounding errors only
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean[:, :-1]))] = 1.0
    left = centred[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :]) + penalty * np.eye(k - 2)
    slopes = np.linalg.solve(left, (centred[:, :-1, -1] / scale)[:, :, None])[:, :, 0] / scale
    constant = mean[:, -1] - (slopes * mean[:, :-1]).sum(axis=1)
    return np.column_stack([constant, slopes])


def evaluate_windows(windows: DataFrame, features: list[str], target: str = "target_yoy_fwd") -> DataFrame:
    """horizon, holdout, model, n, mae, rmse, direction, rows_usable, beats_both for each window that has enough months.

    windows: horizon, holdout, month, part, features, target; a table of months, read twice: for the sums, which come to the driver, and for the scores.
    """
    spark = windows.sparkSession
    enough = [r.asDict() for r in grams(windows, features, target).collect() if r["n"] > r["holdout"] + r["horizon"] + len(features)]
    if not enough:
        raise TooFewMonths("no window has enough months")
    names = ["constant", *(f"w_{c}" for c in features)]
    fitted = [(r["horizon"], r["holdout"], r["n"], *w) for r, w in zip(enough, solve(enough, features).tolist(), strict=True)]
    weights = spark.createDataFrame(fitted, f"horizon int, holdout int, rows_usable int, {', '.join(f'{c} double' for c in names)}")
    test = windows.where("part = 'test'").join(F.broadcast(weights), ["horizon", "holdout"])
    ridge = reduce(lambda a, b: a + b, [F.col(f"w_{c}") * F.col(c) for c in features], F.col("constant"))
    by = ["horizon", "holdout", "rows_usable"]
    scored = scores(test, {"ridge": ridge} | baselines(), target, by)
    mae = lambda m: F.max(F.when(F.col("model") == m, F.col("mae"))).over(Window.partitionBy("horizon", "holdout"))
    beats = (mae("ridge") < mae("persistence")) & (mae("ridge") < mae("zero"))
    return scored.select("horizon", "holdout", "model", "n", "mae", "rmse", "direction", "rows_usable", beats.alias("beats_both"))


def evaluate(design: DataFrame, horizon: int, holdout: int) -> DataFrame:
    """scores of ridge and baselines, with beats_both: whether ridge has the least mae. Too few months raise TooFewMonths."""
    features = [c for c in design.columns if c not in ("month", "target_yoy_fwd")]
    split = purged_split(settled(design), horizon, holdout)
    windows = split.withColumns({"horizon": F.lit(horizon), "holdout": F.lit(holdout)})
    return evaluate_windows(windows, features).drop("horizon", "holdout")


def window_grid(sales: DataFrame, visitors: DataFrame, categories: list[str], horizons=(1, 3, 6), holdouts=(6, 12, 18)) -> DataFrame:
    """horizon, holdout and scores for every window with enough months. The sources are read once, all windows are summed in one aggregation."""
    monthly = settled(monthly_demand(sales, visitors, categories))
    designs = reduce(DataFrame.unionByName, [design_matrix(with_target(monthly, h)).withColumn("horizon", F.lit(h)) for h in horizons])
    back = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("month")))
    placed = designs.withColumn("back", back).select("*", F.explode(F.array(*[F.lit(h) for h in holdouts])).alias("holdout"))
    part = F.when(F.col("back") <= F.col("holdout"), "test").when(F.col("back") <= F.col("holdout") + F.col("horizon"), "purged").otherwise("train")
    return evaluate_windows(placed.withColumn("part", part), FEATURES)


def ablation(labels: DataFrame, papers: DataFrame, horizon: int = 3, holdout: int = 12) -> DataFrame:
    """One row: mae without and with the papers axis, the change and its share, rows lost, and whether it is noise."""
    labels = settled(labels)
    plain, more = design_matrix(labels), design_matrix(labels, papers)
    got = [{r["model"]: r for r in evaluate(d, horizon, holdout).collect()}["ridge"] for d in (plain, more)]
    base, new = got[0]["mae"], got[1]["mae"]
    row = (base, new, new - base, (new - base) / base, got[0]["rows_usable"] - got[1]["rows_usable"], abs(new - base) / base < NOISE)
    return labels.sparkSession.createDataFrame([row], "mae_base double, mae_with_papers double, delta double, share double, rows_lost long, is_noise boolean")
