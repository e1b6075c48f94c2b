"""Forecasts of a series: recency-weighted trend, season, damped extrapolation, bands and anomalies.

A series is short (its last `context` points), so a group is bounded however long its history is: the tail is cut
by a window before anything reaches Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Periods of the frequencies, and what the model is tuned to.
PERIODS = {"daily": 7, "weekly": 4, "monthly": 12, "crawl": 1}
DAMPING, MOMENTUM, SPREAD, BAND = 0.96, 0.25, 0.18, 1.282


def season_of(values: np.ndarray, default: int) -> int:
    """Lag of the highest autocorrelation over 0.35, from 2 to 30 and half the length; 1 if there is none."""
    n = len(values)
    centred = values - values.mean()
    power = float(centred @ centred)
    if n < 2 * default or power == 0:
        return 1
    lags = range(2, min(n // 2, 30) + 1)
    score = [float(centred[:-k] @ centred[k:]) / power for k in lags]
    best = int(np.argmax(score)) if score else 0
    return lags[best] if score and score[best] > 0.35 else 1


def model(values: np.ndarray, horizon: int, period: int, low: float | None = None, high: float | None = None, z: float = 2.0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(forecast, anomalies) of a series."""
    horizon = max(1, min(365, horizon))
    n = len(values)
    clip = lambda x: np.clip(x, -math.inf if low is None else low, math.inf if high is None else high)
    steps = np.arange(1, horizon + 1)
    if n == 1:
        v = np.full(horizon, values[0])
        return pd.DataFrame({"step": steps, "p10": np.maximum(low or 0, v * 0.9), "p50": v, "p90": np.minimum(high, v * 1.1) if high else v * 1.1}), pd.DataFrame(columns=["i", "observed", "expected", "z", "kind", "severity"])
    x = np.arange(n, dtype=float)
    w = np.exp((x - n) / (0.75 * n))
    mx, my = (w @ x) / w.sum(), (w @ values) / w.sum()
    spread = w @ (x - mx) ** 2
    slope = float(w @ ((x - mx) * (values - my)) / spread) if spread else 0.0
    start = my - slope * mx
    season = season_of(values, period)
    rest = values - (start + slope * x)
    parts = np.array([rest[k::season].mean() if len(rest[k::season]) else 0.0 for k in range(season)])
    fitted = start + slope * x + parts[np.arange(n) % season]
    error = values - fitted
    sigma = math.sqrt(float(error @ error) / max(1, n - 1))
    if sigma < 0.05:
        sigma = max(0.05 * abs(values[-1]), 0.2)
    middle = np.sort(error)[n // 2]
    mad = np.sort(np.abs(error - middle))[n // 2] or sigma
    scale = max(1.4826 * mad, 0.5 * sigma, 0.1)
    score = error / scale
    odd = np.flatnonzero(np.abs(score) >= z)
    anomalies = pd.DataFrame({"i": odd, "observed": values[odd], "expected": fitted[odd].round(2), "z": score[odd].round(2), "kind": np.where(error[odd] > 0, "spike", "drop"), "severity": np.where(np.abs(score[odd]) >= 3, "critical", "warning")})
    trend = start + slope * (n - 1) + slope * np.cumsum(DAMPING**steps)
    point = clip(trend + parts[(n - 1 + steps) % season] + error[-3:].mean() * np.exp(-MOMENTUM * steps))
    width = BAND * sigma * np.sqrt(1 + SPREAD * (steps - 1))
    return pd.DataFrame({"step": steps, "p10": clip(point - width).round(2), "p50": point.round(2), "p90": clip(point + width).round(2)}), anomalies


def forecast(series: DataFrame, key: str, order: str, value: str, horizon: int = 7, freq: str = "daily", context: int = 64, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, step, p10, p50, p90) per series; null values are left out, and a series without values has no rows."""
    period = PERIODS[freq]
    tail = _tail(series, key, order, value, context)
    type_ = series.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = model(pdf.sort_values("__o")["__v"].to_numpy(float), horizon, period, low, high)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return tail.groupBy(key).applyInPandas(run, f"{key} {type_}, step int, p10 double, p50 double, p90 double")


def anomalies(series: DataFrame, key: str, order: str, value: str, freq: str = "daily", context: int = 64, z: float = 2.0) -> DataFrame:
    """(key, i, observed, expected, z, kind, severity) of the points that stand out."""
    period = PERIODS[freq]
    type_ = series.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, out = model(pdf.sort_values("__o")["__v"].to_numpy(float), 1, period, z=z)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return _tail(series, key, order, value, context).groupBy(key).applyInPandas(run, f"{key} {type_}, i int, observed double, expected double, z double, kind string, severity string")


def _tail(series: DataFrame, key: str, order: str, value: str, context: int) -> DataFrame:
    rows = series.where(F.col(value).isNotNull()).select(key, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"))
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("__o")))).where(F.col("__r") <= max(8, context)).drop("__r")
