"""Two-sample comparisons with p-values and bootstrap intervals, one metric a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "metric string, n_a long, n_b long, median_a double, median_b double, statistic double, p_value double, effect_size double, effect_ci_low double, effect_ci_high double"


def u_statistic(a: np.ndarray, b: np.ndarray) -> float:
    """Mann-Whitney U of the first sample."""
    ordered = np.sort(b)
    return float((np.searchsorted(ordered, a, "left") + np.searchsorted(ordered, a, "right")).sum()) / 2


def p_value(a: np.ndarray, b: np.ndarray, u: float) -> float:
    """Two-sided, by the normal approximation with corrections for ties and continuity."""
    n, m = len(a), len(b)
    _, counts = np.unique(np.concatenate((a, b)), return_counts=True)
    total = n + m
    variance = n * m / 12 * (total + 1 - float((counts.astype(float) ** 3 - counts).sum()) / (total * (total - 1)))
    if variance <= 0:
        return 1.0
    return min(1.0, math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(variance) / math.sqrt(2)))


def compare(frame: pd.DataFrame, resamples: int = 2000, least: int = 5, seed: int = 42) -> pd.DataFrame:
    frame = frame.sort_values("id")
    a, b = (frame.loc[frame["g"] == g, "v"].to_numpy() for g in (0, 1))
    row = {"metric": frame["metric"].iloc[0], "n_a": len(a), "n_b": len(b)}
    if min(len(a), len(b)) >= least:
        u = u_statistic(a, b)
        rng = np.random.default_rng(seed)
        effects = [1 - 2 * u_statistic(rng.choice(a, len(a)), rng.choice(b, len(b))) / (len(a) * len(b)) for _ in range(resamples)]
        low, high = np.percentile(effects, [2.5, 97.5])
        row |= {"median_a": np.median(a), "median_b": np.median(b), "statistic": u, "p_value": p_value(a, b, u), "effect_size": 1 - 2 * u / (len(a) * len(b)), "effect_ci_low": low, "effect_ci_high": high}
    return pd.DataFrame([row]).reindex(columns=[c.split()[0] for c in SCHEMA.split(", ")])


def compare_groups(values: DataFrame, resamples: int = 2000, least: int = 5) -> DataFrame:
    """Rows (metric, g 0 or 1, id, v) to a comparison of each metric; a resample needs a metric's values together."""
    return values.groupBy("metric").applyInPandas(lambda f: compare(f, resamples, least), SCHEMA)
