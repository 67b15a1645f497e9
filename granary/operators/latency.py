"""Latency: summaries with exact percentiles, and rolling windows, for keys of any number of samples or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import ordered
from granary.shared import Tables


def summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, median, p95) of each key, or of all samples; nulls are left out."""
    tables = Tables(samples.sparkSession)
    found = ordered.percentiles(samples, list(by), value, {"median": 0.5, "p95": 0.95}, tables)
    return tables.keep(found.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")]))


def rolling(samples: DataFrame, value: str, keys: list[str], order: list[str], size: int = 20, least: int = 5) -> DataFrame:
    """Adds rolling_mean and rolling_p95 of the last `size` samples, this one included; p95 waits for `least`.

    Windows run within `keys`, or over all samples where there are none.
    """
    tables = Tables(samples.sparkSession)
    found = ordered.rolling(samples, keys, order, size, {"rolling_mean": F.avg(value), "_n": F.count(value), "_p95": F.percentile(value, 0.95)}, tables)
    return tables.keep(found.withColumns({"rolling_mean": F.round("rolling_mean", 6), "rolling_p95": F.when(F.col("_n") >= least, F.round("_p95", 6))}).drop("_n", "_p95"))
