"""Rolling latency over a stream, in the order of events: late samples wait in state until the watermark passes them.

Each key's state holds the samples that are still waiting and the last ones that were given out. A sample is given
out once no earlier one can come any more, so that the rows are those of the batch form over the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_stream(samples: DataFrame, key: str, time: str, order: str, value: str, delay: str = "10 minutes", size: int = 20, least: int = 5) -> DataFrame:
    """(key, time, order, value, rolling_mean, rolling_p95) for each sample of a stream, by `time`, then `order` (a long).

    `time` is a timestamp; samples that come more than `delay` behind the latest one may be left out, as watermarks
    do. A key's last samples are given out by a timer when the watermark has passed them. Null times, values or
    orders are left out. As in the batch form, rolling_p95 is null until `least` samples are there.
    """
    kinds = dict(samples.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = state.get if state.exists else ([], [])
        waiting, last = [tuple(w) for w in waiting], list(last)
        for pdf in parts:
            waiting += list(zip(pdf["_us"].tolist(), pdf[order].tolist(), pdf[value].astype(float).tolist(), strict=True))
        waiting.sort()
        now = state.getCurrentWatermarkMs() * 1000
        ready, waiting = [w for w in waiting if w[0] < now], [w for w in waiting if w[0] >= now]
        mean, p95 = [], []
        for _, _, v in ready:
            last = [*last, v][-size:]
            mean.append(float(np.mean(last)))
            p95.append(float(np.percentile(last, 95)) if len(last) >= least else None)
        state.update((waiting, last))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        times = pd.to_datetime([w[0] for w in ready], unit="us")
        yield pd.DataFrame({key: pd.Series([k[0]] * len(ready), dtype=object), time: times, order: [w[1] for w in ready], value: [w[2] for w in ready], "rolling_mean": mean, "rolling_p95": pd.Series(p95, dtype=float)})

    told = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull() & F.col(order).isNotNull()).withWatermark(time, delay)
    told = told.select(key, time, F.col(order).cast("long").alias(order), value, F.unix_micros(time).alias("_us"))
    out = f"`{key}` {kinds[key]}, `{time}` timestamp, `{order}` long, `{value}` double, rolling_mean double, rolling_p95 double"
    return told.groupBy(key).applyInPandasWithState(run, out, "waiting array<struct<at: long, nth: long, v: double>>, last array<double>", "append", GroupStateTimeout.EventTimeTimeout)
