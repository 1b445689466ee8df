"""The ledger as a stream: per-period multisets corrected as late events arrive, and running state per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import sent_by_value

sent_by_value(__name__)


def windowed_counts(events: DataFrame, at: str, period: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts per event-time window with a watermark; windows are emitted once they can no longer change (append) or
    at every change (update)."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, period), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("period"), *keys, "n")


def multiset_versions(events: DataFrame, key: str, period: str, arrival: str, value: str, event_id: str, cutoff: int) -> DataFrame:
    """Every correction of a period's statistics, from a stream of events in any order.

    Per key and period the state holds how often each value occurred, and the ids counted (repeated deliveries count
    once); each batch in which something within ``cutoff`` periods of the period arrived emits
    ``key, period, arrival, n, n_distinct, min_value, max_value, median_value`` as of its last arrival. Statistics come from
    cumulative counts over the distinct values. Once an arrival beyond the cut-off of a period is seen, its values and ids are
    dropped from the state and only the mark that it is closed is left.
    Columns: key string, period, arrival and value bigint, event_id bigint.
    """
    out = "key string, period bigint, arrival bigint, n bigint, n_distinct bigint, min_value bigint, max_value bigint, median_value double"
    held = "closed boolean, values array<bigint>, counts array<bigint>, ids array<bigint>"

    def step(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closed, v, c, i = state.get if state.exists else (False, [], [], [])
        if closed:
            return
        rows = pd.concat(list(batches)).sort_values(["arrival", "event_id"]).drop_duplicates("event_id")
        in_time = rows["arrival"] - group[1] <= cutoff
        new = rows[in_time & ~rows["event_id"].isin(i)]
        counts = new["value"].dropna().astype("int64").value_counts().add(pd.Series(list(c), index=list(v), dtype="float64"), fill_value=0).astype("int64").sort_index()
        ids = [*i, *new["event_id"].tolist()]
        state.update((True, [], [], []) if not in_time.all() else (False, counts.index.tolist(), counts.tolist(), ids))
        if len(new):
            n, up = int(counts.sum()), counts.cumsum().to_numpy()
            middle = [int(counts.index[np.searchsorted(up, k)]) for k in ((n + 1) // 2, n // 2 + 1)] if n else []
            yield pd.DataFrame({
                "key": [group[0]], "period": [group[1]], "arrival": [int(new["arrival"].max())], "n": [len(ids)], "n_distinct": [len(counts)],
                "min_value": pd.array([int(counts.index[0]) if n else None], "Int64"), "max_value": pd.array([int(counts.index[-1]) if n else None], "Int64"), "median_value": [sum(middle) / 2 if n else None],
            })

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(period).cast("bigint").alias("period"), F.col(arrival).cast("bigint").alias("arrival"), F.col(value).cast("bigint").alias("value"), F.col(event_id).alias("event_id"))
    return rows.groupBy("key", "period").applyInPandasWithState(step, out, held, "update", "NoTimeout")


def latest_state(events: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Running state per entity: the value of the event latest in ``order`` so far, whatever order events arrive in."""
    return events.groupBy(entity).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def run_once(result: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Process what a stream has now into an in-memory table (for tests and small results) and return it."""
    writer = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
