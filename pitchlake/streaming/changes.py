"""Structured Streaming: price changes with a heartbeat, and late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_prices(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows (key, id, at, price) of a stream that differ from the last kept row of their key or come ``seconds`` after it.

    State is one (price, time) a key. Inside a micro-batch rows are taken in (time, id) order.
    """
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        price, at = state.get if state.exists else (None, None)
        kept = []
        for row in rows.itertuples(index=False):
            now = int(row.at.value // 1000)
            if price is None or row.price != price or now - at >= seconds * 1_000_000:
                kept.append((key[0], row.id, row.at, row.price))
                price, at = row.price, now
        if price is not None:
            state.update((price, at))
        yield pd.DataFrame(kept, columns=["key", "id", "at", "price"])

    return stream.groupBy("key").applyInPandasWithState(
        keep, "key long, id long, at timestamp, price double", "price double, at long", "append", GroupStateTimeout.NoTimeout
    )


def hourly_activity(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Quotes and mean price by hour and selection; rows later than the watermark are dropped by the engine."""
    windows = stream.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "selection")
    return windows.agg(F.count("*").alias("n"), F.avg("price").alias("price")).select("w.start", "selection", "n", "price")
