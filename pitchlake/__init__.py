"""Analytics over append-only sports-forecast data, as Spark jobs."""
