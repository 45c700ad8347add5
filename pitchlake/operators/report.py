"""Performance reports: bands, grouping sets, context comparison, reporting windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Optional filters: a parameter that is None filters nothing and is not in the plan."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def summary(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """n, status, mean probability, hit rate, their difference (hit - p), Brier and log loss."""
    p, y = F.col("p"), F.col("y").cast("double")
    return df.groupBy(*by).agg(*_measures(p, y))


def _measures(p: Column, y: Column) -> list[Column]:
    return [
        F.count("*").alias("n"),
        E.sample_status(F.count("*")).alias("status"),
        F.round(F.avg(p), 8).alias("mean_p"),
        F.round(F.avg(y), 8).alias("hit_rate"),
        F.round(F.avg(y) - F.avg(p), 8).alias("gap"),
        F.round(F.avg(E.brier(p, y)), 8).alias("brier"),
        F.round(F.avg(E.log_loss(p, y)), 8).alias("log_loss"),
    ]


def market_report(df: DataFrame) -> DataFrame:
    """Overall, by market, by market and competition, by market and category: one pass over the rows."""
    sets = [["context"], ["context", "market"], ["context", "market", "competition"], ["context", "market", "category"]]
    columns = ["context", "market", "competition", "category"]
    rows = df.withColumn("category", F.coalesce(F.col("category"), F.lit(-1)))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id().cast("long").alias("level"), *_measures(F.col("p"), F.col("y").cast("double"))
    )
    # Rows without a category are no category of their own.
    return grouped.filter(~(F.col("category").eqNullSafe(F.lit(-1))))


def context_comparison(df: DataFrame, by: list[str]) -> DataFrame:
    """Lineup minus base, per group; the paired sample is the smaller of the two."""
    p, y = F.col("p"), F.col("y").cast("double")
    in_context = lambda name, c: F.avg(F.when(F.col("context") == name, c))
    count = lambda name: F.count(F.when(F.col("context") == name, 1))
    paired = F.least(count("BASE"), count("LINEUP"))
    return df.groupBy(*by).agg(
        paired.alias("paired_n"),
        E.sample_status(paired).alias("status"),
        F.round(in_context("LINEUP", E.brier(p, y)) - in_context("BASE", E.brier(p, y)), 8).alias("brier_delta"),
        F.round(in_context("LINEUP", E.log_loss(p, y)) - in_context("BASE", E.log_loss(p, y)), 8).alias("log_loss_delta"),
        F.round(in_context("LINEUP", y) - in_context("BASE", y), 8).alias("hit_rate_delta"),
    )


def in_window(df: DataFrame, time: str, window: str, as_of: str) -> DataFrame:
    """Rows of a reporting window that ends with the local date ``as_of``: LAST_7, LAST_30, or SEASON from 1 July."""
    end, day = F.lit(as_of).cast("date"), F.to_date(F.col(time))
    start = {
        "LAST_7": F.date_sub(end, 6),
        "LAST_30": F.date_sub(end, 29),
        "SEASON": F.make_date(F.year(end) - F.when(F.month(end) < 7, 1).otherwise(0), F.lit(7), F.lit(1)),
    }[window]
    return df.filter(day.between(start, end))
