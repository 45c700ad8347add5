"""Quality of probabilistic forecasts: group metrics, reliability tables, multiclass evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E


def calibration_error(df: DataFrame, by: list[str], bins: Column, min_n: int = 0) -> DataFrame:
    """(by..., ece, mce). Bins under ``min_n`` rows are left out of the sum but not of the total it is divided by."""
    per_bin = df.groupBy(*by, bins.alias("_bin")).agg(
        F.count("*").alias("_n"), F.avg("p").alias("_p"), F.avg(F.col("y").cast("double")).alias("_y")
    )
    gap = F.when(F.col("_n") >= min_n, F.abs(F.col("_p") - F.col("_y")))
    return per_bin.groupBy(*by).agg(
        (F.coalesce(F.sum(gap * F.col("_n")), F.lit(0.0)) / F.sum("_n")).alias("ece"), F.max(gap).alias("mce")
    )


def binary_quality(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean probability, hit rate, Brier score, log loss and calibration error over all five-point bins.

    One shuffle: bins are pre-aggregated and the group is made of its bins.
    """
    valid = df.filter(E.is_probability(F.col("p")))
    per_bin = valid.groupBy(*by, E.bucket(F.col("p")).alias("_bin")).agg(
        F.count("*").alias("_n"),
        F.sum("p").alias("_p"),
        F.sum(F.col("y").cast("double")).alias("_y"),
        F.sum(E.brier(F.col("p"), F.col("y"))).alias("_b"),
        F.sum(E.log_loss(F.col("p"), F.col("y"))).alias("_l"),
    )
    n = F.sum("_n")
    return per_bin.groupBy(*by).agg(
        n.alias("n"),
        F.round(F.sum("_p") / n, 8).alias("mean_p"),
        F.round(F.sum("_y") / n, 8).alias("hit_rate"),
        F.round(F.sum("_b") / n, 8).alias("brier"),
        F.round(F.sum("_l") / n, 8).alias("log_loss"),
        F.round(F.sum(F.abs(F.col("_p") - F.col("_y"))) / n, 8).alias("ece"),
    )


def reliability_table(df: DataFrame, by: list[str], min_n: int = 20) -> DataFrame:
    """Per bin: n, mean probability, observed rate, gap, standard error and whether the bin is usable."""
    valid = df.filter(E.is_probability(F.col("p")))
    rows = valid.groupBy(*by, E.bucket(F.col("p")).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed")
    )
    return rows.select(
        *by,
        "bin",
        "n",
        F.round("mean_p", 8).alias("mean_p"),
        F.round("observed", 8).alias("observed"),
        F.round(F.col("observed") - F.col("mean_p"), 8).alias("gap"),
        F.round(F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n")), 8).alias("std_error"),
        F.when(F.col("n") >= min_n, "USABLE").otherwise("LOW_SAMPLE").alias("status"),
    )


def multiclass_quality(df: DataFrame, event: list[str], by: list[str], strict: bool = True) -> DataFrame:
    """Quality of three-way forecasts (columns selection, p, y).

    An event counts if it has three distinct selections and, where ``strict``, exactly one true one. The forecast is the
    largest probability; of equal ones the last selection in order wins.
    """
    events = df.groupBy(*by, *event).agg(
        F.count("*").alias("_n"),
        F.countDistinct("selection").alias("_k"),
        F.sum("y").alias("_true"),
        F.max(F.when(F.col("y") == 1, F.col("p"))).alias("_hit_p"),
        F.sum(E.brier(F.col("p"), F.col("y"))).alias("_brier"),
        F.max(F.struct("p", "selection", "y")).alias("_top"),
    )
    events = events.filter((F.col("_k") == 3) & (F.col("_n") == 3))
    if strict:
        events = events.filter("_true = 1")
    return events.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.round(F.avg(-F.log(F.greatest(F.col("_hit_p"), F.lit(E.LOG_FLOOR)))), 8).alias("log_loss"),
        F.round(F.avg("_brier"), 8).alias("brier"),
        F.round(F.avg(F.col("_top.y").cast("double")), 8).alias("accuracy"),
    )
