"""Readiness and coverage: lineups, market inputs, refresh bookkeeping, date splits, expanding reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E


def lineup_completeness(players: DataFrame, by: list[str], starters: int = 11) -> DataFrame:
    """Per lineup: distinct starters a side, and its state. COMPLETE_OFFICIAL is official, has ``starters`` a side and nobody
    twice; INVALID has more on a side; else PARTIAL."""
    side = lambda s: F.countDistinct(F.when((F.col("side") == s) & F.col("starter"), F.col("player")))
    named = F.count(F.when(F.col("starter") & F.col("side").isin("HOME", "AWAY"), F.col("player")))
    out = players.groupBy(*by).agg(side("HOME").alias("home"), side("AWAY").alias("away"), named.alias("named"), F.min(F.col("official").cast("int")).alias("official"))
    home, away = F.col("home"), F.col("away")
    whole = (F.col("official") == 1) & (F.col("named") == home + away) & (home == starters) & (away == starters)
    state = F.when(whole, "COMPLETE_OFFICIAL").when((home <= starters) & (away <= starters), "PARTIAL").otherwise("INVALID")
    return out.select(*by, "home", "away", state.alias("state"))


def lineup_window(kickoff: Column, known: Column, now: Column, complete: Column, before: int = 75, after: int = 5) -> Column:
    """State of a lineup around kickoff: minutes before and after it in which one is looked for."""
    minutes = (F.unix_seconds(kickoff.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 60
    return (
        F.when(complete, "READY")
        .when(~known, "KICKOFF_UNKNOWN")
        .when(minutes > before, "TOO_EARLY")
        .when(minutes >= -after, "WAITING")
        .otherwise("MISSED")
    )


def deactivated(known: DataFrame, refreshed: DataFrame, failures: int, key: str = "id") -> DataFrame:
    """Scheduled rows that a full refresh without failures did not touch become cancelled; with failures nothing changes."""
    if failures:
        return known
    touched = refreshed.select(key, F.lit(True).alias("_seen")).distinct()
    gone = F.col("_seen").isNull() & (F.col("status") == "scheduled")
    return known.join(touched, key, "left").withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status"))).drop("_seen")


def date_split(df: DataFrame, time: str, share: float = 0.7, least: int = 20) -> DataFrame:
    """``part`` by distinct dates in order: the first ``share`` of them train. Fewer than ``least`` dates give no rows.

    Dates are few beside rows: they are numbered alone and joined back.
    """
    days = df.select(F.to_date(time).alias("day")).distinct()
    order = Window.orderBy("day")
    total = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = days.withColumn("_nth", F.row_number().over(order)).withColumn("_n", total).filter(F.col("_n") >= least)
    part = F.when(F.col("_nth") <= F.floor(F.col("_n") * share), "train").otherwise("test")
    return df.withColumn("day", F.to_date(time)).join(F.broadcast(placed.select("day", part.alias("part"))), "day")


def expanding_reliability(df: DataFrame, time: str, pseudo: float = 20.0) -> DataFrame:
    """Observed rate of each row's bin over all earlier days, shrunk to the row's own probability by ``pseudo`` counts.

    Bins change once a day: days are summed first, and the window runs over days.
    """
    keyed = df.withColumn("bin", E.bucket(F.col("p"))).withColumn("day", F.to_date(time))
    days = keyed.groupBy("bin", "day").agg(F.count("*").alias("_n"), F.sum(F.col("y").cast("double")).alias("_y"))
    past = Window.partitionBy("bin").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("bin", "day", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("seen"), F.coalesce(F.sum("_y").over(past), F.lit(0.0)).alias("hits"))
    return keyed.join(days, ["bin", "day"]).withColumn("reliability", (F.col("hits") + pseudo * F.col("p")) / (F.col("seen") + pseudo))


def transformed(df: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    """For each feature its standardised value, filled by the median, and whether it was missing: (median, mean, std)."""
    columns = {}
    for name, (median, mean, std) in stats.items():
        columns[f"{name}_z"] = (F.coalesce(F.col(name).cast("double"), F.lit(median)) - mean) / std
        columns[f"{name}_missing"] = F.when(F.col(name).isNull(), 1.0).otherwise(0.0)
    return df.withColumns(columns)


def family_gate(metrics: DataFrame) -> DataFrame:
    """ACTIVE where log loss gains over 1e-4 and neither Brier nor calibration error is more than .02 worse."""
    gain = F.col("base_log_loss") - F.col("log_loss")
    ok = (gain > 1e-4) & (F.col("brier") <= F.col("base_brier") + 0.02) & (F.col("ece") <= F.col("base_ece") + 0.02)
    return metrics.withColumn("state", F.when(ok, "ACTIVE").otherwise("REJECTED"))
