"""Upserts on append-only storage: the new state of a table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` to append: one of each key that ``old`` lacks, of several the smallest by its other columns."""
    rest = [c for c in new.columns if c not in key]
    row = F.struct(*(rest or key))
    one = new.groupBy(*key).agg(F.min(row).alias("_r"))
    chosen = one.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in new.columns])
    return chosen.join(old.select(*key), key, "left_anti")


def upsert_statistics(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Per column the newest value that is not null: a later gap erases nothing. Of several new values the largest."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    pick = [F.max(F.when(F.col(c).isNotNull(), F.struct("_age", c))).getField(c).alias(c) for c in values]
    return both.groupBy(*key).agg(*pick)


def upsert_matches(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Known kickoff times are never downgraded, status only moves to finished, scores are filled and corrected.

    Several new rows of a key are first one by the same rules: the best known and latest kickoff, finished if any is, the
    largest whole score.
    """
    finished_first = F.max(F.struct((F.col("status") == "finished").alias("f"), "status")).getField("status")
    score = F.max(F.when(F.col("hg").isNotNull() & F.col("ag").isNotNull(), F.struct("hg", "ag")))
    new = new.groupBy(key).agg(F.max("known").alias("known"), F.max(F.struct("known", "kick")).getField("kick").alias("kick"), finished_first.alias("status"), score.alias("s"))
    new = new.select(key, "known", "kick", "status", "s.hg", "s.ag")
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    known = F.greatest("o.known", "n.known")
    better = F.col("n.known").isNotNull() & (F.col("n.known") >= F.coalesce("o.known", F.lit(0)))
    finished = (F.col("o.status") == "finished") | (F.col("n.status") == "finished")
    return joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        known.alias("known"),
        F.when(better, F.col("n.kick")).otherwise(F.col("o.kick")).alias("kick"),
        F.when(finished, "finished").otherwise(F.coalesce("o.status", "n.status")).alias("status"),
        F.coalesce("n.hg", "o.hg").alias("hg"),
        F.coalesce("n.ag", "o.ag").alias("ag"),
    )


def overlay(base: DataFrame, other: DataFrame, column: str, value) -> DataFrame:
    """``base`` with one category's rows replaced by those of ``other``."""
    return base.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(other.filter(F.col(column) == value))


def publish(pointers: DataFrame) -> DataFrame:
    """Per date the run to show: populated before empty, live before replay, then the newest."""
    rank = F.struct((F.col("rows") > 0).alias("full"), (~F.col("replay")).alias("live"), "generated_at", "run_id")
    return pointers.groupBy("day").agg(F.max(rank).alias("top")).select("day", "top.run_id")
