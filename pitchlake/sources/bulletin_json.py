"""Bulletin and popularity documents: nested events, markets and outcomes as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E

# The documents' shapes; every field is optional.
EVENT = (
    "struct<i:bigint,hn:string,an:string,sid:bigint,ci:bigint,d:bigint,"
    "m:array<struct<i:bigint,t:bigint,st:bigint,sov:string,o:array<struct<no:bigint,n:string,odd:double>>>>>"
)
BULLETIN = f"struct<competitions:array<struct<i:bigint,n:string,country:string>>,events:array<{EVENT}>>"
POPULAR = "array<struct<eventId:bigint,marketId:bigint,outcomeNo:bigint,totalPlayed:bigint,odd:double>>"


def prices(documents: DataFrame, column: str = "body") -> DataFrame:
    """One row per event, market and outcome; unnamed events and prices that are not finite and positive are left out."""
    events = documents.select(F.explode(F.from_json(F.col(column), BULLETIN)["events"]).alias("e"))
    named = events.filter(F.col("e.i").isNotNull() & (F.col("e.hn").isNotNull() | F.col("e.an").isNotNull()))
    markets = named.select("e.i", "e.hn", "e.an", E.epoch_to_timestamp(F.col("e.d")).alias("kickoff_at"), F.explode("e.m").alias("m"))
    rows = markets.select(
        F.col("i").alias("event_id"),
        F.col("hn").alias("home"),
        F.col("an").alias("away"),
        "kickoff_at",
        F.col("m.i").alias("market_id"),
        F.col("m.sov").try_cast("double").alias("line"),
        F.explode("m.o").alias("o"),
    )
    return rows.select("event_id", "home", "away", "kickoff_at", "market_id", "line", F.col("o.no").alias("outcome"), F.col("o.odd").alias("odd")).filter(
        (F.col("odd") > 0) & ~F.isnan("odd") & (F.col("odd") < float("inf"))
    )


def popularity(documents: DataFrame, column: str = "body", sport: str = "1") -> DataFrame:
    """The sport's list; a row's place in it is its rank, from 1."""
    listed = F.from_json(F.get_json_object(F.col(column), f"$.data.{sport}"), POPULAR)
    return documents.select(F.posexplode(listed).alias("place", "p")).select((F.col("place") + 1).alias("rank"), "p.*")
