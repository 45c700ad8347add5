"""What a lineup has in common with its team's past: continuity with the last starters, appearances, goalkeepers, positions.

History is strictly earlier than the match: participations of the same instant are not seen. All of it is one as-of pass: the
rows of a team's past and the questions of its lineups are sorted together, a question before what happens at its instant, and
running sums and the last few starters are read where the question stands. The sliding list holds ``RECENT`` players, so a
window's state is as small however long the past is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Starters of a team, and how many of the last ones count as recent.
ELEVEN = 11
RECENT = 5


def past_of_teams(questions: DataFrame, participations: DataFrame, matches: DataFrame) -> DataFrame:
    """(match, team, starts, players, finished, recent): before the match's instant, how many participations of the team were
    starts, how many different players it had, how many finished matches, and the last ``RECENT`` starts with a known player.

    ``questions``: match, team, kick. ``participations``: id, team, player, kick, started. ``matches``: home, away, kick, finished.
    """
    by_player = Window.partitionBy("team", "player").orderBy("kick", "id")
    seen = participations.select("id", "team", "player", "kick", F.coalesce("started", F.lit(False)).alias("started"))
    first = F.col("player").isNotNull() & (F.row_number().over(by_player) == 1)
    known = F.col("started") & F.col("player").isNotNull()
    by_team = Window.partitionBy("team", "_known").orderBy("kick", "id").rowsBetween(1 - RECENT, 0)
    rows = seen.withColumns({"_first": first, "_known": known})
    rows = rows.withColumn("_recent", F.when(F.col("_known"), F.collect_list("player").over(by_team)))
    none = F.lit(None)
    past = rows.select("team", "kick", F.lit(1).alias("turn"), "id", none.cast("long").alias("match"), F.col("started").cast("long").alias("s"), F.col("_first").cast("long").alias("p"), F.lit(0).cast("long").alias("f"), "_recent")
    done = matches.filter("finished").select(F.explode(F.array("home", "away")).alias("team"), "kick")
    played = done.select("team", "kick", F.lit(1).alias("turn"), none.cast("long").alias("id"), none.cast("long").alias("match"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("f"), none.cast(past.schema["_recent"].dataType).alias("_recent"))
    asked = questions.select("team", "kick", F.lit(0).alias("turn"), none.cast("long").alias("id"), "match", *[F.lit(0).cast("long").alias(c) for c in "spf"], none.cast(past.schema["_recent"].dataType).alias("_recent"))
    so_far = Window.partitionBy("team").orderBy("kick", "turn", "id").rowsBetween(Window.unboundedPreceding, 0)
    out = past.unionByName(played).unionByName(asked)
    sums = [F.sum(c).over(so_far).alias(name) for c, name in (("s", "starts"), ("p", "players"), ("f", "finished"))]
    out = out.select("team", "kick", "turn", "match", *sums, F.last("_recent", ignorenulls=True).over(so_far).alias("recent"))
    empty = F.array().cast(past.schema["_recent"].dataType)
    return out.filter("turn = 0").select("match", "team", "starts", "players", "finished", F.coalesce("recent", empty).alias("recent"))


def starter_features(starters: DataFrame, participations: DataFrame, matches: DataFrame) -> DataFrame:
    """(match, side, ...): a lineup's relation to its team's past; ``starters``: match, side (HOME, AWAY), player, position,
    goalkeeper, a row a starter. A match without kickoff or of unknown teams has no row."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("team")) for s, c in (("HOME", "home"), ("AWAY", "away"))])).alias("s")
    teams = matches.filter("kick IS NOT NULL").select(F.col("id").alias("match"), "kick", sides).select("match", "kick", "s.*")
    # Starters may be exploded rows, which Spark takes for as few as they come from: never sent whole to the driver.
    named = starters.join(teams.hint("merge"), ["match", "side"])
    past = past_of_teams(named.select("match", "team", "kick").distinct(), participations, matches)
    earliest = participations.filter("player IS NOT NULL").groupBy("team", "player").agg(F.min("kick").alias("_since"))
    rows = named.join(past.hint("merge"), ["match", "team"]).join(earliest, ["team", "player"], "left")
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = rows.groupBy("match", "side", "team", "starts", "players", "finished", "recent").agg(
        flag(F.array_contains("recent", F.col("player"))).alias("continuity"),
        flag(F.col("goalkeeper") & (F.col("_since") < F.col("kick"))).alias("goalkeeper_continuity"),
        F.count("player").alias("resolved"),
        F.array_sort(F.collect_list("position")).alias("_positions"),
    )
    distinct = F.size(F.array_distinct("recent"))
    counts = F.transform(F.array_distinct("_positions"), lambda p: F.struct(p.alias("position"), F.size(F.filter("_positions", lambda q: q == p)).alias("n")))
    return out.select(
        "match", "side", "team", "continuity", (ELEVEN - F.col("continuity")).alias("changed"),
        F.when(F.col("finished") == 0, 0.0).otherwise(F.col("continuity") / ELEVEN).alias("regulars"),
        F.when(F.col("starts") == 0, 0.0).otherwise(distinct / RECENT).alias("recent_share"),
        "goalkeeper_continuity", counts.alias("positions"), "players", "starts", "finished", "resolved",
    )


def match_features(sides: DataFrame) -> DataFrame:
    """(match, home, away, continuity_difference, quality): both sides' features as structs; a match with one side has none."""
    rest = [c for c in sides.columns if c not in ("match", "side")]
    half = lambda side: sides.filter(F.col("side") == side.upper()).select("match", F.struct(*rest).alias(side))
    both = half("home").join(half("away").hint("merge"), "match")
    full = (F.col("home.resolved") == ELEVEN) & (F.col("away.resolved") == ELEVEN)
    quality = F.when(full & (F.col("home.finished") + F.col("away.finished") > 0), "COMPLETE").when(full, "INSUFFICIENT_PLAYER_HISTORY").otherwise("PARTIAL_PLAYER_RESOLUTION")
    return both.select("match", "home", "away", (F.col("home.continuity") - F.col("away.continuity")).alias("continuity_difference"), quality.alias("quality"))
