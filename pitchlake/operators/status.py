"""Status and quality queries: counts, readiness, coverage, work queues and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E
from pitchlake.operators.similarity import nearest_names


def business_date(local: Column, kickoff: Column) -> Column:
    """The local date, else the kickoff's own."""
    return F.coalesce(local, F.to_date(kickoff))


def fixed_offset_date(ts: Column, hours: int = 3) -> Column:
    """The date at a fixed offset, whatever the zone's rules were: kept for parity, ``local_date`` is right for all years."""
    return F.to_date(ts + F.expr(f"interval '{hours}' hour"))


def totals(matches: DataFrame, teams: DataFrame) -> DataFrame:
    day = business_date(F.col("local_date"), F.col("kick"))
    out = matches.agg(F.count("*").alias("matches"), F.min(day).alias("earliest"), F.max(day).alias("latest"))
    return out.crossJoin(teams.agg(F.count("*").alias("teams")))  # one row each


def coverage_by_season(matches: DataFrame, imports: DataFrame) -> DataFrame:
    """(competition, season, ...): how many matches of a season there are, are finished or scheduled, and have each kind of
    statistics of both sides, their first and last day, and when the season was last imported. One pass: a match is one row.

    ``matches``: id, competition, season, day, status, pairs of statistics; ``imports``: competition, season, status, completed_at.
    """
    both = {"shots": ("hs", "as_"), "shots_on_target": ("hst", "ast"), "corners": ("hc", "ac"), "cards": ("hy", "ay"), "halftime": ("hth", "hta")}
    n = lambda test: F.countDistinct(F.when(test, F.col("id")))
    counts = [n(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"with_{name}") for name, (a, b) in both.items()]
    out = matches.groupBy("competition", "season").agg(
        F.countDistinct("id").alias("matches"), n(F.col("status") == "finished").alias("finished"), n(F.col("status") == "scheduled").alias("scheduled"),
        *counts, F.min("day").alias("earliest"), F.max("day").alias("latest"),
    )
    last = imports.filter("status = 'completed'").groupBy("competition", "season").agg(F.max("completed_at").alias("last_import"))
    return out.join(last, ["competition", "season"], "left")


def feature_quality(snapshots: DataFrame, least: int = 3) -> DataFrame:
    """One row over feature snapshots (competition, cutoff, quality: JSON): how many, how many with too little history on a
    side, their mean coverage of four statistics, competitions and range."""
    fields = "history_home int, history_away int, shots double, corners double, cards double, fouls double"
    q = F.from_json("quality", fields)
    rows = snapshots.withColumn("q", q)
    few = (F.col("q.history_home") < least) | (F.col("q.history_away") < least)
    cover = (F.col("q.shots") + F.col("q.corners") + F.col("q.cards") + F.col("q.fouls")) / 4
    return rows.agg(
        F.count("*").alias("snapshots"),
        F.sum(F.coalesce(few, F.lit(False)).cast("long")).alias("insufficient_history"),
        F.round(F.coalesce(F.avg(cover), F.lit(0.0)), 8).alias("coverage"),
        F.countDistinct("competition").alias("competitions"),
        F.min("cutoff").alias("earliest"),
        F.max("cutoff").alias("latest"),
    )


def dataset_status(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Per dataset: its last completed run, its last run's status, and the matches of that run's competition and season."""
    last = Window.partitionBy("dataset").orderBy(F.desc("id"))
    completed = runs.groupBy("dataset").agg(F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("last_import"))
    newest = runs.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").select("dataset", "status", "competition", "season")
    found = matches.groupBy("competition", "season").agg(
        F.countDistinct("id").alias("matches"),
        F.countDistinct(F.when(F.col("finished"), F.col("id"))).alias("finished"),
        F.countDistinct(F.when(F.col("hc").isNotNull(), F.col("id"))).alias("with_statistics"),
    )
    out = newest.join(completed, "dataset").join(found, ["competition", "season"], "left")
    return out.select("dataset", "last_import", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "finished", "with_statistics")])


def markets_per_match(matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, markets): distinct (code, market, line) of every match's quotes, nulls counted as empty; none is 0."""
    market = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("code", "market_id", "line")])
    counts = quotes.filter("code IS NOT NULL").groupBy("match_id").agg(F.countDistinct(market).alias("markets"))
    return matches.join(counts, matches["id"] == counts["match_id"], "left").select("id", F.coalesce("markets", F.lit(0)).alias("markets"))


def bulletin_status(runs: DataFrame, matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row: last refresh, scheduled matches and their competitions and teams, quotes and the latest of them."""
    scheduled = matches.filter("NOT finished")
    teams = scheduled.select(F.explode(F.array("home", "away")).alias("team")).agg(F.countDistinct("team").alias("teams"))
    parts = [
        runs.filter("status = 'completed'").agg(F.max("completed_at").alias("last_refresh")),
        scheduled.agg(F.countDistinct("id").alias("upcoming"), F.countDistinct("competition").alias("competitions")),
        teams,
        quotes.agg(F.max("captured").alias("latest_quote"), F.count("*").alias("quotes")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def popularity_status(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: snapshots, the latest, and the latest COUNT of every selection, by whether its match is known."""
    w = Window.partitionBy("key", "selection").orderBy(F.desc("captured"), F.desc("id"))
    latest = rows.filter("metric = 'COUNT'").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1")
    flagged = latest.join(matched.select("key", F.lit(1).alias("_known")).distinct(), "key", "left")
    counts = flagged.agg(F.count("*").alias("selections"), F.count("_known").alias("matched"), (F.count("*") - F.count("_known")).alias("unmatched"))
    return rows.agg(F.count("*").alias("snapshots"), F.max("captured").alias("latest")).crossJoin(counts)


def mapping_counts(source: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """One row: source mappings that a canonical one exists for, and those without."""
    flagged = source.join(canonical.select(key, F.lit(1).alias("_known")).distinct(), key, "left")
    known = F.count("_known")
    return flagged.agg(known.alias("resolved"), (F.count("*") - known).alias("unresolved"))


def market_readiness(matches: DataFrame) -> DataFrame:
    """(market, state, usable, coverage): finished matches that have what each market needs. Without a source, no history
    helps; from 10 on a market is supported, from 3 on partly."""
    done = matches.filter("finished AND hg IS NOT NULL AND ag IS NOT NULL")
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    base, corners, cards = F.count("*"), both("hc", "ac"), both("hy", "ay")
    needs = [(m, base, True) for m in ("MATCH_RESULT", "TOTAL_GOALS", "BTTS", "TEAM_TOTAL_GOALS")]
    needs += [("FULL_TIME_TOTAL_CORNERS", corners, True), ("FIRST_HALF_TOTAL_CORNERS", F.lit(0), False), ("TEAM_CORNERS", corners, True)]
    needs += [("FULL_TIME_TOTAL_CARDS", cards, True), ("FIRST_HALF_TOTAL_CARDS", F.lit(0), False), ("TEAM_CARDS", cards, True)]
    rows = F.array(*[F.struct(F.lit(m).alias("market"), n.cast("long").alias("usable"), F.lit(s).alias("source")) for m, n, s in needs])
    out = done.agg(rows.alias("r"), base.alias("total")).select("total", F.explode("r").alias("m")).select("total", "m.*")
    state = F.when(~F.col("source"), "SOURCE_NOT_AVAILABLE").when(F.col("usable") >= 10, "SUPPORTED").when(F.col("usable") >= 3, "PARTIAL").otherwise("INSUFFICIENT_HISTORY")
    return out.select("market", state.alias("state"), "usable", F.round(F.coalesce(F.try_divide("usable", "total"), F.lit(0.0)), 8).alias("coverage"))


def overall_readiness(checks: DataFrame, by: list[str], expected: int = 10) -> DataFrame:
    """READY with all checks ready, ERROR with any in error, PARTIAL with a ready base model, else ACTION_REQUIRED."""
    ready = F.col("status") == "READY"
    count = lambda test: F.count(F.when(test, 1))
    state = (
        F.when((F.count("*") == expected) & (count(ready) == expected), "READY")
        .when(count(F.col("status") == "ERROR") > 0, "ERROR")
        .when(count(ready & (F.col("check") == "base_model")) > 0, "PARTIAL")
        .otherwise("ACTION_REQUIRED")
    )
    return checks.groupBy(*by).agg(state.alias("state"))


def model_coverage(matches: DataFrame, competitions: DataFrame, teams: DataFrame, predicted: DataFrame, least: int = 5) -> DataFrame:
    """(id, state): UNSUPPORTED competition, UNRESOLVED team, MISSING_INPUT below ``least`` earlier finished matches of a
    side, READY with a prediction, else SUPPORTED. Each is one equi-join; earlier matches are counted by a window."""
    from pitchlake.operators import form

    before = form.trailing(form.team_view(matches), ["team"], 1 << 40, {}).select("id", "team", "n")
    of = lambda side: before.select("id", F.col("team").alias(side), F.col("n").alias(f"{side}_n"))
    known = lambda side: teams.select(F.col("team").alias(side), F.lit(True).alias(f"{side}_known")).distinct()
    out = matches.join(of("home"), ["id", "home"]).join(of("away"), ["id", "away"]).join(known("home"), "home", "left").join(known("away"), "away", "left")
    out = out.join(competitions.select("competition", F.lit(True).alias("ok")).distinct(), "competition", "left")
    out = out.join(predicted.select("id", F.lit(True).alias("predicted")).distinct(), "id", "left")
    state = (
        F.when(F.col("ok").isNull(), "UNSUPPORTED")
        .when(F.col("home_known").isNull() | F.col("away_known").isNull(), "UNRESOLVED")
        .when(F.least("home_n", "away_n") < least, "MISSING_INPUT")
        .when(F.col("predicted").isNotNull(), "READY")
        .otherwise("SUPPORTED")
    )
    return out.select("id", state.alias("state"))


def work_queue(rows: DataFrame, priority: Column, checked: str, key: str, limit: int = 256) -> DataFrame:
    """The next rows to work on: by priority, longest unchecked (never first), then key."""
    return rows.orderBy(priority, F.asc_nulls_first(checked), key).limit(limit)


def page(rows: DataFrame, order: list[Column | str], limit: int | None = None) -> DataFrame:
    """At most ``limit`` rows, 20 by default, between 1 and 100."""
    return rows.orderBy(*order).limit(min(max(20 if limit is None else limit, 1), 100))


def choices(sources: DataFrame, targets: DataFrame, block: str, most: int = 5) -> DataFrame:
    """(source_id, target_id, score, rank): the most similar targets of each source's block; of equals the smaller id."""
    named = lambda df, p: df.select(block, F.col("id").alias(f"{p}_id"), E.team_key(F.col("name")).alias(f"{p}_name"))
    return nearest_names(named(sources, "source"), named(targets, "target"), block, most)


def safe_choices(found: DataFrame, least: float = 0.92, margin: float = 0.05) -> DataFrame:
    """The best choice of each source that is at least ``least`` and ``margin`` ahead of the second."""
    best = F.max(F.when(F.col("rank") == 1, F.struct("target_id", "score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    out = found.groupBy("source_id").agg(best.alias("b"), second.alias("s"))
    ok = (F.col("b.score") >= least) & (F.col("s").isNull() | (F.col("b.score") - F.col("s") >= margin))
    return out.filter(ok).select("source_id", F.col("b.target_id").alias("target_id"), F.col("b.score").alias("score"))


def identity(events: DataFrame, slots: DataFrame, aliases: DataFrame, mappings: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(event, side, team, source) of teams named by events: the event's known slot, an alias of the competition, a provider's
    mapping, the exact name, a safe similar name, else a new team of this competition, in this order."""
    key = E.team_key(F.col("name"))
    rows = events.withColumn("key", key)
    steps = [
        ("PROVIDER_EVENT_SLOT", slots, ["event", "side"]),
        ("SCOPED_ALIAS", aliases, ["competition", "key"]),
        ("PROVIDER_MAPPING", mappings, ["name"]),
        ("EXACT", exact, ["competition", "name"]),
        ("SAFE_SIMILAR", fuzzy, ["event", "side"]),
    ]
    for name, table, on in steps:
        rows = rows.join(table.select(*on, F.col("team").alias(f"_{name}")), on, "left")
    found = F.coalesce(*[F.col(f"_{name}").cast("string") for name, *_ in steps], F.concat(F.lit("competition:"), F.col("competition"), F.lit(":name:"), F.col("key")))
    source = F.lit("NEW")
    for name, *_ in reversed(steps):
        source = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(source)
    return rows.select("event", "side", found.alias("team"), source.alias("source"))


def enqueue(events: DataFrame, queued: DataFrame, supported: DataFrame, now: Column) -> DataFrame:
    """Events to resolve: future, scheduled, of a supported competition, and not queued yet."""
    due = events.filter((F.col("status") == "scheduled") & (F.col("kick") > now))
    return due.join(supported.select("competition").distinct(), "competition", "left_semi").join(queued.select("id"), "id", "left_anti")


# States that wait for another try, and when one comes again.
WAITING = ["NEW", "RETRY_LATER", "AMBIGUOUS", "MANUAL_REVIEW"]
AGAIN = {"RETRY_LATER": "interval '5' minute", "MANUAL_REVIEW": "interval '1' day"}


def retry_queue(queue: DataFrame, matches: DataFrame, now: Column, lease_minutes: int = 10, limit: int = 128) -> DataFrame:
    """The next batch of a resolution queue (id, state, attempts, retry_at, leased_at), each as AUTO_RESOLVING with one more
    attempt: rows that wait, whose time has come or who have none, of scheduled future matches, by kickoff, then match. Work
    that was leased longer than ``lease_minutes`` ago waits again, without a time."""
    stale = (F.col("state") == "AUTO_RESOLVING") & (F.col("leased_at") < now - F.expr(f"interval '{lease_minutes}' minute"))
    waiting = queue.withColumn("retry_at", F.when(~F.coalesce(stale, F.lit(False)), F.col("retry_at")))
    waiting = waiting.filter(F.coalesce(stale, F.lit(False)) | F.col("state").isin(WAITING)).filter(F.col("retry_at").isNull() | (F.col("retry_at") <= now))
    due = matches.filter((F.col("status") == "scheduled") & (F.col("kick") > now)).select("id", "kick")
    batch = waiting.join(due, "id").orderBy("kick", "id").limit(min(limit, 128))
    return batch.withColumns({"state": F.lit("AUTO_RESOLVING"), "attempts": F.col("attempts") + 1, "leased_at": now}).drop("kick")


def tried(batch: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """``batch`` after its tries (id, outcome; null: the try failed): RESOLVED and UNSUPPORTED have no next time, a failed try
    comes again in five minutes, one for review in a day."""
    rows = batch.drop("state").join(results, "id").withColumn("state", F.coalesce("outcome", F.lit("RETRY_LATER"))).drop("outcome")
    later = F.lit(None)
    for state, wait in AGAIN.items():
        later = F.when(F.col("state") == state, now + F.expr(wait)).otherwise(later)
    return rows.withColumn("retry_at", later)
