"""Team history: team-centric rows, trailing form, head to head, rest, league baselines, Elo, decayed means.

History is strictly earlier than the match: matches of the same instant see none of one another. A trailing window counts
matches, also those without statistics; a mean is null below three values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.session import checkpointed

MIN_SAMPLE = 3


#: A match's statistics by name: the columns of the home and the away side.
STATISTICS = {"corners": ("hc", "ac"), "shots": ("hs", "as_"), "on_target": ("hst", "ast"), "fouls": ("hf", "af"), "yellow": ("hy", "ay"), "red": ("hr", "ar")}


def team_view(matches: DataFrame) -> DataFrame:
    """Each match twice: (id, kick, competition, finished, team, opponent, at_home, gf, ga), and for every statistic there is,
    its values for and against, null unless both sides have one."""
    known = {k: v for k, v in STATISTICS.items() if set(v) <= set(matches.columns)}

    def side(home: bool) -> Column:
        team, other = ("home", "away") if home else ("away", "home")
        goals = [F.col(c) for c in (("hg", "ag") if home else ("ag", "hg"))]
        out = [F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("at_home"), goals[0].alias("gf"), goals[1].alias("ga")]
        for name, pair in known.items():
            both = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
            own, against = pair if home else pair[::-1]
            out += [F.when(both, F.col(own)).alias(f"{name}_for"), F.when(both, F.col(against)).alias(f"{name}_against")]
        return F.struct(*out)

    both = matches.select("id", "kick", "competition", "finished", F.explode(F.array(side(True), side(False))).alias("s"))
    return both.select("id", "kick", "competition", "finished", "s.*")


def trailing(rows: DataFrame, keys: list[str], last: int, measures: dict[str, Column]) -> DataFrame:
    """``rows``, less columns named like a measure, with ``n``, how many of the ``last`` finished rows of the key lie before the row's instant, and the sum of each
    measure over these; a measure's nulls count nothing but take a place.

    Sums over a trailing stretch are differences of running sums, so a row needs two rows of its key: the last one before its
    instant, and the one ``last`` earlier. Both are equi-joins on (key, number); keys compare as equi-joins do, so null never.
    """
    done = rows.filter("finished")
    order = Window.partitionBy(*keys).orderBy("kick", "id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = done.select(
        *keys,
        F.row_number().over(order).alias("nth"),
        F.struct(*[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(k) for k, c in measures.items()]).alias("s"),
    )
    before = Window.partitionBy(*keys).orderBy("kick").rangeBetween(Window.unboundedPreceding, 0)
    finished = F.col("finished").cast("long")
    asked = rows.withColumn("_upto", F.sum(finished).over(before) - F.sum(finished).over(Window.partitionBy(*keys, "kick")))
    asked = asked.withColumn("_from", F.greatest(F.col("_upto") - last, F.lit(0)))
    hi, lo = (sums.select(*keys, F.col("nth").alias(n), F.col("s").alias(s)) for n, s in (("_upto", "_hi"), ("_from", "_lo")))
    joined = asked.join(hi, [*keys, "_upto"], "left").join(lo, [*keys, "_from"], "left")
    sums_of = [(F.coalesce(F.col(f"_hi.{k}"), F.lit(0)) - F.coalesce(F.col(f"_lo.{k}"), F.lit(0))).alias(k) for k in measures]
    return joined.select(*[c for c in rows.columns if c not in measures], (F.col("_upto") - F.col("_from")).alias("n"), *sums_of)


def _mean(total: Column | str, count: str = "n") -> Column:
    """Null below three values."""
    total = F.col(total) if isinstance(total, str) else total
    return F.when(F.col(count) >= MIN_SAMPLE, F.round(total / F.col(count), 8))


def _flag(test: Column) -> Column:
    return test.cast("long")


def _keys(venue: bool) -> list[str]:
    return ["team", "at_home"] if venue else ["team"]


def trailing_form(matches: DataFrame, last: int, venue: bool = False) -> DataFrame:
    """Results of both teams of every match over their last ``last`` finished matches, optionally at the same venue only."""
    gf, ga = F.col("gf"), F.col("ga")
    counts = {
        "clean_sheets": ga == 0,
        "failed_to_score": gf == 0,
        "over_15": gf + ga > 1,
        "over_25": gf + ga > 2,
        "over_35": gf + ga > 3,
        "btts": (gf > 0) & (ga > 0),
    }
    measures = {"wins": _flag(gf > ga), "draws": _flag(gf == ga), "goals_for": gf, "goals_against": ga, **{k: _flag(c) for k, c in counts.items()}}
    out = trailing(team_view(matches), _keys(venue), last, measures)
    return out.select(
        "id",
        "team",
        "n",
        "wins",
        "draws",
        (F.col("n") - F.col("wins") - F.col("draws")).alias("losses"),
        _mean(3 * F.col("wins") + F.col("draws")).alias("ppm"),
        *[_mean(k).alias(k) for k in ("goals_for", "goals_against")],
        _mean(F.col("goals_for") - F.col("goals_against")).alias("goal_difference"),
        *[_mean(k).alias(k) for k in counts],
    )


def trailing_statistics(matches: DataFrame, kind: str, last: int, venue: bool = False) -> DataFrame:
    """Means of a kind of statistics over the last ``last`` finished matches, of those that have them: ``shooting`` (shots and
    shots on target), ``corners``, ``cards`` (yellow and red) or ``fouls``."""
    own = lambda name: (F.col(f"{name}_for"), F.col(f"{name}_against"))
    need = {"shooting": ["shots", "on_target"], "cards": ["yellow", "red"]}.get(kind, [kind])
    there = F.lit(True)
    for name in need:
        there = there & F.col(f"{name}_for").isNotNull()
    measures = {"matches": there}
    for name in need:
        measures |= {f"{name}_for": own(name)[0], f"{name}_against": own(name)[1]}
    lines = {"corners": ("corners", range(7, 12)), "cards": ("yellow", range(2, 7))}.get(kind)
    overs = {f"over_{x}5": own(lines[0])[0] + own(lines[0])[1] > x for x in lines[1]} if lines else {}
    measures = {k: F.when(there, c.cast("long")) for k, c in {**measures, **overs}.items()}
    out = trailing(team_view(matches), _keys(venue), last, measures)
    mean = lambda name, c=None: _mean(c if c is not None else name, "matches").alias(name)
    c = F.col
    if kind == "shooting":
        share = lambda name, a, b: F.when((c("matches") >= MIN_SAMPLE) & (c(b) > 0), F.round(c(a) / c(b), 8)).alias(name)
        more = [mean(x) for x in ("shots_for", "shots_against", "on_target_for", "on_target_against")]
        more += [share("accuracy", "on_target_for", "shots_for"), share("opponent_accuracy", "on_target_against", "shots_against")]
    elif kind == "cards":
        more = [mean("yellow_for"), mean("yellow_against"), mean("red_for"), mean("team_cards", c("yellow_for") + c("red_for"))]
        more += [mean("match_yellow", c("yellow_for") + c("yellow_against")), mean("match_red", c("red_for") + c("red_against"))]
    else:
        more = [mean(f"{kind}_for"), mean(f"{kind}_against"), mean("total", c(f"{kind}_for") + c(f"{kind}_against"))]
    return out.select("id", "team", "matches", *more, *[mean(k) for k in overs])


def trailing_inputs(matches: DataFrame, last: int) -> DataFrame:
    """What ``trailing_form`` and ``trailing_statistics`` of every kind say in a snapshot of a team's last matches: (id, team, ppm,
    goals_for, goals_against, shots, on_target, corners, yellow, fouls), from one window instead of five."""
    gf, ga = F.col("gf"), F.col("ga")
    measures = {"wins": _flag(gf > ga), "draws": _flag(gf == ga), "goals_for": gf, "goals_against": ga}
    means = {}
    for need in (["shots", "on_target"], ["corners"], ["yellow", "red"], ["fouls"]):
        there = F.lit(True)
        for name in need:
            there = there & F.col(f"{name}_for").isNotNull()
        measures[f"{need[0]}_n"] = F.when(there, 1)
        for name in need:
            if name != "red":
                measures[f"{name}_for"] = F.when(there, F.col(f"{name}_for").cast("long"))
                means[name] = _mean(f"{name}_for", f"{need[0]}_n").alias(name)
    out = trailing(team_view(matches), _keys(False), last, measures)
    points = _mean(3 * F.col("wins") + F.col("draws")).alias("ppm")
    return out.select("id", "team", points, *[_mean(k).alias(k) for k in ("goals_for", "goals_against")], *means.values())


def head_to_head(matches: DataFrame, last: int = 5) -> DataFrame:
    """Mean goals, both-scored and over-2.5 rates of the pair's last meetings, whoever was at home."""
    pair = matches.withColumn("lo", F.least("home", "away")).withColumn("hi", F.greatest("home", "away"))
    goals = F.col("hg") + F.col("ag")
    measures = {"goals": goals, "btts": _flag((F.col("hg") > 0) & (F.col("ag") > 0)), "over_25": _flag(goals > 2)}
    out = trailing(pair, ["lo", "hi"], last, measures)
    return out.select("id", "n", *[_mean(k).alias(k) for k in measures])


def rest_and_congestion(matches: DataFrame) -> DataFrame:
    """Days, to the minute, since the team's last finished match, and how many lie in the 7 and 14 whole days before.

    A team's instants are summed first, and counts within days are differences of running counts: linear in the instants,
    however many matches lie in a window.
    """
    both = F.explode(F.array("home", "away")).alias("team")
    rows = matches.select("id", both, F.unix_seconds(F.col("kick").cast("timestamp")).alias("_at"), F.when(F.col("finished"), 1).alias("_done"))
    instants = rows.groupBy("team", "_at").agg(F.when(F.col("_at").isNotNull(), F.count("_done")).otherwise(0).alias("_n"))
    earlier = Window.partitionBy("team").orderBy("_at")
    last = F.max(F.when(F.col("_n") > 0, F.col("_at"))).over(earlier.rangeBetween(Window.unboundedPreceding, -1))
    upto = lambda seconds: F.coalesce(F.sum("_n").over(earlier.rangeBetween(Window.unboundedPreceding, -seconds)), F.lit(0))
    within = {f"last_{days}": upto(1) - upto((days + 1) * 86400) for days in (7, 14)}
    rest = F.round(F.floor((F.col("_at") - last) / 60) / 1440, 8)
    found = instants.select("team", "_at", rest.alias("rest_days"), *[c.alias(name) for name, c in within.items()])
    on = F.col("r.team").eqNullSafe(F.col("i.team")) & F.col("r._at").eqNullSafe(F.col("i._at"))
    return rows.alias("r").join(found.alias("i"), on).select("id", "r.team", "rest_days", *within)


def league_baseline(matches: DataFrame) -> DataFrame:
    """Goal and outcome means of a competition's finished matches; null below three."""
    n = F.count("*")
    mean = lambda c: F.when(n >= MIN_SAMPLE, F.round(F.avg(c.cast("double")), 8))
    some = lambda c: F.when(F.count(c) >= MIN_SAMPLE, F.round(F.avg(c), 8))
    hg, ag = F.col("hg"), F.col("ag")
    return matches.filter("finished").groupBy("competition").agg(
        n.alias("n"),
        mean(hg).alias("home_goals"),
        mean(ag).alias("away_goals"),
        mean(hg > ag).alias("home_rate"),
        mean(hg == ag).alias("draw_rate"),
        mean((hg > 0) & (ag > 0)).alias("btts_rate"),
        mean(hg + ag > 2).alias("over_25_rate"),
        some(F.col("hc") + F.col("ac")).alias("corners"),
        some(F.col("hy") + F.col("ay")).alias("yellow"),
        some(F.col("hs") + F.col("as_")).alias("shots"),
    )


def training_labels(matches: DataFrame) -> DataFrame:
    """Outcomes of finished matches; statistics labels are null where a side is missing."""
    total = F.col("hg") + F.col("ag")
    return matches.filter("finished").select(
        "id",
        F.when(F.col("hg") > F.col("ag"), "HOME").when(F.col("hg") == F.col("ag"), "DRAW").otherwise("AWAY").alias("result"),
        total.alias("total"),
        *[(total > line).alias(f"over_{int(line * 10)}") for line in (1.5, 2.5, 3.5)],
        ((F.col("hg") > 0) & (F.col("ag") > 0)).alias("btts"),
        (F.col("hc") + F.col("ac")).alias("corners"),
    )


def systems(matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``matches`` with ``system``, the smallest team of all that are linked with theirs by matches of the same ``by``.

    The smallest label spreads along pairs of teams, and along labels, until nothing changes: rounds are few, and a round is
    about pairs of teams, not about matches.
    """
    pairs = matches.select(*by, F.col("home").alias("a"), F.col("away").alias("b")).distinct()
    both = checkpointed(pairs.union(pairs.select(*by, "b", "a")).distinct())
    labels = both.groupBy(*by, "a").agg(F.least("a", F.min("b")).alias("label"))
    while True:
        told = both.join(labels.withColumnRenamed("a", "b"), [*by, "b"]).select(*by, "a", "label")
        spread = labels.union(told).groupBy(*by, "a").agg(F.min("label").alias("label"))
        above = spread.select(*by, F.col("a").alias("label"), F.col("label").alias("above"))
        new = spread.join(above, [*by, "label"]).select(*by, "a", F.col("above").alias("label"))
        new = checkpointed(new)
        if new.join(labels.withColumnRenamed("label", "old"), [*by, "a"]).filter("label <> old").isEmpty():
            return matches.join(new.select(*by, F.col("a").alias("home"), F.col("label").alias("system")), [*by, "home"])
        labels = new


#: Matches of a time slice of a rating fold, and its slices at most: each is a few jobs, which the driver keeps account of.
SLICE, SLICES = 200_000, 12


def time_slices(matches: DataFrame, rows: int) -> list[tuple]:
    """(first day, last day) of stretches of whole days with about ``rows`` matches each; the table has a row a day."""
    days = matches.groupBy(F.to_date("kick").alias("day")).count().orderBy("day").collect()
    slices, held = [], 0
    for day, n in days:
        if day is not None:
            if not slices or held + n > rows:
                slices.append((day, day))
                held = 0
            slices[-1], held = (slices[-1][0], day), held + n
    return slices


def elo(matches: DataFrame, start: float = 1500.0, k: float = 20.0, home: float = 60.0, scale: float = 400.0, slice_rows: int | None = None) -> DataFrame:
    """Ratings before every match: (id, home_elo, away_elo, expected_home).

    An ordered fold over time slices against a checkpointed table of ratings, one row a team: a slice's matches are joined with
    it, the teams that they link (column ``system``, found within the slice if it is not there) go through one task each in
    order, which holds a number a team, and what they end with replaces the old ratings. So however long a linked league's
    history is, a task sees one slice of it: ``slice_rows`` matches, or ``SLICE`` and a share of 1 / ``SLICES`` at least. Matches of one instant all read the ratings from before it; matches without
    kickoff take no part.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    names = ["id", "home_elo", "away_elo", "expected_home", "team", "rating"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating: dict[int, float] = {}
        at, updates = None, []

        def settle() -> None:
            for one, other, move in updates:
                rating[one] += move
                rating[other] -= move
            updates.clear()

        def final() -> list[tuple]:
            settle()
            return [(None, None, None, None, team, value) for team, value in rating.items()]

        for batch in batches:
            out = []
            for system, kick, n, h, a, hg, ag, finished, was_h, was_a in zip(*(c.to_pylist() for c in batch.columns)):
                if (system, kick) != at:
                    if at is not None and system != at[0]:
                        out += final()
                        rating = {}
                    settle()
                    at = (system, kick)
                mine, theirs = rating.setdefault(h, was_h), rating.setdefault(a, was_a)
                expected = 1 / (1 + 10 ** ((theirs - mine - home) / scale))
                out.append((n, mine, theirs, expected, None, None))
                if finished:
                    updates.append((h, a, k * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - expected)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if rest := final():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), kinds)], names)

    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
    schema = "id long, home_elo double, away_elo double, expected_home double, team long, rating double"
    ratings, done = None, matches.sparkSession.createDataFrame([], schema)
    slices = time_slices(matches, slice_rows or max(SLICE, -(-matches.count() // SLICES)))
    number = sum((F.when(F.to_date("kick") > last, 1).otherwise(0) for _, last in slices[:-1]), F.lit(0))
    dealt = matches.filter("kick IS NOT NULL").withColumn("slice", number)
    dealt = dealt if "system" in matches.columns else systems(dealt, ("slice",))
    for nth in range(len(slices)):
        part = dealt.filter(F.col("slice") == nth)
        part = part.select("system", "kick", "id", "home", "away", "hg", "ag", "finished")
        for side in ("home", "away"):
            if ratings is None:
                part = part.withColumn(f"_{side}", F.lit(start))
            else:
                was = ratings.select(F.col("team").alias(side), F.col("rating").alias(f"_{side}"))
                part = part.join(was, side, "left").fillna(start, [f"_{side}"])
        ordered = part.select("system", "kick", "id", "home", "away", "hg", "ag", "finished", "_home", "_away")
        ordered = ordered.repartition("system").sortWithinPartitions("system", "kick", "id")
        folded = checkpointed(ordered.mapInArrow(fold, schema))
        now = folded.filter("team IS NOT NULL").select("team", "rating")
        ratings = now if ratings is None else checkpointed(ratings.join(now, "team", "left_anti").unionByName(now))
        done = done.unionByName(folded.filter("team IS NULL"))
    return done.select("id", "home_elo", "away_elo", "expected_home")


def opponent_strength(matches: DataFrame, ratings: DataFrame, last: int = 5) -> DataFrame:
    """Mean rating of the team's last opponents, as they were before those matches; null below three."""
    rated = matches.join(ratings, "id")
    side = lambda team, rating: F.struct(F.col(team).alias("team"), F.col(rating).alias("faced"))
    rows = rated.select("id", "kick", "finished", F.explode(F.array(side("home", "away_elo"), side("away", "home_elo"))).alias("s"))
    out = trailing(rows.select("id", "kick", "finished", "s.*"), ["team"], last, {"sum": F.col("faced")})
    return out.select("id", "team", "n", F.when(F.col("n") >= MIN_SAMPLE, F.round(F.col("sum") / F.col("n"), 6)).alias("opponent_elo"))


def decayed_form(matches: DataFrame, last: int = 10, venue: bool = False, half_life: float = 90.0, prior_weight: float = 5.0) -> DataFrame:
    """Goals for and against over the last ``last`` finished matches, weighted by 2^(-elapsed days / half life) and shrunk to
    half the competition's goals a match (column ``league_goals``; 2.6 where it has none) by ``prior_weight``.

    With weights relative to a fixed instant both sums are running sums: sum(2^(t/H) x) * 2^(-T/H).
    """
    rows = team_view(matches).join(matches.select("id", F.coalesce("league_goals", F.lit(2.6)).alias("_league")), "id")
    days = (F.unix_seconds(F.col("kick").cast("timestamp")) - 757382400) / 86400  # since 1994: keeps the powers near one
    w = F.pow(F.lit(2.0), days / half_life)
    out = trailing(rows, _keys(venue), last, {"weight": w, "scored": w * F.col("gf"), "conceded": w * F.col("ga")})
    now = F.pow(F.lit(2.0), -days / half_life)
    shrunk = lambda c: F.round((F.col(c) * now + prior_weight * F.col("_league") / 2) / (F.col("weight") * now + prior_weight), 6)
    return out.select("id", "team", shrunk("scored").alias("scoring"), shrunk("conceded").alias("conceding"), F.round(F.col("weight") * now, 6).alias("effective_history"))
