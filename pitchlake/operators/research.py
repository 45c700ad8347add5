"""Goal-market research: component scores, safety filters, ranked selections, weight families, blocks, blends and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E
from pitchlake.session import checkpointed

# The components of a score, their weights by line, the floors of the policy before, and the changed components
# of the weight family.
COMPONENTS = ["probability", "goal_distribution", "ev", "odds", "attack", "concession", "btts", "league", "quality"]
WEIGHTS = {2.5: (0.28, 0.12, 0.15, 0.08, 0.10, 0.08, 0.08, 0.06, 0.05), 3.5: (0.26, 0.18, 0.15, 0.06, 0.12, 0.10, 0.03, 0.06, 0.04)}
OLD_FLOORS = {2.5: 0.64, 3.5: 0.52}
FAMILY_TARGETS, FAMILY_DELTAS = (1, 2, 4, 5, 7, 8), (-0.03, 0.06)
REQUIRED = ["probability", "expected_goals", "odds", "ev", "attack", "concession", "btts", "league_goals", "quality"]


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def components() -> list[Column]:
    c = F.col
    return [
        c("probability"), _clip(c("expected_goals") / 6), _clip(c("ev") + 0.5), _clip(1 / c("odds")), _clip(c("attack") / 5), _clip(c("concession") / 5), c("btts"),
        _clip(c("league_goals") / 4), c("quality"),
    ]


def weighted(weights: tuple, values: list[Column]) -> Column:
    parts = [F.lit(float(w)) * x for w, x in zip(weights, values)]
    return 100 * sum(parts[1:], parts[0])


def score(weights: tuple) -> Column:
    return weighted(weights, components())


def safety(probability_floor: float, ev_floor: float) -> Column:
    """The first reason not to rank a row, or null."""
    c, missing = F.col, F.lit(False)
    for name in REQUIRED:
        missing = missing | ~_finite(c(name))
    return (
        F.when(missing, "MISSING_INPUT_OR_PRICE")
        .when(~c("probability").between(0, 1) | ~c("btts").between(0, 1), "INVALID_PROBABILITY")
        .when(~F.coalesce("prematch_valid", F.lit(False)), "INVALID_PREMATCH_PROVENANCE")
        .when(F.coalesce("history", F.lit(0)) < 5, "INSUFFICIENT_HISTORY")
        .when((c("odds") <= 1) | (c("odds") > 8), "INVALID_OR_EXTREME_ODDS")
        .when(~c("odds_age_hours").between(0, 24), "STALE_OR_FUTURE_ODDS")
        .when(c("probability") < probability_floor, "PROBABILITY_SAFETY_FLOOR")
        .when(c("ev") < ev_floor, "EV_SAFETY_FLOOR")
    )


def daily_selections(rows: DataFrame, weights: tuple, probability_floor: float, ev_floor: float, cutoff: float, most: int = 7, least: int = 5) -> DataFrame:
    """The ``most`` best rows of each date by score, probability and match among the safe ones that reach ``cutoff``; none on
    dates where fewer than ``least`` do. A match that is safe twice on a date is an error."""
    safe = rows.filter(safety(probability_floor, ev_floor).isNull()).withColumn("score", score(weights))
    twice = F.count("*").over(Window.partitionBy("date", "match_id")) > 1
    safe = safe.withColumn("score", F.when(twice, F.raise_error(F.lit("duplicate fixture in goal-market input")).cast("double")).otherwise(F.col("score")))
    above = safe.filter(F.col("score") >= cutoff)
    order = Window.partitionBy("date").orderBy(F.desc("score"), F.desc("probability"), "match_id")
    above = above.withColumns({"rank": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("date"))})
    return above.filter((F.col("_n") >= least) & (F.col("rank") <= most)).drop("_n")


def old_selection(rows: DataFrame, line: float) -> DataFrame:
    """The policy before: a floor by line, positive value, valid provenance, a price above 1."""
    return rows.filter(_finite(F.col("odds")) & (F.col("odds") > 1) & (F.col("probability") >= OLD_FLOORS[line]) & (F.col("ev") > 0) & F.col("prematch_valid"))


def selection_metrics(rows: DataFrame) -> DataFrame:
    """One row: bets, hit rate, return, mean odds, Brier, gap, and the dates with five to seven bets as coupons.

    Where a bet has no price there is no return. Coupons are made from sums by date, so no date's rows meet in one place.
    """
    won, profit = F.col("won").cast("double"), F.col("won").cast("double") * F.col("odds") - 1
    days = rows.groupBy("date").agg(
        F.count("*").alias("n"), F.count("odds").alias("priced"), F.sum(won).alias("won"), F.sum(profit).alias("profit"), F.sum("odds").alias("odds"),
        F.sum(E.brier(F.col("probability"), won)).alias("brier"), F.sum(F.col("probability") - won).alias("gap"),
        (F.product("odds") * F.min(won) - 1).alias("coupon"),
    )
    n, coupon = F.sum("n"), F.when(F.col("n").between(5, 7), F.col("coupon"))
    priced = F.sum("priced") == n
    return days.agg(
        n.alias("bets"),
        F.round(F.sum("won") / n, 8).alias("hit_rate"),
        F.when(priced, F.round(F.sum("profit") / n, 8)).alias("roi"),
        F.when(priced, F.round(F.sum("odds") / n, 8)).alias("average_odds"),
        F.round(F.sum("brier") / n, 8).alias("brier"),
        F.round(F.sum("gap") / n, 8).alias("calibration_gap"),
        F.count(coupon).alias("coupons"),
        F.when(priced, F.round(F.avg(coupon), 8)).alias("coupon_roi"),
    )


def weight_family(line: float) -> list[tuple]:
    """The weights of a line, and small changes that move probability weight to one other component."""
    base = WEIGHTS[line]
    out = [base]
    for target in FAMILY_TARGETS:
        for delta in FAMILY_DELTAS:
            out.append(tuple(w - delta if i == 0 else w + delta if i == target else w for i, w in enumerate(base)))
    return out


#: Shares of a day's matches whose best scores bound the seventh best.
SHARES = 64


def tune(rows: DataFrame, line: float, floors: list[float], ev_floors: list[float], cutoffs: list[float], least_bets: int = 150) -> DataFrame:
    """Return of every policy of the grid, one row each, with objective ROI - 1.96 se - |gap| / 4: the policies are a constant
    that multiplies rows before their daily ranking, so all of them are one plan.

    Only a day's best seven matter. Of the best scores of its ``SHARES`` by match, the seventh bounds them from below: what is
    under it is left out before rows are ranked, so the ranking sees few rows however many there are.
    """
    safe = rows.filter(safety(min(floors), min(ev_floors)).isNull())
    names = [f"_{c}" for c in COMPONENTS]
    safe = safe.select("date", "match_id", "probability", "odds", "ev", "won", *[c.alias(n) for n, c in zip(names, components())])
    scores = F.array(*[weighted(w, [F.col(n) for n in names]) for w in weight_family(line)])
    tried = safe.select("date", "match_id", "probability", "odds", "ev", "won", F.posexplode(scores).alias("family", "score"))
    limits = F.array(*[F.struct(F.lit(p).alias("floor"), F.lit(e).alias("ev_floor"), F.lit(c).alias("cutoff")) for p in floors for e in ev_floors for c in cutoffs])
    tried = tried.select("*", F.explode(limits).alias("g")).select("*", "g.*").drop("g")
    tried = tried.filter((F.col("probability") >= F.col("floor")) & (F.col("ev") >= F.col("ev_floor")) & (F.col("score") >= F.col("cutoff")))
    keys = ["family", "floor", "ev_floor", "cutoff"]
    best = tried.groupBy(*keys, "date", F.pmod(F.xxhash64("match_id"), F.lit(SHARES)).alias("_share")).agg(F.max("score").alias("_best"))
    nth = Window.partitionBy(*keys, "date").orderBy(F.desc("_best"))
    least = checkpointed(best.withColumn("_nth", F.row_number().over(nth)).filter("_nth = 7").select(*keys, "date", "_best"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*keys, "date"]]
    tried = tried.alias("t").join(F.broadcast(least.alias("l")), same, "left").filter("_best IS NULL OR score >= _best").select("t.*")
    order = Window.partitionBy(*keys, "date").orderBy(F.desc("score"), F.desc("probability"), "match_id")
    ranked = tried.withColumns({"rank": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*keys, "date"))}).filter("_n >= 5 AND rank <= 7")
    won = F.col("won").cast("double")
    profit = won * F.col("odds") - 1
    out = ranked.groupBy(*keys).agg(F.count("*").alias("bets"), F.avg(profit).alias("roi"), F.stddev_pop(profit).alias("sd"), F.avg(F.col("probability") - won).alias("gap"))
    objective = F.col("roi") - 1.96 * F.col("sd") / F.sqrt("bets") - 0.25 * F.abs("gap")
    return out.filter(F.col("bets") >= least_bets).select(*keys, "bets", F.round("roi", 8).alias("roi"), F.round("gap", 8).alias("gap"), F.round(objective, 8).alias("objective"))


def agreed_prices(rows: DataFrame, key: list[str], price: str) -> DataFrame:
    """Prices by key; keys with two different prices are dropped."""
    prices = rows.filter(F.col(price).isNotNull()).groupBy(*key).agg(F.countDistinct(price).alias("_n"), F.min(price).alias(price))
    return prices.filter("_n = 1").drop("_n")


def blocks(rows: DataFrame, time: str) -> DataFrame:
    """(rows..., block, part): four expanding folds over dates. A fold tests the next stretch of dates; those before it are
    split 65 / 80 / 90 % into fit, tune, calibrate and late, without the two days before every next stage.

    Dates are numbered alone; their number is bounded by time, not by rows.
    """
    days = rows.select(F.to_date(time).alias("day")).distinct()
    numbered = days.withColumns({"nth": F.row_number().over(Window.orderBy("day")) - 1, "n": F.count("*").over(Window.partitionBy())})
    n = numbered.agg(F.max("n")).first()[0] or 0
    named = {r["nth"]: r["day"] for r in numbered.collect()}  # one date a day
    edges = [int(n * p) for p in (0.4, 0.55, 0.7, 0.85, 1.0)]
    out = None
    day = F.to_date(time)
    for block, (start, stop) in enumerate(zip(edges, edges[1:])):
        if not start or start >= n:
            continue
        cuts = [named[int(start * p)] for p in (0.65, 0.8, 0.9)] + [named[start]]
        last = F.lit(named[stop]) if stop < n else F.lit("9999-01-01").cast("date")
        before = [F.date_sub(F.lit(c), 2) for c in cuts]
        lits = [F.lit(c) for c in cuts]
        part = F.when(day < before[0], "fit")
        for name, low, high in zip(("tune", "calibrate", "late"), lits, before[1:]):
            part = part.when((day >= low) & (day < high), name)
        part = part.when((day >= lits[3]) & (day < last), "test")
        one = rows.withColumns({"block": F.lit(block), "part": part}).filter("part IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.withColumns({"block": F.lit(0), "part": F.lit("")}).limit(0)


# Reasons that hold whatever the figures: no priced history, and no untouched holdout.
ALWAYS = ["NO_TIMESTAMPED_PRICES", "NO_FRESH_HOLDOUT"]


def adoption(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``reasons`` against the nominated model: one per rule that it misses, in order, then those that always
    hold. Material improvement of both losses, a tenth more selections, no fewer matches above the probability floor before a
    price is asked for, and coupons that are as many on Saturdays and no worse."""
    c = F.col
    probability = (c("brier") <= 0.99 * c("base_brier")) & (c("log_loss") <= 0.99 * c("base_log_loss")) & (c("upper95") < 0)
    enough = c("bets") >= F.greatest(F.lit(1.0), 1.1 * c("base_bets"))
    known = c("coupon_roi").isNotNull() & c("base_coupon_roi").isNotNull()
    coupons = known & (c("full_saturdays") >= c("base_full_saturdays")) & (c("coupon_roi") >= c("base_coupon_roi")) & (c("drawdown") <= c("base_drawdown"))
    rules = [
        ("PROBABILITY_NOT_IMPROVED", probability),
        ("AVAILABILITY_NOT_IMPROVED", enough),
        ("FLOOR_AVAILABILITY_FALLS", c("above_floor") >= c("base_above_floor")),
        ("COUPONS_DEGRADED", coupons),
    ]
    missed = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]
    return metrics.withColumn("reasons", F.array_compact(F.array(*missed, *[F.lit(x) for x in ALWAYS])))


# -- probabilities of goal markets ---------------------------------------------------------------------------------------


def monotone(values: list[Column]) -> list[Column]:
    """Each value no larger than the ones before it."""
    return [F.least(*values[: i + 1]) if i else v for i, v in enumerate(values)]


def blend(a: list[Column], b: list[Column], w: float) -> list[Column]:
    """A convex mix of two distributions, normalised."""
    mixed = [w * x + (1 - w) * y for x, y in zip(a, b)]
    total = sum(mixed[1:], mixed[0])
    return [x / total for x in mixed]


def select_blend(rows: DataFrame, ml: str, other: str, label: str) -> DataFrame:
    """(w, loss): the weight of ``ml`` among 0, .05 ... 1 with the least log loss; of equal losses the first."""
    w = F.explode(F.array(*[F.lit(i * 0.05) for i in range(21)])).alias("w")
    q = F.least(F.greatest(F.col("w") * F.col(ml) + (1 - F.col("w")) * F.col(other), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col(label)
    losses = rows.select(ml, other, label, w).groupBy("w").agg(F.sum(-y * F.log(q) - (1 - y) * F.log(1 - q)).alias("loss"))
    return losses.agg(F.min(F.struct("loss", "w")).alias("b")).select(F.col("b.w").alias("w"), F.col("b.loss").alias("loss"))


def goal_markets(home: Column, away: Column, most: int = 40) -> dict[str, Column]:
    """1X2, totals, team totals and both-score of two independent Poisson counts: totals in closed form, 1X2 by the chance of
    fewer away goals for every number of home goals, normalised."""
    h, a = E.poisson_list(home, most), E.poisson_list(away, most)
    # One pass over both: the away goals below so far, and the sums of the three results.
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("below", "home", "draw")])
    step = lambda s, x: F.struct((s["below"] + x["a"]).alias("below"), (s["home"] + x["h"] * s["below"]).alias("home"), (s["draw"] + x["h"] * x["a"]).alias("draw"))
    sums = F.aggregate(F.arrays_zip(h.alias("h"), a.alias("a")), start, step)
    total_h, total_a = (F.aggregate(x, F.lit(0.0), lambda s, y: s + y) for x in (h, a))
    total = total_h * total_a
    over = lambda rate, line: 1 - sum((F.exp(-rate) * F.pow(rate, F.lit(k)) / F.factorial(F.lit(k)) for k in range(1, int(line) + 1)), F.exp(-rate))
    both = 1 - F.exp(-home) - F.exp(-away) + F.exp(-(home + away))
    out = {"home": sums["home"] / total, "draw": sums["draw"] / total, "away": 1 - (sums["home"] + sums["draw"]) / total}
    out |= {f"over_{int(x * 10)}": over(home + away, x) for x in (1.5, 2.5, 3.5)}
    out |= {f"{side}_over_{int(x * 10):02d}": over(rate, x) for side, rate in (("home", home), ("away", away)) for x in (0.5, 1.5)}
    return out | {"btts": F.least(F.greatest(both, F.lit(0.0)), F.lit(1.0))}


# The binary markets that inference expands, by the column of their probability.
EXPANDED = [
    ("TOTAL_GOALS", 1.5, "over_15"),
    ("TOTAL_GOALS", 2.5, "over_25"),
    ("TOTAL_GOALS", 3.5, "over_35"),
    ("HOME_TEAM_TOTAL_GOALS", 0.5, "home_over_05"),
    ("HOME_TEAM_TOTAL_GOALS", 1.5, "home_over_15"),
    ("AWAY_TEAM_TOTAL_GOALS", 0.5, "away_over_05"),
    ("AWAY_TEAM_TOTAL_GOALS", 1.5, "away_over_15"),
]


def expanded(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, market, selection, line, p, availability): every market of a match, a binary one as two complementary rows; a
    market without a probability is one UNAVAILABLE row."""
    row = lambda market, selection, line, p: F.struct(
        F.lit(market).alias("market"), F.lit(selection).alias("selection"), F.lit(line).cast("double").alias("line"), p.alias("p")
    )
    made = [row("MATCH_RESULT", s, None, F.col(s.lower())) for s in ("HOME", "DRAW", "AWAY")]
    made += [row("BTTS", "YES", None, F.col("btts")), row("BTTS", "NO", None, 1 - F.col("btts"))]
    for market, line, column in EXPANDED:
        made += [row(market, "OVER", line, F.col(column)), row(market, "UNDER", line, 1 - F.col(column))]
    out = rows.select(key, F.explode(F.array(*made)).alias("m")).select(key, "m.*")
    return out.withColumn("availability", F.when(F.col("p").isNull(), "UNAVAILABLE").otherwise("AVAILABLE"))
