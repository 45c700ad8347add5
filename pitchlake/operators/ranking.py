"""Candidate scoring, ordered rejection reasons, ranking, top-k and correlation reduction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E

# The categories of candidates, in the order in which a run lists them; those ranked, not selected, every day.
CATEGORIES = ["CORNERS", "OVER_25", "OVER_35", "BTTS_YES", "HIGH_CONFIDENCE", "SURPRISE", "COMPOUND"]
DAILY = ["OVER_25", "BTTS_YES"]


@dataclass(frozen=True)
class Policy:
    """Thresholds and score weights."""

    high_confidence: float = 0.75
    corners: float = 0.50
    over_35: float = 0.52
    surprise_odd: float = 2.0
    surprise_p: float = 0.42
    surprise_edge: float = 0.05
    compound_p: float = 0.72
    compound_low: float = 1.10
    compound_high: float = 1.50
    min_bucket: int = 20
    fresh_hours: int = 24
    weights: tuple = (0.55, 0.25, 0.15, 0.04, 0.01)


def good_quality() -> Column:
    """Five matches of history on either side and, for corners, statistics of half of them."""
    history = F.least("history_home", "history_away")
    coverage = F.when(F.col("market") == "FULL_TIME_TOTAL_CORNERS", F.coalesce("corners_coverage", F.lit(0.0))).otherwise(1.0)
    return (F.coalesce(history, F.lit(0)) >= 5) & (coverage >= 0.5)


def scored(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds implied, edge, ev, confidence, history, components and score to rows with a ``category``.

    A daily category's score is its probability; the others weigh edge, value, calibration and data quality.
    """
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    a, b, c, d, e = policy.weights
    df = df.withColumns(E.value_columns(F.col("p"), F.col("odd")))
    calibrated = F.when(F.col("status") == "CALIBRATED_V1", 1.0).otherwise(0.0)
    quality = F.when(good_quality(), 1.0).otherwise(0.0)
    total = a * F.col("p") + b * unit(F.col("edge")) + c * unit(F.col("ev")) + d * calibrated + e * quality
    n = F.coalesce("n", F.lit(0)).cast("double")
    gap = F.coalesce(F.abs(F.col("p") - F.col("observed")), F.lit(0.0))
    daily = F.col("category").isin(*DAILY)
    parts = {"public_probability": F.col("p"), "edge": F.col("edge"), "expected_value": F.col("ev"), "calibration_support": n, "data_quality": quality}
    return df.withColumns(
        {
            "confidence": F.when(daily, n / (n + 20) * unit(1 - gap)),
            "history": F.when(daily, unit(F.coalesce(F.least("history_home", "history_away"), F.lit(0)) / 10)),
            "score": F.when(daily, F.col("p")).otherwise(total),
            "components": F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]),
        }
    )


def overconfident(p: Column, observed: Column, n: Column) -> Column:
    return observed.between(0, 1) & (n >= 50) & (p - observed > 0.20) & (p - observed > 3 * F.sqrt(p * (1 - p) / n))


#: Categories that ask for good data, beside the daily ones, which call its lack by another name.
CAREFUL = ["CORNERS", "HIGH_CONFIDENCE", "COMPOUND"]


def _first_reason(tests: list[tuple[str, Column]]) -> Column:
    """The first reason whose test holds; null tests do not."""
    return F.coalesce(*[F.when(test, reason) for reason, test in tests])


def shared_rejection(category: str, policy: Policy = Policy()) -> Column:
    """What rejects a row before the category's own gate: the same for all daily, all careful and all other categories."""
    c = F.col
    daily, good = category in DAILY, good_quality()
    invalid = c("odd").isNull() | F.isnan("odd") | (c("odd") == float("inf"))
    tests = [("ODDS_UNAVAILABLE", c("odd").isNull()), ("INVALID_ODDS", invalid | (c("odd") <= 1)), ("MODEL_UNAVAILABLE", c("availability") != "AVAILABLE")]
    if daily:
        n = F.coalesce("n", F.lit(0))
        tests += [
            ("RESOLUTION_FAILED", ~c("identity_valid")),
            ("KICKOFF_UNKNOWN", ~c("kickoff_known")),
            ("INVALID_PROBABILITY", ~E.is_probability(c("p"))),
            ("INSUFFICIENT_HISTORY", ~good),
            ("NEGATIVE_MODEL_QUALITY", c("status").isin("INVALID", "MODEL_INVALID", "REJECTED") | overconfident(c("p"), c("observed"), n)),
        ]
    tests += [("MATCH_FINISHED", c("match_status") == "finished"), ("MATCH_STARTED", c("match_status") != "scheduled")]
    if category in CAREFUL:
        tests.append(("LOW_DATA_QUALITY", ~good))
    # Exactly the limit is still fresh; a price without an age is not.
    tests.append(("STALE_ODDS", c("age_seconds").isNull() | (c("age_seconds") > policy.fresh_hours * 3600)))
    if daily:
        tests.append(("INVALID_ODDS", c("age_seconds") < 0))
    return _first_reason(tests)


def gate(category: str, policy: Policy = Policy()) -> Column:
    """What the category itself rejects."""
    c = F.col
    edge = c("p") - 1 / c("odd")

    def market(name: str, selection: str, lines: list[float] | None) -> Column:
        line = c("line").isin(*lines) if lines else F.lit(True)
        return ~((c("market") == name) & (c("selection") == selection) & F.coalesce(line, F.lit(False)))

    calibrated = c("status") == "CALIBRATED_V1"
    harmless = c("status") == "CALIBRATION_NOT_BENEFICIAL"
    few = F.coalesce("n", F.lit(0)) < policy.min_bucket
    gates = {
        "CORNERS": [
            ("ODDS_MARKET_UNAVAILABLE", market("FULL_TIME_TOTAL_CORNERS", "OVER", E.CORNER_LINES)),
            ("LOW_PUBLIC_PROBABILITY", c("p") < policy.corners),
        ],
        "OVER_25": [("UNSUPPORTED_MARKET", market("TOTAL_GOALS", "OVER", [2.5]))],
        "OVER_35": [
            ("UNSUPPORTED_MARKET", market("TOTAL_GOALS", "OVER", [3.5])),
            ("LOW_PUBLIC_PROBABILITY", c("p") < policy.over_35),
            ("LOW_EDGE", edge <= 0),
        ],
        "BTTS_YES": [("UNSUPPORTED_MARKET", market("BTTS", "YES", None))],
        "HIGH_CONFIDENCE": [
            ("LOW_PUBLIC_PROBABILITY", c("p") < policy.high_confidence),
            ("CALIBRATION_INSUFFICIENT", ~calibrated & ~(harmless & ~few)),
            ("INSUFFICIENT_BUCKET_SAMPLE", few),
        ],
        "SURPRISE": [
            ("LOW_PUBLIC_PROBABILITY", (c("odd") < policy.surprise_odd) | (c("p") < policy.surprise_p)),
            ("LOW_EDGE", edge < policy.surprise_edge),
        ],
        "COMPOUND": [
            ("LOW_PUBLIC_PROBABILITY", c("p") < policy.compound_p),
            ("ODDS_OUTSIDE_COMPOUND_RANGE", ~c("odd").between(policy.compound_low, policy.compound_high)),
            ("CALIBRATION_INSUFFICIENT", ~(calibrated | harmless) | few),
        ],
    }
    return _first_reason(gates[category])


def rejection(category: str, policy: Policy = Policy()) -> Column:
    """The first reason that applies, null for a qualified row. The category's own gate comes last."""
    return F.coalesce(shared_rejection(category, policy), gate(category, policy))


def in_categories(predictions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Each prediction in each category, with ``reason``. What categories share is evaluated once a prediction."""
    shared = {"_daily": DAILY[0], "_careful": CAREFUL[0], "_plain": "SURPRISE"}
    rows = predictions.withColumns({name: shared_rejection(category, policy) for name, category in shared.items()})
    of = lambda k: F.col("_daily" if k in DAILY else "_careful" if k in CAREFUL else "_plain")
    gates = F.array(*[F.struct(F.lit(k).alias("category"), F.coalesce(of(k), gate(k, policy)).alias("reason")) for k in CATEGORIES])
    return rows.select(*predictions.columns, F.explode(gates).alias("_g")).select(*predictions.columns, "_g.*")


def candidate_order() -> list[Column]:
    """Daily categories by probability, value, confidence and history, the others by score; then by match and prediction."""
    daily = F.col("category").isin(*DAILY)
    keys = [F.when(daily, F.col(k)).otherwise(other) for k, other in (("p", F.col("score")), ("ev", F.lit(0.0)), ("confidence", F.lit(0.0)), ("history", F.lit(0.0)))]
    return [*[F.desc(k) for k in keys], F.col("match_id"), F.col("id")]


def candidate_run(predictions: DataFrame, day: str = "day", policy: Policy = Policy()) -> DataFrame:
    """Every prediction in every category, with its rank among the day's candidates or the reason why it is none.

    The best candidate of a match in a category stays; the others are excluded by CORRELATION_REDUCTION. Rejected rows, the
    most by far, are never shuffled; qualified ones are, by (day, category, match) and by (day, category).
    """
    rows = in_categories(predictions, policy)
    passed = scored(rows.filter("reason IS NULL").drop("reason"), policy)
    nth = F.row_number().over(Window.partitionBy(day, "category", "match_id").orderBy(*candidate_order()))
    placed = passed.withColumn("_best", nth == 1)
    rank = F.row_number().over(Window.partitionBy(day, "category").orderBy(F.desc("_best"), *candidate_order()))
    keep = [day, "category", "match_id", "id"]
    more = ["market", "selection", "line", "p", "odd", "ev", "score"]
    best = lambda c: F.when(F.col("_best"), c)
    ranked = placed.withColumn("rank", rank).select(
        *keep, *[best(F.col(c)).alias(c) for c in more], best(F.col("rank")).alias("rank"), F.when(~F.col("_best"), "CORRELATION_REDUCTION").alias("reason")
    )
    return ranked.unionByName(rows.filter("reason IS NOT NULL").select(*keep, "reason"), allowMissingColumns=True)


def best_per_match(df: DataFrame, by: list[str], match: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(the first row of each match in ``order``, the others with reason CORRELATION_REDUCTION)."""
    w = Window.partitionBy(*by, match).orderBy(*order)
    ranked = df.withColumn("_nth", F.row_number().over(w))
    rest = ranked.filter("_nth > 1").drop("_nth").withColumn("reason", F.lit("CORRELATION_REDUCTION"))
    return ranked.filter("_nth = 1").drop("_nth"), rest


def top_k(df: DataFrame, by: list[str], order: list[Column], most: int, least: int = 0) -> DataFrame:
    """At most ``most`` rows a group with their rank from 1; groups with fewer than ``least`` rows give none."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    if least:
        size = F.count("*").over(Window.partitionBy(*by))
        ranked = ranked.withColumn("_size", size).filter(F.col("_size") >= least).drop("_size")
    return ranked


def input_fingerprint(df: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """One order-free fingerprint a group: equal inputs give equal fingerprints, so a stored run can be returned."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in row]), 256)
    number = F.conv(F.substring(key, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("fingerprint"))
