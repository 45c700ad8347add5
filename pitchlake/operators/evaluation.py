"""Evaluations behind the performance reports: star join, one row an evaluated forecast, summaries, settled-only groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E

RESULT = "MATCH_RESULT"
ENOUGH = 20


def star(observations: DataFrame, matches: DataFrame, competitions: DataFrame, statistics: DataFrame) -> DataFrame:
    """Observations with their match, its competition and, where there are any, its statistics.

    Matches and statistics meet observations by match, in one shuffle of each; competitions are few and Spark broadcasts them
    by their size.
    """
    known = matches.join(statistics, "match_id", "left").join(competitions, "competition")
    return observations.join(known, "match_id")


def evaluations(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., match_id, kind, market, p, actual, brier, log_loss, odd): a row for every binary forecast, and one for the three
    match-result forecasts of a match.

    A match counts if it has all three selections and exactly one is true; of repeated selections the likeliest counts. The
    forecast is the likeliest selection; of equal ones the last in the alphabet wins. Its Brier score is summed over three.
    """
    y = F.col("y").cast("double")
    binary = rows.filter(F.col("market") != RESULT).select(
        *by, "match_id", F.lit("BINARY").alias("kind"), "market", "p", (F.col("y") == 1).alias("actual"),
        E.brier(F.col("p"), y).alias("brier"), E.log_loss(F.col("p"), F.col("y")).alias("log_loss"), "odd",
    )
    triples = rows.filter((F.col("market") == RESULT) & F.col("selection").isin("HOME", "DRAW", "AWAY"))
    one = triples.groupBy(*by, "match_id", "selection").agg(F.max(F.struct("p", "y", "odd")).alias("s"))
    three = one.groupBy(*by, "match_id").agg(
        F.count("*").alias("n"),
        F.sum("s.y").alias("true_n"),
        F.max(F.struct(F.col("s.p").alias("p"), "selection", F.col("s.y").alias("y"), F.col("s.odd").alias("odd"))).alias("pick"),
        F.sum(E.brier(F.col("s.p"), F.col("s.y"))).alias("brier"),
        F.max(F.when(F.col("s.y") == 1, F.col("s.p"))).alias("hit"),
    )
    multi = three.filter("n = 3 AND true_n = 1").select(
        *by, "match_id", F.lit("MULTICLASS").alias("kind"), F.lit(RESULT).alias("market"), F.col("pick.p").alias("p"), (F.col("pick.y") == 1).alias("actual"),
        "brier", (-F.log(F.greatest(F.col("hit"), F.lit(E.LOG_FLOOR)))).alias("log_loss"), F.col("pick.odd").alias("odd"),
    )
    return binary.unionByName(multi)


def _binned(rows: DataFrame, by: list[str], p: str, prefix: str, more: dict[str, Column]) -> DataFrame:
    """Sums by five-point bin of ``p``, then means and the calibration error by group."""
    y = F.col("actual").cast("double")
    sums = {"p": F.col(p), "y": y, **more}
    bins = rows.groupBy(*by, E.bucket(F.col(p)).alias("_bin")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    n = F.sum("_n")
    return bins.groupBy(*by).agg(
        n.alias("n"), *[(F.sum(f"_{k}") / n).alias(f"{prefix}{k}") for k in sums], (F.sum(F.abs(F.col("_p") - F.col("_y"))) / n).alias(f"{prefix}ece")
    )


def summaries(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Group metrics with their status; a calibration error from ``ENOUGH`` forecasts on; accuracy where the forecast is one
    of three, else a hit rate; the gap is the hit rate less the mean probability."""
    keys = [*by, "kind"]
    out = _binned(evaluated, keys, "p", "", {"brier": F.col("brier"), "log_loss": F.col("log_loss")})
    multi = F.col("kind") == "MULTICLASS"
    r = lambda c: F.round(c, 12)
    return out.select(
        *keys,
        "n",
        E.sample_status(F.col("n")).alias("status"),
        r(F.col("p")).alias("mean_p"),
        F.when(~multi, r(F.col("y"))).alias("hit_rate"),
        F.when(multi, r(F.col("y"))).alias("accuracy"),
        r(F.col("brier")).alias("brier"),
        r(F.col("log_loss")).alias("log_loss"),
        F.when(F.col("n") >= ENOUGH, r(F.col("ece"))).alias("ece"),
        r(F.col("y") - F.col("p")).alias("gap"),
    )


def settled_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Raw and public forecasts side by side over the settled rows of each group, with counts of every settlement.

    ``rows`` have p (raw), public and settlement; groups compare null-safely; a group without settled rows has no metrics.
    """
    settlement = F.col("settlement")
    count = lambda s: F.count(F.when(settlement == s, 1)).alias(s.lower())
    counts = rows.groupBy(*by).agg(*[count(s) for s in ("WON", "LOST", "VOID", "UNSETTLED")])
    settled = rows.filter(settlement.isin("WON", "LOST")).withColumn("actual", settlement == "WON")
    hit = F.col("actual").cast("int")
    out = counts
    for name, p in (("raw", "p"), ("public", "public")):
        more = {"brier": E.brier(F.col(p), hit), "log_loss": E.log_loss(F.col(p), hit)}
        part = _binned(settled, by, p, f"{name}_", more).drop("n")
        part = part.select(*[F.col(c).alias(f"_{c}") if c in by else F.round(c, 12).alias(c) for c in part.columns])
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(part, on, "left").drop(*[f"_{c}" for c in by])
    n = F.col("won") + F.col("lost")
    return out.withColumns(
        {"n": n, "gap": F.round(F.col("public_y") - F.col("public_p"), 12), "quality": F.when(n >= ENOUGH, "USABLE").otherwise("INSUFFICIENT_SAMPLE")}
    ).drop("raw_y")


def latest_revision(revisions: DataFrame, matches: DataFrame) -> DataFrame:
    """The last usable revision of each match that was made no later than its kickoff (columns match_id, id, generated_at,
    kind, status, payload)."""
    usable = revisions.filter("kind = 'LINEUP_AWARE_PREMATCH' AND status = 'REVISION_AVAILABLE' AND payload IS NOT NULL")
    timely = usable.join(matches.select("match_id", "kickoff"), "match_id").filter("generated_at <= kickoff")
    w = Window.partitionBy("match_id").orderBy(F.desc("generated_at"), F.desc("id"))
    return timely.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "kickoff")


def paired_contexts(revisions: DataFrame, base: DataFrame) -> DataFrame:
    """Base and lineup probabilities of the same match, market, selection and line: the payload of a revision, one row a
    market, beside the base forecast it revises; base forecasts that it does not mention pair with nothing."""
    payload = F.from_json("payload", "array<struct<market:string,selection:string,line:double,p:double>>")
    rows = revisions.select("match_id", "generated_at", F.explode(payload).alias("m")).select("match_id", "generated_at", "m.*")
    on = F.col("b.line").eqNullSafe(F.col("r.line"))
    for c in ("match_id", "market", "selection"):
        on = on & (F.col(f"b.{c}") == F.col(f"r.{c}"))
    return base.alias("b").join(rows.alias("r"), on).select("b.*", "r.generated_at", F.col("r.p").alias("revised"))


def paired_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Base against revised forecasts of the same rows (p, revised, y): log loss, Brier and ten-bin calibration error of both."""
    y = F.col("y")
    out = None
    for name, p in (("base", "p"), ("revised", "revised")):
        part = pairs.groupBy(*by, F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("_bin")).agg(
            F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y.cast("double")).alias("_y"),
            F.sum(E.brier(F.col(p), y)).alias("_b"), F.sum(E.log_loss(F.col(p), y)).alias("_l"),
        )
        n = F.sum("_n")
        part = part.groupBy(*by).agg(
            n.alias("n"),
            F.round(F.sum("_l") / n, 8).alias(f"{name}_log_loss"),
            F.round(F.sum("_b") / n, 8).alias(f"{name}_brier"),
            F.round(F.sum(F.abs(F.col("_p") - F.col("_y"))) / n, 8).alias(f"{name}_ece"),
        )
        out = part if out is None else out.join(part.drop("n"), by)
    return out


def count_errors(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute and root mean square error of two forecasts of a count (actual, base, revised)."""
    d = lambda c: F.col(c) - F.col("actual")
    pair = [(F.round(F.avg(F.abs(d(c))), 8).alias(f"{c}_mae"), F.round(F.sqrt(F.avg(d(c) * d(c))), 8).alias(f"{c}_rmse")) for c in ("base", "revised")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[x for two in pair for x in two])
