"""Queries over readiness, coverage, splits and expanding reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import quality, readiness
from pitchlake.plans.registry import Registry

R = Registry()


@R.query("""
WITH p AS (SELECT l_orderkey % 90 AS lineup, CASE WHEN l_linenumber % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS side, CASE WHEN l_orderkey % 90 < 20 THEN l_partkey % 11 ELSE l_partkey % 400 END AS player,
  l_returnflag <> 'N' AS starter, l_orderkey % 90 % 4 <> 0 AS official FROM lineitem),
q AS (SELECT DISTINCT ON (lineup, side, player, starter) * FROM p WHERE lineup < 20 UNION ALL SELECT * FROM p WHERE lineup >= 20),
c AS (SELECT lineup, count(DISTINCT CASE WHEN side = 'HOME' AND starter THEN player END) AS home, count(DISTINCT CASE WHEN side = 'AWAY' AND starter THEN player END) AS away,
  count(CASE WHEN starter THEN player END) AS named, bool_and(official) AS official FROM q GROUP BY 1)
SELECT lineup, home, away, CASE WHEN official AND named = home + away AND home = 11 AND away = 11 THEN 'COMPLETE_OFFICIAL' WHEN home <= 11 AND away <= 11 THEN 'PARTIAL' ELSE 'INVALID' END AS state FROM c""")
def lineup_completeness(spark, sf_dir):
    k = F.col("l_orderkey") % 90
    rows = frame(spark, sf_dir, "lineitem").select(
        k.alias("lineup"),
        F.when(F.col("l_linenumber") % 2 == 0, "HOME").otherwise("AWAY").alias("side"),
        F.when(k < 20, F.col("l_partkey") % 11).otherwise(F.col("l_partkey") % 400).alias("player"),
        (F.col("l_returnflag") != "N").alias("starter"),
        (k % 4 != 0).alias("official"),
    )
    few = rows.filter("lineup < 20").dropDuplicates(["lineup", "side", "player", "starter"])
    return readiness.lineup_completeness(few.unionByName(rows.filter("lineup >= 20")), ["lineup"])


@R.query("""
WITH m AS (SELECT id, kick + interval '12' hour AS kick, id % 5 <> 0 AS known, id % 7 = 0 AS complete,
  kick + interval '12' hour + ((id % 200) - 150) * interval '1' minute AS now FROM matches)
SELECT id, CASE WHEN complete THEN 'READY' WHEN NOT known THEN 'KICKOFF_UNKNOWN' WHEN 150 - id % 200 > 75 THEN 'TOO_EARLY'
  WHEN 150 - id % 200 >= -5 THEN 'WAITING' ELSE 'MISSED' END AS state FROM m""")
def lineup_readiness(spark, sf_dir):
    m = frame(spark, sf_dir, "matches").withColumn("kick", F.expr("kick + interval '12' hour"))
    now = F.expr("kick + ((id % 200) - 150) * interval '1' minute")
    state = readiness.lineup_window(F.col("kick"), F.col("id") % 5 != 0, now, F.col("id") % 7 == 0)
    return m.select("id", state.alias("state"))


@R.query("""
SELECT id, CASE WHEN id % 4 = 0 THEN 'finished' WHEN id % 3 = 0 THEN 'scheduled' ELSE 'cancelled' END AS status FROM matches""")
def missing_from_refresh(spark, sf_dir):
    m = frame(spark, sf_dir, "matches")
    known = m.select("id", F.when(F.col("id") % 4 == 0, "finished").otherwise("scheduled").alias("status"))
    return readiness.deactivated(known, m.filter("id % 3 = 0"), 0)


@R.query("""
WITH d AS (SELECT DISTINCT CAST(kick AS DATE) AS day FROM matches), n AS (SELECT day, row_number() OVER (ORDER BY day) AS nth, count(*) OVER () AS n FROM d)
SELECT id, CASE WHEN nth <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM matches JOIN n ON CAST(kick AS DATE) = day WHERE n >= 20""")
def date_split(spark, sf_dir):
    return readiness.date_split(frame(spark, sf_dir, "matches").select("id", "kick"), "kick").select("id", "part")


@R.query("""
WITH o AS (SELECT match_id, leg, p, y, CAST(generated_at AS DATE) AS day, CAST(least(greatest(floor(floor(p * 100) / 5) * 5, 0), 95) AS BIGINT) AS bin FROM observations),
d AS (SELECT bin, day, count(*) AS n, sum(y) AS y FROM o GROUP BY 1, 2),
s AS (SELECT bin, day, coalesce(sum(n) OVER w, 0) AS seen, coalesce(sum(y) OVER w, 0) AS hits FROM d
      WINDOW w AS (PARTITION BY bin ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, leg, p, bin, round((hits + 20 * p) / (seen + 20), 12) AS reliability FROM o JOIN s USING (bin, day)""")
def expanding_reliability(spark, sf_dir):
    out = readiness.expanding_reliability(frame(spark, sf_dir, "observations"), "generated_at")
    return out.select("match_id", "leg", "p", "bin", F.round("reliability", 12).alias("reliability"))


@R.query("""
SELECT id, round((coalesce(CAST(hc AS DOUBLE), 6) - 5.5) / 2, 8) AS hc_z, CASE WHEN hc IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hc_missing,
  round((CAST(hg AS DOUBLE) - 2) / 1.5, 8) AS hg_z, 0.0::DOUBLE AS hg_missing FROM matches""")
def feature_vector(spark, sf_dir):
    out = readiness.transformed(frame(spark, sf_dir, "matches"), {"hc": (6.0, 5.5, 2.0), "hg": (2.0, 2.0, 1.5)})
    return out.select("id", F.round("hc_z", 8).alias("hc_z"), "hc_missing", F.round("hg_z", 8).alias("hg_z"), "hg_missing")


@R.query("""
WITH b AS (SELECT market, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(CAST(y AS DOUBLE))) AS gap FROM observations GROUP BY 1, 2), e AS (SELECT market, sum(gap * n) / sum(n) AS ece FROM b GROUP BY 1),
g AS (SELECT market, avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))) AS l, avg((p - y) * (p - y)) AS b,
  avg(-ln(greatest(CASE WHEN y = 1 THEN 0.3 ELSE 0.7 END, 1e-12))) AS bl, avg((0.3 - y) * (0.3 - y)) AS bb, abs(0.3 - avg(CAST(y AS DOUBLE))) AS be FROM observations GROUP BY 1)
SELECT market, CASE WHEN l - bl > 1e-4 AND bb <= b + 0.02 AND be <= ece + 0.02 THEN 'ACTIVE' ELSE 'REJECTED' END AS state FROM g JOIN e USING (market)""")
def family_gate(spark, sf_dir):
    """A constant forecast as the candidate against the given one as base, by log loss, Brier and ten-bin calibration error."""
    rows = frame(spark, sf_dir, "observations")
    p, y, c = F.col("p"), F.col("y"), F.lit(0.3)
    base = quality.calibration_error(rows, ["market"], F.least(F.floor(p * 10), F.lit(9))).select("market", F.col("ece").alias("base_ece"))
    metrics = rows.groupBy("market").agg(
        F.avg(E.log_loss(p, y)).alias("base_log_loss"), F.avg(E.brier(p, y)).alias("base_brier"), F.avg(E.log_loss(c, y)).alias("log_loss"), F.avg(E.brier(c, y)).alias("brier"),
        F.abs(0.3 - F.avg(y.cast("double"))).alias("ece"),
    )
    return readiness.family_gate(metrics.join(base, "market")).select("market", "state")
