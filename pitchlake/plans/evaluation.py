"""Queries over evaluations: star join, summaries, settled groups, revisions and paired contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.operators import evaluation
from pitchlake.plans.registry import Registry

R = Registry()
LOSS = "-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))"

EVALUATED = f"""b AS (SELECT context, competition, category, match_id, 'BINARY' AS kind, market, p, y = 1 AS actual, (p - y) * (p - y) AS brier, {LOSS} AS log_loss, odd
  FROM evaluated WHERE market <> 'MATCH_RESULT'),
s AS (SELECT context, competition, category, match_id, selection, p, y, odd FROM evaluated WHERE market = 'MATCH_RESULT'
  QUALIFY row_number() OVER (PARTITION BY context, competition, category, match_id, selection ORDER BY p DESC, y DESC, odd DESC NULLS LAST) = 1),
t AS (SELECT context, competition, category, match_id, count(*) AS n, sum(y) AS true_n, sum((p - y) * (p - y)) AS brier, max(CASE WHEN y = 1 THEN p END) AS hit,
  arg_max({{'p': p, 'y': y, 'odd': odd}}, {{'p': p, 's': selection}}) AS pick FROM s GROUP BY 1, 2, 3, 4),
e AS (SELECT * FROM b UNION ALL SELECT context, competition, category, match_id, 'MULTICLASS', 'MATCH_RESULT', pick.p, pick.y = 1, brier, -ln(greatest(hit, 1e-12)), pick.odd
  FROM t WHERE n = 3 AND true_n = 1)"""


def _evaluated(spark, sf_dir):
    return evaluation.evaluations(frame(spark, sf_dir, "evaluated"), ["context", "competition", "category"])


@R.query(f"WITH {EVALUATED} SELECT context, competition, kind, market, count(*) AS n, count(odd) AS priced, round(sum(brier), 6) AS brier, round(sum(log_loss), 6) AS log_loss FROM e GROUP BY 1, 2, 3, 4")
def selection_evaluations(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).groupBy("context", "competition", "kind", "market")
    return rows.agg(F.count("*").alias("n"), F.count("odd").alias("priced"), F.round(F.sum("brier"), 6).alias("brier"), F.round(F.sum("log_loss"), 6).alias("log_loss"))


@R.query(f"""
WITH {EVALUATED}, g AS (SELECT context, market, kind, CAST(least(greatest(floor(floor(p * 100) / 5) * 5, 0), 95) AS BIGINT) AS bin, count(*) AS n, sum(p) AS p,
  sum(CAST(actual AS DOUBLE)) AS y, sum(brier) AS brier, sum(log_loss) AS log_loss FROM e GROUP BY 1, 2, 3, 4)
SELECT context, market, kind, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS status, round(sum(p) / sum(n), 12) AS mean_p,
  CASE WHEN kind = 'BINARY' THEN round(sum(y) / sum(n), 12) END AS hit_rate, CASE WHEN kind <> 'BINARY' THEN round(sum(y) / sum(n), 12) END AS accuracy, round(sum(brier) / sum(n), 12) AS brier,
  round(sum(log_loss) / sum(n), 12) AS log_loss, CASE WHEN sum(n) >= 20 THEN round(sum(abs(p - y)) / sum(n), 12) END AS ece, round(sum(y) / sum(n) - sum(p) / sum(n), 12) AS gap FROM g GROUP BY 1, 2, 3""")
def performance_summary(spark, sf_dir):
    return evaluation.summaries(_evaluated(spark, sf_dir), ["context", "market"])


def _metrics(name: str, p: str) -> str:
    return f"""(SELECT competition, market, line, selection, sum(n) AS n, sum(p) / sum(n) AS p, sum(y) / sum(n) AS y, sum(b) / sum(n) AS b, sum(l) / sum(n) AS l, sum(abs(p - y)) / sum(n) AS e
  FROM (SELECT competition, market, line, selection, CAST(least(greatest(floor(floor({p} * 100) / 5) * 5, 0), 95) AS BIGINT) AS bin, count(*) AS n, sum({p}) AS p, sum(w) AS y,
    sum(({p} - w) * ({p} - w)) AS b, sum(-ln(greatest(CASE WHEN w = 1 THEN {p} ELSE 1 - {p} END, 1e-12))) AS l
    FROM (SELECT *, CASE WHEN settlement = 'WON' THEN 1 ELSE 0 END AS w FROM evaluated WHERE market <> 'MATCH_RESULT' AND settlement IN ('WON', 'LOST')) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) {name}"""


@R.query(f"""
WITH c AS (SELECT competition, market, line, selection, count(*) FILTER (settlement = 'WON') AS won, count(*) FILTER (settlement = 'LOST') AS lost, count(*) FILTER (settlement = 'VOID') AS void,
  count(*) FILTER (settlement = 'UNSETTLED') AS unsettled FROM evaluated WHERE market <> 'MATCH_RESULT' GROUP BY 1, 2, 3, 4)
SELECT c.*, won + lost AS n, round(r.p, 12) AS raw_p, round(r.b, 12) AS raw_brier, round(r.l, 12) AS raw_log_loss, round(r.e, 12) AS raw_ece, round(u.p, 12) AS public_p, round(u.y, 12) AS public_y,
  round(u.b, 12) AS public_brier, round(u.l, 12) AS public_log_loss, round(u.e, 12) AS public_ece, round(round(u.y, 12) - round(u.p, 12), 12) AS gap,
  CASE WHEN won + lost >= 20 THEN 'USABLE' ELSE 'INSUFFICIENT_SAMPLE' END AS quality
FROM c LEFT JOIN {_metrics('r', 'p')} ON c.competition = r.competition AND c.market = r.market AND c.line IS NOT DISTINCT FROM r.line AND c.selection = r.selection
LEFT JOIN {_metrics('u', 'public')} ON c.competition = u.competition AND c.market = u.market AND c.line IS NOT DISTINCT FROM u.line AND c.selection = u.selection""")
def model_performance_groups(spark, sf_dir):
    """Settled forecasts by competition, market, line and selection: raw and public metrics side by side."""
    rows = frame(spark, sf_dir, "evaluated").filter("market <> 'MATCH_RESULT'")
    return evaluation.settled_groups(rows, ["competition", "market", "line", "selection"])


@R.query("""
SELECT c.n_name AS name, m.id % 4 AS season, count(*) AS n, count(m.hc) AS with_corners, round(avg(e.p), 8) AS mean_p FROM evaluated e JOIN matches m ON m.id = e.match_id
JOIN nation c ON c.n_nationkey = m.competition GROUP BY 1, 2""")
def performance_star(spark, sf_dir):
    """Observations with match, competition and statistics, counted by competition and season."""
    m = frame(spark, sf_dir, "matches")
    matches = m.select(F.col("id").alias("match_id"), F.col("competition").cast("int").alias("competition"), (F.col("id") % 4).alias("season"))
    statistics = m.filter("hc IS NOT NULL").select(F.col("id").alias("match_id"), "hc", "ac")
    names = frame(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("competition"), F.col("n_name").alias("name"))
    rows = evaluation.star(frame(spark, sf_dir, "evaluated").drop("competition"), matches, names, statistics)
    return rows.groupBy("name", "season").agg(F.count("*").alias("n"), F.count("hc").alias("with_corners"), F.round(F.avg("p"), 8).alias("mean_p"))


REVISIONS = """v AS (SELECT event_id AS id, user_id % 500 + 1 AS match_id, ts AS generated_at, CASE WHEN event_type = 'error' THEN 'OTHER' ELSE 'LINEUP_AWARE_PREMATCH' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'REVISION_AVAILABLE' END AS status, event_id % 7 <> 0 AS has FROM events),
l AS (SELECT * FROM v WHERE kind = 'LINEUP_AWARE_PREMATCH' AND status = 'REVISION_AVAILABLE' AND has AND generated_at <= TIMESTAMP '2024-01-20 00:00:00' + (match_id % 10) * interval '1' day
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY generated_at DESC, id DESC) = 1)"""


def _revisions(spark, sf_dir):
    e = frame(spark, sf_dir, "events")
    p = (F.col("event_id") % 100).cast("double") / 100.0
    row = lambda market, selection, line, value: F.struct(F.lit(market).alias("market"), F.lit(selection).alias("selection"), F.lit(line).cast("double").alias("line"), value.alias("p"))
    payload = F.to_json(F.array(row("TOTAL_GOALS", "OVER", 2.5, p), row("BTTS", "YES", None, 1 - p), row("ODD_EVEN", "ODD", None, p)))
    revisions = e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 500 + 1).alias("match_id"),
        F.col("ts").alias("generated_at"),
        F.when(F.col("event_type") == "error", "OTHER").otherwise("LINEUP_AWARE_PREMATCH").alias("kind"),
        F.when(F.col("event_id") % 5 == 0, "FAILED").otherwise("REVISION_AVAILABLE").alias("status"),
        F.when(F.col("event_id") % 7 != 0, payload).alias("payload"),
    )
    kickoff = F.expr("timestamp_ntz '2024-01-20 00:00:00' + (match_id % 10) * interval '1' day")
    return evaluation.latest_revision(revisions, revisions.select("match_id").distinct().withColumn("kickoff", kickoff))


@R.query(f"WITH {REVISIONS} SELECT match_id, id, generated_at FROM l")
def latest_revisions(spark, sf_dir):
    return _revisions(spark, sf_dir).select("match_id", "id", "generated_at")


BASE = """m(market, selection, line) AS (VALUES ('TOTAL_GOALS', 'OVER', 2.5), ('BTTS', 'YES', NULL), ('MATCH_RESULT', 'HOME', NULL)),
x AS (SELECT DISTINCT user_id % 500 + 1 AS match_id FROM events), o AS (SELECT match_id, market, selection, CAST(line AS DOUBLE) AS line, CAST(match_id % 10 AS DOUBLE) / 10 AS p,
  CAST(match_id % 3 = 0 AS INTEGER) AS y FROM x, m)"""
PAIRED = f"""{REVISIONS}, {BASE}, q AS (SELECT o.*, CASE market WHEN 'BTTS' THEN 1 - CAST(l.id % 100 AS DOUBLE) / 100 ELSE CAST(l.id % 100 AS DOUBLE) / 100 END AS revised
  FROM o JOIN l USING (match_id) WHERE market <> 'MATCH_RESULT')"""


def _pairs(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.lit(n).cast("double").alias("line")) for m, s, n in (("TOTAL_GOALS", "OVER", 2.5), ("BTTS", "YES", None), ("MATCH_RESULT", "HOME", None))])
    ids = frame(spark, sf_dir, "events").select((F.col("user_id") % 500 + 1).alias("match_id")).distinct()
    base = ids.select("match_id", F.explode(kinds).alias("k"), ((F.col("match_id") % 10).cast("double") / 10).alias("p"), (F.col("match_id") % 3 == 0).cast("int").alias("y"))
    return evaluation.paired_contexts(_revisions(spark, sf_dir), base.select("match_id", "k.*", "p", "y"))


@R.query(f"WITH {PAIRED} SELECT match_id, market, selection, line, p, y, round(revised, 8) AS revised FROM q")
def paired_contexts(spark, sf_dir):
    return _pairs(spark, sf_dir).select("match_id", "market", "selection", "line", "p", "y", F.round("revised", 8).alias("revised"))


def _ten(p: str) -> str:
    return f"""(SELECT market, sum(n) AS n, round(sum(l) / sum(n), 8) AS l, round(sum(b) / sum(n), 8) AS b, round(sum(abs(sp - sy)) / sum(n), 8) AS e FROM (SELECT market, least(floor({p} * 10), 9) AS bin,
  count(*) AS n, sum({p}) AS sp, sum(y) AS sy, sum(({p} - y) * ({p} - y)) AS b, sum(-ln(greatest(CASE WHEN y = 1 THEN {p} ELSE 1 - {p} END, 1e-12))) AS l FROM q GROUP BY 1, 2) GROUP BY 1)"""


@R.query(f"""
WITH {PAIRED} SELECT market, CAST(a.n AS BIGINT) AS n, a.l AS base_log_loss, a.b AS base_brier, a.e AS base_ece, z.l AS revised_log_loss, z.b AS revised_brier, z.e AS revised_ece
FROM {_ten('p')} a JOIN {_ten('revised')} z USING (market)""")
def paired_metrics(spark, sf_dir):
    return evaluation.paired_metrics(_pairs(spark, sf_dir), ["market"])


@R.query("""
WITH x AS (SELECT competition, hg AS actual, 1.4 + (id % 5) / 10.0 AS base, 1.2 + (id % 7) / 10.0 AS revised FROM matches WHERE finished)
SELECT competition, count(*) AS n, round(avg(abs(CAST(base AS DOUBLE) - actual)), 8) AS base_mae, round(sqrt(avg((CAST(base AS DOUBLE) - actual) * (CAST(base AS DOUBLE) - actual))), 8) AS base_rmse,
  round(avg(abs(CAST(revised AS DOUBLE) - actual)), 8) AS revised_mae, round(sqrt(avg((CAST(revised AS DOUBLE) - actual) * (CAST(revised AS DOUBLE) - actual))), 8) AS revised_rmse FROM x GROUP BY 1""")
def goal_count_errors(spark, sf_dir):
    m = frame(spark, sf_dir, "matches").filter("finished")
    rows = m.select("competition", F.col("hg").alias("actual"), (1.4 + (F.col("id") % 5) / 10.0).alias("base"), (1.2 + (F.col("id") % 7) / 10.0).alias("revised"))
    return evaluation.count_errors(rows, ["competition"])
