"""Queries over forecasts, prices and team history."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import asof, features, fits, form, joint, lineups, quality, report, training
from pitchlake.plans.registry import Registry

R = Registry()
BUCKET = "CAST(least(greatest(floor(floor(p * 100) / 5) * 5, 0), 95) AS BIGINT)"
LOSS = "-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))"
VALID = "p BETWEEN 0 AND 1"


@R.query(f"""
SELECT grp, {BUCKET} AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(CAST(y AS DOUBLE)), 8) AS observed,
       round(avg(CAST(y AS DOUBLE)) - avg(p), 8) AS gap,
       round(sqrt(avg(CAST(y AS DOUBLE)) * (1 - avg(CAST(y AS DOUBLE))) / count(*)), 8) AS std_error,
       CASE WHEN count(*) >= 20 THEN 'USABLE' ELSE 'LOW_SAMPLE' END AS status
FROM observations WHERE {VALID} GROUP BY 1, 2""")
def reliability_table(spark, sf_dir):
    return quality.reliability_table(frame(spark, sf_dir, "observations"), ["grp"])


@R.query(f"""
WITH b AS (SELECT grp, {BUCKET} AS bin, count(*) AS n, sum(p) AS p, sum(y) AS y, sum((p - y) * (p - y)) AS b, sum({LOSS}) AS l
           FROM observations WHERE {VALID} GROUP BY 1, 2)
SELECT grp, CAST(sum(n) AS BIGINT) AS n, round(sum(p) / sum(n), 8) AS mean_p, round(sum(y) / sum(n), 8) AS hit_rate,
       round(sum(b) / sum(n), 8) AS brier, round(sum(l) / sum(n), 8) AS log_loss, round(sum(abs(p - y)) / sum(n), 8) AS ece
FROM b GROUP BY grp""")
def binary_quality_by_group(spark, sf_dir):
    return quality.binary_quality(frame(spark, sf_dir, "observations"), ["grp"])


@R.query(f"""
WITH b AS (SELECT market, competition, {BUCKET} AS bin, count(*) AS n, abs(avg(p) - avg(CAST(y AS DOUBLE))) AS gap
           FROM observations GROUP BY 1, 2, 3)
SELECT market, competition, round(coalesce(sum(CASE WHEN n >= 20 THEN gap * n END), 0) / sum(n), 8) AS ece,
       round(max(CASE WHEN n >= 20 THEN gap END), 8) AS mce FROM b GROUP BY 1, 2""")
def backtest_calibration_error(spark, sf_dir):
    out = quality.calibration_error(frame(spark, sf_dir, "observations"), ["market", "competition"], E.bucket(F.col("p")), 20)
    return out.withColumns({c: F.round(c, 8) for c in ("ece", "mce")})


@R.query("""
WITH b AS (SELECT market, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(CAST(y AS DOUBLE))) AS gap
           FROM observations GROUP BY 1, 2)
SELECT market, round(sum(gap * n) / sum(n), 8) AS ece, round(max(gap), 8) AS mce FROM b GROUP BY 1""")
def offline_calibration_error(spark, sf_dir):
    bins = F.least(F.floor(F.col("p") * 10), F.lit(9))
    out = quality.calibration_error(frame(spark, sf_dir, "observations"), ["market"], bins)
    return out.withColumns({c: F.round(c, 8) for c in ("ece", "mce")})


def _triples(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations").filter("leg <= 3")
    names = F.element_at(F.array(F.lit("AWAY"), F.lit("DRAW"), F.lit("HOME")), F.col("leg"))
    return rows.select("match_id", names.alias("selection"), F.col("p"), F.col("y"), (F.col("match_id") % 5).alias("grp"))


@R.query("""
WITH t AS (SELECT match_id, CASE leg WHEN 1 THEN 'AWAY' WHEN 2 THEN 'DRAW' ELSE 'HOME' END AS selection, p, y,
                  match_id % 5 AS grp FROM observations WHERE leg <= 3),
e AS (SELECT grp, match_id, max(CASE WHEN y = 1 THEN p END) AS hit, sum((p - y) * (p - y)) AS b,
             first(y ORDER BY p DESC, selection DESC) AS top
      FROM t GROUP BY 1, 2 HAVING count(*) = 3 AND count(DISTINCT selection) = 3 AND sum(y) = 1)
SELECT grp, count(*) AS events, round(avg(-ln(greatest(hit, 1e-12))), 8) AS log_loss, round(avg(b), 8) AS brier,
       round(avg(CAST(top AS DOUBLE)), 8) AS accuracy FROM e GROUP BY grp""")
def multiclass_quality(spark, sf_dir):
    return quality.multiclass_quality(_triples(spark, sf_dir), ["match_id"], ["grp"])


@R.query("""
SELECT key, selection, id, captured, odd FROM quotes
QUALIFY row_number() OVER (PARTITION BY key, selection ORDER BY captured DESC, id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    return asof.latest_per_key(frame(spark, sf_dir, "quotes"), ["key", "selection"], [F.desc("captured"), F.desc("id")])


@R.query("""
SELECT f.*, q.captured, q.id, q.odd FROM forecasts f LEFT JOIN LATERAL (
  SELECT captured, id, odd FROM quotes q WHERE q.key = f.key AND q.selection = f.selection AND q.captured <= f.cutoff
  ORDER BY captured DESC, id DESC LIMIT 1) q ON true""")
def asof_latest_price(spark, sf_dir):
    return asof.asof_latest(
        frame(spark, sf_dir, "forecasts"), frame(spark, sf_dir, "quotes"), ["key", "selection"], "cutoff", "captured", "id", ["odd"]
    )


@R.query("""
WITH a AS (SELECT f.forecast_id, f.cutoff,
  (SELECT {'t': captured, 'o': odd, 'p': provider} FROM two_sided q WHERE q.side = 'yes' AND q.key = f.key AND q.captured <= f.cutoff ORDER BY captured DESC, id DESC LIMIT 1) AS yes,
  (SELECT {'t': captured, 'o': odd, 'p': provider} FROM two_sided q WHERE q.side = 'no' AND q.key = f.key AND q.captured <= f.cutoff ORDER BY captured DESC, id DESC LIMIT 1) AS no
  FROM forecasts f)
SELECT forecast_id, round(CASE WHEN yes.o > 1 AND no.o > 1 AND yes.t >= cutoff - interval '24' hour AND no.t >= cutoff - interval '24' hour
  AND yes.p = no.p AND yes.t = no.t THEN (1 / yes.o) / (1 / yes.o + 1 / no.o) END, 8) AS prior FROM a""")
def asof_two_sided_prior(spark, sf_dir):
    """Fair prior from the latest price of either side: one provider, one time of capture, at most 24 hours old."""
    asks = frame(spark, sf_dir, "forecasts").select("forecast_id", "key", "cutoff")
    out = asof.asof_two_sided(asks, frame(spark, sf_dir, "two_sided"), ["key"], "cutoff")
    return out.select("forecast_id", F.round("prior", 8).alias("prior"))


@R.query("""
SELECT q.* FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM quotes n WHERE n.key = q.key AND n.selection = q.selection
  AND (n.captured > q.captured OR (n.captured = q.captured AND n.id > q.id)))""")
def latest_not_superseded(spark, sf_dir):
    return asof.latest_per_key(frame(spark, sf_dir, "quotes"), ["key", "selection"], [F.desc("captured"), F.desc("id")])


@R.query("""
WITH l AS (SELECT * FROM popularity QUALIFY row_number() OVER (PARTITION BY key, selection, metric ORDER BY captured DESC, id DESC) = 1)
SELECT c.key, c.selection, c.value AS total, r.value AS rank FROM l c JOIN l r ON c.metric = 'COUNT' AND r.metric = 'RANK' AND c.key = r.key
  AND c.selection IS NOT DISTINCT FROM r.selection""")
def latest_metric_pair(spark, sf_dir):
    """Popularity: the latest COUNT rows paired with the latest RANK rows, null-safe on the selection."""
    return asof.metric_pairs(frame(spark, sf_dir, "popularity"), ["key"])


@R.query("""
WITH q AS (SELECT id, key, captured, CAST(floor(odd) AS BIGINT) AS price FROM quotes)
SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY captured, id) = 1
  OR lag(price) OVER (PARTITION BY key ORDER BY captured, id) IS DISTINCT FROM price""")
def dedupe_change(spark, sf_dir):
    rows = frame(spark, sf_dir, "quotes").select("id", "key", "captured", F.floor("odd").alias("price"))
    return asof.dedupe_changes(rows, ["key"], ["captured", "id"], ["price"])


@R.query("""
WITH RECURSIVE q AS (SELECT id, key, captured, CAST(floor(odd) AS BIGINT) AS price,
             row_number() OVER (PARTITION BY key ORDER BY captured, id) AS nth FROM quotes),
f AS (SELECT key, nth, id, captured, price, captured AS kept_at, price AS kept_price, true AS kept FROM q WHERE nth = 1
      UNION ALL
      SELECT q.key, q.nth, q.id, q.captured, q.price,
             CASE WHEN q.price <> f.kept_price OR q.captured - f.kept_at >= interval '3600' second THEN q.captured ELSE f.kept_at END,
             CASE WHEN q.price <> f.kept_price OR q.captured - f.kept_at >= interval '3600' second THEN q.price ELSE f.kept_price END,
             q.price <> f.kept_price OR q.captured - f.kept_at >= interval '3600' second
      FROM f JOIN q ON q.key = f.key AND q.nth = f.nth + 1)
SELECT id, key, captured, price FROM f WHERE kept""")
def dedupe_change_heartbeat(spark, sf_dir):
    rows = frame(spark, sf_dir, "quotes").select("id", "key", "captured", F.floor("odd").alias("price"))
    return asof.dedupe_with_heartbeat(rows, ["key"], "captured", "id", "price", 3600)


@R.query("""
WITH u AS (SELECT id, key, captured, odd, 0 AS revision FROM quotes WHERE id % 2 = 0
           UNION ALL SELECT id, key, captured, odd + 1, 1 FROM quotes WHERE id % 3 = 0)
SELECT id, key, captured, odd, revision FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY captured DESC, revision DESC, id DESC) = 1""")
def union_latest(spark, sf_dir):
    q = frame(spark, sf_dir, "quotes").drop("selection")
    both = q.filter("id % 2 = 0").withColumn("revision", F.lit(0)).union(
        q.filter("id % 3 = 0").withColumn("odd", F.col("odd") + 1).withColumn("revision", F.lit(1))
    )
    return asof.latest_per_key(both, ["key"], [F.desc("captured"), F.desc("revision"), F.desc("id")])


MEASURES = f"""count(*) AS n, CASE WHEN count(*) < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS status,
       round(avg(p), 8) AS mean_p, round(avg(CAST(y AS DOUBLE)), 8) AS hit_rate, round(avg(CAST(y AS DOUBLE)) - avg(p), 8) AS gap,
       round(avg((p - y) * (p - y)), 8) AS brier, round(avg({LOSS}), 8) AS log_loss"""


@R.query(f"""
WITH f AS (SELECT f.*, q.odd FROM forecasts f LEFT JOIN LATERAL (SELECT odd FROM quotes q WHERE q.key = f.key AND q.selection = f.selection
  AND q.captured <= f.cutoff ORDER BY captured DESC, id DESC LIMIT 1) q ON true)
SELECT CASE WHEN odd IS NULL OR odd < 1.01 THEN NULL WHEN odd < 1.30 THEN '1.01-1.29' WHEN odd < 1.50 THEN '1.30-1.49' WHEN odd < 1.80 THEN '1.50-1.79'
  WHEN odd < 2.00 THEN '1.80-1.99' WHEN odd < 2.50 THEN '2.00-2.49' ELSE '2.50+' END AS band, {MEASURES} FROM f GROUP BY 1""")
def odds_band_report(spark, sf_dir):
    """Forecasts by the band of their as-of price; those without one are a band of their own (null): counted, not dropped."""
    rows = asof.asof_latest(
        frame(spark, sf_dir, "forecasts"), frame(spark, sf_dir, "quotes"), ["key", "selection"], "cutoff", "captured", "id", ["odd"]
    )
    return report.summary(rows, [E.ladder(F.col("odd"), E.PREDICTION_BANDS).alias("band")])


@R.query(f"""
SELECT CASE WHEN odd < 1.01 THEN NULL WHEN odd < 1.30 THEN '1.01_1.29' WHEN odd < 1.50 THEN '1.30_1.49' WHEN odd < 1.80 THEN '1.50_1.79'
  WHEN odd < 2.00 THEN '1.80_1.99' WHEN odd < 2.50 THEN '2.00_2.49' WHEN odd < 3.00 THEN '2.50_2.99' ELSE '3.00_PLUS' END AS odds_range, {MEASURES}
FROM observations WHERE odd IS NOT NULL GROUP BY 1""")
def odds_range_report(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations").filter("odd IS NOT NULL")
    return report.summary(rows, [E.ladder(F.col("odd"), E.REPORT_RANGES).alias("odds_range")])


@R.query(f"""
SELECT market, CASE WHEN p < 0.5 THEN 'BELOW_50' WHEN p < 0.6 THEN '50_59' WHEN p < 0.7 THEN '60_69' WHEN p < 0.8 THEN '70_79'
       WHEN p < 0.9 THEN '80_89' ELSE '90_100' END AS bucket, count(*) AS n,
       CASE WHEN count(*) < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS status,
       round(avg(p), 8) AS mean_p, round(avg(CAST(y AS DOUBLE)), 8) AS hit_rate, round(avg(CAST(y AS DOUBLE)) - avg(p), 8) AS gap,
       round(avg((p - y) * (p - y)), 8) AS brier, round(avg({LOSS}), 8) AS log_loss FROM observations GROUP BY 1, 2""")
def confidence_bucket_report(spark, sf_dir):
    return report.summary(frame(spark, sf_dir, "observations"), ["market", E.confidence_bucket(F.col("p")).alias("bucket")])


@R.query(f"""
WITH o AS (SELECT context, market, competition, coalesce(category, -1) AS category, p, y FROM observations),
g AS (SELECT context, market, competition, category, CAST(grouping(context, market, competition, category) AS BIGINT) AS level,
       count(*) AS n, CASE WHEN count(*) < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS status,
       round(avg(p), 8) AS mean_p, round(avg(CAST(y AS DOUBLE)), 8) AS hit_rate, round(avg(CAST(y AS DOUBLE)) - avg(p), 8) AS gap,
       round(avg((p - y) * (p - y)), 8) AS brier, round(avg({LOSS}), 8) AS log_loss
      FROM o GROUP BY GROUPING SETS ((context), (context, market), (context, market, competition), (context, market, category)))
SELECT * FROM g WHERE category IS DISTINCT FROM -1""")
def market_report_grouping_sets(spark, sf_dir):
    return report.market_report(frame(spark, sf_dir, "observations"))


@R.query(f"""
WITH c AS (SELECT market, count(*) FILTER (context = 'BASE') AS nb, count(*) FILTER (context = 'LINEUP') AS nl,
  avg((p - y) * (p - y)) FILTER (context = 'LINEUP') - avg((p - y) * (p - y)) FILTER (context = 'BASE') AS b,
  avg({LOSS}) FILTER (context = 'LINEUP') - avg({LOSS}) FILTER (context = 'BASE') AS l,
  avg(CAST(y AS DOUBLE)) FILTER (context = 'LINEUP') - avg(CAST(y AS DOUBLE)) FILTER (context = 'BASE') AS h
  FROM observations GROUP BY market)
SELECT market, least(nb, nl) AS paired_n,
  CASE WHEN least(nb, nl) = 0 THEN 'INSUFFICIENT_DATA' WHEN least(nb, nl) < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS status,
  round(b, 8) AS brier_delta, round(l, 8) AS log_loss_delta, round(h, 8) AS hit_rate_delta FROM c""")
def context_comparison(spark, sf_dir):
    return report.context_comparison(frame(spark, sf_dir, "observations"), ["market"])


@R.query("SELECT competition, count(*) AS n FROM observations WHERE market = 3 AND context = 'BASE' GROUP BY 1")
def optional_filters(spark, sf_dir):
    rows = report.filtered(frame(spark, sf_dir, "observations"), market=3, category=None, context="BASE")
    return rows.groupBy("competition").agg(F.count("*").alias("n"))


@R.query("""
SELECT 'LAST_7' AS win, count(*) AS n FROM matches WHERE CAST(kick AS DATE) BETWEEN DATE '1996-03-04' AND DATE '1996-03-10'
UNION ALL SELECT 'LAST_30', count(*) FROM matches WHERE CAST(kick AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1996-03-10'
UNION ALL SELECT 'SEASON', count(*) FROM matches WHERE CAST(kick AS DATE) BETWEEN DATE '1995-07-01' AND DATE '1996-03-10'""")
def reporting_window(spark, sf_dir):
    rows = frame(spark, sf_dir, "matches")
    parts = [
        report.in_window(rows, "kick", w, "1996-03-10").agg(F.lit(w).alias("win"), F.count("*").alias("n"))
        for w in ("LAST_7", "LAST_30", "SEASON")
    ]
    return parts[0].union(parts[1]).union(parts[2])


TEAM = """t AS (SELECT id, kick, finished, competition, home AS team, true AS at_home, hg AS gf, ag AS ga, hc AS cf, ac AS ca, hs AS sf, as_ AS sa, hst AS tf, ast AS ta,
        hf AS ff, af AS fa, hy AS yf, ay AS ya, hr AS rf, ar AS ra FROM matches
      UNION ALL SELECT id, kick, finished, competition, away, false, ag, hg, ac, hc, as_, hs, ast, hst, af, hf, ay, hy, ar, hr FROM matches)"""


def _past(last: int, venue: bool, where: str = "true") -> str:
    same = "AND h.at_home = t.at_home" if venue else ""
    return f"""FROM t LEFT JOIN LATERAL (SELECT * FROM (SELECT * FROM t h WHERE h.team = t.team AND h.finished AND h.kick < t.kick {same}
  ORDER BY h.kick DESC, h.id DESC LIMIT {last}) h WHERE {where}) h ON true GROUP BY t.id, t.team, t.at_home"""


def _form(last: int, venue: bool) -> str:
    mean = lambda x: f"CASE WHEN count(h.id) >= 3 THEN round(avg(CAST({x} AS DOUBLE)), 8) END"
    return f"""
WITH {TEAM}
SELECT t.id, t.team, count(h.id) AS n, count(*) FILTER (h.gf > h.ga) AS wins, count(*) FILTER (h.gf = h.ga) AS draws, count(*) FILTER (h.gf < h.ga) AS losses,
  CASE WHEN count(h.id) >= 3 THEN round(CAST(sum(CASE WHEN h.gf > h.ga THEN 3 WHEN h.gf = h.ga THEN 1 ELSE 0 END) AS DOUBLE) / count(h.id), 8) END AS ppm,
  {mean('h.gf')} AS goals_for, {mean('h.ga')} AS goals_against, {mean('h.gf - h.ga')} AS goal_difference, {mean('h.ga = 0')} AS clean_sheets,
  {mean('h.gf = 0')} AS failed_to_score, {mean('h.gf + h.ga > 1')} AS over_15, {mean('h.gf + h.ga > 2')} AS over_25, {mean('h.gf + h.ga > 3')} AS over_35,
  {mean('h.gf > 0 AND h.ga > 0')} AS btts
{_past(last, venue)}"""


def _statistics(kind: str, last: int, venue: bool) -> str:
    mean = lambda name, x: f"CASE WHEN count(h.id) >= 3 THEN round(avg(CAST({x} AS DOUBLE)), 8) END AS {name}"
    share = lambda name, a, b: f"CASE WHEN count(h.id) >= 3 AND sum({b}) > 0 THEN round(CAST(sum({a}) AS DOUBLE) / sum({b}), 8) END AS {name}"
    there, columns = {
        "shooting": (
            "sf IS NOT NULL AND sa IS NOT NULL AND tf IS NOT NULL AND ta IS NOT NULL",
            [mean("shots_for", "h.sf"), mean("shots_against", "h.sa"), mean("on_target_for", "h.tf"), mean("on_target_against", "h.ta"),
             share("accuracy", "h.tf", "h.sf"), share("opponent_accuracy", "h.ta", "h.sa")],
        ),
        "corners": (
            "cf IS NOT NULL AND ca IS NOT NULL",
            [mean("corners_for", "h.cf"), mean("corners_against", "h.ca"), mean("total", "h.cf + h.ca"), *[mean(f"over_{x}5", f"h.cf + h.ca > {x}") for x in range(7, 12)]],
        ),
        "cards": (
            "yf IS NOT NULL AND ya IS NOT NULL AND rf IS NOT NULL AND ra IS NOT NULL",
            [mean("yellow_for", "h.yf"), mean("yellow_against", "h.ya"), mean("red_for", "h.rf"), mean("team_cards", "h.yf + h.rf"), mean("match_yellow", "h.yf + h.ya"),
             mean("match_red", "h.rf + h.ra"), *[mean(f"over_{x}5", f"h.yf + h.ya > {x}") for x in range(2, 7)]],
        ),
        "fouls": ("ff IS NOT NULL AND fa IS NOT NULL", [mean("fouls_for", "h.ff"), mean("fouls_against", "h.fa"), mean("total", "h.ff + h.fa")]),
    }[kind]
    return f"WITH {TEAM} SELECT t.id, t.team, count(h.id) AS matches, {', '.join(columns)} {_past(last, venue, there)}"


@R.query(_form(5, False))
def team_form_last5(spark, sf_dir):
    return form.trailing_form(frame(spark, sf_dir, "matches"), 5)


@R.query(_form(10, False))
def team_form_last10(spark, sf_dir):
    return form.trailing_form(frame(spark, sf_dir, "matches"), 10)


@R.query(_form(5, True))
def venue_form(spark, sf_dir):
    return form.trailing_form(frame(spark, sf_dir, "matches"), 5, venue=True)


@R.query(_statistics("shooting", 5, False))
def team_shooting(spark, sf_dir):
    return form.trailing_statistics(frame(spark, sf_dir, "matches"), "shooting", 5)


@R.query(_statistics("corners", 10, False))
def team_corners(spark, sf_dir):
    return form.trailing_statistics(frame(spark, sf_dir, "matches"), "corners", 10)


@R.query(_statistics("corners", 5, True))
def venue_corners(spark, sf_dir):
    return form.trailing_statistics(frame(spark, sf_dir, "matches"), "corners", 5, venue=True)


@R.query(_statistics("cards", 5, False))
def team_cards(spark, sf_dir):
    return form.trailing_statistics(frame(spark, sf_dir, "matches"), "cards", 5)


@R.query(_statistics("fouls", 5, False))
def team_fouls(spark, sf_dir):
    return form.trailing_statistics(frame(spark, sf_dir, "matches"), "fouls", 5)


@R.query("""
SELECT m.id, count(h.id) AS n, CASE WHEN count(h.id) >= 3 THEN round(avg(CAST(h.hg + h.ag AS DOUBLE)), 8) END AS goals,
  CASE WHEN count(h.id) >= 3 THEN round(avg(CAST(h.hg > 0 AND h.ag > 0 AS DOUBLE)), 8) END AS btts,
  CASE WHEN count(h.id) >= 3 THEN round(avg(CAST(h.hg + h.ag > 2 AS DOUBLE)), 8) END AS over_25
FROM matches m LEFT JOIN LATERAL (SELECT * FROM matches h WHERE least(h.home, h.away) = least(m.home, m.away)
  AND greatest(h.home, h.away) = greatest(m.home, m.away) AND h.finished AND h.kick < m.kick
  ORDER BY h.kick DESC, h.id DESC LIMIT 5) h ON true GROUP BY m.id""")
def h2h_last5(spark, sf_dir):
    return form.head_to_head(frame(spark, sf_dir, "matches"))


@R.query(f"""
WITH {TEAM}, k AS (SELECT id, team, finished, kick + (id % 24) * interval '1' hour + (id % 7) * interval '1' minute AS at FROM t)
SELECT a.id, a.team, round(CAST(date_diff('second', max(h.at), any_value(a.at)) // 60 AS DOUBLE) / 1440, 8) AS rest_days,
  count(h.id) FILTER (date_diff('second', h.at, a.at) // 86400 <= 7) AS last_7, count(h.id) FILTER (date_diff('second', h.at, a.at) // 86400 <= 14) AS last_14
FROM k a LEFT JOIN k h ON h.team = a.team AND h.finished AND h.at < a.at GROUP BY a.id, a.team""")
def rest_congestion(spark, sf_dir):
    at = F.expr("kick + (id % 24) * interval '1' hour + (id % 7) * interval '1' minute")
    return form.rest_and_congestion(frame(spark, sf_dir, "matches").withColumn("kick", at))


@R.query("""
SELECT competition, count(*) AS n, round(avg(hg), 8) AS home_goals, round(avg(ag), 8) AS away_goals,
  round(avg(CAST(hg > ag AS DOUBLE)), 8) AS home_rate, round(avg(CAST(hg = ag AS DOUBLE)), 8) AS draw_rate,
  round(avg(CAST(hg > 0 AND ag > 0 AS DOUBLE)), 8) AS btts_rate, round(avg(CAST(hg + ag > 2 AS DOUBLE)), 8) AS over_25_rate,
  round(avg(hc + ac), 8) AS corners, round(avg(hy + ay), 8) AS yellow, round(avg(hs + as_), 8) AS shots
FROM matches WHERE finished GROUP BY competition""")
def league_baseline(spark, sf_dir):
    return form.league_baseline(frame(spark, sf_dir, "matches"))


@R.query("""
SELECT id, CASE WHEN hg > ag THEN 'HOME' WHEN hg = ag THEN 'DRAW' ELSE 'AWAY' END AS result, hg + ag AS total,
  hg + ag > 1.5 AS over_15, hg + ag > 2.5 AS over_25, hg + ag > 3.5 AS over_35, hg > 0 AND ag > 0 AS btts, hc + ac AS corners
FROM matches WHERE finished""")
def training_labels(spark, sf_dir):
    return form.training_labels(frame(spark, sf_dir, "matches"))


@R.query(f"""
WITH {TEAM}, l AS (SELECT competition, avg(hg + ag) AS goals FROM matches WHERE finished GROUP BY 1),
s AS (SELECT t.id, t.team, any_value(coalesce(l.goals, 2.6)) AS league, sum(h.w) AS w, sum(h.w * h.gf) AS f, sum(h.w * h.ga) AS a
  FROM t LEFT JOIN l USING (competition) LEFT JOIN LATERAL (SELECT h.id, h.gf, h.ga, pow(CAST(2 AS DOUBLE), -date_diff('second', h.kick, t.kick) / CAST(7776000 AS DOUBLE)) AS w
    FROM t h WHERE h.team = t.team AND h.finished AND h.kick < t.kick ORDER BY h.kick DESC, h.id DESC LIMIT 10) h ON true GROUP BY t.id, t.team, t.at_home)
SELECT id, team, round((coalesce(f, 0) + 5 * league / 2) / (coalesce(w, 0) + 5), 6) AS scoring,
  round((coalesce(a, 0) + 5 * league / 2) / (coalesce(w, 0) + 5), 6) AS conceding, round(coalesce(w, 0), 6) AS effective_history FROM s""")
def decay_form(spark, sf_dir):
    m = frame(spark, sf_dir, "matches")
    league = m.filter("finished").groupBy("competition").agg(F.avg(F.col("hg") + F.col("ag")).alias("league_goals"))
    return form.decayed_form(m.join(league, "competition", "left"))


#: Ratings by recursion over instants: the state is a list of the twenty teams' ratings before an instant.
RATED = """instants AS (SELECT row_number() OVER (ORDER BY kick) AS step, kick,
  list({'h': home, 'a': away, 'f': finished, 's': CASE WHEN hg > ag THEN 1.0 WHEN hg = ag THEN 0.5 ELSE 0.0 END::DOUBLE}) AS ms FROM matches GROUP BY kick),
fold(step, r) AS (SELECT 1::BIGINT, list_transform(range(20), lambda t: 1500::DOUBLE)
  UNION ALL SELECT step + 1, list_transform(range(20), lambda t: r[t + 1] + list_sum(list_transform(ms, lambda m:
    CASE WHEN m.f AND t IN (m.h, m.a) THEN CASE WHEN t = m.h THEN 20 ELSE -20 END * (m.s - 1 / (1 + pow(10, (r[m.a + 1] - r[m.h + 1] - 60) / 400::DOUBLE))) ELSE 0::DOUBLE END)))
  FROM fold JOIN instants USING (step)),
rated AS (SELECT id, r[home + 1] AS home_elo, r[away + 1] AS away_elo, 1 / (1 + pow(10, (r[away + 1] - r[home + 1] - 60) / 400::DOUBLE)) AS expected_home
  FROM matches JOIN instants USING (kick) JOIN fold USING (step))"""
FACED = """faced AS (SELECT id, kick, finished, home AS team, away_elo AS other FROM matches JOIN rated USING (id) UNION ALL SELECT id, kick, finished, away, home_elo FROM matches JOIN rated USING (id)),
opposed AS (SELECT t.id, t.team, count(h.id) AS n, CASE WHEN count(h.id) >= 3 THEN round(avg(h.other), 6) END AS opponent_elo
  FROM faced t LEFT JOIN LATERAL (SELECT * FROM faced h WHERE h.team = t.team AND h.finished AND h.kick < t.kick ORDER BY h.kick DESC, h.id DESC LIMIT 5) h ON true GROUP BY t.id, t.team)"""


@R.query(f"WITH RECURSIVE {RATED} SELECT id, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo, round(expected_home, 6) AS expected_home FROM rated")
def elo_ratings(spark, sf_dir):
    out = form.elo(frame(spark, sf_dir, "matches"))
    return out.withColumns({c: F.round(c, 6) for c in ("home_elo", "away_elo", "expected_home")})


def _snapshot_sql() -> str:
    mean = lambda name, x, n="h.id": f"CASE WHEN count({n}) >= 3 THEN round(sum({x}) / CAST(count({n}) AS DOUBLE), 8) END AS {name}"
    points = "CASE WHEN h.gf > h.ga THEN 3 WHEN h.gf = h.ga THEN 1 WHEN h.gf < h.ga THEN 0 END"
    past = lambda last, same="": f"LEFT JOIN LATERAL (SELECT * FROM t h WHERE h.team = t.team AND h.finished AND h.kick < t.kick {same} ORDER BY h.kick DESC, h.id DESC LIMIT {last}) h ON true GROUP BY t.id, t.team"
    some = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    shots, cards = "h.sf IS NOT NULL AND h.sa IS NOT NULL AND h.tf IS NOT NULL AND h.ta IS NOT NULL", "h.yf IS NOT NULL AND h.ya IS NOT NULL AND h.rf IS NOT NULL AND h.ra IS NOT NULL"
    corners, fouls = "h.cf IS NOT NULL AND h.ca IS NOT NULL", "h.ff IS NOT NULL AND h.fa IS NOT NULL"
    five = ", ".join([
        mean("ppm_5", points), mean("goals_for_5", "h.gf"), mean("goals_against_5", "h.ga"), *[mean(name, some(test, x), some(test, x)) for name, test, x in (
            ("shots_5", shots, "h.sf"), ("on_target_5", shots, "h.tf"), ("corners_5", corners, "h.cf"), ("yellow_5", cards, "h.yf"), ("fouls_5", fouls, "h.ff"))],
    ])
    names = ["ppm_5", "ppm_10", "goals_for_5", "goals_against_5", "venue_ppm_5", "venue_goals_for_5", "shots_5", "on_target_5", "corners_5", "yellow_5", "fouls_5", "rest_days"]
    sides = ", ".join(f"{k}.{n} AS {side}_{n}" for n in names for side, k in (("home", "h"), ("away", "a")))
    lm = lambda name, x: f"CASE WHEN count({x}) >= 3 THEN round(avg({x}), 8) END AS league_{name}"
    return f"""
WITH {TEAM}, f AS (SELECT t.id, t.team, {five} FROM t {past(5)}), g AS (SELECT t.id, t.team, {mean('ppm_10', points)} FROM t {past(10)}),
v AS (SELECT t.id, t.team, {mean('venue_ppm_5', points)}, {mean('venue_goals_for_5', 'h.gf')} FROM t {past(5, 'AND h.at_home = t.at_home')}),
d AS (SELECT t.id, t.team, round(CAST(date_diff('second', max(h.kick), any_value(t.kick)) // 60 AS DOUBLE) / 1440, 8) AS rest_days
  FROM t LEFT JOIN t h ON h.team = t.team AND h.finished AND h.kick < t.kick GROUP BY t.id, t.team),
s AS (SELECT * FROM f JOIN g USING (id, team) JOIN v USING (id, team) JOIN d USING (id, team)),
l AS (SELECT m.id, {lm('goals', 'h.hg + h.ag')}, {lm('btts', "CASE WHEN h.id IS NOT NULL THEN CAST(h.hg > 0 AND h.ag > 0 AS INTEGER) END")}, {lm('corners', 'h.hc + h.ac')}, {lm('yellow', 'h.hy + h.ay')}
  FROM matches m LEFT JOIN matches h ON h.competition = m.competition AND h.finished AND h.kick < m.kick GROUP BY m.id),
p AS (SELECT m.id, CASE WHEN count(h.id) >= 3 THEN round(avg(h.hg + h.ag), 8) END AS h2h_goals, CASE WHEN count(h.id) >= 3 THEN round(avg(CAST(h.hg > 0 AND h.ag > 0 AS INTEGER)), 8) END AS h2h_btts
  FROM matches m LEFT JOIN LATERAL (SELECT * FROM matches h WHERE least(h.home, h.away) = least(m.home, m.away) AND greatest(h.home, h.away) = greatest(m.home, m.away) AND h.finished
    AND h.kick < m.kick ORDER BY h.kick DESC, h.id DESC LIMIT 5) h ON true GROUP BY m.id)
SELECT m.id, {sides}, league_goals, league_btts, league_corners, league_yellow, h2h_goals, h2h_btts
FROM matches m JOIN s h ON h.id = m.id AND h.team = m.home JOIN s a ON a.id = m.id AND a.team = m.away JOIN l ON l.id = m.id JOIN p ON p.id = m.id"""


@R.query(_snapshot_sql())
def feature_snapshot(spark, sf_dir):
    """The model's inputs that need no ratings, of every match."""
    return features.snapshots(frame(spark, sf_dir, "matches"))


def _dataset_sql() -> str:
    plain = [c for c in features.FEATURE_NAMES if c not in features.RATED]
    rated = {"home_elo": "r.home_elo", "away_elo": "r.away_elo", "elo_difference": "r.home_elo - r.away_elo", "expected_home": "r.expected_home"}
    rated |= {"home_opponent_elo_5": "oh.opponent_elo", "away_opponent_elo_5": "oa.opponent_elo"}
    values = ", ".join(f"round(CAST({rated.get(c, f'snapshot.{c}')} AS DOUBLE), 6)" for c in features.FEATURE_NAMES)
    return f"""
WITH RECURSIVE {RATED}, {FACED}, snapshot AS ({_snapshot_sql()})
SELECT m.id, [{values}] AS features, CASE WHEN hg > ag THEN 'HOME' WHEN hg = ag THEN 'DRAW' ELSE 'AWAY' END AS result, hg + ag AS total,
  hg + ag > 1 AS over_15, hg + ag > 2 AS over_25, hg + ag > 3 AS over_35, hg > 0 AND ag > 0 AS btts, hc + ac AS corners
FROM matches m JOIN snapshot ON snapshot.id = m.id JOIN rated r ON r.id = m.id JOIN opposed oh ON oh.id = m.id AND oh.team = m.home JOIN opposed oa ON oa.id = m.id AND oa.team = m.away
WHERE m.finished"""


@R.query(_dataset_sql())
def feature_dataset(spark, sf_dir):
    """All 36 inputs of finished matches, ratings included, with their labels."""
    m = frame(spark, sf_dir, "matches")
    found = features.dataset(features.vectors(features.snapshots(m, form.elo(m))), form.training_labels(m))
    return found.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


@R.query(f"WITH RECURSIVE {RATED}, {FACED} SELECT id, team, n, opponent_elo FROM opposed")
def opponent_elo_mean(spark, sf_dir):
    matches = frame(spark, sf_dir, "matches")
    return form.opponent_strength(matches, form.elo(matches))


@R.query("""
WITH x AS (SELECT p, odd, leg FROM observations),
l AS (SELECT 'p' AS feature, p AS x FROM x UNION ALL SELECT 'odd', odd FROM x UNION ALL SELECT 'leg', CAST(leg AS DOUBLE) FROM x),
m AS (SELECT feature, count(x) AS n, median(x) AS median FROM l GROUP BY 1)
SELECT feature, n, round(median, 6) AS median, round(avg(coalesce(x, median)), 6) AS mean,
       round(stddev_pop(coalesce(x, median)), 6) AS std FROM l JOIN m USING (feature) GROUP BY feature, n, median""")
def preprocess_stats(spark, sf_dir):
    return fits.preprocess_stats(frame(spark, sf_dir, "observations"), ["p", "odd", "leg"])


@R.query("""
WITH m AS (SELECT median(epoch_us(kick)) AS middle FROM matches)
SELECT id, CASE WHEN epoch_us(kick) < middle THEN 'fit' ELSE 'test' END AS part FROM matches, m""")
def chronological_half(spark, sf_dir):
    return fits.chronological_half(frame(spark, sf_dir, "matches").select("id", "kick"), "kick").select("id", "part")


@R.query("""
WITH n AS (SELECT id, row_number() OVER (ORDER BY kick, id) AS nth, count(*) OVER () AS total FROM matches)
SELECT id, nth, CASE WHEN nth <= 100 THEN 0 ELSE CAST(floor((nth - 101) /
  CAST(least(greatest(ceil((total - 100) / CAST(15 AS DOUBLE)), 10), 500) AS DOUBLE)) AS BIGINT) + 1 END AS fold FROM n""")
def walk_forward_folds(spark, sf_dir):
    rows = frame(spark, sf_dir, "matches").select("id", "kick")
    return fits.walk_forward_folds(rows, "kick", "id").select("id", F.col("nth").cast("long").alias("nth"), "fold")


@R.query("""
SELECT g.p_floor, g.ev_floor, count(*) AS bets, round(avg(r), 8) AS roi,
       round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)), 8) AS objective
FROM (SELECT p, p * odd - 1 AS ev, CASE WHEN y = 1 THEN odd - 1 ELSE -1 END AS r FROM observations WHERE odd IS NOT NULL) o
JOIN (SELECT CAST(a AS DOUBLE) AS p_floor, CAST(b AS DOUBLE) AS ev_floor FROM (VALUES (0.5), (0.6), (0.7)) x(a), (VALUES (0.0), (0.1)) y(b)) g
  ON o.p >= g.p_floor AND o.ev > g.ev_floor GROUP BY 1, 2""")
def policy_grid(spark, sf_dir):
    return fits.policy_grid(frame(spark, sf_dir, "observations"), [0.5, 0.6, 0.7], [0.0, 0.1])


@R.query()
def bootstrap_interval(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations").withColumn("gain", E.brier(F.col("p"), F.col("y")))
    return fits.bootstrap_interval(rows, F.to_date("generated_at"), "gain")


@R.query("""
WITH RECURSIVE d AS (SELECT p, ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))) AS x, count(*) AS n, CAST(sum(y) AS DOUBLE) AS y FROM observations GROUP BY 1),
f AS (SELECT 0 AS step, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT f.step + 1, least(greatest(any_value(f.a) - 0.03 * sum((n / (1 + exp(-(f.a * x + f.b))) - y) * x) / sum(n), 0.05), 5), least(greatest(any_value(f.b) - 0.03 * sum(n / (1 + exp(-(f.a * x + f.b))) - y) / sum(n), -5), 5)
  FROM f, d WHERE f.step < 500 GROUP BY f.step)
SELECT round(a, 6) AS a, round(b, 6) AS b FROM f WHERE step = 500""")
def platt_fit(spark, sf_dir):
    a, b = fits.platt_fit(frame(spark, sf_dir, "observations"))
    return spark.range(1).select(F.round(F.lit(a), 6).alias("a"), F.round(F.lit(b), 6).alias("b"))


def _platt_sql(rows: str) -> str:
    """Recursive descent of every market over ``rows`` (market, p, y)."""
    return f"""d AS (SELECT market, ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))) AS x, count(*) AS n, CAST(sum(y) AS DOUBLE) AS y FROM {rows} GROUP BY market, p),
f AS (SELECT DISTINCT market, 0 AS step, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM d UNION ALL
  SELECT f.market, any_value(f.step) + 1, least(greatest(any_value(f.a) - 0.03 * sum((n / (1 + exp(-(f.a * x + f.b))) - y) * x) / sum(n), 0.05), 5),
    least(greatest(any_value(f.b) - 0.03 * sum(n / (1 + exp(-(f.a * x + f.b))) - y) / sum(n), -5), 5) FROM f JOIN d ON d.market = f.market WHERE f.step < 500 GROUP BY f.market)"""


@R.query(f"WITH RECURSIVE {_platt_sql('observations')} SELECT f.market, round(a, 6) AS a, round(b, 6) AS b, (SELECT sum(n)::BIGINT FROM d WHERE d.market = f.market) AS n FROM f WHERE step = 500")
def platt_by_market(spark, sf_dir):
    """Platt parameters of every market, all in one job."""
    return fits.platt_fits(frame(spark, sf_dir, "observations"), ["market"]).withColumns({c: F.round(c, 6) for c in "ab"})


def _joint_rows(spark, sf_dir):
    m = frame(spark, sf_dir, "matches").filter("finished")
    x = F.array((F.col("home") % 5 / 4.0), F.when(F.col("away") % 7 != 0, F.col("away") % 7 / 6.0))
    return m.select("id", x.alias("x"), F.array("hg", "ag").alias("y"), F.datediff(F.to_date("kick"), F.lit("1992-01-01")).alias("day"))


@R.query("""
WITH RECURSIVE r AS (SELECT (home % 5) / 4.0 AS x1, CASE WHEN away % 7 <> 0 THEN (away % 7) / 6.0 END AS x2, hg, ag, pow(2.0, -date_diff('day', kick, max(kick) OVER ()) / 365.0) AS w FROM matches WHERE finished),
f AS (SELECT x1, coalesce(x2, (SELECT avg(x2) FROM r)) AS x2, CASE WHEN x2 IS NULL THEN 1.0 ELSE 0.0 END AS x3, hg, ag, w FROM r),
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, sum(w) AS w FROM f),
z AS (SELECT side, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3, sum(f.w) / any_value(s.w) AS w, sum(f.w * CASE side WHEN 'home' THEN hg ELSE ag END) / any_value(s.w) AS y
  FROM f, s, (VALUES ('home'), ('away')) v(side) GROUP BY ALL),
g AS (SELECT 0 AS step, side, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, ln(sum(y)) AS b0 FROM z GROUP BY side UNION ALL
  SELECT any_value(step) + 1, g.side, any_value(b1) - 0.25 * (sum(z1 * (w * exp(b0 + b1 * z1 + b2 * z2 + b3 * z3) - y)) + 0.3 * any_value(b1)),
    any_value(b2) - 0.25 * (sum(z2 * (w * exp(b0 + b1 * z1 + b2 * z2 + b3 * z3) - y)) + 0.3 * any_value(b2)), any_value(b3) - 0.25 * (sum(z3 * (w * exp(b0 + b1 * z1 + b2 * z2 + b3 * z3) - y)) + 0.3 * any_value(b3)),
    any_value(b0) - 0.25 * sum(w * exp(b0 + b1 * z1 + b2 * z2 + b3 * z3) - y) FROM g JOIN z ON z.side = g.side WHERE step < 400 GROUP BY g.side)
SELECT side, term, round(weight, 6) AS weight FROM (SELECT side, unnest(['x1', 'x2', 'missing x2', 'intercept']) AS term, unnest([b1, b2, b3, b0]) AS weight FROM g WHERE step = 400)""")
def joint_rates(spark, sf_dir):
    """Goal rates of both sides by weighted Poisson regressions; the SQL descends 400 steps instead of Newton's few."""
    made = joint.fit_rates(_joint_rows(spark, sf_dir), ["x1", "x2"])
    return made.filter("term IS NOT NULL").select("side", "term", F.round(F.col("values")[0], 6).alias("weight"))


#: Rates of a match's goals, and the masses of the four event cells of its scores.
JOINT = """r AS (SELECT id, 0.6::DOUBLE + 0.35::DOUBLE * hg AS a, 0.5::DOUBLE + 0.3::DOUBLE * ag AS b, hg, ag, 0.05::DOUBLE + (id % 90) / 100::DOUBLE AS over, 0.08::DOUBLE + (id % 83) / 100::DOUBLE AS twin FROM matches),
k(k) AS (SELECT unnest(range(41))), t AS (SELECT rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM (SELECT a AS rate FROM r UNION SELECT b FROM r), k),
n AS (SELECT rate, k, p / sum(p) OVER (PARTITION BY rate) AS p FROM t),
cells AS (SELECT a, b, sum(x.p * y.p) FILTER (x.k + y.k < 3 AND (x.k = 0 OR y.k = 0)) AS q0, sum(x.p * y.p) FILTER (x.k + y.k < 3 AND x.k > 0 AND y.k > 0) AS q1,
  sum(x.p * y.p) FILTER (x.k + y.k >= 3 AND (x.k = 0 OR y.k = 0)) AS q2, sum(x.p * y.p) FILTER (x.k + y.k >= 3 AND x.k > 0 AND y.k > 0) AS q3,
  sum(x.p * y.p) FILTER (x.k + y.k >= 4 AND (x.k = 0 OR y.k = 0)) AS t2, sum(x.p * y.p) FILTER (x.k + y.k >= 4 AND x.k > 0 AND y.k > 0) AS t3
  FROM (SELECT DISTINCT a, b FROM r) d JOIN n x ON x.rate = a JOIN n y ON y.rate = b GROUP BY a, b)"""


def _rates(spark, sf_dir):
    hg, ag, key = F.col("hg"), F.col("ag"), F.col("id")
    m = frame(spark, sf_dir, "matches")
    return m.select("id", (0.6 + 0.35 * hg).alias("home_rate"), (0.5 + 0.3 * ag).alias("away_rate"), "hg", "ag", (0.05 + key % 90 / 100).alias("over"), (0.08 + key % 83 / 100).alias("both"))


@R.query(f"""
WITH RECURSIVE {JOINT}, d AS MATERIALIZED (SELECT q0, q1, q2, q3, avg(CASE WHEN hg + ag >= 3 THEN 1.0 ELSE 0 END) AS yo, avg(CASE WHEN hg > 0 AND ag > 0 THEN 1.0 ELSE 0 END) AS yb, count(*) / (SELECT count(*) FROM r)::DOUBLE AS w
  FROM r JOIN cells USING (a, b) GROUP BY q0, q1, q2, q3),
f AS (SELECT 0 AS step, 0.0::DOUBLE AS o, 0.0::DOUBLE AS t UNION ALL
  SELECT any_value(step) + 1, least(greatest(any_value(o) - 2.0 * (sum(w * ((q2 * exp(o) + q3 * exp(o + t)) / (q0 + q1 * exp(t) + q2 * exp(o) + q3 * exp(o + t)) - yo)) + 0.02 * any_value(o)), -2), 2),
    least(greatest(any_value(t) - 2.0 * (sum(w * ((q1 * exp(t) + q3 * exp(o + t)) / (q0 + q1 * exp(t) + q2 * exp(o) + q3 * exp(o + t)) - yb)) + 0.02 * any_value(t)), -2), 2) FROM f, d WHERE step < 100 GROUP BY step)
SELECT round(o, 6) AS over, round(t, 6) AS "both" FROM f WHERE step = 100""")
def joint_calibration(spark, sf_dir):
    """The tilt of over 2.5 and both-score cells that fits what happened."""
    rows = _rates(spark, sf_dir)
    cell = 2 * (F.col("hg") + F.col("ag") >= 3).cast("int") + ((F.col("hg") > 0) & (F.col("ag") > 0)).cast("int")
    cells = joint.masses(rows).join(rows.select("id", cell.alias("cell")), "id")
    return joint.fit_tilt(cells).select(F.round("over", 6).alias("over"), F.round("both", 6).alias("both"))


@R.query(f"""
WITH {JOINT}, x AS (SELECT id, over, twin, q0, q1, q2, q3, t2, t3, q3 * q0 / (q1 * q2) AS o FROM r JOIN cells USING (a, b)),
s AS (SELECT *, CASE WHEN abs(o - 1) < 1e-9 THEN over * twin ELSE ((1 + (over + twin) * (o - 1)) - sqrt(pow(1 + (over + twin) * (o - 1), 2) - 4 * o * (o - 1) * over * twin)) / (2 * (o - 1)) END AS p3 FROM x)
SELECT id, round(p3, 7) AS over_and_both, round(over - p3, 7) AS over_only, round(twin - p3, 7) AS both_only, round(t3 * p3 / q3 + t2 * (over - p3) / q2, 7) AS over_35 FROM s""")
def joint_projection(spark, sf_dir):
    """Score distributions with given marginals; the SQL solves the two-by-two table of the same odds ratio in closed form."""
    made = joint.project(_rates(spark, sf_dir))
    c = lambda i, name: F.round(F.col("cells")[i], 7).alias(name)
    return made.select("id", c(3, "over_and_both"), c(2, "over_only"), c(1, "both_only"), F.round("over_35", 7).alias("over_35"))


STARTERS = """SELECT m.id AS match, side, CASE WHEN m.id % 10 = 9 AND i = 3 THEN NULL ELSE (m.id * 7 + i * 3 + CASE side WHEN 'HOME' THEN 0 ELSE 5 END) % 40 END AS player,
  CASE WHEN i = 0 THEN 'G' WHEN i < 5 THEN 'D' WHEN i < 9 THEN 'M' WHEN m.id % 4 = 0 THEN NULL ELSE 'F' END AS position, i = 0 AS goalkeeper"""


def _lineups(spark, sf_dir):
    m, p = frame(spark, sf_dir, "matches"), frame(spark, sf_dir, "participations")
    sql = f"{STARTERS} FROM {{m}} m LATERAL VIEW explode(array('HOME', 'AWAY')) AS side LATERAL VIEW explode(sequence(0, 10)) AS i"
    return lineups.starter_features(spark.sql(sql, m=m), p, m)


LINEUP_SQL = f"""s AS ({STARTERS} FROM matches m, (VALUES ('HOME'), ('AWAY')) v(side), range(0, 11) x(i)),
q AS (SELECT id AS match, kick, 'HOME' AS side, home AS team FROM matches UNION ALL SELECT id, kick, 'AWAY', away FROM matches),
instants AS (SELECT team, kick, sum(n) OVER (PARTITION BY team ORDER BY kick) AS starts FROM (SELECT team, kick, count(*) FILTER (started) AS n FROM participations GROUP BY 1, 2)),
debuts AS (SELECT team, player, min(kick) AS since FROM participations WHERE player IS NOT NULL GROUP BY 1, 2),
fives AS (SELECT team, kick, arg_max(five, id) AS five FROM (SELECT team, kick, id, list(player) OVER (PARTITION BY team ORDER BY kick, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five
  FROM participations WHERE started AND player IS NOT NULL) GROUP BY 1, 2),
done AS (SELECT team, kick, sum(n) OVER (PARTITION BY team ORDER BY kick) AS finished FROM (SELECT team, kick, count(*) AS n FROM
  (SELECT home AS team, kick FROM matches WHERE finished UNION ALL SELECT away, kick FROM matches WHERE finished) GROUP BY 1, 2)),
asked AS (SELECT q.*, CAST(coalesce(i.starts, 0) AS BIGINT) AS starts, coalesce(f.five, []) AS five, CAST(coalesce(d.finished, 0) AS BIGINT) AS finished, (SELECT count(*) FROM debuts e WHERE e.team = q.team AND e.since < q.kick) AS players
  FROM q ASOF LEFT JOIN instants i ON i.team = q.team AND q.kick > i.kick ASOF LEFT JOIN fives f ON f.team = q.team AND q.kick > f.kick ASOF LEFT JOIN done d ON d.team = q.team AND q.kick > d.kick),
sides AS (SELECT a.match, a.side, a.team, count(*) FILTER (list_contains(five, s.player)) AS continuity, a.starts, a.players, a.finished, len(list_distinct(five)) AS recent,
  count(*) FILTER (s.goalkeeper AND e.since < a.kick) AS keepers, count(s.player) AS resolved, count(*) FILTER (s.position = 'F') AS forwards
  FROM asked a JOIN s ON s.match = a.match AND s.side = a.side LEFT JOIN debuts e ON e.team = a.team AND e.player = s.player
  GROUP BY a.match, a.side, a.team, a.starts, a.players, a.finished, five)"""


@R.query(f"""
WITH {LINEUP_SQL} SELECT match, side, team, continuity, 11 - continuity AS changed, CASE WHEN finished = 0 THEN 0 ELSE round(continuity / 11.0, 8) END AS regulars,
  CASE WHEN starts = 0 THEN 0 ELSE recent / 5.0 END AS recent_share, keepers AS goalkeeper_continuity, players, starts, finished, resolved, forwards FROM sides""")
def lineup_features(spark, sf_dir):
    """Each lineup's continuity with its team's last starters and past appearances."""
    forwards = F.coalesce(F.element_at(F.map_from_entries("positions"), "F"), F.lit(0)).cast("long")
    return _lineups(spark, sf_dir).withColumns({"forwards": forwards, "regulars": F.round("regulars", 8)}).drop("positions")


@R.query(f"""
WITH {LINEUP_SQL} SELECT h.match, h.continuity - a.continuity AS continuity_difference, CASE WHEN h.resolved = 11 AND a.resolved = 11 THEN
  CASE WHEN h.finished + a.finished > 0 THEN 'COMPLETE' ELSE 'INSUFFICIENT_PLAYER_HISTORY' END ELSE 'PARTIAL_PLAYER_RESOLUTION' END AS quality
FROM sides h JOIN sides a ON a.match = h.match AND h.side = 'HOME' AND a.side = 'AWAY'""")
def lineup_quality(spark, sf_dir):
    return lineups.match_features(_lineups(spark, sf_dir)).select("match", "continuity_difference", "quality")


def _training_rows(spark, sf_dir):
    # No feature of a match and no rating depends on matches that are not finished, and only finished ones are trained on.
    m = frame(spark, sf_dir, "matches").filter("finished")
    return training.training_rows(features.snapshots(m, form.elo(m)), m, features.FEATURE_NAMES)


@R.query()
def trained_models(spark, sf_dir):
    """Every head's weights, the inputs' scaling, blend weights and test metrics, trained on all finished matches."""
    made = training.train(_training_rows(spark, sf_dir), features.FEATURE_NAMES)
    out = made.select("kind", "name", F.posexplode("values").alias("place", "value"))
    return out.withColumn("value", F.round("value", 5))


def _outcomes(spark, sf_dir):
    m = frame(spark, sf_dir, "matches").filter("finished")
    return m.select(
        "id", "kick", "competition", (F.col("home") % 5 / 4.0).alias("x1"), (F.col("away") % 7 / 6.0).alias("x2"), (F.col("hg") + F.col("ag") > 2).cast("int").alias("over"), "hg",
        F.when(F.col("hg") > F.col("ag"), "HOME").when(F.col("hg") == F.col("ag"), "DRAW").otherwise("AWAY").alias("result"),
    )


def _glm_sql() -> str:
    """Recursive descent of every competition over its distinct inputs, a head a recursion."""

    def one(kind: str, steps: int, rate: float) -> str:
        z, y = "c + w1 * x1 + w2 * x2", "over" if kind == "logistic" else "hg"
        p = f"(1 / (1 + exp(-({z}))))" if kind == "logistic" else f"exp(least(greatest({z}, -20), 20))"
        start = "0::DOUBLE" if kind == "logistic" else "ln(greatest(sum(hg) / sum(n), 0.05))"
        cut = (lambda x: x) if kind == "logistic" else (lambda x: f"least(greatest({x}, -5), 5)")
        w = lambda i: cut(f"any_value(w{i}) - {rate} * (sum(x{i} * (n * {p} - {y})) / sum(n) + 0.002 * any_value(w{i}))")
        return f"""{kind} AS (SELECT competition, 0 AS step, 0::DOUBLE AS w1, 0::DOUBLE AS w2, {start} AS c FROM d GROUP BY competition UNION ALL
  SELECT f.competition, any_value(step) + 1, {w(1)}, {w(2)}, {cut(f"any_value(c) - {rate} * sum(n * {p} - {y}) / sum(n)")} FROM {kind} f JOIN d ON d.competition = f.competition WHERE step < {steps} GROUP BY f.competition)"""

    names = ("HOME", "DRAW", "AWAY")
    z = [f"exp(c{i} + u{i} * x1 + v{i} * x2)" for i in range(3)]
    moves = ", ".join(
        f"any_value({k}{i}) - 0.06 * (sum({x} * (n * {z[i]} / ({z[0]} + {z[1]} + {z[2]}) - {names[i].lower()})) / sum(n){f' + 0.002 * any_value({k}{i})' if k != 'c' else ''})"
        for k, x in (("u", "x1"), ("v", "x2"), ("c", "1"))
        for i in range(3)
    )
    state = [f"{k}{i}" for k in "uvc" for i in range(3)]
    softmax = f"""softmax AS (SELECT DISTINCT competition, 0 AS step, {', '.join(f'0::DOUBLE AS {x}' for x in state)} FROM d UNION ALL
  SELECT f.competition, any_value(step) + 1, {moves} FROM softmax f JOIN d ON d.competition = f.competition WHERE step < 800 GROUP BY f.competition)"""
    rows = "SELECT '{0}' AS kind, competition, unnest(['x1', 'x2', 'intercept']) AS term, '' AS class, unnest([w1, w2, c]) AS weight FROM {0} WHERE step = {1}"
    soft = " UNION ALL ".join(
        f"SELECT 'softmax', competition, unnest(['x1', 'x2', 'intercept']), '{name}', unnest([u{i}, v{i}, c{i}]) FROM softmax WHERE step = 800" for i, name in enumerate(names)
    )
    return f"""
WITH RECURSIVE o AS (SELECT competition, (home % 5) / 4.0 AS x1, (away % 7) / 6.0 AS x2, hg, hg + ag > 2 AS o, hg > ag AS h, hg = ag AS e FROM matches WHERE finished),
d AS (SELECT competition, x1, x2, count(*)::DOUBLE AS n, sum(hg)::DOUBLE AS hg, sum(o::INT)::DOUBLE AS over, sum(h::INT)::DOUBLE AS home, sum(e::INT)::DOUBLE AS draw, (count(*) - sum(h::INT) - sum(e::INT))::DOUBLE AS away FROM o GROUP BY ALL),
{one("logistic", 700, 0.08)}, {one("poisson", 800, 0.015)}, {softmax},
w AS ({rows.format("logistic", 700)} UNION ALL {rows.format("poisson", 800)} UNION ALL {soft})
SELECT kind, competition, term, class, round(weight, 6) AS weight, (SELECT sum(n)::BIGINT FROM d WHERE d.competition = w.competition) AS n FROM w"""


@R.query(_glm_sql())
def glm_by_competition(spark, sf_dir):
    """Logistic, Poisson and softmax fits of every competition."""
    rows = _outcomes(spark, sf_dir)
    out = None
    for kind, label in (("logistic", "over"), ("poisson", "hg"), ("softmax", "result")):
        one = fits.glm_fits(rows, ["competition"], ["x1", "x2"], label, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("weight", F.round("weight", 6))


@R.query("""
WITH RECURSIVE o AS (SELECT id, (home % 5) / 4.0 AS x1, (away % 7) / 6.0 AS x2, (hg + ag > 2)::INT AS y, row_number() OVER (ORDER BY kick, id) AS nth, count(*) OVER () AS n FROM matches WHERE finished),
r AS (SELECT *, CASE WHEN nth <= 100 THEN 0 ELSE (nth - 101) // least(greatest(CAST(ceil(greatest(n - 100, 0) / 15.0) AS BIGINT), 10), 500) + 1 END AS fold FROM o),
d AS (SELECT t.fold AS target, x1, x2, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM r JOIN (SELECT DISTINCT fold FROM r WHERE fold > 0) t ON r.fold < t.fold GROUP BY ALL),
f AS (SELECT DISTINCT target, 0 AS step, 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS c FROM d UNION ALL
  SELECT f.target, any_value(step) + 1, any_value(w1) - 0.08 * (sum(x1 * (n / (1 + exp(-(c + w1 * x1 + w2 * x2))) - y)) / sum(n) + 0.002 * any_value(w1)),
    any_value(w2) - 0.08 * (sum(x2 * (n / (1 + exp(-(c + w1 * x1 + w2 * x2))) - y)) / sum(n) + 0.002 * any_value(w2)), any_value(c) - 0.08 * sum(n / (1 + exp(-(c + w1 * x1 + w2 * x2))) - y) / sum(n)
  FROM f JOIN d ON d.target = f.target WHERE step < 700 GROUP BY f.target)
SELECT id, fold, round(1 / (1 + exp(-(c + w1 * x1 + w2 * x2))), 6) AS p FROM r JOIN f ON f.target = r.fold AND step = 700""")
def walk_forward_forecasts(spark, sf_dir):
    """Out-of-sample forecasts, each by a model of the folds before its own."""
    rows = _outcomes(spark, sf_dir)
    return fits.walk_forward(fits.walk_forward_folds(rows, "kick", "id"), ["x1", "x2"], "over").withColumn("p", F.round("p", 6))


@R.query(f"""
WITH RECURSIVE h AS (SELECT *, epoch_us(generated_at) < (SELECT median(epoch_us(generated_at)) FROM observations) AS early FROM observations),
early AS (SELECT market, p, y FROM h WHERE early), {_platt_sql('early')},
m AS (SELECT f.market, a, b, (SELECT sum(n) FROM d WHERE d.market = f.market) AS n_fit FROM f WHERE step = 500),
t AS (SELECT h.market, h.p AS raw, 1 / (1 + exp(-(a * ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))) + b))) AS new, y FROM h JOIN m USING (market) WHERE NOT early),
l AS (SELECT market, count(*) AS n, avg(-ln(greatest(CASE WHEN y = 1 THEN raw ELSE 1 - raw END, 1e-12))) AS raw, avg(-ln(greatest(CASE WHEN y = 1 THEN new ELSE 1 - new END, 1e-12))) AS new FROM t GROUP BY 1),
e AS (SELECT market, sum(abs(p - y)) FILTER (kind = 'raw') / sum(n) FILTER (kind = 'raw') AS raw, sum(abs(p - y)) FILTER (kind = 'new') / sum(n) FILTER (kind = 'new') AS new FROM (
  SELECT market, kind, least(floor(p * 20), 19) AS bin, count(*) AS n, sum(p) AS p, sum(y) AS y FROM (SELECT market, 'raw' AS kind, raw AS p, y FROM t UNION ALL SELECT market, 'new', new, y FROM t) GROUP BY 1, 2, 3) GROUP BY 1)
SELECT m.market, round(a, 6) AS a, round(b, 6) AS b, l.n, CASE WHEN n_fit < 20 OR l.n < 20 THEN 'INSUFFICIENT_SAMPLE' WHEN l.new <= l.raw AND e.new <= e.raw + 0.02 THEN 'CALIBRATED_V1' ELSE 'CALIBRATION_NOT_BENEFICIAL' END AS status
FROM m JOIN l USING (market) JOIN e USING (market)""")
def calibration_by_market(spark, sf_dir):
    """Parameters and status of every market, fitted on the earlier half and judged on the later."""
    rows = fits.chronological_half(frame(spark, sf_dir, "observations"), "generated_at")
    return fits.fit_calibration(rows, "market").withColumns({c: F.round(c, 6) for c in "ab"})


@R.query("""
WITH x AS (SELECT match_id, greatest(p, 1e-9) AS a, greatest((1 - p) * CAST(0.4 AS DOUBLE), 1e-9) AS b, greatest((1 - p) * CAST(0.6 AS DOUBLE), 1e-9) AS c, match_id % 3 AS r FROM observations),
t AS (SELECT CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * i AS t FROM range(16) g(i)),
l AS (SELECT t, round(avg(-ln(greatest(exp(ln(CASE r WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / t) / (exp(ln(a) / t) + exp(ln(b) / t) + exp(ln(c) / t)), 1e-12))), 8) AS loss FROM x, t GROUP BY 1)
SELECT round(t, 8) AS t, loss FROM l ORDER BY l.loss, l.t LIMIT 1""")
def temperature_selection(spark, sf_dir):
    p = F.col("p")
    result = F.element_at(F.array(F.lit("HOME"), F.lit("DRAW"), F.lit("AWAY")), (F.col("match_id") % 3 + 1).cast("int"))
    rows = frame(spark, sf_dir, "observations").select(p.alias("home"), ((1 - p) * 0.4).alias("draw"), ((1 - p) * 0.6).alias("away"), result.alias("result"))
    return fits.select_temperature(rows).select(F.round("t", 8).alias("t"), F.round("loss", 8).alias("loss"))


@R.query("""
WITH RECURSIVE d AS (SELECT p, count(*) AS n, CAST(sum(y) AS DOUBLE) AS y FROM observations GROUP BY 1), f AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS c UNION ALL
  SELECT f.step + 1, any_value(f.w) - 0.08 * (sum((n / (1 + exp(-(f.w * p + f.c))) - y) * p) / sum(n) + 0.002 * any_value(f.w)), any_value(f.c) - 0.08 * sum(n / (1 + exp(-(f.w * p + f.c))) - y) / sum(n)
  FROM f, d WHERE f.step < 700 GROUP BY f.step)
SELECT round(w, 6) AS w_p, round(c, 6) AS intercept FROM f WHERE step = 700""")
def glm_gd_fit(spark, sf_dir):
    w = fits.logistic_gd(frame(spark, sf_dir, "observations"), ["p"], "y")
    return spark.range(1).select(F.round(F.lit(w[0]), 6).alias("w_p"), F.round(F.lit(w[1]), 6).alias("intercept"))
