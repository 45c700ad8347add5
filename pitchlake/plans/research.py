"""Queries over goal-market research: scores, selections, policies, blocks, blends and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import research
from pitchlake.plans.registry import Registry

R = Registry()

SCORE = """100 * (CAST({0} AS DOUBLE) * probability + CAST({1} AS DOUBLE) * least(greatest(expected_goals / 6, 0), 1) + CAST({2} AS DOUBLE) * least(greatest(ev + CAST(0.5 AS DOUBLE), 0), 1)
  + CAST({3} AS DOUBLE) * least(greatest(1 / odds, 0), 1) + CAST({4} AS DOUBLE) * least(greatest(attack / 5, 0), 1) + CAST({5} AS DOUBLE) * least(greatest(concession / 5, 0), 1)
  + CAST({6} AS DOUBLE) * btts + CAST({7} AS DOUBLE) * least(greatest(league_goals / 4, 0), 1) + CAST({8} AS DOUBLE) * quality)"""
BASE = (0.28, 0.12, 0.15, 0.08, 0.10, 0.08, 0.08, 0.06, 0.05)
SAFETY = """CASE WHEN odds IS NULL OR ev IS NULL OR attack IS NULL THEN 'MISSING_INPUT_OR_PRICE' WHEN NOT probability BETWEEN 0 AND 1 OR NOT btts BETWEEN 0 AND 1 THEN 'INVALID_PROBABILITY'
  WHEN NOT prematch_valid THEN 'INVALID_PREMATCH_PROVENANCE' WHEN history < 5 THEN 'INSUFFICIENT_HISTORY' WHEN odds <= 1 OR odds > 8 THEN 'INVALID_OR_EXTREME_ODDS'
  WHEN odds_age_hours NOT BETWEEN 0 AND 24 THEN 'STALE_OR_FUTURE_ODDS' WHEN probability < 0.5 THEN 'PROBABILITY_SAFETY_FLOOR' WHEN ev < 0 THEN 'EV_SAFETY_FLOOR' END"""


def _rows(spark, sf_dir):
    return frame(spark, sf_dir, "goal_rows").withColumn("ev", F.col("probability") * F.col("odds") - 1)


GOALS = "g AS (SELECT *, probability * odds - 1 AS ev FROM goal_rows)"


@R.query(f"WITH {GOALS} SELECT match_id, round({SCORE.format(*BASE)}, 8) AS score, {SAFETY} AS reason FROM g")
def research_scores(spark, sf_dir):
    """Score of every priced row, and the first reason not to rank it."""
    rows = _rows(spark, sf_dir)
    return rows.select("match_id", F.round(research.score(research.WEIGHTS[2.5]), 8).alias("score"), research.safety(0.5, 0.0).alias("reason"))


SELECTED = f"""{GOALS}, s AS (SELECT *, {SCORE.format(*BASE)} AS score FROM g WHERE {SAFETY} IS NULL), a AS (SELECT * FROM s WHERE score >= 45),
d AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, probability DESC, match_id) AS rank, count(*) OVER (PARTITION BY date) AS n FROM a),
t AS (SELECT * FROM d WHERE n >= 5 AND rank <= 7)"""


def _selected(spark, sf_dir):
    return research.daily_selections(_rows(spark, sf_dir), research.WEIGHTS[2.5], 0.5, 0.0, 45.0)


@R.query(f"WITH {SELECTED} SELECT date, match_id, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank FROM t")
def research_selections(spark, sf_dir):
    return _selected(spark, sf_dir).select("date", "match_id", F.round("score", 8).alias("score"), "rank")


@R.query(f"""
WITH {SELECTED}, c AS (SELECT date, product(odds) * min(won) - 1 AS r FROM t GROUP BY 1 HAVING count(*) BETWEEN 5 AND 7)
SELECT count(*) AS bets, round(avg(CAST(won AS DOUBLE)), 8) AS hit_rate, round(avg(won * odds - 1), 8) AS roi, round(avg(odds), 8) AS average_odds,
  round(avg((probability - won) * (probability - won)), 8) AS brier, round(avg(probability - won), 8) AS calibration_gap, (SELECT count(*) FROM c) AS coupons, (SELECT round(avg(r), 8) FROM c) AS coupon_roi FROM t""")
def selection_metrics(spark, sf_dir):
    return research.selection_metrics(_selected(spark, sf_dir))


@R.query(f"WITH {GOALS} SELECT match_id FROM g WHERE odds > 1 AND probability >= 0.64 AND ev > 0 AND prematch_valid")
def old_selection(spark, sf_dir):
    return research.old_selection(_rows(spark, sf_dir), 2.5).select("match_id")


def _grid() -> str:
    """The weight family written out: the base, then every target with -.03 and +.06."""
    rows = [BASE]
    for target in (1, 2, 4, 5, 7, 8):
        for delta in (-0.03, 0.06):
            w = list(BASE)
            w[0] -= delta
            w[target] += delta
            rows.append(tuple(w))
    return " UNION ALL ".join(f"SELECT g.*, {i} AS family, {SCORE.format(*w)} AS score FROM g" for i, w in enumerate(rows))


@R.query(f"""
WITH {GOALS}, s AS (SELECT * FROM ({_grid()}) x WHERE {SAFETY.replace('probability < 0.5', 'probability < 0.45').replace('ev < 0 ', 'ev < -0.05 ')} IS NULL),
p AS (SELECT s.*, CAST(f AS DOUBLE) AS floor, CAST(e AS DOUBLE) AS ev_floor, CAST(c AS DOUBLE) AS cutoff FROM s, (VALUES (0.45), (0.55)) a(f), (VALUES (-0.05), (0.0)) b(e), (VALUES (45.0), (50.0)) d(c)
  WHERE probability >= CAST(f AS DOUBLE) AND ev >= CAST(e AS DOUBLE) AND score >= CAST(c AS DOUBLE)),
r AS (SELECT *, row_number() OVER (PARTITION BY family, floor, ev_floor, cutoff, date ORDER BY score DESC, probability DESC, match_id) AS rank, count(*) OVER (PARTITION BY family, floor, ev_floor, cutoff, date) AS n FROM p)
SELECT family, floor, ev_floor, cutoff, count(*) AS bets, round(avg(won * odds - 1), 8) AS roi, round(avg(probability - won), 8) AS gap,
  round(avg(won * odds - 1) - CAST(1.96 AS DOUBLE) * stddev_pop(won * odds - 1) / sqrt(count(*)) - CAST(0.25 AS DOUBLE) * abs(avg(probability - won)), 8) AS objective
FROM r WHERE n >= 5 AND rank <= 7 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20""")
def policy_search(spark, sf_dir):
    """Every policy of the weight family and floors, with its objective."""
    return research.tune(_rows(spark, sf_dir), 2.5, [0.45, 0.55], [-0.05, 0.0], [45.0, 50.0], least_bets=20)


@R.query("""
SELECT l_suppkey % 97 AS supplier, l_linenumber AS leg, min(l_quantity) AS price FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) = 1
UNION ALL SELECT 1000 + l_orderkey, l_linenumber, min(l_quantity) FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) = 1""")
def agreed_prices(spark, sf_dir):
    """Prices by key from two sources' rows; conflicting ones go."""
    rows = frame(spark, sf_dir, "lineitem").withColumn("price", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")))
    a = rows.select((F.col("l_suppkey") % 97).alias("supplier"), F.col("l_linenumber").alias("leg"), "price")
    b = rows.select((F.col("l_orderkey") + 1000).alias("supplier"), F.col("l_linenumber").alias("leg"), "price")
    return research.agreed_prices(a.union(b), ["supplier", "leg"], "price")


@R.query("""
WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(kick AS DATE) AS day FROM matches)),
e AS (SELECT i AS block, CAST(floor(any_value(n) * [0.4, 0.55, 0.7, 0.85, 1.0][i + 1]) AS BIGINT) AS start, CAST(floor(any_value(n) * [0.4, 0.55, 0.7, 0.85, 1.0][i + 2]) AS BIGINT) AS stop FROM d, range(4) t(i) GROUP BY 1),
c AS (SELECT block, (SELECT day FROM d WHERE nth = floor(start * 0.65)) AS a, (SELECT day FROM d WHERE nth = floor(start * 0.8)) AS b, (SELECT day FROM d WHERE nth = floor(start * 0.9)) AS c,
  (SELECT day FROM d WHERE nth = start) AS t, coalesce((SELECT day FROM d WHERE nth = stop), DATE '9999-01-01') AS z FROM e),
x AS (SELECT m.id, CAST(c.block AS INTEGER) AS block, CASE WHEN CAST(kick AS DATE) < c.a - 2 THEN 'fit' WHEN CAST(kick AS DATE) >= c.a AND CAST(kick AS DATE) < c.b - 2 THEN 'tune'
  WHEN CAST(kick AS DATE) >= c.b AND CAST(kick AS DATE) < c.c - 2 THEN 'calibrate' WHEN CAST(kick AS DATE) >= c.c AND CAST(kick AS DATE) < c.t - 2 THEN 'late'
  WHEN CAST(kick AS DATE) >= c.t AND CAST(kick AS DATE) < c.z THEN 'test' END AS part FROM matches m, c)
SELECT id, block, part FROM x WHERE part IS NOT NULL""")
def chronological_blocks(spark, sf_dir):
    return research.blocks(frame(spark, sf_dir, "matches").select("id", "kick"), "kick").select("id", "block", "part")


@R.query("""
WITH x AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS DOUBLE) / 100 AS b, CAST(c_custkey % 5 AS DOUBLE) / 100 AS l, CAST(c_custkey % 3 AS DOUBLE) - 1.5 AS u, c_custkey % 40 AS n, CASE WHEN c_custkey % 12 <> 0 THEN CAST(c_custkey % 11 AS DOUBLE) / 10 END AS r FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN NOT (0.3 - b <= 0.99 * 0.27 AND 0.6 - l <= 0.99 * 0.59 AND u < 0) THEN 'PROBABILITY_NOT_IMPROVED' END, CASE WHEN n < 11 THEN 'AVAILABILITY_NOT_IMPROVED' END,
  CASE WHEN n % 8 < 5 THEN 'FLOOR_AVAILABILITY_FALLS' END, CASE WHEN r IS NULL OR NOT (id % 6 >= 2 AND r >= 0.5 AND b <= 0.03) THEN 'COUPONS_DEGRADED' END, 'NO_TIMESTAMPED_PRICES', 'NO_FRESH_HOLDOUT'],
  lambda x: x IS NOT NULL), ',') AS reasons FROM x""")
def adoption_gate(spark, sf_dir):
    k = F.col("c_custkey")
    rows = frame(spark, sf_dir, "customer").select(
        k.alias("id"), (0.3 - (k % 7).cast("double") / 100).alias("brier"), F.lit(0.27).alias("base_brier"), (0.6 - (k % 5).cast("double") / 100).alias("log_loss"), F.lit(0.59).alias("base_log_loss"),
        ((k % 3).cast("double") - 1.5).alias("upper95"), (k % 40).alias("bets"), F.lit(10.0).alias("base_bets"), F.when(k % 12 != 0, (k % 11).cast("double") / 10).alias("coupon_roi"), F.lit(0.5).alias("base_coupon_roi"),
        (k % 40 % 8).alias("above_floor"), F.lit(5).alias("base_above_floor"), (k % 6).alias("full_saturdays"), F.lit(2).alias("base_full_saturdays"),
        ((k % 7).cast("double") / 100).alias("drawdown"), F.lit(0.03).alias("base_drawdown"),
    )
    return research.adoption(rows).select("id", F.array_join("reasons", ",").alias("reasons"))


@R.query("""
WITH x AS (SELECT match_id, leg, p AS a, public AS b, odd AS c FROM (SELECT match_id, leg, p, CAST((p * 7 + leg) AS DOUBLE) / 14 AS public, CAST(leg AS DOUBLE) / 10 AS odd FROM observations))
SELECT match_id, leg, round(a, 8) AS first, round(least(a, b), 8) AS second, round(least(a, b, c), 8) AS third FROM x""")
def monotone_lines(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations")
    lines = research.monotone([F.col("p"), (F.col("p") * 7 + F.col("leg")).cast("double") / 14, F.col("leg").cast("double") / 10])
    return rows.select("match_id", "leg", *[F.round(c, 8).alias(n) for n, c in zip(("first", "second", "third"), lines)])


@R.query("""
WITH r AS (SELECT id, CAST(hg AS DOUBLE) * 0.4 + 0.6 AS a, CAST(ag AS DOUBLE) * 0.3 + 0.5 AS b FROM matches),
t AS (SELECT id, i, j, exp(-a) * pow(a, i) / factorial(CAST(i AS INTEGER)) * exp(-b) * pow(b, j) / factorial(CAST(j AS INTEGER)) AS p FROM r, range(0, 20) x(i), range(0, 20) y(j)),
s AS (SELECT id, sum(p) FILTER (i > j) AS home, sum(p) FILTER (i = j) AS draw, sum(p) AS total, sum(p) FILTER (i + j > 1) AS o1, sum(p) FILTER (i + j > 2) AS o2, sum(p) FILTER (i + j > 3) AS o3,
  sum(p) FILTER (i > 0) AS h0, sum(p) FILTER (i > 1) AS h1, sum(p) FILTER (j > 0) AS a0, sum(p) FILTER (j > 1) AS a1, sum(p) FILTER (i > 0 AND j > 0) AS btts FROM t GROUP BY id)
SELECT id, m.market, m.selection, CAST(m.line AS DOUBLE) AS line, round(m.p, 6) AS p, 'AVAILABLE' AS availability FROM s, LATERAL (VALUES ('MATCH_RESULT', 'HOME', NULL, home / total), ('MATCH_RESULT', 'DRAW', NULL, draw / total),
  ('MATCH_RESULT', 'AWAY', NULL, 1 - (home + draw) / total), ('BTTS', 'YES', NULL, btts), ('BTTS', 'NO', NULL, 1 - btts), ('TOTAL_GOALS', 'OVER', 1.5, o1), ('TOTAL_GOALS', 'UNDER', 1.5, 1 - o1),
  ('TOTAL_GOALS', 'OVER', 2.5, o2), ('TOTAL_GOALS', 'UNDER', 2.5, 1 - o2), ('TOTAL_GOALS', 'OVER', 3.5, o3), ('TOTAL_GOALS', 'UNDER', 3.5, 1 - o3), ('HOME_TEAM_TOTAL_GOALS', 'OVER', 0.5, h0),
  ('HOME_TEAM_TOTAL_GOALS', 'UNDER', 0.5, 1 - h0), ('HOME_TEAM_TOTAL_GOALS', 'OVER', 1.5, h1), ('HOME_TEAM_TOTAL_GOALS', 'UNDER', 1.5, 1 - h1), ('AWAY_TEAM_TOTAL_GOALS', 'OVER', 0.5, a0),
  ('AWAY_TEAM_TOTAL_GOALS', 'UNDER', 0.5, 1 - a0), ('AWAY_TEAM_TOTAL_GOALS', 'OVER', 1.5, a1), ('AWAY_TEAM_TOTAL_GOALS', 'UNDER', 1.5, 1 - a1)) m(market, selection, line, p)""")
def expanded_markets(spark, sf_dir):
    """Every market of a match from its two goal rates, a binary one as two rows."""
    m = frame(spark, sf_dir, "matches")
    rates = F.col("hg").cast("double") * 0.4 + 0.6, F.col("ag").cast("double") * 0.3 + 0.5
    rows = m.select("id", *[c.alias(k) for k, c in research.goal_markets(*rates).items()])
    return research.expanded(rows).withColumn("p", F.round("p", 6))


@R.query("""
WITH x AS (SELECT p AS a, CAST((match_id * 7 + leg) % 100 AS DOUBLE) / 100 AS b, y FROM observations), w AS (SELECT i * CAST(0.05 AS DOUBLE) AS w FROM range(21) t(i)),
l AS (SELECT w, sum(-y * ln(least(greatest(w * a + (1 - w) * b, 1e-12), 1 - 1e-12)) - (1 - y) * ln(1 - least(greatest(w * a + (1 - w) * b, 1e-12), 1 - 1e-12))) AS loss FROM x, w GROUP BY 1)
SELECT round(w, 8) AS w, round(loss, 4) AS loss FROM l ORDER BY l.loss, l.w LIMIT 1""")
def blend_selection(spark, sf_dir):
    o = frame(spark, sf_dir, "observations")
    rows = o.select(F.col("p").alias("a"), (((F.col("match_id") * 7 + F.col("leg")) % 100).cast("double") / 100).alias("b"), "y")
    return research.select_blend(rows, "a", "b", "y").select(F.round("w", 8).alias("w"), F.round("loss", 4).alias("loss"))


@R.query("""
WITH x AS (SELECT match_id, leg, 0.35 * p + CAST(0.65 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS a, CAST(0.35 AS DOUBLE) * (1 - p) * CAST(0.4 AS DOUBLE) + CAST(0.65 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS b,
  CAST(0.35 AS DOUBLE) * (1 - p) * CAST(0.6 AS DOUBLE) + CAST(0.65 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS c FROM observations)
SELECT match_id, leg, round(a / (a + b + c), 8) AS home, round(b / (a + b + c), 8) AS draw FROM x""")
def blended_results(spark, sf_dir):
    p = F.col("p")
    home, draw, _ = research.blend([p, (1 - p) * 0.4, (1 - p) * 0.6], [F.lit(0.5), F.lit(0.3), F.lit(0.2)], 0.35)
    return frame(spark, sf_dir, "observations").select("match_id", "leg", F.round(home, 8).alias("home"), F.round(draw, 8).alias("draw"))


@R.query("SELECT match_id, leg, CASE WHEN p IS NULL THEN 0.5 ELSE least(greatest(p * 3 - 1, 0), 1) END AS p FROM observations")
def clamped_probabilities(spark, sf_dir):
    return frame(spark, sf_dir, "observations").select("match_id", "leg", E.clamp_probability(F.col("p") * 3 - 1).alias("p"))
