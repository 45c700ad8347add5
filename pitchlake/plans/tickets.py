"""Queries over candidates, tickets, names and probability markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import publication, ranking, resolve, settlement
from pitchlake.plans.registry import Registry
from pitchlake.session import stored

R = Registry()

CANDIDATES = """c AS (SELECT *, p - 1 / odd AS edge, p * odd - 1 AS ev,
  CAST(least(history_home, history_away) >= 5 AND (market <> 'FULL_TIME_TOTAL_CORNERS' OR corners_coverage >= 0.5) AS BOOLEAN) AS good FROM predictions),
k(category) AS (VALUES ('CORNERS'), ('OVER_25'), ('OVER_35'), ('BTTS_YES'), ('HIGH_CONFIDENCE'), ('SURPRISE'), ('COMPOUND')),
g AS (SELECT *, category IN ('OVER_25', 'BTTS_YES') AS daily, CASE WHEN odd IS NULL THEN 'ODDS_UNAVAILABLE' WHEN odd <= 1 THEN 'INVALID_ODDS'
  WHEN availability <> 'AVAILABLE' THEN 'MODEL_UNAVAILABLE'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND NOT identity_valid THEN 'RESOLUTION_FAILED'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND NOT kickoff_known THEN 'KICKOFF_UNKNOWN'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND NOT p BETWEEN 0 AND 1 THEN 'INVALID_PROBABILITY'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND NOT good THEN 'INSUFFICIENT_HISTORY'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND (status = 'REJECTED' OR (observed IS NOT NULL AND n >= 50 AND p - observed > 0.20
    AND p - observed > 3 * sqrt(p * (1 - p) / n))) THEN 'NEGATIVE_MODEL_QUALITY'
  WHEN match_status = 'finished' THEN 'MATCH_FINISHED' WHEN match_status <> 'scheduled' THEN 'MATCH_STARTED'
  WHEN category IN ('CORNERS', 'HIGH_CONFIDENCE', 'COMPOUND') AND NOT good THEN 'LOW_DATA_QUALITY'
  WHEN age_seconds > 86400 THEN 'STALE_ODDS'
  WHEN category IN ('OVER_25', 'BTTS_YES') AND age_seconds < 0 THEN 'INVALID_ODDS'
  WHEN category = 'CORNERS' AND NOT (market = 'FULL_TIME_TOTAL_CORNERS' AND selection = 'OVER' AND line IN (7.5, 8.5, 9.5, 10.5, 11.5)) THEN 'ODDS_MARKET_UNAVAILABLE'
  WHEN category = 'CORNERS' AND p < 0.50 THEN 'LOW_PUBLIC_PROBABILITY'
  WHEN category = 'OVER_25' AND NOT (market = 'TOTAL_GOALS' AND selection = 'OVER' AND line = 2.5) THEN 'UNSUPPORTED_MARKET'
  WHEN category = 'OVER_35' AND NOT (market = 'TOTAL_GOALS' AND selection = 'OVER' AND line = 3.5) THEN 'UNSUPPORTED_MARKET'
  WHEN category = 'OVER_35' AND p < 0.52 THEN 'LOW_PUBLIC_PROBABILITY' WHEN category = 'OVER_35' AND edge <= 0 THEN 'LOW_EDGE'
  WHEN category = 'BTTS_YES' AND NOT (market = 'BTTS' AND selection = 'YES') THEN 'UNSUPPORTED_MARKET'
  WHEN category = 'HIGH_CONFIDENCE' AND p < 0.75 THEN 'LOW_PUBLIC_PROBABILITY'
  WHEN category = 'HIGH_CONFIDENCE' AND status <> 'CALIBRATED_V1' AND NOT (status = 'CALIBRATION_NOT_BENEFICIAL' AND n >= 20) THEN 'CALIBRATION_INSUFFICIENT'
  WHEN category = 'HIGH_CONFIDENCE' AND n < 20 THEN 'INSUFFICIENT_BUCKET_SAMPLE'
  WHEN category = 'SURPRISE' AND (odd < 2.0 OR p < 0.42) THEN 'LOW_PUBLIC_PROBABILITY' WHEN category = 'SURPRISE' AND edge < 0.05 THEN 'LOW_EDGE'
  WHEN category = 'COMPOUND' AND p < 0.72 THEN 'LOW_PUBLIC_PROBABILITY' WHEN category = 'COMPOUND' AND NOT odd BETWEEN 1.10 AND 1.50 THEN 'ODDS_OUTSIDE_COMPOUND_RANGE'
  WHEN category = 'COMPOUND' AND (status NOT IN ('CALIBRATED_V1', 'CALIBRATION_NOT_BENEFICIAL') OR n < 20) THEN 'CALIBRATION_INSUFFICIENT' END AS reason FROM c, k),
v AS (SELECT *, CASE WHEN daily THEN p ELSE CAST(0.55 AS DOUBLE) * p + CAST(0.25 AS DOUBLE) * least(greatest(edge, 0), 1) + CAST(0.15 AS DOUBLE) * least(greatest(ev, 0), 1)
    + CAST(0.04 AS DOUBLE) * CASE WHEN status = 'CALIBRATED_V1' THEN 1.0 ELSE 0.0 END + CAST(0.01 AS DOUBLE) * CASE WHEN good THEN 1.0 ELSE 0.0 END END AS score,
  CASE WHEN daily THEN CAST(n AS DOUBLE) / (n + 20) * least(greatest(1 - coalesce(abs(p - observed), 0), 0), 1) END AS confidence,
  CASE WHEN daily THEN least(greatest(CAST(least(history_home, history_away) AS DOUBLE) / 10, 0), 1) END AS history FROM g WHERE reason IS NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY day, category, match_id ORDER BY CASE WHEN daily THEN p ELSE score END DESC, CASE WHEN daily THEN ev ELSE 0 END DESC,
  CASE WHEN daily THEN confidence ELSE 0 END DESC, CASE WHEN daily THEN history ELSE 0 END DESC, id) AS of_match FROM v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, category ORDER BY CASE WHEN daily THEN p ELSE score END DESC, CASE WHEN daily THEN ev ELSE 0 END DESC,
  CASE WHEN daily THEN confidence ELSE 0 END DESC, CASE WHEN daily THEN history ELSE 0 END DESC, match_id, id) AS INTEGER) AS rank FROM b WHERE of_match = 1)"""


def predictions(spark, sf_dir):
    return frame(spark, sf_dir, "predictions")


@R.query("SELECT id, round(1 / odd, 8) AS implied, round(p - 1 / odd, 8) AS edge, round(p * odd - 1, 8) AS ev FROM predictions WHERE odd IS NOT NULL")
def value_analytics(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("odd IS NOT NULL")
    return rows.select("id", *[F.round(c, 8).alias(k) for k, c in E.value_columns(F.col("p"), F.col("odd")).items()])


@R.query(f"WITH {CANDIDATES} SELECT category, id, round(score, 8) AS score, round(confidence, 8) AS confidence, round(history, 8) AS history FROM v")
def candidate_scores(spark, sf_dir):
    """Score, confidence and history of every qualified candidate."""
    names = ranking.CATEGORIES
    gates = F.array(*[F.struct(F.lit(k).alias("category"), ranking.rejection(k).alias("reason")) for k in names])
    rows = predictions(spark, sf_dir).select("*", F.explode(gates).alias("g")).filter("g.reason IS NULL").select("*", "g.category")
    return ranking.scored(rows).select("category", "id", *[F.round(c, 8).alias(c) for c in ("score", "confidence", "history")])


@R.query(f"""
WITH {CANDIDATES}, x AS (SELECT category, reason FROM g WHERE reason IS NOT NULL UNION ALL SELECT category, CASE WHEN of_match > 1 THEN 'CORRELATION_REDUCTION' ELSE 'QUALIFIED' END FROM b)
SELECT category, reason, count(*) AS n FROM x GROUP BY 1, 2""")
def candidate_rejections(spark, sf_dir):
    """Rows per category and first reason, over the whole run."""
    run = ranking.candidate_run(predictions(spark, sf_dir))
    return run.groupBy("category", F.coalesce("reason", F.lit("QUALIFIED")).alias("reason")).agg(F.count("*").alias("n"))


@R.query(f"WITH {CANDIDATES} SELECT day, category, match_id, id, market, selection, line, round(score, 8) AS score, rank FROM r")
def candidate_run(spark, sf_dir):
    """The ranked candidates of every day and category."""
    run = ranking.candidate_run(predictions(spark, sf_dir)).filter("rank IS NOT NULL")
    return run.select("day", "category", "match_id", "id", "market", "selection", "line", F.round("score", 8).alias("score"), "rank")


@R.query(f"WITH {CANDIDATES} SELECT count(DISTINCT (match_id, market, selection, line)) AS selections, count(*) AS candidates FROM r")
def distinct_selections(spark, sf_dir):
    """Selections that some category holds, each once, whatever the number of categories."""
    run = ranking.candidate_run(predictions(spark, sf_dir)).filter("rank IS NOT NULL")
    one = F.countDistinct(F.struct("match_id", "market", "selection", "line"))
    return run.agg(one.alias("selections"), F.count("*").alias("candidates"))


@R.query(f"""
WITH {CANDIDATES}, o AS (SELECT *, CASE category WHEN 'CORNERS' THEN 'DAILY_CORNERS' WHEN 'OVER_25' THEN 'DAILY_OVER_25' WHEN 'OVER_35' THEN 'DAILY_OVER_35'
  WHEN 'BTTS_YES' THEN 'DAILY_BTTS' WHEN 'HIGH_CONFIDENCE' THEN 'DAILY_HIGH_CONFIDENCE' WHEN 'SURPRISE' THEN 'DAILY_SURPRISE_SYSTEM' END AS kind FROM r WHERE category <> 'COMPOUND'),
t AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(ln(odd)) OVER (PARTITION BY day, kind ORDER BY CASE WHEN kind = 'DAILY_HIGH_CONFIDENCE' THEN -p ELSE rank END,
    CASE WHEN kind = 'DAILY_HIGH_CONFIDENCE' THEN id ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o
  WINDOW w AS (PARTITION BY day, kind ORDER BY CASE WHEN kind = 'DAILY_HIGH_CONFIDENCE' THEN -p ELSE rank END, CASE WHEN kind = 'DAILY_HIGH_CONFIDENCE' THEN id ELSE 0 END)),
m AS (SELECT day, kind, count(*) AS legs, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS ids, round(product(odd), 6) AS odd FROM t
  WHERE CASE kind WHEN 'DAILY_CORNERS' THEN nth <= 7 WHEN 'DAILY_BTTS' THEN nth <= 7 WHEN 'DAILY_SURPRISE_SYSTEM' THEN nth <= 7
    WHEN 'DAILY_HIGH_CONFIDENCE' THEN nth <= 5 OR before < ln(3.0) - 1e-9 ELSE nth <= 5 END GROUP BY 1, 2
  HAVING count(*) >= CASE kind WHEN 'DAILY_OVER_25' THEN 3 WHEN 'DAILY_OVER_35' THEN 3 WHEN 'DAILY_SURPRISE_SYSTEM' THEN 6 ELSE 5 END),
d AS (SELECT day, kind FROM (SELECT DISTINCT day FROM predictions), (VALUES ('DAILY_CORNERS'), ('DAILY_OVER_25'), ('DAILY_OVER_35'), ('DAILY_BTTS'), ('DAILY_HIGH_CONFIDENCE'),
  ('DAILY_SURPRISE_SYSTEM'), ('DAILY_COMPOUND')) z(kind)),
cp AS (SELECT day, id, match_id, odd, score, rank, count(*) OVER (PARTITION BY day) AS n FROM r WHERE category = 'COMPOUND'),
two AS (SELECT a.day, [a.id, b.id] AS ids, a.odd * b.odd AS odd, (a.score + b.score) / 2 AS quality, a.match_id AS ma, b.match_id AS mb, a.odd * b.odd AS o2, a.score + b.score AS s2
  FROM cp a JOIN cp b ON a.day = b.day AND a.id < b.id AND a.match_id <> b.match_id AND a.n <= 256),
three AS (SELECT t.day, list_append(t.ids, c.id) AS ids, t.o2 * c.odd AS odd, (t.s2 + c.score) / 3 AS quality FROM two t JOIN cp c ON c.day = t.day AND c.id > t.ids[2] AND c.match_id NOT IN (ma, mb)
  WHERE t.day NOT IN (SELECT day FROM two WHERE abs(odd - 1.8) < 1e-9)),
bc AS (SELECT day, ids FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN abs(odd - 1.8) < 1e-9 THEN 2 WHEN odd >= 1.75 THEN 1 ELSE 0 END DESC, quality DESC, odd DESC, len(ids), ids) AS nth
  FROM (SELECT day, ids, odd, quality FROM two UNION ALL SELECT * FROM three) WHERE odd BETWEEN 1.5 - 1e-9 AND 1.8 + 1e-9) WHERE nth = 1),
mm AS (SELECT * FROM m UNION ALL SELECT bc.day, 'DAILY_COMPOUND', count(*), string_agg(CAST(cp.id AS VARCHAR), ',' ORDER BY rank), round(product(odd), 6) FROM bc JOIN cp ON cp.day = bc.day AND list_contains(bc.ids, cp.id) GROUP BY bc.day)
SELECT day, kind, CASE WHEN legs IS NULL THEN 'UNAVAILABLE' ELSE 'GENERATED' END AS state, CASE WHEN legs IS NOT NULL THEN NULL
  WHEN kind = 'DAILY_SURPRISE_SYSTEM' THEN 'INSUFFICIENT_QUALIFIED_SURPRISE_SELECTIONS' WHEN kind = 'DAILY_COMPOUND' THEN 'NO_QUALIFYING_COMPOUND_COUPON' ELSE 'INSUFFICIENT_QUALIFIED_CANDIDATES' END AS reason, legs, ids, odd,
  CASE WHEN legs IS NOT NULL THEN kind = 'DAILY_HIGH_CONFIDENCE' AND odd >= 3.0 END AS target_reached FROM d LEFT JOIN mm USING (day, kind)""")
def daily_coupons(spark, sf_dir):
    """The coupons of every day from its candidates, and why a kind has none."""
    return settlement.daily_coupons(ranking.candidate_run(predictions(spark, sf_dir)))


#: Popular selections: other writings of the predictions, some of no known match, market or selection, at prices of their own.
UNIQUE = "PARTITION BY id ORDER BY p, odd, n, competition, day, observed, age_seconds, status, history_home, history_away, market, selection, line, corners_coverage"
#: The same order in Spark, which has nulls first where DuckDB has them last.
UNIQUE_HERE = UNIQUE.replace(",", " NULLS LAST,") + " NULLS LAST"
POPULAR = """SELECT id, CASE WHEN match_id % 31 = 0 THEN NULL ELSE match_id END AS match_id, market, CASE WHEN id % 23 = 0 THEN 'YES' ELSE selection END AS selection, line,
  CASE WHEN id % 37 = 0 THEN 'MARKET_NOT_SUPPORTED' WHEN id % 41 = 0 THEN 'UNRESOLVED' END AS problem,
  CASE WHEN market = 'BTTS' AND selection = 'YES' THEN 'BTTS_YES' WHEN market = 'TOTAL_GOALS' AND selection = 'OVER' AND line = 2.5 THEN 'OVER_25' WHEN market = 'FULL_TIME_TOTAL_CORNERS' THEN 'CORNERS' END AS category,
  CASE WHEN id % 3 = 0 THEN NULL WHEN id % 43 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) + CAST(id % 17 AS DOUBLE) / CAST(8 AS DOUBLE) END AS odds, match_id % 29 <> 0 AS has_run FROM named"""


@R.query(f"""
WITH named AS (SELECT * REPLACE (id * 100 + row_number() OVER ({UNIQUE}) AS id) FROM predictions), {CANDIDATES.replace("FROM predictions)", "FROM named)")}, pop AS ({POPULAR}),
cand AS (SELECT match_id, market, selection, coalesce(line, -1) AS l, min(id) AS id, arg_min(p, id) AS p, arg_min(odd, id) AS odd FROM r GROUP BY ALL),
one AS (SELECT match_id, market, selection, coalesce(line, -1) AS l, min(id) AS id FROM named GROUP BY ALL),
pred AS (SELECT o.*, min(p.p) AS p, max(p.odd) AS odd, min(availability) AS availability, CASE WHEN o.id % 5 = 0 THEN 0.5::DOUBLE END AS revised FROM one o JOIN named p ON p.id = o.id GROUP BY ALL),
excl AS (SELECT id, category, min(coalesce(reason, CASE WHEN of_match > 1 THEN 'CORRELATION_REDUCTION' END)) AS why FROM (SELECT id, category, reason, NULL AS of_match FROM g WHERE reason IS NOT NULL
  UNION ALL SELECT id, category, NULL, of_match FROM b WHERE of_match > 1) GROUP BY 1, 2),
j AS (SELECT pop.*, pop.match_id % 13 <> 0 AS covered, pop.match_id % 11 <> 0 AS resolved, c.id AS cid, c.p AS cp, c.odd AS codd, m.id AS mid, coalesce(m.revised, m.p) AS mp, m.revised, m.odd AS modd, m.availability, why
  FROM pop LEFT JOIN cand c ON c.match_id = pop.match_id AND c.market = pop.market AND c.selection = pop.selection AND c.l = coalesce(pop.line, -1)
  LEFT JOIN pred m ON m.match_id = pop.match_id AND m.market = pop.market AND m.selection = pop.selection AND m.l = coalesce(pop.line, -1) LEFT JOIN excl e ON e.id = m.id AND e.category = pop.category),
s AS (SELECT *, CASE WHEN match_id IS NULL THEN 'UNRESOLVED/POPULAR_MATCH_UNRESOLVED' WHEN NOT covered THEN 'MODEL_UNSUPPORTED/COMPETITION_OUTSIDE_MODEL_COVERAGE' WHEN NOT resolved THEN 'UNRESOLVED/POPULAR_MATCH_UNRESOLVED'
  WHEN problem = 'MARKET_NOT_SUPPORTED' THEN 'MARKET_NOT_SUPPORTED/POPULAR_MARKET_NOT_SUPPORTED' WHEN problem IS NOT NULL THEN 'UNRESOLVED/POPULAR_SELECTION_UNRESOLVED'
  WHEN NOT has_run THEN 'MODEL_DATA_UNAVAILABLE/CANDIDATE_RUN_UNAVAILABLE' WHEN cid IS NOT NULL AND coalesce(odds, codd) <= 1 THEN 'INVALID_ODDS/INVALID_ODDS'
  WHEN cid IS NOT NULL AND cp * coalesce(odds, codd) - 1 > 0 THEN 'MODEL_SUPPORTED/' WHEN cid IS NOT NULL THEN 'MODEL_BELOW_POLICY/' WHEN mid IS NULL THEN 'MODEL_DATA_UNAVAILABLE/MODEL_PREDICTION_UNAVAILABLE'
  WHEN odds <= 1 THEN 'INVALID_ODDS/INVALID_ODDS' WHEN availability <> 'AVAILABLE' THEN 'MODEL_DATA_UNAVAILABLE/MODEL_UNAVAILABLE' WHEN category IS NULL THEN 'MODEL_NOT_SUPPORTED/SELECTION_NOT_SUPPORTED_BY_POLICY'
  WHEN why IS NULL THEN 'MODEL_DATA_UNAVAILABLE/CANDIDATE_CONTEXT_UNAVAILABLE' WHEN why IN ('ODDS_UNAVAILABLE', 'STALE_ODDS', 'MODEL_UNAVAILABLE') THEN 'MODEL_DATA_UNAVAILABLE/' || why
  ELSE 'MODEL_BELOW_POLICY/' || why END AS says FROM j)
SELECT id, split_part(says, '/', 1) AS support, nullif(split_part(says, '/', 2), '') AS reason, CASE WHEN split_part(says, '/', 1) IN ('MODEL_SUPPORTED', 'MODEL_BELOW_POLICY') AND (cid IS NOT NULL OR says NOT LIKE '%/') THEN
  CASE WHEN cid IS NOT NULL THEN round(cp * coalesce(odds, codd) - 1, 8) ELSE round(mp * coalesce(odds, modd) - 1, 8) END END AS ev FROM s""")
def supported_populars(spark, sf_dir):
    """What the run says of popular selections."""
    rows = stored(predictions(spark, sf_dir).withColumn("id", F.col("id") * 100 + F.expr(f"row_number() OVER ({UNIQUE_HERE})")))
    run = ranking.candidate_run(rows)
    popular = spark.sql(POPULAR.replace("FROM named", "FROM {rows}"), rows=rows)
    coverage = rows.select("match_id").distinct().select("match_id", (F.col("match_id") % 13 != 0).alias("covered"), (F.col("match_id") % 11 != 0).alias("resolved"))
    # A run has one row an id and category, as ids are unique here; only the categories of ``POPULAR`` are ever asked for.
    excluded = run.filter("reason IS NOT NULL").filter(F.col("category").isin("BTTS_YES", "OVER_25", "CORNERS")).select("id", "category", "reason")
    found = publication.supported_populars(popular, coverage, run.filter("rank IS NOT NULL"), rows.withColumn("revised", F.when(F.col("id") % 5 == 0, 0.5)), excluded)
    valued = F.col("support").isin("MODEL_SUPPORTED", "MODEL_BELOW_POLICY")
    return found.select("id", "support", "reason", F.when(valued, F.round("ev", 8)).alias("ev"))


@R.query("""
WITH r AS (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY p DESC, id) AS rank, count(*) OVER (PARTITION BY day) AS n
  FROM predictions WHERE odd IS NOT NULL) SELECT day, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7 AND n >= 5""")
def daily_topk(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("odd IS NOT NULL").select("day", "id", "p")
    return ranking.top_k(rows, ["day"], [F.desc("p"), F.col("id")], 7, 5).select("day", "id", "rank")


@R.query("""
SELECT market, match_id, id, CASE WHEN row_number() OVER (PARTITION BY market, match_id
  ORDER BY p DESC, id, odd) > 1 THEN 'CORRELATION_REDUCTION' END AS reason FROM predictions WHERE odd IS NOT NULL""")
def correlation_reduction(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("odd IS NOT NULL").select("market", "match_id", "id", "p", "odd")
    best, rest = ranking.best_per_match(rows, ["market"], "match_id", [F.desc("p"), F.col("id"), F.col("odd")])
    return best.withColumn("reason", F.lit(None).cast("string")).unionByName(rest).drop("p", "odd")


@R.query("""
WITH c AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_shipdate AS DATE) AS day, l_orderkey AS match_id, l_orderkey * 10 + l_linenumber AS id,
    CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(1 AS DOUBLE) + l_quantity / CAST(20 AS DOUBLE) END AS odd FROM lineitem),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day, match_id ORDER BY p DESC, id, odd, y) = 1),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY day ORDER BY p DESC, id) <= 5)
SELECT day, count(*) AS picks, CASE WHEN count(*) < 5 THEN 'INSUFFICIENT' WHEN count(odd) < 5 THEN 'PRICE_MISSING' WHEN min(y) = 1 THEN 'WON' ELSE 'LOST' END AS state,
  round(CASE WHEN count(*) = 5 AND count(odd) = 5 THEN CASE WHEN min(y) = 1 THEN product(odd) - 1 ELSE -1 END END, 6) AS profit FROM t GROUP BY day""")
def five_pick_day(spark, sf_dir):
    """The five best picks of each day on distinct matches, settled as one coupon where all have a price."""
    o = frame(spark, sf_dir, "observations")
    rows = o.select(F.to_date("generated_at").alias("day"), "match_id", (F.col("match_id") * 10 + F.col("leg")).alias("id"), "p", "y", "odd")
    best, _ = ranking.best_per_match(rows, ["day"], "match_id", [F.desc("p"), F.col("id"), F.asc_nulls_last("odd"), F.col("y")])
    picks = ranking.top_k(best, ["day"], [F.desc("p"), F.col("id")], 5)
    full, priced, won = F.count("*") == 5, F.count("odd") == 5, F.min("y") == 1
    state = F.when(~full, "INSUFFICIENT").when(~priced, "PRICE_MISSING").when(won, "WON").otherwise("LOST")
    profit = F.when(full & priced, F.when(won, F.product("odd") - 1).otherwise(-1.0))
    return picks.groupBy("day").agg(F.count("*").alias("picks"), state.alias("state"), F.round(profit, 6).alias("profit"))


@R.query("""
SELECT key, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR) || '|' || selection), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM quotes GROUP BY key""")
def input_fingerprint(spark, sf_dir):
    return ranking.input_fingerprint(frame(spark, sf_dir, "quotes"), ["key"], ["id", "selection"])


SETTLED = """s AS (SELECT coupon, count(*) AS legs, bool_or(state = 'LOST') AS lost, bool_and(state = 'VOID') AS void,
  product(CASE WHEN state = 'VOID' THEN CAST(1 AS DOUBLE) ELSE odd END) AS odd FROM legs GROUP BY coupon),
k AS (SELECT coupon, legs, CASE WHEN lost THEN 'LOST' WHEN void THEN 'VOID' ELSE 'WON' END AS result, round(odd, 8) AS odd FROM s),
w AS (SELECT *, CAST(CASE result WHEN 'WON' THEN round(1000 * odd) WHEN 'VOID' THEN 1000 ELSE 0 END AS BIGINT) AS payout_cents FROM k)"""


@R.query(f"WITH {SETTLED} SELECT * FROM w")
def settle_accumulator(spark, sf_dir):
    return settlement.settle_accumulators(frame(spark, sf_dir, "legs"), 1000)


COLUMNS = """l AS (SELECT coupon, odd, state, row_number() OVER (PARTITION BY coupon ORDER BY leg, odd, state) - 1 AS i,
  count(*) OVER (PARTITION BY coupon) AS n FROM legs),
m AS (SELECT DISTINCT coupon, n, unnest(range(1, CAST(pow(2, n) AS BIGINT))) AS mask FROM l WHERE n IN (6, 7)),
x AS (SELECT m.coupon, CAST(mask AS INTEGER) AS col, CAST(count(*) AS INTEGER) AS size, round(product(CASE WHEN state = 'VOID' THEN CAST(1 AS DOUBLE) ELSE odd END), 8) AS odd,
  CASE WHEN bool_or(state = 'LOST') THEN 'LOST' WHEN bool_and(state = 'VOID') THEN 'VOID' ELSE 'WON' END AS state
  FROM m JOIN l ON l.coupon = m.coupon AND (mask >> i) & 1 = 1 GROUP BY 1, 2 HAVING count(*) >= 5
  UNION ALL SELECT DISTINCT coupon, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), 'INVALID_SYSTEM_SELECTION_COUNT' FROM l WHERE n NOT IN (6, 7))"""


@R.query(f"WITH {COLUMNS} SELECT coupon, col AS \"column\", size, odd, state FROM x")
def system_columns(spark, sf_dir):
    return settlement.system_columns(frame(spark, sf_dir, "legs"))


SYSTEM = f"""{COLUMNS}, y AS (SELECT coupon, count(col) AS columns, count(*) FILTER (state = 'WON') AS won, count(*) FILTER (state = 'LOST') AS lost,
  count(*) FILTER (state = 'VOID') AS void, nullif(count(col) * 100, 0) AS stake_cents,
  CAST(sum(CASE state WHEN 'WON' THEN round(100 * odd) WHEN 'VOID' THEN 100 WHEN 'LOST' THEN 0 END) AS BIGINT) AS payout_cents,
  CAST(sum(round(100 * odd)) AS BIGINT) AS most_cents, max(CASE WHEN col IS NULL THEN state END) AS reason FROM x GROUP BY coupon)"""


@R.query(f"WITH {SYSTEM} SELECT * FROM y")
def settle_system(spark, sf_dir):
    return settlement.settle_systems(settlement.system_columns(frame(spark, sf_dir, "legs")), 100)


@R.query(f"""
WITH {SYSTEM} SELECT count(*) AS systems, count(stake_cents) AS settled, CAST(sum(columns) AS BIGINT) AS columns, CAST(sum(won) AS BIGINT) AS won, CAST(sum(lost) AS BIGINT) AS lost,
  CAST(sum(void) AS BIGINT) AS void, CAST(sum(stake_cents) AS BIGINT) AS stake_cents, CAST(sum(payout_cents) AS BIGINT) AS gross_cents,
  CAST(sum(payout_cents) - sum(stake_cents) AS BIGINT) AS profit_cents, round(CAST(sum(payout_cents) - sum(stake_cents) AS DOUBLE) / sum(stake_cents), 8) AS roi FROM y""")
def system_summary(spark, sf_dir):
    return settlement.system_summary(settle_system(spark, sf_dir))


COMBINATIONS = """o AS (SELECT * FROM legs WHERE odd > 1 QUALIFY row_number() OVER (PARTITION BY coupon, leg ORDER BY odd, match_id, score) = 1),
p AS (SELECT a.coupon, 2 AS size, [a.leg, b.leg] AS ids, a.odd * b.odd AS odd, (a.score + b.score) / 2 AS quality FROM o a JOIN o b
  ON a.coupon = b.coupon AND a.leg < b.leg AND a.match_id <> b.match_id),
t AS (SELECT a.coupon, 3 AS size, [a.leg, b.leg, c.leg] AS ids, a.odd * b.odd * c.odd AS odd, (a.score + b.score + c.score) / 3 AS quality FROM o a JOIN o b
  ON a.coupon = b.coupon AND a.leg < b.leg AND a.match_id <> b.match_id JOIN o c ON c.coupon = a.coupon AND c.leg > b.leg AND c.match_id NOT IN (a.match_id, b.match_id)
  WHERE a.coupon NOT IN (SELECT coupon FROM p WHERE abs(odd - 1.8) < 1e-9)), f AS (SELECT * FROM p UNION ALL SELECT * FROM t)"""


@R.query(f"""
WITH {COMBINATIONS} SELECT coupon, size, array_to_string(ids, ',') AS ids, round(odd, 8) AS odd, round(quality, 8) AS quality FROM f WHERE odd BETWEEN 1.5 - 1e-9 AND 1.8 + 1e-9
QUALIFY row_number() OVER (PARTITION BY coupon ORDER BY CASE WHEN abs(odd - 1.8) < 1e-9 THEN 2 WHEN odd >= 1.75 THEN 1 ELSE 0 END DESC, quality DESC, odd DESC, size, ids) = 1""")
def best_pair(spark, sf_dir):
    """The best pair or triple of each pool."""
    out = settlement.best_combination(settlement.combinations(frame(spark, sf_dir, "legs")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    return out.select("coupon", "size", joined, F.round("odd", 8).alias("odd"), F.round("quality", 8).alias("quality"))


@R.query(f"""
WITH {COMBINATIONS} SELECT coupon, CAST(target AS DOUBLE) AS target, size, array_to_string(ids, ',') AS ids, round(odd, 8) AS odd FROM f, (VALUES (1.5), (1.6), (1.7), (1.8)) z(target)
QUALIFY row_number() OVER (PARTITION BY coupon, target ORDER BY abs(odd - CAST(target AS DOUBLE)), size, ids) = 1""")
def nearest_target(spark, sf_dir):
    out = settlement.nearest_targets(settlement.combinations(frame(spark, sf_dir, "legs")))
    return out.select("coupon", "target", "size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.round("odd", 8).alias("odd"))


@R.query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY coupon ORDER BY leg, odd, match_id, line NULLS FIRST) AS nth FROM legs),
a AS (SELECT *, row_number() OVER w AS again, first_value(market) OVER w AS m1, first_value(line) OVER w AS l1 FROM l WINDOW w AS (PARTITION BY coupon, match_id ORDER BY nth)),
c AS (SELECT coupon, kind, count(*) AS legs, product(odd) AS odd, min(CASE WHEN again > 1 THEN nth END) AS bad FROM a GROUP BY 1, 2),
e AS (SELECT c.*, CASE WHEN a.market = 'TOTAL_GOALS' AND a.m1 = 'TOTAL_GOALS' AND a.line IS DISTINCT FROM a.l1 THEN 'NESTED_TOTAL_CONFLICT'
  WHEN (a.market = 'BTTS' AND a.m1 = 'TOTAL_GOALS') OR (a.market = 'TOTAL_GOALS' AND a.m1 = 'BTTS') THEN 'BTTS_GOALS_CONFLICT'
  WHEN a.market = 'FULL_TIME_TOTAL_CORNERS' AND a.m1 = a.market AND a.line IS DISTINCT FROM a.l1 THEN 'NESTED_CORNERS_CONFLICT' ELSE 'SAME_MATCH_CONFLICT' END AS conflict
  FROM c LEFT JOIN a ON a.coupon = c.coupon AND a.nth = c.bad)
SELECT coupon, kind, legs, CASE WHEN bad IS NOT NULL THEN conflict WHEN kind = 'DAILY_SURPRISE_SYSTEM' AND legs NOT IN (6, 7) THEN 'INVALID_SYSTEM_SELECTION_COUNT'
  WHEN kind = 'DAILY_COMPOUND' AND legs NOT IN (2, 3) THEN 'INVALID_COMPOUND_SELECTION_COUNT' WHEN kind = 'DAILY_COMPOUND' AND odd + 1e-9 < 1.10 THEN 'COMPOUND_ODDS_BELOW_MINIMUM'
  WHEN kind = 'DAILY_COMPOUND' AND odd - 1e-9 > 1.50 THEN 'COMPOUND_ODDS_ABOVE_MAXIMUM' END AS error FROM e""")
def selection_set_validation(spark, sf_dir):
    return settlement.validate_selections(frame(spark, sf_dir, "legs"))


@R.query("""
SELECT coupon, kind, count(DISTINCT match_id) = count(*) AND min(odd) > 1 AND CASE kind WHEN 'DAILY_SURPRISE_SYSTEM' THEN count(*) IN (6, 7)
  WHEN 'DAILY_COMPOUND' THEN count(*) IN (2, 3) AND product(odd) BETWEEN 1.5 - 1e-9 AND 1.8 + 1e-9 WHEN 'DAILY_OVER_25' THEN CASE WHEN coupon % 3 <> 0 THEN count(*) BETWEEN 3 AND 5 ELSE count(*) >= 5 END ELSE count(*) >= 5 END AS compliant
FROM legs GROUP BY 1, 2""")
def rule_compliance(spark, sf_dir):
    return settlement.rule_compliant(frame(spark, sf_dir, "legs"), F.col("coupon") % 3 != 0)


@R.query("""
WITH b AS (SELECT coupon, leg, CAST(row_number() OVER (PARTITION BY coupon ORDER BY leg, match_id, odd) AS INTEGER) AS nth,
  round(coalesce(exp(sum(ln(odd)) OVER (PARTITION BY coupon ORDER BY leg, match_id, odd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 6) AS before
  FROM legs) SELECT coupon, leg, nth, before FROM b WHERE before < 3.0 OR nth <= 5""")
def running_product(spark, sf_dir):
    return settlement.running_product(frame(spark, sf_dir, "legs"), 3.0, 5, ["leg", "match_id", "odd"])


def _summary(by: str) -> str:
    return f"""
WITH {SETTLED}, grouped AS (SELECT *, {by} FROM w),
turns AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coupon) - row_number() OVER (PARTITION BY grp, result ORDER BY coupon) AS run FROM (SELECT *, {by.split(" AS ")[1]} AS grp FROM grouped) WHERE result IN ('WON', 'LOST')),
streak AS (SELECT grp, max(n) FILTER (result = 'WON') AS win, max(n) FILTER (result = 'LOST') AS loss FROM (SELECT grp, result, run, count(*) AS n FROM turns GROUP BY 1, 2, 3) GROUP BY 1)
SELECT {by.split(" AS ")[1]}, count(*) AS coupons, count(*) AS settled, count(*) FILTER (result = 'WON') AS won, count(*) FILTER (result = 'LOST') AS lost, count(*) FILTER (result = 'VOID') AS void,
  round(CAST(count(*) FILTER (result = 'WON') AS DOUBLE) / nullif(count(*) FILTER (result IN ('WON', 'LOST')), 0), 8) AS hit_rate,
  count(*) * 1000 AS stake_cents, CAST(sum(payout_cents) AS BIGINT) AS gross_cents,
  CAST(sum(payout_cents) AS BIGINT) - count(*) * 1000 AS profit_cents,
  round(CAST(CAST(sum(payout_cents) AS BIGINT) - count(*) * 1000 AS DOUBLE) / (count(*) * 1000), 8) AS roi,
  CAST(1000 AS DOUBLE) AS average_stake_cents, round(avg(odd), 8) AS average_odd, coalesce(any_value(win), 0) AS longest_win, coalesce(any_value(loss), 0) AS longest_loss
FROM grouped LEFT JOIN streak ON streak.grp = grouped.{by.split(" AS ")[1]} GROUP BY 1"""


@R.query(_summary("legs + 0 AS size"))
def coupon_summary(spark, sf_dir):
    rows = settle_accumulator(spark, sf_dir)
    return settlement.coupon_summary(rows, [F.col("legs").alias("size")], 1000, ["coupon"])


@R.query(_summary("""CASE WHEN odd < 1.5 THEN '1.00-1.49' WHEN odd < 2 THEN '1.50-1.99' WHEN odd < 3 THEN '2.00-2.99' WHEN odd < 5 THEN '3.00-4.99'
  WHEN odd < 10 THEN '5.00-9.99' ELSE '10.00+' END AS band"""))
def coupon_by_band(spark, sf_dir):
    rows = settle_accumulator(spark, sf_dir)
    return settlement.coupon_summary(rows, [E.ladder(F.col("odd"), E.COUPON_BANDS).alias("band")], 1000, ["coupon"])


@R.query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY id) - row_number() OVER (PARTITION BY series, state ORDER BY id) AS run
  FROM outcomes WHERE state <> 'VOID'), r AS (SELECT series, state, run, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT series, coalesce(max(n) FILTER (state = 'WON'), 0) AS longest_win, coalesce(max(n) FILTER (state = 'LOST'), 0) AS longest_loss
FROM r GROUP BY series""")
def win_loss_streaks(spark, sf_dir):
    return settlement.streaks(frame(spark, sf_dir, "outcomes"), "series", ["id"])


@R.query("""
WITH b AS (SELECT series, id, profit, sum(profit) OVER (PARTITION BY series ORDER BY id) AS balance FROM outcomes),
p AS (SELECT *, greatest(max(balance) OVER (PARTITION BY series ORDER BY id), 0) AS peak FROM b)
SELECT series, round(sum(profit), 6) AS balance, round(max(peak - balance), 6) AS max_drawdown FROM p GROUP BY series""")
def drawdown(spark, sf_dir):
    return settlement.drawdown(frame(spark, sf_dir, "outcomes"), "series", ["id"])


@R.query("""
WITH c AS (SELECT *, CAST(sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY id) AS BIGINT) AS cycle FROM outcomes)
SELECT series, cycle, count(*) AS steps, max(step) AS reached, round(sum(profit), 6) AS profit FROM c GROUP BY 1, 2""")
def progression_cycles(spark, sf_dir):
    return settlement.cycles(frame(spark, sf_dir, "outcomes"), "series", ["id"])


@R.query("""
WITH RECURSIVE o AS (SELECT series, state, row_number() OVER (PARTITION BY series ORDER BY id) AS nth FROM outcomes),
f AS (SELECT series, CAST(0 AS BIGINT) AS nth, CAST(1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS completed, CAST(0 AS BIGINT) AS resets FROM (SELECT DISTINCT series FROM o)
  UNION ALL SELECT f.series, o.nth,
    CAST(CASE o.state WHEN 'LOST' THEN 1 WHEN 'VOID' THEN f.step ELSE CASE WHEN f.step = 7 THEN 1 ELSE f.step + 1 END END AS BIGINT),
    f.completed + CAST(o.state = 'WON' AND f.step = 7 AS BIGINT), f.resets + CAST(o.state = 'LOST' AS BIGINT)
  FROM f JOIN o ON o.series = f.series AND o.nth = f.nth + 1)
SELECT series, step, completed, resets FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY nth DESC) = 1""")
def series_fold(spark, sf_dir):
    return settlement.series_fold(frame(spark, sf_dir, "outcomes"), "series", ["id"])


@R.query("""
WITH x AS (SELECT id, hg, ag, CASE WHEN hc IS NOT NULL AND ac IS NOT NULL THEN hc + ac END AS corners, hc, ac, hy + ay AS cards,
    CASE WHEN hg > ag THEN 'HOME' WHEN hg = ag THEN 'DRAW' ELSE 'AWAY' END AS result FROM matches WHERE finished),
s(market, selection, line) AS (VALUES ('MATCH_RESULT', 'HOME', NULL), ('BTTS', 'NO', NULL), ('TOTAL_GOALS', 'OVER', 2.0), ('TOTAL_GOALS', 'UNDER', 2.5), ('TOTAL_GOALS', 'OVER', 2.75),
  ('FULL_TIME_TOTAL_CORNERS', 'UNDER', 9.0), ('CORNERS_TOTAL', 'OVER', NULL), ('MATCH_RESULT', 'NONE', NULL), ('ODD_EVEN', 'ODD', NULL)),
r AS (SELECT x.*, market, selection, CAST(line AS DOUBLE) AS line, CASE WHEN market = 'ODD_EVEN' THEN 'UNSUPPORTED_MARKET' WHEN selection = 'NONE' THEN 'UNSUPPORTED_SELECTION'
  WHEN market IN ('FULL_TIME_TOTAL_CORNERS', 'CORNERS_TOTAL') AND corners IS NULL THEN 'FINAL_CORNERS_UNAVAILABLE' WHEN market = 'CORNERS_TOTAL' THEN 'SELECTION_LINE_MISSING'
  WHEN line = 2.75 THEN 'UNSUPPORTED_ASIAN_LINE' END AS reason FROM x, s)
SELECT id, market, selection, line, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN market = 'TOTAL_GOALS' AND hg + ag = line THEN 'VOID'
  WHEN market = 'FULL_TIME_TOTAL_CORNERS' AND corners = line THEN 'VOID' WHEN CASE WHEN market = 'MATCH_RESULT' THEN selection = result WHEN market = 'BTTS' THEN hg = 0 OR ag = 0
  WHEN market = 'FULL_TIME_TOTAL_CORNERS' THEN corners < line WHEN selection = 'OVER' THEN hg + ag > line ELSE hg + ag < line END THEN 'WON' ELSE 'LOST' END AS state FROM r""")
def leg_settlement(spark, sf_dir):
    """Legs of every kind against the final results: a state, or the reason why there is none."""
    kinds = [("MATCH_RESULT", "HOME", None), ("BTTS", "NO", None), ("TOTAL_GOALS", "OVER", 2.0), ("TOTAL_GOALS", "UNDER", 2.5), ("TOTAL_GOALS", "OVER", 2.75),
             ("FULL_TIME_TOTAL_CORNERS", "UNDER", 9.0), ("CORNERS_TOTAL", "OVER", None), ("MATCH_RESULT", "NONE", None), ("ODD_EVEN", "ODD", None)]
    legs = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(x).alias("selection"), F.lit(n).cast("double").alias("line")) for m, x, n in kinds])
    rows = frame(spark, sf_dir, "matches").filter("finished").select("id", "hg", "ag", (F.col("hc") + F.col("ac")).alias("corners"), F.explode(legs).alias("l")).select("*", "l.*")
    state, reason = E.leg_outcome(*[F.col(c) for c in ("market", "selection", "line", "hg", "ag", "corners")])
    return rows.select("id", "market", "selection", "line", reason.alias("reason"), state.alias("state"))


@R.query("""
WITH s(market, selection, line) AS (VALUES ('MATCH_RESULT', 'DRAW', NULL), ('BTTS', 'YES', NULL), ('TOTAL_GOALS', 'OVER', 3.5), ('TOTAL_GOALS', 'OVER', 4.5), ('HOME_TEAM_TOTAL_GOALS', 'OVER', 1.5),
  ('AWAY_TEAM_TOTAL_GOALS', 'UNDER', 0.5), ('FULL_TIME_TOTAL_CORNERS', 'UNDER', 9.5), ('FULL_TIME_TOTAL_CARDS', 'OVER', 4.5), ('HOME_TEAM_CORNERS', 'OVER', 4.5), ('AWAY_TEAM_CORNERS', 'UNDER', 4.5), ('OTHER', 'X', 1.5))
SELECT id, market, selection, CAST(line AS DOUBLE) AS line, CASE market WHEN 'MATCH_RESULT' THEN hg = ag WHEN 'BTTS' THEN hg > 0 AND ag > 0 WHEN 'TOTAL_GOALS' THEN CASE WHEN line = 3.5 THEN hg + ag > 3.5 END
  WHEN 'HOME_TEAM_TOTAL_GOALS' THEN hg > 1.5 WHEN 'AWAY_TEAM_TOTAL_GOALS' THEN ag <= 0.5 WHEN 'FULL_TIME_TOTAL_CORNERS' THEN hc + ac <= 9.5 WHEN 'FULL_TIME_TOTAL_CARDS' THEN hy + ay > 4.5
  WHEN 'HOME_TEAM_CORNERS' THEN hc > 4.5 WHEN 'AWAY_TEAM_CORNERS' THEN ac <= 4.5 END AS hit FROM matches, s WHERE finished""")
def prediction_outcomes(spark, sf_dir):
    """Whether each kind of prediction came true; null where that is not known."""
    kinds = [("MATCH_RESULT", "DRAW", None), ("BTTS", "YES", None), ("TOTAL_GOALS", "OVER", 3.5), ("TOTAL_GOALS", "OVER", 4.5), ("HOME_TEAM_TOTAL_GOALS", "OVER", 1.5),
             ("AWAY_TEAM_TOTAL_GOALS", "UNDER", 0.5), ("FULL_TIME_TOTAL_CORNERS", "UNDER", 9.5), ("FULL_TIME_TOTAL_CARDS", "OVER", 4.5), ("HOME_TEAM_CORNERS", "OVER", 4.5),
             ("AWAY_TEAM_CORNERS", "UNDER", 4.5), ("OTHER", "X", 1.5)]
    made = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(x).alias("selection"), F.lit(n).cast("double").alias("line")) for m, x, n in kinds])
    rows = frame(spark, sf_dir, "matches").filter("finished").select("*", F.explode(made).alias("l")).select("*", "l.*")
    label = {"hg": F.col("hg"), "ag": F.col("ag"), "corners": F.col("hc") + F.col("ac"), "home_corners": F.col("hc"), "away_corners": F.col("ac"), "cards": F.col("hy") + F.col("ay")}
    hit = E.prediction_outcome(F.col("market"), F.col("selection"), F.col("line"), label)
    return rows.select("id", "market", "selection", "line", hit.alias("hit"))


def _leg_sql(rule: str) -> str:
    under = "hg + ag <= line" if rule == "backtest" else "hg + ag < line"
    plain = f"CASE WHEN CASE WHEN side = 'OVER' THEN hg + ag > line ELSE {under} END THEN 'WON' ELSE 'LOST' END"
    return f"CASE WHEN hg + ag = line THEN 'VOID' ELSE {plain} END" if rule == "coupon" else plain


@R.query(f"""
SELECT id, line, side, {_leg_sql('backtest')} AS backtest, {_leg_sql('report')} AS report,
  CASE WHEN line * 2 = floor(line * 2) THEN {_leg_sql('coupon')} END AS coupon
FROM (SELECT id, hg, ag, CAST(l AS DOUBLE) AS line, s AS side FROM matches, (VALUES (2.0), (2.5), (2.75)) a(l), (VALUES ('OVER'), ('UNDER')) b(s)
      WHERE finished)""")
def leg_outcomes(spark, sf_dir):
    """The three settlement rules side by side: they differ on a push and on quarter lines."""
    lines = F.explode(F.array(*[F.lit(x) for x in (2.0, 2.5, 2.75)])).alias("line")
    rows = frame(spark, sf_dir, "matches").filter("finished").select("id", (F.col("hg") + F.col("ag")).alias("total"), lines)
    rows = rows.withColumn("side", F.explode(F.array(F.lit("OVER"), F.lit("UNDER"))))
    rules = [E.total_outcome(F.col("total"), F.col("line"), F.col("side"), r).alias(r) for r in ("backtest", "report", "coupon")]
    return rows.select("id", "line", "side", *rules)


@R.query("""
WITH f AS (SELECT id, competition, home, away, CAST(kick AS DATE) AS day FROM matches), r AS (SELECT * FROM f WHERE id % 3 <> 1),
j AS (SELECT f.id AS fixture_id, count(*) AS n, max(CASE WHEN r.id = f.id THEN r.id END) AS own, min(r.id) AS single
      FROM f JOIN r USING (competition, home, away, day) GROUP BY f.id)
SELECT fixture_id, n, coalesce(own, CASE WHEN n = 1 THEN single END) AS match_id,
  CASE WHEN coalesce(own, CASE WHEN n = 1 THEN single END) IS NULL THEN 'AMBIGUOUS' ELSE 'FOUND' END AS state FROM j""")
def final_result_match(spark, sf_dir):
    rows = frame(spark, sf_dir, "matches").withColumn("day", F.to_date("kick"))
    return resolve.final_results(rows, rows.filter("id % 3 <> 1"))


@R.query("""
SELECT a.id AS first, b.id AS second FROM matches a JOIN matches b ON CAST(a.kick AS DATE) = CAST(b.kick AS DATE) AND a.id < b.id
  AND least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away)""")
def duplicate_fixtures(spark, sf_dir):
    return resolve.duplicate_fixtures(frame(spark, sf_dir, "matches"))


@R.query("""
SELECT s_suppkey AS id, round(1 - CAST(levenshtein(lower(s_name), lower(replace(s_name, '0', 'o'))) AS DOUBLE) / length(s_name), 8) AS score
FROM supplier""")
def name_similarity(spark, sf_dir):
    rows = frame(spark, sf_dir, "supplier")
    other = F.replace(F.col("s_name"), F.lit("0"), F.lit("o"))
    return rows.select(F.col("s_suppkey").alias("id"), F.round(E.similarity(F.lower("s_name"), F.lower(other)), 8).alias("score"))


@R.query("""
WITH c AS (SELECT c_nationkey AS block, c_custkey AS id, lower(replace(c_name, '#', ' ')) AS name FROM customer),
p AS (SELECT s.id AS source_id, t.id AS target_id, round(1 - levenshtein(s.name, t.name) / CAST(greatest(length(s.name), length(t.name)) AS DOUBLE), 8) AS score FROM c s JOIN c t USING (block)),
r AS (SELECT *, row_number() OVER w AS nth, coalesce(lead(score) OVER w, 0) AS second FROM p WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, target_id))
SELECT source_id, target_id, score, second, CASE WHEN score = 1 AND score - second >= 0.05 THEN 'EXACT' WHEN score >= 0.92 AND score - second >= 0.05 THEN 'VERY_HIGH' WHEN score >= 0.75 THEN 'REVIEW' ELSE 'UNRESOLVED' END AS level
FROM r WHERE nth = 1""")
def resolve_best_match(spark, sf_dir):
    """Customer names, misspelt and decorated, against the clean names of their nation."""
    rows = frame(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    dirty = rows.withColumn("name", F.concat(F.lit("FC "), F.replace(F.col("name"), F.lit("Customer"), F.lit("Çustomer")), F.lit(" SK")))
    return resolve.best_matches(dirty, rows, "block")


#: A provider's way of writing a club's name: as it is, decorated, misspelt, another name, or what a curated alias names.
LISTED = """CASE WHEN way % 8 = 1 THEN upper(replace(plain, 'o', 'ö')) WHEN way % 8 = 2 THEN 'FC ' || plain || ' SK' WHEN way % 8 = 3 THEN plain || ' City'
 WHEN way % 8 = 4 THEN substr(plain, 1, 4) || substr(plain, 6) WHEN way % 8 = 5 THEN substr(plain, 1, 3) || 'x' || substr(plain, 5, 4) || 'y' || substr(plain, 10)
 WHEN way % 8 = 6 THEN reverse(plain) WHEN way = 7 THEN 'Man. Utd' WHEN way = 15 THEN plain || ' . ' ELSE plain END"""
#: The provider's games: every other one, a day, hours or a competition off at times, its opponents known already or not.
LISTED_GAMES = """SELECT id + 1000000000 AS id, home + 10000000 AS home, CASE WHEN pick % 3 = 0 THEN away + 10000000 ELSE away END AS away, pick,
 competition + CASE WHEN pick % 10 = 0 THEN 1 ELSE 0 END AS competition, CASE WHEN pick % 9 = 0 THEN NULL WHEN pick % 5 = 0 THEN day + 1 ELSE day END AS day,
 kick + CAST(pick % 7 AS INT) * interval '1' hour AS kick, known, finished, CASE WHEN pick % 13 = 0 THEN hg + 1 ELSE hg END AS hg, ag
 FROM club_games WHERE nth % 2 = 1 AND away <> home"""
FOLDED = "trim(regexp_replace(replace(lower({}), 'ö', 'o'), '[^a-z0-9]+', ' ', 'g'))"
BARE = "regexp_replace(regexp_replace({}, '^(fc )+', ''), '( sk)+$', '')"


def _resolution(spark, sf_dir):
    listed = frame(spark, sf_dir, "listed_clubs").selectExpr("id", f"{LISTED} AS name", "country")
    games = frame(spark, sf_dir, "club_games")
    names = {"club_games": games}
    return listed, frame(spark, sf_dir, "clubs"), spark.sql(LISTED_GAMES.replace("club_games", "{club_games}"), **names), games.filter("away <> home")


NAMED_PAIRS = f"""s AS (SELECT id AS source_id, country, {FOLDED.format("name")} AS folded FROM (SELECT id, {LISTED} AS name, country FROM listed_clubs)),
sk AS (SELECT *, {BARE.format("folded")} AS key FROM s),
t AS (SELECT id AS target_id, country AS target_country, {FOLDED.format("name")} AS target_folded, {BARE.format(FOLDED.format("name"))} AS name FROM clubs),
allpairs AS (SELECT *, 1 - levenshtein(key, name) / CAST(greatest(length(key), length(name)) AS DOUBLE) AS sim, CASE WHEN key = 'man utd' THEN 'manchester united' END AS alias,
  regexp_replace(key, '(.)( city)+$', '\\1') AS short FROM sk, t),
pairs AS (SELECT source_id, target_id, coalesce(country <> target_country, false) AS conflict,
  CASE WHEN alias = name THEN 'ALIAS' WHEN folded = target_folded THEN 'DIRECT' WHEN key = name THEN 'DESIGNATOR' WHEN short = name THEN 'QUALIFIER' ELSE 'SIMILAR' END AS kind, sim
  FROM allpairs WHERE sim >= 0.75 OR alias = name OR short = name)"""


@R.query(f"WITH {NAMED_PAIRS} SELECT source_id, target_id, kind, conflict, CASE WHEN kind = 'SIMILAR' THEN round(sim, 8) ELSE 1.0 END AS name_score FROM pairs")
def name_candidates(spark, sf_dir):
    """Every club that a provider's name may mean, from the set-similarity join; the SQL compares all pairs."""
    listed, clubs, *_ = _resolution(spark, sf_dir)
    found = resolve.name_candidates(listed, clubs, F.lit(True))
    return found.select("source_id", "target_id", "kind", "conflict", F.round("name_score", 8).alias("name_score"))


@R.query(f"""
WITH {NAMED_PAIRS}, lg AS ({LISTED_GAMES}), cg AS (SELECT * FROM club_games WHERE away <> home),
a AS (SELECT id, home AS team, true AS h, away AS opp, competition, day, kick, known FROM lg UNION ALL SELECT id, away, false, home, competition, day, kick, known FROM lg),
b AS (SELECT id, home AS team, true AS h, away AS opp, competition, day, kick, known FROM cg UNION ALL SELECT id, away, false, home, competition, day, kick, known FROM cg),
met AS (SELECT source_id, target_id, a.id AS ai, b.id AS bi, b.h AS bh, a.h = b.h AS side, a.h = b.h AND a.opp = b.opp AS opp, a.day AS ad, b.day AS bd, a.known AND b.known AS timed,
  abs(date_diff('second', a.kick, b.kick)) // 60 AS apart FROM pairs JOIN a ON a.team = source_id JOIN b ON b.team = target_id AND a.competition = b.competition),
ctx AS (SELECT source_id, target_id, bool_or(opp) AS opp, (list(side ORDER BY ai DESC, bi DESC, bh DESC))[1] AS side,
  (list(CASE WHEN ad = bd THEN 'SAME_DATE' ELSE 'NEAR_DATE' END ORDER BY ai DESC, bi DESC, bh DESC) FILTER (ad IS NOT NULL AND bd IS NOT NULL))[1] AS dm,
  (list(apart ORDER BY ai DESC, bi DESC, bh DESC) FILTER (timed))[1] AS apart FROM met GROUP BY source_id, target_id),
j AS (SELECT p.source_id, p.target_id, kind, conflict, c.source_id IS NOT NULL AS comp, coalesce(opp, false) AS opp, coalesce(side, true) AS side, coalesce(dm, 'UNKNOWN') AS dm, apart <= 180 AS kc,
  CASE WHEN kind = 'SIMILAR' THEN sim ELSE 1.0 END AS base FROM pairs p LEFT JOIN ctx c ON p.source_id = c.source_id AND p.target_id = c.target_id),
k AS (SELECT *, round(base + CASE WHEN opp THEN 0.15 ELSE 0 END + CASE dm WHEN 'SAME_DATE' THEN 0.12 WHEN 'NEAR_DATE' THEN 0.03 ELSE 0 END + CASE WHEN comp THEN 0.08 ELSE 0 END
  + CASE WHEN kc THEN 0.05 ELSE 0 END, 8) AS score FROM j),
l AS (SELECT *, CASE WHEN kind IN ('DESIGNATOR', 'QUALIFIER') AND comp AND NOT conflict THEN 'EXACT' WHEN kind NOT IN ('DIRECT', 'ALIAS') AND score >= 0.78 AND opp AND comp AND dm = 'SAME_DATE' AND side THEN 'VERY_HIGH'
  WHEN conflict THEN 'UNRESOLVED' WHEN kind IN ('DIRECT', 'ALIAS') THEN 'EXACT' ELSE 'REVIEW' END AS level,
  row_number() OVER w AS nth, lead(score) OVER w AS runner_up FROM k WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, target_id))
SELECT sk.source_id, target_id, kind, CASE WHEN score > 1 THEN 1.0 ELSE score END AS score, coalesce(CASE WHEN level IN ('EXACT', 'VERY_HIGH') AND score - runner_up < 0.05 THEN 'REVIEW' ELSE level END, 'UNRESOLVED') AS level,
  runner_up, round(score - runner_up, 8) AS margin, comp AS competition_match, opp AS opponent_match, dm AS date_match, side AS same_orientation, kc AS kickoff_compatible, conflict
FROM sk LEFT JOIN (SELECT * FROM l WHERE nth = 1) x ON x.source_id = sk.source_id""")
def resolve_teams(spark, sf_dir):
    """A provider's clubs against the canonical ones, by name and by the fixtures both play."""
    return resolve.resolve_teams(*_resolution(spark, sf_dir), F.lit(True))


@R.query(f"""
WITH g AS (SELECT id, 'canonical' AS provider, competition, day, kick, known, home, away, finished, hg, ag FROM club_games WHERE away <> home
  UNION ALL SELECT id, 'listed', competition, day, kick, known, CASE WHEN pick % 2 = 0 THEN home - 10000000 ELSE home END, away, finished, hg, ag FROM ({LISTED_GAMES})),
n AS (SELECT id AS club, {BARE.format(FOLDED.format("name"))} AS key FROM clubs UNION ALL SELECT id + 10000000, {BARE.format(FOLDED.format("name"))} FROM clubs),
k AS (SELECT g.*, h.key AS hk, w.key AS ak FROM g JOIN n h ON h.club = home JOIN n w ON w.club = away),
p AS (SELECT a.id AS first, b.id AS second, CASE WHEN a.known AND b.known THEN abs(date_diff('second', a.kick, b.kick)) // 60 END AS minutes, abs(date_diff('day', a.day, b.day)) AS days,
  a.finished AND b.finished AND NOT (a.hg = b.hg AND a.ag = b.ag) AS contradicts, a.home = b.home AND a.away = b.away AS same
  FROM k a JOIN k b ON a.competition = b.competition AND a.hk = b.hk AND a.ak = b.ak AND a.id < b.id AND a.provider <> b.provider)
SELECT first, second, CASE WHEN days IS NULL THEN 'UNKNOWN' WHEN days = 0 THEN 'SAME_DATE' WHEN days <= 1 THEN 'NEAR_DATE' ELSE 'INCOMPATIBLE_DATE' END AS date_match, minutes, contradicts,
  CASE WHEN contradicts THEN 'INCOMPATIBLE' WHEN days = 0 AND coalesce(minutes <= 180, true) THEN CASE WHEN same THEN 'EXACT' ELSE 'VERY_HIGH' END ELSE 'REVIEW' END AS level FROM p""")
def fixture_candidates(spark, sf_dir):
    """Games that two providers both list, by their teams' keys."""
    _, clubs, listed, games = _resolution(spark, sf_dir)
    shared = ["id", "competition", "day", "kick", "known", "home", "away", "finished", "hg", "ag"]
    known = listed.withColumn("home", F.when(F.col("pick") % 2 == 0, F.col("home") - 10000000).otherwise(F.col("home")))
    both = games.select(*shared, F.lit("canonical").alias("provider")).unionByName(known.select(*shared, F.lit("listed").alias("provider")))
    names = clubs.select(F.col("id").alias("club"), "name")
    names = names.unionByName(names.withColumn("club", F.col("club") + 10000000))
    for side in ("home", "away"):
        both = both.join(names.select(F.col("club").alias(side), F.col("name").alias(f"{side}_name")), side)
    return resolve.fixture_candidates(both)


@R.query("""
WITH r AS (SELECT id, CAST(hg AS DOUBLE) * 0.4 + 0.6 AS lam FROM matches),
t AS (SELECT id, lam, k, exp(-lam) * pow(lam, k) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) AS p FROM r, range(0, 12) x(k))
SELECT id, round(1 - sum(p) FILTER (k <= 1), 6) AS over_15, round(1 - sum(p) FILTER (k <= 2), 6) AS over_25, round(1 - sum(p) FILTER (k <= 3), 6) AS over_35
FROM t GROUP BY id""")
def count_over_line(spark, sf_dir):
    rows = frame(spark, sf_dir, "matches")
    rate = F.col("hg").cast("double") * 0.4 + 0.6
    return rows.select("id", *[F.round(E.count_over(rate, x), 6).alias(f"over_{int(x * 10)}") for x in (1.5, 2.5, 3.5)])


@R.query("""
WITH r AS (SELECT id, CAST(hg AS DOUBLE) * 0.4 + 0.6 AS a, CAST(ag AS DOUBLE) * 0.3 + 0.5 AS b FROM matches),
t AS (SELECT id, i, j, exp(-a) * pow(a, i) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) * exp(-b) * pow(b, j) / CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) AS p
      FROM r, range(0, 19) x(i), range(0, 19) y(j))
SELECT id, round(sum(p) FILTER (i > j), 6) AS home, round(sum(p) FILTER (i = j), 6) AS draw, round(sum(p) FILTER (i < j), 6) AS away,
  round(sum(p) FILTER (i > 0 AND j > 0), 6) AS btts, round(sum(p) FILTER (i + j > 2), 6) AS over_25 FROM t GROUP BY id""")
def poisson_markets(spark, sf_dir):
    """1X2, both-score and totals from the 19 x 19 grid of two independent goal counts."""
    rows = frame(spark, sf_dir, "matches")
    home, away = F.col("hg").cast("double") * 0.4 + 0.6, F.col("ag").cast("double") * 0.3 + 0.5
    grid = rows.select("id", E.poisson_terms(home, 18).alias("h"), E.poisson_terms(away, 18).alias("a"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    # One pass along both counts: the chance of fewer away goals so far, home wins, draws, and totals up to two.
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("home"), F.lit(0.0).alias("draw"))
    step = lambda s, x: F.struct(
        (s["below"] + x["a"]).alias("below"), (s["home"] + x["h"] * s["below"]).alias("home"), (s["draw"] + x["h"] * x["a"]).alias("draw")
    )
    grid = grid.withColumn("s", F.aggregate(F.arrays_zip("h", "a"), start, step))
    at = lambda c, k: F.element_at(c, k + 1)
    low = sum((at("h", i) * at("a", j) for i in range(3) for j in range(3 - i) if i or j), at("h", 0) * at("a", 0))
    return grid.select(
        "id",
        F.round("s.home", 6).alias("home"),
        F.round("s.draw", 6).alias("draw"),
        F.round(1 - F.col("s.home") - F.col("s.draw"), 6).alias("away"),
        F.round((1 - at("h", 0)) * (1 - at("a", 0)), 6).alias("btts"),
        F.round(1 - low, 6).alias("over_25"),
    )


@R.query("""
WITH x AS (SELECT match_id, leg, greatest(p, 1e-9) AS a, greatest((1 - p) * 0.4, 1e-9) AS b, greatest((1 - p) * 0.6, 1e-9) AS c FROM observations)
SELECT match_id, leg, round(pow(a, 0.5) / (pow(a, 0.5) + pow(b, 0.5) + pow(c, 0.5)), 8) AS home,
  round(pow(b, 0.5) / (pow(a, 0.5) + pow(b, 0.5) + pow(c, 0.5)), 8) AS draw FROM x""")
def temperature_scale(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations")
    home, draw, _ = E.temperature([F.col("p"), (1 - F.col("p")) * 0.4, (1 - F.col("p")) * 0.6], 2.0)
    return rows.select("match_id", "leg", F.round(home, 8).alias("home"), F.round(draw, 8).alias("draw"))


@R.query("""
WITH x AS (SELECT match_id, leg, least(greatest(p, 1e-9), 1 - 1e-9) AS q, least(greatest(1 - p, 1e-9), 1 - 1e-9) AS r FROM observations)
SELECT match_id, leg, round(1 / (1 + exp(-(0.9 * ln(q / (1 - q)) + 0.1))), 8) AS over,
  round(1 - 1 / (1 + exp(-(0.9 * ln(r / (1 - r)) + 0.1))), 8) AS under FROM x""")
def platt_apply(spark, sf_dir):
    rows, p = frame(spark, sf_dir, "observations"), F.col("p")
    return rows.select("match_id", "leg", F.round(E.platt(p, 0.9, 0.1), 8).alias("over"), F.round(E.platt(p, 0.9, 0.1, True), 8).alias("under"))
