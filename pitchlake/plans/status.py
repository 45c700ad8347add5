"""Queries over status, coverage, queues, publication and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import publication, ranking, status
from pitchlake.plans.registry import Registry

R = Registry()


def _matches(spark, sf_dir):
    return frame(spark, sf_dir, "matches")


@R.query("""
SELECT count(*) AS matches, (SELECT count(*) FROM customer) AS teams, min(coalesce(CASE WHEN id % 2 = 0 THEN CAST(kick AS DATE) + 1 END, CAST(kick AS DATE))) AS earliest,
  max(coalesce(CASE WHEN id % 2 = 0 THEN CAST(kick AS DATE) + 1 END, CAST(kick AS DATE))) AS latest FROM matches""")
def normalized_totals(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumn("local_date", F.when(F.col("id") % 2 == 0, F.date_add(F.to_date("kick"), 1)))
    return status.totals(m, frame(spark, sf_dir, "customer"))


@R.query("""
SELECT count(*) AS snapshots, CAST(sum(CASE WHEN id % 9 < 3 OR id % 7 < 3 THEN 1 ELSE 0 END) AS BIGINT) AS insufficient_history,
  round(avg((CAST(id % 5 AS DOUBLE) / 4 + 0.5 + CAST(id % 3 AS DOUBLE) / 2 + 1) / 4), 8) AS coverage, count(DISTINCT competition) AS competitions, min(kick) AS earliest, max(kick) AS latest FROM matches""")
def feature_quality(spark, sf_dir):
    k = F.col("id")
    body = F.struct((k % 9).alias("history_home"), (k % 7).alias("history_away"), ((k % 5).cast("double") / 4).alias("shots"), F.lit(0.5).alias("corners"), ((k % 3).cast("double") / 2).alias("cards"), F.lit(1.0).alias("fouls"))
    return status.feature_quality(_matches(spark, sf_dir).select("competition", F.col("kick").alias("cutoff"), F.to_json(body).alias("quality")))


RUNS = """r AS (SELECT o_orderkey AS id, 'd' || (o_custkey % 12) AS dataset, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
  o_orderdate + interval '1' hour AS completed_at, o_custkey % 10 AS competition, o_custkey % 4 AS season FROM orders)"""


def _runs(spark, sf_dir):
    o = frame(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("d"), F.col("o_custkey") % 12).alias("dataset"), name.alias("status"), F.expr("o_orderdate + interval '1' hour").alias("completed_at"),
        (F.col("o_custkey") % 10).alias("competition"), (F.col("o_custkey") % 4).alias("season"),
    )


@R.query(f"""
WITH {RUNS}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY id DESC) = 1)
SELECT l.dataset, (SELECT max(completed_at) FROM r WHERE r.dataset = l.dataset AND r.status = 'completed') AS last_import, l.status, count(DISTINCT m.id) AS matches,
  count(DISTINCT CASE WHEN m.finished THEN m.id END) AS finished, count(DISTINCT CASE WHEN m.hc IS NOT NULL THEN m.id END) AS with_statistics
FROM l LEFT JOIN matches m ON m.competition = l.competition AND m.id % 4 = l.season GROUP BY l.dataset, l.status""")
def dataset_status(spark, sf_dir):
    return status.dataset_status(_runs(spark, sf_dir), _matches(spark, sf_dir).withColumn("season", F.col("id") % 4))


@R.query("""
WITH q AS (SELECT l_orderkey AS match_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey % 3 END AS code, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 2 END AS market_id, l_returnflag AS line FROM lineitem)
SELECT m.id, count(DISTINCT CASE WHEN code IS NOT NULL THEN code || ':' || coalesce(CAST(market_id AS VARCHAR), '') || ':' || line END) AS markets FROM matches m LEFT JOIN q ON q.match_id = m.id GROUP BY m.id""")
def markets_per_match(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem")
    quotes = rows.select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey") % 3).alias("code"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") % 2).alias("market_id"), F.col("l_returnflag").alias("line"))
    return status.markets_per_match(_matches(spark, sf_dir), quotes)


@R.query(f"""
WITH {RUNS} SELECT (SELECT max(completed_at) FROM r WHERE status = 'completed') AS last_refresh, count(DISTINCT id) AS upcoming, count(DISTINCT competition) AS competitions,
  (SELECT count(DISTINCT t) FROM (SELECT home AS t FROM matches WHERE NOT finished UNION ALL SELECT away FROM matches WHERE NOT finished)) AS teams,
  (SELECT max(captured) FROM quotes) AS latest_quote, (SELECT count(*) FROM quotes) AS quotes FROM matches WHERE NOT finished""")
def bulletin_status(spark, sf_dir):
    return status.bulletin_status(_runs(spark, sf_dir), _matches(spark, sf_dir), frame(spark, sf_dir, "quotes"))


@R.query("""
WITH l AS (SELECT * FROM popularity WHERE metric = 'COUNT' QUALIFY row_number() OVER (PARTITION BY key, selection ORDER BY captured DESC, id DESC) = 1)
SELECT (SELECT count(*) FROM popularity) AS snapshots, (SELECT max(captured) FROM popularity) AS latest, count(*) AS selections, count(*) FILTER (key % 3 = 0) AS matched, count(*) FILTER (key % 3 <> 0) AS unmatched FROM l""")
def popularity_status(spark, sf_dir):
    rows = frame(spark, sf_dir, "popularity")
    return status.popularity_status(rows, rows.filter("key % 3 = 0").select("key"))


@R.query("SELECT count(*) FILTER (c_nationkey IN (SELECT s_nationkey FROM supplier)) AS resolved, count(*) FILTER (c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS unresolved FROM customer")
def mapping_counts(spark, sf_dir):
    source = frame(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("team"))
    return status.mapping_counts(source, frame(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team")), "team")


@R.query("""
WITH b AS (SELECT count(*) AS n, count(hc + ac) AS c, count(hy + ay) AS y FROM matches WHERE finished)
SELECT m.market, CASE WHEN m.n IS NULL THEN 'SOURCE_NOT_AVAILABLE' WHEN m.n >= 10 THEN 'SUPPORTED' WHEN m.n >= 3 THEN 'PARTIAL' ELSE 'INSUFFICIENT_HISTORY' END AS state, coalesce(m.n, 0) AS usable, round(coalesce(m.n, 0) / CAST(b.n AS DOUBLE), 8) AS coverage
FROM b, LATERAL (VALUES ('MATCH_RESULT', b.n), ('TOTAL_GOALS', b.n), ('BTTS', b.n), ('TEAM_TOTAL_GOALS', b.n), ('FULL_TIME_TOTAL_CORNERS', c), ('FIRST_HALF_TOTAL_CORNERS', NULL), ('TEAM_CORNERS', c),
  ('FULL_TIME_TOTAL_CARDS', y), ('FIRST_HALF_TOTAL_CARDS', NULL), ('TEAM_CARDS', y)) m(market, n)""")
def market_readiness(spark, sf_dir):
    return status.market_readiness(_matches(spark, sf_dir))


@R.query("""
WITH c AS (SELECT o_custkey AS unit, CASE WHEN o_orderkey % 4 = 0 THEN 'base_model' ELSE 'other' END AS check_name, CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 0 THEN 'PARTIAL' ELSE 'READY' END AS status FROM orders)
SELECT unit, CASE WHEN count(*) = 10 AND count(*) FILTER (status = 'READY') = 10 THEN 'READY' WHEN count(*) FILTER (status = 'ERROR') > 0 THEN 'ERROR'
  WHEN count(*) FILTER (status = 'READY' AND check_name = 'base_model') > 0 THEN 'PARTIAL' ELSE 'ACTION_REQUIRED' END AS state FROM c GROUP BY 1""")
def overall_readiness(spark, sf_dir):
    k = F.col("o_orderkey")
    checks = frame(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.when(k % 4 == 0, "base_model").otherwise("other").alias("check"), F.when(k % 17 == 0, "ERROR").when(k % 3 == 0, "PARTIAL").otherwise("READY").alias("status"))
    return status.overall_readiness(checks, ["unit"])


@R.query("""
WITH h AS (SELECT home AS team, kick FROM matches WHERE finished UNION ALL SELECT away, kick FROM matches WHERE finished)
SELECT m.id, CASE WHEN competition NOT IN (1, 2, 3, 4) THEN 'UNSUPPORTED' WHEN home % 7 = 0 OR away % 7 = 0 THEN 'UNRESOLVED'
  WHEN (SELECT count(*) FROM h WHERE h.team = m.home AND h.kick < m.kick) < 5 OR (SELECT count(*) FROM h WHERE h.team = m.away AND h.kick < m.kick) < 5 THEN 'MISSING_INPUT'
  WHEN id % 2 = 0 THEN 'READY' ELSE 'SUPPORTED' END AS state FROM matches m""")
def coverage_state(spark, sf_dir):
    m = _matches(spark, sf_dir)
    teams = m.select(F.explode(F.array("home", "away")).alias("team")).distinct().filter("team % 7 <> 0")
    return status.model_coverage(m, m.filter("competition IN (1, 2, 3, 4)"), teams, m.filter("id % 2 = 0"))


@R.query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderstatus <> 'P', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END ASC NULLS FIRST, o_orderkey LIMIT 256")
def work_queue(spark, sf_dir):
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("later"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("checked"))
    return status.work_queue(o, F.col("later"), "checked", "id").select("id")


@R.query("SELECT * FROM (SELECT c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def clamped_page(spark, sf_dir):
    """A page of more rows than a page may have."""
    rows = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return status.page(rows, [F.desc("balance"), "id"], 5000)


NAMED = """s AS (SELECT s_suppkey AS id, s_nationkey AS block, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')) AS name FROM supplier),
t AS (SELECT c_custkey AS id, c_nationkey AS block, replace(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), 'customer', 'supplier') AS name FROM customer),
p AS (SELECT s.id AS source_id, t.id AS target_id, round(1 - levenshtein(s.name, t.name) / CAST(greatest(length(s.name), length(t.name)) AS DOUBLE), 8) AS score FROM s JOIN t USING (block)),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM p)"""


def _choices(spark, sf_dir):
    s, c = frame(spark, sf_dir, "supplier"), frame(spark, sf_dir, "customer")
    sources = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"))
    targets = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")).alias("name"))
    return status.choices(sources, targets, "block")


@R.query(f"WITH {NAMED} SELECT source_id, target_id, score, rank FROM c WHERE rank <= 5")
def name_choices(spark, sf_dir):
    return _choices(spark, sf_dir)


@R.query(f"""
WITH {NAMED} SELECT a.source_id, a.target_id, a.score FROM c a LEFT JOIN c b ON b.source_id = a.source_id AND b.rank = 2 WHERE a.rank = 1 AND a.score >= 0.92 AND (b.score IS NULL OR a.score - b.score >= 0.05)""")
def safe_choice(spark, sf_dir):
    return status.safe_choices(_choices(spark, sf_dir))


@R.query("""
SELECT event_id AS event, CASE WHEN user_id % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS side, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) WHEN user_id % 3 = 0 AND user_id % 7 = 1 THEN CAST(1000 + user_id % 7 AS VARCHAR)
  WHEN user_id % 7 = 2 THEN '2002' WHEN user_id % 3 = 1 AND user_id % 7 = 3 THEN '3003' WHEN event_id % 11 = 0 THEN CAST(4000 + event_id AS VARCHAR) ELSE 'competition:' || (user_id % 3) || ':name:team ' || (user_id % 7) END AS team,
  CASE WHEN event_id % 5 = 0 THEN 'PROVIDER_EVENT_SLOT' WHEN user_id % 3 = 0 AND user_id % 7 = 1 THEN 'SCOPED_ALIAS' WHEN user_id % 7 = 2 THEN 'PROVIDER_MAPPING' WHEN user_id % 3 = 1 AND user_id % 7 = 3 THEN 'EXACT'
  WHEN event_id % 11 = 0 THEN 'SAFE_SIMILAR' ELSE 'NEW' END AS source FROM events""")
def identity_ladder(spark, sf_dir):
    """Teams of events by the first rung that knows them."""
    e = frame(spark, sf_dir, "events").select(
        F.col("event_id").alias("event"), F.when(F.col("user_id") % 2 == 0, "HOME").otherwise("AWAY").alias("side"), (F.col("user_id") % 3).alias("competition"), F.concat(F.lit("Team "), F.col("user_id") % 7, F.lit(" FC")).alias("name")
    )
    slots = e.filter("event % 5 = 0").select("event", "side", F.col("event").alias("team"))
    fuzzy = e.filter("event % 11 = 0").select("event", "side", (F.col("event") + 4000).alias("team"))
    aliases = spark.createDataFrame([(0, "team 1", 1001)], "competition long, key string, team long")
    mappings = spark.createDataFrame([("Team 2 FC", 2002)], "name string, team long")
    exact = spark.createDataFrame([(1, "Team 3 FC", 3003)], "competition long, name string, team long")
    return status.identity(e, slots, aliases, mappings, exact, fuzzy)


@R.query("SELECT id FROM matches WHERE NOT finished AND kick > TIMESTAMP '1996-01-01' AND competition < 5 AND id % 4 <> 0")
def resolution_enqueue(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumn("status", F.when(F.col("finished"), "finished").otherwise("scheduled"))
    return status.enqueue(m, m.filter("id % 4 = 0"), m.filter("competition < 5"), F.lit("1996-01-01").cast("timestamp_ntz")).select("id")


QUEUED = """q AS (SELECT event_id AS id, ['NEW', 'AUTO_RESOLVING', 'RETRY_LATER', 'RESOLVED', 'AMBIGUOUS', 'MANUAL_REVIEW'][event_id % 6 + 1] AS state, event_id % 9 AS attempts,
  CASE WHEN event_id % 6 IN (2, 5) AND event_id % 4 <> 0 THEN ts END AS retry_at, CASE WHEN event_id % 6 = 1 THEN ts END AS leased_at FROM events),
w AS (SELECT *, CASE WHEN state <> 'AUTO_RESOLVING' THEN retry_at END AS again FROM q
  WHERE state IN ('NEW', 'RETRY_LATER', 'AMBIGUOUS', 'MANUAL_REVIEW') OR (state = 'AUTO_RESOLVING' AND leased_at < TIMESTAMP '2024-01-14 23:50:00')),
b AS (SELECT w.id, w.attempts + 1 AS attempts, m.kick FROM w JOIN (SELECT event_id AS id, TIMESTAMP '2024-01-10' + (event_id % 300) * interval '1' hour AS kick, event_id % 5 <> 0 AS scheduled FROM events) m
  ON m.id = w.id WHERE (again IS NULL OR again <= TIMESTAMP '2024-01-15') AND scheduled AND m.kick > TIMESTAMP '2024-01-15' ORDER BY m.kick, w.id LIMIT 128)"""


def _next_batch(spark, sf_dir):
    k, now = F.col("event_id"), F.lit("2024-01-15").cast("timestamp_ntz")
    events = frame(spark, sf_dir, "events")
    states = F.array(*[F.lit(s) for s in ("NEW", "AUTO_RESOLVING", "RETRY_LATER", "RESOLVED", "AMBIGUOUS", "MANUAL_REVIEW")])
    queue = events.select(
        k.alias("id"), F.element_at(states, (k % 6 + 1).cast("int")).alias("state"), (k % 9).alias("attempts"),
        F.when((k % 6).isin(2, 5) & (k % 4 != 0), F.col("ts")).alias("retry_at"), F.when(k % 6 == 1, F.col("ts")).alias("leased_at"),
    )
    kick = F.expr("timestamp_ntz'2024-01-10 00:00:00' + (event_id % 300) * interval '1' hour")
    matches = events.select(k.alias("id"), kick.alias("kick"), F.when(k % 5 != 0, "scheduled").otherwise("finished").alias("status"))
    return status.retry_queue(queue, matches, now), now


@R.query(f"WITH {QUEUED} SELECT id, 'AUTO_RESOLVING' AS state, attempts FROM b")
def retry_queue(spark, sf_dir):
    return _next_batch(spark, sf_dir)[0].select("id", "state", "attempts")


@R.query(f"""
WITH {QUEUED} SELECT id, CASE id % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'MANUAL_REVIEW' ELSE 'RETRY_LATER' END AS state, attempts,
  CASE id % 3 WHEN 1 THEN TIMESTAMP '2024-01-16' WHEN 2 THEN TIMESTAMP '2024-01-15 00:05:00' END AS retry_at FROM b""")
def resolution_results(spark, sf_dir):
    """The batch after its tries."""
    batch, now = _next_batch(spark, sf_dir)
    results = batch.select("id", F.when(F.col("id") % 3 == 0, "RESOLVED").when(F.col("id") % 3 == 1, "MANUAL_REVIEW").alias("outcome"))
    return status.tried(batch, results, now).select("id", "state", "attempts", "retry_at")


# -- publication -------------------------------------------------------------------------------------------------------

RUN_ROWS = """u AS (SELECT event_id AS run_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN 'LINEUP_AWARE' ELSE 'BASE' END AS context, CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  event_id % 4 <> 0 AS populated, event_id % 2 = 0 AS valid_lineup, event_id - 1 AS parent, CASE WHEN event_id % 5 = 0 THEN 'REPLAY' ELSE 'LIVE' END AS purpose, ts AS generated_at FROM events),
h AS (SELECT day, max(run_id) AS run_id FROM u GROUP BY 1),
s AS (SELECT h.day, CASE WHEN p.populated AND (p.context = 'BASE' OR p.valid_lineup) THEN p.run_id ELSE coalesce(
    (SELECT run_id FROM u b WHERE b.day = h.day AND b.context = 'BASE' AND b.status = 'COMPLETED' AND b.populated AND (b.run_id = p.parent OR b.purpose = 'LIVE') ORDER BY b.run_id = p.parent DESC, b.generated_at DESC, b.run_id DESC LIMIT 1),
    CASE WHEN p.context = 'BASE' THEN p.run_id END) END AS run_id FROM h JOIN u p ON p.run_id = h.run_id AND p.status = 'COMPLETED'),
z AS (SELECT * FROM s WHERE run_id IS NOT NULL)"""


def _published(spark, sf_dir):
    k = F.col("event_id")
    runs = frame(spark, sf_dir, "events").select(
        k.alias("run_id"), F.to_date("ts").alias("day"), F.when(k % 3 == 0, "LINEUP_AWARE").otherwise("BASE").alias("context"), F.when(k % 7 == 0, "FAILED").otherwise("COMPLETED").alias("status"), (k % 4 != 0).alias("populated"),
        (k % 2 == 0).alias("valid_lineup"), (k - 1).alias("parent"), F.when(k % 5 == 0, "REPLAY").otherwise("LIVE").alias("purpose"), F.col("ts").alias("generated_at"),
    )
    return runs, publication.selected_runs(runs.groupBy("day").agg(F.max("run_id").alias("run_id")), runs)


@R.query(f"WITH {RUN_ROWS} SELECT day, run_id FROM z")
def selected_run(spark, sf_dir):
    return _published(spark, sf_dir)[1]


@R.query(f"""
WITH {RUN_ROWS}, b AS (SELECT z.day, z.run_id AS base, u.generated_at FROM z JOIN u USING (day, run_id) WHERE status = 'COMPLETED'),
o AS (SELECT u.day, arg_max(u.run_id, u.run_id) AS overlay FROM u LEFT JOIN b ON b.day = u.day WHERE u.run_id % 11 = 0 AND u.status = 'COMPLETED' AND (b.base IS NULL OR u.generated_at >= b.generated_at) GROUP BY 1),
d AS (SELECT coalesce(b.day, o.day) AS day, coalesce(b.base, o.overlay) AS base, o.overlay FROM b FULL JOIN o ON o.day = b.day)
SELECT day, category, CASE WHEN category = 'BTTS_YES' THEN coalesce(overlay, base) ELSE base END AS run_id FROM d, (VALUES ('CORNERS'), ('OVER_25'), ('OVER_35'), ('BTTS_YES'), ('HIGH_CONFIDENCE'), ('SURPRISE'), ('COMPOUND')) c(category)""")
def publication_manifest(spark, sf_dir):
    runs, selected = _published(spark, sf_dir)
    overlays = runs.filter("run_id % 11 = 0").select("day", "run_id", F.col("run_id").alias("id"))
    return publication.manifest(selected, overlays, runs)


AUDIT = """f AS (SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS resolved, o_orderkey % 11 <> 0 AS kickoff_known, o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 9 <> 0 AS prediction_ready,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS p_yes, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1 - CAST(o_orderkey % 100 AS DOUBLE) / 100 + CASE WHEN o_orderkey % 17 = 0 THEN 0.1 ELSE 0 END END AS p_no,
  o_orderkey % 3 = 0 AS calibrated, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 1.0 ELSE 1.5 END AS odd_yes, TIMESTAMP '2024-01-01' - (o_orderkey % 30) * interval '1' hour AS captured_yes,
  CASE WHEN o_orderkey % 5 = 0 THEN 'INSUFFICIENT_HISTORY' END AS rejection FROM orders),
a AS (SELECT *, CASE WHEN NOT prediction_ready AND NOT resolved THEN 'RESOLUTION_FAILED' WHEN NOT prediction_ready AND NOT kickoff_known THEN 'KICKOFF_UNKNOWN' WHEN NOT prediction_ready THEN 'MODEL_INPUT_MISSING'
  WHEN p_yes IS NULL THEN 'PROBABILITY_MISSING' WHEN abs(p_yes + p_no - 1) > 1e-6 THEN 'PAIR_SUM_INVALID' WHEN odd_yes IS NULL THEN 'ODDS_MISSING' WHEN odd_yes <= 1 THEN 'ODDS_INVALID'
  WHEN captured_yes < TIMESTAMP '2024-01-01' - interval '24' hour THEN 'ODDS_STALE' ELSE rejection END AS reason FROM f)"""


@R.query(f"""
WITH {AUDIT}, s AS (SELECT 'stage' AS kind, unnest(['fixtures', CASE WHEN resolved THEN 'resolved' END, CASE WHEN resolved AND kickoff_known THEN 'kickoff_known' END, CASE WHEN prediction_ready THEN 'prediction_ready' END,
  CASE WHEN prediction_ready AND p_yes IS NOT NULL THEN 'btts_probability' END, CASE WHEN prediction_ready AND p_yes IS NOT NULL AND calibrated THEN 'calibrated_btts_probability' END,
  CASE WHEN prediction_ready AND p_yes IS NOT NULL AND NOT calibrated THEN 'public_btts_fallback' END, CASE WHEN prediction_ready AND p_yes IS NOT NULL AND abs(p_yes + p_no - 1) > 1e-6 THEN 'pair_sum_failures' END,
  CASE WHEN odd_yes IS NOT NULL THEN 'current_matches_with_yes_odds' END, CASE WHEN prediction_ready AND p_yes IS NOT NULL AND odd_yes IS NOT NULL THEN 'btts_odds' END,
  CASE WHEN prediction_ready AND p_yes IS NOT NULL AND odd_yes > 1 THEN 'valid_yes_mapping' END, CASE WHEN reason IS NULL OR reason = rejection THEN 'invalid_input_survivors' END, CASE WHEN reason IS NULL THEN 'ranking_pool' END]) AS name FROM a
  UNION ALL SELECT 'exclusion', reason FROM a WHERE reason IS NOT NULL)
SELECT kind, name, count(*) AS n FROM s WHERE name IS NOT NULL GROUP BY 1, 2""")
def btts_audit(spark, sf_dir):
    """How many fixtures reach each of thirteen stages, and the one reason that stops each of the others."""
    k = F.col("o_orderkey")
    p = (k % 100).cast("double") / 100
    rows = frame(spark, sf_dir, "orders").select(
        (k % 13 != 0).alias("resolved"), (k % 11 != 0).alias("kickoff_known"), ((k % 13 != 0) & (k % 11 != 0) & (k % 9 != 0)).alias("prediction_ready"), F.when(k % 8 != 0, p).alias("p_yes"),
        F.when(k % 8 != 0, 1 - p + F.when(k % 17 == 0, 0.1).otherwise(0.0)).alias("p_no"), (k % 3 == 0).alias("calibrated"), F.when(k % 7 == 0, None).when(k % 19 == 0, 1.0).otherwise(1.5).alias("odd_yes"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' - (o_orderkey % 30) * interval '1' hour").alias("captured_yes"), F.when(k % 5 == 0, "INSUFFICIENT_HISTORY").alias("rejection"),
    )
    return publication.audit_counts(rows, F.lit("2024-01-01").cast("timestamp_ntz"))


@R.query("""
WITH c AS (SELECT DISTINCT coupon, kind FROM legs), s AS (SELECT DISTINCT coupon FROM legs WHERE match_id % 10 < 3) SELECT coupon, kind FROM c WHERE kind = 'DAILY_COMPOUND' OR coupon NOT IN (SELECT coupon FROM s)""")
def unfrozen_coupons(spark, sf_dir):
    legs = frame(spark, sf_dir, "legs").withColumn("kickoff", F.expr("timestamp_ntz '2024-01-01 00:00:00' + int(match_id % 10) * interval '1' day"))
    return publication.frozen(legs.select("coupon", "kind").distinct(), legs, F.lit("2024-01-03").cast("timestamp_ntz"))


@R.query("""
SELECT CAST(o_orderdate AS DATE) AS day, 'k' || (o_custkey % 3) AS kind, o_orderkey AS coupon FROM orders WHERE o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_custkey % 3 ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""")
def published_coupons(spark, sf_dir):
    o = frame(spark, sf_dir, "orders")
    rows = o.select(F.to_date("o_orderdate").alias("day"), F.concat(F.lit("k"), F.col("o_custkey") % 3).alias("kind"), F.col("o_orderkey").alias("coupon"), F.col("o_totalprice").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("FINALIZED").alias("status"))
    return publication.published_coupons(rows).select("day", "kind", "coupon")


@R.query("""
WITH b AS (SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN 'OVER_25' ELSE 'SURPRISE' END AS category, CAST(id % 100 AS DOUBLE) / 100 AS p FROM predictions)
SELECT id, category, CASE WHEN id % 5 <> 0 THEN p END AS base_p, CASE WHEN id % 7 <> 0 THEN CASE WHEN id % 3 = 0 THEN p ELSE p / 2 END END AS revised_p,
  round(100 * (CASE WHEN id % 7 <> 0 THEN CASE WHEN id % 3 = 0 THEN p ELSE p / 2 END END - CASE WHEN id % 5 <> 0 THEN p END), 6) AS points,
  CASE WHEN id % 5 = 0 THEN 'NEWLY_QUALIFIED' WHEN id % 7 = 0 THEN 'NO_LONGER_QUALIFIED' WHEN id % 3 = 0 OR p = 0 THEN 'UNCHANGED' ELSE 'STILL_QUALIFIED' END AS change FROM b WHERE id % 35 <> 0""")
def lineup_impact(spark, sf_dir):
    """Candidates before and after a lineup: who is new, gone, unchanged."""
    k = F.col("id")
    rows = frame(spark, sf_dir, "predictions").select(k, F.when(k % 2 == 0, "OVER_25").otherwise("SURPRISE").alias("category"), ((k % 100).cast("double") / 100).alias("p")).distinct()
    revised = rows.filter("id % 7 <> 0").withColumn("p", F.when(k % 3 == 0, F.col("p")).otherwise(F.col("p") / 2))
    return publication.lineup_impact(rows.filter("id % 5 <> 0"), revised)


@R.query("""
WITH q AS (SELECT CAST(captured AS DATE) AS day, 'quotes:' || count(*) || ':' || max(id) AS f FROM quotes GROUP BY 1), p AS (SELECT CAST(captured AS DATE) AS day, 'popularity:' || count(*) || ':' || max(id) AS f FROM popularity WHERE metric = 'RANK' GROUP BY 1)
SELECT coalesce(q.day, p.day) AS day, sha256(coalesce(q.f, 'quotes') || '|' || coalesce(p.f, 'popularity')) AS fingerprint FROM q FULL JOIN p ON q.day = p.day""")
def change_fingerprint(spark, sf_dir):
    quotes = frame(spark, sf_dir, "quotes").withColumn("day", F.to_date("captured"))
    popularity = frame(spark, sf_dir, "popularity").filter("metric = 'RANK'").withColumn("day", F.to_date("captured"))
    return publication.change_fingerprint({"quotes": (quotes, "id"), "popularity": (popularity, "id")}, "day")


@R.query("""
WITH h AS (SELECT competition, max(id) % 3 AS epoch FROM matches GROUP BY 1), c AS (SELECT competition, min(id) % 3 AS epoch FROM matches WHERE competition <> 4 GROUP BY 1)
SELECT h.competition, h.epoch FROM h LEFT JOIN c USING (competition) WHERE h.epoch IS DISTINCT FROM c.epoch""")
def restated_history(spark, sf_dir):
    m = _matches(spark, sf_dir)
    history = m.groupBy("competition").agg((F.max("id") % 3).alias("epoch"))
    computed = m.filter("competition <> 4").groupBy("competition").agg((F.min("id") % 3).alias("epoch"))
    return publication.restated(computed, history, ["competition"])


@R.query("""
SELECT event_id AS id, json_extract_string(props, '$.k') AS k, 'true' AS published, CAST(NULL AS VARCHAR) AS gone, true AS valid FROM events""")
def json_metadata(spark, sf_dir):
    """Metadata with a key set and one removed, and whether it is JSON."""
    e = frame(spark, sf_dir, "events").withColumn("props", F.regexp_replace("props", r"\}\s*$", ', "gone": "1"}'))
    out = publication.with_metadata(e, "props", {"published": F.lit(True)}, ["gone"])
    get = lambda k: F.get_json_object("props", f"$.{k}").alias(k)
    return out.select(F.col("event_id").alias("id"), get("k"), get("published"), get("gone"), publication.is_json(F.col("props")).alias("valid"))


@R.query("""
SELECT key, '[' || string_agg('["' || id || '","' || selection || '"]', ',' ORDER BY id) || ']' AS body FROM quotes GROUP BY 1""")
def json_rows(spark, sf_dir):
    return publication.json_rows(frame(spark, sf_dir, "quotes"), ["key"], ["id", "selection"], ["id"])


@R.query("""
SELECT id, CAST(kick + interval '25' hour AS DATE) AS fixed, CAST(kick + interval '25' hour AS DATE) AS local, coalesce(CASE WHEN id % 2 = 0 THEN DATE '2000-01-01' END, CAST(kick AS DATE)) AS business,
  CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN id % 3 = 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS epoch FROM matches""")
def business_dates(spark, sf_dir):
    """Dates at a fixed offset and by the zone's rules, local dates first, and epochs in seconds or milliseconds."""
    m = _matches(spark, sf_dir)
    k, late = F.col("id"), F.expr("kick + interval '22' hour")
    epoch = F.when(k % 3 == 0, F.lit(1704164645)).when(k % 3 == 1, F.lit(1704164645000)).otherwise(F.lit(9_999_999_999))
    return m.select(
        "id", status.fixed_offset_date(late).alias("fixed"), E.local_date(late).alias("local"), status.business_date(F.when(k % 2 == 0, F.lit("2000-01-01").cast("date")), F.col("kick")).alias("business"),
        E.epoch_to_timestamp(epoch).cast("timestamp_ntz").alias("epoch"),
    )


@R.query("""
SELECT id, CASE WHEN id % 7 IN (1, 3) THEN 'DAILY_RANKED' WHEN id % 7 = 4 THEN 'HIGH_CONFIDENCE' WHEN id % 7 = 6 THEN 'KATLAMA_ELIGIBLE' ELSE 'STRICT_QUALIFIED' END AS status FROM matches""")
def selection_status(spark, sf_dir):
    category = F.element_at(F.array(*[F.lit(c) for c in ranking.CATEGORIES]), (F.col("id") % 7 + 1).cast("int"))
    return _matches(spark, sf_dir).select("id", E.selection_status(category).alias("status"))


@R.query("""
WITH b AS (SELECT match_id, leg, 'BASE' AS context FROM observations WHERE context = 'BASE'), l AS (SELECT match_id, leg, 'LINEUP' AS context FROM observations WHERE context = 'LINEUP')
SELECT context, count(*) AS n, count(*) FILTER (match_id NOT IN (SELECT match_id FROM l)) AS without_lineup FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY 1""")
def concatenated_contexts(spark, sf_dir):
    """Base and lineup observations one after the other, and base matches that no lineup covers."""
    o = frame(spark, sf_dir, "observations").select("match_id", "leg", "context")
    base, lineup = o.filter("context = 'BASE'"), o.filter("context = 'LINEUP'")
    alone = base.join(lineup.select("match_id").distinct(), "match_id", "left_anti").withColumn("alone", F.lit(1))
    rows = base.unionByName(lineup).groupBy("context").agg(F.count("*").alias("n"))
    return rows.join(alone.groupBy("context").agg(F.count("*").alias("without_lineup")), "context", "left").fillna(0, ["without_lineup"])
