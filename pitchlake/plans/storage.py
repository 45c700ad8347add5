"""Queries over sources, upserts, keys and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.fixtures import frame
from pitchlake.functions import expressions as E
from pitchlake.operators import status
from pitchlake.plans.registry import Registry
from pitchlake.sources import bulletin_json, bulletin_tree, results_csv, upserts

R = Registry()


@R.query("""
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS h,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS a FROM orders WHERE o_orderkey % 10 <> 3)
SELECT CASE WHEN h = 'x' THEN 'BAD_FTHG' WHEN (h = '') <> (a = '') THEN 'HALF_PAIR_FTHG_FTAG' ELSE 'OK' END AS issue,
  count(*) AS n, CAST(sum(try_cast(h AS INTEGER)) AS BIGINT) AS goals FROM r GROUP BY 1""")
def csv_validate(spark, sf_dir):
    """Result rows written and parsed as CSV text: issues by kind, and the goals of what could be read."""
    k = F.col("o_orderkey")
    home = F.when(k % 11 == 0, "x").when(k % 13 == 0, "").otherwise((k % 5).cast("string"))
    away = F.when(k % 17 == 0, "").otherwise((k % 4).cast("string"))
    league = F.when(k % 10 == 3, "D9").otherwise("e0")
    line = F.concat_ws(",", league, F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("19:45"), F.concat(F.lit(" Team"), k % 20), F.concat(F.lit("Side"), k % 19), home, away)
    schema = "Div string, Date string, Time string, HomeTeam string, AwayTeam string, FTHG string, FTAG string"
    rows = frame(spark, sf_dir, "orders").select(F.from_csv(line, schema).alias("r")).select("r.*")
    good = results_csv.validate(rows, "E0")
    return good.groupBy(F.coalesce("issue", F.lit("OK")).alias("issue")).agg(F.count("*").alias("n"), F.sum("FTHG").alias("goals"))


@R.query("""
WITH o AS (SELECT id, CAST(id % 2 AS INTEGER) AS known, kick, CASE WHEN id % 4 = 0 THEN 'finished' ELSE 'scheduled' END AS status,
  CASE WHEN id % 4 = 0 THEN hg END AS hg, CASE WHEN id % 4 = 0 THEN ag END AS ag FROM matches WHERE id % 5 <> 0),
n AS (SELECT id, CAST(id % 3 = 0 AS INTEGER) AS known, kick + interval '1' day AS kick, CASE WHEN finished THEN 'finished' ELSE 'postponed' END AS status,
  CASE WHEN finished THEN hg END AS hg, CASE WHEN finished THEN ag END AS ag FROM matches WHERE id % 5 <> 1)
SELECT coalesce(n.id, o.id) AS id, greatest(o.known, n.known) AS known,
  CASE WHEN n.known IS NOT NULL AND n.known >= coalesce(o.known, 0) THEN n.kick ELSE o.kick END AS kick,
  CASE WHEN o.status = 'finished' OR n.status = 'finished' THEN 'finished' ELSE coalesce(o.status, n.status) END AS status,
  coalesce(n.hg, o.hg) AS hg, coalesce(n.ag, o.ag) AS ag FROM o FULL JOIN n ON o.id = n.id""")
def upsert_match(spark, sf_dir):
    m = frame(spark, sf_dir, "matches")
    score = lambda test: [F.when(test, F.col(c)).alias(c) for c in ("hg", "ag")]
    k = F.col("id")
    old = m.filter(k % 5 != 0).select("id", (k % 2).cast("int").alias("known"), "kick", F.when(k % 4 == 0, "finished").otherwise("scheduled").alias("status"), *score(k % 4 == 0))
    new = m.filter(k % 5 != 1).select(
        "id", (k % 3 == 0).cast("int").alias("known"), (F.col("kick") + F.expr("interval '1' day")).alias("kick"),
        F.when(F.col("finished"), "finished").otherwise("postponed").alias("status"), *score(F.col("finished")),
    )
    return upserts.upsert_matches(old, new)


@R.query("SELECT id, CASE WHEN id % 3 = 1 THEN coalesce(hc, 0) ELSE hc END AS hc, CASE WHEN id % 2 = 1 THEN 99 ELSE ac END AS ac FROM matches")
def upsert_statistics(spark, sf_dir):
    m = frame(spark, sf_dir, "matches")
    k = F.col("id")
    new = m.filter((k % 2 == 1) | (k % 3 == 1)).select("id", F.when(k % 3 == 1, F.coalesce("hc", F.lit(0))).alias("hc"), F.when(k % 2 == 1, F.lit(99).cast("long")).alias("ac"))
    return upserts.upsert_statistics(m.select("id", "hc", "ac"), new, ["id"], ["hc", "ac"])


@R.query("SELECT id, key FROM quotes WHERE id % 3 = 0 AND NOT id % 2 = 0")
def insert_or_ignore(spark, sf_dir):
    q = frame(spark, sf_dir, "quotes").select("id", "key")
    new = q.filter("id % 3 = 0")
    return upserts.insert_or_ignore(q.filter("id % 2 = 0"), new.union(new), ["id"])


@R.query("""
SELECT l_orderkey AS event_id, CAST(l_linenumber AS BIGINT) AS market_id, CAST(l_linenumber AS DOUBLE) + 0.5 AS line, o AS outcome,
  CAST(1 AS DOUBLE) + l_quantity AS odd FROM lineitem, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) x(o)""")
def json_explode_markets(spark, sf_dir):
    """Bulletin documents built from line items and taken apart again."""
    rows = frame(spark, sf_dir, "lineitem")
    odd = F.lit(1.0) + F.col("l_quantity")
    outcomes = F.array(*[F.struct(F.lit(n).cast("long").alias("no"), F.lit("x").alias("n"), odd.alias("odd")) for n in (1, 2)])
    bad = F.struct(F.lit(3).cast("long").alias("no"), F.lit("x").alias("n"), F.lit(-1.0).alias("odd"))
    market = F.struct(F.col("l_linenumber").cast("long").alias("i"), F.concat(F.col("l_linenumber"), F.lit(".5")).alias("sov"), F.concat(outcomes, F.array(bad)).alias("o"))
    event = F.struct(F.col("l_orderkey").alias("i"), F.lit("A").alias("hn"), F.lit("B").alias("an"), F.lit(1700000000000).alias("d"), F.array(market).alias("m"))
    nameless = F.struct(F.col("l_orderkey").alias("i"), F.lit(None).cast("string").alias("hn"), F.lit(None).cast("string").alias("an"), F.lit(1).cast("long").alias("d"), F.array(market).alias("m"))
    body = F.to_json(F.struct(F.array(event, nameless).alias("events")))
    return bulletin_json.prices(rows.select(body.alias("body"))).select("event_id", "market_id", "line", "outcome", "odd")


#: Events as JSON objects, some with a field of a wrong type or without one, at three depths of fifty documents.
NODE = """'{"i":' || event_id || CASE WHEN event_id % 11 = 0 THEN ',"hn":5' WHEN event_id % 12 = 0 THEN ',"hn":" "' ELSE ',"hn":"H' || user_id || '"' END || ',"an":"A' || user_id || '"'
 || CASE WHEN event_id % 10 = 3 THEN ',"sid":2' ELSE '' END || ',"ci":' || (user_id % 9) || CASE WHEN event_id % 19 = 0 THEN '' ELSE ',"d":' || (1700000000 + event_id) END
 || CASE WHEN event_id % 13 = 0 THEN ',"m":null' WHEN event_id % 7 = 0 THEN '' ELSE ',"m":[{"i":' || (event_id * 10) || ',"st":101,"sov":"' || (event_id % 4) || '.5","o":[{"no":1,"n":"Over","odd":'
 || CASE WHEN event_id % 17 = 0 THEN '"1.5"' WHEN event_id % 16 = 0 THEN '-1' ELSE '1.' || (event_id % 90 + 10) END || '},{"no":2,"n":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"Under"' END || ',"odd":2.25}]}]' END || '}'"""
STATUS = """CASE WHEN event_id % 11 = 0 THEN 'MALFORMED:hn' WHEN event_id % 13 = 0 THEN 'MALFORMED:m' WHEN event_id % 7 <> 0 AND event_id % 17 = 0 THEN 'MALFORMED:odd'
 WHEN event_id % 10 = 3 THEN 'NOT_FOOTBALL' WHEN event_id % 12 = 0 THEN 'MISSING:hn' WHEN event_id % 19 = 0 THEN 'MISSING:d' END"""


def _bulletins(spark, sf_dir):
    node = frame(spark, sf_dir, "events").selectExpr("user_id % 50 AS doc", "event_id % 3 AS depth", f"{NODE} AS node")
    part = lambda k: F.array_join(F.collect_list(F.when(F.col("depth") == k, F.col("node"))), ",")
    deep = F.format_string('{"events":[%s],"x":{"y":[{"z":{"list":[%s]}}]},"competitions":[{"i":1,"n":"one","hn":"no event"},{"id":%d,"name":"two"},{"i":"3","n":"three"}],"w":[[%s]]}', part(0), part(1), F.col("doc") % 4 + 4, part(2))
    some = node.groupBy("doc").agg(deep.alias("body"))
    rest = spark.range(2).select((F.col("id") + 50).alias("doc"), F.when(F.col("id") == 0, '{"a":[').otherwise('{"a":[1,{"b":null}]}').alias("body"))
    return bulletin_tree.documents(some.unionByName(rest), "doc", "body")


@R.query(f"""
WITH e AS (SELECT event_id, user_id % 50 AS doc, user_id % 9 AS competition, {STATUS} AS issue FROM events)
SELECT doc, CASE WHEN issue LIKE 'MALFORMED%' THEN NULL ELSE event_id END AS event_id, issue,
  CASE WHEN issue IS NOT NULL THEN 'REJECTED' WHEN competition IN (1, 4, 5, 6, 7) THEN 'IMPORTED' ELSE 'UNRESOLVED_COMPETITION' END AS status FROM e
UNION ALL VALUES (50, NULL, 'MALFORMED_JSON', 'REJECTED'), (51, NULL, 'NO_EVENTS', 'REJECTED')""")
def bulletin_import(spark, sf_dir):
    """Event objects at any depth of a bulletin, each with its own fate."""
    docs = _bulletins(spark, sf_dir)
    return bulletin_tree.import_status(bulletin_tree.events(docs), bulletin_tree.competitions(docs)).select("doc", "event_id", "issue", "status")


@R.query("SELECT competition, CASE competition WHEN 1 THEN 'one' ELSE 'two' END AS name FROM (SELECT DISTINCT user_id % 50 % 4 + 4 AS competition FROM events UNION SELECT 1)")
def bulletin_competitions(spark, sf_dir):
    return bulletin_tree.competitions(_bulletins(spark, sf_dir)).select("competition", "name")


@R.query(f"""
WITH e AS (SELECT *, {STATUS} AS issue FROM events),
g AS (SELECT * FROM e WHERE issue IS NULL AND user_id % 9 IN (1, 4, 5, 6, 7) AND event_id % 7 <> 0)
SELECT event_id, event_id * 10 AS market_id, CAST(event_id % 4 + 0.5 AS DOUBLE) AS line, CAST(1 AS BIGINT) AS outcome, CAST('1.' || (event_id % 90 + 10) AS DOUBLE) AS odd FROM g WHERE event_id % 16 <> 0
UNION ALL SELECT event_id, event_id * 10, CAST(event_id % 4 + 0.5 AS DOUBLE), CAST(2 AS BIGINT), CAST(2.25 AS DOUBLE) FROM g WHERE event_id % 5 <> 0""")
def bulletin_outcomes(spark, sf_dir):
    """Priced selections of the imported events of any depth."""
    docs = _bulletins(spark, sf_dir)
    imported = bulletin_tree.import_status(bulletin_tree.events(docs), bulletin_tree.competitions(docs))
    return bulletin_tree.outcomes(imported).select("event_id", "market_id", "line", "outcome", "odd")


@R.query("""
SELECT user_id AS market, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rank, event_id FROM events""")
def popularity_rank(spark, sf_dir):
    rows = frame(spark, sf_dir, "events")
    item = F.struct(F.col("event_id").alias("eventId"), F.col("user_id").alias("marketId"))
    listed = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    body = F.to_json(F.struct(F.struct(F.col("l").alias("1")).alias("data")))
    return bulletin_json.popularity(listed.select(body.alias("body"))).select(F.col("marketId").alias("market"), "rank", F.col("eventId").alias("event_id"))


@R.query("""
SELECT o_orderkey AS id, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN interval '12' hour ELSE interval '15' hour END - interval '3' hour AS kickoff,
  o_orderkey % 3 <> 0 AS known FROM orders WHERE o_orderdate >= TIMESTAMP '2017-01-01'
UNION ALL SELECT o_orderkey, NULL, o_orderkey % 3 <> 0 FROM orders WHERE o_orderdate < TIMESTAMP '2017-01-01'""")
def normalize_kickoff(spark, sf_dir):
    """Local dates and times to UTC; dates before 2017 stand for malformed ones."""
    k = F.col("o_orderkey")
    early = F.col("o_orderdate") < F.lit("2017-01-01").cast("timestamp_ntz")
    rows = frame(spark, sf_dir, "orders")
    day = F.when(early, F.lit("31-31-x")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    at, known = E.parse_kickoff(day, F.when(k % 3 != 0, "15:00"), "Europe/Istanbul")
    return rows.select(k.alias("id"), at.cast("timestamp_ntz").alias("kickoff"), known.alias("known"))


RAW = [("MATCH_RESULT", " 1 "), ("MATCH_RESULT", "X"), ("MATCH_RESULT", "Away"), ("TOTAL_GOALS", "Üst"), ("CORNERS_TOTAL", "alt"), ("BOTH_TEAMS_TO_SCORE", "KG Var"),
       ("BOTH_TEAMS_TO_SCORE", "Hayır"), ("DOUBLE_CHANCE", "1 veya 2"), ("ODD_EVEN", "Çift"), ("TOTAL_GOALS", "over"), ("GOAL_RANGE", "2-3"), ("BTTS", "yes")]


def _labels(spark, sf_dir):
    """Events with a market, a raw label and a line, by turns."""
    n = F.col("event_id") % len(RAW)
    market, raw = (F.element_at(F.array(*[F.lit(x[i]) for x in RAW]), (n + 1).cast("int")) for i in (0, 1))
    line = F.when(n.isin(3, 9), 2.5).when(n == 4, 8.5)
    return frame(spark, sf_dir, "events").select(F.col("event_id").alias("id"), market.alias("market"), raw.alias("raw"), line.alias("line"))


@R.query("""
SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' WHEN 3 THEN 'OVER' WHEN 4 THEN 'UNDER' WHEN 5 THEN 'YES' WHEN 6 THEN 'NO'
  WHEN 7 THEN 'HOME_OR_AWAY' WHEN 8 THEN 'EVEN' END AS provider, CASE event_id % 12 WHEN 2 THEN 'AWAY' WHEN 3 THEN 'OVER' WHEN 4 THEN 'UNDER' WHEN 9 THEN 'OVER' END AS canonical FROM events""")
def normalize_selection(spark, sf_dir):
    rows = _labels(spark, sf_dir)
    market, raw = F.col("market"), F.col("raw")
    return rows.select("id", E.normalize_selection(market, raw).alias("provider"), E.canonical_selection(market, raw).alias("canonical"))


@R.query("""
SELECT event_id AS id, CASE WHEN event_id % 12 IN (0, 1, 2) THEN 'MATCH_RESULT' WHEN event_id % 12 IN (3, 9) THEN 'TOTAL_GOALS' WHEN event_id % 12 = 4 THEN 'FULL_TIME_TOTAL_CORNERS'
  WHEN event_id % 12 IN (5, 6, 11) THEN 'BTTS' WHEN event_id % 12 = 7 THEN 'DOUBLE_CHANCE' WHEN event_id % 12 = 8 THEN 'ODD_EVEN' ELSE 'GOAL_RANGE' END AS market,
  CASE event_id % 12 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' WHEN 2 THEN 'AWAY' WHEN 3 THEN 'OVER' WHEN 4 THEN 'UNDER' WHEN 5 THEN 'YES' WHEN 6 THEN 'NO' WHEN 9 THEN 'OVER' WHEN 11 THEN 'YES' END AS selection,
  CASE WHEN event_id % 12 IN (0, 1, 2) THEN 'MATCH_RESULT' WHEN event_id % 12 IN (3, 9) THEN 'OVER_25' WHEN event_id % 12 IN (5, 11) THEN 'BTTS_YES' END AS category,
  CASE WHEN event_id % 12 IN (7, 8, 10) THEN 'MARKET_NOT_SUPPORTED' END AS failure FROM events""")
def canonical_tuple(spark, sf_dir):
    rows = _labels(spark, sf_dir)
    made = E.canonical_tuple(F.col("market"), F.col("raw"), F.col("line"))
    names = {"shown_market": "market", "shown_selection": "selection"}
    return rows.select("id", *[c.alias(names.get(k, k)) for k, c in made.items()])


@R.query("""
SELECT event_id AS id, CASE event_id % 110 WHEN 1 THEN 'MATCH_RESULT' WHEN 101 THEN 'TOTAL_GOALS' WHEN 89 THEN 'BOTH_TEAMS_TO_SCORE' WHEN 48 THEN 'CORNERS_TOTAL' WHEN 92 THEN 'DOUBLE_CHANCE'
  WHEN 77 THEN 'DOUBLE_CHANCE' WHEN 4 THEN 'GOAL_RANGE' WHEN 91 THEN 'ODD_EVEN' WHEN 90 THEN 'HALFTIME_FULLTIME' ELSE 'UNKNOWN' END AS market FROM events""")
def normalize_market(spark, sf_dir):
    return frame(spark, sf_dir, "events").select(F.col("event_id").alias("id"), E.normalize_market(F.col("event_id") % 110).alias("market"))


FAMILIES = ["MATCH_RESULT", "BTTS", "TOTAL_GOALS", "HOME_TEAM_TOTAL_GOALS", "AWAY_TEAM_CORNERS", "FULL_TIME_TOTAL_CORNERS", "FULL_TIME_TOTAL_CARDS", "ODD_EVEN"]


@R.query("""
WITH m AS (SELECT event_id AS id, ['MATCH_RESULT', 'BTTS', 'TOTAL_GOALS', 'HOME_TEAM_TOTAL_GOALS', 'AWAY_TEAM_CORNERS', 'FULL_TIME_TOTAL_CORNERS', 'FULL_TIME_TOTAL_CARDS', 'ODD_EVEN'][event_id % 8 + 1] AS market FROM events)
SELECT id, CASE market WHEN 'HOME_TEAM_TOTAL_GOALS' THEN 'TEAM_TOTAL_GOALS' ELSE market END AS fold,
  CASE market WHEN 'HOME_TEAM_TOTAL_GOALS' THEN 'TEAM_TOTAL_GOALS' WHEN 'AWAY_TEAM_CORNERS' THEN 'TEAM_CORNERS' WHEN 'FULL_TIME_TOTAL_CORNERS' THEN 'TOTAL_CORNERS'
    WHEN 'FULL_TIME_TOTAL_CARDS' THEN 'TOTAL_CARDS' WHEN 'ODD_EVEN' THEN 'OTHER' ELSE market END AS family,
  CASE market WHEN 'FULL_TIME_TOTAL_CORNERS' THEN 'CORNERS_SAME_MATCH' WHEN 'TOTAL_GOALS' THEN 'NESTED_TOTAL_LINE' WHEN 'BTTS' THEN 'BTTS_GOALS_CORRELATION' ELSE 'NONE' END AS correlation FROM m""")
def market_classes(spark, sf_dir):
    market = F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), (F.col("event_id") % 8 + 1).cast("int"))
    return frame(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), E.market_fold(market).alias("fold"), E.market_family(market).alias("family"), E.correlation_class(market).alias("correlation")
    )


NAMES = ["  Fenerbahçe  SK", "FC Nürnberg", "Man. Utd", "AC Milan AC", "Göztepe", "Bristol Rovers City", "FC SC", "Løkomotiv/Straße", "Ægir", "Bayern Münih"]
KEYS = ["fenerbahce", "nurnberg", "manchester united", "milan", "goztep", "bristol rovers city", "sc", "lokomotiv strasse", "aegir", "bayern munich"]
BARE = ["fenerbahce sk", "fc nurnberg", "man utd", "ac milan ac", "goztepe", "bristol", "fc sc", "lokomotiv strasse", "aegir", "bayern munih"]


@R.query("""
SELECT c_custkey AS id, ['fenerbahce', 'nurnberg', 'manchester united', 'milan', 'goztep', 'bristol rovers city', 'sc', 'lokomotiv strasse', 'aegir', 'bayern munich'][c_custkey % 10 + 1] AS team,
  ['fenerbahce sk', 'fc nurnberg', 'man utd', 'ac milan ac', 'goztepe', 'bristol', 'fc sc', 'lokomotiv strasse', 'aegir', 'bayern munih'][c_custkey % 10 + 1] AS bare,
  ['league one', 'la liga', 'premier league'][c_custkey % 3 + 1] AS competition, 'jan ter wal' AS player FROM customer""")
def name_keys(spark, sf_dir):
    """Folded names without qualifiers, team keys by alias, competition keys in two languages, and player names."""
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    name = pick(NAMES)
    return frame(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        E.team_key(name).alias("team"),
        E.strip_qualifier(E.fold_name(name)).alias("bare"),
        E.competition_key(pick(["İngiltere 1. Lig", "İspanya La Liga", "England Premier League FC"])).alias("competition"),
        E.player_key(F.lit("  Jan  Ter\tWal ")).alias("player"),
    )


@R.query("SELECT c_custkey AS id, sha256(lower(c_name) || '|' || CAST(c_nationkey AS VARCHAR) || '|' || lower(c_mktsegment)) AS key FROM customer")
def content_key(spark, sf_dir):
    rows = frame(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), E.content_key(F.concat(F.lit("  "), F.col("c_name")), F.col("c_nationkey"), F.upper("c_mktsegment")).alias("key"))


@R.query("""
SELECT id, lpad(CAST((year(kick) - CAST(month(kick) < 7 AS INTEGER)) % 100 AS VARCHAR), 2, '0') ||
  lpad(CAST((year(kick) - CAST(month(kick) < 7 AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') AS season FROM matches""")
def season_code(spark, sf_dir):
    return frame(spark, sf_dir, "matches").select("id", E.season_code(F.col("kick")).alias("season"))


@R.query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)")
def semi_supported(spark, sf_dir):
    customers = frame(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return frame(spark, sf_dir, "nation").join(customers, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_replay(spark, sf_dir):
    replayed = frame(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return frame(spark, sf_dir, "customer").join(replayed, "c_custkey", "left_anti").select("c_custkey")


@R.query("SELECT id, selection, odd FROM quotes WHERE selection <> 'view' UNION ALL SELECT id, selection, odd + 1 FROM quotes WHERE selection = 'view' AND id % 2 = 0")
def overlay_category(spark, sf_dir):
    q = frame(spark, sf_dir, "quotes").select("id", "selection", "odd")
    return upserts.overlay(q, q.filter("id % 2 = 0").withColumn("odd", F.col("odd") + 1), "selection", "view")


SEASONS = """SELECT id, competition, CAST(year(kick) AS BIGINT) AS season, CAST(kick AS DATE) AS day, CASE WHEN finished THEN 'finished' WHEN id % 7 = 0 THEN 'postponed' ELSE 'scheduled' END AS status,
 hs, as_, hst, ast, hc, ac, hy, ay, CASE WHEN id % 4 <> 0 THEN CAST(floor(hg / 2) AS BIGINT) END AS hth, CASE WHEN id % 8 <> 1 THEN CAST(floor(ag / 2) AS BIGINT) END AS hta FROM matches"""
IMPORTS = "SELECT user_id % 10 AS competition, 1992 + event_id % 8 AS season, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS completed_at FROM events WHERE user_id % 10 <> 9"


@R.query(f"""
WITH s AS ({SEASONS}), i AS ({IMPORTS})
SELECT s.competition, s.season, count(*) AS matches, count(*) FILTER (status = 'finished') AS finished, count(*) FILTER (status = 'scheduled') AS scheduled,
  count(*) FILTER (hs IS NOT NULL AND as_ IS NOT NULL) AS with_shots, count(*) FILTER (hst IS NOT NULL AND ast IS NOT NULL) AS with_shots_on_target, count(*) FILTER (hc IS NOT NULL AND ac IS NOT NULL) AS with_corners,
  count(*) FILTER (hy IS NOT NULL AND ay IS NOT NULL) AS with_cards, count(*) FILTER (hth IS NOT NULL AND hta IS NOT NULL) AS with_halftime, min(day) AS earliest, max(day) AS latest,
  (SELECT max(completed_at) FROM i WHERE i.status = 'completed' AND i.competition = s.competition AND i.season = s.season) AS last_import FROM s GROUP BY s.competition, s.season""")
def coverage_summary(spark, sf_dir):
    seasons = spark.sql(SEASONS.replace("FROM matches", "FROM {m}"), m=frame(spark, sf_dir, "matches"))
    imports = spark.sql(IMPORTS.replace("FROM events", "FROM {e}"), e=frame(spark, sf_dir, "events"))
    return status.coverage_by_season(seasons, imports)


@R.query("SELECT series, count(*) FILTER (state = 'WON') AS won, count(*) FILTER (state = 'LOST') AS lost, count(*) FILTER (state = 'VOID') AS void FROM outcomes GROUP BY 1")
def conditional_sums(spark, sf_dir):
    rows = frame(spark, sf_dir, "outcomes")
    return rows.groupBy("series").agg(*[F.sum((F.col("state") == s).cast("long")).alias(s.lower()) for s in ("WON", "LOST", "VOID")])


@R.query("SELECT kick, home, count(*) AS n FROM matches GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates_having(spark, sf_dir):
    return frame(spark, sf_dir, "matches").groupBy("kick", "home").agg(F.count("*").alias("n")).filter("n > 1")


@R.query("""
WITH f AS (SELECT CASE WHEN NOT finished THEN 'NOT_FINISHED' WHEN hc IS NULL THEN 'NO_STATISTICS' WHEN hg + ag = 0 THEN 'NO_GOALS' ELSE 'READY' END AS stage FROM matches)
SELECT stage, count(*) AS n FROM f GROUP BY 1""")
def funnel(spark, sf_dir):
    """Each row is counted at the first stage that stops it."""
    stage = F.when(~F.col("finished"), "NOT_FINISHED").when(F.col("hc").isNull(), "NO_STATISTICS").when(F.col("hg") + F.col("ag") == 0, "NO_GOALS").otherwise("READY")
    return frame(spark, sf_dir, "matches").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@R.query("""
WITH p AS (SELECT CAST(ts AS DATE) AS day, event_id AS run_id, ts AS generated_at, user_id % 3 AS rows, event_type = 'error' AS replay FROM events)
SELECT day, run_id FROM p QUALIFY row_number() OVER (PARTITION BY day ORDER BY rows > 0 DESC, replay, generated_at DESC, run_id DESC) = 1""")
def publication_pointer(spark, sf_dir):
    e = frame(spark, sf_dir, "events")
    rows = e.select(
        F.to_date("ts").alias("day"), F.col("event_id").alias("run_id"), F.col("ts").alias("generated_at"), (F.col("user_id") % 3).alias("rows"), (F.col("event_type") == "error").alias("replay")
    )
    return upserts.publish(rows)


@R.query("SELECT DISTINCT team FROM (SELECT home AS team FROM matches WHERE competition = 3 UNION SELECT away FROM matches WHERE competition = 3)")
def union_distinct_teams(spark, sf_dir):
    m = frame(spark, sf_dir, "matches").filter("competition = 3")
    return m.select(F.col("home").alias("team")).union(m.select("away")).distinct()
