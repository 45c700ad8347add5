"""The sports tables derived from the driver's star schema, by expressions that mean the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (driver table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "observations": (
        "lineitem",
        [
            "l_orderkey AS match_id",
            "l_linenumber AS leg",
            "l_linestatus AS grp",
            "l_suppkey % 7 AS market",
            "l_suppkey % 10 AS competition",
            "CASE WHEN l_linenumber % 2 = 0 THEN 'LINEUP' ELSE 'BASE' END AS context",
            "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 4 END AS category",
            "CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p",
            "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
            "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(1 AS DOUBLE) + l_quantity / CAST(20 AS DOUBLE) END AS odd",
            "l_shipdate AS generated_at",
        ],
    ),
    "matches": (
        "orders",
        [
            "o_orderkey AS id",
            "o_orderdate AS kick",
            "o_custkey % 20 AS home",
            "(o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away",
            "(o_orderkey * 7) % 5 AS hg",
            "(o_orderkey * 11) % 4 AS ag",
            "o_orderstatus = 'F' AS finished",
            "o_custkey % 10 AS competition",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 5) % 13 END AS hc",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 3) % 11 END AS ac",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7) % 17 + 3 END AS hs",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 5) % 15 + 2 END AS as_",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7) % 6 END AS hst",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 5) % 5 END AS ast",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 3) % 13 END AS hf",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 9) % 14 END AS af",
            "(o_orderkey * 3) % 5 AS hy",
            "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 11) % 6 END AS ay",
            "CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS hr",
            "CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS ar",
        ],
    ),
    "quotes": (
        "events",
        [
            "event_id AS id",
            "user_id % 20 AS key",
            "event_type AS selection",
            "ts AS captured",
            "CAST(1 AS DOUBLE) + value / CAST(50 AS DOUBLE) AS odd",
        ],
    ),
    "forecasts": (
        "orders",
        [
            "o_orderkey AS forecast_id",
            "o_custkey % 20 AS key",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'click' END AS selection",
            "timestamp '2024-01-01 00:00:00' + (o_orderkey % 720) * interval '1' hour AS cutoff",
            "CAST((o_orderkey * 29) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p",
            "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y",
        ],
    ),
    "two_sided": (
        "events",
        [
            "event_id AS id",
            "user_id % 20 AS key",
            "CASE WHEN event_type IN ('view', 'click') THEN 'yes' ELSE 'no' END AS side",
            "CAST(date_trunc('day', ts) AS TIMESTAMP) AS captured",
            "event_id % 2 AS provider",
            "CAST(1 AS DOUBLE) + value / CAST(50 AS DOUBLE) AS odd",
        ],
    ),
    "popularity": (
        "events",
        [
            "event_id AS id",
            "user_id % 20 AS key",
            "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS selection",
            "CASE WHEN event_id % 2 = 0 THEN 'COUNT' ELSE 'RANK' END AS metric",
            "ts AS captured",
            "CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE event_id % 50 + 1 END AS value",
        ],
    ),
    "outcomes": (
        "events",
        [
            "event_id AS id",
            "user_id AS series",
            "CASE event_type WHEN 'purchase' THEN 'WON' WHEN 'error' THEN 'VOID' ELSE 'LOST' END AS state",
            "CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(-10 AS DOUBLE) END AS profit",
            "event_id % 7 + 1 AS step",
            "ts AS at",
        ],
    ),
    "predictions": (
        "lineitem",
        [
            "l_orderkey * 10 + l_linenumber AS id",
            "l_orderkey AS match_id",
            "l_suppkey % 10 AS competition",
            "CAST(l_shipdate AS DATE) AS day",
            "CASE l_linenumber WHEN 1 THEN 'FULL_TIME_TOTAL_CORNERS' WHEN 4 THEN 'BTTS' WHEN 5 THEN 'MATCH_RESULT' WHEN 7 THEN 'BTTS' ELSE 'TOTAL_GOALS' END AS market",
            "CASE l_linenumber WHEN 4 THEN 'YES' WHEN 5 THEN 'HOME' WHEN 6 THEN 'UNDER' WHEN 7 THEN 'NO' ELSE 'OVER' END AS selection",
            "CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey % 6 AS DOUBLE) + CAST(6.5 AS DOUBLE) WHEN l_linenumber = 3 THEN CAST(3.5 AS DOUBLE)"
            " WHEN l_linenumber IN (2, 6) THEN CAST(2.5 AS DOUBLE) ELSE NULL END AS line",
            "CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p",
            "CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN CAST(1 AS DOUBLE)"
            " ELSE CAST(1 AS DOUBLE) + l_quantity / CAST(20 AS DOUBLE) END AS odd",
            "CASE WHEN l_orderkey % 23 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability",
            "l_orderkey % 19 <> 0 AS identity_valid",
            "l_orderkey % 13 <> 0 AS kickoff_known",
            "l_suppkey % 14 + 2 AS history_home",
            "l_partkey % 14 + 2 AS history_away",
            "CAST(l_partkey % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS corners_coverage",
            "CASE l_suppkey % 5 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'CALIBRATION_NOT_BENEFICIAL' WHEN 2 THEN 'UNCALIBRATED' ELSE 'CALIBRATED_V1' END AS status",
            "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(l_suppkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS observed",
            "(l_partkey * 7) % 90 AS n",
            "CASE WHEN l_orderkey % 17 = 0 THEN 'started' WHEN l_orderkey % 29 = 0 THEN 'finished' ELSE 'scheduled' END AS match_status",
            "(l_orderkey % 27 - 1) * 3600 AS age_seconds",
        ],
    ),
    "evaluated": (
        "lineitem",
        [
            "l_orderkey AS match_id",
            "l_suppkey % 10 AS competition",
            "CASE WHEN l_orderkey % 2 = 0 THEN 'LINEUP' ELSE 'BASE' END AS context",
            "CASE WHEN l_orderkey % 3 = 0 THEN 'SURPRISE' ELSE NULL END AS category",
            "CASE WHEN l_linenumber <= 3 THEN 'MATCH_RESULT' WHEN l_linenumber = 4 THEN 'BTTS' ELSE 'TOTAL_GOALS' END AS market",
            "CASE l_linenumber WHEN 1 THEN 'HOME' WHEN 2 THEN 'DRAW' WHEN 3 THEN 'AWAY' WHEN 4 THEN 'YES' WHEN 5 THEN 'UNDER' ELSE 'OVER' END AS selection",
            "CASE WHEN l_linenumber = 7 THEN CAST(3.5 AS DOUBLE) WHEN l_linenumber IN (5, 6) THEN CAST(2.5 AS DOUBLE) ELSE NULL END AS line",
            "CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p",
            "CAST((l_partkey * 17 + l_orderkey * 7 + l_linenumber * 11) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS public",
            "CASE WHEN l_linenumber <= 3 THEN CASE WHEN l_orderkey % 3 + 1 = l_linenumber THEN 1 ELSE 0 END WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
            "CASE WHEN l_returnflag = 'R' THEN 'WON' WHEN l_returnflag = 'A' THEN 'LOST' WHEN l_partkey % 2 = 0 THEN 'VOID' ELSE 'UNSETTLED' END AS settlement",
            "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) + l_quantity / CAST(20 AS DOUBLE) END AS odd",
        ],
    ),
    "clubs": (
        "part",
        [
            "p_partkey AS id",
            "CASE WHEN p_partkey = 7 THEN 'Manchester United' ELSE split_part(p_name, ' ', 2) || ' ' ||"
            " translate(substr(md5(CAST(p_partkey AS STRING)), 1, 9), '0123456789abcdef', 'aeioubcdfglmnrst') END AS name",
            "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 5 END AS country",
        ],
    ),
    "listed_clubs": (
        "part",
        [
            "p_partkey + 10000000 AS id",
            "p_partkey % 16 AS way",
            "split_part(p_name, ' ', 2) || ' ' || translate(substr(md5(CAST(p_partkey AS STRING)), 1, 9), '0123456789abcdef', 'aeioubcdfglmnrst') AS plain",
            "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size % 5 END AS country",
        ],
    ),
    "club_games": (
        "lineitem",
        [
            "l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id",
            "l_linenumber AS nth",
            "l_partkey AS home",
            "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS away",
            "l_suppkey AS pick",
            "CAST(floor(l_partkey / 20) AS BIGINT) AS competition",
            "CAST(l_shipdate AS DATE) AS day",
            "l_shipdate + CAST(l_quantity AS INT) * interval '1' hour AS kick",
            "l_suppkey % 4 <> 0 AS known",
            "l_returnflag <> 'N' AS finished",
            "l_partkey % 5 AS hg",
            "l_suppkey % 4 AS ag",
        ],
    ),
    "participations": (
        "lineitem",
        [
            "l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id",
            "l_suppkey % 20 AS team",
            "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 40 END AS player",
            "l_shipdate AS kick",
            "l_linenumber <= 4 AS started",
        ],
    ),
    "goal_rows": (
        "orders",
        [
            "o_orderkey AS match_id",
            "o_custkey % 40 AS date",
            "CAST((o_orderkey * 37 + o_custkey * 13) % 600 + 400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS probability",
            "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) + CAST((o_orderkey * 7) % 200 AS DOUBLE) / CAST(100 AS DOUBLE) END AS odds",
            "CAST((o_orderkey * 3) % 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS expected_goals",
            "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) / CAST(10 AS DOUBLE) END AS attack",
            "CAST(o_custkey % 60 AS DOUBLE) / CAST(10 AS DOUBLE) AS concession",
            "CAST((o_orderkey * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS btts",
            "CAST(o_custkey % 40 AS DOUBLE) / CAST(10 AS DOUBLE) AS league_goals",
            "CAST(o_orderkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS quality",
            "o_orderkey % 23 <> 0 AS prematch_valid",
            "o_orderkey % 9 + 3 AS history",
            "CAST(o_orderkey % 26 - 1 AS DOUBLE) AS odds_age_hours",
            "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won",
        ],
    ),
    "legs": (
        "lineitem",
        [
            "l_orderkey AS coupon",
            "l_linenumber AS leg",
            "CAST(1 AS DOUBLE) + l_quantity / CAST(50 AS DOUBLE) AS odd",
            "CASE l_returnflag WHEN 'R' THEN 'WON' WHEN 'A' THEN 'LOST' ELSE 'VOID' END AS state",
            "l_partkey % 50 AS match_id",
            "CAST((l_partkey * 37 + l_orderkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score",
            "CASE l_linenumber WHEN 1 THEN 'FULL_TIME_TOTAL_CORNERS' WHEN 4 THEN 'BTTS' WHEN 5 THEN 'MATCH_RESULT' WHEN 7 THEN 'BTTS' ELSE 'TOTAL_GOALS' END AS market",
            "CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey % 6 AS DOUBLE) + CAST(6.5 AS DOUBLE) WHEN l_linenumber = 3 THEN CAST(3.5 AS DOUBLE)"
            " WHEN l_linenumber IN (2, 6) THEN CAST(2.5 AS DOUBLE) ELSE NULL END AS line",
            "CASE l_orderkey % 4 WHEN 0 THEN 'DAILY_SURPRISE_SYSTEM' WHEN 1 THEN 'DAILY_COMPOUND' WHEN 2 THEN 'DAILY_OVER_25' ELSE 'DAILY_HIGH_CONFIDENCE' END AS kind",
        ],
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's own."""
    source, columns = VIEWS.get(name, (name, ["*"]))
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{source}.parquet").selectExpr(*columns)
    # Computed timestamps are in the session's zone (UTC); the tables' have none.
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the derived tables."""
    used = [name for name in VIEWS if name in sql]
    body = ",\n".join(f"{name} AS (SELECT {', '.join(VIEWS[name][1])} FROM {VIEWS[name][0]})" for name in used)
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {body},\n{sql[14:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"
