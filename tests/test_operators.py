"""Semantics that a query over the driver's tables does not reach."""

import datetime as dt
import inspect
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchlake import catalog
from pitchlake.functions import expressions as E
from pitchlake.operators import asof, fits, form, quality, resolve, settlement, similarity
from pitchlake.sources import artifacts, results_csv
from pitchlake.streaming import changes

DAY = dt.datetime(2024, 1, 1)


def matches(spark, rows):
    schema = "id long, kick timestamp_ntz, competition long, home long, away long, hg long, ag long, hc long, ac long, finished boolean"
    return spark.createDataFrame(rows, schema)


def test_history_is_strictly_earlier(spark):
    rows = [(i, DAY + dt.timedelta(days=i // 2), 1, 1, 2 + i, 2, 1, None, 3, True) for i in range(8)]
    out = {r["id"]: r for r in form.trailing_form(matches(spark, rows), 5).filter("team = 1").collect()}
    assert [out[i]["n"] for i in range(8)] == [0, 0, 2, 2, 4, 4, 5, 5]
    assert out[2]["ppm"] is None and out[4]["ppm"] == 3.0
    corners = {r["id"]: r for r in form.trailing_statistics(matches(spark, rows), "corners", 5).filter("team = 1").collect()}
    assert corners[6]["matches"] == 0 and corners[6]["corners_for"] is None  # a missing side leaves no statistic, but takes a place


def test_elo_batches_read_ratings_from_before(spark):
    rows = [(1, DAY, 1, 1, 2, 1, 0, None, None, True), (2, DAY, 1, 1, 3, 1, 0, None, None, True), (3, DAY + dt.timedelta(days=1), 1, 1, 2, 0, 0, None, None, False)]
    out = {r["id"]: r for r in form.elo(matches(spark, rows)).collect()}
    assert out[2]["home_elo"] == 1500
    move = 20 * (1 - 1 / (1 + 10 ** (-60 / 400)))
    assert out[3]["home_elo"] == pytest.approx(1500 + 2 * move)
    assert out[3]["away_elo"] == pytest.approx(1500 - move)


def test_heartbeat_compares_with_the_last_kept_row(spark):
    times = [0, 3, 5, 7, 11, 12]
    rows = [(1, i, DAY + dt.timedelta(hours=h), 1.5) for i, h in enumerate(times)]
    df = spark.createDataFrame(rows, "key long, id long, at timestamp_ntz, price double")
    kept = asof.dedupe_with_heartbeat(df, ["key"], "at", "id", "price", 6 * 3600)
    assert sorted(r["id"] for r in kept.collect()) == [0, 3]


def test_asof_join_boundary_and_ties(spark):
    quotes = spark.createDataFrame([(1, 1, DAY, 2.0), (1, 2, DAY, 3.0), (1, 3, DAY + dt.timedelta(hours=1), 4.0)], "key long, id long, at timestamp_ntz, odd double")
    asks = spark.createDataFrame([(1, 10, DAY), (1, 11, DAY - dt.timedelta(seconds=1)), (2, 12, DAY)], "key long, ask long, t timestamp_ntz")
    out = {r["ask"]: r["odd"] for r in asof.asof_latest(asks, quotes, ["key"], "t", "at", "id", ["odd"]).collect()}
    assert out == {10: 3.0, 11: None, 12: None}


def test_settlement_rules_differ_on_a_push(spark):
    df = spark.createDataFrame([(2, 2.0, "UNDER"), (2, 2.0, "OVER"), (2, 2.75, "OVER")], "total long, line double, side string")
    got = df.select(*[E.total_outcome(F.col("total"), F.col("line"), F.col("side"), r) for r in ("backtest", "report", "coupon")]).collect()
    assert [tuple(r) for r in got] == [("WON", "LOST", "VOID"), ("LOST", "LOST", "VOID"), ("LOST", "LOST", None)]


def test_void_and_pending_legs(spark):
    legs = spark.createDataFrame(
        [(1, 1, 2.0, "WON"), (1, 2, 3.0, "VOID"), (2, 1, 2.0, "VOID"), (3, 1, 2.0, "PENDING"), (3, 2, 2.0, "WON"), (4, 1, 2.0, "PENDING"), (4, 2, 2.0, "LOST")],
        "coupon long, leg long, odd double, state string",
    )
    got = {r["coupon"]: (r["result"], r["payout_cents"]) for r in settlement.settle_accumulators(legs, 100).collect()}
    assert got == {1: ("WON", 200), 2: ("VOID", 100), 3: ("UNSETTLED", None), 4: ("LOST", 0)}


def test_names_fold_and_keep_something(spark):
    df = spark.createDataFrame([("FC Göztepe SK",), ("Fenerbahçe",), ("FC SK",), ("Ærø-Straße",)], "n string")
    got = [r[0] for r in df.select(E.strip_designators(E.fold_name(F.col("n")))).collect()]
    assert got == ["goztepe", "fenerbahce", "sk", "aero strasse"]


def test_best_match_needs_a_margin(spark):
    src = spark.createDataFrame([(1, 1, "united"), (1, 2, "rovers")], "block long, id long, name string")
    dst = spark.createDataFrame([(1, 7, "united"), (1, 8, "rovers"), (1, 9, "roverz")], "block long, id long, name string")
    got = {r["source_id"]: (r["target_id"], r["level"]) for r in resolve.best_matches(src, dst, "block").collect()}
    assert got == {1: (7, "EXACT"), 2: (8, "EXACT")}


def test_multiclass_skips_incomplete_events_and_breaks_ties(spark):
    rows = [(1, s, p, y) for s, p, y in (("AWAY", 0.4, 0), ("DRAW", 0.2, 0), ("HOME", 0.4, 1))] + [(2, "HOME", 1.0, 1)]
    df = spark.createDataFrame(rows, "event long, selection string, p double, y int").withColumn("g", F.lit(1))
    out = quality.multiclass_quality(df, ["event"], ["g"]).first()
    assert (out["events"], out["accuracy"]) == (1, 1.0)


@pytest.mark.parametrize("distinct", [1_000_000, 1])
def test_logistic_descent_equals_numpy(spark, monkeypatch, distinct):
    import numpy as np

    monkeypatch.setattr(fits, "DISTINCT", distinct)

    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 200) / 4
    y = (rng.random(200) < 0.2 + 0.6 * x).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    got = fits.logistic_gd(df, ["x"], "y", steps=20)
    w = np.zeros(2)
    for _ in range(20):
        e = 1 / (1 + np.exp(-(w[0] * x + w[1]))) - y
        w -= 0.08 * np.array([(e * x).mean() + 0.002 * w[0], e.mean()])
    assert got == pytest.approx(w.tolist())


def test_csv_issues(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG\nE0,01/02/2020,,A,B,1,2\nE0,1/2/20,15:00,A,,1,2\ne0,x,,A,B,,\nE0,01/02/2020,,A,B,1,\nE1,01/02/2020,,A,B,1,1\n")
    schema = "Div string, Date string, Time string, HomeTeam string, AwayTeam string, FTHG string, FTAG string"
    rows = spark.read.csv(str(tmp_path / "r.csv"), schema=schema, header=True)
    got = [(r["issue"], r["kickoff_known"]) for r in results_csv.validate(rows, "E0").collect()]
    assert got == [(None, False), ("MISSING_TEAM", True), ("BAD_DATE", False), ("HALF_PAIR_FTHG_FTAG", False)]


def test_artifact_round_trip_and_tampering():
    text = artifacts.dumps({"w": [0.1, 2e-17]}, "v1")
    assert artifacts.loads(text, "v1") == {"w": [0.1, 2e-17]}
    with pytest.raises(ValueError):
        artifacts.loads(text.replace("0.1", "0.2"), "v1")
    with pytest.raises(ValueError):
        artifacts.loads(text, "v2")


def test_stream_keeps_changes_across_batches(spark, tmp_path):
    schema = "key long, id long, at timestamp, price double"
    for n, rows in enumerate([[(1, 1, DAY, 2.0), (1, 2, DAY + dt.timedelta(minutes=1), 2.0)], [(1, 3, DAY + dt.timedelta(minutes=2), 2.0), (1, 4, DAY + dt.timedelta(hours=2), 2.0), (1, 5, DAY + dt.timedelta(hours=2), 3.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "land").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land"))
    query = changes.changed_prices(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n in range(2):
            for f in (tmp_path / f"in{n}").glob("*.parquet"):
                f.rename(tmp_path / "land" / f"{n}-{f.name}")
            query.processAllAvailable()
        assert sorted(r["id"] for r in spark.sql("select id from kept").collect()) == [1, 4, 5]
    finally:
        query.stop()


def test_registered_fits_run_all_their_steps(spark, monkeypatch):
    from pitchlake.plans import forecasts

    asked = {}

    def seen(name, result):
        default = inspect.signature(getattr(fits, name))

        def call(*args, **options):
            bound = default.bind(*args, **options)
            bound.apply_defaults()
            asked[name] = bound.arguments.get("steps", bound.arguments.get("draws"))
            return result

        monkeypatch.setattr(fits, name, call)

    seen("platt_fit", (1.0, 0.0))
    seen("logistic_gd", [0.0, 0.0])
    seen("bootstrap_interval", None)
    for query in (forecasts.platt_fit, forecasts.glm_gd_fit, forecasts.bootstrap_interval):
        query(spark, "/root/testdata/sf0.001")
    assert asked == {"platt_fit": 500, "logistic_gd": 700, "bootstrap_interval": 2000}


def test_grouped_fits_equal_numpy(spark):
    """Each kind of fit over weighted distinct rows, against plain loops over all rows."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (300, 2)) / 3
    classes = np.array(["HOME", "DRAW", "AWAY"])[rng.integers(0, 3, 300)]
    goals = rng.poisson(1.4, 300)
    rows = [(1, *map(float, a), int(g > 1), int(g), str(c)) for a, g, c in zip(x, goals, classes)]
    df = spark.createDataFrame(rows, "grp long, a double, b double, over int, goals int, result string")
    for kind, label in (("logistic", "over"), ("poisson", "goals"), ("softmax", "result")):
        got = {(r["term"], r["class"]): r["weight"] for r in fits.glm_fits(df, ["grp"], ["a", "b"], label, kind).collect()}
        names = ["HOME", "DRAW", "AWAY"] if kind == "softmax" else [""]
        y = np.stack([classes == c for c in names], 1).astype(float) if kind == "softmax" else (goals > 1 if kind == "logistic" else goals).astype(float)[:, None]
        steps, rate = {"logistic": (700, 0.08), "poisson": (800, 0.015), "softmax": (800, 0.06)}[kind]
        w, c = np.zeros((2, len(names))), np.zeros(len(names))
        if kind == "poisson":
            c += np.log(goals.mean())
        for _ in range(steps):
            z = x @ w + c
            p = np.exp(z) if kind == "poisson" else 1 / (1 + np.exp(-z)) if kind == "logistic" else np.exp(z) / np.exp(z).sum(1, keepdims=True)
            w, c = w - rate * (x.T @ (p - y) / 300 + 0.002 * w), c - rate * (p - y).mean(0)
        for j, k in enumerate(names):
            assert [got["a", k], got["b", k], got["intercept", k]] == pytest.approx([w[0, j], w[1, j], c[j]], rel=1e-6)


def test_walk_forward_sees_the_past_only(spark):
    """Changing a later fold's outcomes changes no earlier forecast."""
    rows = [(i, i // 20, (i % 5) / 4, int(i % 3 == 0)) for i in range(100)]
    other = [(i, f, x, y if f < 3 else 1 - y) for i, f, x, y in rows]
    a, b = ({r["id"]: r["p"] for r in fits.walk_forward(spark.createDataFrame(d, "id long, fold long, x double, y int"), ["x"], "y").collect()} for d in (rows, other))
    assert set(a) == set(range(20, 100))
    assert all(a[i] == b[i] for i in range(20, 80)) and any(a[i] != b[i] for i in range(80, 100))


def test_calibration_is_accepted_only_where_it_helps(spark):
    rows = []
    for n in range(400):
        part = "fit" if n < 200 else "test"
        rows += [("off", part, 0.9 if n % 2 else 0.8, int(n % 10 < 5)), ("flip", part, 0.7, int((n % 10 < 9) == (part == "fit")))]
    rows += [("few", "fit", 0.5, 1)] * 5
    got = {r["family"]: r["status"] for r in fits.fit_calibration(spark.createDataFrame(rows, "family string, part string, p double, y int"), "family").collect()}
    assert got == {"off": "CALIBRATED_V1", "flip": "CALIBRATION_NOT_BENEFICIAL", "few": "INSUFFICIENT_SAMPLE"}


def test_elo_splits_unlinked_teams(spark):
    rows = [(1, DAY, 1, 1, 2, 1, 0, None, None, True), (2, DAY, 1, 8, 9, 1, 0, None, None, True), (3, DAY + dt.timedelta(days=1), 1, 2, 3, 0, 0, None, None, True), (4, DAY + dt.timedelta(days=2), 1, 9, 8, 0, 0, None, None, True)]
    df = matches(spark, rows)
    assert {r["id"]: r["system"] for r in form.systems(df).collect()} == {1: 1, 2: 8, 3: 1, 4: 8}
    out = {r["id"]: r for r in form.elo(df).collect()}
    assert out[4]["away_elo"] > 1500 > out[4]["home_elo"] and out[3]["home_elo"] < 1500


def test_rejections_keep_their_order(spark):
    from pitchlake.operators import ranking

    base = dict(id=1, match_id=1, market="TOTAL_GOALS", selection="OVER", line=2.5, p=0.7, odd=1.8, availability="AVAILABLE", identity_valid=True, kickoff_known=True, history_home=9, history_away=9,
                corners_coverage=1.0, status="CALIBRATED_V1", observed=0.7, n=60, match_status="scheduled", age_seconds=3600, day="2024-01-01")
    cases = [({}, None), ({"odd": None}, "ODDS_UNAVAILABLE"), ({"odd": 1.0, "availability": "x"}, "INVALID_ODDS"), ({"identity_valid": False, "kickoff_known": False}, "RESOLUTION_FAILED"),
             ({"history_home": 4, "match_status": "started"}, "INSUFFICIENT_HISTORY"), ({"observed": 0.3, "age_seconds": 10**6}, "NEGATIVE_MODEL_QUALITY"), ({"age_seconds": 86400}, None),
             ({"age_seconds": 86401}, "STALE_ODDS"), ({"age_seconds": -1}, "INVALID_ODDS"), ({"line": 3.5}, "UNSUPPORTED_MARKET")]
    kinds = "id long, match_id long, market string, selection string, line double, p double, odd double, availability string, identity_valid boolean, kickoff_known boolean, history_home long, history_away long, corners_coverage double, status string, observed double, n long, match_status string, age_seconds long, day string"
    rows = [tuple({**base, **change}.values()) for change, _ in cases]
    got = [r[0] for r in spark.createDataFrame(rows, kinds).coalesce(1).select(ranking.rejection("OVER_25")).collect()]
    assert got == [reason for _, reason in cases]


def test_best_combination_prefers_the_exact_target(spark):
    legs = [(1, 1, 1, 1.5, 0.1), (1, 2, 2, 1.2, 0.1), (1, 3, 3, 1.3, 0.9), (1, 4, 1, 1.2, 0.9), (2, 1, 1, 1.1, 0.5), (2, 2, 2, 1.2, 0.5), (2, 3, 3, 1.3, 0.5)]
    df = spark.createDataFrame(legs, "coupon long, leg long, match_id long, odd double, score double")
    got = {r["coupon"]: (r["size"], list(r["ids"])) for r in settlement.best_combination(settlement.combinations(df)).collect()}
    assert got == {1: (2, [1, 2]), 2: (3, [1, 2, 3])}
    assert settlement.combinations(df, most=2).filter("size = 0").count() == 2


def test_upserts_of_repeated_keys_give_one_row(spark):
    from pitchlake.sources import upserts

    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (3, None)], "k long, v string")
    assert sorted(map(tuple, upserts.insert_or_ignore(old, new, ["k"]).collect())) == [(2, "c"), (3, None)]
    stats = upserts.upsert_statistics(spark.createDataFrame([(1, 5)], "k long, x long"), spark.createDataFrame([(1, None), (1, 3), (1, 2)], "k long, x long"), ["k"], ["x"])
    assert [tuple(r) for r in stats.collect()] == [(1, 3)]
    kinds = "id long, known int, kick timestamp_ntz, status string, hg long, ag long"
    rows = [(1, 0, DAY, "scheduled", None, None), (1, 1, DAY, "finished", 2, 1), (1, 0, DAY + dt.timedelta(days=1), "postponed", None, 3)]
    got = upserts.upsert_matches(spark.createDataFrame(rows[:1], kinds), spark.createDataFrame(rows[1:], kinds)).collect()
    assert [tuple(r) for r in got] == [(1, 1, DAY, "finished", 2, 1)]


def test_results_file_with_short_and_long_rows(spark, tmp_path):
    head = ",".join(f.name for f in results_csv.SCHEMA)
    (tmp_path / "r.csv").write_text(f"{head}\nE0, 01/02/2020 ,15:00, A ,B,1,2\nE0,01/02/2020,,C,D\n")
    rows = results_csv.read(spark, str(tmp_path / "r.csv"))
    got = [(r["HomeTeam"], r["FTHG"], r["FTAG"]) for r in rows.collect()]
    assert got == [("A", "1", "2"), ("C", None, None)]


def exploded_broadcasts(df) -> list[str]:
    """Lines of the plan that explode rows below a broadcast."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        depth = None if depth is not None and at <= depth else depth
        if "BroadcastExchange" in line and depth is None:
            depth = at
        if depth is not None and "Generate" in line:
            found.append(line)
    return found


def test_exploded_starters_are_never_broadcast(spark):
    for name in ("lineup_features", "lineup_quality"):
        assert not exploded_broadcasts(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_nearest_names_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    name = lambda: rng.choice(["", None, "team ", "team long "]) if rng.random() < 0.1 else "team " + "".join(rng.choice("012") for _ in range(rng.randint(1, 7)))
    s, t = ([(rng.randint(1, 2), i, name()) for i in range(n)] for n in (60, 300))
    names = [spark.createDataFrame(rows, f"block long, {p}_id long, {p}_name string") for p, rows in (("source", s), ("target", t))]
    pairs = names[0].join(names[1], "block").withColumn("score", F.round(E.similarity(F.col("source_name"), F.col("target_name")), 8))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    want = pairs.withColumn("rank", rank).filter("rank <= 5").select("source_id", "target_id", "score", "rank")
    assert sorted(map(str, similarity.nearest_names(*names, "block", 5).collect())) == sorted(map(str, want.collect()))


def test_nearest_names_compare_few(spark):
    rows = spark.range(4000).selectExpr("id % 2 AS block", "id", "'team ' || lpad(id, 9, '0') AS name")
    names = [rows.selectExpr("block", f"id AS {p}_id", f"name AS {p}_name") for p in ("source", "target")]
    compared = spark.sparkContext.accumulator(0)
    whole = similarity._few_best
    try:
        similarity._few_best = lambda pairs, *rest: (compared.add(pairs.count()), whole(pairs, *rest))[1]
        assert similarity.nearest_names(*names, "block", 2).count() == 8000
    finally:
        similarity._few_best = whole
    assert compared.value < 4000 * 2000 / 5


def test_nulls_of_popular_selections_come_last(spark, tmp_path):
    """Two rows of one id that differ in a missing price alone."""
    line = "2 AS l_orderkey, {} AS l_partkey, 1 AS l_suppkey, 4 AS l_linenumber, 17.0 AS l_quantity, 1.0 AS l_extendedprice, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1996-01-01' AS l_shipdate"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT {line.format(9)} UNION ALL SELECT {line.format(1009)}) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = catalog.queries()["supported_populars"](spark, str(tmp_path)).select("id", "support", "reason").collect()
    want = con.execute(f"SELECT id, support, reason FROM ({catalog.oracle_sql()['supported_populars']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_slices_of_a_rating_do_not_grow_in_number(spark, monkeypatch):
    rows = [(i, DAY + dt.timedelta(days=i // 2), 1, i % 7, 7 + i % 5, i % 3, i % 2, None, 3, True) for i in range(200)]
    m = matches(spark, rows)
    want = sorted(map(str, form.elo(m).collect()))
    monkeypatch.setattr(form, "SLICE", 2)
    seen, cut = [], form.time_slices
    monkeypatch.setattr(form, "time_slices", lambda *a: seen.append(cut(*a)) or seen[-1])
    assert sorted(map(str, form.elo(m).collect())) == want
    assert 1 < len(seen[0]) <= form.SLICES + 1


def test_congestion_counts_without_sliding_frames(spark):
    """Every frame starts at a team's first instant: one that slides is summed anew for each row."""
    import re

    sql = "id, timestamp '2024-01-01' + cast(id / 4 as int) * interval '7' hour AS kick, id % 3 AS home, id % 3 + 1 AS away, id % 5 > 0 AS finished"
    matches = spark.range(200).selectExpr(*[c.strip() for c in sql.split(",")])
    out = form.rest_and_congestion(matches)
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", out._jdf.queryExecution().optimizedPlan().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}
    rows = [(r["id"], t, r["kick"], r["finished"]) for r in matches.collect() for t in (r["home"], r["away"])]
    for r in out.collect():
        at = next(k for i, t, k, _ in rows if (i, t) == (r["id"], r["team"]))
        past = [(at - k).total_seconds() for _, t, k, f in rows if t == r["team"] and f and k < at]
        assert (r["last_7"], r["last_14"]) == tuple(sum(s < (d + 1) * 86400 for s in past) for d in (7, 14))
        assert r["rest_days"] == (round(min(past) // 60 / 1440, 8) if past else None)


def test_best_of_shares_bound_the_policies_ranking(spark, monkeypatch):
    """What cannot be among a day's seven best is left out before rows are ranked; the policies' figures stay."""
    from pitchlake.operators import research

    monkeypatch.setattr(research, "SHARES", 16)
    h = "pmod(hash(id, {}), 1000) / 1000d"
    names = ["probability", "expected_goals", "odds", "ev", "attack", "concession", "btts", "league_goals", "quality"]
    scale = {"odds": "1.5 + {} * 2", "expected_goals": "{} * 5", "attack": "{} * 5", "concession": "{} * 5", "league_goals": "{} * 4"}
    made = [f"{scale.get(n, '{}').format(h.format(i))} AS {n}" for i, n in enumerate(names)]
    rows = spark.range(900).selectExpr("id AS match_id", "id % 3 AS date", *made, "true AS prematch_valid", "9 AS history", "1d AS odds_age_hours", "cast(id % 2 as int) AS won")
    rows = rows.localCheckpoint()
    got = {r["family"]: r for r in research.tune(rows, 2.5, [0.45], [-0.05], [45.0], least_bets=1).collect()}
    for family in (0, 5):
        chosen = research.daily_selections(rows, research.weight_family(2.5)[family], 0.45, -0.05, 45.0).collect()
        assert got[family]["bets"] == len(chosen) == 21
        assert got[family]["roi"] == pytest.approx(sum(r["won"] * r["odds"] - 1 for r in chosen) / len(chosen), abs=1e-7)


def test_validation_sorts_no_more_legs_in_a_task_as_they_grow(spark, monkeypatch):
    rows = [(i // 3, "DAILY_COMPOUND", i % 3 + 1, 1.1, i % 3 if (i // 3) % 2 else 0, None, "BTTS") for i in range(900)]
    legs = spark.createDataFrame(rows, "coupon long, kind string, leg int, odd double, match_id int, line double, market string")
    want = sorted(map(tuple, settlement.validate_selections(legs).collect()), key=str)
    monkeypatch.setattr(settlement, "TASK_LEGS", 30, raising=False)
    got = settlement.validate_selections(legs)
    assert got.rdd.getNumPartitions() == 30 and sorted(map(tuple, got.collect()), key=str) == want
    assert {r[3] for r in want} == {None, "SAME_MATCH_CONFLICT"}
