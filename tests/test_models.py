"""Joint score models, lineup features and bulletins: plain versions, bounds, and odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import joint, lineups, publication, status
from pitchlake.session import checkpointed
from pitchlake.sources import bulletin_tree


def joint_rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1), rng.random() if rng.random() < 0.7 else None, None], [rng.randrange(5), rng.randrange(4)], rng.randrange(800)) for i in range(n)]


@pytest.mark.parametrize("tasks", [1, 2])
def test_rates_are_the_penalised_optimum(spark, tasks):
    rows = joint_rows(200)
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<int>, day int")
    out = joint.fit_rates(df, ["a", "b", "void"], tasks=tasks).collect()
    model = {(r["side"], r["term"]): r["values"] for r in out if r["term"]}
    assert {t for _, t in model} == {"a", "b", "void", "missing b", "missing void", "intercept"}
    x = np.array([[np.nan if v is None else v for v in r[1]] for r in rows])
    mean = [np.nanmean(x[:, 0]), np.nanmean(x[:, 1]), 0.0]
    wide = np.hstack([np.where(np.isnan(x), mean, x), np.isnan(x[:, 1:]).astype(float)])
    scale = wide.std(axis=0)
    z = (wide - wide.mean(axis=0)) / np.where(scale < 1e-12, 1, scale)
    w = 2.0 ** (-(max(r[3] for r in rows) - np.array([r[3] for r in rows])) / 365)
    rates = {r["id"]: r["values"] for r in out if r["id"] is not None}
    for side, name in enumerate(("home", "away")):
        beta = np.array([model[name, t][0] for t in ("a", "b", "void", "missing b", "missing void")])
        eta = z @ beta + model[name, "intercept"][0]
        y = np.array([r[2][side] for r in rows])
        gradient = z.T @ (w * (np.exp(eta) - y)) / w.sum() + 0.3 * beta
        assert np.abs(gradient).max() < 1e-8 and abs((w * (np.exp(eta) - y)).sum()) < 1e-6
        assert [rates[i][side] for i in range(200)] == pytest.approx(np.clip(np.exp(eta), 0.05, 8).tolist())
    assert joint.fit_rates(df.limit(0), ["a", "b", "void"]).count() == 0


def test_grids_cells_and_projection():
    rates = np.array([[1.4, 1.1], [0.05, 8.0], [3.0, 0.2]])
    grids = joint.score_grids(rates)
    assert np.allclose(grids.sum(axis=(1, 2)), 1)
    assert grids[0, 2, 1] == pytest.approx(math.exp(-2.5) * 1.4**2 / 2 * 1.1)
    over, both = np.array([0.3, 0.9, 0.55]), np.array([0.6, 0.1, 0.5])
    cells = joint.projected(joint.cell_masses(grids), over, both)
    assert np.allclose(cells[:, 2] + cells[:, 3], over, atol=1e-9) and np.allclose(cells[:, 1] + cells[:, 3], both, atol=1e-9)
    made = joint.markets(joint.reweighted(grids, cells))
    assert np.allclose(made["over_25"], over, atol=1e-9) and np.allclose(made["btts"], both, atol=1e-9) and (made["over_35"] <= made["over_25"]).all()
    for bad in ([[0.0, 1.0]], [[1.0, 8.5]], [[float("nan"), 1.0]]):
        with pytest.raises(ValueError, match="rates"):
            joint.score_grids(np.array(bad))


def test_tilt_stops_at_its_bounds(spark):
    rows = [(i, [0.7, 0.1, 0.1, 0.1], 3) for i in range(500)]
    out = joint.fit_tilt(spark.createDataFrame(rows, "id long, cells array<double>, cell int"), tasks=2).first()
    assert out["over"] == pytest.approx(2.0) and out["both"] == pytest.approx(2.0) and out["n"] == 500


def test_lineups_without_history(spark):
    matches = spark.createDataFrame([(1, 10, 11, "2024-01-05", True), (2, 10, 12, "2024-01-05", True), (3, 11, 10, "2024-01-09", False), (4, 10, 13, None, False)], "id long, home long, away long, kick string, finished boolean").withColumn("kick", F.to_timestamp("kick"))
    seen = [(1, 10, 7, "2024-01-05", True), (2, 10, None, "2024-01-05", True), (3, 10, 8, "2024-01-05", None), (4, 10, 9, "2024-01-04", True), (5, 10, 9, "2024-01-09", True)]
    past = spark.createDataFrame(seen, "id long, team long, player long, kick string, started boolean").withColumn("kick", F.to_timestamp("kick"))
    eleven = [(m, side, p, None if p == 9 else "D", p == 8) for m in (1, 3, 4) for side in ("HOME", "AWAY") for p in (7, 8, 9, None)]
    starters = spark.createDataFrame(eleven, "match long, side string, player long, position string, goalkeeper boolean")
    got = {(r["match"], r["side"]): r for r in lineups.starter_features(starters, past, matches).collect()}
    assert set(got) == {(1, "HOME"), (1, "AWAY"), (3, "HOME"), (3, "AWAY")}  # a match without kickoff has none
    late, first = got[3, "AWAY"], got[1, "HOME"]
    assert (first["continuity"], first["starts"], first["players"], first["finished"]) == (1, 1, 1, 0)
    assert (late["continuity"], late["starts"], late["players"], late["finished"], late["goalkeeper_continuity"]) == (2, 3, 3, 2, 1)
    assert late["recent_share"] == pytest.approx(2 / 5) and late["resolved"] == 3
    assert got[3, "HOME"]["recent_share"] == 0 and got[1, "AWAY"]["regulars"] == 0
    assert lineups.starter_features(starters.limit(0), past, matches).count() == 0
    assert lineups.starter_features(starters, past.limit(0), matches).filter("continuity > 0").count() == 0


def test_bulletins_that_are_none(spark):
    bodies = [(1, None), (2, ""), (3, "[]"), (4, '{"i":1,"hn":"a","an":"b","ci":2,"d":5}'), (5, '[[[{"i":null,"an":"b"}]],{"i":7,"hn":"a","an":"a","ci":2,"d":5,"m":[{"o":[{"odd":"x"}]}]}]'), (6, '{"i":9,"hn":"x","an":"x","ci":1,"d":1.5}')]
    docs = bulletin_tree.documents(spark.createDataFrame(bodies, "k long, b string"), "k", "b")
    known = spark.createDataFrame([(2,)], "competition long")
    got = sorted((r["doc"], r["event_id"] or 0, r["issue"] or "", r["status"]) for r in bulletin_tree.import_status(bulletin_tree.events(docs), known).collect())
    assert got == [
        (1, 0, "MALFORMED_JSON", "REJECTED"),
        (2, 0, "MALFORMED_JSON", "REJECTED"),
        (3, 0, "NO_EVENTS", "REJECTED"),
        (4, 1, "", "IMPORTED"),
        (5, 0, "MALFORMED:odd", "REJECTED"),
        (5, 0, "MISSING:i", "REJECTED"),
        (6, 0, "MALFORMED:d", "REJECTED"),
    ]
    assert bulletin_tree.events(docs.limit(0)).count() == 0 and bulletin_tree.competitions(docs).count() == 0


def test_retries_wait_their_time(spark):
    rows = [(1, "NEW", 0, None, None), (2, "MANUAL_REVIEW", 9, None, None), (3, "AMBIGUOUS", 1, "2024-01-03", None), (4, "AUTO_RESOLVING", 1, "2030-01-01", "2024-01-01 00:00"), (5, "AUTO_RESOLVING", 1, None, "2024-01-01 23:55"), (6, "RESOLVED", 1, None, None)]
    queue = spark.createDataFrame(rows, "id long, state string, attempts long, retry_at string, leased_at string").withColumns({c: F.to_timestamp_ntz(c) for c in ("retry_at", "leased_at")})
    matches = spark.createDataFrame([(i, "scheduled" if i != 2 else "postponed", f"2024-02-0{9 - i}") for i in range(1, 7)], "id long, status string, kick string").withColumn("kick", F.to_timestamp_ntz("kick"))
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    assert [(r["id"], r["attempts"]) for r in status.retry_queue(queue, matches, now).collect()] == [(4, 2), (1, 1)]


def test_popular_selections_of_nothing(spark):
    popular = spark.createDataFrame([(1, None, "BTTS", "YES", None, None, "BTTS_YES", 2.0, True), (2, 5, "BTTS", "YES", None, None, "BTTS_YES", None, True)], "id long, match_id long, market string, selection string, line double, problem string, category string, odds double, has_run boolean")
    coverage = spark.createDataFrame([(5, True, True)], "match_id long, covered boolean, resolved boolean")
    none = spark.createDataFrame([], "id long, match_id long, market string, selection string, line double, p double, odd double, availability string, revised double")
    why = spark.createDataFrame([], "id long, category string, reason string")
    got = {r["id"]: (r["support"], r["reason"]) for r in publication.supported_populars(popular, coverage, none, none, why).collect()}
    assert got == {1: ("UNRESOLVED", "POPULAR_MATCH_UNRESOLVED"), 2: ("MODEL_DATA_UNAVAILABLE", "MODEL_PREDICTION_UNAVAILABLE")}


def test_a_bulletin_of_many_levels_is_walked_in_few_stages(spark, monkeypatch):
    """Levels are gone down in one stage, and no level asks for the schema of a whole subtree."""
    written = []
    monkeypatch.setattr(bulletin_tree, "checkpointed", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or checkpointed(df))
    event = '{"i":%d,"hn":"a","an":"b","ci":1,"d":5,"m":[{"i":1,"o":[{"no":1,"n":"x","odd":1.5}]}]}'
    body = '{"a":' * 9 + "[" + event % 1 + ',[3,null,"{",' + event % 2 + "]]" + "}" * 9
    docs = bulletin_tree.documents(spark.createDataFrame([(1, body), (2, "[" + event % 3 + "]")], "k long, b string"), "k", "b")
    got = bulletin_tree.walk(docs, F.try_variant_get("node", "$.hn", "string").isNotNull(), ["competitions"])
    assert sorted(r[0] for r in got.select(F.try_variant_get("node", "$.i", "bigint")).collect()) == [1, 2, 3]
    assert len(written) <= 4 and not any("SchemaOfVariant" in plan for plan in written)


def test_tilt_keeps_no_rows_in_tasks(spark, monkeypatch):
    """The fit is aggregates over the rows, and the minimum of their penalised cost."""
    monkeypatch.setattr(joint, "together", None)
    rng = np.random.default_rng(4)
    cells, seen = rng.dirichlet([3, 2, 2, 3], 400), rng.choice(4, 400, p=[0.15, 0.2, 0.25, 0.4])
    rows = spark.createDataFrame([(i, c.tolist(), int(x)) for i, (c, x) in enumerate(zip(cells, seen))], "id long, cells array<double>, cell int")
    out = joint.fit_tilt(rows).first()
    over, both = np.array([0, 0, 1, 1.0]), np.array([0, 1, 0, 1.0])

    def cost(o, b):
        p = cells * np.exp(o * over + b * both)
        return -np.log(p[np.arange(400), seen] / p.sum(axis=1)).mean() + joint.SHRINK * (o * o + b * b)

    best = cost(out["over"], out["both"])
    assert out["n"] == 400 and all(best < cost(out["over"] + x, out["both"] + y) for x, y in ((1e-4, 0), (-1e-4, 0), (0, 1e-4), (0, -1e-4)))
    assert tuple(joint.fit_tilt(rows.limit(0)).first()) == (0.0, 0.0, 0)
