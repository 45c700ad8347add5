"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from pitchlake import catalog
from pitchlake.fixtures import frame
from pitchlake.operators import features, form

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v:.8g}" if isinstance(v, float) else str(v)

    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_popular_predictions_are_numbered_once(spark):
    """What reads them takes its own columns from a stored table: numbering deals out whole rows."""
    plan = QUERIES["supported_populars"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "stored-" in plan and "windowspecdefinition(id#" not in plan


def test_team_inputs_are_one_window(spark):
    matches = frame(spark, SF, "matches")
    form_of = form.trailing_form(matches, 5).select("id", "team", "ppm", "goals_for", "goals_against")
    kinds = {"shooting": {"shots_for": "shots", "on_target_for": "on_target"}, "corners": {"corners_for": "corners"}, "cards": {"yellow_for": "yellow"}, "fouls": {"fouls_for": "fouls"}}
    for kind, names in kinds.items():
        form_of = form_of.join(form.trailing_statistics(matches, kind, 5).selectExpr("id", "team", *[f"{a} AS {b}" for a, b in names.items()]), ["id", "team"])
    got = form.trailing_inputs(matches, 5)
    assert got.columns == form_of.columns
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain([tuple(r) for r in form_of.collect()], got.columns)
    plan = features.snapshots(matches)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") < 40
