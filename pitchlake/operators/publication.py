"""Publication of daily runs: selected run, manifest, audit funnel, freeze rule, fingerprints and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.ranking import CATEGORIES


def selected_runs(pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """(day, run_id): the run each day shows. ``runs`` have run_id, day, context, status, populated, valid_lineup, parent,
    purpose and generated_at.

    The pointed run, if it is completed, has candidates and is a base run or a valid lineup run; else the best other base run
    of the day with candidates: its parent first, then live ones, newest first; else the pointed run, if it is a base run.
    """
    done = runs.filter("status = 'COMPLETED'")
    head = pointers.join(done, ["day", "run_id"])
    good = F.col("populated") & ((F.col("context") == "BASE") | F.col("valid_lineup"))
    head = head.select("day", F.col("run_id").alias("pointed"), F.col("parent").alias("own_parent"), "context", good.alias("good"))
    base = done.filter("context = 'BASE' AND populated").select("day", "run_id", "purpose", "generated_at")
    rest = head.join(base, "day").filter(F.coalesce(F.col("run_id") == F.col("own_parent"), F.lit(False)) | (F.col("purpose") == "LIVE"))
    parent_first = F.desc(F.coalesce(F.col("run_id") == F.col("own_parent"), F.lit(False)))
    w = Window.partitionBy("day").orderBy(parent_first, F.desc("generated_at"), F.desc("run_id"))
    rest = rest.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select("day", F.col("run_id").alias("fallback"))
    out = head.join(rest, "day", "left")
    chosen = F.when(F.col("good"), F.col("pointed")).otherwise(F.coalesce("fallback", F.when(F.col("context") == "BASE", F.col("pointed"))))
    return out.select("day", chosen.alias("run_id")).filter("run_id IS NOT NULL")


def manifest(selected: DataFrame, overlays: DataFrame, runs: DataFrame, category: str = "BTTS_YES") -> DataFrame:
    """(day, category, run_id): the selected run in every category, but for one that a newer completed overlay run shows.

    Days with an overlay and without a selected run show the overlay everywhere.
    """
    done = runs.filter("status = 'COMPLETED'").select("day", "run_id", "generated_at")
    base = selected.join(done, ["day", "run_id"]).select("day", F.col("run_id").alias("base"), F.col("generated_at").alias("base_at"))
    over = overlays.join(done, ["day", "run_id"]).join(base.select("day", "base_at"), "day", "left")
    over = over.filter(F.col("base_at").isNull() | (F.col("generated_at") >= F.col("base_at")))
    over = over.groupBy("day").agg(F.max(F.struct("id", "run_id")).getField("run_id").alias("overlay"))
    days = base.select("day", "base").join(over, "day", "full")
    rows = days.select("day", F.coalesce("base", "overlay").alias("base"), "overlay", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return rows.select("day", "category", F.when(F.col("category") == category, F.coalesce("overlay", "base")).otherwise(F.col("base")).alias("run_id"))


def btts_audit(fixtures: DataFrame, at: Column) -> tuple[Column, dict[str, Column]]:
    """(primary exclusion, stages): of a fixture's row with resolved, kickoff_known, supported, prediction_ready, p_yes, p_no,
    calibrated, odd_yes, captured_yes and rejection. A row has one exclusion, the first that applies."""
    c = F.col
    pair = F.abs(c("p_yes") + c("p_no") - 1) <= 1e-6
    there = c("prediction_ready")
    reason = (
        F.when(~there & ~c("resolved"), "RESOLUTION_FAILED")
        .when(~there & ~c("kickoff_known"), "KICKOFF_UNKNOWN")
        .when(~there, "MODEL_INPUT_MISSING")
        .when(c("p_yes").isNull() | c("p_no").isNull(), "PROBABILITY_MISSING")
        .when(~pair, "PAIR_SUM_INVALID")
        .when(c("odd_yes").isNull(), "ODDS_MISSING")
        .when(c("odd_yes") <= 1, "ODDS_INVALID")
        .when(c("captured_yes") < at - F.expr("interval '24' hour"), "ODDS_STALE")
        .when(c("rejection").isNotNull(), c("rejection"))
    )
    has = there & c("p_yes").isNotNull()
    stages = {
        "fixtures": F.lit(True),
        "resolved": c("resolved"),
        "kickoff_known": c("resolved") & c("kickoff_known"),
        "prediction_ready": there,
        "btts_probability": has,
        "calibrated_btts_probability": has & c("calibrated"),
        "public_btts_fallback": has & ~c("calibrated"),
        "pair_sum_failures": has & c("p_no").isNotNull() & ~pair,
        "current_matches_with_yes_odds": c("odd_yes").isNotNull(),
        "btts_odds": has & c("odd_yes").isNotNull(),
        "valid_yes_mapping": has & (c("odd_yes") > 1),
        "invalid_input_survivors": reason.isNull() | c("rejection").eqNullSafe(reason),
        "ranking_pool": reason.isNull(),
    }
    return reason, stages


def audit_counts(fixtures: DataFrame, at: Column) -> DataFrame:
    """(kind, name, n): how many fixtures reach each stage, and how many each reason stops."""
    reason, stages = btts_audit(fixtures, at)
    flags = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit("stage").alias("kind"), F.lit(name).alias("name"))) for name, test in stages.items()])
    why = F.array(F.when(reason.isNotNull(), F.struct(F.lit("exclusion").alias("kind"), reason.alias("name"))))
    rows = fixtures.select(F.explode(F.array_compact(F.concat(flags, why))).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def frozen(coupons: DataFrame, legs: DataFrame, at: Column) -> DataFrame:
    """Coupons that may still change: none of their legs has started by ``at``; compounds always may."""
    started = legs.filter(F.col("kickoff") <= at).select("coupon").distinct()
    free = coupons.filter("kind = 'DAILY_COMPOUND'")
    return coupons.filter("kind <> 'DAILY_COMPOUND'").join(started, "coupon", "left_anti").unionByName(free)


def published_coupons(coupons: DataFrame) -> DataFrame:
    """The newest coupon of each day and kind that is no draft."""
    w = Window.partitionBy("day", "kind").orderBy(F.desc("created_at"), F.desc("coupon"))
    return coupons.filter("status <> 'DRAFT'").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def lineup_impact(base: DataFrame, revised: DataFrame) -> DataFrame:
    """(id, category, base_p, revised_p, points, change): candidates of two runs side by side, by prediction and category."""
    b = base.select("id", "category", F.col("p").alias("base_p"))
    r = revised.select("id", "category", F.col("p").alias("revised_p"))
    both = b.join(r, ["id", "category"], "full")
    change = F.when(F.col("base_p").isNull(), "NEWLY_QUALIFIED").when(F.col("revised_p").isNull(), "NO_LONGER_QUALIFIED").when(F.col("base_p") == F.col("revised_p"), "UNCHANGED").otherwise("STILL_QUALIFIED")
    return both.select("id", "category", "base_p", "revised_p", F.round(100 * (F.col("revised_p") - F.col("base_p")), 6).alias("points"), change.alias("change"))


def change_fingerprint(tables: dict[str, tuple[DataFrame, str]], by: str) -> DataFrame:
    """(by, fingerprint): SHA-256 over the row count and largest key of every table, by day: equal where nothing came in."""
    out = None
    for name, (df, key) in tables.items():
        part = df.groupBy(by).agg(F.concat_ws(":", F.lit(name), F.count("*").cast("string"), F.max(key).cast("string")).alias(f"_{name}"))
        out = part if out is None else out.join(part, by, "full")
    return out.select(by, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"_{n}"), F.lit(n)) for n in tables]), 256).alias("fingerprint"))


def restated(computed: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """Groups to compute anew: those whose history has another epoch than the one they were computed at, or none."""
    on = F.lit(True)
    for c in by:
        on = on & (F.col(f"h.{c}") == F.col(f"c.{c}"))
    joined = history.alias("h").join(computed.alias("c"), on, "left")
    return joined.filter(~F.col("h.epoch").eqNullSafe(F.col("c.epoch"))).select("h.*")


def with_metadata(df: DataFrame, column: str, sets: dict[str, Column], removes: list[str] = ()) -> DataFrame:
    """A JSON object column with keys set and removed; text that is no JSON object counts as an empty one."""
    old = F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    gone = F.array(*[F.lit(k) for k in [*sets, *removes]])
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(gone, k))
    new = F.create_map(*[x for k, v in sets.items() for x in (F.lit(k), v.cast("string"))]) if sets else F.create_map().cast("map<string,string>")
    return df.withColumn(column, F.to_json(F.map_concat(kept, new)))


def is_json(text: Column) -> Column:
    """Whether a text is a JSON value."""
    return F.try_parse_json(text).isNotNull()


def json_rows(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """(by, body): each group's rows as a JSON array of arrays, in order: the input of a fingerprint."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("cells")))).alias("r"))
    return rows.select(*by, F.to_json(F.transform("r", lambda x: x["cells"])).alias("body"))


#: Reasons of a rejection that say that data were missing, not that the policy was.
NO_DATA = ["ODDS_UNAVAILABLE", "STALE_ODDS", "MODEL_UNAVAILABLE"]


def supported_populars(popular: DataFrame, coverage: DataFrame, candidates: DataFrame, predictions: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(id, support, reason, source, candidate_id, p, odds, implied, edge, ev, qualified): what the day's run says of selections
    that are popular.

    ``popular``: id, match_id, market, selection, line, problem (null, MARKET_NOT_SUPPORTED or UNRESOLVED), category (null where no
    category holds the selection), odds, has_run. ``coverage``: match_id, covered, resolved. ``candidates`` and ``predictions``:
    id, match_id, market, selection, line, p, odd, with availability and revised (a lineup's p, or null) in the latter.
    ``exclusions``: id (of a prediction), category, reason.

    The first thing that stands in the way names the status: an unknown match, a competition that no model covers, teams that are
    not resolved, an unknown market or selection, no run. A candidate gives its probability at the popular price, else at its own;
    without one the prediction does, or a lineup's revision of it, and the reason why it is no candidate. Of several candidates
    or predictions of a selection the smallest id counts.
    """
    key = ["match_id", "market", "selection", "_line"]
    keyed = lambda df: df.withColumn("_line", F.coalesce(F.col("line").cast("double"), F.lit(-1.0)))
    first = lambda df, name, columns: keyed(df).groupBy(*key).agg(F.min_by(F.struct(*columns), "id").alias(name))
    held = first(candidates, "_c", ["id", "p", F.col("odd").alias("odds")])
    known = first(predictions, "_m", ["id", "p", "availability", "revised", F.col("odd").alias("odds")])
    rows = keyed(popular).join(coverage, "match_id", "left").join(held, key, "left").join(known, key, "left")
    why = exclusions.select(F.col("id").alias("_p"), "category", F.col("reason").alias("_why"))
    rows = rows.withColumn("_p", F.col("_m.id")).join(why, ["_p", "category"], "left")
    c = F.col
    bad = lambda odds: odds.isNotNull() & ~((odds > 1) & (odds < float("inf")))
    candidate, prediction = c("_c.id").isNotNull(), c("_m.id").isNotNull()
    price = F.coalesce("odds", "_c.odds")
    p = F.when(candidate, c("_c.p")).otherwise(F.coalesce("_m.revised", "_m.p"))
    ev = p * price - 1
    # (when, status, reason): the first that holds; a status of None is decided by the value of the candidate.
    steps = [
        (c("match_id").isNull(), "UNRESOLVED", "POPULAR_MATCH_UNRESOLVED"),
        (~F.coalesce("covered", F.lit(False)), "MODEL_UNSUPPORTED", "COMPETITION_OUTSIDE_MODEL_COVERAGE"),
        (~F.coalesce("resolved", F.lit(False)), "UNRESOLVED", "POPULAR_MATCH_UNRESOLVED"),
        (c("problem") == "MARKET_NOT_SUPPORTED", "MARKET_NOT_SUPPORTED", "POPULAR_MARKET_NOT_SUPPORTED"),
        (c("problem").isNotNull(), "UNRESOLVED", "POPULAR_SELECTION_UNRESOLVED"),
        (~c("has_run"), "MODEL_DATA_UNAVAILABLE", "CANDIDATE_RUN_UNAVAILABLE"),
        (candidate & bad(price), "INVALID_ODDS", "INVALID_ODDS"),
        (candidate & (ev > 0), "MODEL_SUPPORTED", None),
        (candidate, "MODEL_BELOW_POLICY", None),
        (~prediction, "MODEL_DATA_UNAVAILABLE", "MODEL_PREDICTION_UNAVAILABLE"),
        (bad(c("odds")), "INVALID_ODDS", "INVALID_ODDS"),
        (c("_m.availability") != "AVAILABLE", "MODEL_DATA_UNAVAILABLE", "MODEL_UNAVAILABLE"),
        (c("category").isNull(), "MODEL_NOT_SUPPORTED", "SELECTION_NOT_SUPPORTED_BY_POLICY"),
        (c("_why").isNull(), "MODEL_DATA_UNAVAILABLE", "CANDIDATE_CONTEXT_UNAVAILABLE"),
        (c("_why").isin(NO_DATA), "MODEL_DATA_UNAVAILABLE", c("_why")),
        (F.lit(True), "MODEL_BELOW_POLICY", c("_why")),
    ]
    step = F.coalesce(*[F.when(test, i) for i, (test, *_) in enumerate(steps)])
    at = lambda name: next(i for i, s in enumerate(steps) if s[2] is not None and not isinstance(s[2], Column) and s[2] == name)
    rows = rows.withColumn("_step", step)
    status = F.element_at(F.array(*[F.lit(s) for _, s, _ in steps]), c("_step") + 1)
    reason = F.element_at(F.array(*[F.lit(r).cast("string") if not isinstance(r, Column) else r for *_, r in steps]), c("_step") + 1)
    reached = c("_step") > at("CANDIDATE_RUN_UNAVAILABLE")
    modelled = reached & (candidate | prediction)
    # What is rejected by the policy alone is shown at the prediction's own price, if the popular one has none.
    last = c("_step") == len(steps) - 1
    shown = F.when(reached & candidate, price).when(last, F.coalesce("odds", "_m.odds")).otherwise(c("odds"))
    usable = F.when(last | ~bad(shown), shown)
    value = F.when(modelled, usable)
    qualified = F.when(reached & candidate & ~bad(price), ev > 0).when(status.isin("MODEL_NOT_SUPPORTED", "MODEL_BELOW_POLICY"), F.lit(False))
    source = F.when(reached & candidate, "CANDIDATE").when(modelled & (c("_step") > at("MODEL_PREDICTION_UNAVAILABLE") + 1), F.when(c("_m.revised").isNotNull(), "LINEUP").otherwise("BASE"))
    return rows.select(
        "id", status.alias("support"), reason.alias("reason"), source.alias("source"), F.when(reached, c("_c.id")).alias("candidate_id"), F.when(modelled, p).alias("p"), shown.alias("odds"),
        (1 / usable).alias("implied"), (F.when(modelled, p) - 1 / value).alias("edge"), (F.when(modelled, p) * value - 1).alias("ev"), qualified.alias("qualified"),
    )
