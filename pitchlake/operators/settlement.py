"""Tickets: legs, accumulators, systems, series, financial summaries, streaks and drawdown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import expressions as E


def settle_accumulators(legs: DataFrame, stake_cents: int) -> DataFrame:
    """Any lost leg loses, any pending leaves open, all void refund, else won; void legs drop out of the product."""
    state = F.col("state")
    agg = legs.groupBy("coupon").agg(
        F.count("*").alias("legs"),
        F.max((state == "LOST").cast("int")).alias("lost"),
        F.max((state == "PENDING").cast("int")).alias("pending"),
        F.min((state == "VOID").cast("int")).alias("void"),
        F.product(F.when(state == "VOID", 1.0).otherwise(F.col("odd"))).alias("odd"),
    )
    result = (
        F.when(F.col("lost") == 1, "LOST").when(F.col("pending") == 1, "UNSETTLED").when(F.col("void") == 1, "VOID").otherwise("WON")
    )
    return agg.select("coupon", "legs", result.alias("result"), F.round("odd", 8).alias("odd")).withColumn(
        "payout_cents",
        F.when(F.col("result") == "WON", E.payout_cents(F.lit(stake_cents), F.col("odd")))
        .when(F.col("result") == "VOID", F.lit(stake_cents).cast("long"))
        .when(F.col("result") == "LOST", F.lit(0).cast("long")),
    )


#: Sizes of the columns of a system, by its number of legs; other numbers make no system.
SYSTEMS = {6: (5, 6), 7: (5, 6, 7)}
NO_SYSTEM = "INVALID_SYSTEM_SELECTION_COUNT"


def system_columns(legs: DataFrame, systems: dict[int, tuple] = SYSTEMS) -> DataFrame:
    """(coupon, column, size, odd, state): every subset of a coupon's legs of the sizes that its number of legs allows.

    A coupon of another number of legs gives one row without a column, whose state says so. Subsets are bit masks over the
    legs in order; those of a number of legs are a constant, so that a coupon is multiplied by its columns only.
    """
    packed = legs.groupBy("coupon").agg(F.array_sort(F.collect_list(F.struct("leg", "odd", "state"))).alias("legs"))
    masks = F.array().cast("array<int>")
    for n, sizes in systems.items():
        chosen = [m for m in range(1, 1 << n) if m.bit_count() in sizes]
        masks = F.when(F.size("legs") == n, F.array(*[F.lit(m) for m in chosen])).otherwise(masks)
    cols = packed.select("coupon", "legs", F.explode_outer(masks).alias("column"))
    cols = cols.withColumn("c", F.expr("filter(legs, (x, i) -> shiftright(`column`, i) & 1 = 1)"))
    odd = F.aggregate("c", F.lit(1.0), lambda a, x: a * F.when(x["state"] == "VOID", 1.0).otherwise(x["odd"]))
    state = (
        F.when(F.col("column").isNull(), NO_SYSTEM)
        .when(F.exists("c", lambda x: x["state"] == "LOST"), "LOST")
        .when(F.exists("c", lambda x: x["state"] == "PENDING"), "UNSETTLED")
        .when(F.forall("c", lambda x: x["state"] == "VOID"), "VOID")
        .otherwise("WON")
    )
    some = F.col("column").isNotNull()
    size = F.when(some, F.bit_count(F.coalesce("column", F.lit(0))))
    return cols.select("coupon", "column", size.alias("size"), F.when(some, F.round(odd, 8)).alias("odd"), state.alias("state"))


def settle_systems(columns: DataFrame, unit_cents: int) -> DataFrame:
    """Per coupon: columns by state, stake, payout and the most it could pay; a void column pays its unit back. No system, no
    money."""
    state, some = F.col("state"), F.col("column").isNotNull()
    full = E.payout_cents(F.lit(unit_cents), F.col("odd"))
    pay = F.when(state == "WON", full).when(state == "VOID", F.lit(unit_cents)).when(some, 0)
    of = lambda s: F.sum((state == s).cast("long"))
    return columns.groupBy("coupon").agg(
        F.count("column").alias("columns"),
        of("WON").alias("won"),
        of("LOST").alias("lost"),
        of("VOID").alias("void"),
        F.sum(F.when(some, F.lit(unit_cents).cast("long"))).alias("stake_cents"),
        F.sum(pay.cast("long")).alias("payout_cents"),
        F.sum(F.when(some, full)).alias("most_cents"),
        F.max(F.when(state == NO_SYSTEM, NO_SYSTEM)).alias("reason"),
    )


def system_summary(systems: DataFrame) -> DataFrame:
    """One row: systems, settled ones, their columns by state and their money."""
    stake, gross = F.sum("stake_cents"), F.sum("payout_cents")
    return systems.agg(
        F.count("*").alias("systems"),
        F.count("stake_cents").alias("settled"),
        *[F.sum(c).alias(c) for c in ("columns", "won", "lost", "void")],
        stake.alias("stake_cents"),
        gross.alias("gross_cents"),
        (gross - stake).alias("profit_cents"),
        F.round(F.try_divide(gross - stake, stake), 8).alias("roi"),
    )


def combinations(legs: DataFrame, most: int = 256) -> DataFrame:
    """(coupon, size, ids, odd, quality): pairs and triples of a pool's legs on different matches, in the order of their ids.

    A pool above ``most`` legs is not searched: it gives one row of size 0. A pool one of whose pairs is exactly the target
    has no triples.
    """
    one = Window.partitionBy("coupon", "leg").orderBy("odd", "match_id", "score")
    pool = legs.filter("odd > 1 AND odd < double('infinity')").withColumn("_nth", F.row_number().over(one)).filter("_nth = 1")
    pool = pool.select("coupon", "leg", "match_id", "odd", "score", F.count("*").over(Window.partitionBy("coupon")).alias("_n"))
    over = pool.filter(F.col("_n") > most).select("coupon").distinct()
    packed = pool.filter(F.col("_n") <= most).groupBy("coupon").agg(
        F.array_sort(F.collect_list(F.struct("leg", "match_id", "odd", "score"))).alias("p")
    )
    first = packed.select("coupon", "p", F.posexplode("p").alias("i", "a"))
    second = first.select("coupon", "p", "a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("b"), F.expr("array_position(p, a)").alias("i"))
    second = second.withColumn("j", F.expr("array_position(p, b)")).filter("a.match_id <> b.match_id")
    pairs = second.select(
        "coupon", F.lit(2).alias("size"), F.array("a.leg", "b.leg").alias("ids"), (F.col("a.odd") * F.col("b.odd")).alias("odd"),
        ((F.col("a.score") + F.col("b.score")) / 2).alias("quality"),
    )
    third = second.select("coupon", "a", "b", F.explode(F.expr("slice(p, int(j) + 1, size(p))")).alias("c"))
    third = third.filter("c.match_id <> a.match_id AND c.match_id <> b.match_id")
    triples = third.select(
        "coupon", F.lit(3).alias("size"), F.array("a.leg", "b.leg", "c.leg").alias("ids"), (F.col("a.odd") * F.col("b.odd") * F.col("c.odd")).alias("odd"),
        ((F.col("a.score") + F.col("b.score") + F.col("c.score")) / 3).alias("quality"),
    )
    exact = pairs.filter(F.abs(F.col("odd") - TARGET) < SLACK).select("coupon").distinct()
    none = over.select("coupon", F.lit(0).alias("size"), F.array().cast(pairs.schema["ids"].dataType).alias("ids"), F.lit(None).cast("double").alias("odd"), F.lit(None).cast("double").alias("quality"))
    return pairs.unionByName(triples.join(exact, "coupon", "left_anti")).unionByName(none)


#: The product of odds that a compound coupon aims at, the range that it must be in, and how far a product may be off.
TARGET, LOW, HIGH, SLACK = 1.8, 1.5, 1.8, 1e-9


def best_combination(found: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Of each pool the combination in range that is exactly the target, else from 1.75 on, else any; of these the best mean
    score, then the largest product, then the first."""
    within = found.filter(F.col("odd").between(low - SLACK, high + SLACK))
    tier = F.when(F.abs(F.col("odd") - TARGET) < SLACK, 2).when(F.col("odd") >= 1.75, 1).otherwise(0)
    w = Window.partitionBy("coupon").orderBy(F.desc(tier), F.desc("quality"), F.desc("odd"), "size", "ids")
    return within.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def nearest_targets(found: DataFrame, targets: tuple = (1.5, 1.6, 1.7, 1.8)) -> DataFrame:
    """(coupon, target, size, ids, odd): the combination whose product is nearest to each target; the first of equals."""
    rows = found.filter("size > 0").withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    w = Window.partitionBy("coupon", "target").orderBy(F.abs(F.col("odd") - F.col("target")), "size", "ids")
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select("coupon", "target", "size", "ids", "odd")


#: Legs that are sorted in one task.
TASK_LEGS = 500_000


def _dealt(legs: DataFrame) -> DataFrame:
    """``legs`` by coupon, in as many tasks as keep each near ``TASK_LEGS`` where the session's number of them is too small."""
    tasks = -(-legs.count() // TASK_LEGS)
    return legs.repartition(tasks, "coupon") if tasks > int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else legs


def validate_selections(legs: DataFrame, low: float = 1.10, high: float = 1.50) -> DataFrame:
    """(coupon, kind, legs, error): why a set of legs is no coupon of its kind, or null.

    The first leg, in order, whose match the coupon has already names the conflict, by its market and that of the match's
    first leg; then numbers of legs and the product's bounds. Both windows sort in tasks whose number grows with the legs.
    """
    order = ["leg", "odd", "match_id", "line"]
    rows = _dealt(legs.select("coupon", "kind", *order, "market")).withColumn("_nth", F.row_number().over(Window.partitionBy("coupon").orderBy(*order)))
    same = Window.partitionBy("coupon", "match_id").orderBy("_nth")
    rows = rows.withColumns({"_again": F.row_number().over(same), "_market": F.first("market").over(same), "_line": F.first("line").over(same)})
    x, y = F.col("market"), F.col("_market")
    other_line = ~F.col("line").eqNullSafe(F.col("_line"))
    goals, btts, corners = (lambda c: c == "TOTAL_GOALS"), (lambda c: c == "BTTS"), (lambda c: c == "FULL_TIME_TOTAL_CORNERS")
    conflict = (
        F.when(goals(x) & goals(y) & other_line, "NESTED_TOTAL_CONFLICT")
        .when((btts(x) & goals(y)) | (goals(x) & btts(y)), "BTTS_GOALS_CONFLICT")
        .when(corners(x) & corners(y) & other_line, "NESTED_CORNERS_CONFLICT")
        .otherwise("SAME_MATCH_CONFLICT")
    )
    rows = rows.withColumn("_conflict", F.when(F.col("_again") > 1, F.struct(F.col("_nth"), conflict.alias("name"))))
    agg = rows.groupBy("coupon", "kind").agg(F.count("*").alias("legs"), F.min("_conflict").alias("c"), F.product("odd").alias("odd"))
    n = F.col("legs")
    compound, system = F.col("kind") == "DAILY_COMPOUND", F.col("kind") == "DAILY_SURPRISE_SYSTEM"
    error = (
        F.when(F.col("c").isNotNull(), F.col("c.name"))
        .when(system & ~n.isin(*SYSTEMS), NO_SYSTEM)
        .when(compound & ~n.between(2, 3), "INVALID_COMPOUND_SELECTION_COUNT")
        .when(compound & (F.col("odd") + SLACK < low), "COMPOUND_ODDS_BELOW_MINIMUM")
        .when(compound & (F.col("odd") - SLACK > high), "COMPOUND_ODDS_ABOVE_MAXIMUM")
    )
    return agg.select("coupon", "kind", "legs", error.alias("error"))


def rule_compliant(legs: DataFrame, current: Column | None = None) -> DataFrame:
    """(coupon, kind, compliant): the number of legs its kind asks for, distinct matches, odds above 1, a compound's product.

    ``current`` tells the coupons of the present policy, all if not given; totals of older ones needed five legs at least."""
    n, kind = F.count("*"), F.col("kind")
    recent = F.bool_and(F.lit(True) if current is None else F.coalesce(current, F.lit(False)))
    count = (
        F.when(kind == "DAILY_CORNERS", n.between(5, 7))
        .when(kind.isin("DAILY_OVER_25", "DAILY_OVER_35"), F.when(recent, n.between(3, 5)).otherwise(n >= 5))
        .when(kind.isin("DAILY_BTTS", "DAILY_HIGH_CONFIDENCE"), n >= 5)
        .when(kind == "DAILY_COMPOUND", n.between(2, 3) & F.product("odd").between(LOW - SLACK, HIGH + SLACK))
        .when(kind == "DAILY_SURPRISE_SYSTEM", n.between(6, 7))
        .otherwise(F.lit(False))
    )
    priced = F.min(F.coalesce((F.col("odd") > 1) & (F.col("odd") < float("inf")), F.lit(False)).cast("int")) == 1
    return legs.groupBy("coupon", "kind").agg((count & priced & (F.countDistinct("match_id") == n)).alias("compliant"))


# The daily coupons, the category each draws on, and the most and the fewest legs it takes.
DAILY_COUPONS = [
    ("DAILY_CORNERS", "CORNERS", 7, 5),
    ("DAILY_OVER_25", "OVER_25", 5, 3),
    ("DAILY_OVER_35", "OVER_35", 5, 3),
    ("DAILY_BTTS", "BTTS_YES", 7, 5),
    ("DAILY_HIGH_CONFIDENCE", "HIGH_CONFIDENCE", None, 5),
    ("DAILY_SURPRISE_SYSTEM", "SURPRISE", 7, 6),
]


COMPOUND = "DAILY_COMPOUND"


def compound_coupons(candidates: DataFrame) -> DataFrame:
    """(day, kind, legs, _ids, odd): the best combination of each day's compound candidates; its legs in rank order."""
    rows = candidates.filter("rank IS NOT NULL AND category = 'COMPOUND'")
    pool = rows.select(F.col("day").alias("coupon"), F.col("id").alias("leg"), "match_id", "odd", "score")
    best = best_combination(combinations(pool)).select(F.col("coupon").alias("day"), F.explode("ids").alias("id"))
    legs = best.join(rows.select("day", "id", "rank", "odd"), ["day", "id"]).groupBy("day")
    ids = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("nth"), "id"))).alias("_ids")
    return legs.agg(F.count("*").alias("legs"), ids, F.round(F.product("odd"), 6).alias("odd")).withColumn("kind", F.lit(COMPOUND))


def daily_coupons(candidates: DataFrame, target: float = 3.0, least: int = 5) -> DataFrame:
    """(day, kind, state, reason, legs, ids, odd, target_reached) for every day of ``candidates`` and every kind of coupon.

    Legs are taken in rank order, up to the kind's most; high confidence in the order of probability, until the product of
    the legs reaches ``target`` with at least ``least`` of them; a compound is the best pair or triple in its range. Too few
    legs, or no such combination: no coupon, and the reason. Candidates are of distinct matches, so no two legs conflict.
    """
    kinds = F.create_map(*[F.lit(x) for kind, category, _, _ in DAILY_COUPONS for x in (category, kind)])
    rows = candidates.filter("rank IS NOT NULL").withColumn("kind", kinds[F.col("category")]).filter("kind IS NOT NULL")
    free = F.col("kind") == "DAILY_HIGH_CONFIDENCE"
    order = Window.partitionBy("day", "kind").orderBy(F.when(free, -F.col("p")).otherwise(F.col("rank").cast("double")), F.when(free, F.col("id")).otherwise(F.lit(0)))
    rows = rows.withColumns({"nth": F.row_number().over(order), "_before": F.coalesce(F.sum(F.log("odd")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    most = F.create_map(*[F.lit(x) for kind, _, top, _ in DAILY_COUPONS for x in (kind, top or 1 << 30)])
    few = F.create_map(*[F.lit(x) for kind, _, _, low in DAILY_COUPONS for x in (kind, low)])
    open_ = (F.col("nth") <= least) | (F.col("_before") < math.log(target) - SLACK)
    taken = rows.filter((F.col("nth") <= most[F.col("kind")]) & (~free | open_))
    made = taken.groupBy("day", "kind").agg(
        F.count("*").alias("legs"), F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("_ids"), F.round(F.product("odd"), 6).alias("odd")
    )
    made = made.filter(F.col("legs") >= few[F.col("kind")]).unionByName(compound_coupons(candidates))
    every = candidates.select("day").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in [*[k for k, *_ in DAILY_COUPONS], COMPOUND]])))
    out = every.join(made, ["day", "kind"], "left")
    there = F.col("legs").isNotNull()
    reason = F.when(F.col("kind") == "DAILY_SURPRISE_SYSTEM", "INSUFFICIENT_QUALIFIED_SURPRISE_SELECTIONS").when(F.col("kind") == COMPOUND, "NO_QUALIFYING_COMPOUND_COUPON").otherwise("INSUFFICIENT_QUALIFIED_CANDIDATES")
    return out.select(
        "day",
        "kind",
        F.when(there, "GENERATED").otherwise("UNAVAILABLE").alias("state"),
        F.when(~there, reason).alias("reason"),
        "legs",
        F.array_join(F.transform("_ids", lambda x: x["id"].cast("string")), ",").alias("ids"),
        "odd",
        F.when(there, (F.col("kind") == "DAILY_HIGH_CONFIDENCE") & (F.col("odd") >= target)).alias("target_reached"),
    )


def running_product(legs: DataFrame, target: float, least: int, order: list[str]) -> DataFrame:
    """Legs taken in order while the product before them is under ``target``, at least ``least`` of them.

    Log sums of at most a few dozen odds; the product of the legs before each leg decides.
    """
    before = Window.partitionBy("coupon").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    product = F.coalesce(F.exp(F.sum(F.log("odd")).over(before)), F.lit(1.0))
    nth = F.row_number().over(Window.partitionBy("coupon").orderBy(*order))
    rows = legs.withColumn("before", F.round(product, 6)).withColumn("nth", nth)
    return rows.filter((F.col("before") < target) | (F.col("nth") <= least)).select("coupon", "leg", "nth", "before")


def streaks(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Longest run of WON and of LOST; VOID neither extends nor breaks one."""
    rows = df.filter(F.col("state").isin("WON", "LOST"))
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(1))
    runs = rows.withColumn("_run", F.sum(changed).over(w)).groupBy(key, "_run", "state").count()
    longest = lambda s: F.coalesce(F.max(F.when(F.col("state") == s, F.col("count"))), F.lit(0))
    return runs.groupBy(key).agg(longest("WON").alias("longest_win"), longest("LOST").alias("longest_loss"))


def drawdown(df: DataFrame, key: str, order: list[str], profit: str = "profit") -> DataFrame:
    """Final balance and the largest fall from a peak; the peak starts at zero."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_balance", F.sum(profit).over(w))
    rows = rows.withColumn("_peak", F.greatest(F.max("_balance").over(w), F.lit(0.0)))
    return rows.groupBy(key).agg(
        F.round(F.sum(profit), 6).alias("balance"), F.round(F.max(F.col("_peak") - F.col("_balance")), 6).alias("max_drawdown")
    )


def cycles(df: DataFrame, key: str, order: list[str], step: str = "step") -> DataFrame:
    """Progression cycles: one starts where the step is 1; (key, cycle, steps, reached, profit)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("cycle", F.sum((F.col(step) == 1).cast("long")).over(w))
    return rows.groupBy(key, "cycle").agg(
        F.count("*").alias("steps"), F.max(step).alias("reached"), F.round(F.sum("profit"), 6).alias("profit")
    )


def series_fold(df: DataFrame, key: str, order: list[str], steps: int = 7) -> DataFrame:
    """State of a progressive series after all its results: WON moves a step up, LOST resets, VOID stays, a won last step
    resets. The step after a row counts the wins since the last loss, so the fold is a running count: no row depends on
    another's decision.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.sum((F.col("state") == "LOST").cast("long")).over(w))
    blocks = rows.groupBy(key, "_block").agg(F.sum((F.col("state") == "WON").cast("long")).alias("_wins"))
    last = F.max(F.struct("_block", "_wins")).getField("_wins")
    return blocks.groupBy(key).agg(
        (last % steps + 1).alias("step"),
        F.sum(F.floor(F.col("_wins") / steps)).alias("completed"),
        F.max("_block").alias("resets"),
    )


def coupon_summary(coupons: DataFrame, by: list[str | Column], stake_cents: int, order: list[str] | None = None) -> DataFrame:
    """Counts, hit rate over decided coupons, stake, gross, profit and return; no stake, no return. With an ``order``, also the
    longest runs of WON and LOST in it; VOID neither extends nor breaks one."""
    won, lost, void = (F.sum((F.col("result") == r).cast("long")) for r in ("WON", "LOST", "VOID"))
    decided = F.col("result").isin("WON", "LOST", "VOID")
    stake = F.sum(F.when(decided, F.lit(stake_cents)).otherwise(0).cast("long"))
    gross = F.sum(F.coalesce("payout_cents", F.lit(0)))
    named = {f"_by{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(by)}
    rows = coupons.withColumns(named)
    out = rows.groupBy(*named).agg(
        F.count("*").alias("coupons"),
        F.sum(decided.cast("long")).alias("settled"),
        won.alias("won"),
        lost.alias("lost"),
        void.alias("void"),
        F.round(F.try_divide(won, won + lost), 8).alias("hit_rate"),
        stake.alias("stake_cents"),
        gross.alias("gross_cents"),
        (gross - stake).alias("profit_cents"),
        F.round(F.try_divide(gross - stake, stake), 8).alias("roi"),
        F.round(F.avg(F.when(decided, F.lit(stake_cents))), 8).alias("average_stake_cents"),
        F.round(F.avg(F.when(decided, F.col("odd"))), 8).alias("average_odd"),
    )
    if order:
        w = Window.partitionBy(*named).orderBy(*order)
        turns = rows.filter(F.col("result").isin("WON", "LOST"))
        turned = F.coalesce((F.lag("result").over(w) != F.col("result")).cast("int"), F.lit(1))
        runs = turns.withColumn("_run", F.sum(turned).over(w)).groupBy(*named, "_run", "result").count()
        longest = lambda r: F.max(F.when(F.col("result") == r, F.col("count")))
        found = runs.groupBy(*named).agg(longest("WON").alias("longest_win"), longest("LOST").alias("longest_loss"))
        same = F.lit(True)
        for name in named:
            same = same & F.col(f"o.{name}").eqNullSafe(F.col(f"f.{name}"))
        rest = [c for c in out.columns if c not in named]
        joined = out.alias("o").join(found.alias("f"), same, "left")
        out = joined.select(*[F.col(f"o.{c}") for c in out.columns], *[F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("longest_win", "longest_loss")])
        out = out.select(*named, *rest, "longest_win", "longest_loss")
    titles = [c if isinstance(c, str) else coupons.select(c).columns[0] for c in by]
    return out.withColumnsRenamed(dict(zip(named, titles)))
