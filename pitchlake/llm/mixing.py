"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants ``rate = target / source_size`` copies. It surely gets the whole part; the fractional
parts are settled by the pivotal method, weighted by size: two documents with fractions p and q move mass between them, at
random and with the expectations unchanged, until one of them is 0 or 1. Moving ``d`` words of one to the other leaves the
words taken in total as they were, so a source ends within one document of its target.

Documents are dealt by a hash into groups of about ``LEAF`` rows of one source, which settle by themselves and leave one
unsettled document each. Those go up a tree of fan-in ``FAN_IN``, pair by pair, until one per source is left, which is drawn. A hot source
just has more groups. All draws are seeded by the group and rows sorted inside it: reruns agree.

Defined results: null text has size 0; documents of size 0 take 0 words; null is a source of its own, last in order; repeated
rows are documents of their own; an empty table gives an empty table; other columns may bear any name.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.storage import durable

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
LEAF = 2048
FAN_IN = 64
EPS = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last, with no task that sees them all."""
    ordered = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source")
    parts = durable(ordered.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition: its bound is the number of partitions, not the data.
    offsets = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy("_null", "source")
    return (
        parts.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(offsets, "_part")
        .withColumn("rank", F.col("_nth") + F.col("_before"))
        .drop("_null", "_part", "_nth", "_before", "count")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): shares by weight, cut at ``most`` times the source.

    The excess of cut sources is shared again among the rest until none is above. Each round sends three numbers to the
    driver; a round cuts at least one source, and in practice a few rounds cut all.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = durable(
        ranked(per_source).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    )
    capacity = F.col("source_size") * most
    budget = total * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, cut = None, -1
    while True:
        # A source is cut when its share at this level would pass its capacity.
        is_cut = F.lit(False) if level is None else F.col("weight") * level >= capacity
        row = table.agg(
            F.count(F.when(is_cut, 1)).alias("cut"),
            F.sum(F.when(is_cut, capacity)).alias("fixed"),
            F.sum(F.when(~is_cut, F.col("weight"))).alias("open"),
        ).first()
        if row["cut"] == cut or not row["open"]:
            break
        cut, level = row["cut"], (budget - (row["fixed"] or 0.0)) / row["open"]
    share = capacity if level is None else F.least(F.col("weight") * level, capacity)
    return table.select("source", "source_size", "n_docs", share.alias("target"))


def _settle(rows: list[tuple[int, float]], rng: random.Random) -> tuple[list[int], int | None, float]:
    """Pivotal rounding of (size, fraction) in order: 0/1 for each, but for one that may stay open with its fraction."""
    out = [0] * len(rows)
    held, p = None, 0.0
    for j, (size, q) in enumerate(rows):
        if q <= EPS or q >= 1 - EPS:
            out[j] = int(q > 0.5)
            continue
        if held is None:
            held, p = j, q
            continue
        ratio = size / rows[held][0]
        up, down = min(1 - p, ratio * q), min(p, ratio * (1 - q))
        if rng.random() * (up + down) < down:
            p, q = p + up, q - up / ratio
        else:
            p, q = p - down, q + down / ratio
        if EPS < p < 1 - EPS:
            out[j] = int(q > 0.5)
        else:
            out[held] = int(p > 0.5)
            held, p = j, q
            if q <= EPS or q >= 1 - EPS:
                out[j], held = int(q > 0.5), None
    return out, held, p


def _settle_equal(sizes: list[int], q: float, rng: random.Random) -> tuple[list[int], int | None, float]:
    """Pivotal rounding of documents that all have fraction ``q``, each against all after it: mass moves between the document
    and the rest, which keep equal fractions, until it is whole (or all of the rest are). With large ones first, what stays
    open at the end is one of the small ones, and the words taken are off by less than it has."""
    out, rest = [0] * len(sizes), sum(sizes)
    for i, size in enumerate(sizes):
        if q <= EPS or q >= 1 - EPS:
            return [*out[:i], *[int(q > 0.5)] * (len(sizes) - i)], None, 0.0
        rest -= size
        if not rest:
            return out, i, q
        up, down = min(1 - q, q * rest / size), min(q, (1 - q) * rest / size)
        if rng.random() * (up + down) < down:
            p, q = q + up, q - up * size / rest
        else:
            p, q = q - down, q + down * size / rest
        if EPS < p < 1 - EPS:
            return [*out[: i + 1], *[int(q > 0.5)] * (len(sizes) - i - 1)], i, p
        out[i] = int(p > 0.5)
    return out, None, 0.0


def _round(seed: int, level: int):
    def settle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "frac"], ascending=[False, True, True], kind="stable", na_position="last")
        rng = random.Random(f"{seed}|{level}|{key[0]}|{key[1]}")
        sizes, fractions = group["size"].tolist(), group["frac"].tolist()
        # Documents of one source begin with one fraction; those that are left open meet with different ones.
        out, held, p = _settle_equal(sizes, fractions[0], rng) if level == 0 else _settle(list(zip(sizes, fractions)), rng)
        group = group.assign(extra=out, open=False)
        if held is not None:
            group.iloc[held, group.columns.get_loc("open")] = True
            group.iloc[held, group.columns.get_loc("frac")] = p
        return group

    return settle


_STATE = "source string, cell long, id string, size long, frac double, whole long, extra long, open boolean"


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 20, **shares) -> DataFrame:
    """One narrow row per row of ``df``: id, source, size, source_size, target, copies, taken."""
    id_type = dict(df.dtypes)[id_col]
    sizes = durable(
        df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), size_of(df[text_col]).alias("size"))
    )
    plan = durable(targets(sizes, **shares))
    # Rows of one source are dealt by a hash of the id into as many cells as the source needs.
    cells = F.greatest(F.ceil(F.col("n_docs") / LEAF), F.lit(1))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    docs = (
        sizes.alias("d")
        .join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "d.source",
            F.pmod(F.xxhash64("id", "size", F.lit(seed)), cells).alias("cell"),
            F.col("id").cast("string").alias("id"),  # Python carries it and need not know its type
            "size",
            (rate - F.floor(rate)).alias("frac"),
            F.floor(rate).alias("whole"),
            F.lit(0).cast("long").alias("extra"),
            F.lit(True).alias("open"),
        )
    )
    done = [docs.filter("size = 0").withColumn("open", F.lit(False))]
    state, level = docs.filter("size > 0"), 0
    widest = plan.agg(F.max("n_docs")).first()[0] or 0
    groups = max(1, math.ceil(widest / LEAF))
    while True:
        state = durable(state.groupBy("source", "cell").applyInPandas(_round(seed, level), _STATE))
        done.append(state.filter("not open"))
        state, level = state.filter("open"), level + 1
        if groups == 1:
            break
        groups = math.ceil(groups / FAN_IN)
        state = state.withColumn("cell", F.floor(F.col("cell") / FAN_IN))
    # One document per source is still open: it is drawn with the probability it has left.
    draw = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    done.append(state.withColumn("extra", (draw < F.col("frac")).cast("long")))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return (
        settled.alias("s")
        .join(plan.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("s.id").cast(id_type).alias("id"),
            "s.source",
            "s.size",
            "t.source_size",
            "t.target",
            (F.col("whole") + F.col("extra")).alias("copies"),
            (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"),
        )
    )


def take_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as it is taken."""
    chosen = mix(df, id_col, source_col, text_col, **options)
    key = ["id", "source", "size"]
    copies = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("copies")))
    rows = df.select(
        F.struct(*df.columns).alias("row"),
        df[id_col].alias("id"),
        df[source_col].cast("string").alias("source"),
        size_of(df[text_col]).alias("size"),
        df[text_col].alias("text"),
    ).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("text")))
    on = F.lit(True)
    for c in [*key, "_nth"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    return (
        rows.alias("r")
        .join(copies.filter("copies > 0").alias("c"), on)
        .select("r.row", F.explode(F.array_repeat(F.lit(0), F.col("c.copies").cast("int"))))
        .select("row.*")
    )
