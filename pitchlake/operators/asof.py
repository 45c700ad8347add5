"""As-of joins, latest rows and change deduplication on snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; keys compare null-safely."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def asof_latest(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str, values: list[str]
) -> DataFrame:
    """``left`` with the values of the latest ``right`` row of its key at or before its time, the largest ``tie`` first.

    Both sides go through one shuffle by key and one sort; each row is read once, whatever the number of matches.
    """
    packed = F.struct(right_time, tie, *values)
    stream = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), packed.alias("_r"), F.lit(None).alias("_l"))
    asks = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), F.lit(None).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = stream.unionByName(asks).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in dict.fromkeys([right_time, tie, *values])])


def asof_two_sided(asks: DataFrame, quotes: DataFrame, keys: list[str], ask_time: str, hours: int = 24) -> DataFrame:
    """``asks`` with ``prior``, the fair probability of ``yes`` from the latest price of either side at the ask's time.

    ``quotes`` have columns side (yes or no), captured, id, provider and odd. A price counts if it is above 1 and at most
    ``hours`` old; the two sides must be one market: same provider, same time of capture. Else there is no prior. One pass:
    both sides' last prices are carried along one sort of quotes and asks.
    """
    price = F.struct("captured", "provider", "odd")
    stream = quotes.select(*keys, F.col("captured").alias("_t"), F.lit(0).alias("_is_ask"), F.col("id").alias("_tie"), "side", price.alias("_r"), F.lit(None).alias("_l"))
    both = asks.select(
        *keys, F.col(ask_time).alias("_t"), F.lit(1).alias("_is_ask"), F.lit(None).alias("_tie"), F.lit(None).alias("side"), F.lit(None).alias("_r"), F.struct(*asks.columns).alias("_l")
    ).unionByName(stream)
    w = Window.partitionBy(*keys).orderBy("_t", "_is_ask", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("_r")), ignorenulls=True).over(w)
    both = both.withColumns({"_yes": last("yes"), "_no": last("no")}).filter("_is_ask = 1")
    fresh = lambda x: (F.col(f"{x}.odd") > 1) & (F.col(f"{x}.captured") >= F.col("_t") - F.expr(f"interval '{hours}' hour"))
    one = (F.col("_yes.provider") == F.col("_no.provider")) & (F.col("_yes.captured") == F.col("_no.captured"))
    yes, no = 1 / F.col("_yes.odd"), 1 / F.col("_no.odd")
    return both.select("_l.*", F.when(fresh("_yes") & fresh("_no") & one, yes / (yes + no)).alias("prior"))


def metric_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest COUNT and latest RANK of each key and selection side by side, null-safely; either may lack."""
    latest = latest_per_key(rows, [*keys, "selection", "metric"], [F.desc("captured"), F.desc("id")])
    of = lambda metric: latest.filter(F.col("metric") == metric).alias(metric)
    on = F.lit(True)
    for c in [*keys, "selection"]:
        on = on & F.col(f"COUNT.{c}").eqNullSafe(F.col(f"RANK.{c}"))
    return of("COUNT").join(of("RANK"), on).select(*[F.col(f"COUNT.{c}") for c in [*keys, "selection"]], F.col("COUNT.value").alias("total"), F.col("RANK.value").alias("rank"))


def dedupe_changes(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows that differ from the row before them, null-safely; a key's first row stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.row_number().over(w) > 1
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    return df.withColumn("_same", same).filter("NOT _same").drop("_same")


def dedupe_with_heartbeat(df: DataFrame, keys: list[str], time: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Rows kept by a store that takes a row if its value differs from the last *kept* one or that is ``seconds`` old.

    One shuffle and sort by key, then one pass over Arrow batches that carries the last kept time. A run of equal values keeps
    its first row (its value differs from whatever was kept before); inside a run only time counts, so a batch jumps from kept
    row to kept row by bisection.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    wait = seconds * 1_000_000
    watched = [*keys, value]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = np.full(n, True)
            for c in watched:
                column = batch.column(c)
                head = column.slice(0, 1) if before is None else before.column(c)
                shifted = pa.concat_arrays([head, column.slice(0, n - 1)])
                equal = pa.compute.fill_null(pa.compute.equal(column, shifted), False)
                both_null = pa.compute.and_(column.is_null(), shifted.is_null())
                same &= pa.compute.or_(equal, both_null).to_numpy(zero_copy_only=False)
            same[0] &= before is not None
            at = batch.column(time).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~same)
            kept = ~same
            for begin, end in zip([0, *starts.tolist()], [*starts.tolist(), n]):
                if begin == end:
                    continue
                last, i = (last, begin) if same[begin] else (at[begin], begin + 1)
                while i < end and (i := i + int(np.searchsorted(at[i:end], last + wait))) < end:
                    kept[i], last, i = True, at[i], i + 1
            before = batch.slice(n - 1, 1)
            yield batch.filter(pa.array(kept))

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, time, tie)
    return ordered.mapInArrow(fold, df.schema)
