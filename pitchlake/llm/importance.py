"""Data selection by importance resampling over hashed n-grams (bags of buckets of the target and of the raw documents).

Each task opens a DuckDB connection and runs one SQL statement on every Arrow batch that Spark hands it: words are unnested,
windows make runs of up to three of them, and a registered function gives each run's zlib CRC, of which the bucket is the
remainder. Spark writes what comes back, a document's buckets (each as often as it occurs), as Parquet in the shared folder;
everything after reads that table: Spark merges bucket counts over all documents and over the target, turns them into gains,
and sums the gains of each document's buckets. Texts are read once and never shuffled; what the second pass holds is one
array of ``BUCKETS`` gains.

A document's score is its log importance weight plus Gumbel noise that depends on the seed and its id alone, so the highest
scores are a sample without replacement in proportion to the weights, and reruns agree. Ranks come from one range shuffle of
narrow rows; no task sees all of them.

Defined results: null text has no words; documents without words weigh 0; a null id counts as the empty string in the noise
and is the smallest in ties; repeated rows are rows of their own, with equal scores and ranks of their own, next to each
other; an empty target or table leaves gains that follow from counts of 0; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import warnings
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.storage import durable, numbered, tidy

BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Bytes of text that DuckDB gets at a time (one text at least), and the memory after which it spills.
BATCH_BYTES = 4 << 20
MEMORY = "400MB"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS = f"""
WITH split AS (
  SELECT nth, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM batch
), words AS (
  SELECT nth, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), runs AS (
  SELECT nth, word AS one, one || ' ' || lead(word) OVER d AS two, two || ' ' || lead(word, 2) OVER d AS three
  FROM words WINDOW d AS (PARTITION BY nth ORDER BY pos)
), grams AS (
  SELECT nth, unnest([one, two, three]) AS gram FROM runs
), found AS (
  SELECT nth, list(CAST(crc32(gram) % {{buckets}} AS USMALLINT)) AS buckets FROM grams WHERE gram IS NOT NULL GROUP BY nth
)
SELECT split.nth, len(words) AS n_words, buckets FROM split LEFT JOIN found USING (nth) ORDER BY split.nth
"""


def crc32(strings: pa.Array) -> pa.Array:
    """zlib's CRC of each string's UTF-8, read from Arrow's buffers without making Python strings."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    wide = pa.types.is_large_string(strings.type)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype="i8" if wide else "i4")[strings.offset : strings.offset + len(strings) + 1]
    raw = memoryview(data or b"")[ends[0] :]
    ends = (ends - ends[0]).tolist()
    crc = zlib.crc32
    return pa.array(np.array([crc(raw[a:b]) for a, b in zip(ends, ends[1:])], dtype="u4"))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        con.create_function("crc32", crc32, [duckdb.sqltypes.VARCHAR], duckdb.sqltypes.UINTEGER, type="arrow")
    return con


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows of about ``BATCH_BYTES``."""
    sizes = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(batch.column("text")).to_pylist()])
    begin = 0
    while begin < batch.num_rows:
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def features(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, buckets): a written row a document; ``buckets`` are unsigned 16-bit integers, one a feature."""
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill:  # DuckDB's own, for this task alone
            con = connect(os.path.join(spill, "duckdb"))
            for batch in (p for b in batches for p in _portions(b)):
                rows = pa.table({"nth": pa.array(np.arange(batch.num_rows)), "text": batch.column("text")})
                con.register("batch", rows)
                found = con.sql(GRAMS.format(buckets=buckets)).to_arrow_table().combine_chunks()
                con.unregister("batch")
                lists = found.column("buckets").combine_chunks()
                values = np.asarray(lists.flatten(), dtype="<u2")
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int64") * 2
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])
                yield pa.record_batch(
                    [batch.column("id"), found.column("n_words").combine_chunks().cast(pa.int64()), blobs.cast(pa.binary())],
                    ["id", "n_words", "buckets"],
                )
            con.close()

    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return durable(docs.mapInArrow(tidy(work), f"id {kind}, n_words long, buckets binary"))


def totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``features``: counted in each task, then merged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype="int64")
        for batch in batches:
            for blob in batch.column("buckets"):
                n += np.bincount(np.frombuffer(blob.as_buffer(), "<u2"), minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.record_batch([pa.array(met), pa.array(n[met])], ["bucket", "n"])

    counted = found.select("buckets").mapInArrow(tidy(work), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share in the documents; one row a bucket."""
    spark = docs.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    for side, name in ((docs, "s"), (target, "t")):
        both = both.join(totals(side, buckets).withColumnRenamed("n", name), "bucket", "left")
    rows = durable(both.fillna(0, ["s", "t"]))
    sums = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")
    out = np.zeros(buckets, dtype="int64")
    for row in rows.join(F.broadcast(sums)).select("bucket", gain).collect():  # `buckets` rows, joined with one
        out[row["bucket"]] = row["gain"]
    return out


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight)."""
    kind = found.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(b.as_buffer(), "<u2") for b in batch.column("buckets")]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("n_words"),
                    pa.array([len(b) for b in each], pa.int64()),
                    pa.array([int(gain[b].sum()) for b in each], pa.int64()),
                ],
                ["id", "n_words", "n_features", "weight"],
            )

    return found.mapInArrow(tidy(work), f"id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank), a row a document; ``rank`` is null for those that are not drawn."""
    found = features(docs, id_col, text_col, buckets)
    wanted = features(target.withColumn("_none", F.lit(0)), "_none", target_text, buckets)
    weighed = weigh(found, gains(found, wanted, buckets))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumns({"score": F.col("weight") + noise, "eligible": F.col("n_words") >= least_words, "_row": F.monotonically_increasing_id()})
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("id"), F.asc("_row")]
    placed = numbered(scored, order, "_nth")
    drawn = placed.filter("eligible").count() * percent // 100
    rank = F.when(F.col("_nth") < drawn, F.col("_nth") + 1).alias("rank")
    return placed.select("id", "n_features", "weight", "score", rank)
