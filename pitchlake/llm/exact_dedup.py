"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text is cut into chunks of ``CHUNK`` bytes. The hash of a chunk is ``sum(b[j] * B**j) mod P`` for two bases; hashes of
adjacent chunks compose as ``h(ab) = h(a) + B**len(a) * h(b)``, whatever the grouping; the chunks of one text are hashed and
composed where the text is, so its memory beside the text is one chunk's. Rows with equal fingerprint and length are then compared, chunk by chunk, with one
row of their group; a fingerprint that two different texts share is split by SHA-256 afterwards. So the result is exact
whatever the hash does.

Shuffles: one of (fingerprint, id) without texts, which partial aggregation shrinks for a hot group; one of the texts, whose
join has a single leader row a key, so that a hot group is split by Spark's skewed join; one of the copies' chunks. The
joins are merge joins at every size: fingerprints are never gathered for a broadcast.

Defined results: null text counts as empty; one output row per input row; the largest id of a group stays (null is the
smallest); where the row that stays is repeated with the same id, exactly one of the repeats stays; an empty table gives an
empty table; the input's other columns may bear any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.storage import durable

FINGERPRINT = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "n_bytes")])
PIECES = T.ArrayType(T.StructType([T.StructField("no", T.LongType()), T.StructField("piece", T.StringType())]))
CHUNK = 1 << 16
P = 2**31 - 1
BASES = (1_000_003, 741_103_597)


def _powers() -> list[np.ndarray]:
    out = []
    for base in BASES:
        row = np.ones(1, dtype=np.uint64)
        while len(row) < CHUNK:  # doubling: the second half is the first times base**len
            row = np.concatenate([row, row * np.uint64(pow(base, len(row), P)) % np.uint64(P)])
        out.append(row[:CHUNK])
    return out


_POWERS: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Both polynomial hashes of at most ``CHUNK`` bytes."""
    if not _POWERS:
        _POWERS.extend(_powers())
    data = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    # A term is under 2**39, and 2**16 of them under 2**55.
    return tuple(int(np.dot(data, p[: len(data)])) % P for p in _POWERS)


def compose(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """(h1, h2, length) of two adjacent stretches together."""
    shift = [pow(b, left[2], P) for b in BASES]
    return (left[0] + shift[0] * right[0]) % P, (left[1] + shift[1] * right[1]) % P, left[2] + right[2]


def fingerprint(text: str) -> tuple[int, int, int]:
    data = text.encode("utf-8", "surrogatepass")
    whole = (0, 0, 0)
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK]
        whole = compose(whole, (*chunk_hash(part), len(part)))
    return whole


@F.pandas_udf(FINGERPRINT)
def _fingerprints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fingerprint(t or "") for t in texts], columns=["h1", "h2", "n_bytes"], dtype="int64")


#: Numbered pieces of a text, for the comparison of copies.
@F.pandas_udf(PIECES)
def _pieces(texts: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"no": a // CHUNK, "piece": t[a : a + CHUNK]} for a in range(0, len(t), CHUNK)] for t in texts], dtype=object
    )


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(F.struct(*df.columns).alias("row"), df[id_col].alias("id"), text.alias("text")).withColumn(
        "fp", _fingerprints("text")
    )


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: id, fp, text_sha256, keep_id, group_size, kept."""
    hashed = _hashed(df, id_col, text_col)
    narrow = durable(hashed.select("id", "fp", F.sha2("text", 256).alias("text_sha256")))
    groups = narrow.groupBy("fp").agg(F.count("*").alias("n"), F.max("id").alias("leader"))
    shared = durable(groups.filter("n > 1").select("fp", "leader"))

    # Texts meet only here: every row of a shared fingerprint, cut into pieces, against those of the group's leader.
    copies = hashed.select("id", "text", "fp").join(shared.hint("merge"), "fp")
    pieces = copies.select("fp", (F.col("id").eqNullSafe(F.col("leader"))).alias("leads"), F.explode(_pieces("text")).alias("p"))
    pieces = durable(pieces.select("fp", "leads", "p.no", "p.piece"))
    leaders = pieces.filter("leads").groupBy("fp", "no").agg(F.min("piece").alias("expected"))
    differing = pieces.join(leaders.hint("merge"), ["fp", "no"], "left").filter(~F.col("piece").eqNullSafe(F.col("expected")))
    collided = differing.select("fp").distinct().withColumn("collided", F.lit(True))

    keyed = narrow.join(collided.hint("merge"), "fp", "left").withColumn("split", F.when(F.col("collided"), F.col("text_sha256")))
    sizes = keyed.groupBy("fp", "split").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    joined = keyed.alias("k").join(
        sizes.hint("merge").alias("s"), (F.col("k.fp") == F.col("s.fp")) & F.col("k.split").eqNullSafe(F.col("s.split"))
    )
    out = joined.select("k.id", "k.fp", "k.text_sha256", "s.keep_id", "s.group_size")
    # Repeats of the row that stays are the only rows a window must number.
    top = out.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    rest = out.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    one = Window.partitionBy("fp", "text_sha256").orderBy("id")
    return top.withColumn("kept", F.row_number().over(one) == 1).unionByName(rest)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns."""
    kept = durable(classes(df, id_col, text_col).filter("kept").select("id", "fp"))
    whole = _hashed(df, id_col, text_col).select("row", "id", "fp")  # the text travels once, in its row
    joined = whole.alias("w").join(
        kept.hint("merge").alias("k"), (F.col("w.fp") == F.col("k.fp")) & F.col("w.id").eqNullSafe(F.col("k.id"))
    )
    one = Window.partitionBy("w.fp", "w.id").orderBy(F.coalesce(F.col("w.row")[text_col], F.lit("")))
    return joined.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("row.*")
