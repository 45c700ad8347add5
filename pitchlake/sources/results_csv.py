"""Results files: header-mapped CSV, validated row by row; a bad row is an issue, never a failed file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import expressions as E

# Columns of a results file.
REQUIRED = ["Div", "Date", "HomeTeam", "AwayTeam"]
INTEGERS = ["FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*REQUIRED[:2], "Time", *REQUIRED[2:], *INTEGERS]])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file as text; rows of another width are kept, with nulls, and what Spark can't parse in ``corrupt``."""
    schema = T.StructType([*SCHEMA, T.StructField("corrupt", T.StringType())])
    return spark.read.csv(
        path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt", enforceSchema=False,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def integer(c: Column) -> Column:
    """Null if blank or malformed; ``malformed`` tells them apart."""
    return F.when(~blank(c), F.trim(c).try_cast("int"))


def malformed(c: Column) -> Column:
    return ~blank(c) & F.trim(c).try_cast("int").isNull()


def validate(rows: DataFrame, league: str, zone: str = "Europe/London") -> DataFrame:
    """Adds ``issue`` (null for a good row), integers, the instant in UTC and whether its time is known.

    Rows of another league are left out; a score pair must be whole or absent.
    """
    numbers = [c for c in INTEGERS if c in rows.columns]
    rows = rows.filter(F.upper(F.trim("Div")) == league.upper())
    kick, known = E.parse_kickoff(F.trim(F.col("Date")), F.col("Time") if "Time" in rows.columns else F.lit(None).cast("string"), zone)
    issue = F.when(blank(F.col("HomeTeam")) | blank(F.col("AwayTeam")), "MISSING_TEAM").when(kick.isNull(), "BAD_DATE")
    for c in numbers:
        issue = issue.when(malformed(F.col(c)), f"BAD_{c}")
    for a, b in (("FTHG", "FTAG"), ("HTHG", "HTAG")):
        if a in numbers and b in numbers:
            issue = issue.when(blank(F.col(a)) != blank(F.col(b)), f"HALF_PAIR_{a}_{b}")
    return rows.withColumns({"issue": issue, "kickoff_at": kick, "kickoff_known": known}).withColumns({c: integer(F.col(c)) for c in numbers})
