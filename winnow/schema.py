"""Schemas of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _fields(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


POSTING = _fields(
    "id string, title string, company string, description string, url string, source string, salary_min int, salary_max int, salary_currency string, "
    "location string, is_remote boolean, published_at timestamp, tags array<string>, raw map<string,string>, match_role string, match_reasons array<string>"
)
VERDICT = _fields("id string, role string, passed_gate boolean, score int, recommend boolean, reasons array<string>")
MATCH = _fields("job_id string, score int, why_fits array<string>, watch_out array<string>, recommendation string")
SEEN = _fields("id string, source string, title string, url string, seen_at timestamp, prefilter_version string")
CACHE = _fields("job_id string, score int, why_fits array<string>, watch_out array<string>, recommendation string, matched_at timestamp, scoring_version string")
APPLICATION = _fields("job_id string, title string, company string, url string, score int, applied_at timestamp, status string")

#: Fixed: the longest description that is kept.
DESCRIPTION_CHARS = 12_000

DEFAULTS = {"salary_currency": "USD", "is_remote": False}


def conform(df: DataFrame, schema: T.StructType = POSTING) -> DataFrame:
    """df with the schema's columns in order; columns that it lacks get their default or null (older tables on read)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])
