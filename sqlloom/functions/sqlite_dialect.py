"""What SQLite texts need to run on Spark: missing functions as SQL functions, and a few rewrites.

Covered: ``iif``, ``total``-like sums, ``strftime`` with common patterns, integer division, NULL for division
by zero, case-insensitive LIKE, double-quoted names. Other differences raise, as they would unrewritten.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Strftime codes and the patterns that say the same.
_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}

_FUNCTIONS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION iif(c BOOLEAN, a STRING, b STRING) RETURNS STRING RETURN CASE WHEN c THEN a ELSE b END",
    "CREATE OR REPLACE TEMPORARY FUNCTION sqlite_divide(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, b)",
    "CREATE OR REPLACE TEMPORARY FUNCTION sqlite_int(a STRING) RETURNS BIGINT RETURN coalesce(try_cast(regexp_extract(a, '^\\\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)",
    "CREATE OR REPLACE TEMPORARY FUNCTION sqlite_substr(a STRING, s INT, n INT) RETURNS STRING RETURN CASE WHEN s > 0 THEN substr(a, s, n) WHEN s = 0 THEN substr(a, 1, greatest(n - 1, 0)) ELSE substr(a, s, n) END",
]


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, and double quotes mean names."""
    for text in _FUNCTIONS:
        spark.sql(text)
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")


def _outside_quotes(text: str, change) -> str:
    return "".join(part if i % 2 else change(part) for i, part in enumerate(re.split(r"('(?:[^']|'')*')", text)))


def strftime(pattern: str) -> str:
    """The date_format pattern of a strftime one; raises for codes without an equal."""
    codes = re.findall(r"%.", pattern)
    if unknown := [c for c in codes if c not in _CODES]:
        raise ValueError(f"strftime code {unknown[0]} has no equal here")
    return re.sub(r"%.", lambda m: _CODES[m[0]], pattern)


def rewrite(sql: str) -> str:
    """A SQLite text as Spark SQL."""
    sql = re.sub(r"\bstrftime\s*\(\s*'([^']*)'\s*,", lambda m: f"date_format_of('{strftime(m[1])}',", sql, flags=re.I)
    sql = re.sub(r"date_format_of\('([^']*)',\s*([^()]+|\w+\([^()]*\))\)", r"date_format(to_timestamp(\2), '\1')", sql)
    return _outside_quotes(sql, lambda part: re.sub(r"(?<![\w.])LIKE(?!\w)", "ILIKE", part, flags=re.I).replace("==", "="))
