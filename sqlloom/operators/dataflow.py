"""Record-set operators: filters, joins, expansion, windows, sets and statistics over sample records.

A record's verification status is one of ``unverified`` (never checked), ``reset`` (to be checked again),
``ok`` and ``failed``, so that a missing flag and a null one stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_RESULT = "[]"
AXES = "ABCDEF"


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """A dense 0-based index by ``order`` (a total order), without one global sort task.

    Rows are range-sorted, counted per partition, and each adds the count of the partitions before its own.
    """
    laid = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    laid = laid.withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return laid.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_id", "_at", "_before")


def presence_fallback(*columns: Column, default: str = "") -> Column:
    """The first column that is there (not null), else ``default``."""
    return F.coalesce(*columns, F.lit(default))


def status_of(flag: Column, present: Column | None = None) -> Column:
    """Status from a nullable flag; ``present`` tells an absent flag from a null one."""
    absent = flag.isNull() if present is None else ~present
    return F.when(absent, "unverified").when(flag.isNull(), "reset").when(flag, "ok").otherwise("failed")


def keep_compilable(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status).isin("unverified", "ok"))


def keep_nonempty(df: DataFrame, result: str = "ex_result") -> DataFrame:
    """Drop rows whose result is exactly the empty list; null results stay."""
    return df.where(~F.col(result).eqNullSafe(F.lit(EMPTY_RESULT)))


def needs_fix(df: DataFrame, fix_all: bool = False, status: str = "status") -> DataFrame:
    return df if fix_all else df.where(F.col(status).isin("reset", "failed"))


def mark_missing(df: DataFrame, required: Sequence[str], status: str = "status", result: str = "ex_result") -> DataFrame:
    """Rows without a required field fail with a message that names the fields."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    message = "Missing " + " or ".join(required)
    out = df
    for name, value in ((status, "failed"), (result, message)):
        old = F.col(name) if name in df.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.when(missing, F.lit(value)).otherwise(old))
    return out


def merge(*sources: DataFrame) -> DataFrame:
    """UNION ALL by name; a column that a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merge_filtered(*sources: DataFrame, status: str = "status", result: str = "ex_result") -> DataFrame:
    """Merge what compiles and returns rows."""
    return merge(*(keep_nonempty(keep_compilable(s, status), result) for s in sources))


def expand(df: DataFrame, times: int, name: str = "evolve_id") -> DataFrame:
    """Each row ``times`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def explode_directions(df: DataFrame, proposal: str = "proposal", name: str = "direction_id", position: str = "position") -> DataFrame:
    """One row per proposed direction, with its position."""
    kept = [c for c in df.columns if c not in (proposal, name, position)]
    return df.where(F.size(F.coalesce(F.col(proposal), F.array().cast("array<int>"))) > 0).select(*kept, F.posexplode(proposal).alias(position, name))


def all_directions(df: DataFrame, n: int = len(AXES), name: str = "direction_id") -> DataFrame:
    return expand(df, n, name)


def some_directions(n: int, of: int, *key: str, seed: int = 0) -> Column:
    """A reproducible choice of ``n`` of the numbers below ``of``, by the row's key."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(of - 1)), lambda i: F.struct(F.xxhash64(*[F.col(k) for k in key], i, F.lit(seed)).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(numbers), 1, n), lambda s: s["i"])


def not_done(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the done ones; null keys equal each other."""
    keys = done.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    return df.join(keys, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), "left_anti")


def lookup_or_reject(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, reason: str) -> DataFrame:
    """Left lookup; a row without a match is rejected with ``reason``. The last duplicate is the caller's to choose."""
    right = table.select(F.col(table_key).alias(key), F.col(value).alias(value), F.lit(True).alias("_found"))
    out = df.join(right, key, "left")
    return out.withColumn("_rejected", F.col("_found").isNull()).withColumn("_reject_reason", F.when(F.col("_found").isNull(), F.lit(reason))).drop("_found")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order`` (a top-1 aggregation, without a window)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def overlay(df: DataFrame, newer: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values of ``newer`` over those of ``df`` where there are any."""
    right = newer.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(right, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def index_in_group(df: DataFrame, group: str, order: Sequence[str], name: str = "sql_index") -> DataFrame:
    """0-based position in the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def batch_index(df: DataFrame, size: int, index: str = "row_idx", name: str = "batch") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(index) / size).cast("long"))


def top_axes(details: Column, k: int = 2) -> Column:
    """Numbers of the k best axes of an array<struct<axis, score>>: by score, ties in order; unknown axes drop out after the cut."""
    ranked = F.array_sort(F.transform(details, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), F.upper(F.trim(x["axis"])).alias("a"))))
    numbers = F.transform(F.slice(ranked, 1, k), lambda x: F.when(F.length(x["a"]) == 1, F.position(x["a"], F.lit(AXES)) - 1).otherwise(F.lit(-1)))
    return F.filter(numbers, lambda n: n >= 0)


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (limited before the shuffle as well as after it)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rounded share; 0 for an empty whole."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def verification_stats(df: DataFrame, status: str = "status") -> DataFrame:
    n = F.count("*")
    ok = F.count_if(F.col(status) == "ok")
    return df.agg(n.alias("total"), ok.alias("compilable"), (n - ok).alias("failed"), rate(ok, n).alias("compilable_rate"))


def rejection_stats(df: DataFrame, reason: str = "_reject_reason") -> DataFrame:
    """Counts by outcome; an API error counts as unparsable, a missing schema only as rejected."""
    r = F.col(reason)
    return df.agg(
        F.count("*").alias("processed"),
        F.count_if(r.isNull()).alias("valid"),
        F.count_if(r.isNotNull()).alias("rejected"),
        F.count_if(r.isin("api_error", "parse_failed")).alias("parse_failed"),
        F.count_if(r == "sql_failed").alias("sql_failed"),
        rate(F.count_if(r.isNull()), F.count("*")).alias("success_rate"),
    )


def injection_stats(df: DataFrame, success: str = "inject_success", count: str = "inject_count") -> DataFrame:
    ok = F.count_if(F.col(success))
    return df.agg(ok.alias("success"), (F.count("*") - ok).alias("failed"), F.coalesce(F.sum(count), F.lit(0)).alias("rows_inserted"), rate(ok, F.count("*")).alias("success_rate"))


def changed(old: Column, new: Column) -> Column:
    return F.count_if(~old.eqNullSafe(new))
