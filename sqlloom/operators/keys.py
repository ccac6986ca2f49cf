"""Key profiles, allocated key ranges, checked inserts and overlays of injected rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.functions.text import parse_insert
from sqlloom.operators.dataflow import index_in_group

#: Type names that count as numeric where they occur in a declared type.
NUMERIC_TYPES = ("INT", "DECIMAL", "NUMERIC", "REAL", "FLOAT", "DOUBLE", "NUMBER")


@dataclass(frozen=True)
class Table:
    """A table's declared keys; the catalog doesn't hold them."""

    name: str
    primary_key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = field(default=())  # column, other table, other column


def is_numeric_type(declared: str) -> bool:
    return not declared or any(t in declared.upper() for t in NUMERIC_TYPES)


def key_profile(spark: SparkSession, tables: Iterable[Table]) -> DataFrame:
    """(table_name, pk_columns, pk_types, is_composite, is_integer, max_value) with one aggregation a table."""
    rows = None
    for t in tables:
        df = spark.table(t.name)
        types = dict(df.dtypes)
        kinds = [types.get(c, "") for c in t.primary_key]
        single = len(t.primary_key) == 1
        numeric = single and is_numeric_type(kinds[0])
        top = F.coalesce(F.max(F.expr(f"try_cast(`{t.primary_key[0]}` as bigint)")), F.lit(0)) if numeric else F.lit(0)
        one = df.agg(top.cast("long").alias("max_value")).select(
            F.lit(t.name).alias("table_name"),
            F.array(*map(F.lit, t.primary_key)).cast("array<string>").alias("pk_columns"),
            F.array(*map(F.lit, kinds)).cast("array<string>").alias("pk_types"),
            F.lit(len(t.primary_key) > 1).alias("is_composite"),
            F.lit(numeric).alias("is_integer"),
            "max_value",
        )
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], "table_name string, pk_columns array<string>, pk_types array<string>, is_composite boolean, is_integer boolean, max_value long")
    return rows


def key_ranges(samples: DataFrame, profile: DataFrame, group: str, order: Sequence[str], budget: int = 10) -> DataFrame:
    """A range of ``budget`` new keys for each sample and table with a single integer key, disjoint in its group.

    ``profile`` holds ``group``, table_name, is_integer and max_value; it is small (a row per table).
    """
    numbered = index_in_group(samples, group, order)
    single = profile.where("is_integer").select(group, "table_name", "max_value")
    start = F.col("max_value") + 1 + F.col("sql_index") * budget
    return numbered.join(single, group).withColumn("start", start).withColumn("end", start + budget - 1)


def out_of_range(inserts: DataFrame, ranges: DataFrame, on: Sequence[str], value: str = "pk_value") -> DataFrame:
    """Inserted keys outside of their range; a key that can't be read counts as outside."""
    joined = inserts.join(ranges.select(*on, "start", "end"), list(on))
    return joined.where(F.col(value).isNull() | ~F.col(value).between(F.col("start"), F.col("end")))


def insert_keys(statement: str, table: Table, columns: Sequence[str]) -> list[int | None]:
    """The key values that an INSERT gives for a single-column key, one a row; null where not an integer."""
    found = parse_insert(statement)
    if not found or len(table.primary_key) != 1:
        return []
    _, named, rows = found
    names = [c.lower() for c in (named or columns)]
    key = table.primary_key[0].lower()
    if key not in names:
        return [None] * len(rows)
    out: list[int | None] = []
    for row in rows:
        value = row[names.index(key)].strip("'\"") if names.index(key) < len(row) else ""
        out.append(int(value) if value.lstrip("+-").isdigit() else None)
    return out


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def insert_rows(spark: SparkSession, statements: Sequence[str]) -> dict[str, DataFrame]:
    """The rows of INSERT statements by table, typed as the tables are; raises on the first bad statement.

    The values are evaluated by Spark (``VALUES``), so literals and expressions read as in SQL.
    """
    out: dict[str, DataFrame] = {}
    for statement in statements:
        found = parse_insert(statement)
        if not found:
            raise ValueError(f"not an INSERT: {statement[:100]}")
        name, named, rows = found
        schema = spark.table(name).schema
        columns = [n for n in (named or schema.fieldNames())]
        by_lower = {f.name.lower(): f for f in schema.fields}
        if unknown := [c for c in columns if c.lower() not in by_lower]:
            raise ValueError(f"table {name} has no column {unknown[0]}")
        if any(len(r) != len(columns) for r in rows):
            raise ValueError(f"table {name}: {len(columns)} columns, but another number of values")
        quoted = ", ".join(f"`{c}`" for c in columns)
        df = spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS t({quoted})")
        present = {c.lower(): c for c in columns}
        typed = df.select(*[(F.col(f"`{present[f.name.lower()]}`") if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        out[name] = out[name].unionByName(typed) if name in out else typed
    return out


def checked_overlay(spark: SparkSession, statements: Sequence[str], tables: Mapping[str, Table]) -> tuple[int, list[str], dict[str, DataFrame]]:
    """(rows, errors, overlaid tables): all statements or none. Nothing is copied: an overlay is a union with the base.

    Checked are NOT NULL columns, uniqueness of keys among old and new rows, and references to parents in
    the overlaid tables. Any error leaves no overlay.
    """
    if not statements:
        return 0, ["no statements"], {}
    try:
        new = {k: v.cache() for k, v in insert_rows(spark, statements).items()}
        count = sum(v.count() for v in new.values())
    except Exception as e:
        return 0, [f"Failed: {str(e).strip().splitlines()[0][:300]}"], {}
    overlaid = {name: spark.table(name).unionByName(df) for name, df in new.items()}
    errors = []
    for name, df in new.items():
        t = tables.get(name, Table(name))
        for c in {*t.not_null, *t.primary_key}:
            if not df.where(F.col(c).isNull()).isEmpty():
                errors.append(f"{name}.{c} is null")
        if t.primary_key:
            keys = df.select(*t.primary_key)
            clash = spark.table(name).select(*t.primary_key).join(F.broadcast(keys), list(t.primary_key), "left_semi")
            if not clash.isEmpty() or not keys.groupBy(*t.primary_key).count().where("count > 1").isEmpty():
                errors.append(f"{name}: key ({', '.join(t.primary_key)}) is not unique")
        for column, other, other_column in t.foreign_keys:
            if not orphans(df, overlaid.get(other, spark.table(other)), column, other_column).isEmpty():
                errors.append(f"{name}.{column} has no parent in {other}.{other_column}")
    for df in new.values():
        df.unpersist()
    return (0, errors, {}) if errors else (count, [], overlaid)
