"""Record files: JSON arrays, JSON lines, texts, schema strings and nested schema files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.operators.dataflow import last_by_key, status_of, with_row_index

SEED = "question_id bigint, db_id string, question string, evidence string, SQL string, gold_sql string, difficulty string, evolve_id int, direction_id int, can_compile boolean, ex_result string"
NESTED_SCHEMA = (
    "db_id string, schema string, tables map<string, struct<fields: map<string, struct<type: string, primary_key: boolean, nullable: boolean, default: string, "
    "autoincrement: boolean, comment: string, examples: array<string>>>, examples: array<string>, comment: string>>, foreign_keys array<array<string>>"
)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_records(spark: SparkSession, path: str, schema: str = SEED) -> DataFrame:
    """Records of a JSON array or JSON-lines file, with gold_sql, a status and row_idx (the order of question_id, then text).

    A flag that is absent and one that is null differ: the raw text of each record tells which.
    """
    lines = path.endswith(".jsonl")
    raw = spark.read.text(path) if lines else spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    parsed = raw.where(F.trim("value") != "").select("value", F.from_json("value", schema).alias("r"))
    present = F.array_contains(F.json_object_keys("value"), "can_compile")
    out = parsed.select("r.*", status_of(F.col("r.can_compile"), F.coalesce(present, F.lit(False))).alias("status"))
    out = out.withColumn("gold_sql", F.coalesce("gold_sql", "SQL")).drop("SQL", "can_compile")
    return with_row_index(out, "question_id", "question", "gold_sql")


def read_schema_strings(spark: SparkSession, path: str) -> DataFrame:
    """(db_name, mschema_str) of a JSON-lines file; of repeated names the last line counts."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())
    return last_by_key(rows.select(F.from_json("value", "db_name string, mschema_str string").alias("r"), "_line").select("r.*", "_line"), "db_name", "_line")


def read_nested_schemas(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(fields, foreign keys) of nested schema files, one JSON object each; table names lose their leading ``main.``."""
    raw = spark.read.schema(NESTED_SCHEMA).option("multiLine", True).json(folder)
    bare = lambda c: F.regexp_replace(c, "^main\\.", "")
    tables = raw.select("db_id", F.explode("tables").alias("name", "t")).select("db_id", bare("name").alias("table_name"), F.posexplode(F.map_entries("t.fields")).alias("ordinal", "f"))
    fields = tables.select("db_id", "table_name", "ordinal", F.col("f.key").alias("field"), "f.value.*")
    k = F.col("k")
    keys = raw.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", bare(k[0]).alias("table_name"), k[1].alias("field"), bare(k[3]).alias("ref_table"), k[4].alias("ref_field"))
    return fields, keys


def write_json_array(df: DataFrame, path: str, order: Iterable[str]) -> int:
    """Export as one JSON array in order, row by row, without holding all of it; the number of records."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            f.write(("," if n else "") + "\n" + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
            n += 1
        f.write("\n]\n")
    return n
