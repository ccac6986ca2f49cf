"""Schema linking: which tables and columns a query uses, and schema text for these.

A schema is three tables: fields (table_name, ordinal, field, type, primary_key, nullable, comment, examples),
foreign keys (table_name, field, ref_table, ref_field) and, implied, table names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlloom.functions.text import base_type, shown_examples
from sqlloom.operators import sqlservice


def resolve_names(asked: DataFrame, known: DataFrame, asked_column: str, known_column: str) -> DataFrame:
    """Adds ``resolved``: the known name that equals the asked one (any case), else the only one whose last part does."""
    names = known.select(F.col(known_column).alias("_name")).distinct()
    exact = names.select(F.lower("_name").alias("_key"), F.col("_name").alias("_exact")).dropDuplicates(["_key"])
    tails = names.groupBy(F.lower(F.substring_index("_name", ".", -1)).alias("_key")).agg(F.count("*").alias("_n"), F.max("_name").alias("_tail")).where("_n = 1").drop("_n")
    out = asked.withColumn("_key", F.lower(asked_column)).join(exact, "_key", "left").join(tails, "_key", "left")
    return out.withColumn("resolved", F.coalesce("_exact", "_tail")).drop("_key", "_exact", "_tail")


def resolve_columns(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """(table_name, field) in the schema's own case, of asked (table_name, field) in any case."""
    keyed = fields.select(F.col("table_name"), F.lower("field").alias("_key"), F.col("field").alias("_field"))
    return asked.select("table_name", F.lower("field").alias("_key")).join(keyed, ["table_name", "_key"]).select("table_name", F.col("_field").alias("field")).distinct()


def references(spark: SparkSession, sql: str) -> tuple[set[str], set[tuple[str, str]]]:
    """(tables, (table, column) pairs) that a query reads, from its analysed plan: stars expanded, aliases resolved.

    The views that a query names are the tables; each leaf's columns belong to the view next to it. References
    to common table expressions reuse the inner columns' ids and own none.
    """
    plan = sqlservice.analysed(spark, sql)._jdf.queryExecution().analyzed()
    tables: set[str] = set()
    owner: dict[int, tuple[str, str]] = {}
    used: set[int] = set()
    todo = [(plan, None)]
    top = [plan.output().apply(i).exprId().id() for i in range(plan.output().size())]
    while todo:
        node, view = todo.pop()
        kind = node.getClass().getSimpleName()
        children = [node.children().apply(i) for i in range(node.children().size())]
        output = node.output()
        attributes = [output.apply(i) for i in range(output.size())]
        if kind == "View":
            # The view's output has ids of its own; below it is only its definition.
            name = node.desc().identifier().table()
            tables.add(name)
            owner.update({a.exprId().id(): (name, a.name()) for a in attributes})
            continue
        if kind == "SubqueryAlias" and len(children) == 1 and children[0].getClass().getSimpleName() not in ("View",) and not children[0].children().size():
            view = node.identifier().name()
        if not children and kind not in ("CTERelationRef", "OneRowRelation", "LocalRelation", "Range"):
            name = view or node.nodeName()
            tables.add(name)
            owner.update({a.exprId().id(): (name, a.name()) for a in attributes})
        seen = node.references().toSeq()
        used |= {seen.apply(i).exprId().id() for i in range(seen.size())}
        inner = node.subqueries()
        todo += [(c, None if kind != "SubqueryAlias" else view) for c in children] + [(inner.apply(i), None) for i in range(inner.size())]
    return tables, {owner[i] for i in (*used, *top) if i in owner}


def reference_rows(spark: SparkSession, texts: Iterable[tuple[int, str]]) -> DataFrame:
    """(row_idx, table_name, field): one row for each table (field null) and column that each query reads."""
    rows = []
    for i, sql in texts:
        tables, columns = references(spark, sql)
        rows += [(i, t, None) for t in sorted(tables)] + [(i, t, c) for t, c in sorted(columns)]
    return spark.createDataFrame(rows, "row_idx long, table_name string, field string")


def prune(fields: DataFrame, foreign_keys: DataFrame, tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a schema that a query uses: a table without a used column keeps all; a foreign key stays if both of its ends do.

    ``tables``: table_name; ``columns``: table_name, field.
    """
    bare = tables.join(columns.select("table_name").distinct(), "table_name", "left_anti")
    kept = fields.join(columns, ["table_name", "field"], "left_semi").unionByName(fields.join(bare, "table_name", "left_semi"))
    ends = kept.select("table_name", "field")
    out = foreign_keys.join(ends, ["table_name", "field"], "left_semi")
    return kept, out.join(ends.select(F.col("table_name").alias("ref_table"), F.col("field").alias("ref_field")), ["ref_table", "ref_field"], "left_semi")


def field_line(hints: bool = False):
    """``(name:TYPE, comment, Primary Key, Examples: [..])`` of a field."""
    examples = shown_examples(F.coalesce("examples", F.array().cast("array<string>")), F.col("type"))
    dated = F.when(base_type(F.col("type")).isin("DATE", "DATETIME", "TIME", "TIMESTAMP"), F.slice(examples, 1, 1)).otherwise(examples)
    parts = [
        F.concat("field", F.lit(":"), base_type(F.col("type"))),
        F.when(F.coalesce("comment", F.lit("")) != "", F.trim("comment")),
        F.when(F.col("primary_key"), F.lit("Primary Key")),
        *([F.col("hint")] if hints else []),
        F.when(F.size(dated) > 0, F.concat(F.lit("Examples: ["), F.array_join(dated, ", "), F.lit("]"))),
    ]
    return F.concat(F.lit("("), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ", "), F.lit(")"))


def table_blocks(fields: DataFrame, group: list[str], hints: bool = False) -> DataFrame:
    """(group, table_name, block): the text of each table, fields by ordinal."""
    lines = fields.select(*group, "table_name", F.struct("ordinal", field_line(hints).alias("line")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return lines.groupBy(*group, "table_name").agg(F.concat(F.lit("# Table: "), F.first("table_name"), F.lit("\n[\n"), F.array_join(ordered, ",\n"), F.lit("\n]")).alias("block"))


def schema_text(fields: DataFrame, foreign_keys: DataFrame, group: str = "db_id", hints: bool = False) -> DataFrame:
    """(db_id, mschema_str): the whole schema's text, tables by name, then foreign keys."""
    blocks = table_blocks(fields, [group], hints).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_name", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    line = F.concat("table_name", F.lit("."), "field", F.lit("="), "ref_table", F.lit("."), "ref_field")
    keys = foreign_keys.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("keys"))
    head = F.concat(F.lit("【DB_ID】 "), F.col(group), F.lit("\n【Schema】\n"), "blocks")
    return blocks.join(keys, group, "left").select(group, F.when(F.col("keys").isNull(), head).otherwise(F.concat(head, F.lit("\n【Foreign keys】\n"), "keys")).alias("mschema_str"))


def catalog_fields(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    """Fields of catalog tables, with the smallest three distinct values of each as examples, from all rows."""
    out = None
    for name in tables:
        df = spark.table(name)
        values = F.posexplode(F.array(*[F.left(F.col(c).cast("string"), F.lit(60)) for c in df.columns])).alias("ordinal", "value")
        distinct = df.select(values).where("value is not null").distinct()
        least = distinct.withColumn("place", F.row_number().over(Window.partitionBy("ordinal").orderBy("value"))).where("place <= 3")
        found = least.groupBy("ordinal").agg(F.array_sort(F.collect_list("value")).alias("examples"))
        declared = spark.createDataFrame([(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "table_name string, ordinal int, field string, type string")
        one = declared.join(found, "ordinal", "left").select("table_name", "ordinal", "field", "type", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
        out = one if out is None else out.union(one)
    return out.withColumns({"primary_key": F.lit(False), "comment": F.lit(None).cast("string")})
