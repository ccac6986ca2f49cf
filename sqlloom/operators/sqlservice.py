"""Running SQL texts: verification with a time limit and a row cap, and comparison of results as sets.

``spark.sql`` runs on the driver only, so a batch is a bounded pool of driver threads; each text's jobs carry
a tag of their own and are cancelled by it when the limit is reached. Only queries are run: commands, DDL
and DML are refused from their parsed plan, before anything executes.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of verification and of comparison: seconds, rows, characters of the shown result, threads.
VERIFY_SECONDS, VERIFY_ROWS, SHOWN_CHARS, VERIFY_THREADS = 20.0, 30, 300, 64
COMPARE_SECONDS, COMPARE_THREADS = 10.0, 20


@dataclass
class SQLResult:
    success: bool
    result: list[tuple] | None = None
    error: str | None = None
    timed_out: bool = False

    @property
    def shown(self) -> str:
        """The rows as text, cut at SHOWN_CHARS, or the error in full."""
        if not self.success:
            return self.error or ""
        text = str(self.result)
        return text if len(text) <= SHOWN_CHARS else text[:SHOWN_CHARS] + "..."


class NotAQuery(ValueError):
    pass


def parsed(spark: SparkSession, sql: str):
    """The parsed plan of one query; raises for anything else."""
    if not sql or not sql.strip():
        raise NotAQuery("empty SQL text")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo, jvm = [plan], spark._jvm
    while todo:
        node = todo.pop()
        kinds = set()
        kind = node.getClass()
        while kind is not None:
            kinds |= {kind.getSimpleName(), *(i.getSimpleName() for i in kind.getInterfaces())}
            kind = kind.getSuperclass()
        if kinds & {"Command", "ParsedStatement", "UnaryParsedStatement", "LeafParsedStatement", "UnaryCommand", "LeafCommand", "BinaryCommand"}:
            raise NotAQuery(f"only queries are run, not {node.nodeName()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    del jvm
    return plan


def analysed(spark: SparkSession, sql: str) -> DataFrame:
    parsed(spark, sql)
    return spark.sql(sql)


def execute(spark: SparkSession, sql: str, seconds: float = VERIFY_SECONDS, rows: int | None = VERIFY_ROWS) -> SQLResult:
    """Run one query; its first ``rows`` rows, or an error, or a time-out."""
    tag, box = f"sqlloom-{uuid.uuid4().hex}", SQLResult(False, error="not finished")
    context = spark.sparkContext

    def work() -> None:
        context.addJobTag(tag)
        try:
            df = analysed(spark, sql)
            box.result = [tuple(r) for r in (df if rows is None else df.limit(rows)).collect()]
            box.success, box.error = True, None
        except Exception as e:  # the text is a user's: every failure is its result
            box.error = str(e).strip().split("\n")[0][:1000] or type(e).__name__
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        end = time.time() + 5
        while thread.is_alive() and time.time() < end:  # a job may start just after the first cancellation
            context.cancelJobsWithTag(tag)
            thread.join(0.2)
        return SQLResult(False, error=f"Timeout: over {seconds:g} s", timed_out=True)
    return box


def _pool(items: Sequence, work, threads: int) -> list:
    """Results in order, at most ``threads`` at a time."""
    if not items:
        return []
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(items)))) as pool:
        return list(pool.map(work, items))


VERIFIED = T.StructType([
    T.StructField("row_idx", T.LongType(), False), T.StructField("can_compile", T.BooleanType(), False), T.StructField("is_empty", T.BooleanType()),
    T.StructField("ex_result", T.StringType()), T.StructField("timed_out", T.BooleanType(), False),
])


def verify_batch(spark: SparkSession, texts: Iterable[tuple[int, str]], seconds: float = VERIFY_SECONDS, threads: int = VERIFY_THREADS) -> DataFrame:
    """(row_idx, can_compile, is_empty, ex_result, timed_out) of (row_idx, sql) pairs."""
    items = list(texts)

    def one(item: tuple[int, str]) -> tuple:
        r = execute(spark, item[1], seconds)
        return item[0], r.success, (not r.result) if r.success else None, r.shown, r.timed_out

    return spark.createDataFrame(_pool(items, one, threads), VERIFIED)


def canonical(df: DataFrame) -> DataFrame:
    """Each row as an array of texts that are equal iff the values are: by position, numbers by value, texts apart from numbers."""

    def cell(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.BooleanType):
            c = F.concat(F.lit("n:"), c.cast("int").cast("string"))
        elif isinstance(kind, T.IntegralType):
            c = F.concat(F.lit("n:"), c.cast("string"))
        elif isinstance(kind, T.NumericType):
            d = c.cast("double")
            whole = (d == F.floor(d)) & (F.abs(d) < F.lit(float(1 << 53)))
            shown = F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
            if isinstance(kind, T.DecimalType):  # exact where a double would not be
                shown = F.when(d.cast("string").try_cast(kind) == c, shown).otherwise(c.cast("string"))
            c = F.concat(F.lit("n:"), shown)
        elif isinstance(kind, T.BinaryType):
            c = F.concat(F.lit("b:"), F.hex(c))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            c = F.concat(F.lit("j:"), F.to_json(c))
        else:
            c = F.concat(F.lit("s:"), c.cast("string"))
        return F.coalesce(c, F.lit("∅"))

    names = [f"c{i}" for i in range(len(df.columns))]
    df = df.toDF(*names)
    return df.select(F.array(*[cell(f) for f in df.schema.fields]).alias("row")) if names else df.select(F.array().cast("array<string>").alias("row"))


def same_results(left: DataFrame, right: DataFrame) -> bool:
    """Whether two results are equal as sets of rows, by one aggregation and without collecting them."""
    if len(left.columns) != len(right.columns):
        return left.isEmpty() and right.isEmpty()
    both = canonical(left).withColumn("side", F.lit(1)).union(canonical(right).withColumn("side", F.lit(2)))
    sides = both.groupBy("row").agg(F.bit_or("side").alias("sides"))
    return sides.where("sides <> 3").isEmpty()


def compare(spark: SparkSession, predicted: str, gold: str, seconds: float = COMPARE_SECONDS) -> bool:
    """Whether both queries run in time and return the same set of rows."""
    tag, verdict = f"sqlloom-{uuid.uuid4().hex}", []

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            verdict.append(same_results(analysed(spark, predicted), analysed(spark, gold)))
        except Exception:  # a failing side is not equal to anything
            verdict.append(False)
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread: threading.Thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        for _ in range(20):  # a job that starts just after a cancellation is cancelled by the next one
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.5)
            if not thread.is_alive():
                break
        return False
    return bool(verdict and verdict[0])


def compare_batch(spark: SparkSession, pairs: Iterable[tuple[int, str, str]], seconds: float = COMPARE_SECONDS, threads: int = COMPARE_THREADS) -> DataFrame:
    """(row_idx, equal) of (row_idx, predicted, gold)."""
    rows = _pool(list(pairs), lambda p: (p[0], compare(spark, p[1], p[2], seconds)), threads)
    return spark.createDataFrame(rows, "row_idx long, equal boolean")


def register_tables(spark: SparkSession, folder: str, tables: Iterable[str]) -> None:
    """Views on a folder's Parquet tables: one target database."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
