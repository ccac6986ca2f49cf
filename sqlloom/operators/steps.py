"""The steps of a corpus build: breadth and depth evolution, verification, fixing, injection, merging, sampling.

Each step is a function of DataFrames. Records have question_id, db_id, question, evidence, gold_sql and
lineage columns (evolve_id, direction_id); prompts come from templates that the caller gives.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.functions import text as X
from sqlloom.operators import dataflow as D
from sqlloom.operators import keys, sqlservice
from sqlloom.operators.generate import Generator, generate, generate_with_retry

#: What each direction of depth evolution asks for, by axis letter.
METHODS = {
    "A": "nested queries, correlated subqueries, common table expressions",
    "B": "AND, OR, NOT; HAVING on GROUP BY; ordering by several columns or expressions",
    "C": "BETWEEN, IN, NOT IN, LIKE, CASE WHEN",
    "D": "aggregate, date, mathematical and window functions",
    "E": "more joins, or another type of join",
    "F": "UNION, INTERSECT, EXCEPT, EXISTS, NOT EXISTS",
}


@dataclass(frozen=True)
class Sampling:
    rounds: int = 4
    batch_size: int = 64


def _prompts(df: DataFrame, template: str, schemas: DataFrame | None, **values) -> DataFrame:
    """``df`` with a prompt; ``schemas``: db_name, mschema_str."""
    if schemas is not None:
        one = D.last_by_key(schemas.withColumn("_order", F.lit(0)), "db_name", "_order").select(F.col("db_name").alias("db_id"), "mschema_str")
        df = df.join(one, "db_id", "left")
    known = {"DATABASE_SCHEMA": F.coalesce("mschema_str", F.lit("")) if schemas is not None else F.lit("")}
    return df.withColumn("prompt", X.render_template(template, known | values)).drop("mschema_str")


_EVOLVED = "struct<question:string,evidence:string,gold_sql:string>"


def _evolved(answered: DataFrame, update_evidence: bool) -> DataFrame:
    parsed = answered.withColumn("_new", F.from_json(X.extract_json("response"), _EVOLVED)).where("_new.question is not null and _new.gold_sql is not null")
    evidence = F.coalesce("_new.evidence", "evidence") if update_evidence else F.col("evidence")
    return parsed.withColumns({"question": F.col("_new.question"), "evidence": evidence, "gold_sql": F.col("_new.gold_sql"), "difficulty": F.lit(None).cast("string")}).drop("_new", "prompt", "response", "response_error")


def evolve_breadth(samples: DataFrame, generator: Generator, template: str, schemas: DataFrame | None = None, times: int = 3, done: DataFrame | None = None, update_evidence: bool = False) -> DataFrame:
    """``times`` variants of each record; records among ``done`` (by question_id) are passed over."""
    todo = samples if done is None else D.not_done(samples, done, ["question_id"])
    asked = _prompts(D.expand(todo, times), template, schemas, EVIDENCE=F.col("evidence"), QUESTION=F.col("question"), GOLD_SQL=F.col("gold_sql"))
    return _evolved(generate(asked, generator), update_evidence)


def propose_directions(samples: DataFrame, generator: Generator, template: str, schemas: DataFrame | None = None, k: int = 2, retries: int = 3) -> DataFrame:
    """Records that compile and return rows, with the k best axes by the generator's scores; asked again while none is valid."""
    usable = D.keep_nonempty(D.keep_compilable(samples))
    asked = _prompts(usable, template, schemas, QUESTION=F.col("question"), GOLD_SQL=F.col("gold_sql"))
    details = F.from_json(X.extract_json("response"), "array<struct<axis:string,score:double>>")
    answered = generate_with_retry(asked, generator, "question_id", retries, accept=F.size(D.top_axes(details, k)) > 0)
    return answered.withColumn("proposal_detail", details).withColumn("proposal", D.top_axes(F.col("proposal_detail"), k)).drop("prompt", "response", "response_error")


def evolve_depth(proposed: DataFrame, generator: Generator, template: str, schemas: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """One variant for each proposed direction; (question_id, evolve_id, direction_id) among ``done`` are passed over."""
    directions = D.explode_directions(proposed).drop("position", "proposal_detail")
    todo = directions if done is None else D.not_done(directions, done, ["question_id", "evolve_id", "direction_id"])
    method = F.element_at(F.array(*map(F.lit, METHODS.values())), F.col("direction_id") + 1)
    asked = _prompts(todo, template, schemas, QUESTION=F.col("question"), GOLD_SQL=F.col("gold_sql"), METHOD=method, EVIDENCE=F.col("evidence"))
    return _evolved(generate(asked, generator), update_evidence=False)


def verify(samples: DataFrame, key: str = "row_idx", seconds: float = sqlservice.VERIFY_SECONDS, threads: int = sqlservice.VERIFY_THREADS, use_db=None) -> DataFrame:
    """Status and result of each record's SQL; records without SQL or database fail unrun.

    SQL runs from the driver, so texts come to it a database at a time; ``use_db(spark, db_id)`` makes that
    database's tables the current ones.
    """
    spark = samples.sparkSession
    marked = D.mark_missing(samples.drop("status", "ex_result"), ["gold_sql", "db_id"])
    out = None
    for row in marked.where("status is null").select("db_id").distinct().collect():  # one row a database
        if use_db:
            use_db(spark, row["db_id"])
        texts = [(r[key], r["gold_sql"]) for r in marked.where((F.col("db_id") == row["db_id"]) & F.col("status").isNull()).select(key, "gold_sql").toLocalIterator()]
        found = sqlservice.verify_batch(spark, texts, seconds, threads)
        out = found if out is None else out.union(found)
    if out is None:
        return marked
    found = out.select(F.col("row_idx").alias(key), F.when(F.col("can_compile"), "ok").otherwise("failed").alias("status"), F.when(F.col("is_empty"), D.EMPTY_RESULT).otherwise(F.col("ex_result")).alias("ex_result"))
    return D.overlay(marked, found, key, ["status", "ex_result"])


def fix(samples: DataFrame, generator: Generator, template: str, schemas: DataFrame | None = None, fix_all: bool = False) -> DataFrame:
    """Records that need it get the generator's SQL, if it gives any, and are to be verified again; the others stay."""
    asked = _prompts(D.needs_fix(samples, fix_all), template, schemas, EVIDENCE=F.col("evidence"), QUESTION=F.col("question"), GOLD_SQL=F.col("gold_sql"), GOLD_RESULT=F.col("ex_result"))
    new = F.get_json_object(X.extract_json("response"), "$.sql")
    answered = generate(asked, generator).withColumn("_sql", new)
    has = F.coalesce(F.col("_sql") != "", F.lit(False))
    fixed = answered.withColumns({
        "gold_sql": F.when(has, F.col("_sql")).otherwise(F.col("gold_sql")), "status": F.when(has, "reset").otherwise(F.col("status")), "ex_result": F.when(has, F.lit(None)).otherwise(F.col("ex_result")),
    }).select(*samples.columns)
    return fixed if fix_all else samples.where(~F.col("status").isin("reset", "failed")).unionByName(fixed)


def inject(spark: SparkSession, sample: Mapping, generator: Generator, template: str, tables: Mapping[str, keys.Table], ranges: Mapping[str, tuple[int, int]], attempts: int = 3, schema: str = "") -> tuple[dict, dict[str, DataFrame]]:
    """Rows for one record's database that its SQL may need: (annotations, overlaid tables).

    A conversation of at most ``attempts`` turns; each failure's stage and errors are told and kept.
    """
    prompt = template.replace("{DATABASE_SCHEMA}", schema).replace("{TARGET_SQL}", sample["gold_sql"] or "")
    messages = [{"role": "user", "content": prompt}]
    history: list[dict] = []
    for attempt in range(1, attempts + 1):
        try:
            answer = generator.chat(messages, 0)
        except Exception:
            answer = None
        statements = X.parse_inserts(answer)
        stage, errors = "success", []
        overlaid: dict[str, DataFrame] = {}
        count = 0
        if answer is None:
            stage = "llm_fail"
        elif not statements:
            stage, errors = "parse_fail", ["no INSERT statement"]
        else:
            for s in statements:
                name = X.parse_insert(s)[0]
                if name in ranges and name in tables:
                    low, high = ranges[name]
                    columns = spark.table(name).columns
                    errors += [f"{name}: key {v} is outside of [{low}, {high}]" for v in keys.insert_keys(s, tables[name], columns) if v is None or not low <= v <= high]
            if errors:
                stage = "pk_violation"
            else:
                count, errors, overlaid = keys.checked_overlay(spark, statements, tables)
                stage = "exec_error" if errors else stage
        history.append({"attempt": attempt, "stage": stage, "llm_response": (answer or "")[:2000], "parsed_inserts": statements, "error": errors})
        if stage == "success":
            return {"inject_success": True, "inject_count": count, "inject_attempts": attempt, "inject_inserts": statements, "inject_error": None, "inject_history": history}, overlaid
        messages += [{"role": "assistant", "content": answer or ""}, {"role": "user", "content": "This failed:\n" + "\n".join(errors or [stage])[:500] + "\nWrite all statements again."}]
    return {"inject_success": False, "inject_count": 0, "inject_attempts": attempts, "inject_inserts": [], "inject_error": "; ".join(history[-1]["error"])[:500], "inject_history": history}, {}


def sample_rejections(samples: DataFrame, generator: Generator, template: str, schemas: DataFrame, sampling: Sampling = Sampling(), key: str = "row_idx", seconds: float = sqlservice.COMPARE_SECONDS, use_db=None) -> DataFrame:
    """Reasoned answers whose SQL returns what the record's does: accepted records, with the round; rejected ones, with a reason.

    A record without a schema is rejected at once. Others are asked in every round until accepted; only the
    last round's failure is a reason: api_error, parse_failed or sql_failed. SQL is compared a database at a time, see
    ``verify``, in batches of ``sampling.batch_size``.
    """
    spark = samples.sparkSession
    known = schemas.select(F.col("db_name").alias("db_id"), F.lit(True).alias("_known")).distinct()
    state = samples.join(known, "db_id", "left")
    rejected = state.where("_known is null").drop("_known")
    left = state.where("_known is not null").drop("_known")
    plain = {"output_reasoning": F.lit(None).cast("string"), "output_sql": F.lit(None).cast("string"), "_sample_round": F.lit(None).cast("int"), "_rejected": F.lit(True)}
    done = rejected.withColumns(plain | {"_reject_reason": F.lit("schema_not_found")})
    for r in range(sampling.rounds):
        asked = _prompts(left, template, schemas, EVIDENCE=F.coalesce("evidence", F.lit("")), QUESTION=X.prompt_with_hint(F.col("question"), F.col("evidence")))
        parsed = generate(asked, generator).withColumn("_p", X.parse_reasoned_answer(F.col("response")))
        parsed = parsed.checkpoint() if spark.sparkContext.getCheckpointDir() else parsed.persist()
        answers = parsed.where("_p is not null").select(key, F.col("_p.answer").alias("sql"), "gold_sql", "db_id")
        equal = spark.createDataFrame([], "row_idx long, equal boolean")
        for row in answers.select("db_id").distinct().collect():  # one row a database
            if use_db:
                use_db(spark, row["db_id"])
            pairs = ((x[key], x["sql"], x["gold_sql"]) for x in answers.where(F.col("db_id") == row["db_id"]).toLocalIterator())
            while batch := list(islice(pairs, sampling.batch_size)):
                equal = equal.union(sqlservice.compare_batch(spark, batch, seconds))
        equal = equal.select(F.col("row_idx").alias(key), "equal")
        judged = parsed.join(equal, key, "left")
        reason = F.when(F.col("response").isNull(), "api_error").when(F.col("_p").isNull(), "parse_failed").otherwise("sql_failed")
        good = judged.where("equal")
        accepted = good.withColumns({"output_reasoning": F.col("_p.reasoning"), "output_sql": F.col("_p.answer"), "_sample_round": F.lit(r), "_rejected": F.lit(False), "_reject_reason": F.lit(None).cast("string")})
        done = done.unionByName(accepted.select(*done.columns))
        rest = judged.where(~F.coalesce("equal", F.lit(False)))
        if r + 1 == sampling.rounds:
            return done.unionByName(rest.withColumns(plain | {"_reject_reason": reason}).select(*done.columns))
        left = rest.select(*left.columns)
        if left.isEmpty():
            return done
    return done
