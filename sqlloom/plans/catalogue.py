"""Registered queries and their oracle SQL.

The driver's tables stand in for record sets: ``documents`` for samples (group: lang or source), ``labels``
for a verification flag that only some have, ``events.props`` for JSON responses, ``pages`` for tagged text,
``conversations`` for messages, ``embeddings`` for question vectors, the other tables for a target database.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.functions import text as X
from sqlloom.operators import dataflow as D
from sqlloom.operators import dedup, keys, linking, sqlservice

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events".split()


def query(oracle: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of (t, spark); ``t`` reads a table by name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a SQL text that the SQL service answers on the target database's views; the oracle runs the same text unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sqlservice.register_tables(spark, sf_dir, [t for t in TABLES if t in text])
        return sqlservice.analysed(spark, text)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


# ---- projections, filters ------------------------------------------------------------------------------


@query("SELECT doc_id AS question_id, lang AS db_id, CAST(n_chars AS INTEGER) AS n_chars, upper(source) AS source FROM documents")
def scan_project(t, spark):
    return t("documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("db_id"), F.col("n_chars").cast("int").alias("n_chars"), F.upper("source").alias("source"))


def _samples(t) -> DataFrame:
    """Documents with the status that their label, if any, gives them."""
    joined = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").select("doc_id", (F.col("quality") == 1).alias("flag")), "doc_id", "left")
    return joined.withColumn("status", D.status_of(F.col("flag"))).drop("flag")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1")
def filter_compilable_default(t, spark):
    return D.keep_compilable(_samples(t)).select("doc_id", "lang")


_RESULT = "CASE WHEN doc_id % 3 = 0 THEN '[]' WHEN doc_id % 3 = 1 THEN NULL ELSE '[(1,)]' END"


@query(f"SELECT doc_id, ex_result FROM (SELECT doc_id, {_RESULT} AS ex_result FROM documents) s WHERE ex_result IS DISTINCT FROM '[]'")
def filter_nonempty_nullsafe(t, spark):
    return D.keep_nonempty(t("documents").select("doc_id", F.expr(_RESULT).alias("ex_result")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'failed' END AS status, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'Missing gold_sql or db_id' END AS ex_result FROM documents""")
def missing_field_mark(t, spark):
    df = t("documents").select("doc_id", F.expr("if(doc_id % 5 = 0, null, text)").alias("gold_sql"), F.expr("if(doc_id % 7 = 0, null, lang)").alias("db_id"))
    return D.mark_missing(df, ["gold_sql", "db_id"]).select("doc_id", "status", "ex_result")


@query("""SELECT doc_id, coalesce(a, b, '') AS sql_first, coalesce(b, a, '') AS gold_first FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS a, CASE WHEN doc_id % 3 = 0 THEN source END AS b FROM documents) s""")
def sql_column_fallback(t, spark):
    df = t("documents").select("doc_id", F.expr("if(doc_id % 2 = 0, lang, null)").alias("SQL"), F.expr("if(doc_id % 3 = 0, source, null)").alias("gold_sql"))
    return df.select("doc_id", D.presence_fallback(F.col("SQL"), F.col("gold_sql")).alias("sql_first"), D.presence_fallback(F.col("gold_sql"), F.col("SQL")).alias("gold_first"))


@query("SELECT doc_id, quality FROM labels WHERE quality = 0")
def needs_fix_filter(t, spark):
    df = t("labels").withColumn("status", D.status_of(F.col("quality") == 1))
    return D.needs_fix(df).select("doc_id", "quality")


# ---- merging, expansion --------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def merge_union(t, spark):
    d = t("documents").select("doc_id", "lang")
    return D.merge(d, d.where("doc_id % 2 = 0"), d.where("lang = 'de'"))


@query("""SELECT * FROM (SELECT doc_id, NULL AS evolve_id, NULL AS direction_id, 'ok' AS status, NULL AS ex_result FROM documents UNION ALL
SELECT doc_id, (doc_id % 3)::INTEGER, NULL, 'unverified', '[]' FROM documents UNION ALL
SELECT doc_id, 1, (doc_id % 6)::INTEGER, CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'ok' END, '[(1,)]' FROM documents) s WHERE status IN ('ok', 'unverified') AND ex_result IS DISTINCT FROM '[]'""")
def merge_schema_drift(t, spark):
    d = t("documents").select("doc_id")
    a = d.withColumns({"status": F.lit("ok"), "ex_result": F.lit(None).cast("string")})
    b = d.withColumns({"evolve_id": (F.col("doc_id") % 3).cast("int"), "status": F.lit("unverified"), "ex_result": F.lit("[]")})
    c = d.withColumns({"evolve_id": F.lit(1), "direction_id": (F.col("doc_id") % 6).cast("int"), "status": F.expr("if(doc_id % 2 = 0, 'failed', 'ok')"), "ex_result": F.lit("[(1,)]")})
    return D.merge_filtered(a, b, c).select("doc_id", "evolve_id", "direction_id", "status", "ex_result")


@query("SELECT doc_id, e::INTEGER AS evolve_id FROM documents, range(3) r(e)")
def breadth_expand(t, spark):
    return D.expand(t("documents").select("doc_id"), 3)


@query("""SELECT doc_id, (i - 1)::INTEGER AS position, p[i] AS direction_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN []::INTEGER[] WHEN doc_id % 4 = 1 THEN NULL
ELSE [(doc_id % 6)::INTEGER, ((doc_id + 1) % 6)::INTEGER] END AS p FROM documents) s, unnest(generate_series(1, len(p))) u(i)""")
def direction_explode(t, spark):
    p = F.expr("case when doc_id % 4 = 0 then cast(array() as array<int>) when doc_id % 4 = 1 then null else array(cast(doc_id % 6 as int), cast((doc_id + 1) % 6 as int)) end")
    return D.explode_directions(t("documents").select("doc_id", p.alias("proposal")))


@query("SELECT doc_id, d::INTEGER AS direction_id FROM documents, range(6) r(d)")
def direction_all(t, spark):
    return D.all_directions(t("documents").select("doc_id"))


@query()
def direction_sample(t, spark):
    return t("documents").select("doc_id", D.some_directions(2, 6, "doc_id", seed=7).alias("proposal"))


@query("""SELECT o_custkey, o_orderkey, r::INTEGER AS rank, (o_orderkey % 6)::INTEGER AS axis FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) s WHERE r <= 2""")
def topk_axes(t, spark):
    top = D.top_k(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    letter = F.expr("substr('ABCDEF', cast(o_orderkey % 6 as int) + 1, 1)")
    return top.select("o_custkey", "o_orderkey", "rank", (F.position(letter, F.lit(D.AXES)) - 1).alias("axis"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2,1' WHEN doc_id % 3 = 1 THEN '0' ELSE '5,4' END AS axes FROM documents""")
def axes_from_details(t, spark):
    """Ties keep their order; an unknown axis counts for the cut and then goes."""
    details = F.expr("""case when doc_id % 3 = 0 then array(named_struct('axis', 'A', 'score', 0.1D), named_struct('axis', 'c', 'score', 0.9D), named_struct('axis', 'B', 'score', 0.9D))
        when doc_id % 3 = 1 then array(named_struct('axis', 'Z', 'score', 1.0D), named_struct('axis', 'A', 'score', 0.7D), named_struct('axis', 'B', 'score', 0.6D))
        else array(named_struct('axis', 'E', 'score', 0.5D), named_struct('axis', ' F ', 'score', 0.8D)) end""")
    return t("documents").select("doc_id", F.array_join(D.top_axes(details, 2).cast("array<string>"), ",").alias("axes"))


# ---- joins ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_qid(t, spark):
    return D.not_done(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("""WITH d AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 6)::INTEGER END AS direction_id FROM documents)
SELECT question_id, direction_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.question_id % 2 = 0 AND e.question_id = d.question_id AND e.direction_id IS NOT DISTINCT FROM d.direction_id)""")
def resume_anti_pair(t, spark):
    d = t("documents").select(F.col("doc_id").alias("question_id"), F.expr("if(doc_id % 5 <> 0, cast(doc_id % 6 as int), null)").alias("direction_id"))
    return D.not_done(d, d.where("question_id % 2 = 0"), ["question_id", "direction_id"])


@query("""SELECT c_custkey, n_name, n_name IS NULL AS _rejected, CASE WHEN n_name IS NULL THEN 'schema_not_found' END AS _reject_reason
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n_nationkey""")
def schema_lookup_reject(t, spark):
    out = D.lookup_or_reject(t("customer").select("c_custkey", "c_nationkey"), t("nation").where("n_nationkey % 2 = 0"), "c_nationkey", "n_nationkey", "n_name", "schema_not_found")
    return out.select("c_custkey", "n_name", "_rejected", "_reject_reason")


@query("SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, source) AS source FROM documents LEFT JOIN labels l USING (doc_id)")
def resume_overlay(t, spark):
    newer = t("labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return D.overlay(t("documents").select("doc_id", "source"), newer, "doc_id", ["source"])


@query("SELECT source, arg_max(lang, doc_id) AS lang, max(doc_id) AS doc_id FROM documents GROUP BY source")
def mapping_last_wins(t, spark):
    return D.last_by_key(t("documents").select("source", "lang", "doc_id"), "source", "doc_id").select("source", "lang", "doc_id")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sql_index FROM documents")
def group_sql_index(t, spark):
    return D.index_in_group(t("documents").select("doc_id", "lang"), "lang", ["doc_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batch_index(t, spark):
    return D.batch_index(D.with_row_index(t("documents").select("doc_id"), "doc_id"), 64).select("doc_id", "row_idx", "batch")


# ---- keys ----------------------------------------------------------------------------------------------


def _profile(t, spark) -> DataFrame:
    return t("orders").agg(F.lit("orders").alias("table_name"), F.lit(True).alias("is_integer"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("max_value"))


@query("SELECT 'orders' AS table_name, max(o_orderkey) AS max_value, true AS is_integer, false AS is_composite FROM orders UNION ALL SELECT 'lineitem', 0, false, true UNION ALL SELECT 'nation', max(n_nationkey), true, false FROM nation")
def pk_profile(t, spark):
    for name in ("orders", "lineitem", "nation"):
        t(name).createOrReplaceTempView(name)
    tables = [keys.Table("orders", ("o_orderkey",)), keys.Table("lineitem", ("l_orderkey", "l_linenumber")), keys.Table("nation", ("n_nationkey",))]
    return keys.key_profile(spark, tables).select("table_name", "max_value", "is_integer", "is_composite")


_RANGES = """SELECT doc_id, lang, m + 1 + (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) * 10 AS "start", m + 10 + (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) * 10 AS "end" FROM documents, (SELECT max(o_orderkey) AS m FROM orders) o"""


def _ranges(t, spark) -> DataFrame:
    profile = t("documents").select("lang").distinct().crossJoin(F.broadcast(_profile(t, spark)))
    return keys.key_ranges(t("documents").select("doc_id", "lang"), profile, "lang", ["doc_id"]).select("doc_id", "lang", "start", "end")


@query(_RANGES)
def pk_range_alloc(t, spark):
    return _ranges(t, spark)


@query(f"""WITH r AS ({_RANGES}) SELECT doc_id, "start" + (doc_id % 13) - 1 AS pk_value FROM r WHERE NOT ("start" + (doc_id % 13) - 1 BETWEEN "start" AND "end")""")
def pk_range_violation(t, spark):
    ranges = _ranges(t, spark)
    inserts = ranges.select("doc_id", (F.col("start") + F.col("doc_id") % 13 - 1).alias("pk_value"))
    return keys.out_of_range(inserts, ranges, ["doc_id"]).select("doc_id", "pk_value")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND c_custkey IN (SELECT o_custkey FROM orders)")
def fk_semi(t, spark):
    nations = t("nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    return t("customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left_semi").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def fk_orphans(t, spark):
    return keys.orphans(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_custkey % 3 <> 0"), "o_custkey", "c_custkey")


@query("""SELECT asked, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN tail END AS resolved FROM (
SELECT a.asked, max(CASE WHEN lower(k.name) = lower(a.asked) THEN k.name END) AS exact, count(CASE WHEN lower(split_part(k.name, '.', 2)) = lower(a.asked) THEN 1 END) AS n,
max(CASE WHEN lower(split_part(k.name, '.', 2)) = lower(a.asked) THEN k.name END) AS tail
FROM (VALUES ('ORDERS'), ('main.orders'), ('nation'), ('nope'), ('Customer')) a(asked), (VALUES ('main.orders'), ('main.nation'), ('aux.nation'), ('main.customer')) k(name) GROUP BY a.asked) s""")
def name_resolution(t, spark):
    known = spark.sql("select * from values ('main.orders'), ('main.nation'), ('aux.nation'), ('main.customer') as k(name)")
    asked = spark.sql("select * from values ('ORDERS'), ('main.orders'), ('nation'), ('nope'), ('Customer') as a(asked)")
    return linking.resolve_names(asked, known, "asked", "name").select("asked", "resolved")


# ---- statistics ----------------------------------------------------------------------------------------


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS compilable, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS failed,
round(count(*) FILTER (WHERE quality = 1) / greatest(count(*), 1), 4) AS compilable_rate FROM labels""")
def verify_stats(t, spark):
    return D.verification_stats(t("labels").withColumn("status", D.status_of(F.col("quality") == 1)))


_REASON = "CASE WHEN o_orderkey % 7 = 0 THEN 'api_error' WHEN o_orderkey % 7 = 1 THEN 'parse_failed' WHEN o_orderkey % 7 = 2 THEN 'sql_failed' WHEN o_orderkey % 7 = 3 THEN 'schema_not_found' END"


@query(f"""SELECT count(*) AS processed, count(*) FILTER (WHERE r IS NULL) AS valid, count(r) AS rejected, count(*) FILTER (WHERE r IN ('api_error', 'parse_failed')) AS parse_failed,
count(*) FILTER (WHERE r = 'sql_failed') AS sql_failed, round(count(*) FILTER (WHERE r IS NULL) / greatest(count(*), 1), 4) AS success_rate FROM (SELECT {_REASON} AS r FROM orders) s""")
def reject_stats(t, spark):
    return D.rejection_stats(t("orders").select(F.expr(_REASON).alias("_reject_reason")))


@query("""SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS success, count(*) FILTER (WHERE l_returnflag <> 'R') AS failed, sum(l_linenumber)::BIGINT AS rows_inserted,
round(count(*) FILTER (WHERE l_returnflag = 'R') / greatest(count(*), 1), 4) AS success_rate FROM lineitem""")
def inject_stats(t, spark):
    return D.injection_stats(t("lineitem").select((F.col("l_returnflag") == "R").alias("inject_success"), F.col("l_linenumber").alias("inject_count")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN (doc_id % 5)::INTEGER END AS _sample_round, CASE WHEN doc_id % 5 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'parse_failed' ELSE 'sql_failed' END END AS _reject_reason FROM documents""")
def rounds_state(t, spark):
    """A record is accepted in the first round whose outcome is good; the last round's failure is its reason."""
    df = t("documents").select("doc_id").withColumns({"_sample_round": F.lit(None).cast("int"), "_reject_reason": F.lit(None).cast("string")})
    for r in range(4):
        pending = F.col("_sample_round").isNull() & F.col("_reject_reason").isNull()
        good = F.col("doc_id") % 5 == r
        failed = pending & ~good & F.lit(r == 3)
        df = df.withColumns({"_sample_round": F.when(pending & good, r).otherwise(F.col("_sample_round")), "_reject_reason": F.when(failed, F.expr("if(doc_id % 2 = 0, 'parse_failed', 'sql_failed')")).otherwise(F.col("_reject_reason"))})
    return df


@query("SELECT count(*) FILTER (WHERE a IS DISTINCT FROM b) AS fixed FROM (SELECT lang AS a, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN lang ELSE source END AS b FROM documents) s")
def fixed_count(t, spark):
    df = t("documents").select("lang", F.expr("case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then lang else source end").alias("new"))
    return df.agg(D.changed(F.col("lang"), F.col("new")).alias("fixed"))


# ---- duplicates ----------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dup_keep_first(t, spark):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_SIMS = "SELECT a.vec_id, b.vec_id AS other, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"


@query(f"SELECT label, vec_id, other AS neighbour, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, other) AS k FROM ({_SIMS}) p) q WHERE k = 1")
def nn_top1(t, spark):
    return dedup.nearest(t("embeddings"), "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH RECURSIVE e AS (SELECT label, least(vec_id, other) AS a, greatest(vec_id, other) AS b FROM ({_SIMS}) p WHERE s > 0.35 GROUP BY ALL),
o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS gone FROM (SELECT DISTINCT label FROM embeddings) l UNION ALL
SELECT f.label, f.n + 1, CASE WHEN list_contains(f.gone, o.vec_id) THEN f.gone ELSE list_concat(f.gone, coalesce((SELECT list(e.b) FROM e WHERE e.a = o.vec_id), []::BIGINT[])) END FROM f JOIN o ON o.label = f.label AND o.n = f.n + 1),
g AS (SELECT label, arg_max(gone, n) AS gone FROM f GROUP BY label)
SELECT o.vec_id, o.label FROM o JOIN g USING (label) WHERE NOT list_contains(g.gone, o.vec_id)""")
def semantic_dedup(t, spark):
    return dedup.semantic_dedup(t("embeddings"), "label", "vec_id", "embedding", threshold=0.35).select("vec_id", "label")


# ---- responses, texts ----------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_lenient(t, spark):
    """JSON in prose: fenced, bare with a trailing comma, with comments and bare keys, or none."""
    response = F.expr("""case when event_id % 4 = 0 then concat('Here:\\n```json\\n', props, '\\n```\\nbye') when event_id % 4 = 1 then concat('Sure ', replace(props, '}', ',}'))
        when event_id % 4 = 2 then concat('// note\\n', replace(props, '"', '')) else 'no json here' end""")
    return t("events").select("event_id", F.get_json_object(X.extract_json(response), "$.k").cast("long").alias("k"))


@query("""SELECT event_id, axis, score FROM (SELECT event_id, 'A' AS axis, 0.5 AS score, event_id % 2 AS m FROM events UNION ALL SELECT event_id, 'B', round((event_id % 10) / 10.0, 1), 0 FROM events) s WHERE m = 0 AND event_id % 5 <> 4""")
def json_array_topk(t, spark):
    text = F.expr("""case when event_id % 5 = 4 then 'broken [' when event_id % 2 = 1 then concat('[{"axis":"B","score":', cast(round((event_id % 10) / 10.0, 1) as string), '}]')
        else concat('[{"axis":"A","score":0.5},{"axis":"B","score":', cast(round((event_id % 10) / 10.0, 1) as string), '}]') end""")
    parsed = t("events").select("event_id", F.from_json(text, "array<struct<axis:string,score:double>>").alias("d"))
    return parsed.select("event_id", F.explode("d").alias("x")).select("event_id", "x.axis", "x.score").where("axis is not null")


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def regex_tag(t, spark):
    return t("pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT page_id, list_last(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS last_href FROM pages")
def regex_last(t, spark):
    return t("pages").select("page_id", F.try_element_at(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.lit(-1)).alias("last_href"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'r' || doc_id END AS reasoning, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'SELECT ' || doc_id END AS answer FROM documents""")
def cot_parse(t, spark):
    response = F.expr("""case when doc_id % 3 = 0 then concat('<reasoning> r', doc_id, '\\n</reasoning>\\n<answer>\\n```sql\\nSELECT ', doc_id, '\\n```\\n</answer>')
        when doc_id % 3 = 1 then concat('x <reasoning>r', doc_id, '</reasoning><answer>SELECT ', doc_id, '</answer> y') else '<answer>SELECT 1</answer>' end""")
    return t("documents").select("doc_id", X.parse_reasoned_answer(response).alias("p")).select("doc_id", "p.reasoning", "p.answer")


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS shown FROM documents")
def truncate_300(t, spark):
    return t("documents").select("doc_id", X.truncate(F.col("text"), 300).alias("shown"))


@query("""SELECT doc_id, regexp_matches(v, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$') AS email, regexp_matches(v, 'https?://') AS url FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a.b-' || doc_id || '@ex.org' WHEN doc_id % 3 = 1 THEN 'http://x.org/' || doc_id ELSE lang END AS v FROM documents) s""")
def is_email_url(t, spark):
    v = F.expr("case when doc_id % 3 = 0 then concat('a.b-', doc_id, '@ex.org') when doc_id % 3 = 1 then concat('http://x.org/', doc_id) else lang end")
    return t("documents").select("doc_id", X.is_email(v).alias("email"), X.is_url(v).alias("url"))


@query("SELECT doc_id, replace(replace(replace('Q: {QUESTION} {{keep}} E: {EVIDENCE}', '{QUESTION}', lang), '{EVIDENCE}', CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END), '{NOPE}', 'x') AS prompt FROM documents")
def template_render(t, spark):
    return t("documents").select("doc_id", X.render_template("Q: {QUESTION} {{keep}} E: {EVIDENCE}", {"QUESTION": F.col("lang"), "EVIDENCE": F.expr("if(doc_id % 2 = 0, source, null)"), "NOPE": F.lit("x")}).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Hint: ' || source || chr(10) || lang ELSE lang END AS prompt FROM documents")
def prompt_hint(t, spark):
    return t("documents").select("doc_id", X.prompt_with_hint(F.col("lang"), F.expr("case when doc_id % 3 = 0 then concat(' ', source, ' ') when doc_id % 3 = 1 then '  ' end")).alias("prompt"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(lang || ' , ' || source || ',, x', ','), lambda v: trim(v)), lambda v: v <> ''), '|') AS parts FROM documents")
def list_parse(t, spark):
    return t("documents").select("doc_id", F.array_join(X.parse_list(F.concat("lang", F.lit(" , "), "source", F.lit(",, x"))), "|").alias("parts"))


@query("""SELECT p_brand, array_to_string(CASE WHEN m > 50 THEN []::VARCHAR[] WHEN m > 20 THEN ex[1:1] ELSE ex[1:3] END, '|') AS examples FROM (
SELECT p_brand, ex, greatest(length(ex[1]), length(ex[2]), length(ex[3])) AS m FROM (SELECT p_brand, list(p_name ORDER BY p_name) AS ex FROM (SELECT DISTINCT p_brand, p_name FROM part) d GROUP BY p_brand) e) s""")
def examples_profile(t, spark):
    ex = t("part").select("p_brand", "p_name").distinct().groupBy("p_brand").agg(F.sort_array(F.collect_list("p_name")).alias("ex"))
    return ex.select("p_brand", F.array_join(X.shown_examples(F.col("ex")), "|").alias("examples"))


@query("""SELECT r_name, '# Table: ' || r_name || chr(10) || '[' || chr(10) || string_agg('(' || n_name || ':' || 'TEXT' || CASE WHEN n_nationkey % 2 = 0 THEN ', Primary Key' ELSE '' END || ')', ',' || chr(10) ORDER BY n_nationkey) || chr(10) || ']' AS block
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def mschema_text(t, spark):
    fields = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("table_name"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("field"), F.lit("text(10)").alias("type"), (F.col("n_nationkey") % 2 == 0).alias("primary_key"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("array<string>").alias("examples")
    )
    return linking.table_blocks(fields, []).select(F.col("table_name").alias("r_name"), "block")


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer, count(*) AS turns FROM conversations GROUP BY conv_id")
def messages_last_assistant(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"), F.count("*").alias("turns"))


# ---- SQL service ---------------------------------------------------------------------------------------

_PAIRS = [
    (1, "SELECT n_name FROM nation", "SELECT n_name FROM nation ORDER BY n_name DESC"),
    (2, "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation"),
    (3, "SELECT n_nationkey FROM nation WHERE n_nationkey < 5", "SELECT n_nationkey * 1.0 FROM nation WHERE n_nationkey < 5"),
    (4, "SELECT n_nationkey FROM nation", "SELECT CAST(n_nationkey AS STRING) FROM nation"),
    (5, "SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE n_nationkey > 0"),
    (6, "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT r_name FROM region WHERE r_regionkey < 0"),
    (7, "SELECT nope FROM nation", "SELECT n_name FROM nation"),
    (8, "SELECT NULL AS x", "SELECT NULL AS y UNION ALL SELECT NULL"),
]


@query("SELECT * FROM (VALUES (1::BIGINT, true), (2, true), (3, true), (4, false), (5, false), (6, true), (7, false), (8, true)) v(row_idx, equal)")
def result_set_equal(t, spark):
    for name in ("nation", "region"):
        t(name).createOrReplaceTempView(name)
    return sqlservice.compare_batch(spark, _PAIRS, seconds=60)


CANDIDATES = [
    (0, "SELECT count(*) FROM nation"),
    (1, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name"),
    (2, "SELECT n_name FROM nation WHERE n_nationkey < 0"),
    (3, "SELEC n_name FROM nation"),
    (4, "SELECT no_such_column FROM nation"),
    (5, "SELECT 1; SELECT 2"),
    (6, ""),
    (7, "DROP TABLE nation"),
    (8, "INSERT INTO nation VALUES (99, 'X', 0)"),
    (9, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS a FROM customer GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY c_mktsegment"),
    (10, "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 5) SELECT max(n) FROM s"),
    (11, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
]


@query()
def verify_batch(t, spark):
    for name in ("nation", "region", "customer", "orders"):
        t(name).createOrReplaceTempView(name)
    return sqlservice.verify_batch(spark, CANDIDATES, seconds=60)


@query()
def verify_timeout(t, spark):
    slow = "SELECT sum(hash(id, id % 7)) FROM range(1000000000000)"
    return sqlservice.verify_batch(spark, [(0, slow), (1, "SELECT 1")], seconds=3)


@query()
def sql_reference_extract(t, spark):
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        t(name).createOrReplaceTempView(name)
    texts = [(i, s) for i, s in CANDIDATES if i in (0, 1, 9, 11)] + [
        (20, "WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT n_name, n FROM c JOIN nation ON k = n_nationkey"),
        (21, "SELECT * FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)"),
    ]
    return linking.reference_rows(spark, texts)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 30")
def fetch_cap(t, spark):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(sqlservice.VERIFY_ROWS)


@query("""SELECT 'base' AS side, count(*) AS n FROM nation WHERE n_name = 'ATLANTIS' UNION ALL SELECT 'overlay', count(*) FROM (SELECT n_name FROM nation UNION ALL SELECT 'ATLANTIS') s WHERE n_name = 'ATLANTIS'""")
def inject_overlay(t, spark):
    for name in ("nation", "region"):
        t(name).createOrReplaceTempView(name)
    table = keys.Table("nation", ("n_nationkey",), ("n_name",), (("n_regionkey", "region", "r_regionkey"),))
    count, errors, overlaid = keys.checked_overlay(spark, ["INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (1000, 'ATLANTIS', 1)"], {"nation": table})
    if errors or count != 1:
        raise ValueError(f"the overlay was refused: {errors}")
    n = F.count_if(F.col("n_name") == "ATLANTIS").alias("n")
    return t("nation").agg(F.lit("base").alias("side"), n).union(overlaid["nation"].agg(F.lit("overlay").alias("side"), n))


# ---- the SQL surface: axes A to F ----------------------------------------------------------------------

sql_query("axisA_scalar_subq", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql_query("axisA_correlated", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("axisA_cte", "WITH spend AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) SELECT c_name, n, total FROM spend JOIN customer ON c_custkey = o_custkey WHERE n > 5")
sql_query("axisA_recursive", "WITH RECURSIVE s(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 12) SELECT n, f FROM s")
sql_query("axisB_boolean", "SELECT p_partkey FROM part WHERE (p_size > 20 AND NOT p_brand = 'Brand#11') OR (p_retailprice < 950 AND p_size IN (1, 2, 3))")
sql_query("axisB_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10 AND max(o_totalprice) > 1000")
sql_query("axisB_order_expr", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a FROM supplier ORDER BY abs(s_acctbal) DESC, s_nationkey, s_suppkey LIMIT 20")
sql_query("axisC_between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#12', 'Brand#13', 'Brand#22')")
sql_query("axisC_notin_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey = 9 THEN NULL ELSE r_regionkey END FROM region WHERE r_regionkey < 3)")
sql_query("axisC_like", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_name LIKE '%7' AND c_mktsegment LIKE '_U%'")
sql_query("axisC_case", "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END")
sql_query("axisD_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query(
    "axisD_date",
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, cast(max(o_orderdate) AS date) AS last FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' GROUP BY year(o_orderdate), month(o_orderdate)",
    "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n, cast(max(o_orderdate) AS date) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY ALL",
)
sql_query("axisD_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(power(p_size, 2), 2) AS square, abs(p_size - 25) AS off, p_size % 7 AS rest FROM part")
sql_query("axisD_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d, ntile(4) OVER (ORDER BY c_custkey) AS q FROM customer")
sql_query("axisD_lag", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, lead(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders")
sql_query("axisD_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM orders")
sql_query("axisE_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql_query("axisE_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql_query("axisE_right", "SELECT r_name, n_name FROM (SELECT * FROM nation WHERE n_nationkey < 6) n RIGHT JOIN region ON n_regionkey = r_regionkey")
sql_query("axisE_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
sql_query("axisE_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("axisE_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_query("axisE_nonequi", "SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 6 GROUP BY r_regionkey")
sql_query("axisE_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey")
sql_query("axisE_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql_query("axisF_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("axisF_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("axisF_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql_query("axisF_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
sql_query("axisF_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
sql_query("axisF_not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
sql_query("seed_top_one", "SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
