import random
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from sqlloom.operators import dataflow as D
from sqlloom.operators import dedup, generate, keys, linking, sqlservice, steps
from sqlloom.plans.runner import Checkpoint, Config, Runner, step_names
from sqlloom.sources import records, sqlite


def test_row_index_is_dense(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10_000), 500)], "k long").repartition(7)
    rows = D.with_row_index(df, "k").orderBy("k").collect()
    assert [r["row_idx"] for r in rows] == list(range(500))


def test_status_and_filters(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, True), (4, None, False)], "id int, flag boolean, there boolean")
    got = {r["id"]: r["status"] for r in df.withColumn("status", D.status_of(F.col("flag"), F.col("there"))).collect()}
    assert got == {1: "ok", 2: "failed", 3: "reset", 4: "unverified"}
    kept = D.keep_compilable(df.withColumn("status", D.status_of(F.col("flag"), F.col("there"))))
    assert {r["id"] for r in kept.collect()} == {1, 4}


def test_verify_and_compare(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    got = {r["row_idx"]: r for r in sqlservice.verify_batch(spark, [(0, "select id from numbers"), (1, "select nope from numbers"), (2, "drop view numbers"), (3, ""), (4, "select id from numbers where id < 0")]).collect()}
    assert got[0]["can_compile"] and not got[0]["is_empty"] and got[4]["is_empty"] and got[4]["ex_result"] == "[]"
    assert not any(got[i]["can_compile"] for i in (1, 2, 3))
    assert sqlservice.compare(spark, "select id from numbers", "select id * 1.0 as x from numbers order by x desc", 60)
    assert not sqlservice.compare(spark, "select id from numbers", "select cast(id as string) from numbers", 60)
    assert sqlservice.verify_batch(spark, []).count() == 0


def test_time_limit(spark):
    r = sqlservice.execute(spark, "select sum(hash(id, id % 7)) from range(1000000000000)", seconds=2)
    assert r.timed_out and not r.success


def test_references(spark):
    spark.createDataFrame([(1, "a", 2)], "id int, name string, other int").createOrReplaceTempView("left_t")
    spark.createDataFrame([(1, "b")], "key int, word string").createOrReplaceTempView("right_t")
    tables, columns = linking.references(spark, "with c as (select other as o, count(*) as n from left_t group by other) select word, n from c join right_t on o = key where exists (select 1 from left_t where id = key)")
    assert tables == {"left_t", "right_t"}
    assert {("left_t", "other"), ("right_t", "word"), ("right_t", "key"), ("left_t", "id")} <= columns and ("left_t", "name") not in columns
    assert linking.references(spark, "select * from right_t")[1] == {("right_t", "key"), ("right_t", "word")}


def test_schema_text(spark):
    fields = spark.createDataFrame(
        [("d", "t", 0, "id", "integer", True, None, ["1", "2"]), ("d", "t", 1, "made", "date", False, "day", ["2020-01-01", "2020-01-02"]), ("d", "u", 0, "t_id", "int", False, None, [])],
        "db_id string, table_name string, ordinal int, field string, type string, primary_key boolean, comment string, examples array<string>",
    )
    fks = spark.createDataFrame([("d", "u", "t_id", "t", "id")], "db_id string, table_name string, field string, ref_table string, ref_field string")
    text = linking.schema_text(fields, fks).first()["mschema_str"]
    assert text == "【DB_ID】 d\n【Schema】\n# Table: t\n[\n(id:INTEGER, Primary Key, Examples: [1, 2]),\n(made:DATE, day, Examples: [2020-01-01])\n]\n# Table: u\n[\n(t_id:INT)\n]\n【Foreign keys】\nu.t_id=t.id"
    kept, left = linking.prune(fields, fks, spark.createDataFrame([("t",), ("u",)], "table_name string"), spark.createDataFrame([("t", "made")], "table_name string, field string"))
    assert {(r["table_name"], r["field"]) for r in kept.collect()} == {("t", "made"), ("u", "t_id")} and left.count() == 0


def test_catalog_examples_are_least_values(spark):
    spark.createDataFrame([(i, "NRA"[i % 3], None) for i in range(50)], "id long, flag string, none string").createOrReplaceTempView("flags")
    got = {r["field"]: (r["ordinal"], r["type"], r["examples"]) for r in linking.catalog_fields(spark, ["flags"]).collect()}
    assert got == {"id": (0, "bigint", ["0", "1", "10"]), "flag": (1, "string", ["A", "N", "R"]), "none": (2, "string", [])}


def test_overlay(spark):
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("parent")
    spark.createDataFrame([(1, 1)], "id long, parent_id long").createOrReplaceTempView("child")
    tables = {"parent": keys.Table("parent", ("id",), ("name",)), "child": keys.Table("child", ("id",), (), (("parent_id", "parent", "id"),))}
    n, errors, made = keys.checked_overlay(spark, ["INSERT INTO parent VALUES (2, 'b')", "INSERT INTO child (id, parent_id) VALUES (2, 2), (3, 1)"], tables)
    assert (n, errors) == (3, []) and made["child"].count() == 3
    for bad in ("INSERT INTO parent VALUES (1, 'x')", "INSERT INTO parent (id) VALUES (5)", "INSERT INTO child VALUES (9, 77)", "INSERT INTO parent VALUES (1, 2, 3)", "INSERT INTO nope VALUES (1)"):
        assert keys.checked_overlay(spark, ["INSERT INTO parent VALUES (3, 'c')", bad], tables)[0] == 0
    assert keys.checked_overlay(spark, [], tables)[1]
    assert keys.insert_keys("INSERT INTO parent (name, id) VALUES ('x', 12), ('y', null)", tables["parent"], ["id", "name"]) == [12, None]


def test_ranges_are_disjoint(spark):
    samples = spark.createDataFrame([(i, "d" if i % 3 else "e") for i in range(30)], "id long, db_id string")
    profile = spark.createDataFrame([("d", "t", True, 7), ("e", "t", True, 0), ("e", "u", False, 0)], "db_id string, table_name string, is_integer boolean, max_value long")
    rows = keys.key_ranges(samples, profile, "db_id", ["id"]).collect()
    for db, top in (("d", 7), ("e", 0)):
        spans = sorted((r["start"], r["end"]) for r in rows if r["db_id"] == db)
        assert spans[0][0] == top + 1 and all(b - a == 9 for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_dedup_equals_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=6).tolist()) for i in range(120)]
    rows[50] = (50, rows[5][1], rows[5][2])
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    kept: list[int] = []
    for i, g, _ in rows:
        if all(rows[j][1] != g or unit[i] @ unit[j] <= 0.5 for j in kept):
            kept.append(i)
    got = dedup.semantic_dedup(df, "label", "id", "v", 0.5, block=16)
    assert sorted(r["id"] for r in got.collect()) == kept
    near = {r["id"]: r["neighbour"] for r in dedup.nearest(df, "label", "id", "v", block=16).collect()}
    for i, g, _ in rows:
        best = max((round(float(unit[i] @ unit[j]), 12), -j) for j, h, _ in rows if h == g and j != i)
        assert near[i] == -best[1]


def test_dedup_decides_long_chains(spark, monkeypatch):
    n = 24
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    rows = spark.range(n)
    assert sorted(r["id"] for r in dedup.greedy_keep(pairs, rows, "id", rounds=2).collect()) == list(range(0, n, 2))
    monkeypatch.setattr(dedup, "SCANNED", 10)
    monkeypatch.setattr(dedup, "TOGETHER", 2)
    assert sorted(r["id"] for r in dedup.greedy_keep(pairs, rows, "id", rounds=1).collect()) == list(range(0, n, 2))


def _rules():
    """A generator's rule; nested, so that it travels to the workers by value."""

    def rule(messages):
        text = messages[-1]["content"]
        if "PROPOSE" in text:
            return '[{"axis": "B", "score": 0.9}, {"axis": "E", "score": 0.8}, {"axis": "A", "score": 0.1}]'
        if "FIX" in text:
            return '{"sql": "select id from things where id < 3"}'
        if "SAMPLE" in text:
            return "<reasoning>so</reasoning><answer>select id from things where id < 3</answer>" if "good" in text else "no"
        return '```json\n{"question": "good ' + str(sum(map(ord, text))) + '", "gold_sql": "select id from things where id < 3",}\n```'

    return generate.RuleGenerator(rule)


def test_generate_keeps_rows(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id long, prompt string")
    gen = generate.RuleGenerator(lambda m: None if m[-1]["content"] == "p3" else m[-1]["content"].upper(), threads=3)
    got = {r["id"]: (r["response"], r["response_error"]) for r in generate.generate(df, gen).collect()}
    assert got[3] == (None, "no answer") and got[4] == ("P4", None) and len(got) == 10
    assert generate.generate_with_retry(df, gen, "id").count() == 10


def test_injection(spark):
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("parent")
    answers = iter([None, "no sql", "```sql\nINSERT INTO parent VALUES (99, 'x')\n```", "```sql\nINSERT INTO parent VALUES (3, 'x')\n```"])
    gen = generate.RuleGenerator(lambda m: next(answers))
    got, made = steps.inject(spark, {"gold_sql": "select 1"}, gen, "{TARGET_SQL}", {"parent": keys.Table("parent", ("id",))}, {"parent": (2, 11)}, attempts=4)
    assert got["inject_success"] and [h["stage"] for h in got["inject_history"]] == ["llm_fail", "parse_fail", "pk_violation", "success"] and made["parent"].count() == 2


def test_runner_resumes(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("things")
    (tmp_path / "seeds.json").write_text('[{"question_id": 1, "db_id": "d", "question": "q", "evidence": "", "SQL": "select id from things"}, {"question_id": 2, "db_id": "d", "question": "r", "evidence": "e", "SQL": "select id from things", "can_compile": null}]')
    (tmp_path / "schemas.jsonl").write_text('{"db_name": "d", "mschema_str": "old"}\n\n{"db_name": "d", "mschema_str": "new"}\n')
    templates = {"breadth": "EVOLVE {QUESTION} {GOLD_SQL}", "propose": "PROPOSE", "depth": "DEPTH {QUESTION} {METHOD}", "fix": "FIX", "sample": "SAMPLE {QUESTION} {DATABASE_SCHEMA}"}
    config = Config(input_file=str(tmp_path / "seeds.json"), output_dir=str(tmp_path / "out"), db_root_path="x", mschema_jsonl=str(tmp_path / "schemas.jsonl"), indep_rounds=1, sampling_count=2, max_samples=1, stop_after="breadth_fix", verify_workers=4)
    runner = Runner(spark, config, _rules(), templates=templates)
    assert runner.run() == ["breadth_evolve", "breadth_verify", "breadth_fix"]
    config.stop_after = ""
    again = Runner(spark, config, _rules(), templates=templates)
    assert again.run() == step_names(config)[3:]
    assert Checkpoint.load(again.checkpoint.path).get("merge") == "completed"
    final = again.table("rejection_sampling")
    assert final.count() > 0 and {r["output_sql"] for r in final.collect()} == {"select id from things where id < 3"}
    config.force_from = "dedup"
    assert Runner(spark, config, _rules(), templates=templates).run() == ["dedup", "rejection_sampling"]
    assert Config(steps="nope").validate()


def test_each_database_has_its_own_tables(spark, tmp_path):
    for name, value in (("one", 1), ("two", 2)):
        (tmp_path / name).mkdir()
        with sqlite3.connect(str(tmp_path / name / f"{name}.sqlite")) as c:
            c.execute("create table bound (v integer)")
            c.execute("insert into bound values (?)", (value,))
            c.execute(f"create table only_{name} (v integer)")
    runner = Runner(spark, Config(mode="spider", db_root_path=str(tmp_path), input_file="x", output_dir=str(tmp_path), run_name="r"), _rules(), templates={})
    records_ = spark.createDataFrame([(0, "one", "select v from bound"), (1, "two", "select v from bound"), (2, "two", "select v from only_one"), (3, "none", "select v from bound")], "row_idx long, db_id string, gold_sql string")
    got = {r["row_idx"]: (r["status"], r["ex_result"]) for r in steps.verify(records_, use_db=runner.use_db).collect()}
    assert [got[i][0] for i in range(4)] == ["ok", "ok", "failed", "failed"] and "1" in got[0][1] and "2" in got[1][1]
    runner.use_db(spark, "none")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as c:
        c.execute('create table "two words" (id integer primary key, made date, price real, raw blob)')
        c.executemany('insert into "two words" values (?, ?, ?, ?)', [(i, "2020-01-01", i / 2, b"x") for i in range(1, 101)])
    df = sqlite.read_table(spark, path, "two words")
    assert df.count() == 100 and df.dtypes == [("id", "bigint"), ("made", "string"), ("price", "double"), ("raw", "binary")]
    assert sqlite.table_names(path) == ["two words"] and sqlite.primary_key(path, "two words") == ["id"]


def test_export(spark, tmp_path):
    import json

    path = str(tmp_path / "a" / "b.json")
    assert records.write_json_array(spark.createDataFrame([(2, "é"), (1, None)], "id int, t string"), path, ["id"]) == 2
    assert json.loads(open(path, encoding="utf-8").read()) == [{"id": 1, "t": None}, {"id": 2, "t": "é"}]
