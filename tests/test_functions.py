import json

import pytest
from pyspark.sql import functions as F

from sqlloom.functions import sqlite_dialect
from sqlloom.functions import text as X


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('a ```json\n{"a": 1,}\n``` b', {"a": 1}),
        ('say {"a": [1, 2,],} now', {"a": [1, 2]}),
        ("[1, 2]", [1, 2]),
        ("{a: 1, // note\n b: 'x' }", None),
        ('{a: 1, /* note */ b: "x"}', {"a": 1, "b": "x"}),
        ('﻿{"u": "http://x"}', {"u": "http://x"}),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient_json(text, value):
    got = X.lenient_json(text)
    assert (None if got is None else json.loads(got)) == value


def test_inserts():
    response = "old ```sql\nINSERT INTO x VALUES (0)\n``` new ```sql\nINSERT INTO t (id, n) VALUES (1, 'a;b, c'), (2, 'it''s');\nSELECT 1;\ninsert into \"u v\" values (3, f(1, 2))\n```"
    got = X.parse_inserts(response)
    assert len(got) == 2
    assert X.parse_insert(got[0]) == ("t", ["id", "n"], [["1", "'a;b, c'"], ["2", "'it''s'"]])
    assert X.parse_insert(got[1]) == ("u v", None, [["3", "f(1, 2)"]])
    assert X.parse_inserts(None) == [] and X.parse_insert("SELECT 1") is None


def test_columns(spark):
    df = spark.createDataFrame([("a@b.cd", "x" * 301, "<reasoning> r </reasoning> <answer>\n```sql\nSELECT 1\n```</answer>", " a, b ,,c"), (None, None, None, None)], "e string, t string, c string, l string")
    one, two = df.select(
        X.is_email(F.col("e")).alias("e"), X.truncate(F.col("t"), 300).alias("t"), X.parse_reasoned_answer(F.col("c")).alias("c"), X.parse_list(F.col("l")).alias("l"), X.render_template("{A}{{A}}{B}", {"A": F.lit("{B}"), "B": F.col("e")}).alias("r")
    ).collect()
    assert one["e"] and one["t"] == "x" * 300 + "..." and tuple(one["c"]) == ("r", "SELECT 1") and one["l"] == ["a", "b", "c"]
    assert one["r"] == "a@b.cd{a@b.cd}a@b.cd"
    assert two["c"] is None and two["t"] is None


def test_fence_and_examples(spark):
    df = spark.createDataFrame([("x ```sql\nA\n``` y ```sql\n B \n``` z", ["a", "", None, "b", "c", "d"]), ("plain ", ["y" * 25, "z"]), ("", ["q@w.er"]), ("", ["v" * 51])], "t string, x array<string>")
    rows = df.select(X.last_fence(F.col("t")).alias("t"), X.shown_examples(F.col("x")).alias("x")).collect()
    assert [r["t"] for r in rows] == ["B", "plain", "", ""]
    assert [r["x"] for r in rows] == [["a", "b", "c"], ["y" * 25], [], []]


def test_examples_of_the_first_three(spark):
    df = spark.createDataFrame([(["a", "b", "c", "v" * 60], "TEXT"), (["x", "see http://y.z"], "TEXT"), (["2020-01-01 00:00:00.000", "z"], "datetime(3)"), ([], "DATE")], "x array<string>, d string")
    assert [r[0] for r in df.select(X.shown_examples(F.col("x"), F.col("d"))).collect()] == [["a", "b", "c"], [], ["2020-01-01 00:00:00.000"], []]


def test_fence_among_prose(spark):
    text = "<reasoning>r</reasoning><answer>Here it is:\n```sql\nSELECT 2\n```\nas asked.</answer>"
    assert spark.createDataFrame([(text,)], "c string").select(X.parse_reasoned_answer(F.col("c")).alias("c")).first()["c"]["answer"] == "SELECT 2"


def test_decimals_are_compared_exactly(spark):
    from sqlloom.operators.sqlservice import same_results

    one = lambda text: spark.sql(f"select {text} as v")
    big = "cast('12345678901234567.{}' as decimal(30,1))"
    assert not same_results(one(big.format(1)), one(big.format(2))) and same_results(one(big.format(1)), one(big.format(1)))
    assert same_results(one("cast(5 as decimal(10,2))"), one("5")) and same_results(one("cast('0.1' as decimal(10,3))"), one("0.1D"))


def test_dialect():
    assert sqlite_dialect.rewrite("SELECT a LIKE 'LIKE' FROM t WHERE b == 1") == "SELECT a ILIKE 'LIKE' FROM t WHERE b = 1"
    assert sqlite_dialect.rewrite("SELECT strftime('%Y-%m', d) FROM t") == "SELECT date_format(to_timestamp(d), 'yyyy-MM') FROM t"
    with pytest.raises(ValueError):
        sqlite_dialect.strftime("%W")
