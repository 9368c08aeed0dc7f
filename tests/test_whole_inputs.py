"""Queries over all rows of their tables, in a folder with ids on both sides of the former filters."""

import datetime

import duckdb

from provenir.plans import catalogue, layer_queries, model_queries, more


def test_no_id_subsets(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    tables = {
        "events": ([(5500, now, 7, "a", 1.0, "{}"), (5501, now, 10, "a", 1.0, "{}"), (5511, now, 7, "b", 1.0, "{}")], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
        "orders": ([(1, "R"), (20, "S")], "o_orderkey bigint, o_orderpriority string"),
        "lineitem": ([(1, 5, 8, 1), (20, 5, 9, 1)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"),
        "part": ([(5, 3)], "p_partkey bigint, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    assert {tuple(r) for r in catalogue.j6_event_inverse(spark, d).select("event_type", "user_id").collect()} == {("a", 7), ("a", 10), ("b", 7)}
    assert {tuple(r) for r in layer_queries.v14_layer_issues(spark, d).select("event_id", "kind").collect()} == {(5501, "syntax"), (5511, "duplicate_id")}
    assert {tuple(r) for r in model_queries.j21_role_rules(spark, d).select("role", "rule_id").collect()} == {("R", 8), ("R", 100003), ("S", 9), ("S", 100003)}


def test_object_class_sees_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "s", "plain words " * 60 + "a database"), (2, "s", "plain words " * 60), (3, "crm", "x"), (4, "scrm", None)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in model_queries.f16_object_class(spark, str(tmp_path)).collect()} == {(1, "system"), (2, "data"), (3, "system"), (4, "data")}


def test_the_first_of_equal_lines_is_the_first_in_the_files(spark, tmp_path):
    # The later file is the larger one, which Spark reads first.
    for part, rows in enumerate([[(k, 100 - k, 1) for k in range(100)], [(k % 100, 1000 + k, 1) for k in range(40_000)]]):
        spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet/part={part}")
    got = {tuple(r) for r in more.k3_first_wins(spark, str(tmp_path)).collect()}
    assert got == {(k, 100 - k) for k in range(100)}


def test_lines_without_a_number_or_a_part_lose(spark, tmp_path):
    rows = [(1, None, 1), (1, 5, 2), (2, 7, None), (2, 8, 3), (3, 9, None), (4, None, None), (None, 3, 2), (None, 4, 1), (5, None, 1), (5, None, 2), (6, 1, 1), (6, None, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in more.k3_first_wins(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.sql(catalogue.SQL["k3_first_wins"]).fetchall()) == {(1, 5), (2, 8), (3, None), (4, None), (None, 4), (5, None), (6, 1)}
