"""Catalog scans over an embedded database, key columns by position, evidence by its places."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provenir.operators import schema_seed as S
from provenir.sources import catalogs as C
from provenir.sources import ddl

DUMP = """
CREATE TABLE orders (id int NOT NULL, day varchar(10) NOT NULL, total decimal(9,2), status enum('new','it''s done') NOT NULL, PRIMARY KEY (day, id), CHECK (status IN ('new','it''s done')));
CREATE TABLE lines (nr int NOT NULL, order_id int, order_day varchar(10), note varchar(20), PRIMARY KEY (nr), UNIQUE (order_id, note),
  CONSTRAINT to_order FOREIGN KEY (order_day, order_id) REFERENCES orders (day, id) ON DELETE CASCADE);
"""
#: The views of that database, as an information schema has them; ``check_constraints``, ``routines`` and ``parameters`` are missing in it.
VIEWS = {
    "tables": ("table_schema varchar(20), table_name varchar(20), table_type varchar(20), table_comment varchar(50)", "('shop','orders','BASE TABLE',' all orders '), ('shop','lines','BASE TABLE',''), ('sys2','other','BASE TABLE','')"),
    "columns": (
        "table_schema varchar(20), table_name varchar(20), column_name varchar(20), column_type varchar(40), is_nullable varchar(3), column_default varchar(20), ordinal_position int, column_comment varchar(20)",
        "('shop','orders','status','enum(''new'',''it''''s done'')','NO',NULL,4,''), ('shop','orders','id','int','NO',NULL,1,'the number'), ('shop','orders','day','varchar(10)','NO',NULL,2,''), ('shop','orders','total','decimal(9,2)','YES',NULL,3,''),"
        "('shop','lines','nr','int','NO',NULL,1,''), ('shop','lines','order_id','int','YES',NULL,2,''), ('shop','lines','order_day','varchar(10)','YES',NULL,3,''), ('shop','lines','note','varchar(20)','YES',NULL,4,''), ('sys2','other','x','int','YES',NULL,1,''), ('shop','big','id','int','NO',NULL,1,'')",
    ),
    "key_column_usage": (
        "constraint_schema varchar(20), constraint_name varchar(20), table_schema varchar(20), table_name varchar(20), column_name varchar(20), ordinal_position int, referenced_table_schema varchar(20), referenced_table_name varchar(20), referenced_column_name varchar(20)",
        "('shop','PRIMARY','shop','orders','id',2,NULL,NULL,NULL), ('shop','PRIMARY','shop','orders','day',1,NULL,NULL,NULL), ('shop','PRIMARY','shop','lines','nr',1,NULL,NULL,NULL), ('shop','u','shop','lines','note',2,NULL,NULL,NULL), ('shop','u','shop','lines','order_id',1,NULL,NULL,NULL),"
        "('shop','to_order','shop','lines','order_id',2,'shop','orders','id'), ('shop','to_order','shop','lines','order_day',1,'shop','orders','day')",
    ),
    "table_constraints": ("constraint_schema varchar(20), constraint_name varchar(20), table_schema varchar(20), table_name varchar(20), constraint_type varchar(20)", "('shop','PRIMARY','shop','orders','PRIMARY KEY'), ('shop','PRIMARY','shop','lines','PRIMARY KEY'), ('shop','u','shop','lines','UNIQUE'), ('shop','to_order','shop','lines','FOREIGN KEY')"),
    "referential_constraints": ("constraint_schema varchar(20), constraint_name varchar(20), table_name varchar(20), delete_rule varchar(20), update_rule varchar(20)", "('shop','to_order','lines','CASCADE','NO ACTION')"),
    "views": ("table_schema varchar(20), table_name varchar(20), view_definition varchar(60)", "('shop','big','select id from orders where total > 9')"),
    "triggers": ("trigger_schema varchar(20), event_object_table varchar(20), trigger_name varchar(20), action_timing varchar(20), event_manipulation varchar(20)", "('shop','orders','stamp','before','insert'), ('shop','orders','stamp','before','update')"),
}


@pytest.fixture(scope="module")
def database(spark):
    """An embedded database in memory, by the driver that comes with Spark."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement()
    run.execute("CREATE SCHEMA information_schema")
    for name, (columns, rows) in VIEWS.items():
        run.execute(f"CREATE TABLE information_schema.{name} ({columns})")
        run.execute(f"INSERT INTO information_schema.{name} VALUES {rows}")
    yield url
    connection.close()


def plain(df):
    return Counter(str(r) for r in df.collect())


def test_scan_of_an_embedded_database_is_what_its_dump_says(spark, database):
    found = C.scan(spark, C.jdbc(spark, database, parts=3), "standard", schemas=["shop"])
    assert set(found.missing) == {"checks", "routines", "parameters"} and all(found.missing.values())
    facts = found.facts.cache()
    cols = ["schema", "table", "name", "sql_type", "nullable", "ord"]
    dump = ddl.parse_ddl(spark.createDataFrame([("d", DUMP)], "file string, sql string"), default_schema="shop")
    own = facts.where("kind = 'column' AND table <> 'big'")
    # A dump writes types its own way.
    squeezed = lambda df: df.withColumn("sql_type", F.replace("sql_type", F.lit(" "), F.lit("")))
    assert plain(own.select(*[c for c in cols if c not in ("ord", "sql_type")])) == plain(dump.where("kind = 'column'").select(*[c for c in cols if c not in ("ord", "sql_type")]))
    assert plain(squeezed(own).select("name", "sql_type").where("sql_type not like 'enum%'")) == plain(squeezed(dump.where("kind = 'column'")).select("name", "sql_type").where("sql_type not like 'enum%'"))
    assert plain(own.select("table", "name", "enum_values").where("enum_values is not null")) == plain(dump.where("kind = 'column' and enum_values is not null").select("table", "name", "enum_values"))
    keys = ["kind", "table", "columns", "ref_schema", "ref_table", "ref_columns", "on_delete", "on_update"]
    of = lambda df: plain(df.where("kind in ('primary_key', 'unique', 'foreign_key')").select(*keys))
    assert of(facts) == of(dump)
    assert [tuple(r) for r in facts.where("kind = 'view'").select("schema", "table", "expression").collect()] == [("shop", "big", "select id from orders where total > 9")]
    assert {tuple(r) for r in facts.where("kind = 'table'").select("table", "comment").collect()} == {("orders", "all orders"), ("lines", None)}
    assert {tuple(r) for r in found.triggers.collect()} == {("shop", "orders", "stamp", "BEFORE", e) for e in ("INSERT", "UPDATE")}
    assert found.routines.count() == found.parameters.count() == 0
    # Seeds of the scan are those of the dump.
    assert plain(S.relationships(facts).drop("file")) == plain(S.relationships(dump).drop("file"))
    facts.unpersist()


def test_scan_needs_its_columns(spark):
    def read(view):
        raise ValueError("gone")

    with pytest.raises(ValueError):
        C.scan(spark, read, "standard")


def test_positional_catalog(spark):
    """A catalog whose constraints hold arrays of numbers, with a view, a check and triggers."""
    tables = {
        "relations": [(1, "shop", "orders", "r", " o ", None), (2, "shop", "lines", "r", None, None), (3, "shop", "big", "v", None, "SELECT 1"), (4, "pg_toast", "x", "r", None, None)],
        "attributes": [(1, 1, "id", "bigint", True, None), (1, 2, "day", "date", True, None), (1, 4, "status", "text", False, "state"), (2, 1, "nr", "int", True, None), (2, 2, "oid", "bigint", False, None), (2, 3, "oday", "date", False, None), (3, 1, "id", "bigint", False, None)],
        "defaults": [(1, 4, "'new'::text")],
        "constraints": [
            ("pk", "p", 1, 0, "2,1", None, " ", " ", None), ("fk", "f", 2, 1, "3,2", "2,1", "c", "a", None), ("lost", "f", 2, 1, "2", "9", "a", "a", None), ("u", "u", 2, 0, "2,3", None, " ", " ", None),
            ("ck", "c", 1, 0, "4", None, " ", " ", "CHECK (((status)::text = ANY ((ARRAY['new'::character varying, 'done'::character varying])::text[])))"), ("ck2", "c", 1, 0, "1", None, " ", " ", "CHECK (((id > 0) AND (id < 9)))"),
        ],
        "triggers": [(1, "stamp", "CREATE TRIGGER stamp BEFORE INSERT OR UPDATE OF day ON shop.orders FOR EACH ROW EXECUTE FUNCTION f()")],
        "routines": [("shop", "add", "function", "numeric", "a bigint, INOUT b numeric(12,2) DEFAULT 0, date, VARIADIC c text", None, "x"), ("shop", "trg", "function", "trigger", "", None, "x"), ("pg_catalog", "now", "function", "time", "", None, "x")],
    }
    by_select = {v.select: n for n, v in C.POSTGRES.items()}
    found = C.scan(spark, lambda v: spark.createDataFrame(tables[by_select[v.select]], v.columns), "postgres")
    rows = {(r["kind"], r["name"] or r["table"]): r for r in found.facts.collect()}
    assert rows["foreign_key", "fk"]["columns"] == ["oday", "oid"] and rows["foreign_key", "fk"]["ref_columns"] == ["day", "id"] and rows["foreign_key", "fk"]["on_delete"] == "CASCADE" and rows["foreign_key", "fk"]["on_update"] is None
    assert rows["primary_key", "pk"]["columns"] == ["day", "id"] and ("foreign_key", "lost") not in rows and rows["unique", "u"]["columns"] == ["oid", "oday"]
    assert rows["check", "ck"]["expression"] == "status IN ('new','done')" and rows["check", "ck"]["columns"] == ["status"]
    assert rows["check", "ck2"]["expression"] == "(id > 0) AND (id < 9)" and rows["check", "ck2"]["columns"] == ["id"]
    assert (rows["column", "status"]["default"], rows["column", "status"]["nullable"], rows["column", "status"]["comment"]) == ("'new'::text", True, "state")
    assert rows["view", "big"]["expression"] == "SELECT 1" and ("table", "x") not in rows and rows["table", "orders"]["comment"] == "o"
    assert {tuple(r) for r in found.triggers.collect()} == {("shop", "orders", "stamp", "BEFORE", "INSERT"), ("shop", "orders", "stamp", "BEFORE", "UPDATE")}
    assert [r["name"] for r in found.routines.collect()] == ["add"]
    assert sorted(tuple(r) for r in found.parameters.collect()) == [("add", 1, "a", "IN", "bigint"), ("add", 2, "b", "INOUT", "numeric(12,2)"), ("add", 4, "c", "IN", "text")]


@pytest.mark.parametrize("text, bare", [("CHECK ((a > 0))", "a > 0"), ("((a) OR (b))", "(a) OR (b)"), ("check ( ( (x) ) )", "x"), ("(a", "(a"), ("a)", "a)"), ("()", ""), ("x = 1", "x = 1"), ("((a = ANY (ARRAY['p''q'])))", "a IN ('p''q')")])
def test_bare_checks(spark, text, bare):
    assert spark.createDataFrame([(text,)], "t string").select(C.bare_check("t")).first()[0] == bare


def test_seeded_citations_survive(spark):
    dump = ddl.parse_ddl(spark.createDataFrame([("d", DUMP), ("e", DUMP.replace("orders", "Ünicode")), ("f", "")], "file string, sql string"))
    text = {r["file"]: r["text"] for r in S.textualize(dump).collect()}
    index = S.evidence_index(dump).cache()
    for r in index.collect():
        assert text[r["file"]][r["char_start"] : r["char_end"]] == r["text"] and text[r["file"]].split("\n")[r["line"] - 1] == r["text"]
    assert index.count() == sum(len(t.split("\n")) for t in text.values() if t)
    cites = S.citations(index)
    got = S.survival(cites, index).collect()
    assert len(got) == cites.count() and all(r["verified"] for r in got) and {r["node_kind"] for r in got} == {"object", "property", "relationship", "rule"}
    for r in got:
        assert text[r["file"]][r["char_start"] : r["char_end"]] == r["snippet"]
    # Wrong words, places beyond the line, unknown lines and files.
    false = [("d", "n", "object", 1, 0, 12, "TABLE public"), ("d", "n", "object", 1, 0, 400, text["d"][:400]), ("d", "n", "object", 999, 0, 5, "TABLE"), ("z", "n", "object", 1, 0, 5, "TABLE"), ("d", "n", "object", 1, 0, 0, ""), ("d", "n", "object", 1, 0, 5, None), ("d", "n", "object", 1, 0, 5, "TABLE")]
    rows = S.survival(spark.createDataFrame(false, cites.schema), index).collect()
    assert sorted((r["line"], r["char_end"], r["file"], r["verified"]) for r in rows if r["verified"]) == [(1, 5, "d", True), (1, 12, "d", True)] and len(rows) == 7
    index.unpersist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_move_once_to_either_end(spark):
    """Constraints meet lists of columns: no join by position, as few exchanges as there are ends; unknown columns and relations have no rows."""
    relations = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "relid long, table_schema string, table_name string")
    attributes = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (2, 3, "w")], "relid long, num int, column_name string")
    rows = [("fk", "f", 1, 2, [2, 1, 9], [3, 7, 1], "c", "a"), ("pk", "p", 1, None, [2, 9, 1], None, " ", " "), ("lost", "f", 1, 5, [1], [1], "a", "a"), ("odd", "x", 1, None, [1], None, " ", " "), ("far", "p", 6, None, [1], None, " ", " ")]
    constraints = spark.createDataFrame(rows, "constraint_name string, kind string, relid long, ref_relid long, conkey array<int>, confkey array<int>, on_delete string, on_update string")
    out = C.keys_by_position(constraints, attributes, relations)
    got = {(r["constraint_name"], r["ordinal_position"], r["column_name"], r["ref_table"], r["ref_column"], r["on_delete"]) for r in out.collect()}
    assert got == {("fk", 1, "y", "b", "w", "CASCADE"), ("pk", 1, "y", None, None, None), ("pk", 3, "x", None, None, None)} and out.count() == 3
    assert "num#" not in "".join(line for line in plan_of(out).splitlines() if "Join" in line)


def test_evidence_is_made_once(spark):
    """What is cited and what it is looked up in are one written index, so no table is read twice."""
    from provenir.plans import catalogue, source_queries  # noqa: F401

    assert "lineitem" not in plan_of(catalogue.QUERIES["v16_grounding_survival"](spark, "/root/testdata/sf0.001"))
