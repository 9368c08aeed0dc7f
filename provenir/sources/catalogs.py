"""Database catalogs as schema facts.

A scan reads each catalog view by itself (by JDBC in partitions, or from tables) and does all
joins in Spark. Two dialects: ``postgres``, whose constraints hold arrays of column
numbers, and ``standard``, the views of ``information_schema`` (MySQL, MariaDB and others). A view that
is missing or may not be read degrades to no rows and is named in ``missing``; only columns are needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.sources.ddl import FACT, FIELDS

#: Columns of key rows: one for each column of a constraint.
KEYS = ["table_schema", "table_name", "constraint_name", "kind", "ordinal_position", "column_name", "ref_schema", "ref_table", "ref_column", "on_delete", "on_update"]

#: Codes of kinds of constraints and of referential actions in the one catalog, their names in the other.
KINDS = {"p": "primary_key", "u": "unique", "f": "foreign_key", "PRIMARY KEY": "primary_key", "UNIQUE": "unique", "FOREIGN KEY": "foreign_key"}
ACTIONS = {"a": "NO ACTION", "c": "CASCADE", "r": "RESTRICT", "n": "SET NULL", "d": "SET DEFAULT"}


@dataclass
class View:
    """A view of a catalog: what to select, the columns, a number to split the read by, and whether a scan can do without."""

    select: str
    columns: str
    split: str | None = None
    needed: bool = False


POSTGRES = {
    "relations": View("SELECT c.oid AS relid, n.nspname AS table_schema, c.relname AS table_name, c.relkind AS kind, obj_description(c.oid) AS comment, CASE WHEN c.relkind = 'v' THEN pg_get_viewdef(c.oid, true) END AS definition FROM pg_class c, pg_namespace n WHERE n.oid = c.relnamespace AND c.relkind IN ('r', 'v')", "relid bigint, table_schema string, table_name string, kind string, comment string, definition string", "relid", True),
    "attributes": View("SELECT attrelid AS relid, attnum AS num, attname AS column_name, format_type(atttypid, atttypmod) AS sql_type, attnotnull AS not_null, col_description(attrelid, attnum) AS comment FROM pg_attribute WHERE attnum > 0 AND NOT attisdropped", "relid bigint, num int, column_name string, sql_type string, not_null boolean, comment string", "relid", True),
    "defaults": View("SELECT adrelid AS relid, adnum AS num, pg_get_expr(adbin, adrelid) AS column_default FROM pg_attrdef", "relid bigint, num int, column_default string", "relid"),
    "constraints": View("SELECT conname AS constraint_name, contype AS kind, conrelid AS relid, confrelid AS ref_relid, array_to_string(conkey, ',') AS conkey, array_to_string(confkey, ',') AS confkey, confdeltype AS on_delete, confupdtype AS on_update, CASE WHEN contype = 'c' THEN pg_get_constraintdef(oid) END AS definition FROM pg_constraint", "constraint_name string, kind string, relid bigint, ref_relid bigint, conkey string, confkey string, on_delete string, on_update string, definition string", "relid"),
    "routines": View("SELECT n.nspname AS schema, p.proname AS name, CASE p.prokind WHEN 'p' THEN 'procedure' ELSE 'function' END AS kind, CASE p.prokind WHEN 'f' THEN pg_get_function_result(p.oid) END AS returns, pg_get_function_arguments(p.oid) AS args, obj_description(p.oid) AS comment, pg_get_functiondef(p.oid) AS definition FROM pg_proc p, pg_namespace n WHERE n.oid = p.pronamespace AND p.prokind IN ('f', 'p')", "schema string, name string, kind string, returns string, args string, comment string, definition string"),
    "triggers": View("SELECT tgrelid AS relid, tgname AS name, pg_get_triggerdef(oid) AS definition FROM pg_trigger WHERE NOT tgisinternal", "relid bigint, name string, definition string"),
}
STANDARD = {
    "tables": View("SELECT table_schema, table_name, table_comment AS comment FROM information_schema.tables WHERE table_type = 'BASE TABLE'", "table_schema string, table_name string, comment string"),
    "columns": View("SELECT table_schema, table_name, column_name, column_type AS sql_type, is_nullable, column_default, ordinal_position, column_comment AS comment FROM information_schema.columns", "table_schema string, table_name string, column_name string, sql_type string, is_nullable string, column_default string, ordinal_position int, comment string", "ordinal_position", True),
    "key_usage": View("SELECT constraint_schema, constraint_name, table_schema, table_name, column_name, ordinal_position, referenced_table_schema AS ref_schema, referenced_table_name AS ref_table, referenced_column_name AS ref_column FROM information_schema.key_column_usage", "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, ref_schema string, ref_table string, ref_column string"),
    "constraints": View("SELECT constraint_schema, constraint_name, table_schema, table_name, constraint_type AS kind FROM information_schema.table_constraints", "constraint_schema string, constraint_name string, table_schema string, table_name string, kind string"),
    "rules": View("SELECT constraint_schema, constraint_name, table_name, delete_rule AS on_delete, update_rule AS on_update FROM information_schema.referential_constraints", "constraint_schema string, constraint_name string, table_name string, on_delete string, on_update string"),
    "checks": View("SELECT constraint_schema, constraint_name, check_clause AS definition FROM information_schema.check_constraints", "constraint_schema string, constraint_name string, definition string"),
    "views": View("SELECT table_schema, table_name, view_definition AS definition FROM information_schema.views", "table_schema string, table_name string, definition string"),
    "routines": View("SELECT routine_schema AS rschema, routine_name AS name, routine_type AS kind, dtd_identifier AS rtype, routine_comment AS comment FROM information_schema.routines", "rschema string, name string, kind string, rtype string, comment string"),
    "parameters": View("SELECT specific_name, ordinal_position AS ord, parameter_name AS name, parameter_mode AS pmode, dtd_identifier AS sql_type FROM information_schema.parameters WHERE parameter_name IS NOT NULL", "specific_name string, ord int, name string, pmode string, sql_type string"),
    "triggers": View("SELECT trigger_schema AS tschema, event_object_table AS ttable, trigger_name AS name, action_timing AS timing, event_manipulation AS event FROM information_schema.triggers", "tschema string, ttable string, name string, timing string, event string"),
}
DIALECTS = {"postgres": POSTGRES, "standard": STANDARD}


def jdbc(spark, url: str, parts: int = 4, **options):
    """A reader of catalog views over JDBC: ``parts`` reads at once where a view has a number to split by; nothing is written (``sessionInitStatement`` may enforce it)."""

    def read(view: View) -> DataFrame:
        source = spark.read.format("jdbc").options(url=url, dbtable=f"({view.select}) t", fetchsize="1000", **options)
        df = source.load()
        if view.split and parts > 1:
            # By remainder: catalog numbers are dense at their low end and have no useful bounds.
            number = f"MOD({view.split}, {parts})"
            df = spark.read.jdbc(url, f"({view.select}) t", predicates=[f"{number} = {k}" + (f" OR {view.split} IS NULL" if not k else "") for k in range(parts)], properties={"fetchsize": "1000", **options})
        return df

    return read


@dataclass
class Catalog:
    """``facts`` as of a schema dump, ``routines`` and their ``parameters``, ``triggers`` (one row an event), and which views were ``missing``."""

    facts: DataFrame
    routines: DataFrame
    parameters: DataFrame
    triggers: DataFrame
    missing: dict[str, str]


def named(df: DataFrame, columns: str) -> DataFrame:
    """The columns by name in any case and with their types; those that are not there are null."""
    own = {c.lower(): c for c in df.columns}
    pairs = [c.split() for c in columns.split(", ")]
    return df.select(*[(F.col(f"`{own[c]}`") if c in own else F.lit(None)).cast(t).alias(c) for c, t in pairs])


def views(spark, read, dialect: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All views of a dialect, and those that could not be read with the reason."""
    got, missing = {}, {}
    for name, view in DIALECTS[dialect].items():
        try:
            got[name] = named(read(view), view.columns)
        except Exception as e:  # noqa: BLE001  drivers raise what they like; what is needed is raised again
            if view.needed:
                raise
            got[name], missing[name] = spark.createDataFrame([], view.columns), str(e).strip().split("\n")[0][:200]
    return got, missing


# Keys -----------------------------------------------------------------------------------------------------

def by_code(c: str, codes: dict[str, str]) -> Column:
    return reduce(lambda out, kv: out.when(F.upper(F.trim(F.col(c))) == kv[0].upper(), kv[1]), codes.items(), F.when(F.lit(False), ""))


def keys_by_position(constraints: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """A row for each column of a key, unnested by position from two aligned arrays of column numbers (``conkey``, ``confkey``).

    A foreign key's position needs both columns to be known; a constraint whose relation is unknown has no rows.
    """
    kind = by_code("kind", {k: v for k, v in KINDS.items() if len(k) == 1})
    # A relation's columns, as many as databases bound, meet its constraints as one list: constraints move once to either end, and not once for each position.
    listed = attributes.groupBy("relid").agg(F.collect_list(F.struct("num", F.col("column_name").alias("name"))).alias("_cols"))
    ends = relations.select("relid", "table_schema", "table_name").join(listed, "relid")
    rows = constraints.select("constraint_name", kind.alias("kind"), "relid", "ref_relid", by_code("on_delete", ACTIONS).alias("on_delete"), by_code("on_update", ACTIONS).alias("on_update"), "conkey", F.coalesce("confkey", F.array().cast("array<int>")).alias("confkey")).where("kind IS NOT NULL")
    own = rows.join(ends, "relid")
    # Each known column of a position; one of no known column has no row.
    named = lambda num, cols, out: F.explode(F.transform(F.filter(cols, lambda x: x["num"] == F.col(num)), lambda x: x["name"])).alias(out)
    at = F.posexplode(F.arrays_zip("conkey", "confkey")).alias("at", "pair")
    place = [(F.col("at") + 1).alias("ordinal_position"), F.col("pair.conkey").alias("num"), F.col("pair.confkey").alias("ref_num")]
    # Only foreign keys have a far end.
    far = ends.toDF("ref_relid", "ref_schema", "ref_table", "_far")
    fk = own.where("kind = 'foreign_key'").join(far, "ref_relid").select("*", at).select("*", *place).select("*", named("num", "_cols", "column_name")).select("*", named("ref_num", "_far", "ref_column"))
    rest = own.where("kind <> 'foreign_key'").select("*", at).select("*", *place).select("*", named("num", "_cols", "column_name"))
    rest = rest.select("*", *[F.lit(None).cast("string").alias(c) for c in ("ref_schema", "ref_table", "ref_column")]).withColumns({"on_delete": F.lit(None).cast("string"), "on_update": F.lit(None).cast("string")})
    return fk.select(*KEYS).unionByName(rest.select(*KEYS))


def keys_by_usage(usage: DataFrame, constraints: DataFrame, rules: DataFrame) -> DataFrame:
    """The same rows from views that name each key column with its position."""
    on = ["constraint_schema", "constraint_name", "table_name"]
    kinds = constraints.select(*on, by_code("kind", {k: v for k, v in KINDS.items() if len(k) > 1}).alias("kind")).where("kind IS NOT NULL")
    own = usage.join(kinds, on).where("kind <> 'foreign_key' OR ref_table IS NOT NULL")
    acts = rules.select(*on, F.upper("on_delete").alias("on_delete"), F.upper("on_update").alias("on_update")).dropDuplicates(on)
    return own.join(acts, on, "left").select(*KEYS)


def key_facts(keys: DataFrame) -> DataFrame:
    """A fact for each constraint, its columns in order. ``NO ACTION`` is none."""
    # As wide as a constraint may be, which databases bound.
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal_position", F.lit(1 << 30)).alias("o"), F.col("column_name").alias("c"), F.col("ref_column").alias("r"))))
    by = ["table_schema", "table_name", "kind", "constraint_name"]
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("ref_schema", "ref_table")]
    acts = [F.max(F.when(F.upper(c) != "NO ACTION", F.upper(c))).alias(c) for c in ("on_delete", "on_update")]
    out = keys.groupBy(*by).agg(ordered.alias("p"), *first, *acts)
    far = F.when(F.col("kind") == "foreign_key", F.transform("p", lambda x: x["r"]))
    return fact(out, kind="kind", schema="table_schema", table="table_name", name="constraint_name", columns=F.transform("p", lambda x: x["c"]), ref_schema=F.when(F.col("kind") == "foreign_key", F.coalesce("ref_schema", "table_schema")), ref_table="ref_table", ref_columns=far, on_delete="on_delete", on_update="on_update")


# Facts ----------------------------------------------------------------------------------------------------

TYPES = dict(c.replace("`", "").split(" ", 1) for c in FACT.split(", "))


def fact(df: DataFrame, **values) -> DataFrame:
    """Rows of facts with the given columns; the others are null."""
    of = lambda v: v if isinstance(v, Column) else F.col(v)
    return df.select(*[(of(values[c]) if c in values else F.lit(None)).cast(TYPES[c]).alias(c) for c in FIELDS])


def blank(c: str) -> Column:
    """Text without its ends; none where nothing is left."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def enumerated(sql_type: str) -> Column:
    """Values that a type lists, as ``enum('a','b')`` does."""
    found = F.transform(F.regexp_extract_all(F.col(sql_type), F.lit(r"'((?:[^']|'')*)'"), 1), lambda x: F.replace(x, F.lit("''"), F.lit("'")))
    return F.when(F.col(sql_type).rlike(r"(?i)^\s*(enum|set)\s*\(") & (F.size(found) > 0), found)


def unwrapped(c: Column) -> Column:
    """Without the pairs of parentheses that hold all of the text."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"\(\s+", "("), r"\s+\)", ")")
    lead, trail = F.length(F.regexp_extract(c, r"^\(*", 0)), F.length(F.regexp_extract(c, r"\)*$", 0))
    step = lambda s, x: F.struct((s["d"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("d"), F.least(s["m"], s["d"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("m"))
    middle = F.split(F.substring(c, lead + 1, F.greatest(F.length(c) - lead - trail, F.lit(0))), "")
    least = F.aggregate(middle, F.struct(lead.alias("d"), lead.alias("m")), step)["m"]
    n = F.greatest(F.least(lead, trail, least), F.lit(0))
    return F.trim(F.substring(c, n + 1, F.length(c) - 2 * n))


def bare_check(c: str) -> Column:
    """A check's expression: without the keyword, outer parentheses, and with ``col IN (...)`` for a comparison with any of an array."""
    text = unwrapped(F.regexp_replace(F.trim(F.col(c)), r"(?i)^check\s*", ""))
    listed = F.regexp_extract(text, r'(?i)^\(?\s*([a-z0-9_"]+)\s*\)?\s*(?:::[a-z0-9_ ]+)?\s*=\s*any\s*\(', 1)
    values = F.regexp_extract_all(text, F.lit(r"('(?:[^']|'')*')"), 1)
    return F.when((listed != "") & (F.size(values) > 0), F.concat(F.replace(listed, F.lit('"'), F.lit("")), F.lit(" IN ("), F.array_join(values, ","), F.lit(")"))).otherwise(text)


def check_facts(checks: DataFrame, columns: DataFrame) -> DataFrame:
    """A fact for each check, with the columns it names (in order): words of the expression meet column names, by join."""
    by = ["table_schema", "table_name"]
    # A view of checks has one row for each, but not all databases name them.
    own = checks.where(F.coalesce("definition", F.lit("")) != "").select(*by, "constraint_name", bare_check("definition").alias("expression")).distinct()
    plain = F.regexp_replace("expression", r"'(?:[^']|'')*'", " ")
    words = own.select(*by, "constraint_name", "expression", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([\p{L}_][\p{L}\p{N}_$]*)"), 1))).alias("word"))
    met = words.join(columns.select(*by, F.col("column_name").alias("word"), "ordinal_position"), [*by, "word"])
    listed = met.groupBy(*by, "constraint_name", "expression").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "word"))).alias("p"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*by, "constraint_name", "expression")]
    out = own.alias("o").join(listed.alias("l"), reduce(Column.__and__, same), "left").select("o.*", F.coalesce(F.transform("p", lambda x: x["word"]), F.array().cast("array<string>")).alias("cols"))
    return fact(out, kind=F.lit("check"), schema="table_schema", table="table_name", name="constraint_name", expression="expression", columns="cols")


def column_facts(columns: DataFrame) -> DataFrame:
    """``columns``: table_schema, table_name, column_name, sql_type, nullable, column_default, ordinal_position, comment."""
    ok = columns.where((F.coalesce("table_name", F.lit("")) != "") & (F.coalesce("column_name", F.lit("")) != ""))
    return fact(ok, kind=F.lit("column"), schema="table_schema", table="table_name", ord="ordinal_position", name="column_name", sql_type=F.coalesce(blank("sql_type"), F.lit("unknown")), nullable=F.coalesce("nullable", F.lit(True)), default=blank("column_default"), comment=blank("comment"), enum_values=enumerated("sql_type"))


def trigger_parts(definition: str) -> tuple[Column, Column]:
    """Timing and events of a trigger's text."""
    timing = F.upper(F.regexp_replace(F.regexp_extract(F.col(definition), r"(?i)\b(before|after|instead\s+of)\b", 1), r"\s+", " "))
    middle = F.regexp_extract(F.col(definition), r"(?is)\b(?:before|after|instead\s+of)\b(.*?)(?:\son\s|$)", 1)
    events = F.filter(F.array(*[F.when(middle.rlike(rf"(?i)\b{e}\b"), e) for e in ("INSERT", "UPDATE", "DELETE")]), lambda x: x.isNotNull())
    return F.when(timing == "", "AFTER").otherwise(timing), events


def scan(spark, read, dialect: str = "standard", schemas: list[str] | None = None, file: str = "catalog") -> Catalog:
    """Facts of a live catalog. ``read`` gives a DataFrame for a ``View``; ``schemas``: only these, else all but the catalog's own."""
    got, missing = views(spark, read, dialect)
    inside = lambda df, c="table_schema": df.where(F.col(c).isin(schemas)) if schemas else df.where(~F.lower(c).isin("information_schema", "pg_catalog") & ~F.lower(c).like("pg\\_%"))
    if dialect == "postgres":
        relations = inside(got["relations"]).withColumn("view", F.col("kind") == "v")
        numbers = lambda c: F.transform(F.split(F.nullif(c, F.lit("")), ","), lambda x: x.cast("int"))
        constraints = got["constraints"].withColumns({"conkey": numbers("conkey"), "confkey": numbers("confkey")})
        keys = keys_by_position(constraints, got["attributes"], relations.select("relid", "table_schema", "table_name"))
        columns = got["attributes"].join(got["defaults"], ["relid", "num"], "left").join(relations.select("relid", "table_schema", "table_name", "view"), "relid")
        columns = columns.withColumns({"nullable": ~F.col("not_null"), "ordinal_position": F.col("num")})
        checks = got["constraints"].where("kind = 'c'").join(relations.where("NOT view").select("relid", "table_schema", "table_name"), "relid")
        tables, seen = relations.where("NOT view"), relations.where("view")
        # Functions of triggers are plumbing.
        routines = inside(got["routines"], "schema").where(~F.coalesce(F.lower("returns"), F.lit("")).isin("trigger", "event_trigger"))
        parameters = argument_rows(routines)
        timing, events = trigger_parts("definition")
        triggers = got["triggers"].join(relations.select("relid", F.col("table_schema").alias("schema"), F.col("table_name").alias("table")), "relid").select("schema", "table", "name", timing.alias("timing"), F.explode(events).alias("event"))
        routines = routines.select("schema", "name", "kind", "returns", "comment")
    else:
        seen = inside(got["views"]).withColumn("comment", F.lit(None).cast("string"))
        mark = seen.select("table_schema", "table_name", F.lit(True).alias("view")).distinct()
        columns = inside(got["columns"]).join(mark, ["table_schema", "table_name"], "left").withColumns({"view": F.coalesce("view", F.lit(False)), "nullable": F.upper(F.trim(F.coalesce("is_nullable", F.lit("YES")))) != "NO"})
        # Tables that only have columns are tables, too.
        known = columns.where("NOT view").select("table_schema", "table_name").distinct()
        tables = known.join(inside(got["tables"]).dropDuplicates(["table_schema", "table_name"]), ["table_schema", "table_name"], "left")
        keys = inside(keys_by_usage(got["key_usage"], got["constraints"], got["rules"]))
        checks = inside(got["checks"].join(got["constraints"].where("kind = 'CHECK'").drop("kind"), ["constraint_schema", "constraint_name"]))
        routines = inside(got["routines"], "rschema").select(F.col("rschema").alias("schema"), "name", F.lower("kind").alias("kind"), F.col("rtype").alias("returns"), "comment")
        parameters = got["parameters"].select("specific_name", "ord", "name", F.coalesce("pmode", F.lit("IN")).alias("mode"), "sql_type")
        triggers = inside(got["triggers"], "tschema").select(F.col("tschema").alias("schema"), F.col("ttable").alias("table"), "name", F.upper("timing").alias("timing"), F.upper("event").alias("event"))
    facts = [
        fact(tables, kind=F.lit("table"), schema="table_schema", table="table_name", comment=blank("comment")),
        fact(seen, kind=F.lit("view"), schema="table_schema", table="table_name", expression=blank("definition"), comment=blank("comment")),
        column_facts(columns),
        key_facts(keys),
        check_facts(checks, columns.where("NOT view")),
    ]
    return Catalog(reduce(DataFrame.unionByName, facts).withColumn("file", F.lit(file)), routines, parameters, triggers, missing)


def argument_rows(routines: DataFrame) -> DataFrame:
    """Parameters of routines from their list of arguments ("IN a bigint, OUT b numeric(12,2) DEFAULT 0"); a type without a name is none."""
    # A comma within one pair of parentheses is part of a type.
    parts = F.split(F.col("args"), r",(?![^()]*\))")
    rows = routines.where(F.coalesce(F.trim("args"), F.lit("")) != "").select(F.col("name").alias("specific_name"), F.posexplode(parts).alias("at", "part"))
    mode = F.upper(F.regexp_extract(F.trim("part"), r"(?i)^(IN|OUT|INOUT|VARIADIC)\s", 1))
    rest = F.regexp_replace(F.trim("part"), r"(?i)^(IN|OUT|INOUT|VARIADIC)\s+", "")
    kind = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(rest, r"(?s)^\S+ (.*)$", 1), r"(?is)\s+default\s.*$", "")), F.lit(""))
    own = rows.where(F.instr(rest, " ") > 0)
    return own.select("specific_name", (F.col("at") + 1).alias("ord"), F.regexp_extract(rest, r"^(\S+) ", 1).alias("name"), F.when(mode.isin("OUT", "INOUT"), mode).otherwise("IN").alias("mode"), F.coalesce(kind, F.lit("unknown")).alias("sql_type"))
