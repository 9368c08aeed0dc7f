"""Models from schema facts: objects, properties, relationships and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import property_type, slugify


def object_id(schema, table):
    """X22."""
    return F.concat(F.lit("objectType:"), slugify(F.concat_ws("_", schema, table)))


def objects(facts: DataFrame) -> DataFrame:
    """P5: tables and views as objects, with the primary key or a guess."""
    own = facts.where(F.col("kind").isin("table", "view"))
    pk = facts.where("kind = 'primary_key'").select("file", "schema", "table", F.col("columns")[0].alias("_pk"))
    slug = F.regexp_replace(slugify("table"), "[.-]", "_")
    guess = facts.where("kind = 'column' AND name LIKE '%\\\\_id'").groupBy("file", "schema", "table").agg(F.min_by("name", "ord").alias("_first"), F.collect_set("name").alias("_ids"))
    out = own.join(pk, ["file", "schema", "table"], "left").join(guess, ["file", "schema", "table"], "left")
    named = F.concat(slug, F.lit("_id"))
    return out.select("file", "schema", "table", object_id("schema", "table").alias("id"), F.col("table").alias("name"), "kind", F.coalesce("_pk", F.when(F.array_contains("_ids", named), named), "_first", named).alias("primary_key"), "comment")


def properties(facts: DataFrame) -> DataFrame:
    """P5: columns as properties, foreign keys with their target."""
    fk = facts.where("kind = 'foreign_key'").select("file", "schema", "table", F.explode("columns").alias("name"), object_id("ref_schema", "ref_table").alias("references")).dropDuplicates(["file", "schema", "table", "name"])
    c = facts.where("kind = 'column'").join(fk, ["file", "schema", "table", "name"], "left")
    return c.select("file", object_id("schema", "table").alias("object_id"), "ord", "name", property_type("sql_type").alias("type"), "nullable", F.col("references").isNotNull().alias("is_foreign_key"), "references", "enum_values", "comment")


def relationships(facts: DataFrame) -> DataFrame:
    """Foreign keys to known tables; one to one if the columns are the primary key or unique."""
    keys = facts.where(F.col("kind").isin("primary_key", "unique")).groupBy("file", "schema", "table").agg(F.collect_set(F.array_sort("columns")).alias("_keys"))
    fk = facts.where("kind = 'foreign_key'").join(keys, ["file", "schema", "table"], "left")
    known = facts.where("kind = 'table'").select("file", F.col("schema").alias("ref_schema"), F.col("table").alias("ref_table")).distinct()
    one = F.coalesce(F.array_contains("_keys", F.array_sort("columns")), F.lit(False))
    return fk.join(known, ["file", "ref_schema", "ref_table"], "left_semi").select("file", object_id("schema", "table").alias("source"), object_id("ref_schema", "ref_table").alias("target"), F.array_join("columns", ",").alias("via"), F.when(one, "one_to_one").otherwise("many_to_one").alias("cardinality"))


def rules(facts: DataFrame) -> DataFrame:
    """Checks as validations, unique keys of several columns as constraints."""
    check = facts.where("kind = 'check'").select("file", object_id("schema", "table").alias("object_id"), F.lit("validation").alias("rule_kind"), F.col("expression").alias("statement"))
    wide = facts.where("kind = 'unique' AND size(columns) >= 2").select("file", object_id("schema", "table").alias("object_id"), F.lit("constraint").alias("rule_kind"), F.concat(F.lit("unique: "), F.array_join("columns", ", ")).alias("statement"))
    return check.unionByName(wide)


#: Order of a table's lines.
LINES = ("table", "view", "column", "primary_key", "unique", "foreign_key", "check")


def line_of():
    """The line of evidence of a fact."""
    where = F.concat_ws(".", "schema", "table")
    return (
        F.when(F.col("kind") == "table", F.concat(F.lit("TABLE "), where))
        .when(F.col("kind") == "column", F.concat(F.lit("  "), F.concat_ws(" ", "name", "sql_type", F.when(~F.col("nullable"), "NOT NULL"))))
        .when(F.col("kind") == "primary_key", F.concat(F.lit("  PRIMARY KEY "), F.array_join("columns", ", ")))
        .when(F.col("kind") == "foreign_key", F.concat(F.lit("  FOREIGN KEY "), F.array_join("columns", ", "), F.lit(" -> "), F.concat_ws(".", "ref_schema", "ref_table")))
        .when(F.col("kind") == "unique", F.concat(F.lit("  UNIQUE "), F.array_join("columns", ", ")))
        .when(F.col("kind") == "check", F.concat(F.lit("  CHECK "), F.col("expression")))
        .when(F.col("kind") == "view", F.concat(F.lit("VIEW "), where))
    )


def line_rank():
    return F.array_position(F.array(*map(F.lit, LINES)), F.col("kind"))


def textualize(facts: DataFrame) -> DataFrame:
    """One line of evidence per fact; lines serve as quotations."""
    rows = facts.withColumn("line", line_of()).where("line IS NOT NULL")
    item = F.struct("schema", "table", line_rank().alias("r"), F.coalesce("ord", F.lit(0)).alias("o"), "line")
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))


def evidence_index(facts: DataFrame) -> DataFrame:
    """The lines of that text with their places: ``file``, ``node_id``, ``node_kind``, ``line`` (from 1), ``char_start``, ``char_end``, ``text``.

    Places are prefix sums in two steps, within a table and over tables, so no window holds more than a
    table's lines or one row for each table of a file. Equal facts are equal lines, each with its own place.
    """
    rows = facts.select("*", line_of().alias("text"), line_rank().alias("_r"), F.coalesce("ord", F.lit(0)).alias("_o")).where("text IS NOT NULL")
    own = Window.partitionBy("file", "schema", "table").orderBy("_r", "_o", "text")
    size = F.length("text") + 1
    inner = rows.select("*", F.row_number().over(own).alias("_n"), (F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("_at"))
    tables = rows.groupBy("file", "schema", "table").agg(F.count("*").alias("_lines"), F.sum(size).alias("_size"))
    before = Window.partitionBy("file").orderBy("schema", "table").rowsBetween(Window.unboundedPreceding, -1)
    # A table's id is made once, and not for each of its lines.
    starts = tables.select("file", "schema", "table", object_id("schema", "table").alias("_id"), F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_l"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_s"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("file", "schema", "table")]
    placed = inner.alias("i").join(starts.alias("t"), same[0] & same[1] & same[2]).select("i.*", "_id", "_l", "_s")
    start = F.col("_s") + F.col("_at")
    kind = F.when(F.col("kind").isin("table", "view"), "object").when(F.col("kind") == "column", "property").when(F.col("kind") == "foreign_key", "relationship").when(F.col("kind").isin("check", "unique"), "rule").otherwise("key")
    part = F.when(F.col("kind").isin("table", "view"), "").otherwise(F.concat(F.lit("."), F.when(F.col("kind") == "column", F.col("name")).otherwise(F.concat_ws(":", "kind", F.coalesce(F.array_join("columns", ","), F.lit("")), F.coalesce("expression", F.concat_ws(".", "ref_schema", "ref_table"))))))
    node = F.concat("_id", part)
    return placed.select("file", node.alias("node_id"), kind.alias("node_kind"), (F.col("_l") + F.col("_n")).alias("line"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), "text")


def citations(index: DataFrame) -> DataFrame:
    """What each seeded node cites: its own line without the indent."""
    indent = F.length("text") - F.length(F.ltrim("text"))
    return index.where("node_kind <> 'key'").select("file", "node_id", "node_kind", "line", (F.col("char_start") + indent).alias("char_start"), "char_end", F.ltrim("text").alias("snippet"))


def survival(cites: DataFrame, index: DataFrame) -> DataFrame:
    """``cites`` with ``verified``: whether the slice at its place is the snippet. A place is looked up by its line, so nothing is searched; outside its line or file nothing is verified."""
    lines = index.select("file", "line", F.col("char_start").alias("_s"), F.col("text").alias("_t"))
    at = cites.join(lines, ["file", "line"], "left")
    slice_ = F.substring(F.col("_t"), (F.col("char_start") - F.col("_s") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    inside = (F.col("char_start") >= F.col("_s")) & (F.col("char_end") <= F.col("_s") + F.length("_t")) & (F.col("char_end") > F.col("char_start"))
    return at.select(*cites.columns, F.coalesce(inside & (slice_ == F.col("snippet")), F.lit(False)).alias("verified"))
