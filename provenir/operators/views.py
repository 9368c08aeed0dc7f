"""A model as the view that screens show, and back.

A view has ``objects`` (``ord``, ``name``, ``zh``, ``confidence``, ``attrs`` of name, type and role, ``relations`` as
"verb → Target, Target"), ``rules`` (``id``, ``en``, ``zh``, ``formal``, ``confidence``, ``document``, ``excerpt``, ``page``, names of
``objects``) and ``processes`` (``id``, ``name``, ``zh``, ``actors``, names of ``objects``, ``steps`` of en, zh and obj). A model has flat tables whose
rows refer to each other by id. Lists of one item stand in its row in the view only.

Steps become actions, each of which emits one event that triggers the next step's action. Ids are slugs of names, so
objects of one slug are one object: the first in order gives its name. What a view names but does not have is left out:
relations to unknown targets, unknown objects of rules and steps. Types outside the vocabulary become String.
Null lists are empty; repeated rows are repeated as properties, and relations are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import slugify, strip
from provenir.operators.matching import numbered
from provenir.operators.published import ordered

#: Types of a view (lower case) that are no String, as published.
TYPES = {"integer": "Integer", "int": "Integer", "decimal": "Float", "number": "Float", "float": "Float", "money": "Float", "currency": "Float", "boolean": "Boolean", "bool": "Boolean", "date": "Date", "datetime": "Timestamp", "timestamp": "Timestamp", "array": "List<String>", "list<string>": "List<String>"}
TEXTS = ["uuid", "string", "text", "json"]
#: Confidence from which a rule blocks, and from which it warns.
BLOCKS, WARNS = 0.95, 0.88


def object_id(name) -> Column:
    return F.concat(F.lit("objectType:"), slugify(name))


def pascal(c: Column) -> Column:
    """Words of letters and digits, each with an upper-case initial, put together; other letters stay as they are."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.greatest(F.length(w) - 1, F.lit(0))))), "")


#: Places that rows without a key are dealt to.
PLACES = 4096


def looked_up(rows: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """``out`` of the table's row of the same ``key`` (one at most). Rows without a key meet nothing and are dealt by their own values, so that they are made once, in one pass with the others, and do not come in one task."""
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(PLACES)).cast("string")
    known = table.select(F.col(key).alias("_known"), out)
    dealt = rows.withColumn("_asked", F.coalesce(F.col(key), place))
    return dealt.join(known, (F.col("_asked") == F.col("_known")) & F.col(key).isNotNull(), "left").select(*rows.columns, out)


def known_names(objects: DataFrame) -> DataFrame:
    """``_name``, ``_id``: each name of an object once."""
    return objects.where("name IS NOT NULL").select(F.col("name").alias("_name")).distinct().withColumn("_id", object_id("_name"))


def properties(objects: DataFrame) -> DataFrame:
    """``object_id``, ``ord``, ``name``, ``type``, ``description``, ``references``: attributes with published types and what they refer to.

    A reference is "Reference<Name>", or a type that is an object's name, or, for a foreign key of another type, the object that the
    attribute is called after (``customer_id``); a foreign key called after no object refers to none.
    """
    names = known_names(objects)
    rows = objects.select(object_id("name").alias("object_id"), F.col("ord").alias("_o"), F.posexplode("attrs").alias("_p", "a"))
    raw = strip(F.coalesce(F.col("a.type"), F.lit("")))
    inner = lambda word: F.nullif(F.regexp_extract(raw, rf"(?i)^{word}\s*<\s*(.+?)\s*>$", 1), F.lit(""))
    rows = rows.withColumn("_enum", inner("enum")).withColumn("_ref", inner("reference")).withColumn("_raw", F.lower(raw))
    plain = F.col("_enum").isNull() & F.col("_ref").isNull() & ~F.col("_raw").isin(*TYPES, *TEXTS)
    rows = looked_up(rows.withColumn("_name", F.when(plain, F.nullif(raw, F.lit("")))), "_name", names, "_id").drop("_name")
    called = F.lower(F.translate(F.regexp_replace("a.name", "(?i)_id$", ""), "_", ""))
    rows = rows.withColumn("_base", F.when(F.col("_ref").isNull() & F.col("_id").isNull() & (F.col("a.role") == "fk"), called))
    first = objects.groupBy(F.lower("name").alias("_base")).agg(object_id(F.min_by("name", F.struct("ord", "name"))).alias("_called")).where("_base IS NOT NULL")
    rows = looked_up(rows, "_base", first, "_called")
    mapped = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("_raw")]
    choices = F.filter(F.transform(F.split("_enum", r"\|"), strip), lambda v: v != "")
    said = F.when(F.size(choices) > 0, F.concat(F.lit("One of: "), F.array_join(choices, ", "), F.lit("."))).otherwise(F.concat("a.name", F.lit(".")))
    return rows.select(
        "object_id", F.struct("_o", "_p").alias("ord"), F.col("a.name").alias("name"), F.when(F.col("_enum").isNotNull(), "List<String>").otherwise(F.coalesce(mapped, F.lit("String"))).alias("type"),
        said.alias("description"), F.coalesce(F.when(F.col("_ref").isNotNull(), object_id("_ref")), "_id", "_called").alias("references"),
    )


def relationships(objects: DataFrame) -> DataFrame:
    """``id``, ``ord``, ``source``, ``target``, ``name``, ``label``: one row for each known target of a relation; remarks in parentheses are no part of its name."""
    said = objects.select("name", F.col("ord").alias("_o"), F.posexplode("relations").alias("_p", "said"))
    sides = F.when(F.contains("said", F.lit("→")), F.split("said", "→", 2)).otherwise(F.split("said", "->", 2))
    targets = F.transform(F.split(F.get(sides, F.lit(1)), ","), lambda t: strip(F.regexp_replace(t, r"\(.*?\)", "")))
    each = said.select("name", "_o", "_p", strip(F.get(sides, F.lit(0))).alias("verb"), F.posexplode(targets).alias("_t", "_name")).where("verb <> '' AND _name <> ''")
    found = each.join(known_names(objects), "_name").withColumn("_order", F.format_string("%020d.%010d.%010d", F.col("_o").cast("long"), "_p", "_t"))
    base = F.concat_ws("-", F.concat(F.lit("rel:"), slugify("name")), slugify("verb"), slugify("_name"))
    return numbered(found, base, "_order", "id", "-").select(
        "id", F.struct("_o", "_p", "_t").alias("ord"), object_id("name").alias("source"), F.col("_id").alias("target"),
        F.translate(slugify("verb"), "-", "_").alias("name"), F.concat_ws(" → ", "verb", "_name").alias("label"),
    )


def rule_kind(formal: Column) -> Column:
    f = F.lower(F.coalesce(formal, F.lit("")))
    has = lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(f, m))
    kinds = [("state_transition", has(":=")), ("authorization", has("block", "∃")), ("temporal", has("≤", "30d", "60d", "today")), ("derivation", has("=") & has("σ"))]
    return F.coalesce(*[F.when(test, kind) for kind, test in kinds], F.lit("validation"))


def mentioned(rows: DataFrame, own: Column, out: str, names: DataFrame) -> DataFrame:
    """``out`` (an id), ``ord``, ``object_id``: known objects of a list of names."""
    each = rows.select(own.alias(out), F.posexplode("objects").alias("ord", "_name"))
    return each.join(names, "_name").select(out, "ord", F.col("_id").alias("object_id"))


def from_view(view: dict[str, DataFrame], keep=None) -> dict[str, DataFrame]:
    """The model's tables: object, property, relationship, rule, rule_object, process, process_object, actor, step, action, trigger, emit, event.

    ``keep`` (a function of DataFrame and name) writes the steps, of which five of these are made; without it each makes them anew.
    """
    o, r, p = view["objects"], view["rules"], view["processes"]
    names = known_names(o)
    key = F.get(F.filter("attrs", lambda a: a["role"] == "pk"), F.lit(0))["name"]
    slug = F.translate(slugify("name"), "-", "_")
    first = F.min_by(F.struct("name", "zh", "confidence", F.coalesce(key, F.concat(slug, F.lit("_id"))).alias("primary_key"), "ord"), F.struct("ord", "name"))
    objects = o.groupBy(object_id("name").alias("id")).agg(first.alias("f")).select("id", "f.*")
    own_rule = F.concat(F.lit("rule:"), slugify(F.col("id").cast("string")), F.lit("-"), slugify(F.left(F.coalesce("en", F.lit("")), F.lit(24))))
    severity = F.when(F.col("confidence") >= BLOCKS, "block").when(F.col("confidence") >= WARNS, "warn").otherwise("info")
    rules = r.select(own_rule.alias("id"), F.left("en", F.lit(48)).alias("title"), "en", "zh", "formal", rule_kind(F.col("formal")).alias("kind"), severity.alias("severity"), "confidence", "document", "excerpt", "page")
    pid = slugify(F.col("id").cast("string"))
    own = F.concat_ws("-", F.concat(F.lit("process:"), pid), slugify("name"))
    steps = p.select(own.alias("process_id"), pid.alias("_pid"), F.col("steps").alias("_all"), F.posexplode("steps").alias("_i", "s"))
    action = lambda i, s: F.concat_ws("-", F.concat(F.lit("action:"), "_pid"), i.cast("string"), slugify(F.left(F.coalesce(s["en"], F.lit("")), F.lit(24))))
    event = lambda i, s: F.concat(F.lit("event:"), F.concat_ws(".", "_pid", i.cast("string"), slugify(s["obj"]), F.lit("done")))
    before = F.get("_all", F.col("_i") - 1)
    steps = steps.select("process_id", F.col("_i").alias("ord"), action(F.col("_i"), F.col("s")).alias("action_id"), event(F.col("_i"), F.col("s")).alias("event_id"), F.when(F.col("_i") > 0, event(F.col("_i") - 1, before)).alias("trigger_id"), F.col("s.en").alias("en"), F.col("s.zh").alias("zh"), F.col("s.obj").alias("_name"))
    steps = keep(steps, "steps") if keep else steps
    actions = looked_up(steps, "_name", names, "_id").select(F.col("action_id").alias("id"), "en", "zh", F.col("_id").alias("object_id"), "event_id").distinct()
    events = actions.groupBy(F.col("event_id").alias("id")).agg(F.min_by(F.struct("en", "object_id"), "id").alias("f"))
    return {
        "object": objects, "property": properties(o), "relationship": relationships(o), "rule": rules, "rule_object": mentioned(r, own_rule, "rule_id", names),
        "process": p.select(own.alias("id"), "name", "zh"), "process_object": mentioned(p, own, "process_id", names), "actor": p.select(own.alias("process_id"), F.posexplode("actors").alias("ord", "role")),
        "step": steps.select("process_id", "ord", "action_id"), "action": actions.drop("event_id"), "emit": actions.select(F.col("id").alias("action_id"), "event_id"),
        "trigger": steps.where("trigger_id IS NOT NULL").select("action_id", F.col("trigger_id").alias("event_id")).distinct(),
        "event": events.select("id", F.upper(F.regexp_replace(F.regexp_replace("id", "^event:", ""), "[^A-Za-z0-9]+", "_")).alias("name"), F.col("f.en").alias("after"), F.col("f.object_id").alias("object_id")),
    }


def listed(rows: DataFrame, by: str, value: Column, out: str) -> DataFrame:
    return rows.groupBy(F.col(by).alias("_by")).agg(ordered(value).alias(out))


def to_view(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The view of a model's tables (as ``from_view`` makes them). Ids lose the prefix of their kind."""
    names = model["object"].select(F.col("id").alias("object_id"), F.col("name").alias("_object"))
    bare = lambda c: F.regexp_replace(c, "^[^:]*:", "")

    def put(rows: DataFrame, id_: str, *parts: DataFrame) -> DataFrame:
        for part in parts:
            rows = rows.join(part, F.col(id_) == F.col("_by"), "left").drop("_by")
        return rows

    def named(rows: DataFrame, by: str) -> DataFrame:
        return listed(rows.join(names, "object_id"), by, F.col("_object"), "objects")

    keys = model["object"].select(F.col("id").alias("object_id"), "primary_key")
    props = model["property"].join(keys, "object_id")
    role = F.when(F.col("name") == F.col("primary_key"), "pk").when(F.col("references").isNotNull(), "fk")
    shown = F.when(F.col("references").isNotNull(), F.concat(F.lit("Reference<"), pascal(bare(F.col("references"))), F.lit(">"))).otherwise(F.col("type"))
    attrs = listed(props, "object_id", F.struct("name", shown.alias("type"), role.alias("role")), "attrs")
    relations = listed(model["relationship"], "source", F.col("label"), "relations")
    objects = put(model["object"], "id", attrs, relations)
    rules = put(model["rule"], "id", named(model["rule_object"], "rule_id"))
    acts = model["action"].join(names, "object_id", "left").select(F.col("id").alias("action_id"), "en", "zh", "_object")
    first = model["process_object"].groupBy("process_id").agg(F.min_by("object_id", "ord").alias("object_id")).join(names, "object_id").select("process_id", F.col("_object").alias("_first"))
    steps = model["step"].join(acts, "action_id", "left").join(first, "process_id", "left")
    step = F.struct(F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh"), F.coalesce("_object", "_first", F.lit("")).alias("obj"))
    processes = put(model["process"], "id", listed(model["actor"], "process_id", F.col("role"), "actors"), named(model["process_object"], "process_id"), listed(steps, "process_id", step, "steps"))
    list_of = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return {
        "objects": objects.select(bare(F.col("id")).alias("id"), "ord", "name", "zh", "confidence", list_of("attrs", "array<struct<name:string,type:string,role:string>>"), list_of("relations", "array<string>")),
        "rules": rules.select(bare(F.col("id")).alias("id"), "en", "zh", "formal", "confidence", "document", "excerpt", "page", list_of("objects", "array<string>")),
        "processes": processes.select(bare(F.col("id")).alias("id"), "name", "zh", list_of("actors", "array<string>"), list_of("objects", "array<string>"), list_of("steps", "array<struct<en:string,zh:string,obj:string>>")),
    }
