"""Stages of a run: what each takes and gives, coercions of replies, summaries, and the run itself as a table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import camel, col, json_slice, search_form, slugify, strip, upper_snake
from provenir.operators import integrity
from provenir.operators.matching import numbered
from provenir.operators.model import KINDS, has_cjk, relation
from provenir.operators.project import PUBLISHED, layer_of
from provenir.sources.store import Files, name_of
from provenir.sources.tables import keep

#: Stages in order, the kind that each makes, and the prefixes of what it owns.
STAGES = ["objects", "rules", "actions", "events", "processes"]
PREFIXES = {"objects": ["objectType:", "rel:"], "rules": ["rule:"], "actions": ["action:"], "events": ["event:"], "processes": ["process:"]}
VERDICTS = ["covered", "partial", "uncovered", "uncoverable"]
#: Fast siblings of model families, in order of trial.
FAST_SIBLINGS = [
    ("gemini-2.5-pro", "google/gemini-2.5-flash"),
    ("gemini-3-pro", "google/gemini-3-flash"),
    ("gpt-5", "openai/gpt-5-mini"),
    ("gpt-4.1", "openai/gpt-4.1-mini"),
    ("claude-opus", "anthropic/claude-sonnet-4.5"),
    ("claude-sonnet", "anthropic/claude-haiku-4.5"),
    ("deepseek-r1", "deepseek/deepseek-chat"),
    ("qwen3-max", "qwen/qwen3-32b"),
]


def text_or_null(c) -> Column:
    """A text without its ends, null if nothing is left."""
    return F.nullif(strip(F.coalesce(col(c), F.lit(""))), F.lit(""))


# What a stage takes --------------------------------------------------------------------------------

def drop_ungrounded(nodes: DataFrame) -> DataFrame:
    """Without extracted nodes that carry no citation; unverified citations count, other provenances stay."""
    bare = F.coalesce(F.size("sources") <= 0, F.lit(True))
    return nodes.where(~(F.col("provenance").eqNullSafe("extracted") & bare))


def stage_issues(issues: DataFrame, stage: str) -> DataFrame:
    """Issues whose owner's id has a prefix of the stage."""
    owned = [F.col("from_id").startswith(p) for p in PREFIXES[stage]]
    return issues.where(owned[0] | owned[-1])


def findings_of_stage(findings: DataFrame, stage: str) -> DataFrame:
    """Findings that expect the stage's kind; those that expect nothing go to objects and rules."""
    some = F.size(F.coalesce("expected_kinds", F.array().cast("array<string>"))) > 0
    return findings.where(F.when(some, F.array_contains("expected_kinds", KINDS[STAGES.index(stage)])).otherwise(F.lit(stage in ("objects", "rules"))))


def gaps_of_layer(gaps: DataFrame, layer: str) -> DataFrame:
    """W9."""
    return gaps.where(F.col("layer").isin(layer, "general"))


def stage_ready(counts: DataFrame, stage: str) -> DataFrame:
    """Of each run (``run_id``, ``from_schema`` and a number for each layer) whether ``stage`` may go, and else the first earlier stage that is missing.

    Objects are needed by all that follow; actions by events and processes, unless the run is one of a schema.
    """
    objects, actions = F.col("objects") > 0, F.when(F.col("from_schema"), F.col("objects") > 0).otherwise(F.col("actions") > 0)
    ready = {"objects": objects, "rules": objects, "actions": actions, "events": actions}
    lost = F.coalesce(*[F.when(~ready[s], s) for s in STAGES[: STAGES.index(stage)]], F.lit(None).cast("string"))
    return counts.select("run_id", lost.alias("missing_stage"), lost.isNull().alias("ready"))


def dangling_of(issues: DataFrame) -> DataFrame:
    """V18."""
    own = issues.where((F.col("kind") == "dangling_reference") & (F.col("field") != "") & (F.col("missing_id") != ""))
    return own.select("from_id", "field", "missing_id")


# Coercions of replies --------------------------------------------------------------------------------

def coerce_bindings(rules: DataFrame, objects: DataFrame) -> DataFrame:
    """Expressions with a predicate, with those bindings (``var``, ``object_id``) that have a name and a known object, in order."""
    rules = rules.where(text_or_null("predicate").isNotNull())
    each = rules.select("rule_id", F.posexplode("bindings").alias("k", "b")).select("rule_id", "k", "b.*").where((F.coalesce("var", F.lit("")) != "") & F.col("object_id").isNotNull())
    known = each.join(objects.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi")
    kept = known.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct("var", "object_id").alias("b")))), lambda x: x["b"]).alias("_b"))
    empty = F.array().cast("array<struct<var:string,object_id:string>>")
    return rules.drop("bindings").join(kept, "rule_id", "left").withColumn("bindings", F.coalesce("_b", empty)).drop("_b")


def group_titles(groups: DataFrame, members: DataFrame) -> DataFrame:
    """English title (the seed, else the first member's title) and Chinese one (the first member's that has any, else the first one's statement, else the English)."""
    first = F.min_by(F.struct("title", "statement_zh"), "ord")
    own = members.groupBy("group_id").agg(first.alias("f"), F.min_by("title_zh", F.when(text_or_null("title_zh").isNotNull(), F.col("ord"))).alias("zh"))
    en = F.coalesce(text_or_null("seed"), F.nullif("f.title", F.lit("")), F.lit("Rule Group"))
    return groups.join(own, "group_id", "left").select("group_id", en.alias("en"), F.coalesce("zh", F.nullif("f.statement_zh", F.lit("")), en).alias("zh"))


def object_seed(c) -> Column:
    """A group's title seed from the first object that its rule applies to."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(col(c), "^objectType:", ""), "[.-]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) != "", F.concat(title_case(bare), F.lit(" Rules"))).otherwise("")


def title_case(c) -> Column:
    """Each word with a capital; the rest of it stays."""
    words = F.split(col(c), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.greatest(F.length(w) - 1, F.lit(0))))), " ")


def coerce_properties(rows: DataFrame) -> DataFrame:
    """Named properties; a foreign key by ``references`` or its old name, or by a flag."""
    ref = F.coalesce(F.nullif("references", F.lit("")), F.nullif("ref_object_id", F.lit("")))
    flag = ref.isNotNull() | F.coalesce(F.col("is_foreign_key"), F.lit(False)) | F.coalesce(F.col("key_role") == "fk", F.lit(False))
    return rows.where(text_or_null("name").isNotNull()).select(*[c for c in rows.columns if c not in ("name", "references", "ref_object_id", "is_foreign_key", "key_role")], strip("name").alias("name"), flag.alias("is_foreign_key"), ref.alias("references"))


def coerce_citations(rows: DataFrame, document: str = "document_name") -> DataFrame:
    """Citations with a snippet; without a document's name they take the run's."""
    return rows.where(F.coalesce("snippet", F.lit("")) != "").withColumn(document, F.coalesce(F.nullif(document, F.lit("")), "default_name")).drop("default_name")


def coerce_verdicts(replies: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """X11: the last usable verdict of each asked sentence: known number, known status, at most ``most`` ids as receipts, known kinds once."""
    ok = replies.where(F.col("status").isin(VERDICTS)).join(known.select("idx").distinct(), "idx", "left_semi")
    last = ok.groupBy("idx").agg(F.max_by(F.struct("status", "covered_by", "expected_kinds", "missing"), "ord").alias("v")).select("idx", "v.*")
    full = lambda a: F.when(F.size(a) > 0, a)
    ids = full(F.slice(F.filter("covered_by", lambda x: x != ""), 1, most))
    kinds = full(F.array_distinct(F.filter("expected_kinds", lambda x: x.isin(KINDS))))
    return last.select("idx", "status", ids.alias("covered_by"), kinds.alias("expected_kinds"), text_or_null("missing").alias("missing"))


#: Kinds of terms; anything else is ``other``.
TERM_KINDS = ["entity", "attribute", "metric", "role", "status", "document", "system", "abbreviation", "event", "process", "other"]
TERMS = "terms array<struct<term:struct<en:string,zh:string>,definition:struct<en:string,zh:string>,kind:string,dataTypeHint:string,enumValuesHint:array<string>,aliases:array<string>,snippet:string>>"


def coerce_terms(replies: DataFrame, reply: str) -> DataFrame:
    """The terms of ``{"terms": [...]}`` in replies, a row each with ``ord``: both names are needed; unknown kinds are ``other``, unknown types none; lists hold each text once, and empty ones are none. Numbers count as their text.

    A reply that is cut or no such object gives no terms.
    """
    said = replies.select(*[c for c in replies.columns if c != reply], F.posexplode(F.from_json(json_slice(reply), TERMS)["terms"]).alias("ord", "t")).where("t IS NOT NULL")
    one = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    full = lambda c: F.when(F.size(F.array_remove(F.transform(c, lambda x: F.trim(x)), "")) > 0, F.array_distinct(F.array_compact(F.array_remove(F.transform(c, lambda x: F.trim(x)), ""))))
    kind = F.when(one("t.kind").isin(TERM_KINDS), one("t.kind")).otherwise("other")
    hint = F.when(one("t.dataTypeHint").isin(list(PUBLISHED)), one("t.dataTypeHint"))
    rows = said.select(
        *[c for c in replies.columns if c != reply], "ord", one("t.term.en").alias("term_en"), one("t.term.zh").alias("term_zh"), one("t.definition.en").alias("definition_en"), one("t.definition.zh").alias("definition_zh"),
        kind.alias("kind"), hint.alias("data_type"), full(F.col("t.enumValuesHint")).alias("enum_values"), full(F.col("t.aliases")).alias("aliases"), one("t.snippet").alias("snippet"),
    )
    return rows.where("term_en <> '' AND term_zh <> ''")


def derive_name(source_name, model_id) -> Column:
    """The first source's name, else the id as a title."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(col(model_id), "^ontology:", ""), "[.-]+", " "))
    return F.coalesce(text_or_null(source_name), F.nullif(title_case(bare), F.lit("")), col(model_id))


def display_name(kind, id_, name, title, statement) -> Column:
    """A node's name by its kind; rules by title or statement, processes by name, both else by id."""
    rule = F.coalesce(F.nullif(col(title), F.lit("")), F.nullif(col(statement), F.lit("")), col(id_))
    return F.when(col(kind) == "rule", rule).when(col(kind) == "process", F.coalesce(F.nullif(col(name), F.lit("")), col(id_))).otherwise(col(name))


def existing_line(id_, name) -> Column:
    """X16."""
    return F.concat(F.lit("- "), col(id_), F.lit(" :: "), F.coalesce(col(name), F.lit("")))


def infer_payload(emits: DataFrame, outputs: DataFrame, types: list[str]) -> DataFrame:
    """Fields of each event from its emitters' outputs, the first of a name: a reference if it names an object, else of its known type."""
    rows = emits.join(outputs, "action_id").where(F.coalesce("name", F.lit("")) != "")
    usable = rows.where(F.col("object_id").isNotNull() | F.col("type").isin(types))
    kind = F.when(F.col("object_id").isNotNull(), "reference").otherwise(F.col("type"))
    field = F.struct(kind.alias("type"), "object_id", F.coalesce("required", F.lit(False)).alias("required"))
    order = F.struct("emit_ord", "out_ord")
    return usable.groupBy("event_id", "name").agg(F.min_by(field, order).alias("f"), F.min(order).alias("ord")).select("event_id", "name", "f.*", "ord")


def fast_sibling(model, provider) -> Column:
    """Family, model and whether it lives with another vendor, for the first family in a model's bare name."""
    bare = F.lower(F.element_at(F.split(F.trim(F.regexp_replace(F.coalesce(col(model), F.lit("")), "^openrouter/", "")), "/"), -1))
    p = F.lower(F.coalesce(F.nullif(col(provider), F.lit("")), F.lit("openrouter")))
    out = F.lit(None).cast("struct<family:string,model:string,wrong_vendor:boolean>")
    for family, sibling in reversed(FAST_SIBLINGS):
        vendor, _, own = sibling.partition("/")
        routed = p.isin("openrouter", "google")
        hit = F.struct(F.lit(family).alias("family"), F.when(~routed & (p == vendor), own).otherwise(sibling).alias("model"), (~routed & (p != vendor)).alias("wrong_vendor"))
        out = F.when(F.contains(bare, F.lit(family)), hit).otherwise(out)
    return out


def verb_relationships(objects: DataFrame) -> DataFrame:
    """Edges from objects' verb strings (``id``, ``name``, ``ord``, ``relations`` as strings), one for each known target, with ids of their own."""
    each = objects.select("id", "name", "ord", F.posexplode("relations").alias("r", "s")).select("*", F.posexplode(relation("s")).alias("t", "x"))
    named = objects.groupBy(F.col("name").alias("target_name")).agg(F.max_by("id", "ord").alias("target"))
    edges = each.select(F.col("id").alias("source"), "name", F.col("x.verb").alias("verb"), F.col("x.target").alias("target_name"), F.struct("ord", "r", "t").alias("at")).join(named, "target_name")
    base = F.concat(F.lit("rel:"), slugify("name"), F.lit("-"), slugify("verb"), F.lit("-"), slugify("target_name"))
    flat = edges.select("source", "target", "verb", base.alias("base"), F.format_string("%020d %09d %09d", F.col("at.ord").cast("bigint"), "at.r", "at.t").alias("at"))
    return numbered(flat, F.col("base"), "at", "id", "-").select("id", F.replace(slugify("verb"), F.lit("-"), F.lit("_")).alias("name"), "source", "target", "verb")


def cjk_prose(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Chinese sentences of each object's relationships, each once in order; a default without any."""
    shown = lambda p: F.coalesce(text_or_null(f"{p}_zh"), F.col(f"{p}_name"))
    own = names.select("id", F.coalesce(text_or_null("name_zh"), "name").alias("shown"))
    verb = F.coalesce(text_or_null("name_zh"), text_or_null("description"), F.nullif(F.replace("name", F.lit("_"), F.lit(" ")), F.lit("")), F.lit("关联"))
    e = edges.select("source", "target", "ord", verb.alias("verb")).join(own.withColumnsRenamed({"id": "source", "shown": "s"}), "source").join(own.withColumnsRenamed({"id": "target", "shown": "t"}), "target")
    line = F.concat(F.lit("【"), "s", F.lit("】"), "verb", F.lit("【"), "t", F.lit("】。"))
    both = e.select(F.col("source").alias("id"), "ord", line.alias("line")).unionByName(e.where("source <> target").select(F.col("target").alias("id"), "ord", line.alias("line")))
    once = both.groupBy("id", "line").agg(F.min("ord").alias("ord"))
    text = once.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "").alias("p"))
    return own.join(text, "id", "left").select("id", F.coalesce("p", F.concat(F.lit("【"), "shown", F.lit("】暂无与其他对象的关联关系。"))).alias("prose"))


def legacy_properties(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Old attributes as properties; a reference is kept if its object is there."""
    known = objects.select(F.col("id").alias("ref_object_id")).distinct().withColumn("_known", F.lit(True))
    to = rows.join(known, "ref_object_id", "left")
    fk = F.coalesce(F.col("_known"), F.lit(False)) & (F.coalesce(F.col("key_role") == "fk", F.lit(False)) | (F.col("type") == "reference"))
    return to.select("object_id", "ord", "name", F.coalesce("description", F.lit("")).alias("description"), fk.alias("is_foreign_key"), F.when(fk, F.col("ref_object_id")).alias("references"))


def needs_migration(has_properties, type_, primary_key, prose, description, description_zh) -> Column:
    """Whether an object is of the old shape."""
    zh = text_or_null(description_zh)
    return ~F.coalesce(col(has_properties), F.lit(False)) | col(type_).isNull() | text_or_null(primary_key).isNull() | ~F.coalesce(has_cjk(prose), F.lit(False)) | (zh.isNotNull() & ~col(description).eqNullSafe(zh))


# Published forms --------------------------------------------------------------------------------------

def action_shown(id_: str = "id", name: str = "name") -> Column:
    """The name under which an action is published."""
    return F.coalesce(F.nullif(camel(name), F.lit("")), F.regexp_replace(id_, "^[^:]*:", ""))


def spec_context(objects: DataFrame, actions: DataFrame, events: DataFrame, gates: DataFrame) -> DataFrame:
    """(``kind``, ``id``, ``shown``, ``extra``): names under which ids are published; an object's key, and for rules the kinds of actors whose actions they gate."""
    bare = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    key = F.coalesce(text_or_null("primary_key"), F.concat(F.regexp_replace(bare("id"), "[.-]+", "_"), F.lit("_id")))
    rows = objects.select(F.lit("object").alias("kind"), "id", F.coalesce(F.nullif("name", F.lit("")), bare("id")).alias("shown"), key.alias("extra"))
    rows = rows.unionByName(actions.select(F.lit("action").alias("kind"), "id", action_shown().alias("shown"), F.lit(None).cast("string").alias("extra")))
    rows = rows.unionByName(events.select(F.lit("event").alias("kind"), "id", upper_snake(F.coalesce(F.nullif("name", F.lit("")), "id")).alias("shown"), F.lit(None).cast("string").alias("extra")))
    actors = gates.join(actions.select(F.col("id").alias("action_id"), "actor_kind"), "action_id").groupBy(F.col("rule_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("actor_kind")), ",").alias("extra"))
    return rows.unionByName(actors.select(F.lit("rule").alias("kind"), "id", F.col("id").alias("shown"), "extra"))


def workflow_step(actor_kind, integration, external) -> Column:
    """``manual`` for people, ``tool`` for outside systems, else ``logic`` (unknown actions too)."""
    return F.when(col(actor_kind) == "human", "manual").when((F.coalesce(col(integration), F.lit("")) != "") | F.coalesce(col(external), F.lit(False)), "tool").otherwise("logic")


def trigger_names(triggers: DataFrame) -> DataFrame:
    """Published triggers of each process, each once with its first place; a schedule is ``SCHEDULED_SYNC``."""
    name = F.when((F.col("kind") == "event") & (F.coalesce("event_id", F.lit("")) != ""), upper_snake(F.regexp_replace("event_id", "^event:", ""))).when(F.col("kind") == "schedule", "SCHEDULED_SYNC")
    return triggers.select("process_id", "ord", name.alias("name")).where(F.col("name").isNotNull()).groupBy("process_id", "name").agg(F.min("ord").alias("ord"))


def workflow_triggers(triggers: DataFrame) -> DataFrame:
    """Published triggers of each process in order."""
    return trigger_names(triggers).groupBy("process_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("triggers"))


def bundle_issues(refs: DataFrame, names: DataFrame, scheduled: str = "SCHEDULED_SYNC") -> DataFrame:
    """References of a published bundle that name nothing.

    ``refs``: place (its path in the bundle), kind (what it names: object, event or action),
    trigger (a workflow's, where ``scheduled`` is allowed), name; ``names``: kind, name.
    """
    # Only the object before a dot is meant; an empty optional name refers to nothing.
    asked = refs.withColumn("name", F.when(F.col("kind") == "object", F.split("name", r"\.")[0]).otherwise(F.col("name")))
    asked = asked.where(F.col("name").isNotNull() & ~(F.col("optional") & (F.col("name") == "")) & ~(F.col("trigger") & (F.col("name") == scheduled)))
    lost = asked.join(names.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    return lost.select("place", F.concat("place", F.lit(": unknown "), "kind", F.lit(' "'), "name", F.lit('"')).alias("message"))


def citation(document, section, page, verified, snippet) -> Column:
    """F32: a rule's first citation as text."""
    where = F.array_join(F.array_compact(F.array(F.nullif(col(section), F.lit("")), F.when(col(page) > 0, F.concat(F.lit("p."), col(page).cast("string"))))), ", ")
    loc = F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise("")
    flag = F.when(F.coalesce(col(verified), F.lit(True)), "").otherwise(" [UNVERIFIED QUOTE]")
    said = F.when(F.coalesce(col(snippet), F.lit("")) != "", F.concat(F.lit(' "'), strip(snippet), F.lit('"'))).otherwise("")
    return F.concat(F.coalesce(col(document), F.lit("")), loc, flag, F.lit(":"), said)


def emit_refs(emits: DataFrame, by: str) -> DataFrame:
    """A role's emitted events by event, tool and occasion."""
    return emits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("event_id", "tool", "on")))


# Diagnostics ----------------------------------------------------------------------------------------

def diagnostics(issues: DataFrame) -> DataFrame:
    """Issues with their layer's tab, and the missing id's where that is another one."""
    tab = lambda c: F.when(layer_of(c).isin(STAGES), layer_of(c)).when(layer_of(c) == "rule_groups", "rules").otherwise("objects")
    other = F.when(F.col("missing_id").isNotNull() & (F.col("missing_id") != "") & (tab("missing_id") != tab("from_id")), tab("missing_id"))
    key = F.concat_ws(":", F.lit("semantic"), "from_id", F.coalesce("field", F.lit("")), "kind", F.coalesce("missing_id", F.lit("")))
    return issues.select(key.alias("key"), F.when(F.col("level") == "error", "error").otherwise("warn").alias("severity"), tab("from_id").alias("layer"), other.alias("related_layer"), "from_id", "kind")


def is_syntax(message) -> Column:
    """Whether an editor's message is about syntax rather than shape; the words are fixed values."""
    return col(message).rlike("(?i)expected|unexpected|end of file|trailing comma|comments are not|colon expected|comma expected|value expected|property expected|close brace|close bracket")


def summary(diags: DataFrame, by: str) -> DataFrame:
    """Errors and warnings of each bundle, and whether it can be saved: no semantic error."""
    bad = F.col("severity") == "error"
    return diags.groupBy(by).agg(F.count_if(bad).alias("errors"), F.count_if(~bad).alias("warnings"), (F.count_if(bad & (F.col("source") == "semantic")) == 0).alias("saveable"))


def diagnostic_order(layer) -> list[Column]:
    """Errors first, then by layer."""
    return [F.when(F.col("severity") == "error", 0).otherwise(1), F.array_position(F.array(*map(F.lit, STAGES)), col(layer))]


def fallback_questions(gaps: DataFrame, by: str, most: int = 12) -> DataFrame:
    """The first gaps that are more than information, as questions in both languages."""
    own = gaps.where(F.col("severity") != "info").withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("rank") <= most)
    en = F.concat(F.lit("Can you clarify how to address this gap: "), "en", F.lit("?"))
    zh = F.concat(F.lit("请说明如何补足以下缺口："), F.coalesce(F.nullif("zh", F.lit("")), "en"), F.lit("？"))
    return own.select(by, "rank", en.alias("question_en"), zh.alias("question_zh"))


def ordinal(*keys) -> Column:
    """The first of the values that is a number; without any, after all others."""
    return F.coalesce(*[F.try_to_number(strip(col(k).cast("string")), F.lit("999999999")).cast("bigint") for k in keys], F.lit((1 << 53) - 1))


def node_index(nodes: DataFrame, by: str, most: int = 400) -> DataFrame:
    """L3: the first ``most`` nodes of each graph as index lines, with how many there are."""
    line = F.concat_ws(" | ", "id", "kind", "label")
    first = nodes.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("rank") <= most)
    return first.join(nodes.groupBy(by).agg(F.count("*").alias("total")), by).select(by, "rank", line.alias("line"), "total")


def capped(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """What one prompt takes: the first ``most`` of each."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("rank") <= most)


def assemble(base: DataFrame, edited: DataFrame) -> DataFrame:
    """Rows (``layer``, ...) of the edited layers that are ``ok``, and of the base's where no such edit is; an edited layer may be empty only by its row in ``edited``."""
    good = edited.where("ok").select("layer").distinct()
    return base.join(good, "layer", "left_anti").unionByName(edited.where("ok AND id IS NOT NULL").drop("ok"))


# Coverage -------------------------------------------------------------------------------------------

def citation_intervals(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(``document_id``, ``node_id``, ``char_start``, ``char_end``): given offsets where they are valid, else the snippet's first place in the normalised text.

    Texts meet only the citations without offsets.
    """
    from provenir.operators.grounding import map_back

    given = F.coalesce(F.col("char_end") > F.col("char_start"), F.lit(False))
    sure = refs.where(given & F.col("document_id").isNotNull()).select("document_id", "node_id", "char_start", "char_end")
    q = search_form("snippet")
    open_ = refs.where(~given & F.col("document_id").isNotNull()).select("document_id", "node_id", q.alias("_q")).where("_q <> ''")
    both = open_.join(docs.select("document_id", F.col("text").alias("_t")), "document_id").where(F.contains(search_form("_t"), F.col("_q")))
    found = both.select("document_id", "node_id", "_q", "_t").mapInArrow(map_back, "document_id bigint, node_id bigint, char_start int, char_end int")
    return sure.unionByName(found.where("char_end > char_start"))


def retire(history: DataFrame, current: DataFrame) -> DataFrame:
    """The history with the current pass, whose findings go."""
    return history.unionByName(current.withColumn("findings", F.array().cast(current.schema["findings"].dataType)))


# The run ----------------------------------------------------------------------------------------------

class Run:
    """A staged run over a store's tables: one stage a step, kept after each, so that a new object goes on where the last one stopped.

    ``stages``: name to a function of the layers so far (name to DataFrame) to the stage's
    layer. A stage that raises stops the run with status ``error`` and is tried again by
    the next step; what earlier stages wrote stays.
    """

    SCHEMA = "run_id string, at int, stage string, status string, detail string"

    def __init__(self, spark, folder: str, run_id: str, stages: dict[str, Callable]):
        self.spark, self.folder, self.run_id, self.stages = spark, f"{folder.rstrip('/')}/runs/{run_id}", run_id, stages

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def state(self) -> list[dict]:
        """Steps so far, in order."""
        path = f"{self.folder}/state"
        return [r.asDict() for r in self.spark.read.schema(self.SCHEMA).parquet(path).orderBy("at").collect()] if self._there(path) else []  # a row a step

    def layer(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/layers/{stage}")

    def _note(self, at: int, stage: str, status: str, detail: str) -> str:
        self.spark.createDataFrame([(self.run_id, at, stage, status, detail)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        return status

    def next_stage(self) -> str | None:
        done = {r["stage"] for r in self.state() if r["status"] == "complete"}
        return next((s for s in self.stages if s not in done), None)

    def step(self, stage: str | None = None) -> tuple[str | None, str]:
        """The next stage (or ``stage`` again): its name and status."""
        steps = self.state()
        stage = stage or self.next_stage()
        if stage is None:
            return None, "complete"
        before = list(self.stages)[: list(self.stages).index(stage)]
        done = {r["stage"] for r in steps if r["status"] == "complete"}
        if lost := [s for s in before if s not in done]:
            raise ValueError(f"{stage} needs {lost[0]} to have run first")
        try:
            out = self.stages[stage]({s: self.layer(s) for s in before})
            out.write.mode("overwrite").parquet(f"{self.folder}/layers/{stage}")
        except Exception as e:  # noqa: BLE001  whatever a stage raises stops the run and is noted
            return stage, self._note(len(steps), stage, "error", str(e)[:500])
        return stage, self._note(len(steps), stage, "complete", "")

    def run(self) -> str:
        """Steps until all is complete or one fails."""
        status = "complete"
        while self.next_stage() and status == "complete":
            _, status = self.step()
        return status

    def rerun(self, stage: str, model, paths: list, prefixes: list[str], before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """A stage again: its layer, and its issues from the differences alone.

        ``model`` makes the tables of a model from layers; ``before``: the issues of the model so far (computed, if not given).
        """
        done = {r["stage"] for r in self.state() if r["status"] == "complete"}
        # The layer is written over, so what it was is kept for the comparison.
        old = {s: keep(self.layer(s), f"before_{s}") if s == stage else self.layer(s) for s in self.stages if s in done}
        was = model(old)
        before = integrity.dangling(was, paths) if before is None else before
        before = keep(before, "issues_before")
        _, status = self.step(stage)
        if status != "complete":
            raise RuntimeError(self.state()[-1]["detail"])
        layer = self.layer(stage)
        now = model({**old, stage: layer})
        issues = integrity.revalidate(was, now, paths, before)
        return layer, integrity.issues_of_stage(issues, prefixes)


class StepFailed(Exception):
    """A sub-step that has come to its end without a result: it is noted and the run goes on."""


class Cursor:
    """A run that its clients pace, one sub-step a call, any number of them at once.

    The cursor is a row of files that can each be created once, so a call moves it by one or not at all. A
    sub-step is claimed before it runs; a client that meets a claim is told ``busy`` until the
    claim's ``lease`` is over (its client has crashed), then it may take the sub-step over. A call that raises does not move the
    cursor; a sub-step that raises ``StepFailed`` does. What it wrote counts only once the cursor has moved, so of two that
    ran the same sub-step one counts.
    """

    def __init__(self, spark, folder: str, run_id: str, steps: list[tuple[str, Callable]], lease: float = 600, clock: Callable = time.time):
        self.spark, self.steps, self.lease, self.clock = spark, steps, lease, clock
        self.files = Files(spark, f"{folder.rstrip('/')}/cursors/{name_of(run_id)}")

    def done(self) -> list[dict]:
        """The sub-steps that count, in order."""
        return [json.loads(self.files.read(f"cursor/{n}")) for n in self.files.names("cursor") if n.endswith(".json") and not n.startswith(".")]

    def results(self) -> dict[str, DataFrame]:
        """What the sub-steps so far have written."""
        return {d["step"]: self.spark.read.parquet(f"{self.files.folder}/out/{d['data']}") for d in self.done() if d["data"]}

    def _claim(self, at: int) -> str | None:
        held = [n for n in self.files.names("claims") if n.startswith(f"{at:06d}.") and n.endswith(".json")]
        if held and not self.files.exists(f"claims/{held[-1][:-5]}.free") and json.loads(self.files.read(f"claims/{held[-1]}"))["until"] > self.clock():
            return None
        name = f"claims/{at:06d}.{len(held):06d}"
        return name if self.files.create_once(f"{name}.json", json.dumps({"until": self.clock() + self.lease})) else None

    def advance(self, expected: int | None = None) -> dict:
        """Run the next sub-step: ``cursor`` (sub-steps done), ``status`` (``running``, ``complete``, ``busy``, or ``behind`` where the cursor is not ``expected``; then nothing ran) and the last ``step``."""
        done = self.done()
        at = len(done)
        tell = lambda status, d: {"cursor": len(d), "status": status, "step": d[-1]["step"] if d else None}
        if at >= len(self.steps):
            return tell("complete", done)
        if expected is not None and expected != at:
            return tell("behind", done)
        claim = self._claim(at)
        if claim is None:
            return tell("busy", done)
        # Another client may have moved on between the look and the claim.
        if len(self.done()) != at:
            return tell("behind", self.done())
        name, work = self.steps[at]
        data, note = uuid.uuid4().hex, {"step": name, "status": "complete", "detail": ""}
        try:
            work(self.results()).write.parquet(f"{self.files.folder}/out/{data}")
        except StepFailed as e:
            data, note = None, {"step": name, "status": "failed", "detail": str(e)[:500]}
        except BaseException:
            self.files.create_once(f"{claim}.free", "{}")
            raise
        if not self.files.create_once(f"cursor/{at + 1:06d}.json", json.dumps({**note, "data": data})) and data:
            self.files.delete(f"out/{data}")
        done = self.done()
        return tell("complete" if len(done) >= len(self.steps) else "running", done)
