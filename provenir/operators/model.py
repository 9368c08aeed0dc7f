"""Operators on model tables: statistics, derivations, reviews, layers and layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import col, strip

#: Words that make an object a system one; short ones only as whole words.
SYSTEM_WORDS = r"system|platform|gateway|portal|\bapi\b|\berp\b|\bcrm\b|\brms\b|engine|middleware|database|系统|平台|网关|中台|引擎"
SEVERITIES = ["block", "warn", "info"]


# Scalars --------------------------------------------------------------------------------------------

def bilingual(en, zh) -> Column:
    """both languages, each falling back to the other."""
    e, z = F.nullif(F.trim(col(en)), F.lit("")), F.nullif(F.trim(col(zh)), F.lit(""))
    return F.struct(F.coalesce(e, z, F.lit("")).alias("en"), F.coalesce(z, e, F.lit("")).alias("zh"))


def has_cjk(c) -> Column:
    return col(c).rlike("[\\x{4E00}-\\x{9FFF}]")


def object_class(*names) -> Column:
    """F16: ``system`` by the words of an object's id and names, else ``data``."""
    return F.when(F.concat_ws(" ", *names).rlike(f"(?i){SYSTEM_WORDS}"), "system").otherwise("data")


def rule_kind(formal) -> Column:
    """kind of a rule by the signs in its formal text; the signs are fixed values."""
    f = F.lower(F.coalesce(col(formal), F.lit("")))
    has = lambda *signs: F.array_contains(F.array(*[F.contains(f, F.lit(s)) for s in signs]), True)
    return F.when(has(":="), "state_transition").when(has("block", "∃"), "authorization").when(has("≤", "30d", "60d", "today"), "temporal").when(has("=") & has("σ"), "derivation").otherwise("validation")


def rule_severity(confidence) -> Column:
    """by confidence; the thresholds are fixed values."""
    return F.when(col(confidence) >= 0.95, "block").when(col(confidence) >= 0.88, "warn").otherwise("info")


#: Scalar words of attribute types.
SCALARS = {"uuid": "uuid", "string": "string", "text": "string", "integer": "integer", "int": "integer", "decimal": "decimal", "number": "decimal", "money": "money", "currency": "money", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "datetime", "timestamp": "datetime", "json": "json", "array": "array"}


def attribute_types(rows: DataFrame, raw: str, objects: DataFrame) -> DataFrame:
    """``type``, ``enum_values`` and ``target`` of ``Enum<a|b>``, ``Reference<X>``, a scalar word or the name of an object; else a string."""
    s = strip(F.coalesce(raw, F.lit("")))
    inner = lambda word: F.nullif(F.regexp_extract(s, rf"(?is)^{word}\s*<\s*(.+?)\s*>$", 1), F.lit(""))
    values = F.filter(F.transform(F.split(inner("enum"), r"\|"), strip), lambda v: v != "")
    scalar = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])[F.lower(s)]
    named = rows.withColumn("_s", s).join(objects.select(F.col("name").alias("_s"), F.col("name").alias("_o")).distinct(), "_s", "left")
    kind = F.when(inner("enum").isNotNull(), "enum").when(inner("reference").isNotNull(), "reference").otherwise(F.coalesce(scalar, F.when(F.col("_o").isNotNull(), "reference"), F.lit("string")))
    target = F.coalesce(inner("reference"), F.when(inner("enum").isNull() & scalar.isNull(), F.col("_o")))
    return named.withColumns({"type": kind, "enum_values": F.when(inner("enum").isNotNull(), F.when(F.size(values) > 0, values).otherwise(F.array(F.lit("value")))), "target": target}).drop("_s", "_o")


def routine_arguments(c) -> Column:
    """arguments of a routine as (mode, name, type): commas inside parentheses do not separate, defaults go."""
    flat = F.regexp_replace(col(c), r",(?=[^()]*\))", "\x01")
    one = lambda a: F.regexp_replace(F.trim(a), r"(?i)\s+(default\b|:?=).*$", "")
    mode = lambda a: F.upper(F.coalesce(F.nullif(F.regexp_extract(a, r"(?i)^(inout|in|out|variadic)\s", 1), F.lit("")), F.lit("IN")))
    rest = lambda a: F.regexp_replace(a, r"(?i)^(inout|in|out|variadic)\s+", "")
    parts = F.filter(F.transform(F.split(flat, ","), one), lambda a: a != "")
    return F.transform(parts, lambda a: F.struct(mode(a).alias("mode"), F.regexp_extract(rest(a), r"^(\S+)", 1).alias("name"), F.replace(F.regexp_extract(rest(a), r"^\S+\s+(.*)$", 1), F.lit("\x01"), F.lit(",")).alias("type")))


def trigger_parts(c) -> tuple[Column, Column]:
    """timing (AFTER without any) and events of a trigger's definition, which stand between its timing and `` ON ``."""
    d = F.upper(col(c))
    head = F.regexp_extract(d, r"(?s)^.*?\b(?:BEFORE|AFTER|INSTEAD\s+OF)\b", 0)
    timing = F.regexp_replace(F.regexp_extract(head, r"\b(BEFORE|AFTER|INSTEAD\s+OF)$", 1), r"\s+", " ")
    on = F.nullif(F.instr(d, " ON "), F.lit(0))
    body = F.substring(d, F.length(head) + 1, F.greatest(F.coalesce(on - 1, F.length(d)) - F.length(head), F.lit(0)))
    body = F.when(head == "", d).otherwise(body)
    events = F.array_compact(F.array(*[F.when(body.rlike(rf"\b{e}\b"), e) for e in ("INSERT", "UPDATE", "DELETE")]))
    return F.when(timing == "", "AFTER").otherwise(timing), events


def relation(c) -> Column:
    """Targets of ``verb → A (note), B`` with the verb before them; ``->`` where there is no arrow. Notes in parentheses go from every target."""
    s = strip(F.coalesce(col(c), F.lit("")))
    mark = F.when(F.contains(s, F.lit("→")), "→").otherwise("->")
    at = F.instr(s, "→") + F.when(F.contains(s, F.lit("→")), 0).otherwise(F.instr(s, "->"))
    verb, rest = strip(F.left(s, F.greatest(at - 1, F.lit(0)))), F.substring(s, at + F.length(mark), F.length(s))
    targets = F.filter(F.transform(F.split(rest, ","), lambda x: strip(F.regexp_replace(x, r"\([^)\n\r]*\)", ""))), lambda x: x != "")
    return F.when((at > 0) & (verb != ""), F.transform(targets, lambda x: F.struct(verb.alias("verb"), x.alias("target")))).otherwise(F.array().cast("array<struct<verb:string,target:string>>"))


def labelled(id_, label) -> Column:
    """An id, with its label in parentheses if it has another one."""
    i, n = col(id_), col(label)
    return F.when(n.isNotNull() & (n != "") & (n != i), F.concat(i, F.lit(' ("'), n, F.lit('")'))).otherwise(i)


def triple_text(index, s, p, o, literal, s_label, o_label) -> Column:
    """a numbered triple; a literal object stands in quotes."""
    end = F.when(col(literal), F.concat(F.lit('"'), col(o), F.lit('" [lit]'))).otherwise(labelled(o, o_label))
    return F.concat(col(index).cast("string"), F.lit(". "), labelled(s, s_label), F.lit(" --"), col(p), F.lit("--> "), end)


def hops_text(hops: DataFrame, by: str) -> DataFrame:
    """the hops of each walk (``step``, ``triples``, ``inference``), a line each."""
    line = F.format_string("Hop %d (%d triples): %s", "step", "triples", "inference")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", line.alias("x"))))), lambda h: h["x"])
    return hops.groupBy(by).agg(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(none yet)")).alias("hops"))


# Statistics ---------------------------------------------------------------------------------------

def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows per layer."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("layer"), F.count("*").alias("n")) for k, df in layers.items()])


def term_stats(terms: DataFrame) -> DataFrame:
    """A3: total and matched terms per kind and over all."""
    return terms.rollup("kind").agg(F.count("*").alias("total"), F.count("matched_id").alias("matched")).withColumn("kind", F.coalesce("kind", F.lit("*")))


def reference_counts(refs: DataFrame, targets: DataFrame, owner: str, ref: str) -> DataFrame:
    """A10: references of each owner and how many have a target."""
    known = targets.select(F.col("id").alias("_id")).distinct()
    return refs.join(known, F.col(ref) == F.col("_id"), "left").groupBy(owner).agg(F.count(ref).alias("total_refs"), F.count("_id").alias("resolved_refs"))


def merge_witnesses(rows: DataFrame, owner: str) -> DataFrame:
    """Distinct citations of merged nodes by document, snippet and start; the highest prior confidence."""
    own = rows.groupBy(owner, "document_id", "snippet", "char_start").agg(F.max("verified").alias("verified"), F.max("confidence").alias("confidence"))
    return own.groupBy(owner).agg(F.count("*").alias("sources"), F.count_if("verified").alias("verified"), F.countDistinct("document_id", "snippet").alias("witnesses"), F.max("confidence").alias("prior"))


def roles(actions: DataFrame, processes: DataFrame) -> DataFrame:
    """(``role``, ``kind``, ``id``): each role's actions and the processes that use them, each once."""
    own = actions.where(F.trim("role") != "")
    used = own.join(processes, "action_id").select("role", F.lit("process").alias("kind"), F.col("process_id").cast("string").alias("id"))
    return own.select("role", F.lit("action").alias("kind"), F.col("action_id").cast("string").alias("id")).unionByName(used).distinct()


def relationship_prose(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ordered distinct sentences of each object's relationships between known objects: outgoing ones with the attribute, or else the name, they go by.

    A default without any; prose that an object (``id``, ``name``, ``prose``) has already stays.
    """
    n = names.select("id", "name")
    e = edges.join(n.withColumnsRenamed({"id": "source", "name": "_s"}), "source").join(n.withColumnsRenamed({"id": "target", "name": "_t"}), "target")
    out = e.select(F.col("source").alias("id"), "ord", F.concat("_s", F.lit(" references "), "_t", F.lit(" via "), F.coalesce("via", "name"), F.lit(".")).alias("line"))
    back = e.where("source <> target").select(F.col("target").alias("id"), "ord", F.concat("_s", F.lit(" references "), "_t", F.lit(".")).alias("line"))
    # Each sentence once, so that an object that very many refer to is gathered by its distinct sentences.
    once = out.unionByName(back).groupBy("id", "line").agg(F.min("ord").alias("ord"))
    text = once.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), " ").alias("_p"))
    own = F.when(strip(F.col("prose")) != "", F.col("prose"))
    return names.join(text, "id", "left").select("id", F.coalesce(own, "_p", F.concat("name", F.lit(" has no foreign-key relationships to other tables."))).alias("prose"))


def target_objects(*columns: str) -> Column:
    """Distinct objects of an action's arrays, in order, without nulls."""
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])), lambda x: x.isNotNull()))


# Filters and order --------------------------------------------------------------------------------

def weak_nodes(nodes: DataFrame, most: int = 40, below: float = 0.6) -> DataFrame:
    """Inferred or doubtful nodes, weakest first, ``most`` of them."""
    return nodes.where((F.col("provenance") == "inferred") | (F.col("confidence") < below)).orderBy("confidence", "id").limit(most)


def accept_all(nodes: DataFrame) -> DataFrame:
    """What nobody has decided on is accepted."""
    return nodes.withColumn("review", F.when(F.col("review").isin("accepted", "rejected"), F.col("review")).otherwise("accepted"))


def closed(c, allowed: list[str], default: str) -> Column:
    """A value of a closed vocabulary, else the default."""
    v = F.lower(F.trim(col(c)))
    return F.when(v.isin(allowed), v).otherwise(default)


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different existing nodes."""
    ids = nodes.select("id").distinct()
    return edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def by_severity(rules: DataFrame) -> DataFrame:
    """Rules by severity, then id."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.when(rank == 0, 99).otherwise(rank), "id")))


def phase_status(lo, hi, cursor, done, steps: int) -> Column:
    """Of a phase of sub-steps ``lo`` to ``hi`` (from 0) after sub-step ``cursor`` has run; ``done`` counts as all ``steps``."""
    ran = F.when(col(done), F.lit(steps)).otherwise(col(cursor) + 1)
    return F.when(col(hi) < ran, "complete").when(col(lo) < ran, "running").otherwise("pending")


# Joins and sets -----------------------------------------------------------------------------------

def role_rules(role_actions: DataFrame, preconditions: DataFrame, touched: DataFrame, applies: DataFrame) -> DataFrame:
    """(role, rule): rules that guard the role's actions or apply to objects they touch."""
    guard = role_actions.join(preconditions, "action_id").select("role", "rule_id")
    on = role_actions.join(touched, "action_id").join(applies, "object_id").select("role", "rule_id")
    return guard.unionByName(on).distinct()


def edit_back(original: DataFrame, edited: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Edited values over the originals by key; new keys are added, others stay."""
    e = edited.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = original.join(e, key, "full")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], *[c for c in original.columns if c != key and c not in columns])


def new_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """U8: links not there yet by source, verb and target, each once."""
    k = ["source", "verb", "target"]
    return found.dropDuplicates(k).join(known.select(*k), k, "left_anti")


def event_skeleton(emits: DataFrame, triggers: DataFrame) -> DataFrame:
    """One event for each id that actions emit or wait for, with who does, from first to last mention."""
    rows = emits.select("event_id", "action_id", "ord", F.lit(True).alias("made")).unionByName(triggers.select("event_id", "action_id", "ord", F.lit(False).alias("made")))
    who = lambda made: F.array_sort(F.array_distinct(F.filter(F.collect_list(F.when(F.col("made") == made, F.col("action_id"))), lambda x: x.isNotNull())))
    return rows.groupBy("event_id").agg(F.min("ord").alias("first"), who(True).alias("produced_by"), who(False).alias("consumed_by"))


def infer_objects(steps: DataFrame, io: DataFrame) -> DataFrame:
    """Objects that a process's actions read or write."""
    return steps.join(io, "action_id").select("process_id", "object_id").distinct()


def infer_foreign_keys(columns: DataFrame, objects: DataFrame) -> DataFrame:
    """``customer_id`` refers to Customer; a name without an object refers to none."""
    stem = F.lower(F.regexp_replace(F.regexp_extract("name", r"(?i)^(.*?)_?(?:id|key)$", 1), "_", ""))
    known = objects.select(F.lower(F.regexp_replace("name", r"[\s_-]", "")).alias("_n"), F.col("id").alias("references"))
    return columns.withColumn("_stem", stem).join(known, F.col("_stem") == F.col("_n"), "left").drop("_stem", "_n")


def forward_references(refs: DataFrame, layer_order: list[str]) -> DataFrame:
    """References to a later layer than their owner's."""
    at = lambda c: F.array_position(F.array(*map(F.lit, layer_order)), F.col(c))
    return refs.where(at("to_layer") > at("from_layer"))


def suggest(rows: DataFrame, allowed: list[str], value: str) -> DataFrame:
    """Rows whose value is outside a vocabulary, with the nearest word as the fix."""
    from provenir.operators.suggest import nearest_word

    return rows.where(~F.col(value).isin(allowed)).withColumn("fix", nearest_word(F.col(value), allowed))


def joined_quotes(refs: DataFrame, sentences: DataFrame) -> DataFrame:
    """A citation without a snippet takes the sentences it names, in order."""
    s = refs.select("ref_id", "document_id", F.posexplode("sentence_refs").alias("k", "idx")).join(sentences.select("document_id", "idx", "text"), ["document_id", "idx"])
    t = s.groupBy("ref_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("_t"))
    return refs.join(t, "ref_id", "left").withColumn("snippet", F.coalesce(F.nullif(F.trim("snippet"), F.lit("")), "_t")).drop("_t")


def gaps(findings: DataFrame, layer: str, round_: int) -> DataFrame:
    """C4: findings (``idx``, ``status``, ``text``, ``missing``) as gaps of a layer, described with their sentence in both languages."""
    idx, text = F.col("idx").cast("string"), F.col("text")
    lost = lambda words: F.when(F.coalesce(F.col("missing"), F.lit("")) != "", F.concat(F.lit(words), F.col("missing"))).otherwise("")
    en = F.concat(F.lit("Source sentence "), idx, F.lit(' is not represented: "'), text, F.lit('"'), lost(" — missing: "))
    zh = F.concat(F.lit("源文第 "), idx, F.lit(' 句未被本体覆盖："'), text, F.lit('"'), lost(" — 缺失："))
    return findings.select(F.concat(F.lit(f"gap:cov-r{round_}-"), idx).alias("id"), F.lit(layer).alias("layer"), F.when(F.col("status") == "uncovered", "block").otherwise("warn").alias("severity"), en.alias("en"), zh.alias("zh"))


def digest(nodes: DataFrame, most: int = 240) -> DataFrame:
    """One line for each node, by its kind, shortened.

    ``nodes``: id, kind, name, name_zh, attributes (array), source, target, title, statement, description, steps (a number).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rest = (
        F.when(F.col("kind") == "object", F.concat(text("name"), F.lit(" / "), text("name_zh"), F.lit(" | attrs: "), F.array_join(F.slice(F.coalesce("attributes", F.array().cast("array<string>")), 1, 30), ",")))
        .when(F.col("kind") == "relationship", F.concat(text("name"), F.lit(" | "), text("source"), F.lit(" -> "), text("target")))
        .when(F.col("kind") == "rule", F.concat(text("title"), F.lit(" | "), text("statement")))
        .when(F.col("kind") == "process", F.concat(text("name"), F.lit(" | steps: "), F.coalesce("steps", F.lit(0)).cast("string")))
        .otherwise(F.concat(text("name"), F.lit(" | "), text("description")))
    )
    line = F.concat_ws(" | ", "id", "kind", rest)
    return nodes.select("id", F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line).alias("line"))


#: Fixed values of the drawings: canvas, order of kinds, radii.
WIDTH, HEIGHT = 1100, 700
KINDS = ["object", "rule", "action", "event", "process"]
INNER, OUTER = 190, 320


def layout(nodes: DataFrame, mode: str, order: str = "ord") -> DataFrame:
    """Places of nodes (``id``, ``kind``, ``order``) as ``radial``, ``hierarchical`` or ``clustered`` drawing. Other kinds have none.

    Each place depends on a node's number in its kind and the kind's size alone.
    """
    own = nodes.where(F.col("kind").isin(KINDS)).select("id", "kind", order)
    sizes = own.groupBy("kind").agg(F.count("*").alias("_n"))  # a row for each kind
    sizes = sizes.withColumn("_tier", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1)
    whole = Window.partitionBy(F.lit(0))  # a handful of rows, one for each kind
    sizes = sizes.withColumn("_nth", F.row_number().over(whole.orderBy("_tier")) - 1).withColumn("_kinds", F.count("*").over(whole))
    k = F.row_number().over(Window.partitionBy("kind").orderBy(order, "id")) - 1
    placed = own.withColumn("_k", k).join(F.broadcast(sizes), "kind")
    n, tier, k = F.col("_n"), F.col("_tier"), F.col("_k")
    share = F.when(n == 1, 0.5).otherwise(k / (n - 1))
    on_arc = lambda cx, cy, radius, start, end: (cx + radius * F.cos(start + (end - start) * share), cy + radius * F.sin(start + (end - start) * share))
    cx, cy, turn = F.lit(WIDTH / 2), F.lit(HEIGHT / 2), 2 * F.pi()
    if mode == "radial":
        part = turn / (len(KINDS) - 1)
        start = -F.pi() / 2 + (tier - 1) * part + part * 0.08
        inner, outer = on_arc(cx, cy, F.lit(INNER), F.lit(0.0), turn), on_arc(cx, cy, F.lit(OUTER), start, start + part * 0.84)
        x, y = (F.when(tier == 0, a).otherwise(b) for a, b in zip(inner, outer))
    elif mode == "hierarchical":
        x, y = 120 + (tier + 0.5) * ((WIDTH - 240) / len(KINDS)), 90 + (k + 0.5) * ((HEIGHT - 180) / n)
    elif mode == "clustered":
        angle = -F.pi() / 2 + F.col("_nth") / F.col("_kinds") * turn
        x, y = on_arc(cx + F.cos(angle) * 230, cy + F.sin(angle) * 170, F.least(F.lit(150), 50 + n * 8), F.lit(0.0), turn)
    else:
        raise ValueError(f"no layout {mode}")
    return placed.select("id", "kind", x.cast("double").alias("x"), y.cast("double").alias("y"))
