"""A model's five published layers as one bundle, from one context of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.operators import project as P
from provenir.operators import published as B
from provenir.operators import stages as S
from provenir.sources.tables import keep

LAYERS = ["objects", "rules", "actions", "events", "workflows"]


def text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def names(model: dict[str, DataFrame]) -> DataFrame:
    """The context: under which names ids are published."""
    return S.spec_context(model["object"], model["action"], model["event"], model["gate"])


def of_kind(context: DataFrame, kind: str, id_: str, shown: str) -> DataFrame:
    return context.where(F.col("kind") == kind).select(F.col("id").alias(id_), F.col("shown").alias(shown))


def emitted(model: dict[str, DataFrame], context: DataFrame) -> DataFrame:
    """``action_id``, ``ord``, ``event``: what actions emit, under its published name; unknown events are none."""
    return model["emit"].join(of_kind(context, "event", "event_id", "event"), "event_id").select("action_id", "ord", "event")


def lists(key: str, parts: dict[str, DataFrame], shown: dict[str, list[str]], numbered: str | None = None) -> DataFrame:
    """For each key its rows of each part in order, as an array: what grouping each part with ``array_sort(collect_list(struct(...)))`` and
    joining the results gives, by one shuffle and one sort. A part without rows of a key is an empty array.

    A part has ``key``, then whole numbers, then texts, which order its rows. ``shown``: its columns that are returned, one as it is, several as a
    struct. The first of those of part ``numbered`` is returned as ``text`` as well: a line for each row with its number, nulls left out.
    Parts share columns: each row to Python costs for each column, so there are few and flat ones.
    """
    fields = {n: [f for f in df.schema.fields if f.name != key] for n, df in parts.items()}
    numbers = {n: [f.name for f in own if isinstance(f.dataType, T.IntegralType)] for n, own in fields.items()}
    texts = {n: [f.name for f in own if f.name not in numbers[n]] for n, own in fields.items()}
    if any([f.name for f in own] != numbers[n] + texts[n] for n, own in fields.items()):
        raise ValueError("numbers come before texts")
    most = lambda names: max(map(len, names.values()))
    slots = [("_n", "bigint", numbers, most(numbers)), ("_t", "string", texts, most(texts))]
    place = {n: {c: f"{slot}{i}" for slot, _, own, _ in slots for i, c in enumerate(own[n])} for n in parts}

    def row(n: str) -> list:
        return [(F.col(own[n][i]) if i < len(own[n]) else F.lit(None)).cast(kind).alias(f"{slot}{i}") for slot, kind, own, k in slots for i in range(k)]

    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("_part"), *row(n)) for i, (n, df) in enumerate(parts.items())])
    # Keys of one kind begin alike, so a hash orders them faster.
    rows = rows.repartition(key).sortWithinPartitions(F.xxhash64(key), *rows.columns)
    kind = lambda n, c: "bigint" if c in numbers[n] else "string"
    array = lambda n, own: kind(n, own[0]) if len(own) == 1 else "struct<" + ", ".join(f"`{c}`: {kind(n, c)}" for c in own) + ">"
    out = [f"`{key}` string", *[f"`{n}` array<{array(n, own)}>" for n, own in shown.items()], *(["text string"] if numbered else [])]
    return rows.mapInArrow(gather({n: {c: place[n][c] for c in shown[n]} for n in parts}, numbered), ", ".join(out))


def gather(parts: dict[str, dict[str, str]], numbered: str | None):
    """Arrow batches of rows (key, number of the part, columns), sorted by key and part, to a row for each key. ``parts``: what each part returns, with the columns that it is in."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def begins(rows):
        codes = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.diff(codes, prepend=-1))

    def grouped(rows, at):
        group = np.repeat(np.arange(len(at)), np.diff(at, append=rows.num_rows))
        part, out = rows.column(1).to_numpy(), {rows.schema.names[0]: rows.column(0).take(pa.array(at))}
        for i, (name, fields) in enumerate(parts.items()):
            own = np.flatnonzero(part == i)
            count = np.bincount(group[own], minlength=len(at))
            ends = np.append(0, np.cumsum(count))
            offsets, values = pa.array(ends, pa.int32()), [rows.column(c).take(pa.array(own)) for c in fields.values()]
            out[name] = pa.ListArray.from_arrays(offsets, values[0] if len(values) == 1 else pa.StructArray.from_arrays(values, names=list(fields)))
            if name == numbered:
                nth = pa.array(np.arange(1, len(own) + 1) - np.repeat(ends[:-1], count)).cast(pa.string())
                there = np.flatnonzero(values[0].is_valid())
                ends = np.append(0, np.cumsum(np.bincount(group[own[there]], minlength=len(at))))
                said = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.binary_join_element_wise(nth, values[0], ". ").take(pa.array(there))), "\n")
        return pa.RecordBatch.from_pydict(out | {"text": said} if numbered else out)

    def run(batches):
        held = []  # batches that the last key's rows began in
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0].as_py() == batch.column(0)[-1].as_py():
                continue
            rows = pa.concat_batches(held)
            at = begins(rows)
            held = [rows.slice(int(at[-1]))]
            yield grouped(rows.slice(0, int(at[-1])), at[:-1])
        if held:
            rows = pa.concat_batches(held)
            yield grouped(rows, begins(rows))

    return run


def gathered(model: dict[str, DataFrame], context: DataFrame) -> DataFrame:
    """What each action is, waits for, changes, calls and emits, and which steps take it, in one row: ``action`` is empty where only others name it."""
    own = model["action"].where("id IS NOT NULL").select(F.col("id").alias("action_id"), S.action_shown().alias("shown"), text("description").alias("said"), "actor_kind", "integration")
    effect = model["effect"].where("action_id IS NOT NULL")
    changes = B.data_changes(effect, model["object"]).join(of_kind(context, "object", "object_id", "object"), "object_id").select("action_id", "object", "change", "description")
    named = lambda rows: rows.where("action_id IS NOT NULL")
    parts = {
        "action": own,
        "data_changes": changes,
        "tools": B.tools_of(own, effect).select("action_id", "ord", "tool"),
        "calls": effect.where("kind = 'external_call'").select("action_id", "kind"),
        "lines": named(B.criteria_lines(model["trigger"], model["gate"], model["rule"])),
        "emits": named(emitted(model, context)),
        "steps": model["step"].select("action_id", "ord", "process_id", text("condition").alias("condition")),
    }
    shown = {n: [c for c in df.columns if c != "action_id"] for n, df in parts.items()} | {"tools": ["tool"], "lines": ["line", "rule_id"]}
    return lists("action_id", parts, shown, "lines")


def rules(model: dict[str, DataFrame], acts: DataFrame) -> DataFrame:
    """Rules with the kinds of actors whose actions they gate."""
    kinds = acts.select(F.explode("action.actor_kind").alias("kind"), "lines.rule_id").where("kind IS NOT NULL").select(F.explode("rule_id").alias("id"), "kind").where("id IS NOT NULL").distinct()
    actors = kinds.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("executor"))
    out = P.spec_rules(model["rule"].where("id IS NOT NULL")).join(actors, "id", "left")
    return out.withColumns({"executor": F.coalesce("executor", F.lit("")), "id": P.bare_id("id")})


def actions(acts: DataFrame) -> DataFrame:
    """Actions with what they wait for, change, call and emit."""
    rows = acts.select("*", F.explode("action").alias("a"))
    return rows.select(
        P.bare_id("action_id").alias("id"), F.col("a.shown").alias("name"), F.col("a.said").alias("description"), F.coalesce("a.actor_kind", F.lit("agent")).alias("actor"), F.col("text").alias("submission_criteria"),
        "data_changes", F.col("tools").alias("tool_use"), F.array_distinct("emits.event").alias("triggered_event"),
    )


def workflows(model: dict[str, DataFrame], context: DataFrame, acts: DataFrame) -> DataFrame:
    """Processes with their actors, triggers, steps in order, and the events of their steps, each once."""
    taken = acts.select("action_id", "action", (F.size("calls") > 0).alias("external"), "emits", F.explode("steps").alias("s")).where("s.process_id IS NOT NULL").select("action_id", "action", "external", "emits", "s.*")
    steps = taken.withColumn("a", F.explode_outer("action"))
    step = [
        F.col("ord").cast("string").alias("order"), F.coalesce("a.shown", P.bare_id("action_id")).alias("name"), F.coalesce("a.said", F.lit("")).alias("description"),
        S.workflow_step("a.actor_kind", "a.integration", "external").alias("type"), "condition",
    ]
    known = of_kind(context, "event", "event_id", "_event").select("event_id")
    triggers = S.trigger_names(model["process_trigger"].join(known.withColumn("_known", F.lit(True)), "event_id", "left").where("(kind <> 'event' OR _known) AND process_id IS NOT NULL"))
    parts = {
        "process": model["process"].select(F.col("id").alias("process_id"), text("name").alias("name"), text("description").alias("description")),
        "steps": steps.select("process_id", F.col("ord").alias("_at"), *step),
        "emits": taken.select("process_id", F.col("ord").alias("step"), F.explode("emits").alias("e")).select("process_id", "step", "e.ord", "e.event"),
        "triggers": triggers.select("process_id", "ord", "name"),
        "actors": model["actor"].where((text("role") != "") & F.col("process_id").isNotNull()).select("process_id", "ord", "role"),
    }
    shown = {"process": ["name", "description"], "steps": ["order", "name", "description", "type", "condition"], "emits": ["event"], "triggers": ["name"], "actors": ["role"]}
    rows = lists("process_id", parts, shown).select("*", F.explode("process").alias("p"))
    name = F.coalesce(F.nullif(S.camel("p.name"), F.lit("")), P.bare_id("process_id"))
    return rows.select(
        P.bare_id("process_id").alias("id"), name.alias("name"), F.coalesce(F.nullif("p.description", F.lit("")), F.col("p.name")).alias("description"), F.when(F.size("actors") > 0, F.array_distinct("actors")).otherwise(F.array(F.lit("Agent"))).alias("actor"),
        F.col("triggers").alias("trigger"), F.col("steps").alias("actions"), F.array_distinct("emits").alias("triggered_event"),
    )


def bundle(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five layers. ``model``: object, property, rule, gate, action, trigger, effect, emit, event, process, step, process_trigger, actor.

    Lists of an item (its properties, steps, effects) go into its row, as its document has them; items stay rows.
    """
    context = names(model)
    # Three layers need the actions, so these are written once.
    acts = keep(gathered(model, context), "actions")
    return {
        "objects": P.spec_objects(model["object"], model["property"]),
        "rules": rules(model, acts),
        "actions": actions(acts),
        "events": P.spec_events(model["event"]),
        "workflows": workflows(model, context, acts),
    }


def issues(layers: dict[str, DataFrame], model: dict[str, DataFrame]) -> DataFrame:
    """V13 on a bundle: what its layers name and do not have."""
    context = names(model)
    own = lambda kind: context.where(F.col("kind") == kind).select("kind", F.col("shown").alias("name"))
    known = own("object").unionByName(own("event")).unionByName(own("action"))

    def refs(layer: str, field: str, kind: str, values: Column, trigger: bool = False) -> DataFrame:
        place = F.concat(F.lit(f"{layer}["), "id", F.lit(f"].{field}"))
        return layers[layer].select(place.alias("place"), F.lit(kind).alias("kind"), F.lit(trigger).alias("trigger"), F.lit(False).alias("optional"), F.explode(values).alias("name"))

    asked = refs("actions", "data_changes", "object", F.transform("data_changes", lambda x: x["object"]))
    asked = asked.unionByName(refs("actions", "triggered_event", "event", F.col("triggered_event")))
    asked = asked.unionByName(refs("workflows", "trigger", "event", F.col("trigger"), True)).unionByName(refs("workflows", "triggered_event", "event", F.col("triggered_event")))
    asked = asked.unionByName(refs("workflows", "actions", "action", F.transform("actions", lambda x: x["name"])))
    return S.bundle_issues(asked, known)
