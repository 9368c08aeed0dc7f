"""The published bundle of a small model, and what it names."""

from pyspark.sql import functions as F

from provenir.operators import bundle as B

SCHEMAS = {
    "object": "id string, name string, description string, primary_key string", "property": "object_id string, ord int, name string, type string, is_foreign_key boolean, references string",
    "rule": "id string, title string, statement string", "gate": "action_id string, rule_id string, ord int",
    "action": "id string, name string, description string, actor_kind string, integration string", "trigger": "action_id string, event_id string, ord int",
    "effect": "action_id string, ord int, kind string, object_id string, description string", "emit": "action_id string, ord int, event_id string",
    "event": "id string, name string, description string", "process": "id string, name string, description string",
    "step": "process_id string, ord int, action_id string, condition string", "process_trigger": "process_id string, ord int, kind string, event_id string", "actor": "process_id string, ord int, role string",
}


def model(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def full(spark):
    return model(
        spark,
        object=[("objectType:a", "Order", " d ", None)], property=[("objectType:a", 2, "x", "decimal", False, None), ("objectType:a", 1, "id", "uuid", False, None)],
        rule=[("rule:1", "Limit", "At most ten."), ("rule:2", None, "Pay first, then ship.")], gate=[("action:ship", "rule:2", 1), ("action:ship", "rule:9", 2)],
        action=[("action:ship", "ship order", " ships ", "human", None), ("action:pay", "pay", None, None, "bank")], trigger=[("action:pay", "event:order.made", 1)],
        effect=[("action:pay", 1, "payment", "objectType:a", " paid "), ("action:pay", 2, "db_write", "objectType:z", "lost"), ("action:ship", 1, "external_call", None, "carrier")],
        emit=[("action:pay", 2, "event:paid"), ("action:pay", 1, "event:paid"), ("action:ship", 1, "event:none")], event=[("event:paid", "order.paid", None)],
        process=[("process:p", None, "Sell"), ("process:q", "empty one", None)], step=[("process:p", 2, "action:ship", " if paid "), ("process:p", 1, "action:pay", None), ("process:p", 3, "action:gone", None)],
        process_trigger=[("process:p", 1, "event", "event:none"), ("process:p", 2, "schedule", None), ("process:p", 3, "event", "event:paid")], actor=[("process:p", 2, "clerk"), ("process:p", 1, "bot"), ("process:p", 3, "clerk"), ("process:p", 4, " ")],
    )


def test_five_layers(spark):
    m = full(spark)
    got = {n: {r["id"] if "id" in r.asDict() else r["name"]: r.asDict(recursive=True) for r in df.collect()} for n, df in B.bundle(m).items()}
    assert list(got) == B.LAYERS
    (order,) = got["objects"].values()
    assert [p["name"] for p in order["properties"]] == ["id", "x"] and order["name"] == "Order"
    assert got["rules"]["1"]["businessLogicRuleName"] == "Limit" and got["rules"]["2"]["executor"] == "human" and got["rules"]["1"]["executor"] == ""
    assert list(got["events"]) == ["ORDER_PAID"]
    pay, ship = got["actions"]["pay"], got["actions"]["ship"]
    assert pay["data_changes"] == [{"object": "Order", "change": "MODIFY", "description": "paid"}] and pay["tool_use"] == ["bank"] and pay["triggered_event"] == ["ORDER_PAID"] and pay["actor"] == "agent"
    assert ship["name"] == "shipOrder" and ship["tool_use"] == ["carrier"] and ship["triggered_event"] == [] and ship["submission_criteria"].startswith("1. ") and "\n" not in ship["submission_criteria"]
    p = got["workflows"]["p"]
    assert p["actor"] == ["bot", "clerk"] and p["trigger"] == ["SCHEDULED_SYNC", "PAID"] and p["triggered_event"] == ["ORDER_PAID"] and p["description"] == "Sell" and p["name"] == "p"
    assert [(s["order"], s["name"], s["type"], s["condition"]) for s in p["actions"]] == [("1", "pay", "tool", ""), ("2", "shipOrder", "manual", "if paid"), ("3", "gone", "logic", "")]
    q = got["workflows"]["q"]
    assert (q["actor"], q["trigger"], q["actions"], q["triggered_event"], q["name"], q["description"]) == (["Agent"], [], [], [], "emptyOne", "empty one")


def test_an_empty_model_has_empty_layers(spark):
    assert all(df.count() == 0 for df in B.bundle(model(spark)).values())


def test_issues_of_a_bundle(spark):
    m = full(spark)
    layers = B.bundle(m)
    assert sorted(r["message"] for r in B.issues(layers, m).collect()) == ['workflows[p].actions: unknown action "gone"', 'workflows[p].trigger: unknown event "PAID"']
    spoilt = {**layers, "workflows": layers["workflows"].withColumn("triggered_event", F.array(F.lit("LOST")))}
    assert 'workflows[q].triggered_event: unknown event "LOST"' in [r["message"] for r in B.issues(spoilt, m).collect()]


def test_actions_are_made_once_for_all_layers(spark):
    plan = B.bundle(full(spark))["actions"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_an_action_that_stands_twice_is_published_twice(spark):
    m = full(spark)
    m["action"] = m["action"].unionByName(m["action"].where("id = 'action:pay'"))
    layers = B.bundle(m)
    assert sorted(r["id"] for r in layers["actions"].collect()) == ["pay", "pay", "ship"]
    assert [s["name"] for s in layers["workflows"].where("id = 'p'").first()["actions"]] == ["pay", "pay", "shipOrder", "gone"]


def test_lists_are_those_of_grouped_rows(spark):
    # Groups of many Arrow batches, of one row, of no row in a part; null keys and values.
    key = F.when(F.col("id") % 40_000 < 25_000, "k:big").when(F.col("id") % 7 > 0, F.concat(F.lit("k:"), (F.col("id") % 4_000).cast("string")))
    rows = spark.range(45_000).select(key.alias("k"), (F.col("id") * 7919 % 45_000).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    few = rows.where("n % 11 = 0").select("k", F.col("s").alias("t"))
    got = B.lists("k", {"a": rows, "b": few}, {"a": ["n", "s"], "b": ["t"]}, "b")
    array = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    want_a, want_b = rows.groupBy("k").agg(array("n", "s").alias("a")), few.groupBy("k").agg(array("t").alias("b"))
    assert {(r["k"], tuple(r["a"])) for r in got.select("k", "a").collect()} == {(r["k"], tuple(r["a"])) for r in want_a.collect()}
    b = {r["k"]: r for r in got.select("k", "b", "text").collect()}
    want = {r["k"]: [x["t"] for x in r["b"]] for r in want_b.collect()}
    assert len(b) == got.count() and {k for k, r in b.items() if r["b"]} == set(want)
    for k, values in want.items():
        assert b[k]["b"] == values and b[k]["text"] == "\n".join(f"{i}. {v}" for i, v in enumerate(values, 1) if v is not None)
