"""Views of a model and back."""

from provenir.operators import views as V

OBJECTS = "ord int, name string, zh string, confidence double, attrs array<struct<name:string,type:string,role:string>>, relations array<string>"
RULES = "id string, en string, zh string, formal string, confidence double, document string, excerpt string, page int, objects array<string>"
PROCESSES = "id string, name string, zh string, actors array<string>, objects array<string>, steps array<struct<en:string,zh:string,obj:string>>"


def view(spark, objects=(), rules=(), processes=()):
    return {"objects": spark.createDataFrame(list(objects), OBJECTS), "rules": spark.createDataFrame(list(rules), RULES), "processes": spark.createDataFrame(list(processes), PROCESSES)}


def rows(df, *by):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [str(r[k]) for k in by])


def full(spark):
    return view(
        spark,
        [
            (2, "Order", "单", 0.9, [("order_id", "String", "pk"), ("total", "Float", None), ("customer_id", "Reference<Customer>", "fk"), ("marks", "List<String>", None)], ["billed to → Customer"]),
            (1, "Customer", "客", 0.8, [("customer_id", "String", "pk"), ("born", "Date", None)], ["places → Order", "knows → Customer"]),
            (3, "Lone", None, None, [("lone_id", "String", "pk")], []),
        ],
        [("r1", "Pay first.", "先付", "paid := true", 0.95, "Book", "pay", 3, ["Order", "Customer"]), ("r2", "Be kind", "", "", 0.5, None, None, None, [])],
        [("p", "sell", "卖", ["clerk", "boss"], ["Order"], [("Take order", "接", "Order"), ("Tell", "说", "Customer"), ("Rest", "", "Order")]), ("q", "idle", "", [], [], [])],
    )


def test_the_way_there_and_back_loses_nothing(spark):
    v = full(spark)
    back = V.to_view(V.from_view(v))
    assert rows(back["objects"].drop("id"), "ord") == rows(v["objects"], "ord")
    drop = lambda part: [{k: x for k, x in r.items() if k != "id"} for r in rows(part, "en" if "en" in part.columns else "name")]
    assert drop(back["rules"]) == drop(v["rules"]) and drop(back["processes"]) == drop(v["processes"])
    again = V.to_view(V.from_view(back))
    assert rows(again["objects"], "ord") == rows(back["objects"], "ord")


def test_types_references_and_relations(spark):
    v = view(
        spark,
        [
            (1, "Line Item", None, None, [("a", " Enum< x | |y > ", None), ("b", "Money", None), ("c", "Order", None), ("order_id", "uuid", "fk"), ("d", "reference < Gone >", None), ("e", "thing", "fk"), ("line_item_id", "int", "fk"), (None, None, None)], ["part of -> Order (main), Gone, Line Item", "part of → Order", "none", "→ Order", "x →"]),
            (2, "Order", None, None, None, None),
            (2, "Order", "again", None, [], []),
        ],
    )
    m = V.from_view(v)
    props = {r["name"]: (r["type"], r["references"], r["description"]) for r in m["property"].collect()}
    assert props == {
        "a": ("List<String>", None, "One of: x, y."), "b": ("Float", None, "b."), "c": ("String", "objectType:order", "c."), "order_id": ("String", "objectType:order", "order_id."),
        "d": ("String", "objectType:gone", "d."), "e": ("String", None, "e."), "line_item_id": ("Integer", None, "line_item_id."), None: ("String", None, None),
    }
    assert sorted((r["id"], r["target"], r["label"]) for r in m["relationship"].collect()) == [
        ("rel:line-item-part-of-line-item", "objectType:line-item", "part of → Line Item"), ("rel:line-item-part-of-order", "objectType:order", "part of → Order"), ("rel:line-item-part-of-order-2", "objectType:order", "part of → Order"),
    ]
    assert {r["id"]: r["primary_key"] for r in m["object"].collect()} == {"objectType:line-item": "line_item_id", "objectType:order": "order_id"}


def test_steps_become_a_chain_of_actions_and_events(spark):
    m = V.from_view(full(spark))
    emits = {r["action_id"]: r["event_id"] for r in m["emit"].collect()}
    assert emits == {"action:p-0-take-order": "event:p.0.order.done", "action:p-1-tell": "event:p.1.customer.done", "action:p-2-rest": "event:p.2.order.done"}
    assert {r["action_id"]: r["event_id"] for r in m["trigger"].collect()} == {"action:p-1-tell": "event:p.0.order.done", "action:p-2-rest": "event:p.1.customer.done"}
    assert {(r["name"], r["after"]) for r in m["event"].collect()} == {("P_0_ORDER_DONE", "Take order"), ("P_1_CUSTOMER_DONE", "Tell"), ("P_2_ORDER_DONE", "Rest")}
    assert {r["id"]: (r["kind"], r["severity"]) for r in m["rule"].collect()} == {"rule:r1-pay-first": ("state_transition", "block"), "rule:r2-be-kind": ("validation", "info")}


def test_an_empty_view(spark):
    m = V.from_view(view(spark))
    assert all(df.count() == 0 for df in [*m.values(), *V.to_view(m).values()])


def test_rows_without_a_key_are_made_once(spark):
    """A look-up reads its rows once; a missing key meets nothing, not even a name that looks like a place."""
    rows = spark.range(6).selectExpr("id", "CASE WHEN id < 2 THEN 'a' WHEN id = 2 THEN 'b' END AS _name", "array(named_struct('x', id)) AS more")
    table = spark.createDataFrame([("a", "A")] + [(str(k), "wrong") for k in range(V.PLACES)], "_name string, _id string")
    out = V.looked_up(rows, "_name", table, "_id")
    assert sorted((r["id"], r["_id"]) for r in out.collect()) == [(0, "A"), (1, "A"), (2, None), (3, None), (4, None), (5, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_steps_are_written_for_all_that_is_made_of_them(spark):
    from provenir.plans import catalogue, view_queries  # noqa: F401

    for name in ("p13_view_actions", "p13_view_objects"):
        assert "orders" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
