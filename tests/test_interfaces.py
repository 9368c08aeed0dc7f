"""Interfaces and tools of a small model."""

from provenir.operators import interfaces as I

OBJECTS, PROPERTIES = "id string, ord long, name string", "object_id string, ord int, name string, type string, references string, primary_key boolean"
ACTIONS, GATES = "id string, ord long, tool string, name string", "action_id string, ord int, rule_id string, severity string"
IOS = "action_id string, side string, ord int, name string, type string, object_id string, required boolean, many boolean"


def tables(spark, empty=False):
    t = lambda rows, schema: spark.createDataFrame([] if empty else rows, schema)
    return (
        t([("objectType:a", 1, "Sales order"), ("objectType:b", 2, "sales-order"), ("objectType:7x", 3, None), ("objectType:d", 4, "!!")], OBJECTS),
        t([("objectType:a", 2, "soldTo", "String", "objectType:7x", False), ("objectType:a", 1, "ID", "Integer", None, True), ("objectType:a", 3, "gone", "String", "objectType:?", None), ("objectType:b", 1, "tags", "List<String>", None, None)], PROPERTIES),
        t([("action:1", 1, None, "Ship order"), ("action:2", 2, "ship_order", "x"), ("action:3", 3, "", ""), ("action:4", 4, None, "2 go")], ACTIONS),
        t(
            [
                ("action:1", "input", 1, "theOrder", None, "objectType:b", True, True), ("action:1", "input", 2, "n", "Integer", None, False, False), ("action:1", "output", 1, "done", "Boolean", None, True, False),
                ("action:2", "output", 1, "a", None, "objectType:a", True, False), ("action:2", "output", 2, "b", "List<String>", None, None, True), ("action:2", "input", 1, "a", None, "objectType:a", None, None), ("action:2", "input", 2, "z", None, "objectType:z", None, None),
            ],
            IOS,
        ),
        t([("action:1", 1, "rule:it's", "block"), ("action:1", 2, "rule:9", None), ("action:9", 1, "rule:8", None)], GATES),
    )


def document(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["file"], r["at"])):
        out.setdefault(r["file"], []).append(r["line"])
    return out


def test_names_and_warnings(spark):
    objects, _, actions, _, gates = tables(spark)
    assert {r["object_id"]: r["interface"] for r in I.interface_names(objects).collect()} == {"objectType:a": "SalesOrder", "objectType:b": "SalesOrder2", "objectType:7x": "_7x", "objectType:d": "Unnamed"}
    assert {r["action_id"]: (r["tool"], r["renamed"]) for r in I.tool_names(actions).collect()} == {"action:1": ("ship_order", False), "action:2": ("ship_order_2", True), "action:3": ("_3", False), "action:4": ("_2_go", False)}
    rules = spark.createDataFrame([("rule:it's",)], "id string")
    assert sorted(tuple(r) for r in I.warnings(actions, gates, rules).collect()) == [("action:1", "missing rule", "rule:9"), ("action:2", "renamed", "ship_order_2")]


def test_documents(spark):
    objects, properties, actions, ios, gates = tables(spark)
    (types,) = document(I.type_lines(objects, properties)).values()
    assert types == [
        "export interface SalesOrder {", "  id: number;", "  sold_to?: _7x;", "  gone?: string;", "}", "export interface SalesOrder2 {", "  tags?: string[];", "}",
        "export interface _7x {", "  [key: string]: unknown;", "}", "export interface Unnamed {", "  [key: string]: unknown;", "}",
    ]
    tools = document(I.tool_lines(actions, objects, ios, gates))
    assert sorted(tools) == ["tools/_2_go.ts", "tools/_3.ts", "tools/ship_order.ts", "tools/ship_order_2.ts"]
    assert tools["tools/ship_order.ts"] == [
        "import type { SalesOrder2 } from '../types.js';", "export interface ShipOrderInput {", "  the_order: SalesOrder2[];", "  n?: number;", "}", "export async function ship_order(input: ShipOrderInput): Promise<boolean> {",
        "  assertPrecondition('rule:it\\'s', 'block', true);", "  assertPrecondition('rule:9', 'info', true);", "  throw new Error('Not implemented: ship_order');", "}",
    ]
    assert tools["tools/ship_order_2.ts"][:9] == [
        "import type { SalesOrder } from '../types.js';", "export interface ShipOrder2Input {", "  a?: SalesOrder;", "  z?: unknown;", "}",
        "export interface ShipOrder2Output {", "  a: SalesOrder;", "  b?: string[];", "}",
    ]
    assert tools["tools/ship_order_2.ts"][9] == "export async function ship_order_2(input: ShipOrder2Input): Promise<ShipOrder2Output> {"
    assert tools["tools/_3.ts"][2] == "export async function _3(): Promise<void> {"
    (index,) = document(I.registry_lines(actions)).values()
    assert index[:2] == ["import { ship_order } from './ship_order.js';", "import { ship_order_2 } from './ship_order_2.js';"] and index[4] == "export const tools = {" and index[8:] == ["  _2_go,", "} as const;", "export type ToolName = keyof typeof tools;"]


def test_an_empty_model(spark):
    objects, properties, actions, ios, gates = tables(spark, empty=True)
    assert I.type_lines(objects, properties).count() == 0 and I.tool_lines(actions, objects, ios, gates).count() == 0 and I.registry_lines(actions).count() == 3


def test_names_are_made_once(spark):
    """A name's expression stands in no plan more often than it is asked for: before, each use made it anew."""
    actions = spark.createDataFrame([(f"action:{k}", k, None, f"Handle {k}") for k in range(4)], "id string, ord long, tool string, name string")
    plan = I.tool_names(actions)._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-zA-Z0-9]" not in plan
