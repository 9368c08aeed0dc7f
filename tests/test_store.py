"""Writers at the same time, lost races, crashes; the graph's merges; the log; client-paced runs; issues from differences."""

import json
import os
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from provenir.operators import integrity as V
from provenir.operators import stages
from provenir.sources import store


def test_create_once_has_one_winner(spark, tmp_path):
    files = store.Files(spark, str(tmp_path))
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda k: files.create_once("a/b.json", json.dumps(k)), range(64)))
    assert sum(won) == 1 and json.loads(files.read("a/b.json")) == won.index(True)
    # Nothing else is left, hidden or not.
    assert [n for n in os.listdir(tmp_path / "a") if not n.endswith(".crc")] == ["b.json"]


def nodes(spark, n):
    return spark.range(n).select(F.lit("object").alias("kind"), F.col("id").cast("string").alias("id"))


def test_savers_at_once_get_versions_of_their_own(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        got = dict(zip(pool.map(lambda n: s.save("m/ü ", "Model", "d", nodes(spark, n)), range(1, 5)), range(1, 5)))
    assert sorted(got) == [1, 2, 3, 4]
    for version, n in got.items():
        assert s.nodes("m/ü ", version).count() == n == s.get("m/ü ", version)["nodes"]
    assert [(r["id"], r["version"]) for r in s.list().collect()] == [("m/ü ", 4)]
    assert s.get("m/ü ", 9) is None and s.get("other") is None
    with pytest.raises(KeyError):
        s.nodes("m/ü ", 9)


def test_marks_and_state_written_at_once_are_all_kept(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    state = lambda k: spark.createDataFrame([(f"k{k}", str(k))], "key string, json string")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: (s._mark(f"m{k}", k % 2 == 0), s.put_state(state(k))), range(16)))
    assert {(r["id"], r["deleted"]) for r in s._read("deleted", "id string, deleted boolean, at timestamp").collect()} == {(f"m{k}", k % 2 == 0) for k in range(16)}
    assert {(r["key"], r["json"]) for r in s.state().collect()} == {(f"k{k}", str(k)) for k in range(16)}


def test_lost_race_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path))
    s.save("m", "Model", "d", nodes(spark, 3))
    with pytest.raises(store.Conflict):
        s.save("m", "Model", "d", nodes(spark, 5), expected=0)
    # Another writer is first, after this one has looked.
    true = s.files.create_once
    monkeypatch.setattr(s.files, "create_once", lambda name, text: store.Store(spark, str(tmp_path)).save("m", "Other", "d", nodes(spark, 4)) and true(name, text))
    with pytest.raises(store.Conflict):
        s.save("m", "Model", "d", nodes(spark, 5), expected=1)
    monkeypatch.setattr(s.files, "create_once", true)
    assert s.versions("m") == [1, 2] and s.get("m")["name"] == "Other" and sorted(r["nodes"] for r in s.heads().collect()) == [3, 4]
    assert s.save("m", "Model", "d", nodes(spark, 6), expected=2) == 3
    # A crash between the rows and the commit.
    monkeypatch.setattr(s.files, "create_once", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        s.save("m", "Model", "d", nodes(spark, 7))
    monkeypatch.setattr(s.files, "create_once", true)
    assert s.versions("m") == [1, 2, 3] and s.heads().count() == 3
    assert s.sweep() == 1 and s.sweep() == 0 and s.nodes("m", 3).count() == 6


def import_(spark, seq, ids, edges, name="n"):
    n = spark.createDataFrame([("L", i, f'{{"{name}":{seq}}}') for i in ids] + [(None, "x", "{}"), ("L", None, "{}")], "label string, id string, props string")
    e = spark.createDataFrame([("E", a, b, None) for a, b in edges] + [("E", None, "x", "{}")], "type string, source string, target string, props string")
    return n, e


def seen(g):
    return Counter(map(tuple, g.nodes().collect())), Counter(map(tuple, g.edges().collect()))


def test_graph_is_the_same_after_any_imports(spark, tmp_path):
    parts = {1: import_(spark, 1, "abcd", [("a", "b"), ("b", "z"), ("a", "b")]), 2: import_(spark, 2, "bcz", [("b", "c")]), 3: import_(spark, 3, "a", [])}
    graphs = []
    for k, order in enumerate([(1, 2, 3), (3, 2, 1), (2, 1, 2, 3, 1, 1)]):
        g = store.Graph(spark, f"{tmp_path}/{k}", buckets=4)
        took = [g.merge(*parts[seq], "m", seq) for seq in order]
        assert took == [seq not in order[:i] for i, seq in enumerate(order)]
        graphs.append(seen(g))
    assert graphs[0] == graphs[1] == graphs[2]
    found, edges = graphs[0]
    assert found == Counter({("L", "a", '{"n":3}'): 1, ("L", "b", '{"n":2}'): 1, ("L", "c", '{"n":2}'): 1, ("L", "d", '{"n":1}'): 1, ("L", "z", '{"n":2}'): 1})
    assert set(edges) == {("E", "a", "b", "{}"), ("E", "b", "z", "{}"), ("E", "b", "c", "{}")}
    assert seen(store.Graph(spark, f"{tmp_path}/none")) == (Counter(), Counter())


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    g = store.Graph(spark, str(tmp_path), buckets=8)
    g.merge(*import_(spark, 1, [f"n{k}" for k in range(40)], []), "m", 1)

    def state():
        return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(tmp_path / "nodes") for f in fs if f.startswith("part-")}

    before = state()
    for seq in range(2, 5):
        g.merge(*import_(spark, seq, ["n1"], []), "m", seq)
    assert before.items() <= state().items()
    was = seen(g)
    touched = [b for b, parts in g.files_of("nodes").items() if len(parts) > 2]
    assert len(touched) == 1 and g.compact("nodes", 2) == touched and g.compact("nodes", 2) == []
    assert seen(g) == was and all(len(parts) == 1 for parts in g.files_of("nodes").values())
    # All but the files of that bucket are the ones from before.
    assert {k: v for k, v in before.items() if f"bucket={touched[0]}/" not in k}.items() <= state().items()


def test_many_lines_make_few_files(spark, tmp_path):
    log = store.RunLog(spark, str(tmp_path))
    log.LINES = 9000
    for k in range(100_000):
        log.add(f"r{k % 3}", f"line {k}\nmore", "llm" if k % 2 else "step")
    rows = log.rows()
    assert rows.count() == 100_000 and rows.select("message").distinct().count() == 100_000
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path) for f in fs) < 10
    line = store.stamped(rows.where("message = 'line 7\\nmore'")).first()["line"]
    assert line.endswith("] [llm] line 7 more") and line[0] == "["
    assert store.RunLog(spark, str(tmp_path)).rows().count() == 100_000


def test_a_large_base_is_written_by_many_tasks(spark, tmp_path):
    log = store.RunLog(spark, str(tmp_path))
    lines = spark.range(40_000).select(F.lit("r").alias("run_id"), F.current_timestamp().alias("at"), F.lit("llm").alias("category"), F.sha2(F.col("id").cast("string"), 256).alias("message"))
    log.FILE = 256 << 10
    log.append(lines)
    assert log.compact() and log.rows().select("message").distinct().count() == 40_000
    sizes = [os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(tmp_path / "merged") for f in fs if f.endswith(".parquet")]
    assert len(sizes) > 4 and max(sizes) < 2 * log.FILE


def test_log_never_stops_a_run(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    log = store.RunLog(spark, str(tmp_path / "file" / "log"))
    log.add("r", "m")
    log.flush()
    log.add("r", "m")
    log.flush()
    assert log.off


def steps(spark, calls, fails):
    def work(name):
        def run(got):
            calls.append(name)
            if fails.get(name):
                raise fails.pop(name)
            return spark.createDataFrame([(name, len(got))], "name string, before int")

        return run

    return [(n, work(n)) for n in ("a", "b", "c")]


def test_clients_pace_a_run(spark, tmp_path):
    calls, now = [], [1000.0]
    fails = {"b": OSError("network")}
    one, two = (stages.Cursor(spark, str(tmp_path), "run", steps(spark, calls, fails), lease=60, clock=lambda: now[0]) for _ in range(2))
    assert one.advance(0) == {"cursor": 1, "status": "running", "step": "a"}
    assert two.advance(0) == {"cursor": 1, "status": "behind", "step": "a"}
    with pytest.raises(OSError):
        two.advance(1)
    # A failed call has not moved the cursor and holds no claim.
    assert one.advance(1) == {"cursor": 2, "status": "running", "step": "b"}
    assert two.advance() == {"cursor": 3, "status": "complete", "step": "c"} and one.advance() == {"cursor": 3, "status": "complete", "step": "c"}
    assert calls == ["a", "b", "b", "c"] and {k: v.first()["before"] for k, v in one.results().items()} == {"a": 0, "b": 1, "c": 2}


def test_a_crashed_client_is_taken_over_and_counts_once(spark, tmp_path):
    calls, now = [], [1000.0]
    one, two = (stages.Cursor(spark, str(tmp_path), "run", steps(spark, calls, {}), lease=60, clock=lambda: now[0]) for _ in range(2))
    assert one._claim(0)  # and then it is gone
    assert two.advance()["status"] == "busy" and calls == []
    now[0] += 61
    # The first one comes back while the second runs the step: both write, one counts.
    inner = two.steps[0][1]
    two.steps[0] = ("a", lambda got: (inner(got), stages.Cursor(spark, str(tmp_path), "run", steps(spark, calls, {}), clock=lambda: now[0] + 100_000).advance())[0])
    assert two.advance()["cursor"] == 1
    assert calls == ["a", "a"] and [d["step"] for d in one.done()] == ["a"] and one.results()["a"].count() == 1
    assert len([n for n in one.files.names("out")]) == 1


def test_a_step_that_fails_inside_advances(spark, tmp_path):
    calls = []
    c = stages.Cursor(spark, str(tmp_path), "run", steps(spark, calls, {"a": stages.StepFailed("no reply")}))
    assert c.advance() == {"cursor": 1, "status": "running", "step": "a"} and c.done()[0]["status"] == "failed"
    assert c.advance(1)["cursor"] == 2 and list(c.results()) == ["b"] and c.results()["b"].first()["before"] == 0


PATHS = [V.Path("rel", "id", "source", "obj", "id"), V.Path("rel", "id", "others", "obj", "id", "warn"), V.Path("rule", "id", "rel_id", "rel", "id"), V.Path("obj", "id", "parent", "obj", "id")]


def random_model(spark, rng):
    some = lambda n: [f"o{rng.randrange(n)}" for _ in range(rng.randrange(3))]
    maybe = lambda x: x if rng.random() < 0.8 else None
    obj = [(f"o{rng.randrange(12)}", maybe(f"o{rng.randrange(14)}")) for _ in range(10)]
    rel = [(f"r{rng.randrange(9)}", maybe(f"o{rng.randrange(14)}"), some(14)) for _ in range(9)]
    rule = [(f"u{k}", maybe(f"r{rng.randrange(11)}")) for k in range(6)]
    return obj, rel, rule


def edited(rng, rows, fresh):
    return [f if rng.random() < 0.25 else r for r, f in zip(rows, fresh) if rng.random() < 0.85] + fresh[: rng.randrange(2)]


def test_issues_of_random_edits_are_those_of_a_whole_check(spark):
    schemas = {"obj": "id string, parent string", "rel": "id string, source string, others array<string>", "rule": "id string, rel_id string"}
    frames = lambda model: {n: spark.createDataFrame(rows, schemas[n]) for n, rows in zip(schemas, model)}
    for seed in range(5):
        rng = random.Random(seed)
        first = random_model(spark, rng)
        touched = [{"obj"}, {"rel"}, {"rule", "obj"}, None, set()][seed]
        fresh = random_model(spark, rng)
        second = [edited(rng, a, b) if touched is None or n in touched else a for n, a, b in zip(schemas, first, fresh)]
        old, new = frames(first), frames(second)
        got = V.revalidate(old, new, PATHS, V.dangling(old, PATHS), touched)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, V.dangling(new, PATHS).collect())), seed


def test_a_rerun_gives_a_layer_and_its_issues(spark, tmp_path):
    ids = ["rule:1", "rule:2"]
    layers = {
        "objects": lambda got: spark.createDataFrame([("objectType:a",)], "id string"),
        "rules": lambda got: spark.createDataFrame([(i, "objectType:a" if i == "rule:1" else "objectType:b") for i in ids], "id string, object_id string"),
    }
    model = lambda got: {"object_type": got["objects"], "rule_object": got["rules"].withColumnRenamed("id", "rule_id")} if "rules" in got else {"object_type": got["objects"]}
    run = stages.Run(spark, str(tmp_path), "r", layers)
    assert run.run() == "complete"
    ids.append("rule:3")
    layer, issues = run.rerun("rules", model, V.MODEL_PATHS, stages.PREFIXES["rules"])
    assert layer.count() == 3 and sorted((r["from_id"], r["missing_id"]) for r in issues.collect()) == [("rule:2", "objectType:b"), ("rule:3", "objectType:b")]
