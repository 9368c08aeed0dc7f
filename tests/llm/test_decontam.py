"""Occurrences, slot-heavy windows and short items of decontamination."""

from pyspark.sql import functions as F

from provenir.llm import decontam

from .test_rest import ITEM

DOCS, BENCH = "doc_id bigint, text string", "item_id bigint, text string"


def variant(k, name):
    return ITEM.replace("12 kg", f"{k} kg").replace("3 kg", f"{k + 7} kg").replace("Tom", name).replace("7", f"{k + 9}")


def found(spark, docs, bench):
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.found_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()}


def test_each_occurrence_by_itself(spark):
    filler = "one more sentence about nothing much at all. " * 40
    docs = [
        (1, variant(5, "Max") + ". " + variant(6, "Jim")),
        (2, variant(5, "Max") + ". " + filler + "she sells 99 kg to her friend Bob."),
        (3, filler + variant(5, "Max") + ". " + filler + ITEM + ". " + filler + variant(6, "Jim")),
        (4, filler),
        (5, "well, " * 13 + variant(8, "Joe") + ". " + variant(9, "Ben")),
    ]
    assert found(spark, docs, [(1, ITEM)]) == {(1, 1): "renamed", (2, 1): "renamed", (3, 1): "exact", (5, 1): "renamed"}


def test_many_variants_in_a_long_text(spark):
    assert found(spark, [(1, ". ".join(variant(k, n) for k, n in enumerate(["Max", "Jim", "Joe", "Ben"] * 50, 20)))], [(1, ITEM)]) == {(1, 1): "renamed"}


def test_slot_heavy_and_short_items(spark):
    bench = [(1, "compute 12 + 34 - 56 * 78 / 90 + 11 - 22"), (2, "who is it"), (3, "12 kg"), (4, "rain")]
    docs = [
        (1, "Please compute 12 + 34 - 56 * 78 / 90 + 11 - 22 now, if you can."),
        (2, "Please compute 13 + 35 - 57 * 79 / 91 + 12 - 23 now, if you can."),
        (3, "Somebody asked who is it that calls at the door."),
        (4, "He took 12 kg and she took 13 of them."),
        (5, "Rain"),
        (6, "who was it"),
        (7, None),
        (8, ""),
        (9, "Please compute 13 + 35 * 57 - 79 / 91 - 12 + 23 now, if you can."),
    ]
    # The signs of (2) are the item's, so it is the item with other numbers; those of (9) are not.
    assert found(spark, docs, bench) == {(1, 1): "exact", (2, 1): "renamed", (3, 2): "exact", (4, 3): "exact", (5, 4): "exact"}


def words(spark, text, values=True):
    df = spark.createDataFrame([(text,)], "t string").select(decontam.tokens(F.col("t"), values).alias("w"))
    return [w.rstrip(decontam.END) for w in df.first()["w"]]


def test_one_slot_for_a_number_a_name_and_a_unit(spark):
    n, p, u, s = decontam.NUMBER, decontam.NAME, decontam.UNIT, decontam.SIGN
    assert words(spark, "3.5, 1,000. 3/4 5%") == [n + "3.5", n + "1,000", n + "3/4", n + "5%"]
    assert words(spark, "four or twenty-five or one hundred, none, often, one more") == [n + "four", "or", n + "twenty-five", "or", n + "one hundred", "none", "often", "one", "more"]
    assert words(spark, "Then Tom Smith, Max and Ann McRay left. She sold 12kg, four miles") == ["then", p + "tom smith", p + "max", "and", p + "ann", "mcray", "left", "she", "sold", n + "12", u + "kg", n + "four", u + "miles"]
    assert words(spark, "7+9 - 2 = x-3") == [n + "7", s + "+", n + "9", s + "-", n + "2", "x", n + "3"]
    assert words(spark, "a\x01b\x04c 2\x05") == ["a", "b", "c", n + "2"]
    for text in ("7+9 of Tom Smith, 12kg", "", "?!"):
        assert [w[0] if w[0] in n + p + u else w for w in words(spark, text)] == words(spark, text, False)
    assert spark.createDataFrame([(None,)], "t string").select(decontam.tokens(F.col("t")).alias("w")).first()["w"] is None


def test_variants_with_other_forms_of_numbers_and_names(spark):
    item = "a farmer called Tom Smith picks 3 apples and 5 pears and sells 2 kg of them to his friend Bob at noon"
    docs = [
        (1, item.replace("3 apples", "3.5 apples").replace("5 pears", "1,000 pears")),
        (2, item.replace("3 apples", "four apples").replace("Tom Smith", "Max").replace("Bob", "Mary Ann Lee")),
        (3, item),
        (4, "a farmer called on us and sells pears to his friend at noon"),
        (5, "Tell me: what is 7 + 9?"),
        (6, "what is 7 * 9?"),
    ]
    assert found(spark, docs, [(1, item), (2, "What is 2 + 3?")]) == {(1, 1): "renamed", (2, 1): "renamed", (3, 1): "exact", (5, 2): "renamed"}


def test_long_runs_need_no_stack(spark):
    # Each took a stack frame for a part of the run, and the overflow ended the executor.
    texts = ["1/2," * 20000 + "3", "two " * 20000 + "x", "the " + "Foo " * 20000 + "BarBaz", "one " + "twenty-" * 20000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1).select("k", decontam.tokens(F.col("t"), values=False).alias("w")).collect()
    got = {r["k"]: r["w"] for r in rows}
    assert got == {0: [decontam.NUMBER], 1: [decontam.NUMBER, "x"], 2: ["the", decontam.NAME, "barbaz"], 3: [decontam.NUMBER]}
