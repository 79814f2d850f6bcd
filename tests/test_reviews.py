"""Reviews: tags, each invariant broken once, strict replay, sense probe, windows of records."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import reviews as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tags(spark):
    tags = lambda t: one(spark, V.review_tags(F.col("t")), t=t)
    assert "dialogue_register" in tags("他说：“走吧。”") and "dialogue_register" not in tags("他说：“走吧。") and "domain_terms" in tags("玩家获得技能和装备。") and "number_negation" in tags("不到5%的人成功。")
    assert tags("字" * 90) == ["semantic_context"] and tags("字" * 20) == ["natural_vi"] and tags("字") == [] and "quote_author" in tags("求月票") and "quote_author" not in tags("制作者")
    assert one(spark, V.risk_tags(F.col("t")), t="“a” BOSS 12 师姐") == ["dialogue", "digits", "latin", "name_cue"] and one(spark, V.risk_tags(F.col("t")), t="字" * 121) == ["long_line"]
    assert one(spark, V.categories(F.col("t"), {"stats": ["血量", "攻击"], "guild": ["公会"], "none": []}), t="公会攻击") == ["stats", "guild"]
    assert one(spark, V.classify(F.col("t")), t="npc 来了") == "game" and one(spark, V.classify(F.col("t")), t="山") == "general"
    assert one(spark, V.pair_labels(F.col("s"), F.col("t")), s="boss 和 Anna npc Tom", t="Boss anna x TOM2") == ["BOSS", "NPC", "anna"]


def review(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "candidates": make([("1", "甲", "a", ["x"]), ("2", "乙", "b", ["y"]), ("3", "丙", "c", ["y"])], "id string, zh string, raw_vi string, tags array<string>"), "edits": make([("1", "A"), ("2", "B"), ("3", "C")], "id string, vi string"),
        "approved": make([("1", "甲", "A", "approved"), ("2", "乙", "B", "approved")], "id string, zh string, vi string, status string"), "locked": make([("丁",)], "zh string"),
    }


def test_review_rules_hold(spark):
    V.require(review(spark), V.review_rules(size=3))
    assert V.checked(review(spark), V.review_rules(size=3)).count() == 16
    with pytest.raises(ValueError, match="size is 4"):
        V.require(review(spark), V.review_rules(size=4))


def rows_added(name, *row):
    return lambda tables: {**tables, name: tables[name].unionByName(tables[name].sparkSession.createDataFrame([row], tables[name].schema))}


BREAKS = [
    ("unique id", rows_added("candidates", "1", "戊", "", ["x"])), ("unique zh", rows_added("candidates", "9", "甲", "", ["x"])), ("candidates: unique id", rows_added("candidates", None, "己", "", ["x"])), ("has tags", rows_added("candidates", "9", "戊", "", [])), ("has tags", rows_added("candidates", "9", "戊", "", None)),
    ("edits: unique id", rows_added("edits", "1", "A")), ("form filled", rows_added("edits", "3", " ")), ("edits are of candidates", rows_added("edits", "7", "x")), ("approved: unique id", rows_added("approved", "1", "丙", "A", "approved")), ("approved: unique zh", rows_added("approved", "3", "甲", "C", "approved")),
    ("leftover script", rows_added("approved", "3", "丙", "C 字", "approved")), ("status", rows_added("approved", "3", "丙", "C", "pending")), ("sources unchanged", rows_added("approved", "3", "庚", "C", "approved")), ("forms are the edits'", rows_added("approved", "3", "丙", "D", "approved")),
    ("nothing locked is approved", rows_added("locked", "甲")), ("locked: unique zh", rows_added("locked", "丁")),
]


def test_each_invariant_broken_once(spark):
    rules = V.review_rules()
    for name, change in BREAKS:
        with pytest.raises(ValueError, match=name):
            V.require(change(review(spark)), rules)
    with pytest.raises(ValueError):
        V.require({}, rules)


def replay_tables(spark, booster):
    make = lambda rows: spark.createDataFrame(rows, "zh string, vi string")
    return make([("史一", "Hắn đi."), ("史一", "Hắn đi."), ("史二", "Tôi đi."), ("金", "Hắn."), (None, "x"), ("史三", None)]), make(booster), make([("金", "g")]), make([("锁", "l")])


def test_strict_replay(spark):
    booster = [(f"{o}{s}走{i}", f"{t} đi {i}.") for s, t in V.SUBJECTS.items() for i in range(5) for o in ("", "此时，")] + [("锁", "x"), ("它走", "nó đi."), ("他停", "Cậu đi.")]
    out = V.strict_replay(*replay_tables(spark, booster), F.lit(True), per_subject=4).collect()
    kinds = [r["source_type"] for r in out]
    assert kinds.count("historical_strict") == 1 and all(kinds.count(f"register_booster_{t}") == 4 for t in V.SUBJECTS.values()) and len(out) == 13
    assert {r["zh"] for r in out}.isdisjoint({"金", "锁", "它走", "他停", "史二"})
    assert one(spark, V.subject_of(F.col("t")), t="此时，她皱起眉头。") == "她" and one(spark, V.subject_of(F.col("t")), t="Lúc này") is None
    with pytest.raises(ValueError, match="12 of"):
        V.strict_replay(*replay_tables(spark, booster), F.lit(True), per_subject=12)
    with pytest.raises(ValueError, match="unique zh"):
        V.strict_replay(*replay_tables(spark, [*booster, ("他走0", "hắn chạy.")]), F.lit(True), per_subject=10)


def test_sense_probe(spark):
    rows = [("高能", "peak", f"前方高能{i}", "x") for i in range(8)] + [("高能", "keep", "高能物理", "y"), ("挂机", "afk", "他挂机", "z")]
    make = lambda rows: spark.createDataFrame(rows, "term string, sense string, zh string, vi string")
    assert V.sense_probe(make(rows)).count() == 10
    for name, row in (("term in source", ("越塔", "a", "没有", "x")), ("target filled", ("越塔", "a", "越塔", " ")), ("unique zh", ("高能", "keep", "前方高能0", "x")), ("contrast", ("高能", "peak", "高能九", "x")), ("target filled", ("越塔", "a", "越塔", None))):
        with pytest.raises(ValueError, match=name):
            V.sense_probe(make([*rows, row]))


def test_record_window(spark):
    df = spark.createDataFrame([(2, [["c", "d"]]), (1, [["a", "b"], ["x"], ["e", "f"], ["g", "h"]]), (3, [["y", "z"]]), (0, None)], "id long, p array<array<string>>")
    got = [tuple(r) for r in V.record_window(df, ["id"], "p", 3, 3).orderBy("id", "nth").collect()]
    assert got == [(1, 0, "a", "b"), (1, 2, "e", "f"), (2, 0, "c", "d")]


def test_number_words_end_at_ascii_letters(spark):
    """Java took an accented letter for part of the word, the SQL doesn't."""
    from quillspark.plans.reviews import NUMBER

    df = spark.createDataFrame([("domiue no\u00f1cobo", True), ("no", True), ("nos", False), ("a 1", True), ("\u00e9pas.", True), ("_pas", False)], "t string, e boolean")
    assert df.where(F.col("t").rlike(NUMBER) != F.col("e")).count() == 0
