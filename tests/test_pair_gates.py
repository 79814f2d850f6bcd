"""Literal cases of every rule of the pair gates, and the recipes that rest on them."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.operators import corpus as C
from quillspark.operators import gates as G
from quillspark.operators import pair_gates as P
from quillspark.operators import queue as Q
from quillspark.operators import recipes

ZH, VI = "他走进了那间很大的屋子", "Hắn bước vào gian nhà rất lớn"


def verdicts(spark, rules, rows, extra="", some=G.first_reason):
    """rows: (source, target, ...) with the columns named in extra."""
    df = spark.createDataFrame(rows, "s string, t string" + extra)
    return [r["v"] for r in df.coalesce(1).select(some(rules).alias("v")).collect()]




def test_teacher_lines(spark):
    cases = {
        (ZH, VI): None, ("abc", VI): "empty_or_other_script", (ZH, "  "): "empty_or_other_script", (None, None): "empty_or_other_script", (ZH, VI + "走"): "script_leak", (ZH, VI + "�"): "mojibake", (ZH, VI + "‘"): "unbalanced_quotes",
        (ZH, VI + " mình"): "modern_register", (ZH + "求月票", VI): "author_note", (ZH, VI + " <tên>"): "placeholder", (ZH + "xiǎo", VI): "pinyin_in_source", (ZH + "se情", VI): "pinyin_in_source",
        (ZH + "12", VI + " 13"): "numbers", (ZH, "Ừ"): "length_ratio", (ZH, VI * 3): "length_ratio",
    }
    assert verdicts(spark, P.teacher_line_rules(F.col("s"), F.col("t")), list(cases)) == list(cases.values())


def test_teacher_rows(spark):
    meta = ("pro", "m-1", "stop", "strict_clean", 2, 2)
    swap = lambda i, v: (*meta[:i], v, *meta[i + 1 :])
    cases = [
        (("甲\n乙", "a\nb", meta), None), (("甲\n乙\n", "a\r\nb", meta), None), (("甲", "a", None), "missing_metadata"), (("甲\n乙", "a\nb", swap(0, "FLASH")), None), (("甲\n乙", "a\nb", swap(0, "x")), "tier_or_model"),
        (("甲\n乙", "a\nb", swap(1, None)), "tier_or_model"), (("甲\n乙", "a\nb", swap(2, "length")), "unfinished"), (("甲\n乙", None, meta), "missing_pair"), (("甲\n乙", "a", meta), "line_alignment"), (("甲\n乙", "a\nb", swap(5, 3)), "declared_counts"),
    ]
    kind = ", m struct<teacher_tier:string,model:string,finish_reason:string,quality_bucket:string,source_line_count:int,target_line_count:int>"
    assert verdicts(spark, P.teacher_row_rules(F.col("s"), F.col("t"), F.col("m"), "m-"), [c for c, _ in cases], kind) == [w for _, w in cases]


def test_replay_and_gold(spark):
    cases = [(ZH, VI, True), (ZH, VI + "“", False), ("“" + ZH, VI, False), (ZH, VI + " tôi", False), (ZH + "1", VI, False), ("abc", VI, False), (None, VI, False), (ZH, None, False)]
    df = spark.createDataFrame(cases, "s string, t string, w boolean").select(P.replay_ok(F.col("s"), F.col("t")).alias("v"), "w").collect()
    assert [r["v"] for r in df] == [r["w"] for r in df]
    gold = [(1, "甲", "a", "approved"), (2, "甲", "a", "approved"), (3, "甲", "b", "approved"), (4, "乙", "c走", "approved"), (5, "乙", "d", "approved"), (6, "丙", "", "approved"), (7, "丁", "e", None), (8, "乙", "d“", "approved")]
    names = "n int, source string, target string, status string"
    got = {r["n"]: r["reason"] for r in P.gold_reasons(spark.createDataFrame(gold, names), "n").collect()}
    assert got == {1: None, 2: "duplicate", 3: "conflict", 4: "structure", 5: None, 6: "missing_pair", 7: "status", 8: "structure"}
    assert P.checked_gold(spark.createDataFrame([gold[0], gold[4]], names), "n").count() == 2
    with pytest.raises(ValueError, match="row 2: duplicate"):
        P.checked_gold(spark.createDataFrame(gold, names), "n")
    with pytest.raises(ValueError, match="no approved"):
        P.checked_gold(spark.createDataFrame([], names), "n")


def test_gates_with_all_reasons(spark):
    cases = [(ZH, VI, []), (None, VI, ["missing_pair"]), ("abc", VI + "走", ["length_ratio", "script_in_target", "source_without_script"]), (ZH + "5%", VI + " 5", ["numbers"]), (ZH + "ZX123Q", VI + "“", ["numbers", "placeholder", "target_quotes"])]
    assert verdicts(spark, P.internal_rules(F.col("s"), F.col("t")), [c[:2] for c in cases], some=G.all_reasons) == [c[2] for c in cases]
    assert verdicts(spark, P.internal_rules(F.col("s"), F.col("t"), core=True), [c[:2] for c in cases], some=G.all_reasons) == [[], ["missing_pair"], ["script_in_target"], [], ["placeholder"]]
    cases = [(ZH, VI, False, []), (ZH, ZH, True, ["leakage", "script_leak", "source_copy"]), ("8:00 " + ZH, "8 00 " + VI, False, ["numbers"]), (ZH + "??", VI + " [MASK]", False, ["mojibake", "placeholder"]), ("走", "Đi", False, ["source_length"]), (None, None, False, ["length_ratio", "source_copy", "source_length", "source_without_script"])]
    assert verdicts(spark, P.candidate_rules(F.col("s"), F.col("t"), F.col("b")), [c[:3] for c in cases], ", b boolean", G.all_reasons) == [c[3] for c in cases]
    cases = [(ZH, VI, False, []), (ZH + "求票", VI + " **", True, ["advertisement", "leakage", "placeholder"]), ("走", "Đi" * 9, False, ["length_ratio", "source_length"])]
    assert verdicts(spark, P.pack_rules(F.col("s"), F.col("t"), F.col("b")), [c[:3] for c in cases], ", b boolean", G.all_reasons) == [c[3] for c in cases]
    cases = [(ZH, VI, []), ("走a b c d e f g", VI, ["source_language"]), (ZH, "Hắn 走 đi", ["target_language"]), (ZH, VI + " www.x", ["artifact"]), (ZH, VI + " [ad] 1", ["artifact", "numbers"]), (None, None, ["length_ratio", "source_language", "source_length", "target_language", "target_length"])]
    assert verdicts(spark, P.external_rules(F.col("s"), F.col("t")), [c[:2] for c in cases], some=G.all_reasons) == [c[2] for c in cases]
    cases = [(ZH, VI, False, 5, None), (ZH, VI, True, 5, "conflict"), (ZH, VI, False, 449, "too_many_tokens"), (ZH, VI + " Em", False, 5, "modern_register"), (ZH, VI + "\x00", False, 5, "replacement_or_null"), (None, VI, False, 5, "source_without_script")]
    assert verdicts(spark, P.literature_rules(F.col("s"), F.col("t"), F.col("b"), F.col("n")), [c[:4] for c in cases], ", b boolean, n int") == [c[4] for c in cases]


def test_lines_and_chapters(spark):
    chain = "他走，" * 30
    cases = [(chain, "Hắn đi, " * 20, True, True), (chain, "Hắn đi. " * 20, True, True), (chain + "。", "Hắn đi. " * 20, False, False), (ZH, VI, False, False), (None, None, False, False)]
    df = spark.createDataFrame(cases[:1] + cases[2:], "s string, t string, a boolean, b boolean").select(P.rhythm_wanted(F.col("s"), F.col("t")).alias("x"), P.teaches_bad_rhythm(F.col("s"), F.col("t")).alias("y"), "a", "b").collect()
    assert [(r["x"], r["y"]) for r in df] == [(r["a"], r["b"]) for r in df]
    use = [(ZH + "。", VI, True), (ZH, VI, False), (ZH + "。作者", VI, False), ("“" + ZH, VI, False), (None, None, False)]
    assert [r["v"] for r in spark.createDataFrame(use, "s string, t string, w boolean").select(P.usable(F.col("s"), F.col("t")).alias("v")).collect()] == [u[2] for u in use]
    chapters = {"Nàng cười. Cô ấy khóc": "conflict_female", "Nàng cười. “Cô ấy khóc”": None, "hắn và anh ta": "conflict_male", "anh em anh em": "endearments", "anh trai em gái anh ấy em": None, "": None, None: None}
    assert {r["t"]: r["v"] for r in spark.createDataFrame([(x,) for x in chapters], "t string").select("t", P.chapter_reason(F.col("t")).alias("v")).collect()} == chapters
    leaks = {"tôi đã đi": (True, True), "của tôi đã": (False, False), "“tôi đã đi” hắn nói": (False, False), "Hắn cười, mình cũng cười": (True, True), "cậu ngồi": (False, True), "anh ấy đi": (False, True), "bóng của mình": (False, False), None: (False, False)}
    got = spark.createDataFrame([(x,) for x in leaks], "t string").select("t", P.register_leak(F.col("t")).alias("a"), P.mined_leak(F.col("t")).alias("b")).collect()
    assert {r["t"]: (r["a"], r["b"]) for r in got} == leaks


def test_small_columns(spark):
    one = lambda c, **v: spark.range(1).select(*(F.lit(x).alias(k) for k, x in v.items())).select(c.alias("x")).first()["x"]
    assert one(P.misreadings(F.col("s"), F.col("t")), s="棒梗和一大爷", t="xoạ  trụ và Dượng") == ["wrong_person", "wrong_kinship"]
    assert one(P.source_key(F.col("s")), s="“你 好”，　吗？") == "你好吗"
    assert [one(P.occurrences(F.col("t"), F.col("s")), t="Kiếm 12 và kiếm 123, 12.", s=x) for x in ("kiếm", "12", "", "3")] == [2, 2, 0, 0]
    names = {"罗林·埃尔顿": True, "内力型·瞬身": False, "埃尔顿": True, "林埃尔顿": False, "埃尔": False, "埃尔顿大人": False, "": False}
    assert {k: one(P.looks_western(F.col("s"), "埃尔顿罗林", "林王"), s=k) for k in names} == names
    rows = [("三十年河东三十年河西", "Ba mươi năm ba mươi năm Hà Tây", False), ("他走了", "đi mãi đi mãi", True), ("他走了", "đi mãi", False), (None, "đi mãi đi mãi", False)]
    assert [r["v"] for r in spark.createDataFrame(rows, "s string, t string, w boolean").select(S.repeats_beyond(F.col("s"), F.col("t")).alias("v")).collect()] == [r[2] for r in rows]


def test_anchor_and_samples(spark):
    lines = spark.createDataFrame([(1, 1, ZH, VI), (1, 2, ZH, VI + "."), (2, 3, ZH + "。", VI), (3, 4, ZH + "，", VI), (1, 5, None, VI)], "c int, o int, source string, target string")
    kept = recipes.anchor_lines(lines, spark.createDataFrame([(1,), (3,), (3,)], "c int"), ["c"], "o")
    assert sorted(r["o"] for r in kept.collect()) == [1, 4]
    assert recipes.sample_free(lines, spark.createDataFrame([(1,), (None,)], "o int"), "o", 2, "x").count() == 2 and recipes.sample_free(lines, lines.select("o").limit(0), "o", 0, "x").count() == 5
    assert sorted(r["o"] for r in recipes.short_sources(lines, "source", "target", 9).collect()) == [1, 2, 3, 4]
    risks = recipes.sample_risks(spark.createDataFrame([(1, "甲**", "a"), (2, "甲求票", 'a"'), (3, "甲" * 21, "a"), (4, "甲", "tôi đã đi"), (5, "甲", "b")], "o int, s string, t string"), "o", "s", "t", 3).first()
    assert tuple(risks) == (3, 1, 1, 1, 1)
    best, summary = recipes.best_scored(spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.5), (4, None)], "i int, x double"), "x", 0.6, 5, ["i"])
    assert [r["i"] for r in best.collect()] == [1, 2] and summary.first()["median"] == 0.6


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "chapter", 10, "pending", None, None), (2, "chapter", 11, "pending", None, None), (3, "chapter", 12, "running", "w", None), (4, "metadata", None, "pending", None, None), (5, "chapter", 99, "pending", None, None)], "id int, type string, chapter_id int, status string, locked_by string, error string")
    chapters = spark.createDataFrame([(10, 1, None, None), (11, 2, None, None), (12, 1, "x", None)], "id int, novel_id int, content string, content_out string")
    novels, sources = spark.createDataFrame([(1, 1), (2, 2)], "id int, source_id int"), spark.createDataFrame([(1, False), (2, True)], "id int, enabled boolean")
    out = {r["id"]: r["status"] for r in Q.unfetchable_failed(jobs, chapters, novels, sources).collect()}
    assert out == {1: "failed", 2: "pending", 3: "running", 4: "pending", 5: "failed"}
    done = Q.finalized(jobs, chapters, spark.createDataFrame([(3, "w", 12, "new"), (1, "w", 10, "no"), (7, "w", 12, "no")], "job_id int, worker string, chapter_id int, content_out string"))
    assert {r["id"]: (r["status"], r["locked_by"]) for r in done["jobs"].collect()}[3] == ("done", None) and {r["id"]: r["content_out"] for r in done["chapters"].collect()} == {10: None, 11: None, 12: "new"}
    assert [tuple(r) for r in done["novels"].collect()] == [(1, 1)] and sorted(r["job_id"] for r in done["rejected"].collect()) == [1, 7]


def test_spaced_cover_equals_brute_force(spark):
    rng, kinds = random.Random(3), "abcd"
    rows = [(g, d, p, [k for k in kinds if rng.random() < 0.4]) for g, d, p in itertools.product("xy", range(4), range(60))]
    got = {(r["g"], r["pick"]): (r["d"], r["p"]) for r in C.greedy_cover_spaced(spark.createDataFrame(rows + rows[:9], "g string, d int, p int, k array<string>"), "g", "d", "p", "k", 12).collect()}
    for g in "xy":
        left, covered = [r for r in rows if r[0] == g], set()
        for n in range(12):
            r = min(left, key=lambda r: (-len(set(r[3]) - covered), -len(r[3]), r[1], r[2]))
            assert got[g, n + 1] == (r[1], r[2])
            covered |= set(r[3])
            left = [x for x in left if x[1] != r[1] or abs(x[2] - r[2]) > 8]


def test_corpus_gate_of_pairs_equals_a_loop(spark):
    from quillspark.plans import QUERIES
    from quillspark.plans.pairs import pairs
    from quillspark.plans.registry import Tables

    data, repeated, seen, want = "/root/testdata/sf0.001", re.compile(r"(?i)\b(\w+(?:\s+\w+){0,2})\s+\1\b"), set(), {}
    for r in sorted(pairs(Tables(spark, data)).collect(), key=lambda r: r["conv_id"] * 1000 + r["turn"]):
        s, t = r["s"], r["t"]
        most = max([s.count(s[i : i + n]) for n in (2, 3, 4) for i in range(len(s) - n + 1)], default=1)
        if not s or not t:
            reason = "missing"
        elif s in seen:
            reason = "duplicate"
        elif re.search("[一-鿿]", t):
            reason = "script_leak"
        elif len(s) >= 20 and not 2.0 <= len(t) / len(s) <= 4.5:
            reason = "length_ratio"
        else:
            reason = "repeats" if any(t.lower().count(g.lower()) > most for g in repeated.findall(t)) else None
        if reason is None:
            seen.add(s)
        want[r["conv_id"], r["turn"]] = reason
    got = {(r["conv_id"], r["turn"]): r["reason"] for r in QUERIES["gate_corpus_pairs"](spark, data).collect()}
    assert got == want and {"script_leak", "length_ratio", "duplicate", None} <= set(want.values())


def test_every_pair_has_a_score(spark):
    """pairs of odd conversations and of even turns had none."""
    from quillspark.plans import QUERIES
    from quillspark.plans.pairs import pairs
    from quillspark.plans.registry import Tables

    data = "/root/testdata/sf0.001"
    keys = lambda df: sorted((r["conv_id"], r["turn"]) for r in df.collect())
    assert keys(QUERIES["quality_score_pairs"](spark, data)) == keys(pairs(Tables(spark, data)))
