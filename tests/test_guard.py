"""Term guard: literals, brute force over random lines, both ways to find terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import termguard as G


def held(source, *terms):
    found = [{"term": t, "right": r, "approved": a, "n": source.count(t)} for t, r, a in terms if t in source]
    return sorted(found, key=lambda t: (not t["approved"], -len(t["term"]), t["term"]))


def test_codes():
    rare = list(G.codes("rare"))
    assert rare[:3] == ["JW", "JJ", "JZ"] and len(rare) == len(set(rare)) == 336 and set("".join(rare)) == set(G.RARE)
    assert next(G.codes("long")) == "ZXAAAQ" and next(G.codes("bracket")) == "⟦AAA⟧" and len(list(G.codes("long"))) == 1000


def test_protect_and_restore():
    zh = "睚眦戴上了冥想项链，睚眦冷笑一声。"
    coded, marks = G.protect(zh, held(zh, ("睚眦", "Nhai Tý", False), ("冥想项链", "Dây Chuyền Thiền Định", False)), "rare")
    assert "睚眦" not in coded and "冥想项链" not in coded and [m["n"] for m in marks] == [1, 2]
    spaced = coded
    for m in marks:
        spaced = spaced.replace(m["code"], " ".join(m["code"]), 1)
    out = G.restore(spaced, marks, "rare")
    assert out.count("Nhai Tý") == 2 and "Dây Chuyền Thiền Định" in out and not any(m["code"] in out for m in marks)
    assert G.restore(coded.replace(marks[1]["code"], "", 1), marks, "rare") is None
    assert G.protect("普通句子", [], "rare") == ("普通句子", [])
    both = "白银级BOSS吞噬"
    coded, marks = G.protect(both, held(both, ("白银级", "bạch ngân cấp", False), ("BOSS", "boss", False)), "rare")
    assert "bạch ngân cấp boss" in G.restore(coded, marks, "rare")
    # an approved short term goes before a longer one that isn't
    coded, marks = G.protect("睚眦必报", held("睚眦必报", ("睚眦必报", "Nhai Tí Tất Báo", False), ("睚眦", "Nhai Tý", True)), "long")
    assert [m["right"] for m in marks] == ["Nhai Tý"] and "必报" in coded
    assert G.protect("JJ a JW", held("JJ a JW", ("JJ", "x", True)), "rare")[1][0]["code"] == "JZ"  # codes of the source are left out
    assert G.protect("ab ZX", held("ab ZX", ("ab", "x", True), ("ZX", "y", False)), "long") == ("ab ZX", [])


def test_numbers():
    assert [t["term"] for t in G._own_numbers("82亿、5000、5%")] == ["5000", "5%"]
    assert G.numbers_kept("1比1000000，82亿，5%", "1-10000000, 800 triệu, 5") == ("1 trên 1000000, 800 triệu, 5%", True)
    assert G.numbers_kept("1 và 2", "3") == ("3", False) and G.occurrences_in("hơn 10000000 năm", "1000000") == 0
    zh = "丧尸001只，编号00。"
    for family in ("long", "rare", "bracket"):
        coded, marks = G.protect(zh, sorted([*G._own_numbers(zh), *held(zh, ("丧尸", "táng thi", False))], key=lambda t: G._priority(t["term"], t["approved"])), family)
        out = G.restore(coded, marks, family)
        assert "ZX" not in out and "⟦" not in out and "001" in out and "编号 00" in out


def replaced_in_turn(source, needed, family):
    free = (c for c in G.codes(family) if c not in source)
    text, marks = source, []
    for t, code in zip(needed, free, strict=False):
        if n := text.count(t["term"]):
            text = text.replace(t["term"], f" {code} ")
            marks.append((code, t["right"], n))
    return (source, []) if any(text.count(c) != n for c, _, n in marks) else (text, marks)


def test_protect_equals_replacing_in_turn():
    rng = random.Random(2)
    for _ in range(3000):
        source = "".join(rng.choices("ab c", k=rng.randrange(0, 40)))
        words = {"".join(rng.choices("abc", k=rng.randrange(2, 5))) for _ in range(8)}
        needed = held(source, *((w, w.upper(), rng.random() < 0.5) for w in words))
        text, marks = G.protect(source, needed, "bracket")
        assert (text, [tuple(m.values()) for m in marks]) == replaced_in_turn(source, needed, "bracket")
        assert G.restore(text, marks, "bracket") is not None


TERMS = [("林风", "Lâm Phong", True, None, 7), ("林风", "Lâm Phúng", False, None, 7), ("天山", "Thiên Sơn", False, "", None), ("天山", "Thiên San", False, None, 8), ("风", "gió", True, None, None), ("山门", "cổng", False, "nghi sai", None), (" 大山 ", "núi", None, None, None), ("空空", "", True, None, None)]


@pytest.mark.parametrize("most", [100, 1])
def test_held_terms_by_automaton_and_by_join(spark, most):
    terms = spark.createDataFrame(TERMS, "term string, right string, approved boolean, note string, g long")
    lines = spark.createDataFrame([(1, 7, "林风上天山，林风"), (2, 8, "天山大山林风"), (3, 7, None), (4, 7, ""), (5, None, "天山山门大山")], "id long, g long, s string")
    got = {r["id"]: [tuple(h) for h in r["held"]] for r in G.with_held_terms(lines, terms, "s", "g", ["id"], most).collect()}
    assert got == {1: [("林风", "Lâm Phong", True, 2), ("天山", "Thiên Sơn", False, 1)], 2: [("大山", "núi", False, 1), ("天山", "Thiên San", False, 1)], 3: [], 4: [], 5: [("大山", "núi", False, 1), ("天山", "Thiên Sơn", False, 1)]}


def test_guarded_tries_families_in_turn(spark):
    rows = [(0, "睚眦来了"), (1, "睚眦来了"), (2, "睚眦来了"), (3, "睚眦来了"), (4, "睚眦"), (5, "没有"), (6, "12 和 34"), (7, None), (8, "睚眦 项链")]
    terms = spark.createDataFrame([("睚眦", "Nhai Tý", True, None), ("项链", "dây", False, None)], "term string, right string, approved boolean, note string")

    def translate(c):
        id_ = F.col("id")
        plain = F.when(id_ == 4, F.replace(c, F.lit("睚眦"), F.lit("nhai tý"))).when(id_ == 6, F.regexp_replace(c, "^12", "")).otherwise(c)
        plain = F.when(id_.isin(1, 2, 3), F.replace(plain, F.lit("AAQ"), F.lit("AQ"))).otherwise(plain)
        plain = F.when(id_.isin(2, 3), F.replace(plain, F.lit("JW"), F.lit("J"))).otherwise(plain)
        plain = F.when(id_ == 8, F.regexp_replace(plain, "AABQ|JJ|AAB", "")).otherwise(plain)  # the second code never comes back
        return F.when(id_ == 3, F.regexp_replace(plain, "[⟦⟧]", "")).otherwise(plain)

    out = G.guarded(G.with_held_terms(spark.createDataFrame(rows, "id long, s string"), terms, "s"), "s", translate)
    got = {r["id"]: (r["guarded"], r["way"], r["lacks"]) for r in out.collect()}
    assert got[0] == ("Nhai Tý 来了", 1, 1) and got[1] == ("Nhai Tý 来了", 2, 1) and got[2] == ("Nhai Tý 来了", 3, 1) and got[3] == ("睚眦来了", 0, 1)
    assert got[4] == ("nhai tý", 0, 0) and got[5] == ("没有", 0, 0) and got[6] == ("12 和 34", 1, 0) or got[6][1] == 1
    assert got[7] == (None, None, None) and got[8] == ("Nhai Tý 项链", 4, 2)


def test_guarded_texts_keep_their_lines(spark):
    docs = spark.createDataFrame([(1, "睚眦\n\n好 睚眦"), (2, None), (3, "")], "id long, t string")
    terms = spark.createDataFrame([("睚眦", "Nhai Tý", True)], "term string, right string, approved boolean")
    got = {r["id"]: r["guarded"] for r in G.guarded_texts(docs, "id", "t", terms, lambda c: c).collect()}
    assert got == {1: "Nhai Tý\n\n好 Nhai Tý", 2: None, 3: ""}


def test_covered_terms_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(9)}
    texts = ["".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(200)]

    def brute(text):
        taken, out = [False] * len(text), []
        for w in sorted(words, key=lambda w: (-len(w), w)):
            for at in range(len(text) - len(w) + 1):
                if text.startswith(w, at) and not any(taken[at : at + len(w)]):
                    taken[at : at + len(w)] = [True] * len(w)
                    out.append((at, w))
        return sorted(out)

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string")
    got = {r["id"]: [tuple(c) for c in r["covered"]] for r in G.covered_terms(df, spark.createDataFrame([(w,) for w in words], "term string"), "t").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} | {len(texts): []}
    with pytest.raises(ValueError):
        G.covered_terms(df, spark.createDataFrame([("a",), ("b",)], "term string"), "t", most=1)


def test_restore_compiles_no_pattern_of_a_line(monkeypatch):
    """a pattern a code took most of the time."""
    made, compiled = [], re._compiler.compile
    monkeypatch.setattr(re._compiler, "compile", lambda *a, **k: made.append(a) or compiled(*a, **k))
    for family in ("long", "rare", "bracket"):
        words = [f"w{i:02}w" for i in range(40)]
        coded, marks = G.protect(" ".join(words), held(" ".join(words), *((w, w.upper(), True) for w in words)), family)
        re.purge()
        made.clear()
        assert G.restore(coded, marks, family) == " ".join(w.upper() for w in words) and len(made) <= 2


def test_codes_that_overlap_or_stand_apart():
    marks = lambda **n: [{"code": c, "right": c.lower(), "n": k} for c, k in n.items()]
    assert G.restore("J W Z a", marks(JWZ=1), "rare") == "jwz a" and G.restore("J W Z", marks(JW=1, JWZ=1), "rare") == "jwz"
    assert G.restore("JWZ", marks(JW=1), "rare") is None and G.restore("ZXA ZXQ BCQ", marks(ZXAZXQ=1), "long") == "zxazxq BCQ"
    assert G.restore("ZXA ZXQ BCQ", marks(ZXAZXQ=1, ZXQBCQ=1), "long") == "zxazxq BCQ" and G.restore("1ZXAAAQ ZX AAAQ", marks(ZXAAAQ=1), "long") == "1ZXAAAQ zxaaaq"


def test_needed_terms_are_found_once_a_line(spark):
    """the filter on what is lacking ran the search and the comparison a second time."""
    from quillspark.plans import QUERIES

    plan = QUERIES["protect_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3


def test_lists_of_terms_are_read_field_by_field(spark, monkeypatch):
    """to_pylist() of lists of structs took more time than the search itself; lines carried their terms through every try."""
    import pyarrow as pa

    rows = [[{"term": "ab", "right": None, "approved": True, "n": 1}, {"term": "c", "right": "x", "approved": None, "n": 2}], [], None, [{"term": "d", "right": "y", "approved": False, "n": 3}]]
    lists = pa.array(rows, G._HELD)
    assert [G._dicts(lists.slice(i)) for i in range(5)] == [rows[i:] for i in range(5)] and G._dicts(pa.array([None], G._HELD)) == [None]
    written, put = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df: written.append(df.columns) or put(df))
    terms = spark.createDataFrame([("睚眦", "Nhai Tý", True)], "term string, right string, approved boolean")
    held = G.with_held_terms(spark.createDataFrame([(1, "睚眦来了", "x"), (2, None, "y")], "id long, s string, other string"), terms, "s")
    out = G.guarded(held, "s", lambda c: c, keep=["id"])
    assert {r["id"]: (r["guarded"], r["way"]) for r in out.collect()} == {1: ("Nhai Tý 来了", 1), 2: (None, None)}
    assert out.columns == ["id", "guarded", "way", "lacks"] and all(set(c) <= {"id", "s", "_l", "_t"} for c in written), written


def test_codes_that_start_with_their_letter_are_the_same():
    """patterns lead with a code's first letter; the same codes as with a look behind every place."""
    rng = random.Random(9)
    for family, first, shapes in (("long", "ZX", [["Z", "X", *3 * ["[A-Z]"], "Q"]]), ("rare", G.RARE, [n * [f"[{G.RARE}]"] for n in (4, 3, 2)]), ("bracket", "⟦⟧", [["⟦", *3 * ["[A-Z]"], "⟧"]])):
        plain = [re.compile(rf"(?<![{re.escape(G.BESIDE[family])}])(?=({G._GAP.join(x)})(?![{re.escape(G.BESIDE[family])}]))") for x in shapes]
        for _ in range(4000):
            raw = "".join(rng.choices([*first, *first, "Q", "A", "X", " ", "\t", "1", "é"], k=rng.randrange(0, 14)))
            want = sorted(((m.start(), m.end(1), re.sub("[ \t]", "", m[1])) for p in plain for m in p.finditer(raw)), key=lambda x: (x[0], -x[1]))
            assert list(G.codes_in(raw, family)) == want, raw
    assert G.numbers_kept("no numbers", "none") == ("none", True) and G.numbers_kept("一２", "３") == ("２", True)
