"""Small literals: cleaning, gates, glossary, game, HTML, windows and upserts."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import game, glossary
from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import frames as R
from quillspark.functions import lint as L
from quillspark.functions import style as S
from quillspark.operators import gates as G
from quillspark.operators import html as H


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    cases = {
        "脸上『露』出神『色』": "脸上露出神色", "〖测〗试": "测试", "  không có dấu  ": "không có dấu", "⦅一⦆⦅下⦆": "一下", "‹是›": "是", "“哼！”": "“哼！”", "【提示】": "【提示】",
        "〈叮！〉": "【叮！】", "〈机缘暴击系统绑定中……〉": "【机缘暴击系统绑定中……】", "脸〈色〉苍白": "脸色苍白", "“回房间休息吧“，她说道！": "“回房间休息吧”，她说道！", "“甲。”“乙。”": "“甲。”“乙。”",
        "厅下都在议论！/\n( )": "厅下都在议论！", "埃尔顿*希里说道。": "埃尔顿希里说道。", "好。!!别担心。": "好。别担心。", "图纸*1": "图纸*1", "\u200b测试\ufeff": "测试", "": "",
    }
    assert {x: X.clean_source_text(x) for x in cases} == cases
    assert one(spark, X.clean_source(F.col("t")), t="⦅一⦆⦅下⦆") == "一下"
    assert one(spark, X.collapse_repeats(F.col("t")), t="cuối câu " * 300 + "hết") == "cuối câu hết"
    assert one(spark, S.narrator_terms(F.col("t")), t="Chúng ta đi, người ta nói, ta về. Hắn nghe anh ta. “Ta đây”") == ["ta", "hắn", "anh ta"]
    assert X.balance_quotes_text("“甲“乙\n“丙") == "“甲”乙\n“丙"
    assert one(spark, X.trim_unicode(F.col("t")), t="　 a b　") == "a b"
    assert one(spark, X.clean_output(F.col("t")), t="```\ncuối câu cuối câu cuối câu **x**\nGLOSSARY_JSON: []") == "cuối câu x"
    assert one(spark, X.str_count(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, X.truncate_at_sentence(F.col("t"), 8), t="One. Two three") == "One."
    assert one(spark, X.chunk_pack(F.split("t", "\n"), 5), t="ab\ncd\nefghijk\nl") == ["ab\ncd", "efghijk", "l"]
    assert X.repair_json_text('{"a": "he said "hi" ok", "b": [1, 2') == '{"a": "he said \\"hi\\" ok", "b": [1, 2]}'
    assert X.split_sentences_text("一。“二。三。”四！五") == ["一。", "“二。三。”四！", "五"]
    assert X.similarity_texts("a b c", "ABC") == 1.0
    df = spark.createDataFrame([("Ａb c!", "X"), (None, None)], "t string, a string")
    assert [r.k for r in df.select(X.dedup_key(F.col("t"), F.col("a")).alias("k")).collect()] == ["abc|x", "|"]


def test_gates(spark):
    rows = [(0, "aaaa"), (1, ""), (2, "aaaa"), (3, "b!"), (4, "b!"), (5, None)]
    df = spark.createDataFrame(rows, "o int, t string")
    out = G.with_seen(df, "t", "o", F.coalesce(F.trim("t"), F.lit("")) == "", F.when(F.col("t").contains("!"), "loud")).orderBy("o").collect()
    assert [r.reason for r in out] == [None, "missing", "duplicate", "loud", "loud", "missing"]
    pair = spark.createDataFrame([("他说3。", "Hắn nói 3."), ("他说3。", "Hắn nói 4."), ("abc", "x"), ("他", "他")], "s string, t string")
    assert [r.r for r in pair.select(G.first_reason(G.strict_rules(F.col("s"), F.col("t"))).alias("r")).collect()] == [None, "numbers", "source_script", "script_leak"]
    doc = spark.createDataFrame([("a\n" * 12, "a"), ("x", ""), ("a" * 500, "b" * 400)], "s string, t string")
    assert [r.r for r in doc.select(G.first_reason(G.document_rules(F.col("s"), F.col("t"))).alias("r")).collect()] == ["too_short", "empty", None]


def test_glossary(spark):
    readings = {"林": ["lâm"], "风": ["phong", "phúng"]}
    column = F.create_map(*[x for k, v in readings.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    df = spark.createDataFrame([("林风",), ("林x",), ("",)], "t string").withColumn("m", column)
    assert [r.h for r in df.select(glossary.han_viet(F.col("t"), F.col("m")).alias("h")).collect()] == ["Lâm Phong", None, None]
    assert glossary.reading_candidates("林风", readings) == ["Lâm Phong", "Lâm Phúng"] and glossary.reading_candidates("林x", readings) == []
    done, ok = glossary.translate_guarded("林风 goes", {"林风": "Lâm Phong"}, lambda s: s.replace("goes", "đi"))
    assert ok and done == "Lâm Phong đi"
    lost, ok = glossary.translate_guarded("林风 goes", {"林风": "Lâm Phong"}, lambda s: "nothing")
    assert not ok and lost == "nothing"
    terms = spark.createDataFrame([(1, "林风", None), (None, "剑", None), (None, "天山", None), (2, "天山", "doubtful")], "g int, term string, note string")
    docs = spark.createDataFrame([(1, 7, "林风在天山"), (2, 8, "天山"), (3, 9, "山")], "g int, d int, t string")
    assert sorted((r.d, r.term) for r in glossary.eligible_terms(terms, docs, "g", "t").collect()) == [(7, "天山"), (7, "林风"), (8, "天山")]
    assert glossary.repair_numbers("3比5", "4 trên 6") == "3 trên 5" and glossary.repair_numbers("3万", "4") == "4"


def test_game(spark):
    got = spark.createDataFrame([(p,) for p in (0, 5, 10, 315, 325)], "p int").select(game.tier_of(F.col("p")).alias("t"), game.tier_multiplier(F.col("p")).alias("m")).collect()
    assert [r.t for r in got] == [0, 1, 1, 6, 6] and [r.m for r in got] == [1.0, 2.0, 2.5, 7.0, 8.0]
    bucket = R.bucket_of_hash(F.md5(F.concat_ws(":", F.lit("11111111-2222-3333-4444-555555555555"), F.lit("7"), F.col("id").cast("string"))), 6, 100) < 50
    assert [r.g for r in spark.range(1, 11).select("id", bucket.alias("g")).orderBy("id").collect()] == [c == "T" for c in "TFTTTFFTFT"]


def test_html(spark):
    page = '<html><div id="c"><p>One &amp; two</p><div class="ad">x</div><br>Three<script>var a="</p>"</script></div><p>out</p></html>'
    assert H.inside(page, "id", "c").endswith("</script>") and H.inside(page, "class", "ad") == "x" and H.inside(page, "id", "none") == ""
    assert one(spark, H.to_text(F.col("h")), h=page) == "One & two\nx\nThreeout"
    assert H.skeleton_of("<p>short</p><p>this is a much longer text</p>") == "<p></p><p>[26]</p>"
    pages = spark.createDataFrame([("u/1.html", "a"), ("u/1_2.html", "b"), ("u/1_4.html", "d")], "url string, t string")
    assert H.joined_pages(pages, "url", "t").first()["text"] == "a\nb"


def test_frames(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("b", 1, "z")], "g string, i int, t string")
    assert sorted((r.g, r.i, r.context) for r in R.context_before(df, ["g"], "i", "t", 2).collect()) == [("a", 1, ""), ("a", 3, "x"), ("b", 1, "")]
    assert sorted(tuple(r) for r in R.islands(df.where("i <> 2"), ["g"], "i").collect()) == [("a", 1, 1, 1), ("a", 3, 3, 1), ("b", 1, 1, 1)]
    assert R.mix_ratio(10, 100, 0.5) == (10, 10) and R.mix_ratio(10, 100, 0.5, cap=8) == (4, 4)
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(r.k for r in R.only_changed(new, old, "k", ["v"]).collect()) == [2, 3]
    assert sorted(tuple(r) for r in R.upsert(old, new.where("k = 2"), "k").collect()) == [(1, "a"), (2, "b")]
    train, held = C.holdout(spark.range(100).withColumnRenamed("id", "k"), "k", F.sha2(F.col("k").cast("string"), 256), 50)
    assert (train.count(), held.count()) == (95, 5)


def test_sources_and_sinks(spark, tmp_path):
    from quillspark.sources import readers as S
    from quillspark.sources import sinks as K

    (tmp_path / "a.jsonl").write_text('{"zh": "甲", "vi": "a"}\n\nbad\n{"zh": "乙", "vi": "b"}\n', encoding="utf-8")
    good, bad = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "zh string, vi string")
    assert sorted(r.zh for r in good.collect()) == ["乙", "甲"] and [r.line for r in bad.collect()] == ["bad"]
    (tmp_path / "r.tsv").write_text("# head\n林\tlâm|lam\n风\tphong\n", encoding="utf-8")
    assert {r.key: r["values"] for r in S.read_multi_tsv(spark, str(tmp_path / "r.tsv")).collect()} == {"林": ["lâm", "lam"], "风": ["phong"]}
    (tmp_path / "p.txt").write_text("title: T\n--- SOURCE ---\na\nb\n--- TARGET ---\nc\n", encoding="utf-8")
    row = S.read_text_pairs(spark, str(tmp_path / "p.txt"), "SOURCE", "TARGET").first()
    assert (row.source, row.target, row.header["title"]) == ("a\nb", "c", "T")
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.jsonl", '{"a": 1}\n{"a": 2}\n')
        z.writestr("readme.txt", "no")
    assert sorted(r.line for r in S.read_zip_lines(spark, str(tmp_path / "z.zip")).collect()) == ['{"a": 1}', '{"a": 2}']
    done = K.write_pack({"one": spark.range(3), "two": spark.range(5)}, str(tmp_path / "pack"), {"one": 3})
    assert {r.shard: r.n_rows for r in done.collect()} == {"one": 3, "two": 5}
    with pytest.raises(ValueError, match="one"):
        K.write_pack({"one": spark.range(3)}, str(tmp_path / "pack2"), {"one": 4})
    rows = spark.createDataFrame([(1, "a", True), (2, None, True), (3, "c", False)], "id int, text string, done boolean")
    new, nulled = K.offload(rows, spark.createDataFrame([], "id int, text string"), "id", "text", "done")
    assert [tuple(r) for r in new.collect()] == [(1, "a")] and {r.id: r.text for r in nulled.collect()} == {1: None, 2: None, 3: "c"}


def test_streaming(spark, tmp_path):
    from quillspark.streaming import events as E

    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = E.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == spark.read.parquet(str(src)).count()
    q = E.health(stream).writeStream.format("memory").queryName("health").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("health").count() > 0


def test_style(spark):
    from quillspark.functions import style as S

    df = spark.createDataFrame([("他笑了。", "Nàng cười."), ("她笑了。", "Hắn cười."), ("笑了。", "Hắn cười."), ("他们笑了。", "Cười.")], "s string, t string")
    got = df.select(S.fix_lead_gender(F.col("s"), F.col("t")).alias("f"), S.invents_subject(F.col("s"), F.col("t")).alias("i")).collect()
    assert [r.f for r in got] == ["Hắn cười.", "Nàng cười.", "Hắn cười.", "Cười."] and [r.i for r in got] == [False, False, True, False]
    best = spark.createDataFrame([("他说。", ["Tôi nói.", "Nói. Rồi.", "Nói. Xong."])], "s string, c array<string>")
    assert best.select(S.best_of(F.col("s"), F.col("c")).alias("b")).first()["b"] == "Nói. Rồi."
    types = spark.createDataFrame([("“好。”他说，“走。”",), ("他走了。",), ("开口说道，a，b，c。",)], "s string").select(S.sentence_types(F.col("s")).alias("t")).collect()
    assert [r.t for r in types] == [["dialogue", "several_turns"], ["narration", "pronoun_subject"], ["narration", "dropped_subject", "comma_chain"]]
    assert S.repeat_budget_of("三十年河东三十年河西") == 2 and S.repeat_budget_of("") == 1
    assert S.join_parts(["Hắn đi,", "Và nói.", "Nàng cười"]) == "Hắn đi, và nói. Nàng cười"
    assert S.without_echo("tail of the earlier text here", "tail of the earlier text\nnew") == "new"
    assert S.apply_fixes("aaaa bbbb", [("aaaa", "cccc"), ("bbbb", "b"), ("zz", "y")]) == ("cccc bbbb", 1)
    rules = S.rhythm_rules(F.col("s"), F.col("t"), F.lit("x"))
    rows = spark.createDataFrame([("他，走，了。", "Hắn đi rồi. Nàng  ở lại."), ("a" * 40 + "。", "B" * 51 + ". " + "C" * 51 + ".")], "s string, t string")
    assert [r.r for r in rows.select(G.first_reason(rules).alias("r")).collect()] == ["double_space", None]


def test_queue(spark):
    from quillspark.operators import queue as Q

    jobs = spark.createDataFrame([(1, "chapter", 1, 10, "pending", 5, 1), (2, "chapter", 1, 11, "pending", 1, 2), (3, "chapter", 2, 20, "pending", 5, 3), (4, "chapter", 2, 21, "running", 5, 3), (5, "metadata", 3, None, "pending", 9, 1), (6, "chapter", 3, 30, "pending", 1, 1)], "id int, type string, novel_id int, chapter_id int, status string, priority int, created_at int")
    chapters = spark.createDataFrame([(10, 1, 1, "c", "queued"), (11, 1, 2, "c", "queued"), (20, 2, 1, "c", "queued"), (21, 2, 2, "c", "queued"), (30, 3, 1, "c", "queued"), (31, 3, 2, None, "none"), (40, 4, 1, "c", "queued")], "id int, novel_id int, chapter_index int, content string, translation_status string")
    assert [r.id for r in Q.claimable(jobs, chapters).collect()] == [1, 5]
    lost, idle = Q.orphans(chapters, jobs)
    assert [r.id for r in lost.collect()] == [40] and idle.count() == 0
    plan = {r.chapter_index: r.action for r in Q.translation_request(chapters, jobs, 3, 1, 3).collect()}
    assert plan == {1: "leave", 2: "queue", 3: "create"}
    states = spark.createDataFrame([(1, "running", 3, 5), (2, "running", 1, 5), (3, "running", 1, 50), (4, "done", 9, 1)], "id int, status string, attempts int, locked_at int")
    assert [r.status for r in Q.requeued(states, F.lit(10)).orderBy("id").collect()] == ["failed", "pending", "running", "done"]
    done = Q.finished(states.withColumn("max_attempts", F.lit(3)), spark.createDataFrame([(1, False, False), (2, False, True), (3, True, False)], "id int, ok boolean, deferred boolean"))
    assert [(r.status, r.attempts) for r in done.orderBy("id").collect()] == [("failed", 3), ("pending", 0), ("done", 1), ("done", 9)]
    ticks = spark.createDataFrame([("a", i, i == 2) for i in range(8)] + [("b", 1, True)], "source string, tick int, ok boolean")
    assert sorted(tuple(r) for r in Q.source_status(ticks).collect()) == [("a", 5, True), ("b", 0, False)]
    toc = lambda rows: spark.createDataFrame(rows, "novel_id int, chapter_index int, source_chapter_id string")
    assert sorted(tuple(r) for r in Q.toc_changes(toc([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]), toc([(1, 1, "a"), (1, 2, "x"), (1, 4, "d")])).collect()) == [(1, 2, "remapped"), (1, 3, "gone"), (1, 4, "added")]


def test_evaluation(spark):
    from quillspark.operators import evaluation as V

    df = spark.createDataFrame([("m", "他说3。", "x", "Hắn nói 3.", "Hắn nói 3."), ("m", "笑了4。", "她", "Hắn cười 5.", "cười 4.")], "model string, source string, context string, output string, reference string")
    row = V.summary(V.scored(df), "model").first()
    assert (row.n, row.digit_fail, row.quote_fail, row.structural_defects) == (2, 1, 0, 1) and 0.5 < row.similarity < 1
    free = V.reference_free(df).first()
    assert (free.lines, free.subject_dropped, free.invented, free.invented_wrong_gender, free.gender_known, free.gender_wrong) == (2, 1, 1, 1, 1, 0)


def test_recipes(spark):
    from quillspark.operators import recipes as P

    lines = spark.createDataFrame([(["他来了3。", "装备BOSS掉了。", "天黑。"], ["Hắn đến 3.", "Rơi BOSS rồi.", "Trời tối."], "pro"), (["天黑。"], ["Trời đã tối."], "flash"), (["a"], ["b", "c"], "x")], "zh_lines array<string>, vi_lines array<string>, teacher_tier string")
    flat = P.aligned_lines(lines, "zh_lines", "vi_lines", "teacher_tier")
    assert flat.count() == 4
    none = spark.createDataFrame([], "h string")
    got = P.teacher_candidates(flat, none, 1, 1)
    assert {(r.domain, r.source) for r in got.collect()} == {("general", "他来了3。"), ("game", "装备BOSS掉了。")}
    with pytest.raises(ValueError, match="general"):
        P.teacher_candidates(flat, none, 2, 1)
    pairs = P.context_pairs(flat.where("teacher_tier = 'pro'"), ["teacher_tier"], 1).orderBy("pos").collect()
    assert [r.input for r in pairs] == ["他来了3。", "他来了3。⟪ctx⟫装备BOSS掉了。", "装备BOSS掉了。⟪ctx⟫天黑。"]
    gate = P.corpus_gate(spark.createDataFrame([(0, "甲", "a"), (1, "甲", "b"), (2, "乙", "乙"), (3, "", "c")], "o int, source string, target string"), "o")
    assert {r.reason: r.n for r in gate["reasons"].collect()} == {"duplicate": 1, "script_leak": 1, "missing": 1} and gate["approved"].count() == 1
    rows = spark.createDataFrame([("s%d" % i, "t", "a" if i % 2 else "b") for i in range(20)] + [("s1", "u", "a")], "source string, target string, tier string")
    assert {r.tier: r["count"] for r in P.replay_quota(rows, {"a": 3, "b": 50}).groupBy("tier").count().collect()} == {"a": 3, "b": 10}
    pool = spark.createDataFrame([(f"k{i}", "d") for i in range(10)], "k string, d string")
    assert {r.batch: r["count"] for r in P.review_batches(pool, pool.limit(1), "k", "d", 4, 2).groupBy("batch").count().collect()} == {0: 4, 1: 4}
    with pytest.raises(ValueError, match="approved"):
        P.merge_approved(pool, pool.limit(2), "k")
    assert P.merge_approved(pool, pool.limit(2), "k", "skip").count() == 10 and P.training_mix(pool.limit(2), pool, F.col("k"), 3).count() == 15


def test_terms(spark):
    from quillspark.operators import terms as W

    rows = spark.createDataFrame([("林风", " Lâm Phong ", "person", "Lâm Phong"), ("林风", "Lin Feng", "person", "Lâm Phong"), ("x", "y", "person", None), ("天山", "山", "place", "Thiên Sơn")], "term string, right string, kind string, reading string")
    assert [(r.right, r.note) for r in W.prepared(rows).collect()] == [("Lâm Phong", None), ("Lin Feng", "doubtful")]
    assert [r.s for r in rows.select(W.safe_pending(F.col("kind"), F.trim("right"), F.col("reading")).alias("s")).collect()][:2] == [True, True]
    stored = spark.createDataFrame([(1, "甲", "Lin", "Lâm"), (1, "乙", None, "Lin Gia"), (2, "丙", None, "Lin Gia")], "g int, term string, wrong string, right string")
    assert [(r.term, r.wrong, r.right) for r in W.healed(stored, "g").collect()] == [("乙", "Lin Gia", "Lâm Gia")]
    assert W.overrides(stored.select("term", "right"), spark.createDataFrame([("甲", "Lâm"), ("乙", "Nhà Lâm")], "term string, right string")).first()["right"] == "Nhà Lâm"
    todo = spark.createDataFrame([("a", "Lam Phong", None), ("b", "Lâm Phong", "doubtful"), ("c", "Something", None), ("d", "", None)], "term string, right string, note string").withColumns({"approved": F.lit(False), "created_by": F.lit(None).cast("string")})
    assert {r.term: r.action for r in W.actions(todo, F.lit("Lâm Phong")).collect()} == {"a": "fix", "b": "clear", "c": "flag", "d": "drop"}


def test_game_states(spark):
    df = spark.createDataFrame([(1, 100, 50, 0.5, 0.4, 0), (1, 100, 50, 0.5, 0.6, 0), (1, 10, 50, 0.5, 0.4, 0)], "s int, p int, n int, c double, d double, f int")
    stage, points = game.advanced(*(F.col(c) for c in "spncdf"))
    assert [tuple(r) for r in df.select(stage.alias("a"), points.alias("b")).collect()] == [(2, 50), (1, 70), (1, 10)]
    days = spark.sql("select 4 as s, date'2024-01-02' as l, t from values (date'2024-01-02'), (date'2024-01-03'), (date'2024-01-05') as v(t)")
    assert sorted(tuple(r) for r in days.select(game.live_streak(F.col("s"), F.col("l"), F.col("t")).alias("a"), game.next_streak(F.col("s"), F.col("l"), F.col("t")).alias("b")).collect()) == [(0, 1), (4, 4), (4, 5)]


def test_repairs(spark):
    from quillspark.functions import repair as P

    assert one(spark, P.rhythm(F.col("t")), t="Hắn đi ,.. rồi!!  nàng ở  lại . xong...") == "Hắn đi, rồi! Nàng ở lại. Xong..."
    assert one(spark, P.register(F.col("t")), t="Cô ấy nói “cô ấy đi” rồi anh ta cười") == "Nàng nói “cô ấy đi” rồi hắn cười"
    assert one(spark, P.stock_phrases(F.col("t")), t="Trên thực tế hắn cười một cái, chẳng lẽ chẳng đi") == "Thật ra hắn bật cười, chẳng lẽ không đi"
    assert [one(spark, P.title(F.col("t")), t=x) for x in ("«Chương 12: tên mới»", "《甲》", "“Kiếm” bùng nổ", "“toàn bộ”", "Mẫn Diệt”！")] == ["Tên mới", "甲", "“Kiếm” bùng nổ", "Toàn bộ", "Mẫn Diệt!"]
    assert P.merged_paragraphs_text("A b. C d. E f. G.\n\nOne only") == ["A b. C d. E f. G.", "One only"]
    assert P.covered_terms_text("abcab", ["ab", "abc", "b"]) == [(0, "abc"), (3, "ab")]
    assert one(spark, P.genres(F.split("t", ","), {"玄幻": "Huyền huyễn"}), t="玄幻, Action,玄幻,都市") == ["Huyền huyễn", "Action"]
    assert one(spark, P.omitted_address(F.col("s"), F.col("t"), [("本王", ["bổn vương"]), ("朕", ["trẫm"])]), s="本王和朕", t="Bổn vương") == ["朕"]
    assert one(spark, P.without_junk_description(F.col("t")), t="简介：好书。小说推荐：别的") == "好书。"


def test_toc_order(spark):
    rows = [("g", 0, "9", "nine", False), ("g", 1, "8", "eight", False), ("g", 2, None, None, True), ("g", 3, "1", "one", False), ("g", 4, "2", "two", False), ("h", 0, "3", "late", False), ("h", 1, "1", "one", False), ("h", 2, "3", "three", False)]
    out = H.toc_order(spark.createDataFrame(rows, "g string, pos int, id string, title string, is_marker boolean"), "g").orderBy("g", "chapter_index").collect()
    assert [(r.g, r.id, r.title) for r in out] == [("g", "1", "one"), ("g", "2", "two"), ("g", "8", "eight"), ("g", "9", "nine"), ("h", "1", "one"), ("h", "3", "three")]


def test_contained_terms_of_one_character(spark):
    from quillspark.functions.glossary import contained

    terms = spark.createDataFrame([("王",), ("王氏",), ("x",), (None,)], "term string")
    texts = spark.createDataFrame([("王氏族",), ("王",), ("y",), ("",), (None,)], "text string")
    got = sorted((r["text"], r["term"]) for r in contained(terms, "term", texts, "text").collect())
    assert got == [("王", "王"), ("王氏族", "王"), ("王氏族", "王氏")]


def test_lint_warnings(spark):
    cases = {
        "Hắn cười một cái.": ["one_of_action"], "Họ tiến hành tấn công": ["carry_out"], "Đối với ta mà nói": ["as_for_x"], "**đậm**": ["markdown"], "An-đê-ri-an đến": ["hyphened_name"],
        "Anh đi rồi.": ["bare_address"], "Anh ta đi rồi.": [], "một đầu tiên": [], "một đầu trâu": ["head_counter"], "xiǎo": ["pinyin"], "còn 汉 tự": ["script_left"], "mệnhĐồ": ["glued_words"],
        "A!!!\nB": ["loud"], "chẳng chẳng chẳng chẳng": ["negations"], "hắn hắn hắn. Xong": ["repeated_pronoun"], "“Mình đã về”": ["self_in_speech"], "hắn y. hắn y.\nhắn y": ["mixed_narrator"], "": [], "Bình thường.": [],
    }
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], "t string").select("t", L.lint_warnings(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == cases | {None: None}


def test_row_numbers_of_many_rows(spark):
    from quillspark.sources.sinks import row_numbers

    rows = spark.range(1_500_000).select(F.xxhash64("id").alias("h"), F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(8)
    got = row_numbers(rows, "h").agg(F.count(F.lit(1)), F.countDistinct("rn"), F.min("rn"), F.max("rn")).first()
    assert tuple(got) == (1_500_000, 1_500_000, 1, 1_500_000)


def test_pages_stay_out_of_python(spark):
    """whole pages went to Python workers, 10,000 a batch, and several times over; now entities alone do."""
    import html as stdlib
    import random

    from quillspark.functions import text
    from quillspark.operators import html
    from quillspark.plans import QUERIES

    rng, parts = random.Random(5), ["<div>", "</div>", '<DIV class="content x">', '<div class="a content">', "<article>", "</article >", "<divx>", "</p>", "é", "&amp;", "&#65;", "&nosuch;", "&copy", "<", ">", '"', "\n", "</DIV>", '<p id="q">']
    pages = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(500)]
    chosen = [("class", "content"), ("tag", "article"), ("id", "q"), ("tag", "div")]
    df = spark.createDataFrame([(x,) for x in [*pages, None]], "h string")
    rows = df.select("h", *(html.balanced_block(k, v)(F.col("h")).alias(f"{k}-{v}") for k, v in chosen), text.unescape_html(F.col("h")).alias("u")).collect()
    for r in rows:
        assert list(r)[1:] == ([None] * 5 if r["h"] is None else [*(html.inside(r["h"], k, v) for k, v in chosen), stdlib.unescape(r["h"])])
    for name in ("html_balanced", "html_diagnose"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.split("\n") if "ArrowEvalPython [" in line]
        assert len(sent) == 1 and "run(regexp_extract_all(" in sent[0] and "run(html" not in sent[0]


def test_similarity_from_is_the_ratio(spark, monkeypatch):
    """F15, near_dup: pairs are settled by their longest common subsequence before blocks are matched; the ratios stay."""
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    from quillspark.functions import text as X

    rng, pairs = random.Random(4), [("", ""), ("a", ""), (" ", "\t"), ("Ab c", "aBC"), ("İx" * 9, "i̇x" * 9), (None, "a")]
    for n in (5, 26, 80, 300):
        for _ in range(60):
            a = "".join(rng.choices("ab cdé", k=n))
            b = "".join(rng.choice("ab c") if rng.random() < 0.06 else c for c in a)
            pairs += [(a, b), (a, b[: n * 9 // 10]), (a, "".join(rng.choices("ab cdé", k=n)))]
    plain = lambda t: "".join(t.split()).lower()
    for a, b in pairs[:-1:7]:
        x, y = plain(a or ""), plain(b)
        row = [0] * (len(y) + 1)
        for c in x:
            last = row[:]
            for j, d in enumerate(y):
                row[j + 1] = last[j] + 1 if c == d else max(last[j + 1], row[j])
        assert X.common_length(X.character_places(x), len(x), y) == row[-1]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for long in (10_000, 20):
        got = {r[0]: r[1] for r in df.select("i", X.similarity_from(0.92, long)("a", "b")).collect()}
        for i, (a, b) in enumerate(pairs):
            r = None if a is None else SequenceMatcher(None, plain(a), plain(b), autojunk=False).ratio()
            assert got[i] == (r if r is not None and r >= 0.92 else None), (a, b)
    for n in (8, 60, 400):
        for _ in range(150):
            x = "".join(rng.choices("ab" if n < 100 else ["the", "on", "sh"], k=n))
            y = "".join(rng.choice("abx") if rng.random() < 0.1 else c for c in x[n // 9 :] + x[: n // 5])
            assert X.matched_length(x, y) == sum(b.size for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    x = "".join(rng.choices(["the", "on", "ed", "in", "sh"], k=250))
    y = "".join(rng.sample(x, len(x)))  # all characters in common, few in order: no blocks are matched
    monkeypatch.setattr(X, "SequenceMatcher", None)
    assert X.similarity_from(0.92).func(pd.Series([x]), pd.Series([y])).isna().all()
