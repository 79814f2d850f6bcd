"""Site templates: literal pages of the six templates."""

from quillspark.operators import sites

OG = '<meta property="og:{}" content="{}">'
NOVELS = [
    ("biquge", "".join(OG.format(k, v) for k, v in (("title", "测试小说"), ("novel:author", "某作者"), ("novel:status", "已完结"), ("novel:category", "玄幻"), ("novel:update_time", "2026-07-01 12:30"), ("image", "//img.x/1.jpg"))) + '<div id="intro">这是简介。...《测试小说》</div>',
     ("测试小说", "某作者", "https://img.x/1.jpg", "这是简介。", ["玄幻"], True, "2026-07-01 12:30:00", None)),
    ("xinbiquge", OG.format("title", "恨姐症最新章节"), ("恨姐症", None, None, None, [], False, None, None)),
    ("dingdian", '<title>《逆问》小洛儿 - 顶点小说网</title><meta name="description" content="《逆问》作者:小洛儿,简介:不求名&amp;lt;br /&amp;gt;只求飞升"><img src="https://img.x/upload/book_images/38/37418.jpg"><p>类别: <span>玄幻</span></p>状态: <span>完结</span>',
     ("逆问", "小洛儿", "https://img.x/upload/book_images/38/37418.jpg", "不求名\n只求飞升", [], False, None, None)),
    ("dingdian", '<title>异世邪君 - 全本小说网</title><h1>异世邪君</h1><p class="info">作者: <span class="author">风凌天下</span></p><p class="info">类别: <span>玄幻</span></p><p class="info">状态: <span>完结</span></p><img src="https://img.x/upload/book_images/1/5.jpg" />',
     ("异世邪君", "风凌天下", "https://img.x/upload/book_images/1/5.jpg", None, ["玄幻"], True, None, None)),
    ("faloo", '<div class="book_info"><img src="//img.test/cover.jpg"></div><h1>Kiếm Tiên</h1><h2>作者</h2>：<a>Tác Giả</a><h2>大类</h2>：<a>玄幻</a><h2>小类</h2>：<a>东方</a><h2>状态：完成</h2><div id="info2"><p>Mô tả đầy đủ</p></div>本书已更88章',
     ("Kiếm Tiên", "Tác Giả", "https://img.test/cover.jpg", "Mô tả đầy đủ", ["玄幻", "东方"], True, None, None)),
    ("faloo", "<html>系统提示</html>", (None, None, None, None, [], False, None, "blocked")),
    ("piaotia", '<h1>逆天邪神</h1><div>作者：火星引力</div><img src="https://www.piaotia.com/files/article/image/1/2/2s.jpg">', ("逆天邪神", "火星引力", "https://www.piaotia.com/files/article/image/1/2/2s.jpg", None, [], False, None, None)),
    ("piaotia", '<h1>重生之大涅磐</h1><td>类&nbsp;&nbsp;&nbsp; 别：都市言情</td><td>作&nbsp;&nbsp;&nbsp; 者：奥尔良烤鲟鱼堡</td><td>文章状态：已完成</td><td><span class="hottext">内容简介：</span><br />　　苏灿回到了夏天。<br /><br /></td>',
     ("重生之大涅磐", "奥尔良烤鲟鱼堡", None, "苏灿回到了夏天。", ["都市言情"], True, None, None)),
    ("piaotia", "<title>武动乾坤最新章节_天蚕土豆</title>", ("武动乾坤", None, None, None, [], False, None, None)),
    ("shuba", "".join(f'<meta property="og:{k}" content="{v}"/>' for k, v in (("title", "霍格沃茨"), ("description", "睁开双眼&lt;br /&gt;老家的特产随之而来。"), ("image", "https://cdn.x/90442s.jpg"), ("novel:category", "玄幻魔法"), ("novel:author", "林曦遇鹿"), ("novel:status", "完结"), ("novel:book_name", "霍格沃茨的学习面板"))),
     ("霍格沃茨的学习面板", "林曦遇鹿", "https://cdn.x/90442s.jpg", "睁开双眼\n老家的特产随之而来。", ["玄幻魔法"], True, None, None)),
    ("shuba", '<meta property="og:title" content="武动乾坤"/>', ("武动乾坤", None, None, None, [], False, None, None)),
    ("other", "<h1>x</h1>", (None, None, None, None, [], False, None, "unknown_site")), ("shuba", None, (None, None, None, None, [], False, None, "no_title")),
]


def test_novel_meta(spark):
    rows = [(i, s, h) for i, (s, h, _) in enumerate(NOVELS)]
    out = sites.novel_meta(spark.createDataFrame(rows, "id long, site string, html string"))
    assert out.columns[:2] == ["id", "site"]
    got = {r["id"]: (r["title"], r["author"], r["cover"], r["description"], r["genres"], bool(r["completed"]), str(r["updated"]) if r["updated"] else None, r["problem"]) for r in out.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(NOVELS)}


LATEST = '<div class="book_list"><a href="/book/107/107771/30.html">第三章最新</a></div>'
TOCS = {
    ("biquge", "59979"): (['<a href="/59979/2.html">第二章</a><a href="/59979/1.html">第一章</a><a href="/1/7.html">别的</a><a href="/59979/2.html">第二章 &amp; continued</a>'], [("59979/1", "第一章"), ("59979/2", "第二章 & continued")]),
    ("biquge", "7"): (['<meta property="og:novel:status" content="完本"><a href="/7/9.html">外</a><div id="list"><dl><dt>《测试小说》的结局</dt><dd><a href="/7/4.html">第4章</a></dd><dd><a href="/7/3.html">第3章</a></dd><dt><b>《测试小说》正文</b></dt><dd><a href="/7/1.html">第1章</a></dd><dd><a href="/7/2.html">第2章</a></dd></dl></div>'],
                      [("7/1", "第1章"), ("7/2", "第2章"), ("7/3", "第3章"), ("7/4", "第4章")]),
    ("xinbiquge", "107/107771"): ([LATEST + '<div class="book_list book_list2"><a href="/book/107/107771/10.html">第一章</a><a href="/book/107/107771/20.html">第二章</a></div>', LATEST + '<div class="book_list book_list2"><a href="/book/107/107771/30.html">第三章</a></div>',
                                   LATEST + '<div class="book_list book_list2"><a href="/book/107/107771/10.html">第一章</a></div>'], [("107/107771/10", "第一章"), ("107/107771/20", "第二章"), ("107/107771/30", "第三章")]),
    ("dingdian", "niwen_2"): (['<a href="/n/niwen_2/9297.html" itemprop="url"><span itemprop="name">第二章 (latest)</span></a><a href="/n/niwen_2/9296.html" itemprop="url"><span itemprop="name">第一章 千道宗</span></a><a href="/n/niwen_2/9297.html" itemprop="url"><span itemprop="name">完本感言</span></a>'],
                              [("niwen_2/9296", "第一章 千道宗"), ("niwen_2/9297", "完本感言")]),
    ("dingdian", "empty"): (['<ul class="list" itemscope="itemscope"></ul>'], []),
    ("faloo", "123"): (['<li><a href="//wap.faloo.com/123_1.html">Chương 1</a></li><li><a href="//wap.faloo.com/123_2.html"><span class="v_0">V</span>VIP</a></li><li><a href="//wap.faloo.com/123_3.html"><b>Chương</b> 3</a></li>'], [("123/1", "Chương 1"), ("123/3", "Chương 3")]),
    ("faloo", "5"): (["系统提示"], []),
    ("piaotia", "1/2"): (['<a href="9297.html">第二章 (cũ)</a><a href="9296.html">第一章 觉醒</a><a href="9297.html">第二章 战起</a>'], [("1/2/9296", "第一章 觉醒"), ("1/2/9297", "第二章 战起")]),
    ("piaotia", "1/3"): (['<a class="x" href="/html/1/3/5.html">一</a>'], [("1/3/5", "一")]),
    ("piaotia", "1/4"): (["<p>trống</p>"], []),
    ("shuba", "90442"): (["".join(f'<li data-num="{n}"><a href="https://www.69shuba.com/txt/90442/{c}">{t}</a></li>' for n, c, t in ((3, 300, "第三章 丙"), (1, 100, "第一章 甲"), (2, 200, "第二章 (cũ)"), (2, 200, "第二章 乙")))], [("90442/100", "第一章 甲"), ("90442/200", "第二章 乙"), ("90442/300", "第三章 丙")]),
}


def test_toc_entries_and_state(spark):
    rows = [(s, n, i, h) for (s, n), (pages, _) in TOCS.items() for i, h in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "site string, novel string, page int, html string")
    got = {}
    for r in sites.toc_entries(df).orderBy("site", "novel", "chapter_index").collect():
        got.setdefault((r["site"], r["novel"]), []).append((r["chapter_index"], r["chapter"], r["title"]))
    assert got == {k: [(i, *e) for i, e in enumerate(want, 1)] for k, (_, want) in TOCS.items() if want}
    state = {(r["site"], r["novel"]): (r["n_chapters"], r["completed"], r["problem"]) for r in sites.toc_state(df).collect()}
    assert state[("biquge", "59979")] == (2, False, None) and state[("biquge", "7")] == (4, True, None) and state[("xinbiquge", "107/107771")] == (3, False, None)
    assert state[("dingdian", "niwen_2")] == (2, True, None) and state[("dingdian", "empty")] == (0, None, "empty_list") and state[("faloo", "5")] == (0, None, "blocked")
    assert state[("faloo", "123")] == (2, None, None) and state[("piaotia", "1/4")] == (0, None, "no_entries") and state[("shuba", "90442")] == (3, None, None)


P1, P2 = "第一段" + "字" * 30, "第二段" + "文" * 30
CHAPTERS = {
    ("biquge", "1/1", "https://www.shuhaige.net/x"): ([f'<div id="content">{P1}。<br/>{P2}。<br>请记住本站笔趣阁 www.shuhaige.net<br>手机版</div>'], (f"{P1}。\n{P2}。", 1, None)),
    ("biquge", "1/2", "www.shuhaige.net"): (['<div class="a" id="content">短。</div>'], ("短。", 1, None)),
    ("biquge", "1/123", "www.shuhaige.net"): (['<div id="content">trang một<br>这章没有结束，请点击下一页继续阅读！</div><a href="/1/123_2.html">下一页</a>', '<div id="content">trang hai</div>', '<div id="content">not linked</div>'], ("trang một\ntrang hai", 2, None)),
    ("biquge", "1/3", "www.shuhaige.net"): (['<div id="list">x</div>'], (None, 0, "not_ready")),
    ("biquge", "1/4", "www.shuhaige.net"): (["<p>x</p>"], (None, 0, "no_content")),
    ("biquge", "1/5", "www.shuhaige.net"): (['<div id="content"> <br> </div>'], (None, 1, "empty")),
    ("xinbiquge", "107/1/2", "www.xbiquge.com.cn"): (['<article class="content font_max"><p>&nbsp;&nbsp;第(1/2)页</p><p>một</p><p>第(1/2)页</p></article><a href="/book/107/1/2_2.html">下一页</a>', '<article class="content font_max"><p>hai</p></article>'], ("một\nhai", 2, None)),
    ("dingdian", "a/1", "www.dingdian-xiaoshuo.com"): (['<div class="articlebody"><p>Một &lt;b&gt;</p><p>Hai</p>顶点小说 x</div>'], ("Một <b>\nHai", 1, None)),
    ("faloo", "1/1", "wap.faloo.com"): (['<div class="x nodeContent">' + "nội dung " * 10 + '<script>x</script><br>飞卢小说网提醒 y<br>cuối</p><div class="nodeEnd">'], (("nội dung " * 10).strip() + "\ncuối", 1, None)),
    ("faloo", "1/2", "wap.faloo.com"): (['<div class="nodeContent">ngắn<div class="nodeEnd">'], (None, 1, "unavailable")),
    ("faloo", "1/3", "wap.faloo.com"): (["系统提示"], (None, 0, "blocked")),
    ("piaotia", "1/2/9", "www.piaotia.com"): (["<h1>T</H1><script>x</script>剑气纵横三万里。<br/>飘天文学 www.piaotia.com<br>手机阅读<div class=\"bottomlink\">footer</div>"], ("剑气纵横三万里。", 1, None)),
    ("piaotia", "1/2/8", "www.piaotia.com"): (['<div id="content">内容</div>'], ("内容", 1, None)),
    ("shuba", "9/1", "www.69shuba.com"): (['<div class="txtnav"><h1 class="hide720">第一章 甲</h1><div class="txtinfo hide720"><span>2026</span></div><div id="txtright"><script>l();</script></div>&emsp;&emsp;第一章 甲<br />\r\n&emsp;&emsp;剑气纵横三万里。\n<br /><br />\r\n&emsp;<div class="contentadv"><script>l();</script></div>\r\n&emsp;一剑光寒十九州。\n<br />&emsp;(本章完)\n<br />\n<div class="bottom-ad"><script>l();</script></div></div><div class="page1"><a href="/txt/9/0">上一章</a></div>'],
                                          ("剑气纵横三万里。\n一剑光寒十九州。", 1, None)),
    ("shuba", "9/2", "www.69shuba.com"): (["<div>không có gì</div>"], (None, 0, "no_content")),
}


def test_chapter_text(spark):
    rows = [(s, c.rpartition("/")[0], c, host, i, h) for (s, c, host), (pages, _) in CHAPTERS.items() for i, h in enumerate(pages, 1)]
    out = sites.chapter_text(spark.createDataFrame(rows, "site string, novel string, chapter string, host string, page int, html string"))
    got = {(r["site"], r["chapter"]): (r["text"], r["n_pages"], r["problem"]) for r in out.collect()}
    assert got == {(s, c): want for (s, c, _), (_, want) in CHAPTERS.items()}


def test_anchors_are_matched_once_a_page(spark):
    """F13, F16: patterns with a novel's id are matched against pages, not against each anchor."""
    from quillspark.operators import sites as S
    from quillspark.plans import sites as P

    class Tables:
        lineitem = spark.createDataFrame([(o, n, "R" if n == 1 else "N", "F") for o in range(12) for n in range(1, 4)], "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string")

    entries = S.toc_entries(P.toc_pages(Tables))
    got = sorted((r["novel"], r["chapter_index"], r["chapter"], r["title"]) for r in entries.collect())
    skips = lambda o: 2 if P.NAMES[o % len(P.NAMES)] == "faloo" else 1
    assert got == [(o, i + 1, f"{o}/{n}", f"Chương {n} & F") for o in range(12) for i, n in enumerate(range(skips(o), 4))]
    plan = S.toc_entries(spark.createDataFrame([("x", 1, "", "")], "novel string, page int, html string, site string"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "regexp_extract_all" not in above  # before, each anchor's id, title and number were matched there
