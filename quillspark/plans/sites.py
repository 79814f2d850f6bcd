"""Queries of the site templates. The tables have no pages of these templates, so Spark renders them from all orders, parts
and documents, one template after another; the SQL says what has to be read back, without any page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import sites as S
from quillspark.plans.registry import Tables, query

NAMES = tuple(S.TEMPLATES)


def site_of(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.col(key), F.lit(len(NAMES))) + 1).cast("int"))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def toc_pages(t: Tables) -> DataFrame:
    """A table of contents for each order, its lines as chapters; biquge has a main list, shuba counts down, locked lines are
    returned ones, the last chapter stands in a block of its own before the list."""
    line = F.struct(F.col("n"), (F.col("flag") == "R").alias("locked"), F.concat(F.lit("Chương "), "n", F.lit(" &amp; "), "status").alias("t"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("novel"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    o = lines.groupBy("novel").agg(F.array_sort(F.collect_list(line)).alias("c")).withColumn("site", site_of("novel"))
    novel, joined = F.col("novel").cast("string"), lambda f, c="c": F.array_join(F.transform(c, f), "")
    link = lambda x, before, title=None: F.concat(F.lit('<a href="' + before), novel, F.lit("/"), x["n"], F.lit('.html">'), title if title is not None else x["t"], F.lit("</a>"))
    late = lambda before: link(F.element_at(F.col("c"), -1), before, F.lit("latest"))
    front, back = F.filter("c", lambda x: x["n"] <= 2), F.reverse(F.filter("c", lambda x: x["n"] > 2))
    page = {
        "biquge": F.concat(F.lit('<div id="list"><dt>End</dt>'), joined(lambda x: link(x, "/"), back), F.lit("<dt><b>正文</b></dt>"), joined(lambda x: link(x, "/"), front), F.lit("</div>")),
        "xinbiquge": F.concat(late("/book/"), F.lit('<div class="book_list2">'), joined(lambda x: link(x, "/book/"))),
        "dingdian": F.concat(late("/n/"), joined(lambda x: link(x, "/n/"))),
        "faloo": joined(lambda x: F.concat(F.lit('<li><a href="/'), novel, F.lit("_"), x["n"], F.lit('.html">'), F.when(x["locked"], '<i class="v_0"></i>').otherwise(""), x["t"], F.lit("</a></li>"))),
        "piaotia": joined(lambda x: F.concat(F.lit('<a href="'), x["n"], F.lit('.html">'), x["t"], F.lit("</a>"))),
        "shuba": joined(lambda x: F.concat(F.lit('<li data-num="'), x["n"], F.lit('"><a href="/txt/'), novel, F.lit("/"), x["n"], F.lit('">'), x["t"], F.lit("</a></li>")), F.reverse("c")),
    }
    html = F.coalesce(*(F.when(F.col("site") == k, v) for k, v in page.items()))
    return o.select("site", "novel", F.lit(1).alias("page"), html.alias("html"))


SITE_SQL = "['" + "', '".join(NAMES) + "']"
TOC_SQL = f"""with l as (select l_orderkey as novel, {SITE_SQL}[(l_orderkey % {len(NAMES)})::int + 1] as site, l_linenumber as n, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus from lineitem group by all), k as (select * from l where not (site = 'faloo' and l_returnflag = 'R'))"""


@query(TOC_SQL + " select site, novel, row_number() over (partition by novel order by n)::int as chapter_index, novel || '/' || n as chapter, 'Chương ' || n || ' & ' || l_linestatus as title from k")
def site_toc(t: Tables) -> DataFrame:
    """Chapters of every order's table of contents, read from a page of its template."""
    return S.toc_entries(toc_pages(t))


@query(TOC_SQL + """, a as (select distinct site, novel from l) select a.site, a.novel, count(k.n)::bigint as n_chapters, case when count(k.n) > 0 and a.site in ('biquge', 'xinbiquge') then false end as completed,
case when count(k.n) = 0 then 'no_entries' end as problem from a left join k on a.novel = k.novel group by 1, 2""")
def site_toc_state(t: Tables) -> DataFrame:
    """Number of chapters and state of every order's table of contents."""
    return S.toc_state(toc_pages(t))


@query(f"""select p_partkey, {SITE_SQL}[(p_partkey % {len(NAMES)})::int + 1] as site, p_name || ' & ' || p_partkey as title, p_brand as author, case when p_partkey % 6 = 2 then [] else [p_type] end as genres,
p_partkey % 6 <> 2 and p_size % 2 = 0 as completed, case when p_partkey % 6 in (0, 1) then 'Size ' || p_size else 'Size' || chr(10) || p_size end as description from part""")
def site_meta(t: Tables) -> DataFrame:
    """Metadata of every part, read from a page of its template."""
    p = t.part.withColumn("site", site_of("p_partkey"))
    title = F.concat("p_name", F.lit(" &amp; "), "p_partkey")
    og = lambda **k: F.concat(*(F.concat(F.lit(f'<meta property="og:{n.replace("__", ":")}" content="'), v, F.lit('">')) for n, v in k.items()))
    done = lambda yes, no: F.when(F.col("p_size") % 2 == 0, yes).otherwise(no)
    named = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) and x not in p.columns else F.col(x) if isinstance(x, str) else x for x in parts))
    family = og(novel__author=F.col("p_brand"), novel__category=F.col("p_type"), novel__status=done("已完结", "连载"))
    intro = named('<div id="intro">Size <b>', F.col("p_size").cast("string"), "</b></div>")
    page = {
        "biquge": F.concat(og(title=title), family, intro), "xinbiquge": F.concat(og(title=F.concat(title, F.lit("最新章节"))), family, intro),
        "dingdian": named("<title>《", title, "》", "p_brand", ' - x</title><meta name="description" content="Size&amp;lt;br&amp;gt;', F.col("p_size").cast("string"), '">状态: <span>完结</span>'),
        "faloo": named("<h1><i>", title, "</i></h1><h2>作者</h2>：<a>", "p_brand", "</a><h2>大类</h2><a>", "p_type", "</a>状态：", done("完成", "连载"), '<div id="info2"><p>Size</p>', F.col("p_size").cast("string"), "</div>"),
        "piaotia": named("<title>", title, "最新章节_x</title>作&nbsp;&nbsp;者：", "p_brand", "\n类&nbsp;别：", "p_type", "<br>文章状态：", done("已完成", "连载"), "<br>内容简介：</span><br />Size<br>", F.col("p_size").cast("string"), "</td>"),
        "shuba": F.concat(og(novel__book_name=title, novel__author=F.col("p_brand"), novel__category=F.col("p_type"), novel__status=done("完结", "连载")), named('<meta property="og:description" content="Size&lt;br&gt;', F.col("p_size").cast("string"), '">')),
    }
    rows = p.select("p_partkey", "site", F.coalesce(*(F.when(F.col("site") == k, v) for k, v in page.items())).alias("html"))
    return S.novel_meta(rows).select("p_partkey", "site", "title", "author", "genres", "completed", "description")


@query(f"""with d as (select doc_id, {SITE_SQL}[(doc_id % {len(NAMES)})::int + 1] as site, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as lines from documents where text is not null),
j as (select doc_id, site, len(lines) as n, array_to_string(lines, chr(10)) as body from d)
select doc_id::varchar as chapter, case when length(body) >= case when site = 'faloo' then 50 else 1 end then md5(body) end as text_md5,
case when site = 'faloo' and length(body) < 50 then 'unavailable' when length(body) < 1 then 'empty' end as problem from j""")
def site_chapters(t: Tables) -> DataFrame:
    """The text of every document, read from a chapter's page of its template with advertisements in between."""
    d = t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("chapter"), site_of("doc_id").alias("site"), F.split("text", "\n").alias("lines"))
    inside = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("&nbsp; "), escaped(x))), "<br/>\n")
    ad = F.when(F.col("site") == "faloo", "飞卢小说网提醒 read on").otherwise("Read at WWW.NOVELHOST.test")
    shell = {"biquge": ('<div id="content">', "</div>"), "xinbiquge": ('<article class="font_max"><p>第(1/1)页</p>', "</article>"), "dingdian": ('<div class="articlebody">', "</div>"), "faloo": ('<div class="nodeContent">', '<div class="nodeEnd">'),
             "piaotia": ("<h1>T</h1><table>x</table>", '<div class="bottomlink">next</div>'), "shuba": ('<div class="txtnav"><h1>T</h1><div class="txtinfo">x</div>', '<div class="bottom-ad">')}
    around = lambda i: F.coalesce(*(F.when(F.col("site") == k, v[i]) for k, v in shell.items()))
    html = F.concat(around(0), inside, F.lit("<br>"), ad, around(1))
    rows = d.select("site", F.lit("n").alias("novel"), "chapter", F.lit(1).alias("page"), F.lit("https://www.novelhost.test/").alias("host"), html.alias("html"))
    return S.chapter_text(rows).select("chapter", F.md5("text").alias("text_md5"), "problem")
