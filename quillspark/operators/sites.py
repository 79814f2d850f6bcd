"""Sites by template: metadata, table of contents and chapter text of pages, each template a few rows of rules.

A page names its template in a column `site`; each field takes the first of its template's rules that matches, as plain
columns in one projection. Entries of a table of contents become rows, so that repeated ones are dropped and numbered by
aggregates. A new site of a known template needs no rule, a new template one entry of TEMPLATES.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import trim_unicode


class Rule(NamedTuple):
    """Group 1 of pattern is the field's value. coded: it is escaped HTML, so entities are decoded before tags are dropped
    (otherwise after); breaks: paragraph ends and breaks become line ends; drop: cut out of the cleaned value."""

    field: str
    pattern: str
    coded: bool = False
    unescape: int = 1
    breaks: bool = False
    drop: str = ""


class Template(NamedTuple):
    """entry: pattern of an anchor with {novel} for the novel's id; groups id and title, at the numbers given.
    keep: which of repeated ids counts; number: group of the entry's own number; skip: entries that are left out.
    region: where a chapter's text is, in order; without: what is cut out of it; junk and heads: lines that go."""

    meta: tuple[Rule, ...]
    completed: str
    entry: tuple[str, ...]
    region: tuple[str, ...]
    ads: tuple[str, ...]
    keep: str = "last"
    groups: tuple[int, int] = (1, 2)
    number: int = 0
    skip: str = ""
    without: tuple[str, ...] = ()
    junk: str = ""
    least: int = 1
    body: Callable[[Column], Column] | None = None


def _og(name: str) -> str:
    return rf'<meta[^>]*property="{name}"[^>]*content="([^"]*)"'


def _named(name: str) -> str:
    return rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]+content=["'](.*?)["']"""


def _labelled(label: str) -> str:
    return rf"(?is)<h2[^>]*>\s*{label}\s*</h2>\s*[：:]?\s*<a[^>]*>(.*?)</a>"


# What the templates of the sites look like, and the words that they use.
GAP = r"(?:&nbsp;|\s)*"
NEXT_PAGE = "点击下一页|下一页.*继续阅读|继续阅读.*下一页"
_BIQUGE_META = (
    Rule("author", _og("og:novel:author")), Rule("status", _og("og:novel:status")), Rule("genre", _og("og:novel:category")), Rule("updated", _og("og:novel:update_time")), Rule("cover", _og("og:image")),
    Rule("description", r'(?s)<div id="intro"[^>]*>(.*?)</div>', unescape=0, drop=r"\.{2,}《.*?》\s*$"), Rule("description", _og("og:description")),
)
_BIQUGE_ENTRY = r'<a href="[^"]*?/{novel}/(\d+)\.html"[^>]*>([^<]+)</a>'
_NO_TITLE = r"(?s)\A(?!.*?<title>《[^》]+》\s*[^\s<-]).*?"
MAIN_LIST, LATEST_PAGES, BLOCKED = "正文", "book_list2", "系统提示"
TEMPLATES = {
    "biquge": Template(
        meta=(Rule("title", _og("og:title")), *_BIQUGE_META), completed="^(?:完|已完)", entry=(_BIQUGE_ENTRY,), region=(r"""(?s)<div[^>]*\bid=["']content["'][^>]*>(.*?)</div>""",), ads=("请记住本站", "手机版", "笔趣阁"), junk=NEXT_PAGE,
        body=lambda h: F.coalesce(found(h, r"""(?s)<div[^>]*\bid=["']list["'][^>]*>(.*?)</div>"""), h),
    ),
    "xinbiquge": Template(
        meta=(Rule("title", _og("og:title"), drop="最新章节$"), *_BIQUGE_META), completed="^(?:完|已完)", entry=(_BIQUGE_ENTRY,), keep="first", region=(r"""(?s)<article[^>]*class="[^"]*font_max[^"]*"[^>]*>(.*?)</article>""",), ads=("请记住本站", "手机版", "笔趣阁"),
        junk=NEXT_PAGE + r"|^第\s*\(\d+/\d+\)\s*页$", body=lambda h: behind(h, LATEST_PAGES),
    ),
    "dingdian": Template(
        meta=(
            Rule("title", r"<title>《([^》]+)》\s*[^\s<-]+"), Rule("title", r"<h1[^>]*>([^<]+)</h1>"), Rule("author", r"<title>《[^》]+》\s*([^\s<-]+)"), Rule("author", r'<span class="author">([^<]+)</span>'),
            Rule("genre", _NO_TITLE + r"类别:\s*<span>([^<]+)</span>"), Rule("status", _NO_TITLE + r"状态:\s*<span>([^<]+)</span>"), Rule("cover", r'<img[^>]+src="([^"]*book_images[^"]+)"'),
            Rule("description", r'(?s)name="description"[^>]*content="(.*?)"', coded=True, unescape=2, breaks=True, drop=r"^《[^》]+》作者:[^,]+,简介:"),
        ),
        completed="^(?:完结|完本)$", entry=(r'<a href="[^"]*?/{novel}/(\d+)\.html"[^>]*>(?:<span[^>]*>)?([^<]+)',), region=(r'(?s)<div[^>]*\bclass="[^"]*articlebody[^"]*"[^>]*>(.*?)</div>',), ads=("顶点小说", "dingdian", "请记住", "手机版"),
    ),
    "faloo": Template(
        meta=(
            Rule("title", r"(?is)<h1[^>]*>(.*?)</h1>"), Rule("author", _labelled("作者")), Rule("author", _named("og:novel:author")), Rule("genre", _labelled("大类")), Rule("genre", _labelled("小类")), Rule("genre", _named("og:novel:category")), Rule("genre2", _labelled("小类")),
            Rule("status", r"状态[：:]\s*(完成|完结)"), Rule("description", r"""(?is)id=["']info2["'][^>]*>(.*?)</div>""", breaks=True), Rule("description", _named("description")),
            Rule("cover", r"""(?is)class=["'][^"']*book_info[^"']*["'].*?<img[^>]+src=["']([^"']+)"""), Rule("cover", _named("og:image")),
        ),
        completed="^(?:完成|完结)$", keep="first", skip=r"""class=["'][^"']*\bv_0\b""", least=50, entry=(r"""(?is)<li[^>]*>\s*<a[^>]+href=["'][^"']*/{novel}_(\d+)\.html["'][^>]*>(.*?)</a>\s*</li>""",), ads=(),
        region=(r"""(?is)class=["'][^"']*\bnodeContent\b[^"']*["'][^>]*>(.*?)<div[^>]*class=["'][^"']*\bnodeEnd\b""",), without=(r"(?is)<script\b.*?</script>|<style\b.*?</style>",), junk="^(?:飞卢小说网提醒|飞卢小说，飞要你好看|手机用户请浏览)",
    ),
    "piaotia": Template(
        meta=(
            Rule("title", r"(?s)<h1[^>]*>(.*?)</h1>", unescape=0), Rule("title", r"(?s)<title>(.*?)</title>", drop="(?s)(?:最新章节|[_,，-]).*$"), Rule("author", rf"作{GAP}者{GAP}[：:]{GAP}([^<\n,，]+)"), Rule("author", r"[,，]\s*([^,，<]+?)作品选"),
            Rule("genre", rf"类{GAP}别{GAP}[：:]{GAP}([^<]+)"), Rule("status", rf"文章状态{GAP}[：:]{GAP}([^<]+)"), Rule("cover", r'<img[^>]+src="([^"]+/files/article/image/[^"]+)"'), Rule("description", r"(?s)内容简介[：:]\s*</span>(.*?)</td>", coded=True, breaks=True),
        ),
        completed="^(?:已完成|完本|完结)$", entry=(r'<a\s+href="(\d+)\.html"[^>]*>([^<]+)</a>', r'<a[^>]+href="[^"]*?/(\d+)\.html"[^>]*>([^<]+)</a>'), ads=("飘天文学", "piaotia", "ptwxz", "手机阅读", "请记住", "本书首发", "txt下载"),
        region=(r'(?s)<div[^>]*id="content"[^>]*>(.*?)</div>', r'(?is)</h1>(.*?)(?:<div[^>]*class="bottomlink"|\z)'), without=(r"(?is)<script.*?</script>", r"(?is)<table.*?</table>", r'(?is)<div[^>]*class="toplink".*?</div>'),
    ),
    "shuba": Template(
        meta=(
            *(Rule("title", rf'<meta[^>]+(?:property|name)="{n}"[^>]*content="([^"]*)"') for n in ("og:novel:book_name", "og:title")), Rule("title", r"(?s)<h1[^>]*>(.*?)</h1>", unescape=0), Rule("author", _named("og:novel:author")), Rule("genre", _named("og:novel:category")),
            Rule("status", _named("og:novel:status")), Rule("cover", _named("og:image")), Rule("description", _named("og:description"), coded=True, breaks=True),
        ),
        completed="^(?:完结|完本)$", entry=(r'data-num="(\d+)"[^>]*>\s*<a[^>]+href="[^"]*?/txt/{novel}/(\d+)"[^>]*>([^<]+)</a>',), groups=(2, 3), number=1, ads=("69书吧", "69shu", "cdnshu", "请记住", "手机阅读", "本书首发", "(本章完)"),
        region=(r'(?s)class="txtnav"[^>]*>(.*?)(?:<div class="bottom-ad"|\z)',), without=('(?s)<div class="page1?".*$', r"(?is)<script.*?</script>", r'(?is)<div[^>]*class="[^"]*txtinfo[^"]*"[^>]*>.*?</div>'),
    ),
}
LAST_TITLES = r"(?:正文|全文)?(?:完结|完本)|大结局|完结感言|完本感言|终章"
FIELDS = ("title", "author", "cover", "description", "genre", "genre2", "status", "updated")


def found(c: Column, pattern: str | Column, group: int = 1) -> Column:
    """Group of the first match, null if there is none."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.get(F.regexp_extract_all(c, pattern, F.lit(group)), F.lit(0))


def behind(c: Column, mark: str) -> Column:
    """What stands behind the first mark; all where there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark))).otherwise(c)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is told once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_site(of: Callable[[str, Template], Column], site: Column) -> Column:
    out = F
    for name, t in TEMPLATES.items():
        out = out.when(site == name, of(name, t))
    return out


def _decoded(values: Column) -> Column:
    """Of an array of strings each with its entities decoded."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([[v if v is None else unescape(v) for v in r] for r in rows.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(values)


def _cleaned(rule: Rule, value: str | None) -> str | None:
    """The value without tags, decoded and trimmed, null if nothing is left."""
    if value is None:
        return None
    bare = lambda v: re.sub(r"<[^>]+>", "", re.sub(r"(?i)</p\s*>|<br\s*/?>", "\n", v) if rule.breaks else v)
    value = value if rule.coded else bare(value)
    for _ in range(rule.unescape):
        value = unescape(value)
    value = (bare(value) if rule.coded else value).strip()
    if rule.breaks:
        value = "\n".join(filter(None, map(str.strip, value.split("\n"))))
    return (re.sub(rule.drop, "", value).strip() if rule.drop else value) or None


def _fields(html: Column, site: Column) -> Column:
    """array<string>: of each field the first of its rules that leaves something. Patterns are matched natively; what they
    found is cleaned in one pass for all fields."""
    values = _by_site(lambda _, t: F.array(*(found(html, r.pattern) for r in t.meta)), site)

    def run(sites: pa.Array, rows: pa.Array) -> pa.Array:
        def one(name, row):
            out = dict.fromkeys(FIELDS)
            for rule, v in zip(TEMPLATES[name].meta, row, strict=True) if row else ():
                out[rule.field] = out[rule.field] or _cleaned(rule, v)
            return list(out.values())

        return pa.array([one(*r) for r in zip(sites.to_pylist(), rows.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(site, values)


def novel_meta(pages: DataFrame, html: str = "html", site: str = "site") -> DataFrame:
    """pages (all columns but html) with title, author, cover, description, genres, completed, updated and problem.

    problem: blocked where the site answered with a notice, no_title where a page has none, else null. Pages of unknown
    templates have problem unknown_site, null pages no_title. An address without a scheme gets https.
    """
    h, s = F.col(html), F.col(site)
    rows = pages.withColumn("_f", _fields(h, s))
    rows = rows.withColumns({f"_{f}": F.col("_f")[i] for i, f in enumerate(FIELDS)})
    cover = F.when(F.col("_cover").startswith("//"), F.concat(F.lit("https:"), "_cover")).when((s == "faloo") & F.col("_cover").startswith("http://"), F.concat(F.lit("https"), F.substr("_cover", F.lit(5)))).otherwise(F.col("_cover"))
    ended = _by_site(lambda _, t: F.coalesce(F.col("_status").rlike(t.completed), F.lit(False)), s)
    blocked = (s == "faloo") & F.contains(F.substring(h, 1, 2000), F.lit(BLOCKED))
    problem = F.when(~s.isin(*TEMPLATES) | s.isNull(), "unknown_site").when(F.col("_title").isNotNull(), F.lit(None)).when(blocked, "blocked").otherwise("no_title")
    genre2 = F.when(F.col("_genre") != F.coalesce("_genre2", F.lit("")), F.col("_genre2"))
    return rows.select(
        *(c for c in pages.columns if c != html), F.col("_title").alias("title"), F.col("_author").alias("author"), cover.alias("cover"), F.col("_description").alias("description"),
        F.array_compact(F.array("_genre", genre2)).alias("genres"), ended.alias("completed"), F.try_to_timestamp("_updated", F.lit("yyyy-MM-dd HH:mm")).alias("updated"), problem.alias("problem"),
    )


def _entry_pattern(novel: Column, pattern: str) -> Column:
    head, _, tail = pattern.partition("{novel}")
    return F.concat(F.lit(head + r"\Q"), novel, F.lit(r"\E" + tail)) if tail else F.lit(pattern)


def _anchors(html: Column, novel: Column, name: str, t: Template) -> Column:
    """array<struct<id, t, num, locked, part>> in the order in which entries count: what the pattern found in each anchor,
    1 for the part before a main list. The novel's pattern is matched against a page, not once more against each anchor."""

    def all_of(c: Column, i: int, part: int) -> Column:
        pattern = _entry_pattern(novel, t.entry[i])
        of = lambda group: F.regexp_extract_all(c, pattern, F.lit(group))
        others = [of(t.groups[1]), *([of(t.number)] if t.number else []), *([of(0)] if t.skip else [])]
        number = lambda k: F.get(others[1], k).cast("long") if t.number else F.lit(None).cast("long")
        locked = lambda k: F.get(others[-1], k).rlike(t.skip) if t.skip else F.lit(False)
        return F.transform(of(t.groups[0]), lambda x, k: F.struct(x.alias("id"), F.get(others[0], k).alias("t"), number(k).alias("num"), locked(k).alias("locked"), F.lit(part).alias("part")))

    def split(body: Column, head: Column) -> Column:
        at = F.position(head, body)
        behind_it, before = F.substr(body, at + F.length(head)), F.substr(body, F.lit(1), at - 1)
        main = F.concat(_once(behind_it, lambda c: all_of(c, 0, 1)), F.reverse(_once(before, lambda c: all_of(c, 0, 1))))
        return F.when(head.isNotNull(), main).otherwise(all_of(body, 0, 0))

    def of_body(body: Column) -> Column:
        if name == "biquge":
            heads = F.filter(F.regexp_extract_all(body, F.lit(r"(?s)<dt[^>]*>.*?</dt>"), F.lit(0)), lambda x: F.contains(x, F.lit(MAIN_LIST)))
            return _once(F.get(heads, F.lit(0)), lambda head: split(body, head))
        if len(t.entry) == 1:
            return all_of(body, 0, 0)
        return _once(all_of(body, 0, 0), lambda first: F.when(F.size(first) > 0, first).otherwise(all_of(body, 1, 0)))

    return _once(t.body(html) if t.body else html, of_body)


def toc_entries(pages: DataFrame, html: str = "html", site: str = "site", novel: str = "novel", page: str = "page") -> DataFrame:
    """(site, novel, chapter_index, chapter, title) of tables of contents, whose pages count in their order.

    A repeated id counts where its template says: at its last place (a list behind the block of latest chapters), or at its
    first; a list that names its main part has the rest, reversed, behind it; numbered entries go by their number. Titles
    are decoded and trimmed; entries of locked chapters are left out. A page without entries gives no rows, see toc_state().
    """
    s, n = F.col(site), F.col(novel).cast("string")
    rows = pages.select(site, novel, page, F.posexplode(_by_site(lambda name, t: _anchors(F.col(html), n, name, t), s)).alias("_pos", "_e"))
    rows = rows.where(~F.col("_e.locked")).select(site, novel, page, "_pos", F.col("_e.part").alias("_part"), F.col("_e.id").alias("_id"), F.col("_e.t").alias("_t"), F.col("_e.num").alias("_num"))
    rows = rows.withColumn("_t", trim_unicode(_decoded(F.array(F.regexp_replace("_t", r"<[^>]+>", "")))[0])).where("_t <> '' and _id <> ''")
    first = (F.col("_part") == 1) | _by_site(lambda _, t: F.lit(t.keep == "first"), s)
    at = F.struct(page, "_pos", "_num", "_t")
    best = rows.groupBy(site, novel, "_id").agg(F.when(F.max(first), F.min(at)).otherwise(F.max(at)).alias("b"))
    nth = F.row_number().over(Window.partitionBy(site, novel).orderBy(F.col("b._num").asc_nulls_first(), f"b.{page}", "b._pos"))
    return best.select(site, novel, nth.alias("chapter_index"), F.concat_ws("/", F.col(novel).cast("string"), "_id").alias("chapter"), F.col("b._t").alias("title"))


def toc_state(pages: DataFrame, html: str = "html", site: str = "site", novel: str = "novel", page: str = "page") -> DataFrame:
    """(site, novel, n_chapters, completed, problem) of every table of contents.

    completed is told by the page's status, or by the last five titles where a site says it there only; null where it can't
    be told. problem: empty_list (the site itself has none), blocked, no_entries; null where there are chapters.
    """
    s, h = F.col(site), F.col(html)
    entries = toc_entries(pages, html, site, novel, page)
    last = Window.partitionBy(site, novel).orderBy(F.desc("chapter_index"))
    ends = entries.withColumn("_r", F.row_number().over(last)).groupBy(site, novel).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("_r") <= 5) & F.col("title").rlike(LAST_TITLES)).alias("end"))
    said = F.when(s.isin("biquge", "xinbiquge"), F.coalesce(found(h, _og("og:novel:status")).rlike("^(?:完|已完)"), F.lit(False)))
    empty = h.rlike(r'(?s)<ul[^>]*\bclass="[^"]*\blist\b[^"]*"[^>]*>\s*</ul>')
    first = pages.groupBy(site, novel).agg(F.min_by(F.struct(said.alias("said"), empty.alias("empty"), F.contains(F.substring(h, 1, 2000), F.lit(BLOCKED)).alias("blocked")), page).alias("p"))
    rows = first.join(ends, [site, novel], "left")
    completed = F.when(F.col("n").isNotNull(), F.coalesce("p.said", F.when((s == "dingdian") & F.col("end"), True)))
    problem = F.when(F.col("n").isNotNull(), F.lit(None)).when((s == "dingdian") & F.col("p.empty"), "empty_list").when((s == "faloo") & F.col("p.blocked"), "blocked").otherwise("no_entries")
    return rows.select(site, novel, F.coalesce("n", F.lit(0)).alias("n_chapters"), completed.alias("completed"), problem.alias("problem"))


def chapter_text(pages: DataFrame, html: str = "html", site: str = "site", novel: str = "novel", chapter: str = "chapter", page: str = "page", host: str = "host", most_pages: int = 30) -> DataFrame:
    """(site, novel, chapter, text, n_pages, problem): a chapter's pages from 1 on, as far as each one links to the next.

    Lines are trimmed, blank ones, advertisements (those of the template and with the host's name), hints at further pages
    and a repeated heading go. problem: not_ready (listed, but the page is the table of contents), blocked, unavailable (too
    short for what is free), no_content, empty; text is null then.
    """
    s, h = F.col(site), F.col(html)

    def region(_: str, t: Template) -> Column:
        c = F.coalesce(*(found(h, p) for p in t.region))
        for p in t.without:
            c = F.regexp_replace(c, p, "")
        return c

    cid = F.element_at(F.split(F.col(chapter), "/"), -1)
    more = F.regexp_like(h, F.concat(F.lit(r"\Q"), cid, F.lit("_"), (F.col(page) + 1).cast("string"), F.lit(r".\E"))) & s.isin("biquge", "xinbiquge")
    raw = _by_site(region, s)
    title = F.when(s == "shuba", found(raw, r"(?s)<h1[^>]*>(.*?)</h1>"))
    rows = pages.select(site, novel, chapter, page, host, more.alias("more"), raw.alias("raw"), title.alias("h1"), h.rlike(r"""<div[^>]*\bid=["']list["']""").alias("listed"), F.contains(F.substring(h, 1, 2000), F.lit(BLOCKED)).alias("blocked"))
    bare = F.when(s == "shuba", F.regexp_replace("raw", r"(?is)<h1[^>]*>.*?</h1>", "")).otherwise(F.col("raw"))
    parts = F.array(*(F.regexp_replace(c, r"<[^>]+>", "") for c in (F.regexp_replace(bare, r"(?i)</p\s*>|<br\s*/?>", "\n"), F.col("h1"))))
    rows = rows.withColumn("_v", _decoded(parts))
    lines = F.filter(F.transform(F.split(F.replace(F.col("_v")[0], F.lit(" "), F.lit(" ")), "\n"), trim_unicode), lambda x: x != "")
    name = F.regexp_replace(F.col(host), r"^(?:https?://)?(?:www\.)?([^/]*).*$", "$1")
    own = F.array(F.lower(name), F.lower(F.substring_index(name, ".", 1)))
    ads = _by_site(lambda _, t: F.array(*(F.lit(a.lower()) for a in t.ads)) if t.ads else F.array().cast("array<string>"), s)
    marks = F.filter(F.when(s == "faloo", ads).otherwise(F.concat(own, ads)), lambda m: m != "")
    junk = lambda x: _by_site(lambda _, t: x.rlike(t.junk) if t.junk else F.lit(False), s)
    kept = F.filter(lines, lambda x: ~junk(x) & ~F.exists(marks, lambda m: F.contains(F.lower(x), m)))
    kept = F.when((F.col("_v")[1] != "") & (F.get(kept, F.lit(0)) == trim_unicode(F.col("_v")[1])), F.slice(kept, 2, 1_000_000)).otherwise(kept)
    one = F.struct(F.col(page).cast("int").alias("n"), "more", F.col("raw").isNotNull().alias("there"), kept.alias("lines"), "listed", "blocked")
    whole = rows.groupBy(site, novel, chapter).agg(F.array_sort(F.collect_list(one)).alias("p"))
    run = F.aggregate("p", F.lit(0), lambda n, x: F.when((x["n"] == n + 1) & x["there"] & (n < most_pages) & ((n == 0) | F.get(F.col("p"), n - 1)["more"]), n + 1).otherwise(n))
    whole = whole.withColumn("n_pages", run).withColumn("text", F.array_join(F.flatten(F.transform(F.slice("p", 1, run), lambda x: x["lines"])), "\n"))
    first = F.get(F.col("p"), F.lit(0))
    short = F.length("text") < _by_site(lambda _, t: F.lit(t.least), s)
    problem = (
        F.when((F.col("n_pages") == 0) & (s == "biquge") & first["listed"], "not_ready").when((s == "faloo") & short & first["blocked"], "blocked").when((s == "faloo") & short, "unavailable")
        .when(F.col("n_pages") == 0, "no_content").when(short, "empty")
    )
    return whole.select(site, novel, chapter, F.when(problem.isNull(), F.col("text")).alias("text"), "n_pages", problem.alias("problem"))
