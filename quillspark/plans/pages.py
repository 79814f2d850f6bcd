"""HTML queries on raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import html as H
from quillspark.plans.registry import Tables, query

TEXT_SQL = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<table\b.*?</table\s*>', '', 'g'),
'(?is)<!--.*?-->', '', 'g'), '(?i)</p\s*>|<br\s*/?>|</h[1-6]>|</li>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"""


@query(r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, regexp_extract(html, '(?is)<html[^>]*lang="([a-z]*)"', 1) as lang, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages""")
def html_title_meta(t: Tables) -> DataFrame:
    """Title, language and host, entities left as they are."""
    return t.pages.select("page_id", H.tag_text(F.col("html"), "title").alias("title"), F.regexp_extract("html", r'(?is)<html[^>]*lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query(f"select page_id, md5(replace({TEXT_SQL}, chr(160), ' ')) as text_md5 from pages")
def html_to_text(t: Tables) -> DataFrame:
    """Text of the pages, before entities are decoded."""
    return t.pages.select("page_id", F.md5(H.to_text(F.col("html"), entities=False)).alias("text_md5"))


@query(r"""with a as (select page_id, u.i - 1 as nth, u.a as a from (select page_id, unnest(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>'), lambda x, i: {'i': i, 'a': x})) as u from pages)),
l as (select page_id, nth, regexp_extract(a, '(?is)\bhref="([^"]*)"', 1) as href, trim(regexp_replace(a, '(?s)<[^>]+>', '', 'g')) as label from a) select page_id, href, min_by(label, nth) as label, min(nth)::int as nth from l where length(label) between 2 and 60 group by 1, 2""")
def html_links(t: Tables) -> DataFrame:
    """Anchors of the pages."""
    return H.links(t.pages, "page_id", "html")


@query(f"""with x as (select page_id, {TEXT_SQL} as s from pages) select page_id, len(list_filter(string_split(s, chr(10)), lambda l: not (contains(l, 'Cookie') or contains(l, 'cookie') or contains(l, '©'))))::int as n_lines from x""")
def html_boilerplate(t: Tables) -> DataFrame:
    """Lines left when those with a marker go."""
    s = H.without_boilerplate(H.to_text(F.col("html"), entities=False), ["Cookie", "cookie", "©"])
    return t.pages.select("page_id", F.size(F.split(s, "\n")).alias("n_lines"))


@query(f"""with x as (select page_id, {TEXT_SQL} as s from pages) select page_id, case when length(s) < 200 then 'too_short' when len(regexp_extract_all(s, '[A-Za-z]')) * 1.0 / greatest(length(s), 1) < 0.6 then 'script_share'
when len(list_filter(string_split(s, chr(10)), lambda l: l <> '')) < 3 then 'few_lines' when contains(s, 'cookie') then 'navigation' else 'ok' end as verdict from x""")
def content_verify(t: Tables) -> DataFrame:
    """First reason a page's text fails for."""
    return t.pages.select("page_id", H.verify(H.to_text(F.col("html"), entities=False), "[A-Za-z]", 200, 0.6, 3, ["cookie"]).alias("verdict"))


@query(r"select page_id, length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) as n_article, length(regexp_extract(html, '(?is)<div[^>]*\bclass=\"ad\"[^>]*>(.*?)</div>', 1)) as n_ad from pages")
def html_blocks(t: Tables) -> DataFrame:
    """Lengths of blocks to their first close."""
    return t.pages.select("page_id", F.length(H.tag_text(F.col("html"), "article")).alias("n_article"), F.length(H.block(F.col("html"), "class", "ad")).alias("n_ad"))


@query("""select page_id, case when instr(html, '</nav>') > 0 then length(string_split(substr(html, instr(html, '</nav>') + 6), '</article>')[1]) else 0 end as n from pages""")
def html_slice_markers(t: Tables) -> DataFrame:
    """What lies between two markers."""
    return t.pages.select("page_id", F.length(H.between(F.col("html"), "</nav>", ["</article>"])).alias("n"))


@query()
def html_balanced(t: Tables) -> DataFrame:
    """Text of the article, to the tag that closes it."""
    return t.pages.select("page_id", H.to_text(H.balanced_block("tag", "article")(F.col("html"))).alias("text"))


@query()
def html_unescape(t: Tables) -> DataFrame:
    """Titles with their entities decoded."""
    return t.pages.select("page_id", H.unescape_html(H.tag_text(F.col("html"), "title")).alias("title"))


@query()
def html_skeleton(t: Tables) -> DataFrame:
    """Tags without text."""
    return t.pages.select("page_id", H.skeleton("html").alias("skeleton"))


@query()
def html_diagnose(t: Tables) -> DataFrame:
    """First selector that gives a sound text."""
    return H.diagnose(t.pages, "page_id", "html", [("class", "content"), ("tag", "article"), ("tag", "body")], script="[A-Za-z]")
