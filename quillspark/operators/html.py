"""HTML extraction: built-in patterns where a pattern says it, pandas UDFs for entities, balanced blocks and skeletons."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import unescape_html


def meta(html: Column, prop: str) -> Column:
    """Content of <meta property=...>, unescaped; null if absent."""
    return unescape_html(F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]+property="{re.escape(prop)}"[^>]+content="([^"]*)"', 1), F.lit("")))


def tag_text(html: Column, tag: str) -> Column:
    """Raw inside of the first <tag>, to its first close."""
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def block(html: Column, attribute: str, value: str, tag: str = "div") -> Column:
    """Raw inside of the first element with an attribute value, to the first close of its tag."""
    return F.regexp_extract(html, rf'(?is)<{tag}[^>]*\b{attribute}="{re.escape(value)}"[^>]*>(.*?)</{tag}>', 1)


def between(html: Column, start: str, ends: Sequence[str]) -> Column:
    """Text behind the first start marker and before the first end marker behind it; empty without a start."""
    at = F.instr(html, start)
    rest = F.when(at > 0, F.substr(html, at + len(start))).otherwise("")
    for e in ends:
        rest = F.substring_index(rest, e, 1)
    return rest


def to_text(html: Column, entities: bool = True) -> Column:
    """Breaks and paragraph ends as lines, other tags dropped, entities decoded, lines stripped, blank ones dropped."""
    s = F.regexp_replace(html, r"(?is)<(script|style|nav|table)\b.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"(?is)<!--.*?-->", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)</p\s*>|<br\s*/?>|</h[1-6]>|</li>", "\n"), r"(?s)<[^>]+>", "")
    s = F.replace(unescape_html(s) if entities else s, F.lit(" "), F.lit(" "))
    return F.array_join(F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def without_boilerplate(text: Column, markers: Sequence[str], title: Column | None = None) -> Column:
    """Lines without those that hold a marker or repeat the title."""
    bad = lambda x: sum((F.contains(x, F.lit(m)).cast("int") for m in markers), F.lit(0)) > 0
    keep = (lambda x: ~bad(x)) if title is None else (lambda x: ~bad(x) & (x != F.coalesce(title, F.lit(""))))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def links(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, href, label, nth): anchors in order, inner tags dropped, labels of 2 to 60 characters, the first of an href."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = df.select(id_col, F.posexplode(found).alias("nth", "a"))
    label = F.trim(F.regexp_replace("a", r"(?s)<[^>]+>", ""))
    rows = rows.select(id_col, "nth", F.regexp_extract("a", r'(?is)\bhref="([^"]*)"', 1).alias("href"), label.alias("label")).where(F.length("label").between(2, 60))
    first = rows.groupBy(id_col, "href").agg(F.min_by("label", "nth").alias("label"), F.min("nth").alias("nth"))
    return first.select(id_col, "href", "label", "nth")


def verify(text: Column, script: str = r"\p{L}", least_chars: int = 200, least_share: float = 0.5, least_lines: int = 3, junk: Sequence[str] = ()) -> Column:
    """First failing reason of an extracted text, or ok."""
    share = F.regexp_count(text, F.lit(script)) / F.greatest(F.length(text), F.lit(1))
    rows = F.size(F.filter(F.split(text, "\n"), lambda x: x != ""))
    out = F.when(F.length(text) < least_chars, "too_short").when(share < least_share, "script_share").when(rows < least_lines, "few_lines")
    for j in junk:
        out = out.when(F.contains(text, F.lit(j)), "navigation")
    return out.otherwise("ok")


def _chosen(kind: str, value: str) -> str:
    name = r"([a-z][a-z0-9]*)"
    return {"id": rf'<{name}[^>]*\bid="{re.escape(value)}"[^>]*>', "class": rf'<{name}[^>]*\bclass="(?:[^"]*\s)?{re.escape(value)}(?:\s[^"]*)?"[^>]*>', "tag": rf"<({re.escape(value)})\b[^>]*>"}[kind]


def inside(html: str, kind: str, value: str) -> str:
    """Raw inside of the element chosen by id, class or tag, to the tag that closes it; empty if there is none."""
    m = re.search(_chosen(kind, value), html, re.I)
    if not m:
        return ""
    open_tags = 1
    for t in re.finditer(rf"<(/?){m[1]}\b[^>]*>", html[m.end() :], re.I):
        open_tags += -1 if t[1] else 1
        if not open_tags:
            return html[m.end() : m.end() + t.start()]
    return html[m.end() :]


def skeleton_of(html: str, limit: int = 6000) -> str:
    """Tags and attributes without the text; runs of over 20 characters as their length."""
    s = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", html)
    s = re.sub(r">([^<]*)<", lambda m: f">[{n}]<" if (n := len(m[1].strip())) > 20 else "><", s)
    return " ".join(s.split())[:limit]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once for each row and hand it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def balanced_block(kind: str, value: str) -> Callable[[Column], Column]:
    """inside() as native columns, so that no page goes to Python: lengths of the text between tags of that name are added up
    to the first tag that leaves none open."""
    chosen = "(?iU)" + _chosen(kind, value)

    def to_close(x: Column) -> Column:
        tag = F.concat(F.lit("(?iU)</?"), x["name"], F.lit(r"\b[^>]*>"))
        tags, texts = F.regexp_extract_all(x["rest"], tag, F.lit(0)), F.split(x["rest"], tag)
        parts = F.zip_with(texts, tags, lambda s, t: F.struct(F.length(s).alias("s"), F.length(t).alias("t"), F.when(F.startswith(t, F.lit("</")), -1).otherwise(1).alias("step")))
        state = lambda n, at, end: F.struct(n.cast("int").alias("open"), at.cast("int").alias("at"), end.cast("int").alias("end"))

        def step(a: Column, p: Column) -> Column:
            n, at = a["open"] + p["step"], a["at"] + p["s"]
            return F.when(p["t"].isNull() | a["end"].isNotNull(), a).otherwise(state(n, at + p["t"], F.when(n == 0, at)))

        end = F.aggregate(parts, state(F.lit(1), F.lit(0), F.lit(None)), step, lambda a: a["end"])
        return F.substr(x["rest"], F.lit(1), F.coalesce(end, F.length(x["rest"])))

    def behind(html: Column, x: Column) -> Column:
        rest = F.substr(html, F.position(x["head"], html) + F.length(x["head"]))
        return F.when(x["head"] == "", "").otherwise(_let(F.struct(rest.alias("rest"), x["name"].alias("name")), to_close))

    def block_of(html: Column) -> Column:
        found = F.struct(F.regexp_extract(html, chosen, 0).alias("head"), F.regexp_extract(html, chosen, 1).alias("name"))
        return _let(found, lambda x: behind(html, x))

    return block_of


@F.pandas_udf(T.StringType())
def skeleton(s: pd.Series) -> pd.Series:
    return s.map(skeleton_of, na_action="ignore")


def diagnose(df: DataFrame, id_col: str, html: str, candidates: Sequence[tuple[str, str]], **limits) -> DataFrame:
    """(id, kind, value): the first candidate selector whose text verifies; null if none does."""
    texts = F.array(*(to_text(balanced_block(k, v)(F.col(html))) for k, v in candidates))
    ok = F.transform(texts, lambda t: F.coalesce(verify(t, **limits) == "ok", F.lit(False)))
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in candidates))
    first = df.select(id_col, F.nullif(F.array_position(ok, F.lit(True)), F.lit(0).cast("long")).cast("int").alias("i")).groupBy(id_col).agg(F.min("i").alias("i"))
    return first.select(id_col, F.get(names, F.col("i") - 1).alias("m")).select(id_col, "m.kind", "m.value")


def toc_normalized(df: DataFrame, group: str, index: str, id_col: str) -> DataFrame:
    """Entries without blank ids and repeats (the first stays), renumbered from 1."""
    from quillspark.operators.frames import first_by, numbered

    rows = first_by(df.where(F.trim(F.coalesce(F.col(id_col), F.lit(""))) != ""), [group, id_col], [F.col(index)])
    return numbered(rows, [group], [F.col(index)], "chapter_index")


def joined_pages(df: DataFrame, url: str, text: str) -> DataFrame:
    """Texts of base.html, base_2.html, ... as one, in page order, up to the first missing page."""
    base, nth = F.regexp_replace(url, r"_(\d+)(?=\.html?$)", ""), F.coalesce(F.nullif(F.regexp_extract(url, r"_(\d+)\.html?$", 1), F.lit("")).cast("int"), F.lit(1))
    pages = F.sort_array(F.collect_list(F.struct(nth.alias("n"), F.col(text).alias("t"))))
    rows = df.groupBy(base.alias("base")).agg(pages.alias("p"))
    run = F.filter("p", lambda x, i: x["n"] == i + 1)
    return rows.select("base", F.size(run).alias("n_pages"), F.array_join(F.transform(run, lambda x: x["t"]), "\n").alias("text"))


def toc_order(entries: DataFrame, group: str, marker: str = "is_marker") -> DataFrame:
    """(group, id, title, chapter_index): entries behind the marker of the main list in order, then those before it
    reversed, the first of an id kept; without a marker every id at its last place.

    entries: group, pos, id, title, is_marker (one row a marker, whose id is null).
    """
    from pyspark.sql import Window

    mark = entries.groupBy(group).agg(F.min(F.when(F.col(marker), F.col("pos"))).alias("_m"))
    rows = entries.where(~F.col(marker)).join(mark, group)
    behind = F.col("_m").isNotNull() & (F.col("pos") > F.col("_m"))
    part = F.when(F.col("_m").isNull() | behind, 0).otherwise(1)
    key = F.struct(part.alias("a"), F.when(part == 0, F.col("pos")).otherwise(-F.col("pos")).alias("b"))
    rows = rows.withColumn("_k", key)
    best = rows.groupBy(group, "id").agg(F.when(F.max("_m").isNull(), F.max(F.struct("_k", "title"))).otherwise(F.min(F.struct("_k", "title"))).alias("_b"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_b._k"))
    return best.select(group, "id", F.col("_b.title").alias("title"), nth.alias("chapter_index"))
