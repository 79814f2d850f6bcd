"""Queries of the term guard: glossary terms found, protected, restored and covered.

The glossary is made of the benchmark's words, their right forms are the words reversed, and words of an even length are
approved. The translation of the queries is the text itself with codes damaged on two lines of three, so that the plain
one lacks every term and each family of codes has lines that only it saves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import termguard as G
from quillspark.plans.registry import Tables, query

WORDS = "[A-Za-z]{5,9}"


def glossary(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z]){WORDS}(?![A-Za-z])"), F.lit(0))).alias("term")).distinct()
    return words.select("term", F.concat(F.lit("x-"), F.reverse(F.lower("term"))).alias("right"), (F.length("term") % 2 == 0).alias("approved"))


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "source"))


GLOSSARY_SQL = """
with words as (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as term from benchmark),
g as (select distinct term, 'x-' || reverse(lower(term)) as "right", length(term) % 2 = 0 as approved from words where length(term) between 5 and 9),
l as (select doc_id, unnest(range(len(s))) as line, unnest(s) as source from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)),
h as (
  select doc_id, line, source, term, "right", approved, (length(source) - length(replace(source, term, ''))) // length(term) as n,
    row_number() over (partition by doc_id, line order by not approved, -length(term), term) as nth
  from l join g on contains(source, term)
)"""


@query(GLOSSARY_SQL + "select doc_id, line::int as line, term, nth::int as nth, n::int as n from h")
def held_terms(t: Tables) -> DataFrame:
    """Glossary terms of each line in the order in which they are replaced, with their occurrences."""
    held = G.with_held_terms(lines(t), glossary(t), "source", keys=("doc_id", "line"))
    rows = held.select("doc_id", "line", F.posexplode("held").alias("nth", "h"))
    return rows.select("doc_id", "line", "h.term", (F.col("nth") + 1).alias("nth"), "h.n")


def codes_sql(family: str) -> str:
    """List of a family's codes in order."""
    letter = lambda e: f"chr((65 + {e})::int)"
    body = f"{letter('i // 676')} || {letter('i // 26 % 26')} || {letter('i % 26')}"
    if family == "rare":
        four = "['J', 'W', 'Z', 'F']"
        power = {1: four}
        for n in (2, 3, 4):
            power[n] = f"flatten(list_transform({power[n - 1]}, lambda a{n}: list_transform({four}, lambda b{n}: a{n} || b{n})))"
        return f"list_concat(['JW'], list_filter(list_concat({power[2]}, list_concat({power[3]}, {power[4]})), lambda c: c <> 'JW'))"
    head, tail = ("ZX", "Q") if family == "long" else ("⟦", "⟧")
    return f"list_transform(range(1000), lambda i: '{head}' || {body} || '{tail}')"


PROTECTED_SQL = f"""{GLOSSARY_SQL}, f as (select {codes_sql("long")} as long, {codes_sql("rare")} as rare, {codes_sql("bracket")} as bracket),
m as (select doc_id, line, source, list({{'term': term, 'right': "right"}} order by nth) as terms from h
  where (length(lower(source)) - length(replace(lower(source), "right", ''))) // length("right") < n group by 1, 2, 3),
c as (select m.*, list_filter(case line % 3 when 0 then long when 1 then rare else bracket end, lambda x: not contains(source, x)) as codes, list_filter(long, lambda x: not contains(source, x)) as first_codes from m, f),
p as (select *,
  list_reduce(list_transform(terms, lambda x, i: {{'a': x.term, 'b': codes[i]}}), lambda s, x: {{'a': replace(s.a, x.a, ' ' || x.b || ' '), 'b': ''}}, {{'a': source, 'b': ''}}).a as coded,
  list_reduce(list_transform(terms, lambda x, i: {{'a': x.term, 'b': first_codes[i]}}), lambda s, x: {{'a': replace(s.a, x.a, ' ' || x.b || ' '), 'b': ''}}, {{'a': source, 'b': ''}}).a as first_coded
  from c)"""


@query(PROTECTED_SQL + "select doc_id, line::int as line, md5(first_coded) as protected_md5 from p")
def protect_terms(t: Tables) -> DataFrame:
    """Lines with the terms that the plain text lacks as codes of the first family."""
    held = G.with_held_terms(lines(t), glossary(t), "source", keys=("doc_id", "line"))
    rows = held.select("doc_id", "line", "source", G.lacking_of(F.col("source"), F.col("source"), F.col("held"))["needed"].alias("needed")).where(F.size("needed") > 0)
    return rows.select("doc_id", "line", F.md5(G.protected(F.col("source"), F.col("needed"), "long")["text"]).alias("protected_md5"))


def damaging(c: Column) -> Column:
    """A translation that keeps lines 0, 3, ...; breaks long codes on lines 1, 4, ... and rare ones, too, on the others."""
    way = F.pmod("line", F.lit(3))
    long = F.replace(c, F.lit("ZX"), F.lit("Z"))
    return F.when(way == 0, c).when(way == 1, long).otherwise(F.replace(long, F.lit("JW"), F.lit("J")))


DAMAGED = "case line % 3 when 0 then {0} when 1 then replace({0}, 'ZX', 'Z') else replace(replace({0}, 'ZX', 'Z'), 'JW', 'J') end"


@query(f"""{PROTECTED_SQL}, d as (select doc_id, line, {DAMAGED.format("coded")} as raw, terms, codes from p),
r as (select doc_id, line, list_reduce(list_reverse(list_transform(terms, lambda x, i: {{'a': x.right, 'b': codes[i]}})), lambda s, x: {{'a': replace(s.a, x.b, x.a), 'b': ''}}, {{'a': raw, 'b': ''}}).a as text from d)
select l.doc_id, l.line::int as line, (case when r.text is null then 0 else 1 + l.line % 3 end)::int as way,
md5(coalesce(regexp_replace(regexp_replace(r.text, '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), {DAMAGED.format("l.source").replace("case line", "case l.line")})) as guarded_md5 from l left join r on l.doc_id = r.doc_id and l.line = r.line""")
def restore_terms(t: Tables) -> DataFrame:
    """Translated lines with all their terms, and the family of codes that saved them."""
    held = G.with_held_terms(lines(t), glossary(t), "source", keys=("doc_id", "line"))
    return G.guarded(held, "source", damaging, keep=("doc_id", "line")).select("doc_id", "line", "way", F.md5("guarded").alias("guarded_md5"))


@query(GLOSSARY_SQL + """, o as (select doc_id, line, term, unnest(list_filter(range(0, length(source) - length(term) + 1), lambda i: source[i + 1 : i + length(term)] = term)) as s from h),
k as (select doc_id, line, list([{'s': s, 'e': s + length(term), 't': term}] order by -length(term), term, s) as met from o group by 1, 2),
c as (select doc_id, line, list_sort(list_reduce(met, lambda a, x: case when len(list_filter(a, lambda y: y.s < x[1].e and x[1].s < y.e)) > 0 then a else list_concat(a, x) end)) as kept from k)
select doc_id, line::int as line, len(kept)::int as n_kept, list_aggregate(list_transform(kept, lambda x: x.s::varchar || ':' || x.t), 'string_agg', ',') as kept from c""")
def covered_terms(t: Tables) -> DataFrame:
    """Occurrences of glossary terms in lines that don't overlap, longer terms first."""
    found = G.covered_terms(lines(t), glossary(t).select("term"), "source").where(F.size("covered") > 0)
    joined = F.array_join(F.transform("covered", lambda x: F.concat_ws(":", x["start"], x["term"])), ",")
    return found.select("doc_id", "line", F.size("covered").alias("n_kept"), joined.alias("kept"))
