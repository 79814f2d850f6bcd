"""Queries of the name rules. The tables have no names in another script, so all documents' words of two to five letters
become names: a letter is a character whose readings are the letter with a, then with o, and whose romanisation is the letter
with i. Nine forms in turn are right, wrong, foreign or meanings; the SQL says what each has to give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import names as N
from quillspark.plans.registry import Tables, query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPT = "".join(chr(0x4E00 + i) for i in range(26))
COMMON = ("and", "the", "which", "der", "les", "of", "that")
KIND_LIST = ("person", "place", "item", "sect")
#: Letters that with a, o or i make a syllable of the target language.
WITH = {"a": "bcdghklmnprstvxoui", "o": "bcdghklmnprstvxea", "i": "bcdghklmnprstvxaou"}


def named(t: Tables) -> DataFrame:
    """(word, term, right, kind, romanisation): one of nine forms for each word."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{M}])[A-Za-z]{2,5}(?![\p{L}\p{M}])"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    n, letters = F.length("word"), F.filter(F.split("word", ""), lambda c: c != "")
    way = F.pmod(n * 7 + F.ascii("word"), F.lit(9))
    form = lambda tail: F.array_join(F.transform(letters, lambda c: F.concat(F.upper(c), F.lit(tail))), " ")
    twice = F.concat(F.upper(F.substring("word", 1, 1)), F.lit("a"))
    term = F.translate("word", LETTERS, SCRIPT)
    right = F.element_at(F.array(form("a"), form("o"), form("i"), F.lit("xoong nhỏ"), F.initcap("word"), term, F.lit("An-đê"), F.concat_ws(" ", twice, twice), F.lit("Héc Nơ")), way + 1)
    return words.select("word", term.alias("term"), right.alias("right"), F.element_at(F.array(*map(F.lit, KIND_LIST)), F.pmod(n, F.lit(4)) + 1).alias("kind"), F.transform(letters, lambda c: F.concat(c, F.lit("i"))).alias("romanisation"))


def readings(t: Tables) -> DataFrame:
    """The readings of the characters, as a table."""
    letters = t.region.select(F.explode(F.array(*map(F.lit, LETTERS))).alias("c")).distinct()
    return letters.select(F.translate("c", LETTERS, SCRIPT).alias("char"), F.array(F.concat("c", F.lit("a")), F.concat("c", F.lit("o"))).alias("readings"))


NAMES_SQL = f"""with w as (select distinct lower(x) as word from (select unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) as x from documents) where regexp_full_match(x, '[A-Za-z]{{2,5}}')),
n as (select word, length(word) as n, (length(word) * 7 + unicode(word)) % 9 as way, ['{"', '".join(KIND_LIST)}'][length(word) % 4 + 1] as kind, string_split(word, '') as l,
array_to_string(list_transform(string_split(word, ''), lambda c: upper(c) || 'a'), ' ') as reading from w),
f as (select *, [reading, replace(reading, 'a', 'o'), replace(reading, 'a', 'i'), 'xoong nhỏ', upper(word[1]) || word[2:], 'X', 'An-đê', upper(word[1]) || 'a ' || upper(word[1]) || 'a', 'Héc Nơ'][way + 1] as right_form from n)"""


@query(NAMES_SQL + """ select word, kind, (kind <> 'item' and case way when 3 then true when 5 then true when 6 then kind <> 'person' when 8 then n <> 2 and kind <> 'person' else false end) as suspect,
case when kind = 'item' or way in (0, 1, 3, 4) then case when way = 5 then 'source' else right_form end when way in (2, 5, 6) then reading
when way = 7 then case when n <> 2 and kind = 'person' then reading when n = 2 and word[1] <> word[2] then reading else right_form end
when way = 8 then case when n = 2 or kind = 'person' then reading else right_form end end as mended from f""")
def name_forms(t: Tables) -> DataFrame:
    """Doubtful forms of names, and forms mended by their characters' readings."""
    done = N.checked_names(named(t), readings(t), sounds="阿埃", surnames="赵")
    return done.select("word", "kind", "suspect", F.when(F.col("mended") == F.col("term"), "source").otherwise(F.col("mended")).alias("mended"))


def _syllable_sql(tail: str) -> str:
    return f"len(list_filter(l, lambda c: contains('{WITH[tail]}', c))) > 0"


@query(NAMES_SQL + f""" select word, case when way in (3, 5, 6, 8) then false when way = 4 then word in {COMMON} when kind = 'person' and (n <= 3 or way = 7) then false
when way = 0 then not ({_syllable_sql("a")}) when way = 1 then not ({_syllable_sql("o")}) when way = 2 then not ({_syllable_sql("i")}) else not contains('{WITH["a"]}', word[1]) end as english from f""")
def name_meanings(t: Tables) -> DataFrame:
    """Forms that are words of English."""
    return N.checked_names(named(t), readings(t), sounds="阿埃", surnames="赵", common=COMMON).select("word", "english")


@query(NAMES_SQL + """ select word, case when way = 2 and kind <> 'person' then reading end as written, way = 2 as suspect from f""")
def name_romanised(t: Tables) -> DataFrame:
    """Romanised forms: with the reading that replaces them, and those that are only doubted."""
    rows = named(t).withColumn("readings", N.readings_of(readings(t))(F.col("term")))
    args = [F.col(c) for c in ("readings", "romanisation")]
    return rows.select("word", N.pinyin_written(F.col("term"), F.col("right"), F.col("kind"), *args, "阿埃").alias("written"), N.pinyin_suspect(F.col("term"), F.col("right"), *args, "阿埃").alias("suspect"))


@query(NAMES_SQL + """, u as (select word, n, list_transform(l, lambda c: upper(c)) as u from f where n < 4) select word, case when n = 2 then u[1] || 'a ' || u[2] || 'a,' || u[1] || 'a ' || u[2] || 'o,' || u[1] || 'o ' || u[2] || 'a,' || u[1] || 'o ' || u[2] || 'o'
else array_to_string(list_transform(['a a', 'a o', 'o a', 'o o'], lambda x: u[1] || 'a ' || u[2] || x[1] || ' ' || u[3] || x[3]), ',') end as candidates from u""")
def name_candidates(t: Tables) -> DataFrame:
    """The first four combinations of readings of names of two or three characters."""
    rows = named(t).where(F.length("word") < 4)
    return rows.select("word", F.array_join(N.reading_candidates(N.readings_of(readings(t))(F.col("term"))), ",").alias("candidates"))
