"""Text cleaning and measuring. Columns wherever built-ins can say it; pandas UDFs for state machines and fixpoints.

Java's \\w and \\s know only ASCII, so patterns on words carry (?U).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and classes that cleaning has to know.
INVISIBLE = "​‌‍﻿­‎‏‪‬"
HAN = "一-鿿"
WRAPS, RARE_WRAPS = ("『〖【〔〈⦅‹«", "』〗】〕〉⦆›»"), ("⦅‹«", "⦆›»")
SENTENCE_ENDS, EMPTY_PAIR = "。！？!?", ("（(", "）)")
QUOTE_PAIRS = (("“", "”"), ("「", "」"), ("『", "』"))
MOJIBAKE = r"(?:�|Ã|Â(?=\s|[\"'.,;:!?])|â(?:€|™|œ|ž)|Ä(?:‘|’))"


def trim_unicode(c: Column) -> Column:
    """Strip all Unicode white space, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def str_count(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def quotes_balanced(c: Column, pairs: Sequence[tuple[str, str]] = QUOTE_PAIRS) -> Column:
    """Equal counts of every pair, and straight double quotes in twos."""
    ok = str_count(c, '"') % 2 == 0
    for a, b in pairs:
        ok = ok & (str_count(c, a) == str_count(c, b))
    return ok


def dense_length(c: Column) -> Column:
    """Length without white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def digits(c: Column) -> Column:
    """All runs of digits, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0))


def lines(c: Column) -> Column:
    """Lines with something in them."""
    return F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")


def sentences(c: Column) -> Column:
    """Non-blank pieces after sentence ends that white space follows."""
    return F.filter(F.split(c, r"(?U)(?<=[.!?…])\s+"), lambda x: F.trim(x) != "")


def sentence_ratio(source: Column, target: Column, stops: str = "。！？") -> Column:
    """Sentences of target for each full stop of source."""
    n = sum((str_count(source, s) for s in stops), F.lit(0))
    return F.size(sentences(target)) / F.greatest(n, F.lit(1))


def remove_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def collapse_repeats(c: Column, rounds: int = 6) -> Column:
    """Stuttered phrases of two words or more, once, however often they repeat; rounds are for phrases inside phrases."""
    for _ in range(rounds):
        c = F.regexp_replace(c, r"(?iU)\b(\w+(?:\s+\w+)+?)(?:\s+\1\b)+", "$1")
    return c


def clean_output(c: Column) -> Column:
    """Cut at the glossary block, drop fences and bold marks, collapse stutters, strip."""
    body = F.substring_index(c, "GLOSSARY_JSON", 1)
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^```\w*\s*$", ""), r"\*\*", "")
    return trim_unicode(collapse_repeats(body))


def strip_title_prefix(c: Column) -> Column:
    return trim_unicode(F.regexp_replace(c, r"^\s*第[0-9零一二三四五六七八九十百千万两]+[章节回卷]\s*[:：.、]?\s*", ""))


def dedup_key(title: Column, author: Column) -> Column:
    """NFKC, without white space, punctuation and underscores, lower case; title|author."""
    part = lambda c: F.lower(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)[\s\W_]+", ""))
    return F.concat(part(title), F.lit("|"), part(author))


def truncate_at_sentence(c: Column, n: int) -> Column:
    """At most n characters, cut behind the last sentence end if there is one."""
    head = F.substring(c, 1, n)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?…。！？])", 1)
    return F.when(F.length(c) <= n, c).when(cut != "", cut).otherwise(head)


def chunk_pack(parts: Column, limit: int) -> Column:
    """Consecutive parts joined by newlines into chunks of at most limit characters; a longer part stands alone."""

    def add(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(part) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), part)))).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(add(a, p)))


def replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, the longest wrong form first."""
    for wrong, right in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def _udf(f, kind: T.DataType = T.StringType()):  # noqa: B008
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def balance_quotes_text(text: str) -> str:
    """Within a line an opening quote that follows an open one closes it."""
    out = []
    for line in text.split("\n"):
        pieces, inside = re.split("([“”])", line), False
        for i in range(1, len(pieces), 2):
            if pieces[i] == "“" and inside:
                pieces[i] = "”"
            inside = pieces[i] == "“"
        out.append("".join(pieces))
    return "\n".join(out)


_OPEN, _CLOSE = (f"[{x}]" for x in WRAPS)
#: In order: slashes behind a sentence end, empty pairs on a line, stars inside names, runs of sentence ends, angle labels, rare wraps.
_STEPS = (
    (re.compile(rf"(?<=[{SENTENCE_ENDS}])/[ \t]*(?=\r?$)", re.M), ""),
    (re.compile(rf"^[ \t]*[{EMPTY_PAIR[0]}][ \t]*[{EMPTY_PAIR[1]}][ \t]*(?:\r?\n|\Z)", re.M), ""),
    (re.compile(rf"(?<=[{HAN}])\*(?=[{HAN}])"), ""),
    (re.compile(rf"([{SENTENCE_ENDS}])[{SENTENCE_ENDS}]+"), r"\1"),
    (re.compile(r"〈([^〈〉\n]*)〉"), r"【\1】"),
    (re.compile(rf"[{RARE_WRAPS[0]}]([{HAN}])[{RARE_WRAPS[1]}]"), r"\1"),
)
#: One Han character in brackets beside another one; the second group is empty where the first has it.
_WRAPPED = re.compile(rf"(?<=[{HAN}]){_OPEN}([{HAN}]){_CLOSE}|{_OPEN}([{HAN}]){_CLOSE}(?=[{HAN}])")


def clean_source_text(text: str) -> str:
    """Invisible characters, quotes, stray marks and brackets around single Han characters, until nothing changes."""
    text = balance_quotes_text(text.translate(dict.fromkeys(map(ord, INVISIBLE))))
    for pattern, new in _STEPS:
        text = pattern.sub(new, text)
    changes = 1
    while changes:
        text, changes = _WRAPPED.subn(lambda m: m[1] or m[2], text)
    return text.strip()


def repair_json_text(text: str) -> str:
    """Balanced JSON from a cut or badly quoted answer: stray quotes and raw breaks escaped, open brackets closed."""
    out, need, quoted, i = [], [], False, 0
    raw = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            follows = text[i + 1 :].lstrip()[:1] if quoted else ""
            if quoted and follows and follows not in ",:}]":
                out.append('\\"')
            else:
                quoted = not quoted
                out.append(c)
        elif quoted:
            out.append(raw.get(c, c))
        else:
            out.append(c)
            if c in "{[":
                need.append({"{": "}", "[": "]"}[c])
            elif c in "}]":
                if need:
                    need.pop()
                if not need:
                    break
        i += 1
    return "".join(out) + '"' * quoted + "".join(reversed(need))


def split_sentences_text(text: str, limit: int = 120) -> list[str]:
    """Sentences, ends inside quotes not counted; longer ones cut at clause marks, then hard, never inside an ASCII word."""
    out, held, depth = [], [], 0
    for piece in re.split("([。！？!?….\n“”「」『』])", text):
        held.append(piece)
        if piece in "“「『" and piece:
            depth += 1
        elif piece in "”」』" and piece:
            depth = max(0, depth - 1)
        elif piece == "\n" or piece and piece in "。！？!?…." and not depth:
            out.append("".join(held))
            held = []
    out.append("".join(held))
    cut = []
    for s in out:
        while len(s) > limit:
            at = max((m.end() for m in re.finditer("[，、；,;:：]", s[:limit])), default=0)
            if not at:
                at = limit
                while at > 1 and re.match(r"[A-Za-z0-9]{2}", s[at - 1 : at + 1]):
                    at -= 1
                at = at if at > 1 else limit
            cut.append(s[:at])
            s = s[at:]
        cut.append(s)
    return [s.strip() for s in cut if s.strip()]


def similarity_texts(a: str, b: str) -> float:
    """Ratio of matching blocks of two texts without white space, in lower case."""
    x, y = ("".join(t.split()).lower() for t in (a, b))
    return SequenceMatcher(None, x, y, autojunk=False).ratio()


balance_quotes, clean_source, repair_json = _udf(balance_quotes_text), _udf(clean_source_text), _udf(repair_json_text)
nfkc = _udf(lambda s: normalize("NFKC", s))
unescaped_parts = _udf(lambda a: [unescape(x) for x in a], T.ArrayType(T.StringType()))
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"  # as in Python's html module
split_sentences = _udf(split_sentences_text, T.ArrayType(T.StringType()))


def unescape_html(c: Column) -> Column:
    """html.unescape() of a column; entities alone go to Python, not the texts around them."""
    found, c = unescaped_parts(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))), c.cast("string")
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(F.zip_with(F.split(c, ENTITY), found, lambda x, e: F.concat(x, F.coalesce(e, F.lit("")))), ""))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity_texts(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def character_places(text: str) -> dict[str, int]:
    """Of each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(places: dict[str, int], size: int, y: str) -> int:
    """Length of the longest common subsequence of y and a text of that size, of which places has the character_places.

    One addition a character of y over the bits of the whole text (Hyyro 2004).
    """
    left = (1 << size) - 1
    for c in y:
        if met := left & places.get(c, 0):
            left = (left + met) | (left - met)
    return size - (left & (1 << size) - 1).bit_count()


def matched_length(x: str, y: str, q: int = 6) -> int:
    """Characters in the blocks that SequenceMatcher matches without junk, ties as there.

    Blocks of q characters or more are found by runs of q, of which few places of y have the same; other gaps are left to it.
    """
    places: dict[str, list[int]] = {}
    for j in range(len(y) - q + 1):
        places.setdefault(y[j : j + q], []).append(j)
    total, left = 0, [(0, len(x), 0, len(y))]
    while left:
        x0, x1, y0, y1 = left.pop()
        best, at, to, ends = 0, 0, 0, {}
        for i in range(x0, x1 - q + 1):
            now = {}
            for j in places.get(x[i : i + q], ()):
                if j > y1 - q:
                    break
                if j >= y0:
                    now[j] = n = ends.get(j - 1, 0) + 1
                    if n > best:
                        best, at, to = n, i - n + 1, j - n + 1
            ends = now
        if best:
            size = best + q - 1
            total += size
            left += [(x0, at, y0, to), (at + size, x1, to + size, y1)]
        elif x0 < x1 and y0 < y1:
            total += sum(b.size for b in SequenceMatcher(None, x[x0:x1], y[y0:y1], autojunk=False).get_matching_blocks())
    return total


def similarity_from(least: float, long: int = 10_000):
    """similarity, null below least; upper bounds settle most pairs before blocks are matched.

    Matched blocks are a common subsequence, so the longest one bounds the ratio; of texts beyond `long` characters the
    characters in common do.
    """

    def one(a: str, b: str, places) -> float | None:
        x, y = ("".join(t.split()).lower() for t in (a, b))
        total = len(x) + len(y)
        if total and 2.0 * min(len(x), len(y)) / total < least:
            return None
        if total and len(y) <= long and 2.0 * common_length(places(y), len(y), x) / total < least:
            return None
        if len(y) > long and SequenceMatcher(None, x, y, autojunk=False).quick_ratio() < least:
            return None
        return r if (r := 2.0 * matched_length(x, y) / total if total else 1.0) >= least else None

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        places = lru_cache(maxsize=32)(character_places)
        return pd.Series([None if x is None or y is None else one(x, y, places) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run.asNondeterministic()  # else a filter on it is pushed down and it runs twice
