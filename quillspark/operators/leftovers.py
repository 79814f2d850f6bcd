"""Leftover script in translated lines: replaced by glossary forms, then by readings, with spaces where words would run together.

The glossary is the automaton of the term guard, the readings a table of characters; both are bounded and broadcast. A word
of two senses takes the one that its sentence tells.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.names import MOST_CHARACTERS
from quillspark.operators.termguard import MOST_TERMS, _automaton, _shared, usable_terms


class Sense(NamedTuple):
    """plain, unless wrapped (before it), suffix (behind it) or context (in the sentence) say item and action doesn't speak against it."""

    plain: str
    item: str
    action: re.Pattern
    context: re.Pattern
    wrapped: re.Pattern
    suffix: re.Pattern


# The word of two senses, and what tells them apart.
SENSES = {
    "鲜血": Sense(
        "máu tươi", "Tiên Huyết", re.compile(r"\b(?:chảy|phun|trào|tuôn|rỉ|ứa|nhỏ|bắn|văng|phun ra|trào ra|ho ra|nôn ra|ọc ra|mất máu|vết thương|miệng|mũi|khóe môi|cơ thể|thi thể|nhuộm đỏ|đầm đìa)\b", re.I),
        re.compile(r"\b(?:vật phẩm|nguyên liệu|đạo cụ|đan dược|linh dược|bình|lọ|thu thập|luyện chế|phẩm cấp|kho đồ|túi đồ|trang bị|nhận được|phần thưởng|công thức|dược liệu|tên gọi)\b", re.I),
        re.compile(r"[《〈「『【\[（(]\s*$"), re.compile(r"^\s*(?:丹|丸|瓶|精华|药|液|晶|石|符|剑|刀|珠|草|花|果)"),
    )
}
HAN = "一-鿿㐀-䶿"
SENTENCE_ENDS = ".!?。！？;；\n"
_RUN, _ONE, _SENSES = re.compile(f"[{HAN}]+"), re.compile(f"[{HAN}]"), re.compile("|".join(map(re.escape, SENSES)))


def sense(text: str, start: int, end: int, s: Sense) -> str:
    """The form that the sentence around [start, end) tells."""
    left = max(text.rfind(c, 0, start) for c in SENTENCE_ENDS) + 1
    right = min((i for c in SENTENCE_ENDS if (i := text.find(c, end)) >= 0), default=len(text))
    if s.action.search(text, left, right):
        return s.plain
    named = s.wrapped.search(text[left:start]) or s.suffix.search(text[end:right]) or s.context.search(text, left, right)
    return s.item if named else s.plain


def put(text: str, places: list[tuple[int, int, str]]) -> str:
    """text with [start, end) of each place replaced, a space where letters or digits would touch, and no doubled spaces.

    places are in the order in which they are replaced: beside a place that comes later what it replaces counts, one that
    came before has seen to its own space.
    """
    order = {p[:2]: i for i, p in enumerate(places)}
    starts, ends = {p[0]: i for p, i in order.items()}, {p[1]: i for p, i in order.items()}
    out, at = [], 0
    for start, end, new in sorted(places):
        mine = order[start, end]
        lead = new[:1].isalnum() and text[start - 1 : start].isalnum() and start > 0 and ends.get(start, mine) >= mine
        trail = new[-1:].isalnum() and text[end : end + 1].isalnum() and starts.get(end, mine) >= mine
        out += [text[at:start], " " * lead, new, " " * trail]
        at = end
    return re.sub(r"[ \t]{2,}", " ", "".join([*out, text[at:]]))


def by_glossary(text: str, automaton, group=None) -> tuple[str, int]:
    """text with terms of the source's script replaced, longer terms first, and how many were."""
    met = {}
    for end, (term, value) in automaton.iter(text) if len(automaton) else ():
        if _ONE.search(term) and (own := value.get(group) or value.get(None)):
            met[end + 1 - len(term), end + 1] = (term, own[0])
    taken, places = bytearray(len(text)), []
    for (a, b), (term, right) in sorted(met.items(), key=lambda m: (m[0][0] - m[0][1], m[1][0], m[0])):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            places.append((a, b, sense(text, a, b, SENSES[term]) if term in SENSES else right))
    return put(text, places), len(places)


def by_readings(text: str, readings: dict[str, str]) -> tuple[str, int]:
    """text with what is left of the script read character by character, and how many characters were; unknown ones stay,
    words of two senses take theirs."""
    if not _SENSES.search(text):
        return _by_runs(text, readings)
    places, n = [], 0
    for run in _RUN.finditer(text):
        at = run.start()
        for word in (*_SENSES.finditer(run[0]), None):
            end = run.start() + word.start() if word else run.end()
            if raw := text[at:end]:
                n += sum(c in readings for c in raw)
                places.append((at, end, " ".join(readings.get(c, c) for c in raw)))
            if word:
                at = run.start() + word.end()
                n += len(word[0])
                places.append((end, at, sense(text, end, at, SENSES[word[0]])))
    return put(text, places), n


def _by_runs(text: str, readings: dict[str, str]) -> tuple[str, int]:
    """by_readings of a text without words of two senses: no place touches another, and equal runs are read once."""
    known, n = {}, 0

    def read(run: re.Match) -> str:
        nonlocal n
        raw, (start, end) = run[0], run.span()
        if raw not in known:
            new = " ".join(readings.get(c, c) for c in raw)
            known[raw] = new, sum(c in readings for c in raw), new[:1].isalnum(), new[-1:].isalnum()
        new, times, lead, trail = known[raw]
        n += times
        lead = lead and start > 0 and text[start - 1].isalnum()
        trail = trail and text[end : end + 1].isalnum()
        return f"{' ' * lead}{new}{' ' * trail}"

    return re.sub(r"[ \t]{2,}", " ", _RUN.sub(read, text)), n


def without_leftovers(lines: DataFrame, text: str, terms: DataFrame, readings: DataFrame, group: str | None = None) -> DataFrame:
    """lines with `text` replaced, and by_terms, by_reading (how many terms and characters) and left (whether script is left).

    terms: as of the term guard, usable_terms(), at most MOST_TERMS; doubted ones are left to the readings. readings: char,
    readings; the first one counts, capitalised. Null texts stay null. All other columns stay as they are.
    """
    spark = lines.sparkSession
    rows = usable_terms(terms, group).select((F.col(group) if group else F.lit(None)).cast("string"), "term", "right", "approved").where(F.col("term").rlike(f"[{HAN}]")).limit(MOST_TERMS + 1).collect()
    known = readings.groupBy("char").agg(F.min("readings").alias("r")).limit(MOST_CHARACTERS + 1).collect()
    if len(rows) > MOST_TERMS or len(known) > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_TERMS} terms or {MOST_CHARACTERS} characters")
    shared = _shared(spark, [tuple(r) for r in rows] + [(None, w, s.plain, False) for w, s in SENSES.items()])
    table = spark.sparkContext.broadcast({r["char"]: r["r"][0].capitalize() for r in known if r["r"]})
    kind = pa.struct([("text", pa.string()), ("by_terms", pa.int32()), ("by_reading", pa.int32())])

    def run(texts: pa.Array, groups: pa.Array) -> pa.Array:
        def one(t, g):
            if t is None:
                return {"text": None, "by_terms": 0, "by_reading": 0}
            t, n = by_glossary(t, automaton, g) if _ONE.search(t) else (t, 0)
            t, m = by_readings(t, table.value) if _ONE.search(t) else (t, 0)
            return {"text": t, "by_terms": n, "by_reading": m}

        automaton = _automaton(shared)
        return pa.array([one(t, g) for t, g in zip(texts.to_pylist(), groups.to_pylist(), strict=True)], kind)

    found = F.arrow_udf(run, "struct<text:string,by_terms:int,by_reading:int>")(F.col(text), (F.col(group) if group else F.lit(None)).cast("string"))
    done = lines.withColumn("_l", found)
    return done.select(*(F.col("_l.text").alias(c) if c == text else c for c in lines.columns), "_l.by_terms", "_l.by_reading", F.coalesce(F.col("_l.text").rlike(f"[{HAN}]"), F.lit(False)).alias("left"))


def padded(before: Column, new: Column, behind: Column) -> Column:
    """new with a space on the side where letters or digits of both would touch."""
    word = r"[\p{L}\p{N}]"
    lead = F.when(before.rlike(word + r"\z") & new.rlike(r"\A" + word), " ").otherwise("")
    return F.concat(lead, new, F.when(behind.rlike(r"\A" + word) & new.rlike(word + r"\z"), " ").otherwise(""))
