"""Term guard: glossary terms that a translation must keep, as columns of lines.

with_held_terms() finds a line's terms in one pass of an automaton over all of the glossary (bounded and broadcast; a
larger one is joined). guarded() translates plainly first; lines that lack a right form or a number are tried again with
their terms as codes, one family of codes after another, and the first try in which every code came back as often as it
went is taken. A line that no family saves keeps its plain translation.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import islice, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.glossary import contained
from quillspark.sources.sinks import settled

HELD = "array<struct<term:string,right:string,approved:boolean,n:int>>"
MARKS = "array<struct<code:string,right:string,n:int>>"
_HELD = pa.list_(pa.struct([("term", pa.string()), ("right", pa.string()), ("approved", pa.bool_()), ("n", pa.int32())]))
_MARKS = pa.list_(pa.struct([("code", pa.string()), ("right", pa.string()), ("n", pa.int32())]))

# Letters of codes, what must not stand beside a code, marks of a broken one, numbers and their units.
RARE, CAPITALS = "JWZF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BESIDE = {"long": CAPITALS + "0123456789", "rare": RARE, "bracket": "⟦" + CAPITALS + "0123456789" + "⟧"}
LEFTOVER = "ZX[A-Z0-9]{0,4}Q|⟦|⟧"
_GAP = r"[ \t]*"
#: Patterns of a family's codes, longer ones first: a first letter, behind a place that no code may touch, and group 1, the
#: others. The first letter leads, so that a search goes from one to the next.
_SHAPES = {
    family: [re.compile(rf"{first}(?<![{re.escape(BESIDE[family])}]{first})(?=({_GAP}{_GAP.join(others)})(?![{re.escape(BESIDE[family])}]))") for first, *others in shapes]
    for family, shapes in {"long": [["Z", "X", *3 * ["[A-Z]"], "Q"]], "rare": [n * [f"[{RARE}]"] for n in (4, 3, 2)], "bracket": [["⟦", *3 * ["[A-Z]"], "⟧"]]}.items()
}
NUMBER, UNITS = r"\d+(?:\.\d+)?%?", "万亿"
RATIO, RATIO_WORD = r"(\d+(?:\.\d+)?)比(\d+(?:\.\d+)?)", "trên"
#: (family, approved terms only), in the order of the tries.
CASCADES = (("long", False), ("rare", False), ("bracket", False), ("long", True), ("rare", True), ("bracket", True))
DOUBTFUL = "nghi sai"
MOST_CODES, MOST_TERMS = 1000, 100_000


def codes(family: str) -> Iterator[str]:
    """The codes of a family in order."""
    if family == "rare":
        yield "JW"
        yield from (c for n in (2, 3, 4) for c in map("".join, product(RARE, repeat=n)) if c != "JW")
    else:
        head, tail = {"long": ("ZX", "Q"), "bracket": ("⟦", "⟧")}[family]
        yield from (f"{head}{''.join(body)}{tail}" for body in islice(product(CAPITALS, repeat=3), MOST_CODES))


def _dicts(lists: pa.ListArray) -> list[list[dict] | None]:
    """The lists of structs as to_pylist() gives them, field by field, at a tenth of its time."""
    rows, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).tolist()
    names = [f.name for f in rows.type]
    fields = [c.to_numpy(zero_copy_only=False).tolist() for c in rows.flatten()]
    held = [dict(zip(names, x, strict=True)) for x in zip(*fields, strict=True)]
    return [None if null else held[i:j] for null, i, j in zip(lists.is_null().to_pylist(), ends, ends[1:], strict=False)]


def usable_terms(terms: DataFrame, group: str | None = None) -> DataFrame:
    """(group,) term, right, approved of terms(term, right, approved, note): trimmed, of two characters or more, with a right
    form and not doubted; of one term approved rows go first, then the least right form."""
    note = F.col("note") if "note" in terms.columns else F.lit(None).cast("string")
    rows = terms.withColumns({"term": X.trim_unicode(F.col("term")), "right": X.trim_unicode(F.col("right")), "approved": F.coalesce(F.col("approved"), F.lit(False))})
    rows = rows.where((F.length("term") >= 2) & (F.col("right") != "") & ~F.contains(F.coalesce(note, F.lit("")), F.lit(DOUBTFUL)))
    best = F.min(F.struct((~F.col("approved")).alias("pending"), "right"))
    return rows.groupBy(*filter(None, [group]), "term").agg(best.alias("b")).select(*filter(None, [group]), "term", "b.right", (~F.col("b.pending")).alias("approved"))


def _priority(term: str, approved: bool) -> tuple:
    return (not approved, -len(term), term)


_AUTOMATA: dict[str, object] = {}


def _shared(spark, rows: list[tuple]):
    """Rows (group, term, right, approved) for all workers, under a name that no other glossary has."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, rows))


def _automaton(shared):
    """One automaton a worker, of the glossary used last; a term's value is {group: (right, approved)}."""
    name, rows = shared.value
    if name not in _AUTOMATA:
        import ahocorasick

        table: dict[str, dict] = {}
        for group, term, right, approved in rows:
            table.setdefault(term, {})[group] = (right, approved)
        found = ahocorasick.Automaton()
        for term, value in table.items():
            found.add_word(term, (term, value))
        found.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = found
    return _AUTOMATA[name]


def held_in(text: str, group, automaton) -> list[dict]:
    """Terms of the group or of none that text contains, approved ones first, then longer ones; a group's own form wins."""
    found = {}
    for _, (term, value) in automaton.iter(text) if len(automaton) else ():
        if term not in found and (own := value.get(group) or value.get(None)):
            found[term] = own
    rows = [{"term": t, "right": r, "approved": a, "n": text.count(t)} for t, (r, a) in found.items()]
    return sorted(rows, key=lambda r: _priority(r["term"], r["approved"]))


def with_held_terms(lines: DataFrame, terms: DataFrame, text: str, group: str | None = None, keys: Sequence[str] = (), most: int = MOST_TERMS) -> DataFrame:
    """lines and held: their usable terms with the number of their occurrences, in the order in which they are replaced.

    group: a column of both; terms with a null group belong to all. Up to `most` terms are broadcast. Beyond that lines and
    terms are joined on pairs of characters, and `keys` must tell lines apart. Null texts hold nothing.
    """
    usable = usable_terms(terms, group)
    rows = usable.select((F.col(group) if group else F.lit(None)).cast("string"), "term", "right", "approved").limit(most + 1).collect()
    if len(rows) > most:
        return _joined_terms(lines, usable, text, group, list(keys))
    shared = _shared(lines.sparkSession, [tuple(r) for r in rows])

    def run(texts: pa.Array, groups: pa.Array) -> pa.Array:
        automaton = _automaton(shared)
        return pa.array([held_in(t, g, automaton) if t else [] for t, g in zip(texts.to_pylist(), groups.to_pylist(), strict=True)], _HELD)

    return lines.withColumn("held", F.arrow_udf(run, HELD)(F.col(text), (F.col(group) if group else F.lit(None)).cast("string")))


def _joined_terms(lines: DataFrame, usable: DataFrame, text: str, group: str | None, keys: list[str]) -> DataFrame:
    if not keys:
        raise ValueError("a glossary of this size is joined, and that needs keys of lines")
    slim = lines.select(*keys, text, *([F.col(group).alias("_g")] if group and group not in keys else []))
    own = F.col(group if group in keys else "_g") if group else None
    terms = usable.withColumnRenamed(group, "_of") if group else usable.withColumn("_of", F.lit(None))
    met = contained(terms, "term", slim, text)
    met = met.where(F.col("_of").isNull() | (F.col("_of") == own)) if group else met
    times = ((F.length(text) - F.length(F.replace(F.col(text), F.col("term"), F.lit("")))) / F.length("term")).cast("int")
    best = met.groupBy(*keys, "term").agg(F.min(F.struct(F.col("_of").isNull().alias("shared"), "right", "approved")).alias("b"), F.first(times).alias("n"))
    one = F.struct((~F.col("b.approved")).alias("p"), (-F.length("term")).alias("l"), "term", F.col("b.right").alias("right"), F.col("b.approved").alias("approved"), F.col("n").cast("int").alias("n"))
    held = best.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("h"))
    held = held.select(*keys, F.transform("h", lambda x: F.struct(x["term"].alias("term"), x["right"].alias("right"), x["approved"].alias("approved"), x["n"].alias("n"))).alias("held"))
    return lines.join(held, keys, "left").withColumn("held", F.coalesce("held", F.array().cast(HELD)))


@lru_cache(1 << 17)
def _has_digits(value: str) -> bool:
    return any(c.isdigit() for c in value)


def occurrences_in(text: str, value: str, folded: str | None = None) -> int:
    """A value with digits counts between other digits only; words are case-blind. folded: text.casefold(), if it is there."""
    if _has_digits(value):
        return len(re.findall(rf"(?<!\d){re.escape(value)}(?!\d)", text))
    return (text.casefold() if folded is None else folded).count(value.casefold())


def _may_have_digits(text: str) -> bool:
    return not text.isascii() or any(map(text.__contains__, "0123456789"))


def numbers_kept(source: str, target: str) -> tuple[str, bool]:
    """target with the source's numbers in their places, and whether both have as many; nothing is put where a large unit
    follows in the source. A ratio that the target has with a mark gets its word."""
    if not _may_have_digits(source) and not _may_have_digits(target):
        return target, True
    there, here = list(re.finditer(NUMBER, source)), list(re.finditer(NUMBER, target))
    if len(there) != len(here):
        return target, False
    out, at = [], 0
    for a, b in zip(there, here, strict=True):
        kept = b[0] if source[a.end() : a.end() + 1] in tuple(UNITS) else a[0]
        out += [target[at : b.start()], kept]
        at = b.end()
    done = "".join([*out, target[at:]])
    for m in re.finditer(RATIO, source):
        a, b = m.groups()
        done = re.sub(rf"(?<!\d){re.escape(a)}\s*[-:：/]\s*{re.escape(b)}(?!\d)", f"{a} {RATIO_WORD} {b}", done, count=1)
    return done, True


def _own_numbers(source: str) -> list[dict]:
    """Numbers of two characters or more without a unit behind, as terms that stay themselves."""
    found = dict.fromkeys(m[0] for m in re.finditer(NUMBER, source) if len(m[0]) >= 2 and source[m.end() : m.end() + 1] not in tuple(UNITS))
    return [{"term": x, "right": x, "approved": True, "n": source.count(x)} for x in found]


def lacking(source: str, target: str, held: list[dict]) -> tuple[str, bool, list[dict]]:
    """target with its numbers mended, whether they are all there, and the terms whose right form it lacks."""
    mended, kept = numbers_kept(source, target)
    terms = {t["term"]: t for t in [*([] if kept else _own_numbers(source)), *held][::-1]}  # the first of a term counts
    folded = mended.casefold() if terms else ""
    needed = [t for t in terms.values() if occurrences_in(mended, t["right"], folded) < t["n"]]
    return mended, kept, sorted(needed, key=lambda t: _priority(t["term"], t["approved"]))


def protect(source: str, needed: list[dict], family: str) -> tuple[str, list[dict]]:
    """source with each term as a code between spaces, and what the codes stand for; (source, []) if no codes can be told
    apart. Terms come in their order and take places that no term before has taken; codes that source has are left out."""
    taken, places, marks = bytearray(len(source)), [], []
    for t, code in zip(needed, (c for c in codes(family) if c not in source), strict=False):
        term = t["term"]
        if any([term in m["code"] for m in marks]):
            return source, []
        at, n, size = source.find(term), 0, len(term)
        while at >= 0:
            if free := taken.find(1, at, at + size) < 0:
                taken[at : at + size] = b"\1" * size
                places.append((at, at + size, code))
                n += 1
            at = source.find(term, at + (size if free else 1))
        if n:
            marks.append({"code": code, "right": t["right"], "n": n})
    out, at = [], 0
    for first, last, code in sorted(places):
        out += [source[at:first], f" {code} "]
        at = last
    return "".join([*out, source[at:]]), marks


def codes_in(raw: str, family: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, code) of all that looks like a code of the family, overlapping ones and those with spaces between letters
    too, by start and then longer ones first. The patterns are the family's, so a line compiles none of its own."""
    met = [(m.start(), m.end(1), (m[0] + m[1]).replace(" ", "").replace("\t", "")) for pattern in _SHAPES[family] for m in pattern.finditer(raw)]
    return iter(sorted(met, key=lambda x: (x[0], -x[1])))


def restore(raw: str, marks: list[dict], family: str) -> str | None:
    """raw with codes as right forms, also where spaces came between their letters; None if one didn't come back as often."""
    right, counts, ends = {m["code"]: m["right"] for m in marks}, {}, {}
    out, at = [], 0
    for start, end, code in codes_in(raw, family) if marks else ():
        if code not in right:
            continue
        if start >= ends.get(code, 0):
            counts[code], ends[code] = counts.get(code, 0) + 1, end
        if start >= at:
            out += [raw[at:start], right[code]]
            at = end
    if any(counts.get(m["code"], 0) != m["n"] for m in marks):
        return None
    return re.sub(r"[ \t]{2,}", " ", "".join([*out, raw[at:]])).strip()


def lacking_of(source: Column, target: Column, held: Column) -> Column:
    """struct<target, kept, needed> of a line, null where it or its translation is.

    Declared nondeterministic, which it isn't: a filter on it would else be pushed below and run it, and what it reads, twice.
    """
    kind = pa.struct([("target", pa.string()), ("kept", pa.bool_()), ("needed", _HELD)])

    def run(s: pa.Array, t: pa.Array, h: pa.Array) -> pa.Array:
        rows = zip(s.to_pylist(), t.to_pylist(), _dicts(h), strict=True)
        return pa.array([None if a is None or b is None else dict(zip(("target", "kept", "needed"), lacking(a, b, c or []), strict=True)) for a, b, c in rows], kind)

    return F.arrow_udf(run, f"struct<target:string,kept:boolean,needed:{HELD}>").asNondeterministic()(source, target, held)


def protected(source: Column, needed: Column, family: str) -> Column:
    """struct<text, marks>; null where source is."""
    kind = pa.struct([("text", pa.string()), ("marks", _MARKS)])

    def run(s: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if a is None else dict(zip(("text", "marks"), protect(a, b or [], family), strict=True)) for a, b in zip(s.to_pylist(), _dicts(n), strict=True)], kind)

    return F.arrow_udf(run, f"struct<text:string,marks:{MARKS}>")(source, needed)


def restored(raw: Column, marks: Column, family: str) -> Column:
    """The text with right forms, null where a code got lost or there is no text."""

    def run(r: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([None if a is None else restore(a, b or [], family) for a, b in zip(r.to_pylist(), _dicts(m), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(raw, marks)


def guarded(lines: DataFrame, text: str, translate: Callable[[Column], Column], held: str = "held", keep: Sequence[str] | None = None) -> DataFrame:
    """lines with guarded (the translation), way (the try that was taken from 1, 0 for plain, null text: null) and lacks (terms
    the plain translation lacked).

    translate gives the translation of a column of lines and null for null; it may use other columns of lines. All lines
    are translated once, which is written; only those that lack something go through the tries, each with what is left and
    written, until nothing is. keep: the columns of lines that come back, all if not given; translate may use these and text.
    """
    names = list(lines.columns if keep is None else keep)
    found = lacking_of(F.col(text), translate(F.col(text)), F.col(held))
    first = settled(lines.select(*dict.fromkeys([*names, text]), found.alias("_l")))
    good = ~F.coalesce(~F.col("_l.kept") | (F.size("_l.needed") > 0), F.lit(False))
    done = first.where(good).select(*names, F.col("_l.target").alias("guarded"), F.when(F.col("_l.target").isNotNull(), 0).alias("way"), F.when(F.col("_l.target").isNotNull(), 0).alias("lacks"))
    rest, ends = first.where(~good), [done]
    kept = lambda df, way, out: df.select(*names, out.alias("guarded"), way.alias("way"), F.size("_l.needed").alias("lacks"))
    plain = F.col("_l.target")
    for i, (family, approved) in enumerate(CASCADES, 1):
        needed = F.filter("_l.needed", lambda t: t["approved"]) if approved else F.col("_l.needed")
        if approved and not CASCADES[i - 2][1]:
            ends.append(kept(rest.where(F.size(needed) == 0), F.lit(0), plain))
            rest = rest.where(F.size(needed) > 0)
        tried = rest.withColumn("_p", protected(F.col(text), needed, family))
        tried = settled(tried.withColumn("_t", restored(translate(F.col("_p.text")), F.col("_p.marks"), family)).drop("_p"))
        broken = F.col("_t").rlike(LEFTOVER) & ~plain.rlike(LEFTOVER)
        ends.append(kept(tried.where("_t is not null"), F.when(broken, 0).otherwise(i), F.when(broken, plain).otherwise(F.col("_t"))))
        rest = tried.where("_t is null").drop("_t")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, ends)
    return reduce(DataFrame.unionByName, [*ends, kept(rest, F.lit(0), plain)])


def guarded_texts(docs: DataFrame, id_col: str, text: str, terms: DataFrame, translate: Callable[[Column], Column], group: str | None = None) -> DataFrame:
    """(id, guarded): whole texts, line by line; ids tell texts apart. Null texts stay null, a text has as many lines as before."""
    lines = docs.select(id_col, *filter(None, [group if group != id_col else None]), F.posexplode_outer(F.split(text, "\n")).alias("line", "source"))
    done = guarded(with_held_terms(lines, terms, "source", group, (id_col, "line")), "source", translate)
    rows = done.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line", "guarded"))).alias("all"), F.count("source").alias("n"))
    return rows.select(id_col, F.when(F.col("n") > 0, F.array_join(F.transform("all", lambda x: x["guarded"]), "\n", "")).alias("guarded"))


def covered(text: str, automaton) -> list[dict]:
    """Occurrences of terms that don't overlap: longer terms first, among equals the first in code-point order and place."""
    met = sorted((-len(term), term, end + 1 - len(term)) for end, (term, _) in automaton.iter(text)) if len(automaton) else []
    taken, out = bytearray(len(text)), []
    for size, term, at in met:
        if not any(taken[at : at - size]):
            taken[at : at - size] = b"\1" * -size
            out.append({"start": at, "term": term})
    return sorted(out, key=lambda o: o["start"])


def covered_terms(lines: DataFrame, terms: DataFrame, text: str, most: int = MOST_TERMS) -> DataFrame:
    """lines and covered: array<struct<start, term>> of occurrences that don't overlap, from 0. terms: term; most at most."""
    rows = [r[0] for r in terms.select("term").where("term <> ''").distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    shared = _shared(lines.sparkSession, [(None, t, t, True) for t in rows])

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(shared)
        return pa.array([covered(t, automaton) if t else [] for t in texts.to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("term", pa.string())])))

    return lines.withColumn("covered", F.arrow_udf(run, "array<struct<start:int,term:string>>")(F.col(text)))
