"""Bilingual glossary: readings, term eligibility, protection by codes and adherence."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def han_viet(term: Column, readings: Column) -> Column:
    """First reading of every character, capitalised; null if one lacks a reading. readings: map<char, array<string>>."""
    parts = F.transform(F.filter(F.split(term, ""), lambda c: c != ""), lambda c: F.initcap(F.get(F.try_element_at(readings, c), F.lit(0))))
    return F.when((F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isNull()), F.concat_ws(" ", parts))


def reading_candidates(term: str, readings: dict[str, Sequence[str]], cap: int = 4) -> list[str]:
    """Combinations of readings in order, distinct, cap at most; none if a character has no reading."""
    if not term or any(not readings.get(c) for c in term):
        return []
    seen = dict.fromkeys(" ".join(w.capitalize() for w in combo) for combo, _ in zip(product(*(readings[c] for c in term)), range(6 * cap), strict=False))
    return list(seen)[:cap]


def contained(terms: DataFrame, term: str, texts: DataFrame, text: str, q: int = 2) -> DataFrame:
    """Rows of texts with each row of terms whose term they contain; every text contains an empty term.

    No theta join: a term's first q characters, or all of a shorter one, meet the distinct runs of up to q characters of
    the texts, then containment is tested.
    """
    keyed = terms.withColumn("_k", F.substring(term, 1, q))
    wanted = F.col(text)

    def runs_of(k: int) -> Column:
        return F.when(F.length(wanted) >= k, F.transform(F.sequence(F.lit(1), F.length(wanted) - (k - 1)), lambda i: F.substr(wanted, i, F.lit(k))))

    none = F.array().cast("array<string>")
    grams = F.when(wanted.isNotNull(), F.array_distinct(F.concat(F.array(F.lit("")), *(F.coalesce(runs_of(k), none) for k in range(1, q + 1)))))
    rows = texts.withColumn("_k", F.explode(grams))
    return rows.join(keyed, "_k").where(F.contains(text, term)).drop("_k")


def eligible_terms(terms: DataFrame, docs: DataFrame, group: str, text: str, min_length: int = 2) -> DataFrame:
    """(group, doc columns, term): terms contained in the texts of their group or of none.

    Own and global terms are two equi-joins and a union: on the group, and on the texts' bigrams. Doubtful terms count only
    where a column `approved` says so.
    """
    sure = F.coalesce(F.col("note"), F.lit("")) != "doubtful"
    sure = sure | F.coalesce(F.col("approved"), F.lit(False)) if "approved" in terms.columns else sure
    usable = terms.where((F.length("term") >= min_length) & sure)
    own = docs.join(usable.where(F.col(group).isNotNull()), group).where(F.contains(text, "term"))
    return own.unionByName(contained(usable.where(F.col(group).isNull()).drop(group), "term", docs, text))


def adherence(source: Column, target: Column, terms: Sequence[tuple[str, str, str | None]]) -> tuple[Column, Column]:
    """(ok, applicable) of (source term, right form, wrong form): applicable where the source has the term."""
    ok = applicable = F.lit(0)
    for term, right, wrong in terms:
        here = F.contains(source, F.lit(term))
        good = F.contains(F.lower(target), F.lit(right.lower()))
        if wrong:
            good = good & ~F.contains(F.lower(target), F.lit(wrong.lower()))
        applicable = applicable + here.cast("int")
        ok = ok + (here & good).cast("int")
    return ok, applicable


CASCADES = ("JWZF", "ZX{:03d}Q", "[[{}]]", "QQ{}QQ", "#{}#", "XK{}X")


def protect(text: str, terms: Sequence[str], scheme: str) -> tuple[str, dict[str, str]]:
    """text with each term (longest first) replaced by a code between spaces, and the codes."""
    codes: dict[str, str] = {}
    for i, term in enumerate(sorted(set(terms), key=lambda t: (-len(t), t))):
        if term and term in text:
            code = scheme.format(i + 1) if "{" in scheme else f"{scheme}{i + 1}"
            codes[code] = term
            text = text.replace(term, f" {code} ")
    return text, codes


def restore(text: str, codes: dict[str, str], right: dict[str, str], expected: dict[str, int]) -> str | None:
    """Codes replaced by right forms; None unless each came back as often as it went."""
    for code in sorted(codes, key=len, reverse=True):
        pattern = re.compile(rf"\s*{re.escape(code)}(?![0-9])\s*")
        if len(pattern.findall(text)) != expected[code]:
            return None
        text = pattern.sub(lambda m, c=code: f" {right[codes[c]]} ", text)
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r" {2,}", " ", text)).strip()


def translate_guarded(text: str, terms: dict[str, str], translate: Callable[[str], str], cascades: Sequence[str] = CASCADES) -> tuple[str, bool]:
    """Translate with terms kept: the first scheme whose codes all survive; else the plain translation and False."""
    for scheme in cascades:
        coded, codes = protect(text, list(terms), scheme)
        expected = {c: len(re.findall(re.escape(c) + r"(?![0-9])", coded)) for c in codes}
        done = restore(translate(coded), codes, terms, expected)
        if done is not None:
            return done, True
    return translate(text), False


def repair_numbers(source: str, target: str) -> str:
    """Put the source's numbers in their places where both sides have as many; not where large units follow."""
    if re.search(r"\d\s*[万亿]", source):
        return target
    found = re.findall(r"\d+", source)
    if len(found) != len(re.findall(r"\d+", target)):
        return target
    numbers = iter(found)
    return re.sub(r"\d+", lambda m: next(numbers), target)
