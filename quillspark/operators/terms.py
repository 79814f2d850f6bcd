"""Glossary maintenance: what to do with each proposed or stored term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import frames as R

KINDS, DOUBTFUL = ("person", "place", "sect"), "doubtful"


def prepared(terms: DataFrame, reading: str = "reading") -> DataFrame:
    """Proposed terms (term, right, kind, reading) worth keeping, trimmed, with a note where the form isn't the reading."""
    term, right = X.trim_unicode(F.col("term")), X.trim_unicode(F.col("right"))
    rows = terms.withColumns({"term": term, "right": right})
    sound = F.col("term").rlike(f"[{X.HAN}]") & (F.length("term") >= 2) & (F.col("right") != "") & ~F.col("right").rlike(f"[{X.HAN}]") & F.col("kind").isin(*KINDS)
    doubt = F.col(reading).isNotNull() & (F.lower(F.col("right")) != F.lower(F.col(reading)))
    return rows.where(sound).withColumn("note", F.when(doubt, DOUBTFUL))


def safe_pending(kind: Column, right: Column, reading: Column, stop: tuple[str, ...] = ()) -> Column:
    """Whether a pending term may be used: a name whose form is its reading, or a person in Latin letters of 3 words at most."""
    latin = right.rlike(r"^[A-Za-z][A-Za-z'.-]*( [A-Za-z'.-]+){0,2}$")
    return kind.isin(*KINDS) & ~F.lower(right).isin(*stop or ("",)) & ((F.lower(right) == F.lower(reading)) | (latin & (kind == "person")))


def new_terms(proposed: DataFrame, known: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """First form of each new term, and proposals that contradict a known form."""
    first = R.first_by(proposed, [group, "term"], [F.col("ordinal")])
    new = first.join(known.select(group, "term"), [group, "term"], "left_anti")
    clash = proposed.join(known.select(group, "term", F.col("right").alias("known_right")), [group, "term"]).where(F.lower("right") != F.lower("known_right"))
    return new, clash


def healed(terms: DataFrame, group: str) -> DataFrame:
    """Terms whose right form holds another term's wrong form get its right form instead; the old one becomes wrong.

    The replacements of a group are folded in, longest wrong form first; only changed rows are returned.
    """
    pairs = terms.where("wrong is not null and wrong <> '' and wrong <> right").groupBy(group).agg(F.sort_array(F.collect_set(F.struct((-F.length("wrong")).alias("n"), "wrong", "right"))).alias("fixes"))
    fixed = F.aggregate("fixes", F.col("right"), lambda acc, f: F.replace(acc, f["wrong"], f["right"]))
    return terms.join(pairs, group).withColumn("new_right", fixed).where("new_right <> right").withColumns({"wrong": F.col("right"), "right": F.col("new_right")}).drop("new_right", "fixes")


def actions(terms: DataFrame, reading: Column, since: Column | None = None) -> DataFrame:
    """action for unapproved terms that no user made: drop junk, fix to the reading, flag doubt, clear old doubt."""
    rows = terms.where("not approved and created_by is null")
    rows = rows.where(F.col("created_at") > since) if since is not None else rows
    same = F.lower("right") == F.lower(reading)
    action = F.when(F.col("right").rlike(f"[{X.HAN}]") | (F.trim("right") == ""), "drop").when(reading.isNull(), "keep").when(same & (F.col("note") == DOUBTFUL), "clear")
    action = action.when(same, "keep").when(F.levenshtein(F.lower("right"), F.lower(reading)) <= 2, "fix").when(F.coalesce(F.col("note"), F.lit("")) != DOUBTFUL, "flag").otherwise("keep")
    return rows.withColumn("action", action).where("action <> 'keep'")


def overrides(terms: DataFrame, table: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(term, right): terms whose form an override table changes; skipped terms and no-ops are left out."""
    rows = terms.select("term", F.col("right").alias("old")).join(table.select("term", "right"), "term")
    return rows.where(~F.col("term").isin(*skip or ("",)) & (F.col("old") != F.col("right"))).select("term", "right")
