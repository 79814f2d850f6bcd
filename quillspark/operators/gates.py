"""Gates: ordered rules that give a row its first reason, or all of its reasons. Reasons are data, order is semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.functions import text as X

Rules = Sequence[tuple[str, Column]]


def first_reason(rules: Rules) -> Column:
    """The reason of the first rule that holds, else null; a null predicate doesn't hold."""
    return F.coalesce(*(F.when(test, reason) for reason, test in rules))


def all_reasons(rules: Rules) -> Column:
    """Sorted distinct reasons of all rules that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(test, reason) for reason, test in rules)))))


def with_seen(df: DataFrame, key: str, order: str, missing: Column, intrinsic: Column, reason: str = "reason", duplicate: str = "duplicate") -> DataFrame:
    """Final reason where a key counts as seen only once a row with it was accepted, and duplicates are told before all
    other reasons but `missing`. The first accepted place of a key is one aggregate, joined back, so a key that a third of
    the rows has is split by adaptive execution instead of filling one window partition."""
    first = df.where(intrinsic.isNull() & ~missing).groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    out = df.join(first, F.col(key) == F.col("_k"), "left")
    seen = F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    return out.withColumn(reason, F.when(missing, "missing").when(seen, duplicate).otherwise(intrinsic)).drop("_k", "_first")


def split(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Approved rows without the reason, and rejects with it."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def pair_rules(source: Column, target: Column, script: str = f"[{X.HAN}]", ratio: tuple[float, float] = (2.0, 4.5), min_source: int = 20, score: Column | None = None, min_score: float = 0.70) -> Rules:
    """Rules of a translated line behind missing and duplicate: foreign script left over, lengths, phrases said twice in a row
    and more often than the source repeats anything, alignment score."""
    share = F.length(target) / F.length(source)
    rules = [("script_leak", target.rlike(script)), ("length_ratio", (F.length(source) >= min_source) & ~share.between(*ratio)), ("repeats", S.repeats_beyond(source, target))]
    return [*rules, ("misaligned", score < min_score)] if score is not None else rules


def strict_rules(source: Column, target: Column, ratio: tuple[float, float] = (0.25, 4.0), script: str = f"[{X.HAN}]", banned: str | None = None) -> Rules:
    """Rules of replay and teacher lines: source script, leaks, mojibake, quotes, register, digits, dense length ratio."""
    rules = [
        ("source_script", ~source.rlike(script)), ("script_leak", target.rlike(script)), ("mojibake", source.rlike(X.MOJIBAKE) | target.rlike(X.MOJIBAKE)),
        ("unbalanced_quotes", ~X.quotes_balanced(source) | ~X.quotes_balanced(target)), ("numbers", ~X.digits(source).eqNullSafe(X.digits(target))),
        ("length_ratio", ~(X.dense_length(target) / F.greatest(X.dense_length(source), F.lit(1))).between(*ratio)),
    ]
    return [*rules[:4], ("register", target.rlike(banned)), *rules[4:]] if banned else rules


def document_rules(source: Column, target: Column, script: str = f"[{X.HAN}]") -> Rules:
    """Rules of a whole translation: empty, leaks, truncation, lost paragraphs, inflation, lost line breaks."""
    n, m, a, b = F.length(source), F.length(target), F.size(X.lines(source)), F.size(X.lines(target))
    return [
        ("empty", F.trim(F.coalesce(target, F.lit(""))) == ""), ("script_leak", target.rlike(script)), ("cyrillic", target.rlike(r"[Ѐ-ӿ]")),
        ("too_short", (n > 0) & (m < F.when(n > 300, 0.6).otherwise(0.3) * n)), ("lost_lines", (a >= 10) & (b < 0.3 * a)),
        ("inflated", (n > 400) & (m > 4.5 * n)), ("lost_breaks", (X.str_count(source, "\n") >= 5) & (X.str_count(target, "\n") == 0)),
    ]


def conflict_groups(df: DataFrame, keys: Sequence[str], counts: tuple[str, str], min_share: float = 0.2) -> DataFrame:
    """Groups that use two styles at once: both occur and the rarer has min_share of the commoner."""
    a, b = (F.sum(c) for c in counts)
    out = df.groupBy(*keys).agg(a.alias("n_a"), b.alias("n_b"))
    return out.withColumn("conflict", (F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= min_share))


def tag_shares(df: DataFrame, tags: Column, least: float = 0.05) -> DataFrame:
    """Share of rows that have each tag, flagged below `least`."""
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / total).withColumn("too_rare", F.col("share") < least)


def accepted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most n accepted rows a group."""
    return df.where(F.col("reason").isNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
