"""Reference-based and reference-free measures of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.functions import text as X


def text_measures(c: Column, name: str) -> list[Column]:
    """Characters, lines, foreign-script characters and modern pronouns of a text."""
    return [F.length(c).alias(f"{name}_chars"), F.size(X.lines(c)).alias(f"{name}_lines"), X.count_matches(c, f"[{X.HAN}]").alias(f"{name}_script"), X.count_matches(c, S.any_of(S.MODERN)).alias(f"{name}_modern")]


def scored(df: DataFrame, source: str = "source", output: str = "output", reference: str = "reference") -> DataFrame:
    """df with similarity to the reference and structural defects of the output."""
    o, s, r = F.col(output), F.col(source), F.col(reference)
    ratio = F.length(o) / F.greatest(F.length(r), F.lit(1))
    return df.withColumns({
        "similarity": F.round(X.similarity(r, o), 6), "n_sentences": F.size(X.sentences(o)), "quote_fail": (~X.quotes_balanced(o)).cast("int"), "digit_fail": (~X.digits(s).eqNullSafe(X.digits(o))).cast("int"),
        "script": X.count_matches(o, f"[{X.HAN}]"), "modern": X.count_matches(o, S.any_of(S.MODERN)), "length_outlier": (~ratio.between(0.5, 2.0)).cast("int"),
    }).withColumn("divergence", F.round(1 - F.col("similarity"), 4))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Means and sums of scored() by keys, and the structural defects they add up to."""
    total = {c: F.sum(c).alias(c) for c in ("n_sentences", "script", "modern", "quote_fail", "digit_fail", "length_outlier")}
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 4).alias("similarity"), *total.values())
    return out.withColumn("structural_defects", F.col("script") + F.col("modern") + F.col("quote_fail") + F.col("digit_fail"))


def reference_free(df: DataFrame, source: str = "source", context: str = "context", output: str = "output") -> DataFrame:
    """One row of counts: lines, dropped subjects, invented ones, wrong genders by context and by the line, leftovers."""
    s, o = F.col(source), F.col(output)
    told, around = S.source_narration(s), S.source_narration(F.concat_ws("\n", F.col(context), s))
    dropped, invented = ~told.rlike("[他她它]"), S.invents_subject(s, o)
    male, female = F.contains(around, F.lit(S.MALE)), F.contains(around, F.lit(S.FEMALE))
    wrong = (male & ~female & o.rlike(S.LEADS_FEMALE)) | (female & ~male & o.rlike(S.LEADS_MALE))
    head = F.substring(F.ltrim(told), 1, 1)
    count = lambda c, name: F.count_if(c).alias(name)
    return df.agg(
        F.count(F.lit(1)).alias("lines"), count(dropped, "subject_dropped"), count(dropped & invented, "invented"), count(dropped & invented & wrong, "invented_wrong_gender"), count(head.isin(S.MALE, S.FEMALE), "gender_known"),
        count(((head == S.MALE) & o.rlike(S.LEADS_FEMALE)) | ((head == S.FEMALE) & o.rlike(S.LEADS_MALE)), "gender_wrong"), F.sum(X.count_matches(S.narration(o), S.any_of(S.MODERN))).alias("modern"),
        F.sum(X.count_matches(o, S.REPEATED)).alias("repeated"), F.sum(X.count_matches(o, f"[{X.HAN}]")).alias("script"),
    )


def changed(a: DataFrame, b: DataFrame, key: str, output: str, n: int = 10) -> DataFrame:
    """The first n rows by key whose outputs differ between two variants."""
    return a.select(key, F.col(output).alias("before")).join(b.select(key, F.col(output).alias("after")), key).where("before <> after").orderBy(key).limit(n)
