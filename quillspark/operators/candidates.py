"""Candidates of a discovery queue: what an outcome makes of them, when they come up again, and which ones a cycle takes.

Outcomes: done, rejected, too_short, failed, and blocked, which says nothing about the candidate. A failed one comes up
again after an hour, one that was too short after a week, others never. All are columns and windows over one candidate's
or one cycle's outcomes; streaming/candidates.py has the same rules with state and timers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How long a candidate rests after an outcome, and the failures in a row that end a cycle.
REST_HOURS = {"failed": 1, "too_short": 7 * 24}
FAILURES_IN_A_ROW = 8
COUNTED = ("done", "too_short", "failed")


def rested(outcome: Column, ts: Column) -> Column:
    """When a candidate may be tried again, null where never."""
    out = F.lit(None).cast("timestamp")
    for name, hours in REST_HOURS.items():
        out = F.when(outcome == name, ts.cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))).otherwise(out)
    return out


def states(candidates: DataFrame, outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", nth: str = "nth", outcome: str = "outcome") -> DataFrame:
    """candidates (their keys unique) with status, attempts and retry_after after all outcomes; pending, 0 and null without one.

    Of a candidate's outcomes the latest counts, of equal times the one of largest nth; blocked ones never count. One
    aggregate, which combines before the shuffle.
    """
    told = outcomes.where(F.col(outcome) != "blocked").groupBy(*keys).agg(F.max(F.struct(ts, nth, outcome)).alias("_s"), F.count_if(F.col(outcome).isin(*COUNTED)).alias("_n"))
    rows = candidates.join(told, list(keys), "left")
    status = F.coalesce(F.col(f"_s.{outcome}"), F.lit("pending"))
    return rows.select(*candidates.columns, status.alias("status"), F.coalesce("_n", F.lit(0)).alias("attempts"), rested(status, F.col(f"_s.{ts}")).alias("retry_after"))


def next_batch(states: DataFrame, source: str, now: Column, limit: int, priority: str = "priority", created: str = "created_at") -> DataFrame:
    """The first `limit` candidates of each source (the feature): pending ones by priority and age, then those that are due by
    priority and the time they came up."""
    due = F.col("status").isin(*REST_HOURS) & (F.col("retry_after") <= now)
    rows = states.withColumn("_p", F.when(F.col("status") == "pending", 0).when(due, 1)).where("_p is not null")
    order = Window.partitionBy(source).orderBy("_p", priority, F.when(F.col("_p") == 0, F.col(created)).otherwise(F.col("retry_after")), *(c for c in states.columns if c not in (source, priority, created, "status", "attempts", "retry_after")))
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("_p")


def cycle_end(outcomes: DataFrame, cycle: Sequence[str], nth: str, outcome: str = "outcome", most_new: int = 10, failures: int = FAILURES_IN_A_ROW) -> DataFrame:
    """outcomes with counts: whether the cycle got as far. It ends at a blocked one, which itself doesn't count, behind
    `failures` failures in a row, and before the next once most_new are done.

    Runs of failures are found by what stands before them; done, rejected and too_short ones end a run.
    """
    before = Window.partitionBy(*cycle).orderBy(nth)
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    is_failure = F.col(outcome) == "failed"
    run = F.sum(F.when(is_failure, 0).otherwise(1)).over(before)
    rows = outcomes.withColumn("_run", run).withColumn("_length", F.sum(is_failure.cast("int")).over(Window.partitionBy(*cycle, "_run").orderBy(nth)))
    ended = F.coalesce(F.max(F.when(F.col("_length") >= failures, 1).when(F.col(outcome) == "blocked", 1).otherwise(0)).over(past), F.lit(0)) == 1
    full = F.coalesce(F.sum((F.col(outcome) == "done").cast("int")).over(past), F.lit(0)) >= most_new
    return rows.withColumn("counts", ~ended & ~full & (F.col(outcome) != "blocked")).drop("_run", "_length")


def come_up_again(outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", nth: str = "nth", outcome: str = "outcome") -> DataFrame:
    """(keys, due, outcome, attempts): each time a resting candidate came up again, before the next outcome it had."""
    told = outcomes.where(F.col(outcome) != "blocked")
    order = Window.partitionBy(*keys).orderBy(ts, nth)
    attempts = F.count_if(F.col(outcome).isin(*COUNTED)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    due = rested(F.col(outcome), F.col(ts))
    rows = told.select(*keys, outcome, due.alias("due"), attempts.alias("attempts"), F.lead(ts).over(order).alias("_next"))
    return rows.where(F.col("due").isNotNull() & (F.col("_next").isNull() | (F.col("due") <= F.col("_next").cast("timestamp")))).select(*keys, "due", outcome, "attempts")


def genre_blocked(genres: Column, titles: Sequence[Column], description: Column, blocked: Sequence[str], blocked_text: Sequence[str], strong: Sequence[str], cut: str = "小说推荐") -> Column:
    """The first of `blocked` in the genres, else of `blocked_text` in genres, titles and the description before `cut`; null if
    there is none or one of `strong` occurs in them. Case-blind; nulls are empty."""
    cats = F.lower(F.array_join(F.coalesce(genres, F.array().cast("array<string>")), " "))
    text = F.concat_ws(" ", cats, *(F.lower(t) for t in titles), F.lower(F.substring_index(F.coalesce(description, F.lit("")), cut, 1)))
    first = lambda c, words: F.coalesce(*(F.when(F.contains(c, F.lit(w.lower())), F.lit(w)) for w in words)) if words else F.lit(None).cast("string")
    allowed = reduce(Column.__or__, (F.contains(text, F.lit(w.lower())) for w in strong), F.lit(False))
    return F.when(~allowed, F.coalesce(first(cats, blocked), first(text, blocked_text)))


def visibility(status: Column, chapters: Column, hidden: Column, translated: Column, least: int) -> Column:
    """What a novel's list of chapters means for it: hide a thin one that isn't complete, unhide one that has grown or been
    completed, else keep. Translated ones are never touched: those were hidden by hand."""
    thin = (F.coalesce(status, F.lit("")) != "completed") & (F.coalesce(chapters, F.lit(0)) < least)
    free = ~F.coalesce(translated, F.lit(False))
    shown = ~F.coalesce(hidden, F.lit(False))
    return F.when(free & shown & thin, "hide").when(free & ~shown & ~thin, "unhide").otherwise("keep")
