"""Job queues as sets: eligibility, transitions and what a request would change. Locks and leases are not enforced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimable(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Pending jobs that may run now, best first by priority, then age.

    Of one novel nothing runs; a chapter job waits for the novel's metadata job, its own content and the chapter before it.
    jobs: id, type, novel_id, chapter_id, status, priority, created_at; chapters: id, novel_id, chapter_index, content.
    """
    pending = jobs.where("status = 'pending'")
    busy = jobs.where("status = 'running'").select("novel_id").distinct()
    meta = pending.where("type = 'metadata'").select("novel_id").distinct()
    places = chapters.select(F.col("id").alias("chapter_id"), "chapter_index", F.col("content").isNotNull().alias("ready"))
    waiting = pending.where("type = 'chapter'").join(places, "chapter_id").select("novel_id", (F.col("chapter_index") + 1).alias("chapter_index")).distinct()
    others = pending.where("type <> 'chapter'").withColumn("chapter_index", F.lit(None).cast("int"))
    chapter = pending.where("type = 'chapter'").join(meta, "novel_id", "left_anti").join(places.where("ready").drop("ready"), "chapter_id").join(waiting, ["novel_id", "chapter_index"], "left_anti")
    return others.unionByName(chapter.select(*others.columns)).join(busy, "novel_id", "left_anti").orderBy("priority", "created_at", "id")


def requeued(jobs: DataFrame, cutoff: Column, max_attempts: int = 3) -> DataFrame:
    """Running jobs locked before cutoff: failed after max_attempts, else pending again and unlocked."""
    old = (F.col("status") == "running") & (F.col("locked_at") < cutoff)
    status = F.when(old & (F.col("attempts") >= max_attempts), "failed").when(old, "pending").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "locked_at": F.when(~old, F.col("locked_at"))})


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after results (id, ok, deferred): done; deferred ones give their attempt back; failures retry up to max_attempts."""
    j = jobs.join(results, "id", "left")
    attempts = F.when(F.col("deferred"), F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    status = F.when(F.col("ok"), "done").when(F.col("deferred"), "pending").when(~F.col("ok"), F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")).otherwise(F.col("status"))
    return j.withColumns({"status": status, "attempts": attempts}).drop("ok", "deferred")


def orphans(chapters: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued chapters without an active job, and pending jobs whose chapter isn't queued."""
    active = jobs.where(F.col("status").isin("pending", "running")).select(F.col("chapter_id").alias("id"))
    queued = chapters.where("translation_status = 'queued'")
    lost = queued.join(active, "id", "left_anti")
    idle = jobs.where("status = 'pending' and chapter_id is not null").join(queued.select(F.col("id").alias("chapter_id")), "chapter_id", "left_anti")
    return lost, idle


def translation_request(chapters: DataFrame, jobs: DataFrame, novel_id: int, first: int, last: int, cap: int = 10_000) -> DataFrame:
    """(chapter_index, action) of a range: create a missing chapter, queue an idle one, or leave it."""
    stop = min(last, first + cap - 1)
    wanted = chapters.sparkSession.range(first, stop + 1).select(F.col("id").cast("int").alias("chapter_index"))
    own = chapters.where(F.col("novel_id") == novel_id).select(F.col("id").alias("chapter_id"), "chapter_index", "translation_status")
    active = jobs.where(F.col("status").isin("pending", "running")).select("chapter_id").distinct().withColumn("active", F.lit(True))
    rows = wanted.join(own, "chapter_index", "left").join(active, "chapter_id", "left")
    action = F.when(F.col("chapter_id").isNull(), "create").when(F.col("active"), "leave").when(F.col("translation_status").isin("none", "failed"), "queue").otherwise("leave")
    return rows.select("chapter_index", action.alias("action"))


def source_status(events: DataFrame, limit: int = 5) -> DataFrame:
    """(source, fails, disabled) after all ticks: one success resets, `limit` failing ticks in a row disable.

    events: source, tick, ok. The last good tick is one aggregate, so no ordering window over a busy source is needed.
    """
    ticks = events.groupBy("source", "tick").agg(F.max("ok").alias("ok"))
    last = ticks.where("ok").groupBy("source").agg(F.max("tick").alias("good"))
    bad = ticks.join(last, "source", "left").where("not ok and (good is null or tick > good)")
    counts = bad.groupBy("source").agg(F.count(F.lit(1)).alias("fails"))
    out = events.select("source").distinct().join(counts, "source", "left").select("source", F.coalesce("fails", F.lit(0)).alias("fails"))
    return out.withColumn("disabled", F.col("fails") >= limit)


def toc_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(novel_id, chapter_index, change) between stored and fresh lists: added, remapped (another id), or gone."""
    a = old.select("novel_id", "chapter_index", F.col("source_chapter_id").alias("a"))
    b = new.select("novel_id", "chapter_index", F.col("source_chapter_id").alias("b"))
    both = a.join(b, ["novel_id", "chapter_index"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "remapped")
    return both.select("novel_id", "chapter_index", change.alias("change")).where("change is not null")


def unfetchable_failed(jobs: DataFrame, chapters: DataFrame, novels: DataFrame, sources: DataFrame, error: str = "source is off and holds no text") -> DataFrame:
    """jobs, of which pending chapter jobs fail where the chapter has no content and its source isn't enabled.

    jobs: type, chapter_id, status, error; chapters: id, novel_id, content; novels: id, source_id; sources: id, enabled. A
    chapter, novel or source that is missing counts as off and empty. No two rows of a table share an id.
    """
    places = chapters.select(F.col("id").alias("_c"), F.col("novel_id").alias("_n"), F.col("content").isNotNull().alias("_has"))
    found = places.join(novels.select(F.col("id").alias("_n"), F.col("source_id").alias("_s")), "_n", "left").join(sources.select(F.col("id").alias("_s"), F.col("enabled").alias("_on")), "_s", "left").select("_c", "_has", "_on")
    lost = (F.col("type") == "chapter") & (F.col("status") == "pending") & F.col("chapter_id").isNotNull() & ~F.coalesce("_has", F.lit(False)) & ~F.coalesce("_on", F.lit(False))
    out = jobs.join(found, F.col("chapter_id") == F.col("_c"), "left").withColumn("_lost", F.coalesce(lost, F.lit(False)))
    return out.select(*(F.when(F.col("_lost"), {"status": F.lit("failed"), "error": F.lit(error)}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "error") else F.col(c) for c in jobs.columns))


def finalized(jobs: DataFrame, chapters: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Jobs, chapters and counts after results that take effect together or not at all.

    results: job_id, worker, chapter_id, content_out, one row a job. A result holds if its job runs, is locked by that worker
    and is for that chapter, and the chapter exists; others are in rejected. novels: novel_id, first_translations (chapters
    that had no translation before). Of several results for one chapter that of the largest job_id stays.
    """
    named = results.select("job_id", "worker", F.col("chapter_id").alias("_chapter"), F.col("content_out").alias("_new"))
    known = chapters.select(F.col("id").alias("_c"), "novel_id", F.col("content_out").isNull().alias("_first"))
    held = named.join(jobs.select(F.col("id").alias("job_id"), "status", "locked_by", "chapter_id"), "job_id", "left").join(known, F.col("_chapter") == F.col("_c"), "left")
    good = F.coalesce((F.col("status") == "running") & F.col("locked_by").eqNullSafe(F.col("worker")) & (F.col("chapter_id") == F.col("_chapter")) & F.col("_c").isNotNull(), F.lit(False))
    ok = held.where(good)
    done = ok.select(F.col("job_id").alias("id"), F.lit(True).alias("_done"))
    text = ok.groupBy(F.col("_chapter").alias("id")).agg(F.max_by("_new", "job_id").alias("_new"), F.lit(True).alias("_done"))
    new_jobs = jobs.join(done, "id", "left").withColumns({"status": F.when(F.col("_done"), "done").otherwise(F.col("status")), "locked_by": F.when(F.col("_done").isNull(), F.col("locked_by"))}).select(*jobs.columns)
    new_chapters = chapters.join(text, "id", "left").withColumn("content_out", F.when(F.col("_done"), F.col("_new")).otherwise(F.col("content_out"))).select(*chapters.columns)
    novels = ok.where("_first").select("novel_id", "_chapter").distinct().groupBy("novel_id").agg(F.count(F.lit(1)).alias("first_translations"))
    return {"jobs": new_jobs, "chapters": new_chapters, "novels": novels, "rejected": held.where(~good).select("job_id")}
