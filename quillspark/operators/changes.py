"""Changes between two states of a table, and what they leave behind: versions, deleted keys, first collections.

A batch of increments is applied once however often it is replayed: it is written under its number, and counters are sums
over the numbers, so a second run of a batch replaces what the first one wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, old, new): rows inserted, updated and deleted between two states; old and new are structs of the others.

    Keys are unique in each state; one of null is a key like any other. Rows that differ in no column give none.
    """
    names = [c for c in before.columns if c not in keys]
    held = lambda df, name: df.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.struct(*names).alias(name))
    on = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    both = held(before, "old").join(held(after, "new"), on, "full")
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    key = [F.when(F.col("new").isNull(), F.col(f"_old_{k}")).otherwise(F.col(f"_new_{k}")).alias(k) for k in keys]
    return both.select(*key, kind.alias("kind"), "old", "new").where("kind is not null")


def versions(stored: DataFrame, changed: DataFrame, group: str) -> DataFrame:
    """(group, version) after the changes: one up for every row inserted or updated that belongs to a group, named in `new`."""
    n = changed.where("kind <> 'delete'").groupBy(F.col(f"new.{group}").alias(group)).agg(F.count(F.lit(1)).alias("_n")).where(F.col(group).isNotNull())
    return stored.join(n, group, "full").select(group, (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("version"))


def blacklist(changed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of deleted rows, so that they aren't collected again."""
    names = [*columns]
    return changed.where("kind = 'delete'").select(*(F.col(f"old.{c}" if c not in changed.columns else c).alias(c) for c in names))


def collected(stored: DataFrame, changed: DataFrame, keys: Sequence[str], quantity: str, at: str) -> DataFrame:
    """(keys, first_collected_at): a thing once held stays, also when it is used up; the first time counts."""
    now = changed.where((F.col("kind") != "delete") & (F.col(f"new.{quantity}") > 0)).select(*keys, F.col(f"new.{at}").alias("first_collected_at"))
    return stored.select(*keys, "first_collected_at").unionByName(now).groupBy(*keys).agg(F.min("first_collected_at").alias("first_collected_at"))


def hits(found: DataFrame, group: str, terms: str) -> DataFrame:
    """(group, term, n): how many rows named each term (array, each term once a row)."""
    return found.select(group, F.explode(F.array_distinct(terms)).alias("term")).where("term is not null").groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def record(increments: DataFrame, batch: int, path: str) -> None:
    """Write a batch's increments under its number; a replay replaces them."""
    increments.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch)}")


def counters(spark, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """(keys, n): sums over all batches; schema is the increments'."""
    return spark.read.schema(f"{schema}, batch long").parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def retranslated(chapters: DataFrame, jobs: DataFrame, novels: DataFrame, wanted: DataFrame, priority: int = 30) -> DataFrame:
    """(novel_id, chapter_index, chapter_id, action, priority) of wanted (novel_id, chapter_index).

    action: queue (finished jobs of the chapter give way to a new one), running (a job is pending or running, and stays),
    no_source (no text is stored and the novel's source is off), unknown (no such chapter). Each wanted chapter is
    answered once.
    """
    w = wanted.select("novel_id", "chapter_index").distinct()
    own = chapters.select("novel_id", "chapter_index", F.col("id").alias("chapter_id"), F.col("content").isNotNull().alias("stored"))
    active = jobs.where(F.col("status").isin("pending", "running")).select("chapter_id").distinct().withColumn("active", F.lit(True))
    rows = w.join(own, ["novel_id", "chapter_index"], "left").join(novels.select(F.col("id").alias("novel_id"), "enabled"), "novel_id", "left").join(active, "chapter_id", "left")
    action = F.when(F.col("chapter_id").isNull(), "unknown").when(~F.coalesce("stored", F.lit(False)) & ~F.coalesce("enabled", F.lit(False)), "no_source").when(F.col("active"), "running").otherwise("queue")
    return rows.select("novel_id", "chapter_index", "chapter_id", action.alias("action"), F.when(action == "queue", F.lit(priority)).alias("priority"))
