"""Sinks: shards of a fixed size, packs with manifests, idempotent offload."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.corpus import manifest


def settled(df: DataFrame) -> DataFrame:
    """df written once to spark.checkpoint.dir, so that all that is derived from it sees the same rows in the same partitions.
    Only a local session may go without that folder; it then gets a temporary one of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def row_numbers(df: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """Numbers from 1 over all rows in order, without sorting them in one task: rows are range-partitioned and numbered in
    their partition; the partitions' sizes, one row each, give what comes before. The partitions are settled first, as a
    second pass would sample other bounds and number some rows twice."""
    parts = settled(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def shard_numbers(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds shard: 0 for the first size rows, and so on."""
    return row_numbers(df, order, "_n").withColumn("shard", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def write_shards(df: DataFrame, path: str, order: str, size: int) -> None:
    shard_numbers(df, order, size).write.partitionBy("shard").mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """JSON lines, UTF-8 as it is."""
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).json(path)


def write_split(approved: DataFrame, rejects: DataFrame, path: str) -> None:
    approved.write.mode("overwrite").parquet(f"{path}/approved")
    rejects.write.mode("overwrite").parquet(f"{path}/rejects")


def write_pack(shards: dict[str, DataFrame], path: str, expected: dict[str, int] | None = None) -> DataFrame:
    """Shards as Parquet and a manifest table; fails if a shard hasn't its expected number of rows."""
    rows = None
    for name, df in shards.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        read = df.sparkSession.read.parquet(f"{path}/{name}")
        row = manifest(read, *read.columns).select(F.lit(name).alias("shard"), "*")
        rows = row if rows is None else rows.unionByName(row)
    rows.write.mode("overwrite").parquet(f"{path}/manifest")
    done = rows.sparkSession.read.parquet(f"{path}/manifest")
    for r in done.collect():  # a row a shard
        if expected and r["n_rows"] != expected.get(r["shard"], r["n_rows"]):
            raise ValueError(f"{r['shard']}: {r['n_rows']} rows, not {expected[r['shard']]}")
    return done


def offload(rows: DataFrame, stored: DataFrame, key: str, text: str, done: str) -> tuple[DataFrame, DataFrame]:
    """Rows to store (done, with text, not stored yet) and the table with the text of stored rows nulled; can be rerun."""
    new = rows.where(F.col(done) & F.col(text).isNotNull()).join(stored.select(key), key, "left_anti").select(key, text)
    kept = stored.select(key).unionByName(new.select(key)).distinct().withColumn("_s", F.lit(True))
    nulled = rows.join(kept, key, "left").withColumn(text, F.when(F.col("_s").isNull(), F.col(text))).drop("_s")
    return new, nulled
