"""Relational building blocks: every one is a plan that Catalyst sees whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def numbered(df: DataFrame, keys: Keys, order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_by(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in order (canonical picks, first or last wins, glossary dedup)."""
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: Keys, order: Sequence[Column], n: int) -> DataFrame:
    """At most n rows a key; Spark limits each task's groups before the shuffle."""
    return numbered(df, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def round_robin(df: DataFrame, group: str, order: Sequence[Column], group_order: Sequence[Column]) -> DataFrame:
    """Interleave groups: every group's first row, then every group's second; adds turn. Sort by turn and group_order."""
    return numbered(df, [group], order, "turn").orderBy("turn", *group_order)


def islands(df: DataFrame, keys: Keys, index: str) -> DataFrame:
    """Runs of consecutive index values: keys, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(index)
    marked = df.select(*keys, index).distinct().withColumn("_g", F.col(index) - F.row_number().over(w))
    return marked.groupBy(*keys, "_g").agg(F.min(index).alias("run_first"), F.max(index).alias("run_last"), F.count(F.lit(1)).alias("run_length")).drop("_g")


def drop_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of keys with a single distinct value; a key with two goes for good."""
    sound = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo = _hi").select(key)
    return df.join(sound, key, "left_semi")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def dup_counts(df: DataFrame, keys: Keys) -> DataFrame:
    """One row: rows, unique keys, extra rows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("n") - 1).alias("n_extra"))


def index_percentiles(df: DataFrame, keys: Keys, value: str, places: Mapping[str, float]) -> DataFrame:
    """Keys, and for each name of places the element at min(n - 1, int(p * n)) of the group's sorted values: no interpolation.

    Values are counted before they are sorted, so a group costs what its distinct values cost. Nulls take no part.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = counted.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    at = lambda p: F.least(F.col("_all") - 1, F.floor(F.lit(p) * F.col("_all")))
    return upto.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in places.items()))


def numbered_by_parts(df: DataFrame, key: str, part: Column, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Numbers from 1 in each key's order, a key's rows split over tasks by part, which must not fall in that order (a day of a
    time, say): rows are numbered in their part, and the parts' sizes give what comes before."""
    parts = df.withColumn("_part", part)
    upto = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    local = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return local.join(before, [key, "_part"]).withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def context_before(df: DataFrame, keys: Keys, order: str, text: str, k: int, sep: str = "\n") -> DataFrame:
    """Rows with text and the non-empty texts among the k places before, joined; rows without text go after that."""
    filled = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.col(text))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, -1)
    seen = F.collect_list(filled).over(w)
    return df.withColumn("context", F.concat_ws(sep, seen)).withColumn("context_len", F.size(seen)).where(filled.isNotNull())


def stride(df: DataFrame, order: Sequence[Column], k: int, keys: Keys) -> DataFrame:
    """In each group every max(1, n div k)-th row, the first included, k at most."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / k).cast("int"))
    rn = F.row_number().over(w.orderBy(*order))
    taken = df.withColumn("_step", step).withColumn("_rn", rn).where((F.col("_rn") - 1) % F.col("_step") == 0)
    return taken.where((F.col("_rn") - 1) / F.col("_step") < k).drop("_step", "_rn")


def only_changed(new: DataFrame, old: DataFrame, key: str, columns: Keys) -> DataFrame:
    """Rows of new that are absent from old or differ in a column, null-safely: what an upsert has to write."""
    before = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    return new.join(before, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_k", "_old")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows put in: a key of new replaces, others are added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key it lacks (on conflict do nothing)."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def series_fill(df: DataFrame, keys: Keys, index: str, up_to: Column) -> DataFrame:
    """The missing (keys, index) of 1..up_to in each group."""
    bounds = df.groupBy(*keys).agg(up_to.alias("_n"))
    wanted = bounds.where("_n >= 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias(index))
    return wanted.join(df.select(*keys, F.col(index).cast("int").alias(index)), [*keys, index], "left_anti")


def weighted_union(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Concatenate frames, each k times."""
    out = None
    for df, k in parts:
        rows = df.withColumn("_i", F.explode(F.array_repeat(F.lit(0), k))).drop("_i")
        out = rows if out is None else out.unionByName(rows)
    return out


def mix_ratio(human: int, machine: int, share: float, cap: int | None = None) -> tuple[int, int]:
    """How many human and machine rows give a human share, machine filled up first; over cap both shrink."""
    m = min(machine, int(human * (1 - share) / share))
    if cap is not None and human + m > cap:
        h = min(human, int(cap * share))
        return h, cap - h
    return human, m


def bucket_of_hash(hex_hash: Column, digits: int, n: int) -> Column:
    """The number in the first hex digits of a hash, modulo n."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("long") % n


def stable_hash(*parts: Column, sep: str = "\0") -> Column:
    """SHA-256 of the parts, joined by a separator; nulls as empty."""
    return F.sha2(F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
