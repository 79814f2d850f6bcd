"""Training-corpus preparation on line tables: explosion, hashes, leakage, sampling, mixing, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import frames as R


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, pos, line, keep...) of every line; positions count from 0."""
    return docs.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def normalize_pair(df: DataFrame, sources: Sequence[str] = ("zh", "source", "source_zh"), targets: Sequence[str] = ("vi", "proposed_vi", "target", "target_vi")) -> DataFrame:
    """source and target from whichever columns exist, the first that isn't blank."""
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in df.columns), F.lit(None).cast("string"))
    return df.withColumn("source", pick(sources)).withColumn("target", pick(targets))


def leaking(rows: DataFrame, evaluation: DataFrame, hashes: str = "h", group: Sequence[str] = ()) -> DataFrame:
    """Rows whose hash is in the evaluation set, or whose group is, told apart by `leak`; two semi joins and a union."""
    by_hash = rows.join(evaluation.select(hashes).distinct(), hashes, "left_semi").withColumn("leak", F.lit("hash"))
    if not group:
        return by_hash
    by_group = rows.join(evaluation.select(*group).distinct(), list(group), "left_semi").withColumn("leak", F.lit("group"))
    return by_hash.unionByName(by_group.join(evaluation.select(hashes).distinct(), hashes, "left_anti"))


def blocked_hashes(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Hashes of whole texts and of each of their non-blank lines."""
    parts = F.concat(F.array(F.col(text_col)), F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != ""))
    return texts.select(F.explode(parts).alias("t")).select(F.sha2(F.trim("t"), 256).alias("h")).distinct()


def combine_shards(gold: DataFrame, replay: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """gold, and replay rows whose key gold lacks; second frame: replay's keys with another value than gold's (errors)."""
    clash = replay.join(gold.select(F.col(key), F.col(value).alias("_v")), key).where(F.col(value) != F.col("_v")).drop("_v")
    return gold.unionByName(replay.join(gold.select(key), key, "left_anti")), clash


def hash_order(*parts: Column, salt: str = "") -> Column:
    """Reproducible random order: SHA-256 of a salt and the parts."""
    return F.sha2(F.concat_ws("\0", F.lit(salt), *parts), 256)


def mixed(human: DataFrame, machine: DataFrame, share: float, order: Column, cap: int | None = None) -> DataFrame:
    """Human and machine rows at a human share, each the first by order."""
    h, m = R.mix_ratio(human.count(), machine.count(), share, cap)
    return first_rows(human, order, h).unionByName(first_rows(machine, order, m))


def first_rows(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The first n rows by order, for n that grows with the table: rows are range-partitioned and numbered, not merged in one
    task as a limit behind a sort would be."""
    from quillspark.sources.sinks import row_numbers

    return row_numbers(df.withColumn("_order", order), "_order", "_nth").where(F.col("_nth") <= n).drop("_order", "_nth")


def holdout(df: DataFrame, key: str, order: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows: the first min(n, count // 20) by order; keys held out leave training altogether."""
    size = min(n, df.count() // 20)
    held = df.orderBy(order).limit(size)
    return df.join(held.select(key), key, "left_anti"), held


def manifest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, distinct keys and a digest that doesn't depend on row order."""
    h = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(h).alias("n_unique"), F.sha2(F.concat_ws("-", *(F.coalesce(part(i), F.lit("")) for i in range(8))), 256).alias("digest"))


def greedy_cover(df: DataFrame, group: str, labels: str, order: str, n: int, priority: Sequence[str] = (), weight: int = 8) -> DataFrame:
    """In each group up to n rows, each adding most labels not yet covered (priority labels count `weight`); ties by order.

    Groups go to workers; a step only looks at distinct label sets, of which the first row stands for all, so a group's
    frame holds a row a label set and not a row a text.
    """
    import pandas as pd

    special = set(priority)
    heads = df.groupBy(group, F.array_sort(labels).alias(labels)).agg(F.min(order).alias(order))
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, pick int, gain int"

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows, covered, out = rows.sort_values(order).reset_index(drop=True), set(), []
        sets = [set(x) for x in rows[labels]]
        for k in range(n):
            gains = [sum(weight if x in special else 1 for x in s - covered) for s in sets]
            if not gains or max(gains) <= 0:
                break
            i = gains.index(max(gains))
            out.append((rows[group][i], rows[order][i], k + 1, gains[i]))
            covered |= sets[i]
        return pd.DataFrame(out, columns=[group, order, "pick", "gain"])

    return heads.groupBy(group).applyInPandas(pick, schema)


def greedy_cover_spaced(df: DataFrame, group: str, text_id: str, pos: str, labels: str, n: int, apart: int = 8) -> DataFrame:
    """In each group up to n places, each adding most labels not yet covered, then having most; ties by text_id and pos.

    Two places in one text are more than `apart` positions away from each other. A pick blocks 2 * apart + 1 places at most,
    so of each group's places with equal labels the first n * (2 * apart + 1) are enough, and a worker's frame is bounded by the
    number of label sets and not by the group. Repeated rows count once; places without labels may be left out.
    """
    import pandas as pd

    places = df.groupBy(group, text_id, pos).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(labels)))).alias(labels))
    heads = R.top_per_group(places, [group, labels], [F.col(text_id), F.col(pos)], n * (2 * apart + 1))
    kind = lambda c: df.schema[c].dataType.simpleString()

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left = [(x, p, frozenset(s)) for x, p, s in zip(rows[text_id], rows[pos], rows[labels], strict=True)]
        covered, out = set(), []
        while left and len(out) < n:
            x, p, s = min(left, key=lambda c: (-len(c[2] - covered), -len(c[2]), c[0], c[1]))
            covered |= s
            out.append((rows[group].iloc[0], x, p, len(out) + 1))
            left = [c for c in left if c[0] != x or abs(c[1] - p) > apart]
        return pd.DataFrame(out, columns=[group, text_id, pos, "pick"])

    return heads.groupBy(group).applyInPandas(pick, f"{group} {kind(group)}, {text_id} {kind(text_id)}, {pos} {kind(pos)}, pick int")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, min_length: int = 24, head: int = 80, step: int = 4, block: int = 40, least: float = 0.92) -> DataFrame:
    """(a, b, ratio): texts that share a 4-gram at stride `step` of their head and whose matching-block ratio reaches least.

    Blocks of more than `block` texts are skipped, as the feature defines it; exact copies are left out.
    """
    from quillspark.functions.text import similarity_from

    rows = df.where(F.length(text_col) >= min_length).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    grams = rows.select("i", F.length("t").alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length("t"), F.lit(head)) - 3, F.lit(step)), lambda p: F.substr(F.col("t"), p, F.lit(4))))).alias("g"))
    small = grams.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m").between(2, block)).select("g")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows that take long: not to be dealt by their bytes
    kept = grams.join(small, "g").repartition(tasks, "g")
    lengths = 2 * F.least("x.n", "y.n") >= least * (F.col("x.n") + F.col("y.n"))
    pairs = kept.alias("x").join(kept.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.i") < F.col("y.i")) & lengths).select(F.col("x.i").alias("a"), F.col("y.i").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("i").alias("a"), F.col("t").alias("s")), "a").repartition(tasks, "b").join(rows.select(F.col("i").alias("b"), F.col("t").alias("u")), "b").where("s <> u")
    return both.select("a", "b", similarity_from(least)("s", "u").alias("ratio")).where("ratio is not null")
