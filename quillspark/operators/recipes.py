"""Corpus recipes: compositions of gates, dedup, conflict removal, quotas and mixing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import style as S
from quillspark.functions import text as X
from quillspark.operators import frames as R
from quillspark.operators import gates as G
from quillspark.operators import pair_gates as P
from quillspark.operators.corpus import hash_order
from quillspark.sources.sinks import row_numbers


def aligned_lines(df: DataFrame, source: str = "zh_lines", target: str = "vi_lines", *keep: str) -> DataFrame:
    """(keep..., pos, source, target) of aligned line arrays; rows whose arrays differ in length are left out."""
    ok = df.where(F.size(source) == F.size(target))
    return ok.select(*keep, F.posexplode(F.arrays_zip(F.col(source).alias("s"), F.col(target).alias("t"))).alias("pos", "p")).select(*keep, "pos", F.col("p.s").alias("source"), F.col("p.t").alias("target"))


def corpus_gate(df: DataFrame, order: str, chapter: str | None = None, score: str | None = None) -> dict[str, DataFrame]:
    """source/target rows through the line gate with first-accepted duplicates: approved, rejects, reasons and, with a
    chapter column, chapters that mix two ways of address."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = G.pair_rules(F.col("source"), F.col("target"), score=F.col(score) if score else None)
    rows = G.with_seen(df, "source", order, blank("source") | blank("target"), G.first_reason(rules))
    approved, rejects = G.split(rows)
    out = {"approved": approved, "rejects": rejects, "reasons": G.reason_counts(rows)}
    if chapter:
        told = S.narration(F.col("target"))
        styles = {"n_old": X.count_matches(told, S.any_of(["nàng"])), "n_new": X.count_matches(told, S.any_of(["cô", "cô ấy", "cô ta"]))}
        out["chapters"] = G.conflict_groups(approved.withColumns(styles), [chapter], ("n_old", "n_new"))
    return out


def teacher_candidates(lines: DataFrame, blocked: DataFrame, general: int, game: int, tier: str = "teacher_tier", banned: Sequence[str] = S.MODERN) -> DataFrame:
    """Gated lines without locked or conflicting sources, split by domain, best tier first, then by hash.

    lines: source, target, teacher_tier. blocked: h (SHA-256 of locked sources). Raises if a domain is short.
    """
    s, t = F.col("source"), F.col("target")
    passed = lines.where(G.first_reason(G.strict_rules(s, t, banned=S.any_of(banned))).isNull()).withColumn("h", F.sha2(F.trim(s), 256))
    free = R.drop_conflicts(passed.join(blocked.select("h").distinct(), "h", "left_anti"), "source", "target")
    one = R.first_by(free, ["source"], [F.col(tier).desc(), F.col("h")]).withColumn("domain", F.when(S.two_game_signals(s), "game").otherwise("general"))
    parts = []
    for name, n in (("general", general), ("game", game)):
        part = one.where(F.col("domain") == name).orderBy(F.col(tier).desc(), "h").limit(n)
        if (found := part.count()) < n:
            raise ValueError(f"{name}: {found} rows of {n}")
        parts.append(part)
    return parts[0].unionByName(parts[1])


def context_pairs(lines: DataFrame, keys: Sequence[str], k: int, mark: str = "⟪ctx⟫") -> DataFrame:
    """Lines with up to k sources before them in front: context mark current; the gate looks at the current line only."""
    rows = R.context_before(lines, keys, "pos", "source", k, mark)
    passed = rows.where(G.first_reason(G.strict_rules(F.col("source"), F.col("target"))).isNull())
    return passed.withColumn("input", F.when(F.col("context_len") > 0, F.concat("context", F.lit(mark), "source")).otherwise(F.col("source")))


def address_ok(df: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Chapters whose modern address doesn't outnumber the old one (3 are forgiven)."""
    t = F.col(target)
    counted = df.groupBy(*keys).agg(F.sum(X.count_matches(t, S.any_of(["anh", "em"]))).alias("new"), F.sum(X.count_matches(t, S.any_of(["ta", "ngươi"]))).alias("old"))
    return df.join(counted.where(F.col("new") <= F.greatest(F.lit(3), F.col("old"))).select(*keys), list(keys), "left_semi")


def training_mix(gold: DataFrame, documents: DataFrame, order: Column, cap: int, times: int = 6) -> DataFrame:
    """Gold rows `times` over and the first cap others."""
    return R.weighted_union([(gold, times), (documents.orderBy(order).limit(cap), 1)])


def replay_quota(rows: DataFrame, quotas: dict[str, int], tier: str = "tier", salt: str = "replay") -> DataFrame:
    """Replay rows without conflicting sources, the first of each tier by hash up to its quota."""
    free = R.drop_conflicts(rows, "source", "target")
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col(tier) == name, n).otherwise(limit)
    return R.numbered(R.first_by(free, ["source"], [F.col(tier), F.col("target")]), [tier], [hash_order(F.col("source"), salt=salt), F.col("source")], "_n").where(F.col("_n") <= limit).drop("_n")


def score_filter(df: DataFrame, score: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or above least, without the score, and a histogram of all scores by thousandths, with the rows before each."""
    shares = df.groupBy(F.floor(F.col(score) * 1000).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("low"))
    cumulative = shares.withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n"))
    return df.where(F.col(score) >= least).drop(score), cumulative


def balanced(df: DataFrame, group: str, n: int, order: Sequence[Column]) -> DataFrame:
    """n rows of each group; raises if one is short."""
    out = R.top_per_group(df, [group], order, n)
    short = [r[group] for r in out.groupBy(group).count().where(F.col("count") < n).collect()]  # a row a group
    if short:
        raise ValueError(f"too few rows: {sorted(short)}")
    return out


def review_batches(pool: DataFrame, approved: DataFrame, key: str, domain: str, quota: int, batches: int, offset: int = 0) -> DataFrame:
    """Unapproved rows in batches: of each domain quota rows a batch, in hash order; adds batch."""
    free = R.first_by(pool.join(approved.select(key), key, "left_anti"), [key], [F.col(domain)])
    n = R.numbered(free, [domain], [hash_order(F.col(key), salt="review"), F.col(key)], "_n")
    b = F.floor((F.col("_n") - 1) / quota).cast("int") - offset
    return n.withColumn("batch", b).where(F.col("batch").between(0, batches - 1)).drop("_n")


def merge_approved(old: DataFrame, new: DataFrame, key: str, on_duplicate: str = "error") -> DataFrame:
    """old and new rows; duplicates of a key are an error, skipped or replaced."""
    if on_duplicate == "replace":
        return R.upsert(old, new, key)
    if on_duplicate == "skip":
        return R.insert_missing(old, new, key)
    if clash := new.join(old.select(key), key, "left_semi").count():
        raise ValueError(f"{clash} rows are approved already")
    return old.unionByName(new)


def anchor_lines(lines: DataFrame, chapters: DataFrame, keys: Sequence[str], order: str, source: str = "source", target: str = "target") -> DataFrame:
    """Lines of the given chapters that may be replayed, the first of each source by order (unique)."""
    passed = lines.join(chapters.select(*keys).distinct(), list(keys), "left_semi").where(P.replay_ok(F.col(source), F.col(target))).withColumn("_h", F.sha2(source, 256))
    first = passed.groupBy("_h").agg(F.min(order).alias("_first"))
    return passed.join(first, "_h").where(F.col(order) == F.col("_first")).drop("_h", "_first")


def best_scored(df: DataFrame, score: str, least: float, n: int, ties: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The n best rows at or above least, and one row with the mean and the median of all scores."""
    return df.where(F.col(score) >= least).orderBy(F.col(score).desc(), *ties).limit(n), df.agg(F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"))


def sample_free(df: DataFrame, taken: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """n rows in hash order of those whose key isn't taken; all of them where n is 0 or there are no more."""
    free = df.join(taken.select(key).distinct(), key, "left_anti")
    if not n:
        return free
    ranked = row_numbers(free.withColumn("_o", F.struct(hash_order(F.col(key).cast("string"), salt=salt), F.col(key))), "_o", "_rn")
    return ranked.where(F.col("_rn") <= n).drop("_o", "_rn")


def short_sources(df: DataFrame, source: str, target: str, n: int, salt: str = "probe", size: tuple[int, int] = (6, 120)) -> DataFrame:
    """n rows in hash order whose source has a length within size and whose target is there."""
    rows = df.where(F.length(source).between(*size) & (F.coalesce(F.length(target), F.lit(0)) > 0)).withColumn("_k", F.concat_ws("\0", source, target))
    ranked = row_numbers(rows.withColumn("_o", F.struct(hash_order(F.col("_k"), salt=salt), F.col("_k"))), "_o", "_rn")
    return ranked.where(F.col("_rn") <= n).drop("_k", "_o", "_rn")


def sample_risks(df: DataFrame, order: str, source: str, target: str, limit: int) -> DataFrame:
    """One row: what the first `limit` rows by order that a replay would take have of risks, as counts."""
    s, t = F.col(source), F.col(target)
    taken = row_numbers(df.where((F.length(s) > 0) & (F.length(t) > 0) & ~P.register_leak(t)), order, "_rn").where(F.col("_rn") <= limit)
    author = r"(?iU)PS[：: ]|本章说|求(?:票|收藏|订阅)|(?:作者|笔者).{0,12}(?:说|写|感谢)|感谢.{0,18}(?:读者|编辑|书友)|完本"  # fixed value
    marks = r"\*\*|/\s*$|[（(]\s*[）)]|【\s*】"  # fixed value
    rules = {
        "damaged_source": s.rlike(marks), "uneven_quotes": (X.str_count(t, '"') % 2 == 1) | (X.str_count(t, "“") != X.str_count(t, "”")), "author_note": s.rlike(author),
        "length_ratio": (F.length(s) > 20) & ~(F.length(t) / F.greatest(F.length(s), F.lit(1))).between(0.25, 5.0),
    }
    return taken.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(test).alias(name) for name, test in rules.items()))
