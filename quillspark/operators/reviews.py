"""Reviews: tags of source lines, invariants over several tables, strict replay, a probe of senses and windows of records.

Invariants are aggregates: each table is read once for all of its own, relations of two tables are anti joins. What can't
be told, such as a null, counts as broken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.corpus import hash_order

# What the tags stand for, and words that a strict style doesn't have.
TAG_DOMAIN = "系统|游戏|玩家|技能|装备|爆率|掉落|兵种|领主|战舰|护卫舰|机甲|魔法|妖兽|灵根"
TAG_NUMBER = r"\d|不|没|无|未|难|仅|只|除非|否则"
TAG_AUTHOR = "(?<!制)作者|更新|推荐票|收藏|读者|章节|点击榜|月票|投票"
QUOTES = (("“", "”"), ("「", "」"), ("『", "』"))
RISKS = {"dialogue": r"[“”\"「」『』]", "digits": r"\d", "long_line": ".{121,}", "latin": "(?<![A-Za-z])[A-Za-z][A-Za-z0-9_-]{1,}", "name_cue": r"名叫|叫做|姓名|名字|姓[㐀-鿿]|师姐|师兄|先生|小姐"}
GAME_CLASS = "(?i)游戏|玩家|副本|技能|装备|任务|等级|升级|系统|属性|公会|战队|网游|Boss|NPC|服务器"
GAME_LABELS = r"(?i)(?<![A-Za-z])(?:BOSS|NPC|PK|PVP|PVE|RPG|MMORPG|VIP|ID|GM|CD|EXP|HP|MP|BUFF|DEBUFF|DPS|AOE|AFK|KDA|LOL|DOTA|FPS|MOBA|UI|APP|SERVER|RANK|TOP|ALL[- ]?IN)(?![A-Za-z])"
LATIN_WORD = "(?<![A-Za-z])[A-Za-z][A-Za-z0-9_-]{2,}(?![A-Za-z])"
BANNED_STYLE = r"(?iU)(?<!\w)(?:tôi|bạn|cậu|cháu|anh ta|cô ta|cô ấy|cậu ta|ông ta|bà ta)(?!\w)"
SUBJECTS = {"他": "hắn", "她": "nàng", "我": "ta"}
OPENINGS = ("此时，", "片刻后，", "闻言，", "下一刻，", "想到这里，", "说到这里，")
CONTRAST = 8


def named_tags(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in their order; none for nulls."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def balanced(c: Column) -> Column:
    """Whether each kind of quote opens as often as it closes."""
    return reduce(Column.__and__, (F.regexp_count(c, F.lit(a)) == F.regexp_count(c, F.lit(b)) for a, b in QUOTES))


def review_tags(c: Column, domain: str = TAG_DOMAIN, number: str = TAG_NUMBER, author: str = TAG_AUTHOR) -> Column:
    n = F.length(c)
    return named_tags([("semantic_context", n >= 90), ("dialogue_register", c.rlike("[“「『]") & balanced(c)), ("domain_terms", c.rlike(domain)), ("number_negation", c.rlike(number)), ("quote_author", c.rlike(author)), ("natural_vi", n.between(20, 89))])


def risk_tags(c: Column, risks: Mapping[str, str] = RISKS) -> Column:
    return named_tags([(name, c.rlike(pattern)) for name, pattern in risks.items()])


def categories(c: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """Names of the categories of which a term occurs. terms: words of each category, a parameter."""
    return named_tags([(name, reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))) for name, words in terms.items() if words])


def classify(c: Column, game: str = GAME_CLASS) -> Column:
    return F.when(c.rlike(game), "game").otherwise("general")


def pair_labels(source: Column, target: Column, game: str = GAME_LABELS) -> Column:
    """Game words of a pair in capitals, sorted, then other Latin words that both sides have, in lower case, sorted."""
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    low = lambda x: F.transform(x, F.lower)
    games = F.array_sort(F.array_distinct(F.transform(found(F.concat_ws(" ", source, target), game), F.upper)))
    both = F.array_intersect(low(found(source, LATIN_WORD)), low(found(target, LATIN_WORD)))
    return F.concat(games, F.array_sort(F.array_except(both, low(games))))


class Rule(NamedTuple):
    """An invariant of one table: an aggregate that has to be true."""

    table: str
    name: str
    holds: Column


class Relation(NamedTuple):
    """An invariant of two tables on columns of equal names: disjoint, or left within right. Nulls are never shared."""

    left: str
    right: str
    name: str
    on: tuple[str, ...]
    kind: str


def size_is(table: str, n: int) -> Rule:
    return Rule(table, f"size is {n}", F.count(F.lit(1)) == n)


def unique(table: str, *columns: str) -> Rule:
    """No two rows agree in all of the columns, and none of these is null."""
    return Rule(table, f"unique {', '.join(columns)}", F.countDistinct(*columns) == F.count(F.lit(1)))


def every(table: str, name: str, predicate: Column) -> Rule:
    return Rule(table, name, F.count_if(~F.coalesce(predicate, F.lit(False))) == 0)


def checked(tables: Mapping[str, DataFrame], rules: Sequence[Rule | Relation]) -> DataFrame:
    """(rule, holds) of all invariants: a row each. An unknown table or column raises."""
    missing = {t for r in rules for t in ((r.table,) if isinstance(r, Rule) else (r.left, r.right))} - set(tables)
    if missing or not rules:
        raise ValueError(f"nothing to check, or unknown tables: {sorted(missing)}")
    out = []
    for name, df in tables.items():
        own = [r for r in rules if isinstance(r, Rule) and r.table == name]
        if own:
            row = df.agg(*(F.coalesce(r.holds, F.lit(False)).alias(f"r{i}") for i, r in enumerate(own)))
            out.append(row.select(F.inline(F.array(*(F.struct(F.lit(f"{name}: {r.name}").alias("rule"), F.col(f"r{i}").alias("holds")) for i, r in enumerate(own))))))
    for r in (r for r in rules if isinstance(r, Relation)):
        left, right, on = tables[r.left].select(*r.on), tables[r.right].select(*r.on), list(r.on)
        if r.kind not in ("disjoint", "within"):
            raise ValueError(f"no such kind: {r.kind}")
        bad = left.join(right, on, "left_semi" if r.kind == "disjoint" else "left_anti")
        out.append(bad.agg((F.count(F.lit(1)) == 0).alias("holds")).select(F.lit(f"{r.left}, {r.right}: {r.name}").alias("rule"), "holds"))
    return reduce(DataFrame.unionByName, out)


def require(tables: Mapping[str, DataFrame], rules: Sequence[Rule | Relation]) -> None:
    """Raises with the names of all invariants that don't hold; a row an invariant comes to the driver."""
    broken = sorted(r["rule"] for r in checked(tables, rules).where(~F.col("holds")).collect())
    if broken:
        raise ValueError("broken: " + "; ".join(broken))


def review_rules(candidates: str = "candidates", edits: str = "edits", approved: str = "approved", locked: str = "locked", size: int | None = None) -> list[Rule | Relation]:
    """What holds between candidates (id, zh, raw_vi, tags), edits (id, vi), approved rows (id, zh, vi, status) and locked
    evaluation rows (zh): ids and sources are unique, each edit and approved row has its candidate, sources aren't changed, all
    approved rows were edited and have a form without leftover script, and nothing that is approved is locked."""
    rules = [
        unique(candidates, "id"), unique(candidates, "zh"), unique(edits, "id"), unique(approved, "id"), unique(approved, "zh"), unique(locked, "zh"), every(candidates, "has tags", F.size("tags") > 0),
        every(edits, "form filled", F.trim("vi") != ""), every(approved, "form filled, without leftover script", (F.trim("vi") != "") & ~F.col("vi").rlike(r"[㐀-鿿]")), every(approved, "status", F.col("status") == "approved"),
        Relation(edits, candidates, "edits are of candidates", ("id",), "within"), Relation(approved, candidates, "sources unchanged", ("id", "zh"), "within"), Relation(approved, edits, "forms are the edits'", ("id", "vi"), "within"), Relation(approved, locked, "nothing locked is approved", ("zh",), "disjoint"),
    ]
    return rules + ([size_is(candidates, size), size_is(edits, size)] if size is not None else [])


def subject_of(c: Column, subjects: Sequence[str] = tuple(SUBJECTS), openings: Sequence[str] = OPENINGS) -> Column:
    """The pronoun that a line begins with, behind one of the openings; null for others."""
    bare = F.regexp_replace(c, "^(?:" + "|".join(openings) + ")", "")
    first = F.substring(bare, 1, 1)
    return F.when(first.isin(*subjects), first)


def strict_replay(historical: DataFrame, booster: DataFrame, gold: DataFrame, locked: DataFrame, style_ok: Column, per_subject: int = 60, subjects: Mapping[str, str] = SUBJECTS, salt: str = "replay") -> DataFrame:
    """(zh, vi, source_type): historical rows of a strict style and per_subject booster rows of each subject, none with a source
    of gold, locked or historical rows.

    style_ok is a column over vi. Of equal pairs one stays; of the booster's the first by hash. Raises if a subject is short,
    if a source has two targets, or if sources overlap, rather than returning such rows. Null sources and targets go.
    """
    from quillspark.sources.sinks import settled

    strict = style_ok & ~F.col("vi").rlike(BANNED_STYLE)
    filled = lambda df: df.select("zh", "vi").where("zh is not null and vi is not null").distinct()
    blocked = gold.select("zh").union(locked.select("zh")).distinct()
    old = filled(historical).join(blocked, "zh", "left_anti").where(strict).withColumn("source_type", F.lit("historical_strict"))
    free = filled(booster).join(blocked, "zh", "left_anti").join(old.select("zh").distinct(), "zh", "left_anti").where(strict)
    free = free.withColumn("subject", subject_of(F.col("zh"), list(subjects))).where("subject is not null")
    nth = F.row_number().over(Window.partitionBy("subject").orderBy(hash_order(F.col("zh"), salt=salt), "zh", "vi"))
    target = F.coalesce(*(F.when(F.col("subject") == k, v) for k, v in subjects.items()))
    chosen = free.withColumn("nth", nth).where(F.col("nth") <= per_subject).select("zh", "vi", F.concat(F.lit("register_booster_"), target).alias("source_type"))
    out = settled(old.unionByName(chosen))
    counts = {v: F.count_if(F.col("source_type") == f"register_booster_{v}") >= per_subject for v in subjects.values()}
    rules = [unique("replay", "zh"), *(Rule("replay", f"{per_subject} of {v}", c) for v, c in counts.items()), Relation("replay", "blocked", "no source is blocked", ("zh",), "disjoint")]
    require({"replay": out, "blocked": blocked}, rules)
    return out


def sense_probe(examples: DataFrame, contrast: int = CONTRAST, domain: str = "dictdis_polysemy") -> DataFrame:
    """(zh, vi, domain, status) of examples (term, sense, zh, vi), if all of them have their term in the source and a target,
    no source occurs twice, and no sense of a term has over `contrast` times the examples of another one; raises otherwise."""
    counts = examples.groupBy("term", "sense").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    rules = [every("examples", "term in source", F.contains("zh", "term")), every("examples", "target filled", F.trim("vi") != ""), unique("examples", "zh"), every("senses", f"contrast up to {contrast}", F.col("most") <= F.col("least") * contrast)]
    require({"examples": examples, "senses": counts}, rules)
    return examples.select("zh", "vi", F.lit(domain).alias("domain"), F.lit("approved").alias("status"))


def record_window(records: DataFrame, order: Sequence[str], pairs: str, most_records: int, most_pairs: int) -> DataFrame:
    """The first most_pairs pairs (array<array<string>>) of the first most_records records in order, a row each: the records'
    other columns, nth from 0, left, right. Pairs of another size are left out and keep their place; the limits are the
    feature, and most_records a bounded number."""
    rows = records.orderBy(*order).limit(most_records)
    rows = rows.select(*(c for c in records.columns if c != pairs), F.posexplode(F.slice(pairs, 1, most_pairs)).alias("nth", "_p"))
    return rows.where(F.size("_p") == 2).withColumns({"left": F.col("_p")[0], "right": F.col("_p")[1]}).drop("_p")
