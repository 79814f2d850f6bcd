"""Deterministic numbers of the idle game, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative cost of the tiers, each step twice the last.
TIER_COSTS = (5, 15, 35, 75, 155, 315)
GRADES = {"common": 1, "fine": 2, "rare": 4, "epic": 8}


def requirement(stage: Column) -> Column:
    return F.floor(300 * F.pow(F.lit(1.3), stage))


def high_requirement(base: Column, tier: Column) -> Column:
    return F.floor(base * F.pow(F.lit(1.6), tier + 1))


def grade_multiplier(grade: Column) -> Column:
    out = F.lit(1)
    for name, m in GRADES.items():
        out = F.when(grade == name, m).otherwise(out)
    return out


def tier_of(points: Column) -> Column:
    """How many tiers the points pay for."""
    return sum(((points >= c).cast("int") for c in TIER_COSTS), F.lit(0))


def tier_multiplier(points: Column) -> Column:
    """1 for each tier, the part of the next one linearly, and a tenth for each point past the last."""
    tier = tier_of(points)
    share = F.lit(0.0)
    for i, (a, b) in enumerate(zip((0, *TIER_COSTS), TIER_COSTS, strict=False)):
        share = F.when(tier == i, (points - a) / F.lit(float(b - a))).otherwise(share)
    return 1 + tier + F.when(points > TIER_COSTS[-1], (points - TIER_COSTS[-1]) * 0.1).otherwise(share)


def tick(elapsed_s: Column, rate: Column, buff: Column, buff_s: Column, cap_s: int = 48 * 3600) -> Column:
    """Gain over elapsed seconds, 48 hours at most, with a buff over part of them."""
    t = F.greatest(F.lit(0), F.least(elapsed_s, F.lit(cap_s)))
    return F.floor(rate * t + rate * buff / 100 * F.least(t, F.greatest(buff_s, F.lit(0))))


def loss(amount: Column, defence: Column) -> Column:
    return F.floor(amount * 0.3 * (1 - F.least(F.lit(0.5), defence / (defence + 1000.0))))


def recycle_gain(spare: Column, grade: Column, cap: int = 100_000) -> Column:
    return F.least(spare * grade * grade * 20, F.lit(cap))


def success_chance(base: Column, bonus: Column, least: float = 0.05, most: float = 0.95) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), base + bonus))


def advanced(stage: Column, points: Column, need: Column, chance: Column, draw: Column, defence: Column) -> tuple[Column, Column]:
    """(stage, points) after an attempt: a step up for the points on success, a softened loss on failure, nothing without them.

    draw: a uniform number of the row, so that results can be repeated.
    """
    able, won = points >= need, draw < chance
    return stage + (able & won).cast("int"), F.when(able & won, points - need).when(able, points - loss(points, defence)).otherwise(points)


def live_streak(streak: Column, last_day: Column, today: Column) -> Column:
    """The stored streak if it reaches yesterday, else 0."""
    return F.when(F.datediff(today, last_day) <= 1, streak).otherwise(0)


def next_streak(streak: Column, last_day: Column, today: Column) -> Column:
    """The streak after reading today: unchanged today, one more from yesterday, else 1."""
    gap = F.datediff(today, last_day)
    return F.when(gap == 0, streak).when(gap == 1, streak + 1).otherwise(1)


def state_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
