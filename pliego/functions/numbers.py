"""Arithmetic of flags and scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.params import Params


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_multiple(value: Column, unit: int) -> Column:
    """Whether the value, rounded half to even, is a multiple of unit."""
    return F.rint(value).cast("long") % unit == 0


def tier(score: Column, p: Params) -> Column:
    """The tier of a score, lower borders inclusive; null has none, nor has a score below the lowest border."""
    found = F.lit(None).cast("string")
    for name, _, least in p.tiers:
        found = F.when(score >= least, F.lit(name)).otherwise(found)
    return found


def tier_order(name: Column, p: Params) -> Column:
    """0 for the highest tier."""
    names = [t[0] for t in reversed(p.tiers)]
    return reduce(lambda rest, i: F.when(name == names[i], F.lit(i)).otherwise(rest), reversed(range(len(names))), F.lit(None).cast("int"))


def shrunk(own: Column, group: Column, n: Column, k: float) -> Column:
    """own, drawn to the group's mean the more the fewer n are; where one of them is missing, the other."""
    w = n / (n + F.lit(k))
    return F.coalesce(w * own + (1 - w) * group, own, group)


def combined(contract: Column, entity: Column, contract_weight: float, entity_weight: float) -> Column:
    """The mean of both parts by weight; where one is missing, the other."""
    both = (contract * contract_weight + entity * entity_weight) / (contract_weight + entity_weight)
    return F.coalesce(both, contract, entity)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: the mean of value by weight, null weights as 0; the plain mean if all weights are 0. Null values don't count."""
    w = F.when(value.isNotNull(), F.coalesce(weight, F.lit(0.0)))
    return F.when(F.sum(w) > 0, F.sum(w * value) / F.sum(w)).otherwise(F.avg(value))


def weighted_parts(value: Column, weight: Column) -> list[Column]:
    """The sums that `mean_of_parts` needs, so that means of many levels come from one pass."""
    w = F.when(value.isNotNull(), F.coalesce(weight, F.lit(0.0)))
    return [F.sum(w * value).alias("wv"), F.sum(w).alias("w"), F.sum(value).alias("v"), F.count(value).alias("n")]


def mean_of_parts(wv: Column, w: Column, v: Column, n: Column) -> Column:
    return F.when(w > 0, wv / w).otherwise(ratio(v, n))


def rate(condition: Column) -> Column:
    """Aggregate: percentage of rows for which the condition holds; null counts as no."""
    return F.count_if(condition) * 100.0 / F.count("*")
