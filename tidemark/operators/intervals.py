"""Lookups of days in validity intervals by equality alone.

The days are the leaves of a binary tree. An interval is a few nodes that cover just its days, two a
level at most, and a day's ancestors are one node a level; a day lies in an interval if, and only if,
they share a node, and then it is one node. So a join on nodes makes each hit once and no other pair,
and what is asked of all of a day's intervals is added up by node before any day meets them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree over days from the year 1 to beyond 9999.
LEVELS = 22
_FIRST = "date'0001-01-01'"


def _number(day: str) -> str:
    return f"datediff({day}, {_FIRST})"


def covering(start: str, end: str) -> Column:
    """The (level, node) that cover the days from start to end, both included; null is open. None if end is before start."""
    low, high = f"greatest(coalesce({_number(start)}, 0), 0)", f"least(coalesce({_number(end)}, {2**LEVELS - 2}), {2**LEVELS - 2}) + 1"
    ends = f"transform(sequence(0, {LEVELS}), l -> named_struct('level', l, 'low', cast(ceil(({low}) / power(2, l)) as int), 'high', shiftright({high}, l)))"
    open_ = f"filter({ends}, x -> x.low < x.high)"
    nodes = "concat(if(x.low % 2 = 1, array(x.low), array()), if(x.high % 2 = 1, array(x.high - 1), array()))"
    return F.expr(f"flatten(transform({open_}, x -> transform({nodes}, n -> named_struct('level', x.level, 'node', n))))")


def ancestors(day: str) -> Column:
    """The (level, node) above a day; none for a null."""
    return F.expr(f"if({day} is null, cast(array() as array<struct<level: int, node: int>>), transform(sequence(0, {LEVELS}), l -> named_struct('level', l, 'node', shiftright({_number(day)}, l))))")


def hits(days: DataFrame, intervals: DataFrame, on: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """Rows of days joined to the intervals, with equal `on`, that hold their day: each hit once. Other column names differ."""
    left = days.select("*", F.inline(ancestors(day)))
    right = intervals.select("*", F.inline(covering(start, end)))
    return left.join(right, [*on, "level", "node"]).drop("level", "node")


def summed_hits(days: DataFrame, intervals: DataFrame, on: Sequence[str], day: str, start: str, end: str, figures: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """days with figures of the intervals that hold their day: name -> (column of intervals, "sum", "min" or "max"); null without any.

    (on, day) pairs meet the nodes' sums once each, so neither many equal days nor many intervals of one key make pairs.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    nodes = intervals.select(*on, F.inline(covering(start, end)), *[c.alias(n) for n, (c, _) in figures.items()])
    nodes = nodes.groupBy(*on, "level", "node").agg(*[how[kind](n).alias(n) for n, (_, kind) in figures.items()])
    asked = days.select(*on, day).where(F.col(day).isNotNull()).distinct().select(*on, day, F.inline(ancestors(day)))
    found = asked.join(nodes, [*on, "level", "node"]).groupBy(*on, day).agg(*[how[kind](n).alias(n) for n, (_, kind) in figures.items()])
    return days.join(found, [*on, day], "left")
