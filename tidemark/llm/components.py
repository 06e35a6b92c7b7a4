"""Connected components of links held in a DataFrame, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .spread import looked_up


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(a, b) links of any orderable type -> (id, label) for each id in a link; label is its component's smallest id.

    In each round an id goes to the foremost of itself and its neighbours (in order of the ids at first,
    then of a hash that changes with the round, so that no chain is slow) and links are renamed
    accordingly, until none is left. A round is a grouped minimum joined to both ends of the links, so a
    hub is never gathered; each round is stored. Then the rounds' names, fewer in each, are followed from
    the last one back, and ids that share a name are looked up without meeting in one task. Nulls, self
    links and repeats are ignored; no links give no rows.
    """
    e = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a is not null and b is not null and a != b")
    e, steps = stored(e), []
    while not e.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"links did not settle in {rounds} rounds")
        order = [F.xxhash64("v", F.lit(len(steps)))] * bool(steps)
        low = e.union(e.select("v", "u")).groupBy("u").agg(F.min(F.struct(*order, "v")).alias("v"))
        own = F.struct(*[F.xxhash64("u", F.lit(len(steps)))] * bool(steps), F.col("u").alias("v"))
        low = stored(low.select("u", F.when(own < F.col("v"), F.col("u")).otherwise(F.col("v.v")).alias("m")))
        steps.append(low)
        left = stored(looked_up(e, low, ["u"]).select(F.col("found.m").alias("m"), "v"))
        e = stored(looked_up(left, low.select(F.col("u").alias("v"), F.col("m").alias("to")), ["v"]).select(F.col("m").alias("u"), F.col("found.to").alias("v")).where("u != v"))
    if not steps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    named = steps[0].select(F.col("u").alias("id"), F.col("m").alias("label"))
    if len(steps) == 1:
        return named
    # label -> where it ends, from the last round to the second.
    ends = steps[-1].select(F.col("u").alias("label"), F.col("m").alias("end"))
    for step in steps[-2:0:-1]:
        step = step.select(F.col("u").alias("label"), F.col("m").alias("at"))
        back = looked_up(step, ends.select(F.col("label").alias("at"), "end"), ["at"])
        ends = stored(back.select("label", F.coalesce("found.end", "at").alias("end")))
    least = stored(named.groupBy("label").agg(F.min("id").alias("least")))
    least = stored(looked_up(least, ends, ["label"]).select("label", "least", F.coalesce("found.end", "label").alias("end")))
    whole = stored(least.groupBy("end").agg(F.min("least").alias("all")))
    least = stored(looked_up(least, whole, ["end"]).select("label", F.col("found.all").alias("least")))
    return looked_up(named, least, ["label"]).select("id", F.col("found.least").alias("label"))
