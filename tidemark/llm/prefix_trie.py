"""The trie of conversations' shared beginnings, by partition refinement.

A class is a set of conversations that are equal up to some turn; the first class holds all, at the root.
In each round every class is followed to its first turn on which members differ: the turns before are
nodes one under another, each with one child, and there the class splits into one class for each turn
found. A class whose members never differ again, as one with a single member, retires: all its turns
left are such a chain. So rounds are as many as there are forks on a path, not turns. Folding back runs
from the last round to the first and adds each class's leaves and savings to the class it came from.

Turns are known by 128 bits of role and text. Whatever may hold a third of all rows is dealt out: rows
of a conversation or a chain by blocks of 1,024 turns, members of a class by conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, small_batches, stored
from .spread import looked_up

#: Turns of a conversation, or nodes of a chain, that stay together: 2**BLOCK.
BLOCK = 10
#: Parts that the members of a class are dealt to.
DEALS = 16
#: Characters of ids that are joined before they are hashed.
MOST_CHARS = 1 << 20


def _block(depth: str = "depth") -> Column:
    return F.expr(f"shiftright({depth}, {BLOCK})")


def _in_blocks(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each block from depth `start` to depth `end`, with its number as `block`."""
    return df.withColumn("block", F.explode(F.sequence(_block(start), _block(end))))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n, key, size): turns numbered from 1 in each conversation, ordered by turn, role and text, nulls first.

    key: 128 bits of role and text, null as empty; size: the text's UTF-8 bytes. Rows without a
    conversation are left out. Rows are dealt by ranges of (conversation, turn), so a conversation of any
    length lies in many tasks; what it has in earlier ranges is added from one row for each range.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = picked(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    rows = rows.select(F.col("conv").cast("long"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartitionByRange(n_tasks(spark), "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key")
    counted = stored(rows.select("conv", key, F.octet_length("text").cast("long").alias("size")).mapInArrow(_counted, "part int, conv long, n long, key binary, size long"))
    # One row for each range.
    carried, last, held = [], None, 0
    for r in counted.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "n")).alias("last")).orderBy("part").collect():
        if r.first == last:
            carried.append((r.part, r.first, held))
        held = r.last.n + (held if r.first == r.last.conv == last else 0)
        last = r.last.conv
    before = spark.createDataFrame(carried, "part int, conv long, before long")
    return counted.join(F.broadcast(before), ["part", "conv"], "left").select("conv", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "key", "size")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        fresh = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
        n = np.arange(len(conv)) - np.repeat(fresh, np.diff(fresh, append=len(conv))) + 1
        if conv[0] == last:
            n[: fresh[1] if len(fresh) > 1 else len(conv)] += held
        last, held = conv[-1], int(n[-1])
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(conv), part, np.int32)), "conv": batch.column("conv"), "n": pa.array(n), "key": batch.column("key"), "size": batch.column("size")})


def whole(turns: DataFrame) -> DataFrame:
    """Numbered turns as rows of a trie: (conv, depth, key, size, total), total being the conversation's turns."""
    counts = turns.groupBy("conv").agg(F.max("n").alias("n"))
    rows = looked_up(turns, counts.select("conv", F.col("n").alias("total")), ["conv"], counts)
    return rows.select("conv", F.col("n").alias("depth"), "key", "size", "found.total")


def spliced(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Rows of a trie, of conversations that begin like another one.

    Conversation c gets the first h turns of conversation c - c % every, all if it has fewer and none if
    it isn't there, then its own turns after its first h; h is the unsigned CRC-32 of c's digits % most.
    One left without any turn has a row of depth 0 alone.
    """
    turns = stored(turns)
    counts = stored(turns.groupBy("conv").agg(F.max("n").alias("n")))
    own = counts.select("conv", "n", F.expr(f"conv - conv % {every}").alias("source"), F.expr(f"crc32(cast(cast(conv as string) as binary)) % {most}").alias("h"))
    plan = own.join(counts.select(F.col("conv").alias("source"), F.col("n").alias("there")), "source", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("total", F.expr("taken + greatest(n - h, 0)"))
    plan = stored(plan.select("conv", "source", "n", "h", "taken", "total"))
    heads = turns.where(F.col("n") < most).select(F.col("conv").alias("source"), F.col("n").alias("depth"), "key", "size")
    heads = plan.select("conv", "source", "taken", "total").join(heads, "source").where("depth <= taken").select("conv", "depth", "key", "size", "total")
    tails = looked_up(turns, plan.select("conv", "h", "taken", "total"), ["conv"], counts).where("n > found.h")
    tails = tails.select("conv", F.expr("n - found.h + found.taken").alias("depth"), "key", "size", "found.total")
    empty = plan.where("total = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size"), "total")
    return heads.unionByName(tails).unionByName(empty)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of `rows`, (conv, depth, key, size, total) with depths from 1 to total.

    (conv_id, depth): the node, by the smallest conversation in it and its turns; the root has depth 0.
    parent_conv_id; n_convs: conversations that begin with the node's turns; n_children; n_leaves: nodes
    without children under it or itself; saved_tokens: bytes that all but one conversation of a node share
    in its last turn, added up under it and in it; ends_sha256: of the ids, ascending and joined by commas, of conversations
    that end there. No conversations give no rows. A conversation without turns may have a row of depth 0.
    """
    spark = rows.sparkSession
    no_key = F.lit(b"")
    tops = rows.where("depth = 1 or total = 0").select("conv", F.lit(0).cast("long").alias("depth"), no_key.alias("key"), F.lit(0).cast("long").alias("size"), "total")
    active = rows.where("depth > 0").unionByName(tops)
    active = stored(active.select("*", no_key.alias("cls"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("above")))
    chains, ends, classes = [], [], []
    while True:
        seen = active.groupBy("cls", "depth").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("conv").alias("conv"), F.min("size").alias("size"), F.min("up").alias("up"), F.min("above").alias("above"))
        seen = stored(seen)
        fork = seen.groupBy("cls").agg(F.min(F.when(F.col("low") != F.col("high"), F.col("depth"))).alias("fork"), F.min("depth").alias("start"), F.max("depth").alias("deepest")).where("fork is not null")
        fork = fork.join(seen.select("cls", (F.col("depth") + 1).alias("fork"), F.col("conv").alias("above")), ["cls", "fork"], "left")
        fork = stored(fork)
        forks = fork.count()
        if forks:
            # Nodes of a chain lie by blocks of depths, members by a hash of their id: no class is one task's.
            until = _in_blocks(fork.select("cls", "fork", "start", "deepest"), "start", "deepest").select("cls", "block", "fork")
            chain = seen.withColumn("block", _block()).join(until, ["cls", "block"], "left").where("fork is null or depth < fork")
            dealt = active.drop("up", "above").withColumn("deal", F.pmod(F.xxhash64("conv"), F.lit(DEALS)).cast("int"))
            split = fork.select("cls", "fork", "above").withColumn("deal", F.explode(F.expr(f"sequence(0, {DEALS - 1})")))
            dealt = dealt.join(split, ["cls", "deal"], "left").drop("deal")
            dealt = stored(dealt.where("fork is null and depth = total or depth < fork and depth = total or depth >= fork"))
            ended = dealt.where("depth = total and (fork is null or depth < fork)")
        else:
            chain, ended = seen, active.where("depth = total")
        chains.append(stored(chain.select("cls", "up", "above", "depth", "n", "conv", F.expr("(n - 1) * size").alias("saved"))))
        ends.append(ended.select("cls", "depth", "conv"))
        classes.append(chains[-1].groupBy("cls").agg(F.min("up").alias("up"), F.min("depth").alias("start"), F.max("depth").alias("end"), F.sum("saved").alias("saved")))
        if not forks:
            break
        going = dealt.where("depth >= fork")
        label = F.unhex(F.md5(F.concat("cls", F.lit(b"/"), "key")))
        begun = _in_blocks(going.where("depth = fork").select("conv", "fork", "total", label.alias("label")), "fork", "total").select("conv", "block", "label")
        going = going.withColumn("block", _block()).join(begun, ["conv", "block"])
        active = stored(going.select("conv", "depth", "key", "size", "total", F.col("label").alias("cls"), F.col("cls").alias("up"), "above"))
    placed, below = [], None
    for own in reversed(classes):
        if below is None:
            own = own.select("*", F.lit(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("under"))
        else:
            sums = below.groupBy(F.col("up").alias("cls")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + F.col("under")).alias("under"))
            own = own.join(sums, "cls", "left").select("cls", "up", "start", "end", "saved", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("under", F.lit(0)).alias("under"))
        below = stored(own)
        placed.append(below)
    nodes = _placed(reduce(DataFrame.unionByName, chains), reduce(DataFrame.unionByName, placed))
    out = nodes.join(_digests(reduce(DataFrame.unionByName, ends)), ["cls", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _placed(chain: DataFrame, classes: DataFrame) -> DataFrame:
    """The nodes of chains with what is under them and the node above; a window holds 1,024 nodes of a chain at most."""
    chain = chain.withColumn("block", _block())
    within = Window.partitionBy("cls", "block").orderBy("depth")
    rows = chain.withColumn("tail", F.sum("saved").over(within.rowsBetween(0, Window.unboundedFollowing))).withColumn("previous", F.lag("conv").over(within))
    blocks = chain.groupBy("cls", "block").agg(F.sum("saved").alias("saved"), F.max(F.struct("depth", "conv")).getField("conv").alias("last"))
    along = Window.partitionBy("cls").orderBy("block")
    blocks = blocks.select("cls", "block", F.sum("saved").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"), F.lag("last").over(along).alias("earlier"))
    known = _in_blocks(classes, "start", "end").select("cls", "block", "end", "kids", "leaves", "under").join(blocks, ["cls", "block"])
    rows = rows.join(known, ["cls", "block"])
    return rows.select(
        "cls", "depth", F.col("conv").alias("conv_id"), F.coalesce("previous", "earlier", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("end"), F.lit(1).cast("long")).otherwise(F.col("kids")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("tail") + F.coalesce("later", F.lit(0)) + F.col("under")).alias("saved_tokens"),
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(cls, depth, sha): the SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted and joined in ranges; what one node's task reads in order are joined texts, of which
    it holds one at a time, as the digest of a sequence can't be taken in parts.
    """
    n = n_tasks(ends.sparkSession)
    ranges = ends.repartitionByRange(n, "cls", "depth", "conv").sortWithinPartitions("cls", "depth", "conv")
    texts = ranges.mapInArrow(_texts, "cls binary, depth long, conv long, ids string")
    return texts.repartition(n, "cls", "depth").sortWithinPartitions("cls", "depth", "conv").mapInArrow(_hashed, "cls binary, depth long, sha string")


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ("cls", "depth", "conv", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string())
    node, first, ids, size, out, held = None, None, [], 0, [], 0
    for batch in batches:
        for cls, depth, conv in zip(*[batch.column(c).to_pylist() for c in ("cls", "depth", "conv")], strict=True):
            if (cls, depth) != node or size >= MOST_CHARS:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                    held += size
                    if held >= MOST_CHARS or len(out) >= 10_000:
                        yield _batch(out, names, types)
                        out, held = [], 0
                node, first, ids, size = (cls, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*node, first, ",".join(ids)))
        yield _batch(out, names, types)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ("cls", "depth", "sha"), (pa.binary(), pa.int64(), pa.string())
    node, sha, out = None, None, []
    for batch in batches:
        for cls, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("cls", "depth", "ids")], strict=True):
            if (cls, depth) == node:
                sha.update(b",")
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (cls, depth), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 10_000:
            yield _batch(out, names, types)
            out = []
    if node:
        yield _batch([*out, (*node, sha.hexdigest())], names, types)
