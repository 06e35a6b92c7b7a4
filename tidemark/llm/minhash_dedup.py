"""Near-duplicate documents by a chosen-path set similarity join.

1. Each text becomes its set of word shingles; equal sets are one item from here on (so a large group
   of copies costs as much as one document). An item's minwise tokens are `coordinates` numbers.
2. `trees` independent trees branch the items: at each level a node picks one coordinate, or two with
   probability 2 / threshold - 2 or so, from its own id, and sends an item to the children named by the
   item's tokens there. A choice depends on the node alone, so a path is computed where the item is.
3. Nodes with more than one item are compared exhaustively on the minwise tokens. Estimates five
   standard deviations under the threshold still count, so what is left are candidate groups.
4. Candidate groups get their texts, and links are confirmed on those texts' full sets of shingles (the
   words themselves, not hashes), exhaustively but for pairs that links already connect.
Groups beyond a task's limit are cut into chunks: links within chunks, links between one
representative of each connected part, then what still is apart is compared chunk by chunk.

All trees pick from the same coordinates, so they are not independent given two sets: of a pair at the
threshold, m coordinates agree with binomial chance, and then a tree misses it with 1 - survival(m /
COORDINATES). The number of trees is the smallest for which the mean of this to the power of the trees
is at most `miss`. Pairs more alike than the threshold are missed less often.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rows import picked
from .scratch import small_batches, stored
from .spread import looked_up
from .words import SPACE_WORDS, Words, mix, pieces, ranges, windows

COORDINATES = 64
#: Items that one task compares, about: by minwise tokens (128 bytes an item), by full sets; bytes of them.
SKETCH_LIMIT, SET_LIMIT, LIMIT_BYTES = 4096, 512, 8 << 20
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Of each text, the sorted distinct hashes of its k-word shingles (one for a shorter text, none without words), and 128 bits that name the set."""
    w = Words(texts, SPACE_WORDS, lower=True)
    both = [w.hashes(seed) for seed in (0, 1)]
    grams = [windows(h, k) for h in both]
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        x, y = (g[a : b - k + 1] for g in grams) if b - a >= k else (windows(h[a:b], b - a) if b > a else h[:0] for h in both)
        x, first = np.unique(x, return_index=True)
        yield x, np.array([mix(x, 11).sum() + np.uint64(len(x)), mix(y[first], 13).sum()], np.uint64).tobytes() if len(x) else b""


def shingle_numbers(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's k-word shingles; equal numbers are equal words, in these texts alone."""
    w = Words(texts, SPACE_WORDS, lower=True)
    word = w.numbers()
    code, short, out = word, {}, []
    for j in range(1, k):
        if j > 1:  # so that numbers stay small enough to be put together
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * len(word) + word[j:]
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(code[a : b - k + 1]))
        else:
            out.append(np.array([short.setdefault(tuple(word[a:b].tolist()), -1 - len(short))] if b > a else [], np.int64))
    return out


def minwise(x: np.ndarray) -> bytes:
    """16 bits of the smallest of each of COORDINATES hashes of x."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 4096):
        y = (x[None, i : i + 4096] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]
        np.minimum(least, y.min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, key, tokens) for each row of docs."""

    def run(batches):
        for p in pieces(batches):
            keys, tokens, sizes = [], [], []
            for x, key in shingle_sets(p.column("text"), k):
                keys.append(key)
                sizes.append(len(x))
                tokens.append(minwise(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "key", "tokens"])

    slim = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, key binary, tokens binary")


def survival(s: float, threshold: float, depth: int) -> float:
    """Chance that two items of similarity s share a node at this depth of one tree."""
    second, f = 1 / threshold - 1, 1.0
    for _ in range(depth):
        x = s * f
        f = (1 - second) * x + second * (2 * x - x * x)
    return f


def trees_for(miss: float, threshold: float, depth: int) -> int:
    """Trees with which a pair at the threshold shares no node with chance `miss` at most; see above."""
    chance = [math.comb(COORDINATES, m) * threshold**m * (1 - threshold) ** (COORDINATES - m) for m in range(COORDINATES + 1)]
    lost = [1 - survival(m / COORDINATES, threshold, depth) for m in range(COORDINATES + 1)]
    trees = 1
    while sum(p * x**trees for p, x in zip(chance, lost, strict=True)) > miss:
        trees += 1
    return trees


def tree_nodes(items: DataFrame, depth: int, trees: int, threshold: float) -> DataFrame:
    """(grp, item): the nodes that each item (key, tokens) reaches; item is a 64-bit hash of the key."""
    second = int((1 / threshold - 1) * 2**32)

    def run(batches):
        for b in batches:
            t = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint16).reshape(-1, COORDINATES).astype(np.uint64)
            item = np.tile(np.arange(len(t)), trees)
            node = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64), 101), len(t))
            for level in range(depth):
                pick = mix(node, 211 + level)
                first = (pick % np.uint64(COORDINATES)).astype(np.int64)
                child = mix(node ^ mix(t[item, first] + np.uint64(1)), 307) + first.astype(np.uint64)
                two = np.flatnonzero((pick >> np.uint64(32)) < second)
                step = 1 + ((pick[two] >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)
                other = (first[two] + step) % COORDINATES
                child2 = mix(node[two] ^ mix(t[item[two], other] + np.uint64(1)), 307) + other.astype(np.uint64)
                node, item = np.concatenate([child, child2]), np.concatenate([item, item[two]])
            ids = b.column("item").to_numpy()[item]
            for i in range(0, len(item), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 65536].view(np.int64)), pa.array(ids[i : i + 65536])], ["grp", "item"])

    return items.select(F.xxhash64("key").alias("item"), "tokens").mapInArrow(run, "grp long, item long")


class Sketches:
    """Minwise tokens of some items; near(q, of) tells which may be similar to item q."""

    def __init__(self, payloads: list[bytes], threshold: float):
        self.t = np.frombuffer(b"".join(payloads), np.uint16).reshape(-1, COORDINATES)
        self.least = math.floor(COORDINATES * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)))

    def near(self, q: int, of: np.ndarray) -> np.ndarray:
        return (self.t[of] == self.t[q]).sum(axis=1) >= self.least


class Sets:
    """Full shingle sets of some items, given as texts; near(q, of) tells which are similar to item q."""

    def __init__(self, payloads: list[bytes], threshold: float, shingle: int):
        sets = shingle_numbers(pa.array(payloads, pa.large_binary()), shingle)
        self.sizes = np.array([len(x) for x in sets])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.all = np.concatenate(sets)
        self.percent = round(100 * threshold)

    def near(self, q: int, of: np.ndarray) -> np.ndarray:
        n, m = self.sizes[of], self.sizes[q]
        out = np.zeros(len(of), bool)
        able = np.flatnonzero(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        if len(able):
            x, own = self.all[ranges(self.at[of[able]], n[able])], self.all[self.at[q] : self.at[q] + m]
            hit = own[np.minimum(np.searchsorted(own, x), m - 1)] == x
            both = np.add.reduceat(hit, np.cumsum(n[able]) - n[able], dtype=np.int64)
            out[able] = 100 * both >= self.percent * (n[able] + m - both)
        return out


def connected_parts(items: Sketches | Sets, n: int) -> np.ndarray:
    """A number for each of n items: that of the connected part it is in. Pairs known to be connected aren't compared."""
    part, left, number = np.zeros(n, np.int64), np.arange(n), 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        part[queue[0]] = number
        while queue and len(left):
            near = items.near(queue.pop(), left)
            part[left[near]] = number
            queue += left[near].tolist()
            left = left[~near]
        number += 1
    return part


def cross_links(items: Sketches | Sets, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links between left and right items that connect what part (a number for each connected part) has apart."""
    links, part = [], part.copy()
    for q in right.tolist():
        while len(of := left[part[left] != part[q]]):
            near = of[items.near(q, of)]
            if not len(near):
                break
            parts, first = np.unique(part[near], return_index=True)
            links += [(q, x) for x in near[first].tolist()]
            part[np.isin(part, parts)] = part[q]
    return links


LINKS = "a binary, b binary"


def links_within(members: DataFrame, kind: Callable[[list[bytes]], Sketches | Sets], limit: int) -> DataFrame:
    """members: (grp, key, payload), stored. Links that connect, in each group, what all similar pairs there connect.

    A group is cut into chunks of about `limit` rows and LIMIT_BYTES at most, and each key gets its
    connected part's smallest key as head; heads of a group that has chunks go through that once more.
    Keys of such a group that are still apart are compared chunk by chunk.
    """
    chunks = F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum(F.octet_length("payload")) / LIMIT_BYTES)).cast("int").alias("chunks")
    large = stored(members.groupBy("grp").agg(chunks).where("chunks > 1"))
    kinds = {c: members.schema[c].dataType.simpleString() for c in ("grp", "key")}

    def heads(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        part = connected_parts(kind(table.column("payload").to_pylist()), len(keys))
        least: dict[int, bytes] = {}
        for p, k in zip(part.tolist(), keys, strict=True):
            least[p] = min(least.get(p, k), k)
        return table.select(["grp", "big", "key"]).append_column("head", pa.array([least[p] for p in part.tolist()], pa.binary()))

    def headed(df: DataFrame) -> DataFrame:
        """df: (grp, key, payload, chunks), chunks null for a group that is one chunk."""
        chunk = F.coalesce(F.pmod(F.xxhash64("key"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk")
        dealt = df.select("grp", F.col("chunks").isNotNull().alias("big"), "key", "payload", chunk)
        return dealt.groupBy("grp", "chunk").applyInArrow(heads, f"grp {kinds['grp']}, big boolean, key binary, head binary")

    def linked(df: DataFrame) -> DataFrame:
        return df.where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b"))

    if large.isEmpty():
        return linked(headed(members.withColumn("chunks", F.lit(None).cast("int"))))
    first = stored(headed(looked_up(members, large, ["grp"]).select("grp", "key", "payload", "found.chunks")))
    links = linked(first)
    first = stored(first.where("big").select("grp", "key", "head"))
    tops = stored(members.join(first.where("key = head").select("grp", "key"), ["grp", "key"]))
    second = stored(headed(looked_up(tops, tops.groupBy("grp").agg(chunks), ["grp"]).select("grp", "key", "payload", "found.chunks")))
    links = links.union(linked(second))

    named = second.select("grp", F.col("key").alias("head"), F.col("head").alias("label"))
    label = stored(looked_up(first, named, ["grp", "head"]).select("grp", "key", F.col("found.label").alias("label")))
    count = label.groupBy("grp", "label").agg(F.count("*").alias("own"))
    main = count.groupBy("grp").agg(F.max_by("label", F.struct("own", "label")).alias("main"), F.sum("own").alias("n"), (F.sum("own") - F.max("own")).alias("rest"))
    main = main.where("rest > 0").join(large, "grp")
    # The rest's share of the group's chunks.
    main = stored(main.select("grp", "main", "chunks", F.ceil(F.col("chunks") * F.col("rest") / F.col("n")).cast("int").alias("rests")))
    if main.isEmpty():
        return links
    open_ = looked_up(label, main, ["grp"]).where("found is not null").select("grp", "key", "label", "found.*")
    i, j = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("rests")).cast("int")
    open_ = stored(members.join(open_, ["grp", "key"]).withColumn("i", i).withColumn("j", j))
    left = open_.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("side", F.lit(0))
    right = open_.where("label != main").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1))
    columns = ["grp", "i", "j", "key", "payload", "label", "side"]
    tasks = left.select(*columns).union(right.select(*columns))

    def across(table: pa.Table) -> pa.Table:
        keys, side = table.column("key").to_pylist(), table.column("side").to_numpy()
        part = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        found = cross_links(kind(table.column("payload").to_pylist()), np.flatnonzero(side == 0), np.flatnonzero(side == 1), part)
        return pa.table({"a": pa.array([keys[x] for x, _ in found], pa.binary()), "b": pa.array([keys[y] for _, y in found], pa.binary())})

    return links.union(tasks.groupBy("grp", "i", "j").applyInArrow(across, LINKS))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; documents link at Jaccard >= threshold.

    shingle: words in a shingle, of the text in lower case (A-Z). A shorter text is one shingle. miss:
    chance at most that the trees lose a link at the threshold itself (the trees' number follows, see
    above; closer links are lost less often). component_id is the smallest id among all documents that
    links connect, the document's own included; kept says whether the row has that id.

    Null, empty or wordless texts have n_shingles 0 and link with nothing: component_id is their own id.
    A row with a null id takes part, but its id is never a component's; alone it has component_id null;
    such rows are kept unless a component has an id. Rows that repeat an id are rows of their own: equal
    sets link, and all rows with the smallest id are kept. Other columns of docs play no part.
    """
    small_batches(docs.sparkSession)
    base = stored(profiles(docs, id_col, text_col, shingle))
    n = base.where("n_shingles > 0").select(F.approx_count_distinct("key", 0.02)).first()[0]
    depth = max(2, math.ceil(math.log(max(n, 2) / 4) / math.log(20)))

    items = stored(base.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens")))
    nodes = tree_nodes(items, depth, trees_for(miss, threshold, depth), threshold)
    shared = nodes.groupBy("grp").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = stored(shared.select("grp", "n", F.lit(True).alias("is")))
    members = looked_up(nodes, shared.select("grp", "is"), ["grp"], counts=shared.select("grp", "n")).where("found is not null").select("grp", "item").distinct()
    members = members.join(items.select(F.xxhash64("key").alias("item"), "key", F.col("tokens").alias("payload")), "item").select("grp", "key", "payload")
    groups = connected_components(links_within(stored(members), lambda x: Sketches(x, threshold), SKETCH_LIMIT))

    chosen = stored(items.join(groups, items.key == groups.id).select("doc_id", "key", F.col("label").alias("grp")))

    def named(batches):
        """Texts with the keys of their sets, so that of rows that repeat an id the right one is found."""
        for p in pieces(batches, "payload"):
            keys = [k for _, k in shingle_sets(p.column("payload"), shingle)]
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(keys, pa.binary()), p.column("payload")], ["doc_id", "key", "payload"])

    texts = picked(docs, doc_id=id_col, payload=text_col).select(F.col("doc_id").cast("long"), F.col("payload").cast("string"))
    some = texts.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    if not chosen.where("doc_id is null").isEmpty():
        some = some.union(texts.where("doc_id is null"))
    some = some.mapInArrow(named, "doc_id long, key binary, payload string")
    sets = some.alias("t").join(chosen.alias("c"), F.expr("t.key = c.key and t.doc_id <=> c.doc_id"))
    sets = stored(sets.select("c.grp", "t.key", F.col("t.payload").cast("binary").alias("payload")).dropDuplicates(["key"]))
    parts = stored(connected_components(links_within(sets, lambda x: Sets(x, threshold, shingle), SET_LIMIT)))

    # Of each component the smallest id: of the rows that share a set the smallest is known.
    whole = stored(items.join(parts, items.key == parts.id).select("key", "label", "doc_id"))
    least = whole.groupBy("label").agg(F.min("doc_id").alias("least"))
    whole = looked_up(whole, least, ["label"]).select("key", F.col("found.least").alias("least"))
    whole = stored(whole.union(items.join(parts, items.key == parts.id, "left_anti").select("key", "doc_id")))
    out = looked_up(base.select("doc_id", "n_shingles", "key"), whole, ["key"])
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("found.least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
