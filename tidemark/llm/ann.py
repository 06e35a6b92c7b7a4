"""Nearest vectors by multi-index hashing.

1. A rotation is learned on a bounded sample: principal directions, then the turn that brings them
   closest to the corners of a cube. The signs along them are a vector's code of 64 bits.
2. Codes are cut in parts, and each part is an index of its own: (part, value) -> codes. Two codes within
   a radius agree in some part up to its share of the radius (pigeonhole), so probing every value within
   that share in every part meets all codes within the radius.
3. Rows are dealt to blocks, each with its own index, and every query visits every block. Codes met there are
   compared whole, and those within the radius are ranked by their floats in the same task: what leaves a
   block are a query's nearest of it, never the pairs met.

The radius comes from exact neighbours, over all rows, of a set number of rows: it is the smallest that
holds the wanted share of them. Queries that find too few rows go again with all bits, so every query gets
its number, and what is shuffled are all rows twice at most. Equal vectors are one row of the index, with their
smallest ids; no other row is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, stored
from .spread import looked_up

BITS = 64
#: Bits of a code's parts: 256 values each, so queries that visit a block together share what they look up.
WIDTHS = [8] * (BITS // 8)
#: Rows of a block at most, and fewest where more tasks have use for it; numbers of its vectors at most.
BLOCK_ROWS, LEAST_ROWS, MOST_NUMBERS = 1 << 16, 256, 1 << 23
#: Copies of queries, one for each block, if they are over a quarter of the rows; pairs of queries and rows marked at a time; answers held before they are sent on.
MOST_COPIES, MOST_ENTRIES, MOST_HELD = 1 << 17, 1 << 25, 1 << 13


@dataclass
class Model:
    """A code's planes and its parts. radius: of the search; sampled: rows it was fitted on."""

    mean: np.ndarray
    planes: np.ndarray
    widths: list[int]
    radius: int = 0
    sampled: int = 0
    shifts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.shifts = np.cumsum([0, *self.widths[:-1]]).tolist()

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]

    def part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return codes >> np.uint64(self.shifts[j]) & np.uint64((1 << self.widths[j]) - 1)

    def shares(self, radius: int) -> list[int]:
        """The radius of each part, -1 for none: codes within `radius` keep to at least one of them."""
        q, more = divmod(radius, len(self.widths))
        return [q if j <= more else q - 1 for j in range(len(self.widths))]


def rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """`bits` directions for centred rows x: principal ones, turned until their signs lose the least; more turns than one where rows are short."""
    dim, rng = x.shape[1], np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, : min(dim, bits)]
    low, planes = x @ axes, []
    while sum(p.shape[1] for p in planes) < bits:
        turn = np.linalg.qr(rng.normal(size=(low.shape[1], low.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ v).T
        planes.append(axes @ turn)
    return np.concatenate(planes, axis=1)[:, :bits]


def _matrix(column: pa.Array, kind: type | None = np.float64) -> np.ndarray:
    """Lists of one length as rows of a matrix of `kind`, or of their own."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind or column.type.value_type.to_pandas_dtype(), copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def _norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _near(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest rows, and of all others that could be, as figures in products of the rows' own precision are rounded."""
    if len(rows) <= k:
        return np.arange(len(rows))
    kind = np.finfo(rows.dtype)
    with np.errstate(all="ignore"):
        apart = norms * norms - 2 * (rows @ query)
        room = 4 * (rows.shape[1] + 4) * kind.eps * (norms + np.sqrt(query @ query)) ** 2 + rows.shape[1] * kind.tiny
        return np.flatnonzero(~(apart - room > np.partition(apart + room, k - 1)[k - 1]))  # what overflows stays


def valid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): rows that take part, vec in floats or else doubles. Of rows with one id, that with the smallest vector."""
    rows = picked(table, id=id_col, vec=vector_col)
    kind = "array<float>" if dict(rows.dtypes)["vec"] == "array<float>" else "array<double>"
    rows = rows.select(F.col("id").cast("long"), F.col("vec").cast(kind))
    fine = "id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    rows = stored(rows.where(fine))
    again = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return rows
    return stored(rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))))


def classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rid, vec, ids): each different vector once, with its k smallest ids, rid the first; and (id, rid) of every row.

    Equal vectors are known by 128 bits. Groups of copies are cut to their k smallest ids in parts first:
    as ties go to the smaller id, no other copy can be among a query's nearest.
    """
    key = rows.select("id", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("b"))
    again = stored(key.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"))
    if again.isEmpty():
        return rows.select(F.col("id").alias("rid"), "vec", F.array("id").alias("ids")), rows.select("id", F.col("id").alias("rid"))
    copies = stored(looked_up(key, again, ["a", "b"], again).where("found is not null").drop("found"))
    firsts = copies.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["a", "b", "deal"], ["a", "b"]):
        firsts = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("rank") <= k)
    same = stored(firsts.groupBy("a", "b").agg(F.min("id").alias("rid"), F.array_sort(F.collect_list("id")).alias("ids")))
    moved = stored(looked_up(copies, same, ["a", "b"], again).select("id", "found.rid", F.when(F.col("id") == F.col("found.rid"), F.col("found.ids")).alias("ids")))
    out = rows.join(moved, "id", "left").where("rid is null or rid = id").select(F.col("id").alias("rid"), "vec", F.coalesce("ids", F.array("id")).alias("ids"))
    members = rows.select("id").join(moved.select("id", "rid"), "id", "left").select("id", F.coalesce("rid", "id").alias("rid"))
    return stored(out), members


def fit(rows: DataFrame, most_values: int = 4_000_000, sample: int = 20_000) -> tuple[Model, np.ndarray]:
    """A model of `rows` (vec) of one length, from at most `sample` rows and `most_values` numbers, those of the smallest hashes; and that sample."""
    count, dim = rows.count(), F.size("vec")
    length = rows.select(dim.alias("n")).first()[0]
    most = max(1, min(sample, most_values // length))
    hashed = rows.select("vec", F.xxhash64(F.col("vec").cast("array<double>")).alias("h"))
    # Hashes are even, so those under the cut are some more than are wanted, and no more rows are gathered to be put in order.
    cut = int(2**64 * min(1.0, (1.25 * most + 100) / count)) - 2**63
    x = np.empty((0, 1))
    for some in (hashed.where(F.col("h") < cut), hashed) if cut < 2**63 else (hashed,):
        if len(x) < most:
            x = _matrix(some.orderBy("h", "vec").limit(most).select("vec").toArrow().column(0).combine_chunks())
    mean = x.mean(axis=0)
    return Model(mean, rotation(x - mean), WIDTHS, sampled=len(x)), x


def calibrated(model: Model, sample: np.ndarray, rows: DataFrame, k: int, recall: float, tests: int = 64) -> Model:
    """The model with the smallest radius that holds `recall` of the k nearest, among all rows, of the sample's first `tests` rows."""
    spark = rows.sparkSession
    queries = sample[:tests]
    known = spark.sparkContext.broadcast((model, queries, model.codes(queries)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, queries, codes = known.value
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in queries]
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if not len(x):
                continue
            own, norms = model.codes(x), _norms(x)
            for i, q in enumerate(queries):
                near = _near(x, norms, q, k + 1)
                dist = np.concatenate([best[i][0], _distances(x[near], q)])
                bits = np.concatenate([best[i][1], np.bitwise_count(own[near] ^ codes[i]).astype(np.int64)])
                order = np.argsort(dist, kind="stable")[: k + 1]
                best[i] = dist[order], bits[order]
        yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(best)), [len(b[0]) for b in best])), "dist": pa.array(np.concatenate([b[0] for b in best])), "bits": pa.array(np.concatenate([b[1] for b in best]))})

    found = rows.select("vec").mapInArrow(nearest, "q long, dist double, bits long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "bits"))).where(F.col("rank").between(2, k + 1))
    bits = np.sort([r.bits for r in found.select("bits").collect()])  # tests * k numbers
    model.radius = int(bits[min(len(bits) - 1, int(np.ceil(recall * len(bits))))]) if len(bits) else 0
    return model


def with_codes(rows: DataFrame, model: Model) -> DataFrame:
    """rows (vec) with their codes, the last column."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = known.value.codes(_matrix(batch.column("vec"))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=[*batch.schema.names, "code"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in [*rows.dtypes, ("code", "long")]))


def n_blocks(rows: int, numbers: int, queries: int, tasks: int) -> int:
    """Blocks of rows of so many numbers: one for a task where rows suffice, fewer where queries would be copied too often, and as many as keep a block in its limits."""
    fewest = -(-rows // max(1, min(BLOCK_ROWS, MOST_NUMBERS // numbers)))
    return max(1, fewest, min(tasks, -(-rows // LEAST_ROWS), max(rows // 4, MOST_COPIES) // max(queries, 1)))


def coded(rows: DataFrame, model: Model, queries: int = 1) -> DataFrame:
    """(block, rid, vec, ids, code): rows with the block that each is dealt to, and their codes. queries: about how many will visit the blocks."""
    blocks = n_blocks(rows.count(), len(model.mean), queries, n_tasks(rows.sparkSession))
    return with_codes(rows.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"), "rid", "vec", "ids"), model)


def index(table: DataFrame, model: Model) -> DataFrame:
    """(block, part, starts, places): each block's own index of each part. A block's rows, by rid, have places; those of value v are places[starts[v] : starts[v + 1]]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def indexed() -> pa.RecordBatch:
            codes, starts, places = np.concatenate(held).astype(np.uint64), [], []
            for j, width in enumerate(model.widths):
                values = model.part(codes, j).astype(np.int64)
                starts.append(np.append(0, np.cumsum(np.bincount(values, minlength=1 << width))))
                places.append(np.argsort(values, kind="stable"))
            parts = len(model.widths)
            return pa.RecordBatch.from_pydict({"block": pa.array(np.full(parts, block)), "part": pa.array(np.arange(parts, dtype=np.int32)), "starts": pa.array(starts, pa.list_(pa.int32())), "places": pa.array(places, pa.list_(pa.int32()))})

        for batch in batches:
            blocks, codes = batch.column("block").to_numpy(), batch.column("code").to_numpy()
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(blocks)] if len(blocks) else []):
                if held and blocks[lo] != block:
                    yield indexed()
                    held = []
                block = blocks[lo]
                held.append(codes[lo:hi])
        if held:
            yield indexed()

    dealt = table.select("block", "rid", "code").repartition(n_tasks(table.sparkSession), "block").sortWithinPartitions("block", "rid")
    return dealt.mapInArrow(run, "block long, part int, starts array<int>, places array<int>")


def _masks(model: Model, radius: int) -> list[np.ndarray]:
    """By part: what turns a code's value into each value to look up. A part whose share is all its bits meets every row, so the others need no look."""
    shares = model.shares(radius)
    every = [j for j, w in enumerate(model.widths) if shares[j] >= w][:1]
    shares = [share if j in every or not every else -1 for j, share in enumerate(shares)]
    return [np.array([sum(1 << b for b in bits) for n in range(share + 1) for bits in itertools.combinations(range(w), n)], np.int64) for w, share in zip(model.widths, shares, strict=True)]


def _marked(model: Model, radius: int, masks: list[np.ndarray], parts: list[tuple[np.ndarray, ...]], asked: np.ndarray) -> np.ndarray:
    """For each code asked, which rows of a block have codes within the radius. parts: starts, places, and the codes in that order, by part."""
    rows = len(parts[0][1])
    marked = np.zeros((len(asked), rows), bool)
    flat = marked.reshape(-1)
    for j, (starts, places, codes) in enumerate(parts):
        if not len(masks[j]):
            continue
        own = model.part(asked, j).astype(np.int64)
        by = np.argsort(own, kind="stable")
        for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(own[by], prepend=-1)).tolist(), len(by)]):
            value = own[by[lo]] ^ masks[j]
            first, size = starts[value], starts[value + 1] - starts[value]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
            if not len(at):
                continue
            met, place = codes[at], places[at]
            for i in range(lo, hi, step := max(1, (1 << 20) // len(at))):
                who = by[i : min(i + step, hi)]
                q, e = np.divmod(np.flatnonzero(np.bitwise_count(asked[who][:, None] ^ met) <= radius), len(at))
                flat[who[q] * rows + place[e]] = True
    return marked


def _visited(model: Model, radius: int, k: int):
    """A block's rows, then its index, then queries: each query's k nearest of the block within the radius."""
    masks = _masks(model, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, lists, parts, ready = None, [], [], [], None
        out: list[tuple[int, list[float], list[int]]] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)], names=["qid", "dist", "ids"])

        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
            for lo, hi in itertools.pairwise([*edges, len(blocks)] if edges else []):
                key, code, vec, ids, starts, places = (batch.column(c).slice(lo, hi - lo) for c in ("key", "code", "vec", "ids", "starts", "places"))
                if blocks[lo] != block:
                    block, rows, lists, parts, ready = blocks[lo], [], [], [], None
                if kinds[lo] == 0:
                    rows.append((code.to_numpy().astype(np.uint64), _matrix(vec, None)))
                    lists.append(ids)
                elif kinds[lo] == 1:
                    parts += [(s.values.to_numpy(), p.values.to_numpy()) for s, p in zip(starts, places, strict=True)]
                elif rows or ready:
                    if ready is None:
                        codes, x = (np.concatenate(c) for c in zip(*rows, strict=True))
                        copies = pa.concat_arrays(lists)
                        ready = [(s, p, codes[p]) for s, p in parts], x, _norms(x), copies.offsets.to_numpy(), copies.values.to_numpy()
                        rows, lists, parts = [], [], []
                    own, x, norms, ends, same = ready
                    asked, queries, qids = code.to_numpy().astype(np.uint64), _matrix(vec, None), key.to_pylist()
                    for i in range(0, len(asked), step := max(1, MOST_ENTRIES // len(x))):
                        marked = _marked(model, radius, masks, own, asked[i : i + step])
                        for q, here in zip(range(i, i + len(marked)), marked, strict=True):
                            at = np.flatnonzero(here)
                            if not len(at):
                                continue
                            at = at[_near(x[at], norms[at], queries[q], k)]
                            d = _distances(x[at].astype(np.float64), queries[q].astype(np.float64))
                            if len(d) > k:
                                first = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                                at, d = at[first], d[first]
                            found = sorted((y, r) for y, a in zip(d.tolist(), at.tolist(), strict=True) for r in same[ends[a] : ends[a + 1]].tolist())[:k]
                            out.append((qids[q], [y for y, _ in found], [r for _, r in found]))
                            if len(out) >= MOST_HELD:
                                yield sent()
                                out.clear()
        if out:
            yield sent()

    return run


def within_radius(model: Model, radius: int, table: DataFrame, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, dist, id): for each of `queries` (qid, code, vec), its k nearest ids among all rows of `table` whose code is within the radius. entries: the table's index."""
    blocks = entries.agg(F.max("block")).first()[0] + 1
    names = {"code": "long", "vec": dict(table.dtypes)["vec"], "ids": "array<long>", "starts": "array<int>", "places": "array<int>"}

    def laid(rows: DataFrame, kind: int, key: str) -> DataFrame:
        return rows.select("block", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), *[c if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()])

    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "qid", "code", "vec")
    together = laid(table, 0, "rid").unionByName(laid(entries, 1, "part")).unionByName(laid(asked, 2, "qid"))
    # Few blocks of one size: over more tasks than blocks, fewer of them meet in one.
    together = together.repartition(max(n_tasks(table.sparkSession), 4 * blocks), "block").sortWithinPartitions("block", "kind", "key")
    near = together.mapInArrow(_visited(model, radius, k), "qid long, dist array<double>, ids array<long>")
    near = near.select("qid", F.inline(F.arrays_zip(F.col("dist"), F.col("ids").alias("id"))).alias("dist", "id"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))).where(F.col("rank") <= k)
    return near.select("qid", "dist", "id")


def nearest(table: DataFrame, is_query: str, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets is_query (SQL on `id`), its k nearest others by Euclidean distance.

    Nearest first, ties to the smaller id. The index holds every row; it is fitted on `sample` rows at most. Nulls, zero vectors and
    vectors with null or non-finite numbers take no part, nor do vectors of another length than most have
    (of equally many, the shorter). Of rows that repeat an id, the one of the smallest vector takes part.
    Rows without an id take no part. With fewer than k others all are found. No rows give no rows.
    """
    spark, schema = table.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = valid(table, id_col, vector_col)
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == length.n)
    vectors, members = classes(rows, k + 1)
    model, x = fit(vectors, sample=sample)
    model = calibrated(model, x, vectors, k, recall)
    queries = stored(members.where(is_query))
    placed = coded(vectors, model, queries.count())
    entries = stored(index(placed, model))
    asked = rows.where(is_query).join(queries, "id").select(F.col("rid").alias("qid"), "vec").dropDuplicates(["qid"])
    left = stored(with_codes(asked, model))
    want, found = min(k + 1, length.m), []
    for radius in sorted({model.radius, BITS}):
        if left.isEmpty():
            break
        near = stored(within_radius(model, radius, placed, entries, left, k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("near")))
        near = near.where(F.size("near") >= want) if radius < BITS else near
        found.append(near)
        if radius < BITS:
            left = stored(left.join(near, "qid", "left_anti"))
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = looked_up(queries.select("id", F.col("rid").alias("qid")), every, ["qid"]).select("id", F.expr(f"slice(filter(found.near, x -> x.id <> id), 1, {k})").alias("near"))
    out = out.select("id", F.posexplode("near"))
    return out.select(F.col("id").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.dist").alias("score"))
