import numpy as np
import pytest

from tidemark.llm import ann
from tidemark.llm.queries import QUERIES, table
from tidemark.llm.scratch import stored

SF = "/root/testdata/sf0.01"


def brute(rows, query, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if query(i):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(out):
    got = {}
    for r in out.select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect():
        own = got.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return got


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / max(1, sum(map(len, want.values())))


def test_query_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got, want = found(QUERIES["op13_nearest"](spark, SF)), brute(rows, lambda i: i % 100 == 0, 10)
    share = recall(got, want)
    print(f"recall at 10: {share:.3f}")
    assert share >= 0.9
    exact = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        assert all(abs(d - np.linalg.norm(np.array(exact[q], float) - np.array(exact[i], float))) < 1e-12 for i, d in near)


@pytest.mark.parametrize("dim", [3, 100])
def test_clusters_copies_and_odd_vectors(spark, dim):
    """Copies by the dozen, other lengths, zeros, nulls and infinities; ties go to the smaller id."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, dim))[rng.integers(0, 6, 400)] * 5 + rng.normal(size=(400, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(60)] + [(-100, x[1].tolist())]
    odd = [(2000, None), (2100, [0.0] * dim), (2200, [float("nan")] * dim), (2300, [float("inf")] + [1.0] * (dim - 1)), (2400, [None] + [1.0] * (dim - 1)), (2500, [1.0]), (2600, []), (None, x[2].tolist()), (3, (x[3] + 1e6).tolist())]
    frame = spark.createDataFrame([(i, v, "l") for i, v in rows + odd], "vec_id long, embedding array<double>, VEC string")
    smaller = {3: min(x[3].tolist(), (x[3] + 1e6).tolist())}
    want = brute([(i, smaller.get(i, v)) for i, v in rows], lambda i: i % 100 == 0, 10)
    got = found(ann.nearest(frame, "id % 100 = 0", k=10))
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == list(range(1000, 1010))


def test_small_buckets_and_blocks(spark, monkeypatch):
    """Crowded buckets in chunks, many blocks, pairs sent on at once: with every code in the radius the result is exact."""
    monkeypatch.setattr(ann, "MOST_ENTRIES", 16)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "MOST_HELD", 50)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(frame, "id % 50 = 0", k=7, recall=1.0))
    want = brute(rows, lambda i: i % 50 == 0, 7)
    assert recall(got, want) >= 0.95
    vectors, members = ann.classes(ann.valid(frame, "vec_id", "embedding"), 8)
    model, _ = ann.fit(vectors)
    placed = ann.coded(vectors, model)
    queries = members.where("id % 50 = 0").selectExpr("rid as qid").join(placed.selectExpr("rid as qid", "code", "vec"), "qid")
    for radius in (9, 20, 64):
        near = ann.within_radius(model, radius, placed, ann.index(placed, model), queries, 1000)
        pairs = sorted((r.qid, r.id) for r in near.select("qid", "id").collect())
        codes = {r.rid: np.uint64(r.code % 2**64) for r in placed.select("rid", "code").collect()}
        assert pairs == sorted((q, i) for q in codes if q % 50 == 0 for i in codes if np.bitwise_count(codes[q] ^ codes[i]) <= radius)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), "true").collect() == []
    assert ann.nearest(spark.createDataFrame([(1, [1.0, 2.0])], schema), "true").collect() == []
    got = found(ann.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 6.0])], schema), "true", k=5))
    assert got == {1: [(2, 0.0), (3, 5.0)], 2: [(1, 0.0), (3, 5.0)], 3: [(1, 5.0), (2, 5.0)]}


def test_pairs_within_the_radius_are_not_shuffled(spark):
    """Rows, a copy of each query for each block and each block's nearest are; with every code in the radius that is under a byte a pair."""
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(4000, 16)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors, members = ann.classes(ann.valid(frame, "vec_id", "embedding"), 6)
    model, _ = ann.fit(vectors)
    placed = stored(ann.coded(vectors, model))
    queries = stored(members.where("id % 5 = 0").selectExpr("rid as qid").join(placed.selectExpr("rid as qid", "code", "vec"), "qid"))

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        each = context.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = written()
    near = ann.within_radius(model, ann.BITS, placed, ann.index(placed, model), queries, 6).collect()
    assert written() - before < 4000 * 800
    got = {}
    for r in near:
        got.setdefault(r.qid, []).append((r.dist, r.id))
    assert {q: [i for _, i in sorted(v)][1:] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(rows, lambda i: i % 5 == 0, 5).items()}


def test_few_copies_and_far_queries_in_floats(spark):
    """Vectors stay floats. A few have copies; a query far from all rows gets its number, exactly."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[0], x[100] = 100, -100
    x[7], x[300] = x[5], x[5]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = ann.valid(frame, "vec_id", "embedding")
    vectors, members = ann.classes(fine, 11)
    assert dict(vectors.dtypes)["vec"] == "array<float>" and vectors.count() == 598
    assert vectors.where("size(ids) > 1").select("rid", "ids").collect() == [(5, [5, 7, 300])]
    assert {r.id: r.rid for r in members.collect()} == {i: 5 if i in (7, 300) else i for i in range(600)}
    got, want = found(ann.nearest(frame, "id % 100 = 0")), brute(rows, lambda i: i % 100 == 0, 10)
    assert recall(got, want) >= 0.95 and got[0] == want[0] and got[100] == want[100] and [i for i, _ in got[300]][:2] == [5, 7]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_shortlist_has_the_nearest(kind):
    """Large, small and mixed numbers, ties and sums that overflow: none of the nearest is lost to rounding, and few others stay where sums are fine."""
    rng = np.random.default_rng(6)
    most, least = (1e30, 1e-30) if kind is np.float32 else (1e300, 1e-300)
    for scale in (1, 1e6, most, least, 10.0 ** rng.integers(-12, 12, (500, 1))):
        rows = (rng.normal(size=(500, 20)) * scale).astype(kind)
        rows[400:] = rows[:100]
        at = ann._near(rows, ann._norms(rows), rows[3], 10)
        with np.errstate(all="ignore"):
            d = np.sqrt(((rows.astype(float) - rows[3].astype(float)) ** 2).sum(axis=1))
        assert set(np.flatnonzero(d <= np.sort(d)[9])) <= set(at)
        assert scale is not 1 or len(at) <= 12


def test_blocks():
    """One for a task, of no fewer rows than are worth one; fewer where queries would be copied too often; as many as keep blocks in their limits."""
    assert ann.n_blocks(51_282, 64, 513, 12) == 12 and ann.n_blocks(500, 64, 5, 200) == 2 and ann.n_blocks(1, 64, 1, 12) == 1
    assert ann.n_blocks(615_384, 64, 6154, 600) == 24 and ann.n_blocks(3_000_000, 64, 30_000, 3000) == 46
    assert ann.n_blocks(100_000, 4096, 1000, 4) == 49
