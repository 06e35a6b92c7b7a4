"""An inverted-file index of vectors: cells around centroids as folders of a Parquet table, and search in the nearest cells.

Centroids are fitted on a bounded sample; every row lies in the cell of largest cosine. How many cells a
query asks follows from exact neighbours, among all rows, of a set number of rows. Asking all cells is
the exact search over the same table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieval import best_pairs, vector_search
from .risk import ranked

#: Rows or queries of a block: what a task compares at a time.
BLOCK = 4096


@dataclass
class Cells:
    """Unit centroids, one row each, and how many of them a query asks. Both are of set size, whatever the table."""

    centroids: np.ndarray
    probes: int

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), self.probes) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cells:
        rows = spark.read.parquet(path).orderBy("cell").collect()
        return Cells(np.array([r.centroid for r in rows]), rows[0].probes)


def _rows(table: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """(id, v): rows with an id and a finite vector other than zero, of this length if one is given."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return rows.where(fine if length is None else f"{fine} and size(v) = {length}")


def _nearest_cells(cells: Cells, most: int):
    """(id, v, cell, rank): the `most` cells of largest cosine to each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            order = np.argsort(-(v @ cells.centroids.T), axis=1, kind="stable")[:, :most]
            which = pa.array(np.repeat(np.arange(len(batch)), order.shape[1]))
            rank = pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(which), batch.column("v").take(which), pa.array(order.ravel().astype(np.int32)), rank], names=["id", "v", "cell", "rank"])

    return run


def assigned(cells: Cells, table: DataFrame, *, id_col: str, vector_col: str, most: int = 1) -> DataFrame:
    """(id, v, cell, rank) of rows old or new: their `most` nearest cells. Rows that can't have a cosine with the centroids are left out."""
    rows = _rows(table, id_col, vector_col, cells.centroids.shape[1])
    return rows.mapInArrow(_nearest_cells(cells, most), "id long, v array<double>, cell int, rank int")


def fit_cells(table: DataFrame, *, id_col: str, vector_col: str, cells: int | None = None, sample: int = 20_000, tests: int = 64, k: int = 10, recall: float = 0.95, seed: int = 1) -> Cells:
    """Centroids of at most `sample` rows, those of the smallest hashes, and the number of cells to ask.

    cells: the square root of the rows, 1,024 at most, unless given. Vectors of the commonest length count.
    The number of cells to ask is the smallest that holds `recall` of the k nearest of `tests` rows.
    """
    rows = stored(_rows(table, id_col, vector_col))
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if length is None:
        raise ValueError("no vectors to fit cells on")
    rows, want = rows.where(F.size("v") == length.n), cells or max(1, min(1024, math.isqrt(length.m)))
    some = stored(rows.orderBy(F.xxhash64("v"), "id").limit(sample))
    unit = some.select(F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))").alias("v"))
    found = KMeans(k=want, maxIter=15, seed=seed, featuresCol="f").fit(unit.select(array_to_vector("v").alias("f"))).clusterCenters()
    centroids = np.array([c / n for c in found if (n := np.linalg.norm(c)) > 0])
    model = Cells(centroids if len(centroids) else np.eye(1, length.n), 1)
    asked = stored(some.limit(tests))
    near = vector_search(rows, asked, id_col="id", vector_col="v", most=k).select("query_id", "id")
    own = assigned(model, rows, id_col="id", vector_col="v").select("id", F.col("cell"))
    asks = assigned(model, asked, id_col="id", vector_col="v", most=len(model.centroids)).select(F.col("id").alias("query_id"), "cell", "rank")
    ranks = sorted(r["rank"] for r in near.join(own, "id").join(asks, ["query_id", "cell"]).select("rank").collect())  # tests * k numbers
    model.probes = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))] + 1 if ranks else 1
    return model


def write_cells(cells: Cells, table: DataFrame, path: str, *, id_col: str, vector_col: str) -> None:
    """Adds rows to the table under path, in folders by cell. A cell with more rows than a block is dealt to as many tasks."""
    rows = stored(assigned(cells, table, id_col=id_col, vector_col=vector_col).select("id", "v", "cell"))
    sizes = rows.groupBy("cell").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(n, "cell", "part").select("id", "v", "cell").write.mode("append").partitionBy("cell").parquet(path)


def search_cells(cells: Cells, path: str, queries: DataFrame, *, id_col: str, vector_col: str, most: int = 10, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, place): as vector_search, among the rows of the cells that each query asks: cells.probes of them, or `probes`; all cells are exact.

    A cell's rows and the queries that ask it meet in blocks, so neither a crowded cell nor a cell that
    all queries ask is one task's. Ids of queries are unique.
    """
    spark = queries.sparkSession
    every = len(cells.centroids)
    asks = stored(assigned(cells, queries, id_col=id_col, vector_col=vector_col, most=min(every, probes or cells.probes)).select("id", "v", "cell"))
    rows = spark.read.schema("id long, v array<double>, cell int").parquet(path)
    wanted = [r.cell for r in asks.select("cell").distinct().collect()]  # as many as there are centroids at most
    rows = rows.where(F.col("cell").isin(wanted)).select("id", "v", "cell")
    count = lambda df, name: df.groupBy("cell").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias(name))
    blocks = F.broadcast(stored(count(rows, "row_blocks").join(count(asks, "query_blocks"), "cell")))  # a row for each cell
    left = rows.join(blocks, "cell").select("id", "v", "cell", F.expr("cast(pmod(xxhash64(id), row_blocks) as int)").alias("rb"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("qb"))
    right = asks.join(blocks, "cell").select("id", "v", "cell", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("rb"), F.expr("cast(pmod(xxhash64(id), query_blocks) as int)").alias("qb"))
    by = ["cell", "rb", "qb"]

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        return best_pairs(most)(ours.select(["id", "v"]), theirs.select(["id", "v"]))

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query_id long, id long, score double")
    return ranked(found, ["query_id"], most, F.desc("score"), F.col("id"))
