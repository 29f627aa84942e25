"""Exact top-k by inner product: ball trees per shard, branch and bound, the k-th score shared between shards."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut

QUERY_STEP, K, SCALE = 50, 5, 256
#: Floats hold integers below this exactly; components beyond +-LARGEST / SCALE count as that, scores beyond a long as its ends.
EXACT, LARGEST = 2.0**53, 2**62
#: Vectors of a shard and of a leaf, and queries that one task holds.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 64, 2048


class BallTree:
    """Balls over rows of an integer matrix, halved along the direction between two far points."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.exact = rows.astype(np.float64), rows
        self.leaves: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(np.arange(len(rows)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            points = self.rows[at]
            centre = points.mean(axis=0)
            apart = np.sqrt(((points - centre) ** 2).sum(axis=1))
            node = len(centres)
            centres.append(centre)
            radii.append(apart.max())
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if len(at) <= LEAF_ROWS or radii[-1] == 0:
                self.leaves.append(at)
                self.children.append(None)
                continue
            far = points[apart.argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (other - far), kind="stable")
            self.leaves.append(None)
            self.children.append((-1, -1))
            half = len(at) // 2
            todo += [(at[order[:half]], node, 0), (at[order[half:]], node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        """Bounds of every query's inner products within every ball, never below the exact ones.

        Rounding, of sums of products and of integers beyond 2**53, errs by some 2**-53 of |q| (|c| + r) an operation,
        however small the bound itself is where products cancel.
        """
        lengths = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centres.T + lengths[:, None] * self.radii
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return bounds + (queries.shape[1] + 8) * 2.0**-52 * lengths[:, None] * reach

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products as integers: in floats where these hold every sum exactly, else in whole numbers of any size, ended at those of a long."""
        if not len(query):
            return np.zeros(len(at), np.int64)
        if np.abs(self.rows[at]).sum(axis=1).max() * np.abs(query).max() < EXACT:
            return (self.rows[at] @ query.astype(np.float64)).astype(np.int64)
        return np.clip(self.exact[at].astype(object) @ query.astype(object), -(2**63), 2**63 - 1)

    def best(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """(score, -id) of the k best rows with a score of at least ``least``, in a heap; of the query's own row one copy is no candidate."""
        heap: list[tuple[int, int]] = []
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if -bound < max(least, heap[0][0] if len(heap) == k else -math.inf):
                break
            at = self.leaves[node]
            if at is None:
                for child in self.children[node]:
                    heapq.heappush(nodes, (-bounds[child], child))
                continue
            scores = self.scores(at, query)
            low = max(least, heap[0][0] if len(heap) == k else -math.inf)
            for j in np.flatnonzero(scores >= low):
                item = (int(scores[j]), -int(ids[at[j]]))
                same = bool(ids[at[j]] == own) and np.array_equal(self.exact[at[j]], query)
                for _ in range(min(k, int(copies[at[j]]) - same)):
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        return heap


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, ints, copies: floor(256 x) of each component, equal rows counted; rows that take no part are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    taking_part = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return taking_part.select("vec_id", ints.alias("ints")).groupBy("vec_id", "ints").agg(F.count("*").alias("copies"))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, by two steps of bounded arrays."""
    block = 1 << 16
    starts = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(block).cast("long"))))
    ends = F.least(F.col("_from") + block, F.col(times)) - 1
    return starts.withColumn("_from", F.explode(F.sequence(F.col("_from"), ends))).drop("_from", times)


def search(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score of the k best inner products of every query, all rows but its own.

    Queries are the rows whose vec_id is divisible by ``query_step``. Ties go to the smaller vec_id. Rows with
    a null vec_id, a null vector or a null or non-finite component take no part; vectors of another length
    than the query's are no candidates; vectors without components score 0 with each other. A row that stands n times is n candidates, n - 1 for itself, and asks n
    times; rows under one vec_id with unlike vectors are candidates of each other and ask each for itself. Scores are
    exact; those beyond a long count as its end. A query with fewer than k candidates returns them all; an empty table
    gives an empty result; further columns are not read.
    """
    ints = cut(integer_vectors(vectors))
    n = ints.count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n / query_step / BLOCK_ROWS))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id", "ints"), F.lit(parts)).cast("int")
    rows = ints.withColumn("dim", F.size("ints")).withColumn("shard", spread(shards))
    asked = rows.where(F.col("vec_id") % query_step == 0).withColumn("block", spread(blocks)).drop("shard")
    asked = asked.withColumn("vector_key", F.md5(F.col("ints").cast("string")))
    keys = ["dim", "shard", "block"]
    every_block, every_shard = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))

    def task(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(queries):
            ids, copies, tree = held["vec_id"].to_numpy(), held["copies"].to_numpy(), BallTree(np.array(held["ints"].tolist(), np.int64))
            wanted = np.array(queries["ints"].tolist(), np.int64)
            bounds = tree.upper_bounds(wanted.astype(np.float64))
            for j, (query_id, key, times, least) in enumerate(zip(queries["vec_id"], queries["vector_key"], queries["copies"], queries["least"])):
                least = -math.inf if pd.isna(least) else int(least)
                found += [(query_id, key, times, -i, s) for s, i in tree.best(wanted[j], bounds[j], ids, copies, query_id, k, least)]
        return pd.DataFrame(found, columns=["query_id", "vector_key", "times", "vec_id", "score"])

    def scored(held: DataFrame, queries: DataFrame) -> DataFrame:
        queries = queries.toDF(*queries.columns)  # names of its own beside the rows it was made from
        return held.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(task, "query_id long, vector_key string, times long, vec_id long, score long")

    home = (F.col("block") % shards).cast("int")
    first = scored(
        rows.withColumn("block", every_block).where(F.col("shard") == home), asked.withColumn("shard", home).withColumn("least", F.lit(None).cast("long"))
    )
    kth = first.groupBy(F.col("query_id").alias("vec_id"), "vector_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = asked.join(kth, ["vec_id", "vector_key"], "left")
    found = scored(rows.withColumn("block", every_block), known.withColumn("shard", every_shard))
    ranked = Window.partitionBy("query_id", "vector_key").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return repeated(best, "times").select("query_id", "rank", "vec_id", "score")
