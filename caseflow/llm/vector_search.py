"""Exact top-k inner products by KD-trees per shard.

Rows are dealt to shards by a hash of their id.  A shard's tree splits at medians of its widest
component and keeps the tight box of every node; the largest inner product that a query can have with
a box bounds a node from above.  Nodes are visited best bound first, until the bound falls
below the k-th best score so far.  That score starts from the k-th best over a bounded sample of
the rows, which every shard gets with the query, so most shards open few leaves.

Components become floor(scale * x); scores are integers and exact, whatever their size: where doubles could not add them up,
Python's integers do.  The column holds the nearest 64-bit integer; ranks follow the exact scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.common import drop_path, materialize

LEAF, SAMPLE = 128, 2048
LEAST_SHARD, MOST_SHARD, MOST_QUERIES = 8_192, 65_536, 16_384


def usable(vector: str | Column) -> Column:
    """True for vectors that have components, all of them finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


class Tree:
    """Nodes in arrays: box, smallest id, rows (a stretch of ``order``) and the two children."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(ids))
        lows, highs, least, spans, kids = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = vectors[order[a:b]]
            low, high = part.min(0), part.max(0)
            node = len(spans)
            lows.append(low), highs.append(high), least.append(ids[order[a:b]].min()), spans.append((a, b)), kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = node
            wide = int(np.argmax(high - low))
            if b - a > LEAF and high[wide] > low[wide]:
                middle = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], middle - a)]
                todo += [(middle, b, node, 1), (a, middle, node, 0)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.lows, self.highs, self.least, self.spans, self.kids = np.array(lows), np.array(highs), [int(x) for x in least], spans, kids

    def search(self, queries: np.ndarray, own: np.ndarray, floors: list, k: int) -> Iterator[tuple[int, list[tuple]]]:
        """For each query its place and up to k ``(score, -id)`` that may be among the best of all shards."""
        for base in range(0, len(queries), 512):
            part = queries[base : base + 512]
            bounds = (np.maximum(part, 0) @ self.highs.T + np.minimum(part, 0) @ self.lows.T).tolist()
            for q in range(len(part)):
                yield base + q, self._best(part[q], int(own[base + q]), bounds[q], floors[base + q], k)

    def _best(self, query: np.ndarray, own: int, bound: list, floor, k: int) -> list[tuple]:
        best: list[tuple] = []
        heap = [(-bound[0], self.least[0], 0)]
        while heap:
            negative, least, node = heapq.heappop(heap)
            if floor is not None and -negative < floor:
                break
            if len(best) == k and (-negative, -least) < best[0]:
                break  # a lower bound, or the same with larger ids only: so is all that is left
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], self.least[left], left))
                heapq.heappush(heap, (-bound[right], self.least[right], right))
                continue
            a, b = self.spans[node]
            scores = self.vectors[a:b] @ query
            worst = best[0][0] if len(best) == k else floor
            near = np.flatnonzero(scores >= worst) if worst is not None else np.arange(len(scores))
            if len(near) > 4 * k:  # the k best of a leaf are enough, with smaller ids first among equals; one place is for the query's own row
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[: 4 * k]] if not (self.ids[a:b] == own).sum() > 3 * k else near
            for i in near.tolist():
                found = (int(scores[i]), -int(self.ids[a + i]))
                if found[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision; as Python integers where doubles could not add up exactly."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    with np.errstate(over="ignore"):
        x = np.floor(flat * float(scale)).reshape(len(column), -1)
        exact = not x.size or np.abs(x).max() ** 2 * x.shape[1] < 2.0**53
    if exact:
        return x
    large = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale)  # noqa: E731  large doubles are integers
    return np.array([large(v) for v in flat.tolist()], object).reshape(len(column), -1)


def beyond(score: int) -> str:
    """Orders scores that 64 bits cannot hold, as text; empty for those that they can."""
    if -(2**63) < score < 2**63 - 1:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest inner product for each query.

    ``is_query`` chooses queries among the rows by the column ``id``.  Ties go to the smaller id; a query
    with fewer than k other rows gets all of them.  Rows without id, and vectors that are null, empty or
    hold null or non-finite components take no part; vectors of different lengths are never
    compared.  Of rows that repeat an id each is a candidate, none for itself, and the smallest
    vector is the query.  An empty table gives an empty one; other columns are left out.  Shards and blocks of queries meet in tasks of bounded size.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    rows, rows_path = materialize(rows.withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    shards = max(1, -(-n // min(MOST_SHARD, max(LEAST_SHARD, n // (2 * spark.sparkContext.defaultParallelism) + 1))))
    queries = rows.where(is_query).groupBy(F.col("id").alias("qid"), F.col("dim").alias("qdim")).agg(F.min("v").alias("qv"))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    queries = queries.withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))

    schema = "query_id long, vec_id long, score long, beyond string"

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if data.num_rows and asked.num_rows:
            tree = Tree(integers(data["v"].combine_chunks(), scale), np.asarray(data["id"]))
            own = np.asarray(asked["qid"])
            floors = asked["floor"].to_pylist() if "floor" in asked.column_names else [None] * len(own)
            asked_vectors = integers(asked["qv"].combine_chunks(), scale)
            with np.errstate(over="ignore"):
                exact = object not in (tree.vectors.dtype, asked_vectors.dtype) and np.abs(tree.vectors).max() * np.abs(asked_vectors).max() * tree.vectors.shape[1] < 2.0**53
            if not exact:
                whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
                asked_vectors, tree = whole(asked_vectors), Tree(whole(tree.vectors), tree.ids)
            for q, best in tree.search(asked_vectors, own, floors, k):
                for score, negative in best:
                    found[0].append(int(own[q])), found[1].append(-negative), found[2].append(max(-(2**63), min(2**63 - 1, score))), found[3].append(beyond(score))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64()), "beyond": pa.array(found[3], pa.string())})

    # The sample is bounded by SAMPLE whatever the number of rows; every block of queries gets it.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seen = sample.groupBy("block", "dim").cogroup(queries.groupBy("qblock", "qdim")).applyInArrow(search, schema)
    floors = seen.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.min("score") > -(2**63)), F.min("score")).alias("floor"))
    asked, asked_path = materialize(queries.join(floors, F.col("query_id") == F.col("qid"), "left").select("qid", "qdim", "qv", "qblock", "floor"), "queries")

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    everywhere = asked.withColumn("qshard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = placed.groupBy("shard", "block", "dim").cogroup(everywhere.groupBy("qshard", "qblock", "qdim")).applyInArrow(search, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    best, _ = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    for path in (rows_path, asked_path):
        drop_path(spark, path)
    return best


def op6_exact_top_k(spark, sf_dir):
    """The ten nearest rows of every hundredth vector."""
    from caseflow.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
