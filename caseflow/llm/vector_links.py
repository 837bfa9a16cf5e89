"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors are one class.  The signs of ``bits`` random projections name a class's bucket in each table.  First only a
sketch goes there, the signs of SKETCH projections: two classes whose sketches differ in more places than vectors at the
threshold ever do (FAR standard deviations beyond the mean) are told apart, and so are pairs that met in an earlier table
of the sketch.  Only classes that then still have a partner in a bucket send their vector there, where the
cosine in double precision decides; a pair that shares several buckets counts only in the first table that it shares.  A
bucket yields sums of links per class and a root per local component, never its pairs; a large bucket is split into
blocks whose pairs are tiles of bounded size.  Components are joined by distributed rounds.

The number of bits grows with the number of classes, so that buckets keep their size, and the
number of tables follows from the wanted recall of a pair right at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import connected_components, drop_path, materialize
from caseflow.llm.vector_search import usable

#: Classes that a bucket is meant to hold, and what a tile holds at most of each of its two blocks; rows compared at once.
BUCKET, BLOCK, STEP = 2048, 8192, 256
RECALL, SEED = 0.9995, 20_240_229
SKETCH, FAR = 128, 5


def plan(classes: int, threshold: float) -> tuple[int, int, int]:
    """Bits and tables for a number of classes, and in how many places of their sketches linked ones differ at most."""
    bits = max(1, math.ceil(math.log2(max(1, classes) / BUCKET)))
    differ = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** bits))
    return bits, tables, math.ceil(SKETCH * differ + FAR * math.sqrt(SKETCH * differ * (1 - differ)))


def signs_of(vectors: np.ndarray, planes: int) -> np.ndarray:
    return vectors @ np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((planes, vectors.shape[1])).T > 0


def codes_of(signs: np.ndarray, bits: int) -> np.ndarray:
    """The code of each table whose signs are given."""
    tables = signs.shape[1] // bits
    return signs[:, : tables * bits].reshape(len(signs), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by powers of two, so that squares neither overflow nor vanish and nothing is rounded."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0, keepdims=True))[1])


def first_here(codes: np.ndarray, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs that share a bucket of this table: those that share none before."""
    out = np.ones(len(a), bool)
    for t in range(min(table, codes.shape[1])):
        out &= codes[a, t] != codes[b, t]
    return out


def partnered(table: int, sketches: np.ndarray, side: np.ndarray, crossed: bool, bits: int, most: int) -> np.ndarray:
    """Which rows have a partner that their sketches do not tell apart and that they have not met before."""
    signs = np.unpackbits(sketches.view(np.uint8), axis=1)
    codes = codes_of(signs, bits)
    out = np.zeros(len(sketches), bool)
    words = [np.ascontiguousarray(sketches[:, k]) for k in range(sketches.shape[1])]
    for i in range(0, len(sketches), STEP):
        apart = np.zeros((min(STEP, len(sketches) - i), len(sketches) - i), np.uint8)
        for w in words:
            apart += np.bitwise_count(w[i : i + STEP, None] ^ w[None, i:])
        a, b = np.nonzero(apart <= most)
        a, b = a + i, b + i
        kept = (a < b) & (side[a] != side[b]) if crossed else a < b
        a, b = a[kept], b[kept]
        kept = first_here(codes, table, a, b)
        out[a[kept]] = out[b[kept]] = True
    return out


def tile_links(table: int, rep: np.ndarray, mult: np.ndarray, side: np.ndarray, vectors: np.ndarray, crossed: bool, threshold: float, bits: int):
    """Links and roots of one tile: of all pairs, or of pairs between its two sides."""
    order = np.argsort(rep, kind="stable")
    rep, mult, side, vectors = rep[order], mult[order], side[order], scaled(vectors[order])
    codes = codes_of(signs_of(vectors, table * bits), bits) if table else np.zeros((len(rep), 0), np.int64)
    norms = np.sqrt((vectors * vectors).sum(1))
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i in range(0, len(rep), STEP):
        near = (vectors[i : i + STEP] @ vectors[i:].T) / (norms[i : i + STEP, None] * norms[None, i:]) >= threshold
        a, b = np.nonzero(near)
        a, b = a + i, b + i
        kept = (a < b) & (side[a] != side[b]) if crossed else a < b
        a, b = a[kept], b[kept]
        kept = first_here(codes, table, a, b)
        a, b = a[kept], b[kept]
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for k, partners in zip(a[starts].tolist(), np.split(b, starts[1:]), strict=True) if len(a) else ():
            met = np.unique(np.append(root[partners], root[k]))
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    some = links > 0
    return rep[some], links[some], rep[root][some]


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two rows link when the cosine of their vectors is at least ``threshold``.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do rows without id or
    vectors of different lengths; such a row is its own component.  Repeated rows link with each other.  An empty
    table gives an empty one; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    ok = F.col("vec_id").isNotNull() & usable("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", ok).withColumn("h1", F.when(ok, F.xxhash64("v"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit(7), F.reverse("v"))))
    rows, rows_path = materialize(rows, "vector-rows")
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v"))
    classes, classes_path = materialize(classes.withColumn("dim", F.size("v")), "vector-classes")
    bits, tables, most = plan(classes.count(), threshold)

    def matrix(column: pa.Array, dim: int) -> np.ndarray:
        return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted(set(batch.column(2).to_pylist())):
                part = batch.filter(pa.compute.equal(batch.column(2), dim))
                signs = signs_of(scaled(matrix(part.column(1), dim)), max(SKETCH, bits * tables))
                sketch = np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)
                codes = codes_of(signs, bits)
                for t in range(tables):
                    columns = [pa.array(np.full(len(signs), t, np.int32)), pa.array(np.ascontiguousarray(codes[:, t])), part.column(2), part.column(0)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in (0, 1))], ["t", "code", "dim", "rep", "s0", "s1"])

    keys, tile = ["t", "code", "dim"], ["t", "code", "dim", "low", "high"]
    sketched, sketch_path = materialize(classes.select("rep", "v", "dim").mapInArrow(spread, "t int, code long, dim int, rep long, s0 long, s1 long"), "vector-sketches")

    def tiled(frame: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        large = frame.groupBy(*keys).count().where(F.col("count") > BLOCK).select(*keys, blocks.alias("n"))
        frame = frame.join(large, keys, "left").withColumn("n", F.coalesce("n", F.lit(1)))
        frame = frame.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return frame.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("n", "other")

    def choose(key: tuple, group: pa.Table) -> pa.Table:
        t, code, dim, low, high = (x.as_py() for x in key)
        sketches = np.stack([np.asarray(group["s0"]), np.asarray(group["s1"])], 1).view(np.uint64)
        chosen = group.filter(pa.array(partnered(t, sketches, np.asarray(group["own"]), low != high, bits, most))) if len(sketches) > 1 else group.slice(0, 0)
        same = lambda x, kind: pa.array(np.full(len(chosen), x), kind)
        return pa.table({"t": same(t, pa.int32()), "code": same(code, pa.int64()), "dim": same(dim, pa.int32()), "rep": chosen["rep"]})

    asked = tiled(sketched).groupBy(*tile).applyInArrow(choose, "t int, code long, dim int, rep long").distinct()
    asked, asked_path = materialize(asked, "vector-partners")
    tiles = tiled(asked).join(classes.select("rep", "mult", "v"), "rep")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        t, _, dim, low, high = (x.as_py() for x in key)
        vectors = matrix(group["v"].combine_chunks(), dim)
        rep, links, root = tile_links(t, np.asarray(group["rep"]), np.asarray(group["mult"]), np.asarray(group["own"]), vectors, low != high, threshold, bits)
        return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    found, found_path = materialize(tiles.groupBy(*tile).applyInArrow(compare, "rep long, links long, root long"), "vector-links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("h1", "h2", "rep", "mult").join(sums, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    named, named_path = materialize(
        named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-components"
    )
    good = rows.where("ok").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for path in (classes_path, sketch_path, asked_path, found_path):
        drop_path(spark, path)
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_near_vectors(spark, sf_dir):
    """Links and components of all vectors."""
    from caseflow.llm.common import table

    return link_vectors(table(spark, sf_dir, "embeddings"))
