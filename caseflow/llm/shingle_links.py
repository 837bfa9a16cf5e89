"""N-gram Jaccard join of whole texts, exact and without comparing all pairs.

Sets of equal shingles are one class; shingles and classes go by 64-bit hashes.  Two linked sets of at most n shingles
differ in so few of them that the first ``n - ceil(t n) + 1`` shingles of each, in any order that is the same for
all sets, have one in common.  The order here puts rare shingles first: a fraction of the hash space (RICH times 1 - t)
is counted over all classes, and its shingles stand before the others by the number of classes that hold them.  A
shingle of one class meets nothing and is never sent again, so a set of its own has no key at all, and a passage that many
documents share stands at the end of the order.  Keys are the shingles of a set's first part that others hold, too.

Sets that share keys form clusters.  First every set is compared with the centre of each of its keys.  What then still lies
in several components of a cluster is compared in tiles: a band of set sizes with itself and with the next band, in
blocks, without pairs that lie in the largest component both.  In a tile, hashed bitmaps bound the overlap from above (the
bits that one bitmap has and the other lacks), and the sorted arrays of the pairs that remain are intersected exactly.
A tile yields links that span its components, never its pairs.

Shingles travel as blobs by bucket of their hash; the number of buckets follows from the bytes of all texts.  A shingle that HOT
classes of one blob hold is sent once there and counts as frequent everywhere; rows go by their id, so that no group of
copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import buckets_for, connected_components, materialize, may_be_among, new_path, release, scratch, slices, utf8_column

#: Sets in a block of a tile, and shingles in it; distinct words that a worker remembers.
BLOCK, BLOCK_SHINGLES, REMEMBERED = 256, 1 << 20, 100_000
MOST_BITS = 1 << 18
RICH, HOT = 2.5, 16
#: Shingles that a task holds before it sends them.
FLUSH = 600_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A shingle's hash within its bucket (48 bits) and a class that holds it; 0 in ``cls`` and in ``many`` 1: frequent.
ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("cls", "<i8")])
COUNTED = np.dtype([("cls", "<i8"), ("key", "<u8"), ("count", "<u4")])
#: A class, its shingles, those in the counted fraction.
CLASS = np.dtype([("cls", "<i8"), ("n", "<i8"), ("counted", "<i8")])
ROW = np.dtype([("id", "<i8"), ("cls", "<i8"), ("n", "<i8")])
FREQUENT, UNCOUNTED = (1 << 32) - 2, (1 << 32) - 1
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def words() -> Words:
    return Words()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts back to back: the hashes of each one's distinct n-word shingles, sorted, and the bounds of each text's.

    A text of fewer words has the whole sequence as one shingle; one without words has none.
    """
    bounds = offsets - offsets[0]
    apart = np.insert(data[offsets[0] : offsets[-1]], bounds[1:-1], 0x20)
    bounds = bounds + np.concatenate(([0], np.arange(len(bounds) - 2), [len(bounds) - 2])) if len(bounds) > 2 else bounds
    tokens = apart.tobytes().lower().split()  # ASCII letters and ASCII white space only
    space = SPACE[apart]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(apart) else np.zeros(0, np.int64)
    first = np.searchsorted(begins, bounds)
    first[-1] = len(begins)
    counts = np.diff(first)
    h = np.fromiter(map(words().__getitem__, tokens), np.uint64, len(tokens))
    out = np.full(len(h), n, np.uint64)
    for k in range(min(n, len(h))):
        out[: len(h) - k] = mix(out[: len(h) - k] ^ h[k:]) * M2
    valid = np.ones(len(h), bool)
    for k in range(1, n):  # the last places of each text start no whole shingle
        at = first[1:][counts >= k] - k
        valid[at] = False
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short.tolist():
        whole = np.full(1, counts[i], np.uint64)
        for k in range(counts[i]):
            whole = mix(whole ^ h[first[i] + k]) * M2
        out[first[i]], valid[first[i]] = whole[0], True
    places = np.concatenate(([0], np.cumsum(valid)))[first]
    out = out[valid]
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[places[:-1][places[:-1] < len(out)]] = True
    return out[fresh], np.concatenate(([0], np.cumsum(fresh)))[places]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of stretches, modulo 2 ** 64."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[bounds[1:]] - total[bounds[:-1]]


def classes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit name of each set."""
    return mix(mix(sums(mix(hashes), bounds)) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def head(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Shingles at the beginning of a set of n of which a linked set shares one."""
    return n + (-num * n // den) + 1


def width_for(n: int) -> int:
    """Bits of a bitmap for sets of up to n shingles: 4 to 8 for each."""
    return min(MOST_BITS, 1 << max(7, int(4 * n - 1).bit_length()))


def bitmaps(hashes: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    out = np.empty((len(bounds) - 1, bits // 64), np.uint64)
    flags = np.zeros(bits, bool)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        flags[at[a:b]] = True
        out[i] = np.packbits(flags).view(np.uint64)
        flags[at[a:b]] = False
    return out


def tile_links(names: np.ndarray, sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, crossed: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Links (names) that span the components of a tile: of all pairs, or of those between its two sides.

    Pairs that already lie in one component are left out.
    """
    order = np.lexsort((names, [len(x) for x in sets]))
    names, component, side, sets = names[order], component[order], side[order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    bounds = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(sets)
    maps = bitmaps(flat, bounds, width_for(int(size[-1])))
    column = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(column.max()) + 1, np.int64)
    _, root = np.unique(component, return_inverse=True)
    out = []
    for i in range(len(sets) - 1):
        reach = int(np.searchsorted(size, size[i] * den // num, side="right"))
        near = root[i + 1 : reach] != root[i]
        if crossed:
            near &= side[i + 1 : reach] != side[i]
        near = np.flatnonzero(near) + i + 1
        if not len(near):
            continue
        a, b = maps[i], maps[near]
        overlap = np.minimum(size[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), size[near] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        near = near[den * overlap >= num * (size[i] + size[near] - overlap)]
        if not len(near):
            continue
        own = column[bounds[i] : bounds[i + 1]]
        mark[own] = 1
        both = np.array([mark[column[bounds[j] : bounds[j + 1]]].sum() for j in near.tolist()])
        mark[own] = 0
        for j in near[den * both >= num * (size[i] + size[near] - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((int(names[i]), int(names[j])))
    return out


def compared(tiles: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: links that span the components of tiles.

    ``tiles``: a row per tile (``t1``, ``t2``, ``low``, ``high``) and set in it (``cls``, ``component``, and ``own``, which of
    the two blocks it is of; if these are one block, all its pairs are compared).
    """

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        cls = np.asarray(group["cls"])
        found = []
        if len(cls) > 1:
            arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["hashes"]]
            found = tile_links(cls, arrays, np.asarray(group["component"]), np.asarray(group["own"]), key[2].as_py() != key[3].as_py(), num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return tiles.join(sets, "cls").groupBy("t1", "t2", "low", "high").applyInArrow(compare, "a long, b long")


def blocks_of(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def star_tiles(groups: DataFrame) -> DataFrame:
    """Each set of a key with the key's centre (its smallest class), in blocks."""
    stars = groups.where("cls != center").select("center", "cls", "n").distinct()
    shape = stars.groupBy("center").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    members = stars.join(shape, "center").select(F.col("center").alias("t1"), F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("t2"), "cls", F.lit(1).alias("own"))
    centres = shape.select(F.col("center").alias("t1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t2"), F.col("center").alias("cls"), F.lit(0).alias("own"))
    return members.unionByName(centres).select("t1", "t2", F.lit(0).alias("low"), F.lit(1).alias("high"), "cls", "own", F.col("cls").alias("component"))


def open_tiles(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The tiles of clusters that hold several components.  ``nodes``: ``cluster, cls, component, n``."""
    sizes = nodes.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("all"))
    main = main.where("parts > 1 and all > 2").select("cluster", "main")  # two alone have been compared
    # Linked sets lie in one band of sizes, or in two neighbouring ones.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9)
    banded = nodes.join(main, "cluster").withColumn("open", F.col("component") != F.col("main")).withColumn("band", band.cast("int"))
    banded = banded.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    part = ["cluster", "tile"]
    count = lambda cond: blocks_of(F.count_if(cond), F.sum(F.when(cond, F.col("n")).otherwise(0)))
    shape = banded.groupBy(*part).agg(
        count(F.col("open")).alias("of_open"), count(~F.col("open")).alias("of_main"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("band").alias("least")
    )
    shape = shape.where("of_open > 0 and x != y and least = tile").select(*part, "of_open", "of_main")
    h = F.xxhash64("cls")
    dealt = banded.join(shape, part).withColumn("own", F.when(F.col("open"), F.pmod(h, "of_open")).otherwise(F.col("of_open") + F.pmod(h, "of_main")).cast("int"))
    last = F.col("of_open") - 1 + F.when(F.col("open"), F.col("of_main")).otherwise(0)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select(F.col("cluster").alias("t1"), F.col("tile").alias("t2"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cls", "own", "component")


def shingle_components(docs: DataFrame, words_per_shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are stretches without ASCII white space, with A-Z in lower case.  Rows link when ``den *
    intersection >= num * union`` of their sets of distinct shingles; a component is named by its
    smallest id.  Texts without words and nulls link with nothing.  Repeated rows link with each other, and
    rows of one id are one document: they share one component, whatever their texts, and each row states the size of its own set.
    Rows without id keep their size and have no component.  An empty table gives an empty one, other columns are left
    out, and a text of any length is taken whole; a task holds a few such texts at a time.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shingle-components")
    with scratch(spark):
        components_of(docs, words_per_shingle, num, den, id_col, text_col).write.parquet(path)
    return spark.read.schema(COMPONENTS).parquet(path)


COMPONENTS = "doc_id long, n_shingles long, component_id long"


def split(rows: np.ndarray, at: np.ndarray, buckets: int) -> list[bytes]:
    """The rows of each bucket."""
    order = np.argsort(at, kind="stable")
    rows, bounds = rows[order], np.searchsorted(at[order], np.arange(buckets + 1))
    return [rows[bounds[b] : bounds[b + 1]].tobytes() for b in range(buckets)]


def short(key: np.ndarray, shift: np.uint64) -> np.ndarray:
    """A hash as its bucket and the last 48 bits, which is all that an entry says."""
    return ((key >> shift) << np.uint64(48)) | (key & np.uint64(0xFFFFFFFFFFFF))


def bucket_of(values: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (mix(np.ascontiguousarray(values).view(np.uint64)) >> shift).astype(np.int64)


def heads_of(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows of kind 0: every row's ``doc_id, cls, n``; of kind 1: ``cls, n, key`` for the keys of each class."""
    share = min(1.0, RICH * (den - num) / den)
    buckets = buckets_for(docs, "text", share * ENTRY.itemsize / 7, 1 << 16)  # a shingle for 7 bytes
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    limit = np.uint64(round(share * (1 << 16)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, sets, more, rows, held, seen = [], [], [], [], [], 0, set()

        def flush() -> pa.RecordBatch:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            times = np.diff(np.append(starts, len(key)))
            hot = np.repeat(times >= HOT, times)
            sent = np.concatenate((np.flatnonzero(~hot), starts[times >= HOT]))
            entries = np.empty(len(sent), ENTRY)
            entries["low"], entries["high"] = key[sent] & np.uint64(0xFFFFFFFF), (key[sent] >> np.uint64(32)) & np.uint64(0xFFFF)
            entries["cls"] = np.where(hot[sent], 0, owner[sent])  # no class has the name 0
            frequent = np.empty(hot.sum(), COUNTED)
            frequent["cls"], frequent["key"], frequent["count"] = owner[hot], short(key[hot], shift), FREQUENT
            frequent = np.concatenate([frequent, *more])
            parts = [np.concatenate(x) for x in (sets, rows)]
            out = [
                split(entries, (key[sent] >> shift).astype(np.int64), buckets),
                split(frequent, bucket_of(frequent["cls"], shift), buckets),
                split(parts[0], bucket_of(parts[0]["cls"], shift), buckets),
                split(parts[1], bucket_of(parts[1]["id"], shift), buckets),
            ]
            for x in (keys, owners, sets, more, rows):
                x.clear()
            filled = [b for b in range(buckets) if any(x[b] for x in out)]
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *(pa.array([x[b] for b in filled], pa.binary()) for x in out)], ["bucket", "entries", "counted", "sets", "rows"])

        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                hashes, bounds = shingle_sets(data, offsets[i : j + 1], n)
                size, names = np.diff(bounds), classes_of(hashes, bounds)
                row = np.empty(j - i, ROW)
                row["id"], row["cls"], row["n"] = ids[i:j], names, size
                rows.append(row)
                new = np.zeros(j - i, bool)
                for k, name in enumerate(names.tolist()):  # copies in one task send their shingles once
                    if name not in seen and size[k]:
                        new[k] = True
                        if len(seen) < REMEMBERED:
                            seen.add(name)
                own = np.repeat(np.arange(j - i), size)
                chosen = new[own]
                hashes, own = hashes[chosen], own[chosen]
                counted = (hashes & np.uint64(0xFFFF)) < limit
                of_sample = np.bincount(own[counted], minlength=j - i)
                one = np.empty(new.sum(), CLASS)
                one["cls"], one["n"], one["counted"] = names[new], size[new], of_sample[new]
                sets.append(one), keys.append(hashes[counted]), owners.append(names[own[counted]])
                # Where the counted shingles are fewer than a head has, it goes on with the others by their hash.
                left = head(size, num, den) - of_sample
                rest, whose = hashes[~counted], own[~counted]
                place = np.arange(len(rest)) - np.searchsorted(whose, whose)
                taken = place < left[whose]
                beyond = np.empty(taken.sum(), COUNTED)
                beyond["cls"], beyond["key"], beyond["count"] = names[whose[taken]], short(rest[taken], shift), UNCOUNTED
                more.append(beyond)
                held += len(keys[-1]) + len(beyond) + (j - i)
                if held > FLUSH:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    blobs = "bucket int, counted binary, sets binary, rows binary"

    def count(group: pa.Table) -> pa.Table:
        """How many classes hold each shingle; those of several go on to their classes."""
        bucket = group["bucket"][0].as_py()
        raw = np.frombuffer(b"".join(group["entries"].to_pylist()), ENTRY)
        key = (raw["high"].astype(np.uint64) << np.uint64(32)) | raw["low"]
        order = np.lexsort((raw["cls"], key))
        key, cls = key[order], raw["cls"][order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[fresh], cls[fresh]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        times = np.diff(np.append(starts, len(key))).astype(np.int64)
        if len(starts):
            times = np.where(np.logical_or.reduceat(cls == 0, starts), FREQUENT, np.minimum(times, FREQUENT - 1))
        times = np.repeat(times, np.diff(np.append(starts, len(key))))
        several = (times > 1) & (cls != 0)
        found = np.empty(several.sum(), COUNTED)
        found["cls"], found["key"], found["count"] = cls[several], key[several] | np.uint64(bucket << 48), times[several]
        out = split(found, bucket_of(found["cls"], shift), buckets)
        names = [b for b in range(buckets) if out[b] or b == bucket]
        mine = lambda name: [b"".join(group[name].to_pylist()) if b == bucket else b"" for b in names]
        passed = mine("counted")
        return pa.table({"bucket": pa.array(names, pa.int32()), "counted": pa.array([out[b] + p for b, p in zip(names, passed, strict=True)], pa.binary()), "sets": pa.array(mine("sets"), pa.binary()), "rows": pa.array(mine("rows"), pa.binary())})

    def heads(group: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(group["rows"].to_pylist()), ROW)
        sets = np.unique(np.frombuffer(b"".join(group["sets"].to_pylist()), CLASS))
        found = np.frombuffer(b"".join(group["counted"].to_pylist()), COUNTED)
        order = np.lexsort((found["key"], found["count"], found["cls"]))
        key, cls, times = found["key"][order], found["cls"][order], found["count"][order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, times = key[fresh], cls[fresh], times[fresh]
        of = np.searchsorted(sets["cls"], cls)
        counted = times != UNCOUNTED
        shared = np.bincount(of[counted], minlength=len(sets))
        left = head(sets["n"], num, den) - (sets["counted"] - shared)  # shingles of one class come first
        place = np.arange(len(key)) - np.searchsorted(cls, cls)
        # The uncounted ones that a class has sent are those that its head needs.
        taken = (place < left[of]) | ~counted
        key, of = key[taken], of[taken]
        none = lambda k: pa.nulls(k, pa.int64())
        column = lambda x: pa.array(np.ascontiguousarray(x).astype(np.int64))
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(row), len(key)])),
                "doc_id": pa.concat_arrays([column(row["id"]), none(len(key))]),
                "cls": column(np.concatenate((row["cls"], sets["cls"][of]))),
                "n": column(np.concatenate((row["n"], sets["n"][of]))),
                "key": pa.concat_arrays([none(len(row)), pa.array(np.ascontiguousarray(key).view(np.int64))]),
            }
        )

    dealt = docs.mapInArrow(deal, "bucket int, entries binary, counted binary, sets binary, rows binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, blobs)
    return counted.groupBy("bucket").applyInArrow(heads, "kind int, doc_id long, cls long, n long, key long")


def sets_of(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``cls, hashes`` of classes, from the text of one row each (``cls, doc_id``)."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat an id are in one task: its classes need no second set
        for batch in batches:
            data, offsets = utf8_column(batch.column(0))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                hashes, bounds = shingle_sets(data, offsets[i : j + 1], n)
                own = classes_of(hashes, bounds)
                kept = [k for k in range(j - i) if own[k] == names[i + k]]  # not another text of the same id
                kept = [k for k in kept if own[k] not in seen and not seen.add(own[k])]
                out = [hashes[bounds[k] : bounds[k + 1]].tobytes() for k in kept]
                yield pa.RecordBatch.from_arrays([pa.array(own[kept], pa.int64()), pa.array(out, pa.binary())], ["cls", "hashes"])

    return docs.join(classes, "doc_id").select("text", "cls").mapInArrow(arrays, "cls long, hashes binary")


def components_of(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The plan of ``shingle_components``, over intermediate tables that go when it has been written."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = narrow.where("doc_id is not null")
    found, _ = materialize(heads_of(named, n, num, den), "shingle-heads")
    release(spark)
    rows, keys = found.where("kind = 0").select("doc_id", "cls", "n"), found.where("kind = 1").select("key", "cls", "n")

    # Keys with the same sets say the same; one of them is enough.
    groups = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("cls").alias("center"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("same")).where("members > 1")
    groups = groups.groupBy("same", "members").agg(F.min_by(F.struct("key", "center"), "key").alias("one")).select("one.*")
    groups, _ = materialize(keys.join(groups, "key"), "shingle-groups")
    nodes = groups.select("cls", "n").distinct()
    reps = rows.join(nodes.select("cls"), "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    reps, _ = materialize(reps, "shingle-reps")
    held = named.where(may_be_among(F.col("doc_id"), reps.select("doc_id")))  # other texts are not moved
    sets, _ = materialize(sets_of(held, reps, n), "shingle-sets")
    release(spark)

    links, _ = materialize(compared(star_tiles(groups), sets, num, den), "shingle-stars")
    components, _ = materialize(connected_components(links), "shingle-known")
    clusters = connected_components(groups.where("cls != center").select(F.col("cls").alias("a"), F.col("center").alias("b")))
    placed = nodes.join(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "cls")
    placed = placed.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed, _ = materialize(placed, "shingle-nodes")
    more, _ = materialize(compared(open_tiles(placed, num, den), sets, num, den), "shingle-more")
    release(spark)

    # Rows of one id are one document, whatever their texts.
    texts = rows.where("n > 0")
    several = texts.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x != y").select("doc_id", "x")
    same_id = texts.join(several, "doc_id").where("cls != x").select(F.col("cls").alias("a"), F.col("x").alias("b"))
    edges = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same_id)
    final, _ = materialize(connected_components(edges), "shingle-final")

    by_class = texts.groupBy("cls").agg(F.min("doc_id").alias("rep")).join(final.withColumnRenamed("node", "cls"), "cls", "left")
    by_class, _ = materialize(by_class.select("cls", "rep", F.coalesce("component", "cls").alias("component")), "shingle-classes")
    names = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    told, _ = materialize(texts.join(by_class, "cls").join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "shingle-told")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    others = told.join(empty.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(others, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for i, j in slices(offsets):
                counts = np.diff(shingle_sets(data, offsets[i : j + 1], n)[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.nulls(j - i, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    nameless = narrow.where("doc_id is null").mapInArrow(sizes, COMPONENTS)
    return told.unionByName(empty).unionByName(nameless)


def op7_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    from caseflow.llm.common import table

    return shingle_components(table(spark, sf_dir, "documents"), 4, 85, 100)
