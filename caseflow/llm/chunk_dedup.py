"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes marks boundaries; of boundaries closer than LEAST_CHUNK bytes only
the first of a cluster counts, so where a chunk ends depends on nothing but the bytes just before it, and an
insertion shifts chunks without changing those behind it.  Runs of a short period may have no such boundary at all: a
stretch of more than LONG_CHUNK bytes without one is cut again, where the hash is least in its surroundings, which comes back with every
period.  Each chunk is looked up by the 128-bit digest of itself and its successor.  All occurrences but the first (smallest id, then place) are
repeats; repeats that touch form a core.  A core grows bytewise at both ends as far as the bytes there equal those
at the first occurrence; what then has at least LEAST_SPAN bytes is a span, to be reported or cut out.

What a core can grow by is bounded: a boundary of the first kind that REACH equal bytes precede stands in both texts, so that
what follows is a repeat, too.  The stretch next to each end, and REACH bytes more, of both texts therefore suffice.  A first
occurrence sends its bytes once per digest and salt, so that a common passage meets its copies in many tasks.

Records travel as blobs by bucket of the digest.  Of records that one task has for a digest only the first goes
to the digest's bucket; the others are known repeats and go by their document, so a passage that a third
of all documents share costs its bucket one record per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.common import buckets_for, drop_path, free_prefix, materialize, may_be_among, utf8_column

#: A boundary stands at one of RARITY places on average; sizes in bytes.
RARITY, LEAST_CHUNK, LEAST_SPAN = 20, 12, 100
#: Longer chunks are cut again, at least hashes among so many bytes.
LONG_CHUNK, NEAR = 160, 32
#: Bytes that decide on a boundary: those hashed, and those in which an earlier one may hide it.
REACH = 16 + LEAST_CHUNK
#: ``many``: the task that made the record has others of its digest.
UNIT = np.dtype([("digest", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("size", "<u4"), ("many", "u1")])
REPEAT = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("stop", "<u4"), ("digest", "<u8"), ("more", "<u8")])
SALTS = 1024
#: Records that a task holds before it sends them.
FLUSH = 300_000
DIGEST = "struct<digest:bigint,more:bigint>"
CORE = f"doc_id long, text_hash long, start long, stop long, head {DIGEST}, tail {DIGEST}"


def gear() -> np.ndarray:
    """256 values of 16 bits, from a fixed generator."""
    return np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


GEAR = gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # twice the window with each step: h[i] + (h[i - k] << k)
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint16(k)
        h = wider
    return h


def boundaries(h: np.ndarray) -> np.ndarray:
    """Ends of chunks inside a text: after byte i if the hash of bytes i - 15 to i is small."""
    at = np.flatnonzero(h < (1 << 16) // RARITY) + 1
    at = at[at < len(h)]
    return at[np.diff(at, prepend=-LEAST_CHUNK) >= LEAST_CHUNK]


def again(h: np.ndarray, start: int, stop: int) -> list[int]:
    """Cuts inside a long chunk: behind the last of the least hashes of each NEAR bytes, LEAST_CHUNK bytes apart."""
    windows = np.lib.stride_tricks.sliding_window_view(h[start:stop][::-1], NEAR)
    at = stop - np.unique(np.argmin(windows, 1) + np.arange(len(windows)))[::-1]
    out, last = [], start
    for x in at.tolist():
        if x - last >= LEAST_CHUNK and stop - x >= LEAST_CHUNK:
            out.append(x)
            last = x
    return out


def cuts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin and end, and which of these places depend on the bytes just before them alone."""
    h = rolling(np.frombuffer(text, np.uint8))
    cuts = np.concatenate(([0], boundaries(h), [len(text)]))
    long = np.flatnonzero(np.diff(cuts) > LONG_CHUNK)
    if not len(long):
        return cuts, cuts
    return np.sort(np.concatenate([cuts, *(again(h, int(cuts[i]), int(cuts[i + 1])) for i in long)]).astype(np.int64)), cuts


def units(text: bytes, doc: int) -> np.ndarray:
    """A record per chunk and its successor."""
    if len(text) < LEAST_SPAN:
        return np.zeros(0, UNIT)
    cuts, _ = cuts_of(text)
    stops = cuts[2:] if len(cuts) > 2 else cuts[1:]
    starts = cuts[: len(stops)]
    out = np.empty(len(stops), UNIT)
    digests = b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    out["digest"], out["more"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    out["doc"], out["text"], out["start"], out["size"] = doc, xxhash.xxh32_intdigest(text), starts, stops - starts
    out["many"] = 0
    return out


def repeats_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each digest, and the others as repeats of it."""
    rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"], rows["more"], rows["digest"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["digest"][1:] != rows["digest"][:-1]) | (rows["more"][1:] != rows["more"][:-1])
    many = np.maximum.reduceat(rows["many"], np.flatnonzero(first)) if len(rows) else rows["many"]
    later = ~first  # rows that repeat a document as a whole are one document
    later[1:] &= (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1]) | (rows["start"][1:] != rows["start"][:-1])
    out = np.empty(later.sum(), REPEAT)
    for name in ("doc", "text", "start", "digest", "more"):
        out[name] = rows[name][later]
    out["stop"] = out["start"] + rows["size"][later]
    if len(rows):
        many = many | np.maximum.reduceat(later, np.flatnonzero(first)).astype(np.uint8)
    firsts = rows[first]
    firsts["many"] = many
    return firsts, out


def digest_of(rows: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(rows[name].astype(np.int64)) for name in ("digest", "more")], ["digest", "more"])


def cores_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Touching repeats of a document merged, and the last repeat of each."""
    rows = rows[np.lexsort((rows["stop"], rows["start"], rows["text"], rows["doc"]))]
    if not len(rows):
        return rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1]) | (rows["start"][1:] > rows["stop"][:-1])
    at = np.flatnonzero(new)
    out, last = rows[at].copy(), rows[np.append(at[1:], len(rows)) - 1]
    out["stop"] = last["stop"]
    return out, last


def beside(text: bytes, cuts: np.ndarray, at: int, up: bool) -> bytes:
    """The stretch between boundaries before or behind a place, and REACH bytes beyond it."""
    if up:
        return text[max(0, int(cuts[max(0, np.searchsorted(cuts, at) - 1)]) - REACH) : at]
    return text[at : int(cuts[min(len(cuts) - 1, np.searchsorted(cuts, at, side="right"))]) + REACH]


def alike(a: bytes, b: bytes, up: bool) -> int:
    """How many bytes two texts have in common at their ends (up) or beginnings."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (np.frombuffer(t[len(t) - n :][::-1] if up else t[:n], np.uint8) for t in (a, b))
    differ = x != y
    return int(differ.argmax()) if differ.any() else n


def repeated_spans(docs: DataFrame, least_span: int = LEAST_SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, start, stop, earlier_doc_id``: stretches of bytes that stand earlier, too.

    Earlier: in a document of smaller id, or before in the same one; ``earlier_doc_id`` names one such document.
    Nulls, texts under ``least_span`` bytes and rows without id have no spans, an empty table none at all.  Rows that
    repeat an id and text are one document; other rows of one id are told apart by ``text_hash``.  Other columns are
    left out.  A text of any length is taken whole; a task holds a few such texts at a time.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    buckets = buckets_for(narrow, "text", UNIT.itemsize / 30)  # a chunk for 30 bytes

    def split(rows: np.ndarray, at: np.ndarray) -> dict[int, bytes]:
        order = np.argsort(at, kind="stable")
        rows, bounds = rows[order], np.searchsorted(at[order], np.arange(buckets + 1))
        return {b: rows[bounds[b] : bounds[b + 1]].tobytes() for b in range(buckets) if bounds[b] < bounds[b + 1]}

    def by_doc(rows: np.ndarray) -> dict[int, bytes]:
        h = rows["doc"].view(np.uint64) if rows["doc"].flags.c_contiguous else np.ascontiguousarray(rows["doc"]).view(np.uint64)
        return split(rows, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            first, later = repeats_of(np.concatenate(held))
            held.clear()
            pa.default_memory_pool().release_unused()
            a, b = split(first, (first["digest"] >> np.uint64(32)).astype(np.int64) % buckets), by_doc(later)
            names = sorted({*a, *b})
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([x.get(k, b"") for k in names], pa.binary()) for x in (a, b))], ["bucket", "units", "repeats"])

        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                held.append(units(data[offsets[i] : offsets[i + 1]].tobytes(), doc))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def match(group: pa.Table) -> pa.Table:
        first, later = repeats_of(np.frombuffer(b"".join(group["units"].to_pylist()), UNIT))
        known = np.frombuffer(b"".join(group["repeats"].to_pylist()), REPEAT)
        out = by_doc(np.concatenate((later, known)))
        names, blobs = [group["bucket"][0].as_py(), *out], [None, *out.values()]
        return pa.table({"bucket": pa.array(names, pa.int32()), "repeats": pa.array(blobs, pa.binary()), "firsts": pa.array([first[first["many"] > 0].tobytes()] + [None] * len(out), pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                first = np.frombuffer(blob, UNIT)
                stop = first["start"].astype(np.int64) + first["size"]
                columns = [first["doc"], first["text"].astype(np.int64), first["start"].astype(np.int64), stop]
                yield pa.RecordBatch.from_arrays([digest_of(first), *(pa.array(np.ascontiguousarray(x)) for x in columns)], ["digest", "doc_id", "text_hash", "start", "stop"])

    def merge(group: pa.Table) -> pa.Table:
        core, last = cores_of(np.frombuffer(b"".join(group["repeats"].to_pylist()), REPEAT))
        columns = [pa.array(core[name].astype(np.int64)) for name in ("doc", "text", "start", "stop")]
        return pa.table(dict(zip(cores_have, [*columns, digest_of(core), digest_of(last)], strict=True)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies beside both ends of each place that is asked for."""
        for batch in batches:
            data, offsets = utf8_column(batch.column(0))
            asked, bounds = batch.column(1).flatten(), np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))))
            texts, starts, stops = (asked.field(name).to_numpy(zero_copy_only=False) for name in ("text_hash", "start", "stop"))
            rows, up, down = [], [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                own, cuts = xxhash.xxh32_intdigest(text), None
                for k in range(bounds[i], bounds[i + 1]):
                    if texts[k] == own:
                        cuts = cuts_of(text)[1] if cuts is None else cuts
                        rows.append(k)
                        up.append(beside(text, cuts, int(starts[k]), True))
                        down.append(beside(text, cuts, int(stops[k]), False))
            taken = asked.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.field(name) for name in asks_have), pa.array(up, pa.binary()), pa.array(down, pa.binary())], [*asks_have, "up", "down"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            mine, first = ([columns[f"{a}{b}"].to_pylist() for b in ("up", "down")] for a in ("", "first_"))
            up, down = (np.array([alike(a, b, side == 0) for a, b in zip(mine[side], first[side], strict=True)], np.int64) for side in (0, 1))
            columns["start"] = pa.array(columns["start"].to_numpy() - up)
            columns["stop"] = pa.array(columns["stop"].to_numpy() + down)
            yield pa.RecordBatch.from_arrays([columns[name] for name in spans_have], spans_have)

    cores_have = ["doc_id", "text_hash", "start", "stop", "head", "tail"]
    asks_have, spans_have = [*cores_have, "digest", "salts"], [*cores_have[:4], "earlier_doc_id"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    dealt = narrow.mapInArrow(deal, "bucket int, units binary, repeats binary")
    matched, matched_path = materialize(dealt.groupBy("bucket").applyInArrow(match, "bucket int, repeats binary, firsts binary"), "repeat-matches")
    cores, cores_path = materialize(matched.where("repeats is not null").groupBy("bucket").applyInArrow(merge, CORE), "repeat-cores")

    firsts = matched.where("firsts is not null").select("firsts").mapInArrow(unpack, f"digest {DIGEST}, doc_id long, text_hash long, start long, stop long")
    ends = cores.select(F.explode(F.array("head", "tail")).alias("digest"), salt.alias("salt")).distinct()
    none = F.lit(None).cast(DIGEST)
    of_firsts = firsts.join(ends.groupBy("digest").agg(F.collect_list("salt").alias("salts")), "digest").select(*cores_have[:4], none.alias("head"), none.alias("tail"), "digest", "salts")
    asks = cores.select("*", none.alias("digest"), F.lit(None).cast("array<int>").alias("salts")).unionByName(of_firsts)
    asked = asks.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(*asks_have)).alias("asked"))
    asked, asked_path = materialize(asked, "repeat-asked")
    some = narrow.where(may_be_among(F.col("doc_id"), asked.select("__id")))  # other texts are not moved
    seen = some.join(asked, F.col("doc_id") == F.col("__id")).select("text", "asked").mapInArrow(look, f"{CORE}, digest {DIGEST}, salts array<int>, up binary, down binary")
    seen, _ = materialize(seen.dropDuplicates(["doc_id", "text_hash", "start", "stop", "digest"]), "repeat-sides")
    for path in (matched_path, cores_path, asked_path):
        drop_path(spark, path)

    at_firsts = seen.where("digest is not null").select("digest", F.explode("salts").alias("salt"), F.col("doc_id").alias("earlier_doc_id"), "up", "down")
    heads = at_firsts.select(F.col("digest").alias("head"), "salt", "earlier_doc_id", F.col("up").alias("first_up"))
    tails = at_firsts.select(F.col("digest").alias("tail"), "salt", F.col("down").alias("first_down"))
    sides = seen.where("digest is null").select(*cores_have, salt.alias("salt"), "up", "down").join(heads, ["head", "salt"]).join(tails, ["tail", "salt"])
    grown = sides.select(*cores_have[:4], "earlier_doc_id", "up", "down", "first_up", "first_down").mapInArrow(grow, "doc_id long, text_hash long, start long, stop long, earlier_doc_id long")
    within = W.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    apart = F.coalesce(F.col("start") > F.max("stop").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    islands = grown.where(F.col("stop") - F.col("start") >= least_span).withColumn("__apart", apart.cast("int")).withColumn("__island", F.sum("__apart").over(within))
    spans = islands.groupBy("doc_id", "text_hash", "__island").agg(F.min_by("earlier_doc_id", F.struct("start", "earlier_doc_id")).alias("earlier_doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select(*spans_have)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans; a span's ends move inwards to whole characters."""
    out, at = [], 0
    for start, stop in sorted(spans):
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        if start >= at and start < stop:
            out.append(text[at:start])
            at = stop
    return b"".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, least_span: int = LEAST_SPAN, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with repeated spans cut out of their texts, and ``chars_col`` counted anew for these.

    Every row stays, whatever remains of it; the first occurrence of a passage stays, too.
    """
    spans, _ = materialize(repeated_spans(docs, least_span, id_col, text_col), "repeated-spans")
    per_doc = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    p = free_prefix(docs.columns)
    per_doc = per_doc.groupBy(F.col("doc_id").alias(f"{p}id")).agg(F.collect_list(F.struct("text_hash", "spans")).alias(f"{p}spans"))
    per_doc, _ = materialize(per_doc, "repeat-marks")
    maybe = may_be_among(F.col(id_col), per_doc.select(f"{p}id"))
    joined = docs.where(maybe).join(per_doc, F.col(id_col).cast("long") == F.col(f"{p}id"), "left").drop(f"{p}id")
    at, text_at = len(docs.columns), docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(at)
            columns = list(batch.columns[:at])
            changed = np.flatnonzero(np.asarray(marks.is_valid()))
            if len(changed):
                texts = columns[text_at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i in changed.tolist():
                    raw = (texts[i] or "").encode()
                    own = xxhash.xxh32_intdigest(raw)
                    found = [(s["start"], s["stop"]) for m in marks[i].as_py() if m["text_hash"] == own for s in m["spans"]]
                    if found:
                        texts[i] = cut(raw, found).decode("utf-8", "replace")
                        if chars is not None:
                            chars[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars is not None:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:at])

    return joined.mapInArrow(rewrite, docs.schema).union(docs.where(~maybe))


def op10_repeated_spans(spark, sf_dir):
    """Every stretch of a document that stands in an earlier one, or earlier in the same."""
    from caseflow.llm.common import table

    return repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")
