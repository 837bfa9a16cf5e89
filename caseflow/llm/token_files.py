"""Token files: identifiers packed into the fewest bits that the vocabulary needs.

A set of token files is a Parquet table ``blocks`` and a small table ``parts``, written and read by
Spark, so that any store works and a lost task is written anew.  A block holds whole texts: ``payload``
has their identifiers one after another, ``bits`` bits each (least significant bit first), and
``ends`` the place in the block where each text ends.  ``first`` is the block's first token
counted from the start of its part, and ``parts`` has the first token of each part, so a block can
be found and unpacked by itself, by numpy, without a loop over tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.bpe import WORDS, ByteBPE, little_endian
from caseflow.llm.common import new_path, slices, utf8_column

#: Tokens after which a block ends; only a longer text makes a longer block.
BLOCK_TOKENS = 1 << 18
BLOCKS = "part int, block int, bits int, first long, n_tokens long, doc_ids array<{id}>, ends array<long>, payload binary"


def bits_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Identifiers as consecutive groups of ``bits`` bits, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Identifiers ``start`` to ``stop`` of a payload, without reading the rest."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-stop * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[low:high], bitorder="little")[start * bits - low * 8 :][: (stop - start) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class LibraryBPE(ByteBPE):
    """Texts cut at forced boundaries, whose fragments a library encodes.

    Where merged tokens are numbered in the order of their merges, tiktoken does so, whose rank of a pair is the number of the
    token that it makes; it gives what the tokenizers library gives in a third of the time.  Else the latter does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path)
        merged = np.fromiter(self.made.values(), np.int64, len(self.made))
        if len(self.ids) == len(self.made) + 256 and (np.diff(merged) == 1).all() and -1 not in self.single:
            import tiktoken

            library = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=self.ids, special_tokens={})
            self._ids = library.encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self._ids = lambda text: library.encode(text, add_special_tokens=False).ids

    def _fragment(self, fragment: bytes) -> bytes:
        return little_endian(self._ids(fragment.decode("utf-8", "replace")))


@lru_cache(maxsize=2)
def library_bpe(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def write_token_files(
    docs: DataFrame, path: str, out: str, end_id: int = 0, vocabulary: int | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text, appends ``end_id``, and writes token files to ``out`` in ascending id order.

    Nulls and empty texts have the end id alone.  Null ids come first; rows of one id follow each other
    in the order of their texts; other columns are left out.  One shuffle, by ranges of the id, which
    no frequent value can unbalance as long as ids differ; memory is bounded by a block.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, id_type = docs.sparkSession, narrow.schema["doc_id"].dataType.simpleString()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_bpe(path)
        bits, end = bits_of(vocabulary or bpe.size), np.array([end_id], "<u4").tobytes()
        block, first = 0, 0
        ids, sizes, held, part = [], [], [], None

        def seal() -> pa.RecordBatch:
            nonlocal block, first
            tokens = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum(sizes)
            schema = [part, block, bits, first, len(tokens)]
            out = pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x], t) for x, t in zip(schema, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)),
                    pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                    pa.array([ends.tolist()], pa.list_(pa.int64())),
                    pa.array([pack(tokens, bits)], pa.binary()),
                ],
                ["part", "block", "bits", "first", "n_tokens", "doc_ids", "ends", "payload"],
            )
            block, first = block + 1, first + len(tokens)
            ids.clear(), sizes.clear(), held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            data, offsets = utf8_column(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                encoded = bpe.encode_slice(data, offsets[i : j + 1])
                ids.append(batch.column(0).slice(i, j - i))
                held += [x for e in encoded for x in (e, end)]
                sizes += [(len(e) >> 2) + 1 for e in encoded]
                if sum(sizes) >= BLOCK_TOKENS:
                    yield seal()
        if ids:
            yield seal()

    ordered.mapInArrow(blocks, BLOCKS.format(id=id_type)).write.parquet(f"{out}/blocks")
    totals = spark.read.parquet(f"{out}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # A row per partition of the shuffle above, whatever the number of texts.
    first = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")
    totals.select("part", first.alias("start"), "n_tokens").coalesce(1).write.parquet(f"{out}/parts")


def read_token_files(spark: SparkSession, out: str, where: Column | None = None, ids: list | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, token_ids`` of every text in the files, unpacked.

    ``start`` counts the tokens of all texts before.  ``where`` may choose blocks by ``part``,
    ``block``, ``start`` (of the block) and ``n_tokens``: other payloads are not unpacked.  With ``ids`` only the texts of these
    ids are, each by its own range of bits, whatever else is in its block.
    """
    blocks, parts = spark.read.parquet(f"{out}/blocks"), spark.read.parquet(f"{out}/parts")
    placed = blocks.join(F.broadcast(parts.select("part", F.col("start").alias("__start"))), "part")  # parts: a row per partition
    placed = placed.withColumn("start", F.col("__start") + F.col("first"))
    placed = placed.where(where) if where is not None else placed
    wanted = None if ids is None else frozenset(ids)
    if wanted is not None:
        kind = blocks.schema["doc_ids"].dataType
        placed = placed.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)).cast(kind)) if wanted else F.lit(False))
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, start, n, doc_ids, ends, payload in zip(*(batch.column(k) for k in range(6)), strict=True):
                stops = np.array(ends.values)
                starts = np.concatenate(([0], stops[:-1]))
                if wanted is not None:
                    chosen = [i for i, x in enumerate(doc_ids.as_py()) if x in wanted]
                    texts = pa.array([unpack(payload.as_buffer(), bits.as_py(), int(starts[i]), int(stops[i])).astype("<u4").tobytes() for i in chosen], pa.binary())
                    columns = [doc_ids.values.take(pa.array(chosen, pa.int64())), pa.array(starts[chosen] + start.as_py(), pa.int64()), pa.array((stops - starts)[chosen], pa.int64()), texts]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "token_ids"])
                    continue
                tokens = unpack(payload.as_buffer(), bits.as_py(), 0, n.as_py())
                raw = tokens.astype("<u4").tobytes()
                texts = pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, stops, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(starts + start.as_py(), pa.int64()), pa.array(stops - starts, pa.int64()), texts], ["doc_id", "start", "n_tokens", "token_ids"]
                )

    return placed.select("bits", "start", "n_tokens", "doc_ids", "ends", "payload").mapInArrow(
        read, f"doc_id {id_type}, start long, n_tokens long, token_ids binary"
    )


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str) -> DataFrame:
    """Every document's place, length and checksum as read back from its token files."""
    from caseflow.llm.common import table

    out = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path, out)
    read = read_token_files(spark, out)
    return read.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


