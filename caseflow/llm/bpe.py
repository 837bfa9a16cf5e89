"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that stands in no vocabulary token can never be merged across, so it
marks a certain cut.  Texts are cut at all such pairs at once by a table of 65,536 flags; every
fragment is encoded on its own (each distinct one once per worker, while it is remembered) and
the identifiers are concatenated.

The tokenizer also splits a text into words by a pattern before it merges.  A cut is taken only
where that pattern, applied to the two sides apart, finds the words it finds in the whole text:
behind a character that is no white space (only white space looks ahead), at the start of a
character, and not before an apostrophe unless an ASCII letter or digit stands there (an apostrophe
starts a contraction at the start of a fragment, but not inside a run of punctuation).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import binary_array, slices, utf8_column
from caseflow.llm.merging import SHIFT, merge_long, merge_short

#: Fixed value: the published word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct fragments that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 500_000, 96
PLAIN_START = frozenset(b" ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SEPARATOR = 0xFF  # stands in no UTF-8 text


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Merges, token bytes, cut table and memory of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.size = max(*self.ids.values(), *self.special.values()) + 1
        #: The rank of a pair of identifiers, and the identifier that its merge makes.
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            both = self.ids[left] << SHIFT | self.ids[right]
            self.rank[both], self.made[both] = i, self.ids[left + right]
        self.single = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.bytes_of[i] = token
        self.apart = np.ones((256, 256), bool)
        for token in self.ids:
            for a, b in zip(token, token[1:], strict=False):
                self.apart[a, b] = False
        self.cuts = self._cut_table()
        self.specials = regex.compile(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(WORDS)
        self.memory = Memory(self._fragment)

    def _cut_table(self) -> np.ndarray:
        left = np.zeros(256, bool)
        left[0x21:0x7F] = True
        left[0x80:0xC0] = True
        for b in (*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF):
            left[b] = False  # last bytes of white space beyond ASCII
        right = np.ones(256, bool)
        right[0x80:0xC0] = False
        table = self.apart & left[:, None] & right[None, :]
        word = np.zeros(256, bool)
        for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            word[lo:hi] = True
        table[~word, 0x27] = False
        return table.reshape(-1)

    def _fragment(self, fragment: bytes) -> bytes:
        if fragment[1:].isalpha() and fragment[0] in PLAIN_START:  # one word of ASCII letters
            return little_endian(self.merge(fragment))
        out: list[int] = []
        for word in self.pattern.findall(fragment.decode("utf-8", "replace")):
            out += self.merge(word.encode())
        return little_endian(out)

    def merge(self, word: bytes) -> list[int]:
        """Identifiers of one word: cut at forced boundaries, then merged pair by pair."""
        symbols = [self.single[b] for b in word]
        if len(symbols) <= 48:  # too few for inner cuts to save anything: no rank stands across one
            return merge_short(symbols, self.rank, self.made)
        out: list[int] = []
        start = 0
        for i in range(1, len(word) + 1):
            if i == len(word) or self.apart[word[i - 1], word[i]]:
                out += merge_long(symbols[start:i], self.rank, self.made)
                start = i
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Identifiers (little-endian unsigned 32-bit) of the texts that lie back to back in ``data``."""
        return encode_back_to_back(data, offsets, self.cuts, self.memory, self.specials, self._around_specials)

    def _around_specials(self, text: bytes) -> bytes:
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._whole(text[at : m.start()]), little_endian([self.special[m.group()]])]
            at = m.end()
        return b"".join([*out, self._whole(text[at:])])

    def _whole(self, text: bytes) -> bytes:
        return encode_back_to_back(np.frombuffer(text, np.uint8), np.array([0, len(text)]), self.cuts, self.memory, None, None)[0]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """Remembers what short fragments encode to; forgets all when it is full."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        out = self.encode(fragment)
        if len(fragment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = out
        return out


def encode_back_to_back(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, memory: dict, specials, around) -> list[bytes]:
    """Cuts all texts at once, looks their fragments up, and joins them text by text."""
    base, end = int(offsets[0]), int(offsets[-1])
    n = len(offsets) - 1
    if end == base:
        return [b""] * n
    here, bounds = data[base:end], offsets - base
    pairs = (here[:-1].astype(np.uint16) << 8) | here[1:]
    flags = np.zeros(len(here) + 1, bool)
    flags[1:-1] = cuts[pairs]
    flags[bounds[(bounds > 0) & (bounds < len(here))]] = True
    at = np.flatnonzero(flags)
    fragments = np.insert(here, at, SEPARATOR).tobytes().split(bytes([SEPARATOR]))
    firsts = np.searchsorted(at, bounds[:-1], side="left") + (bounds[:-1] > 0)
    lasts = np.searchsorted(at, bounds[1:], side="left") + 1
    lookup = memory.__getitem__
    result = []
    found = set()
    if specials is not None:
        for m in specials.finditer(here.tobytes()):
            found.add(int(np.searchsorted(bounds, m.start(), side="right")) - 1)
    for i in range(n):
        if bounds[i] == bounds[i + 1]:
            result.append(b"")
        elif i in found:
            result.append(around(here[bounds[i] : bounds[i + 1]].tobytes()))
        else:
            result.append(b"".join(map(lookup, fragments[firsts[i] : lasts[i]])))
    return result


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """``doc_id, n_tokens, token_ids`` of every whole text; ``token_ids``: little-endian unsigned 32-bit.

    With ``round_trip`` also ``decoded``, the text that the identifiers decode to, made in the same
    workers.  Nulls and empty texts have no tokens; repeated rows and null ids stay as they are; other
    columns are left out, so none can clash.  No shuffle; memory is bounded by a slice of
    1 MB of text (or one longer text) and the remembered fragments.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for i, j in slices(offsets):
                ids = bpe.encode_slice(data, offsets[i : j + 1])
                columns = [batch.column(0).slice(i, j - i), pa.array([len(x) >> 2 for x in ids], pa.int64()), binary_array(ids)]
                names = ["doc_id", "n_tokens", "token_ids"]
                if round_trip:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(encode, f"doc_id {id_type}, n_tokens long, token_ids binary" + ", decoded string" * round_trip)


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``token_ids``, special tokens included, to ``doc_id, n_tokens, token_ids``."""
    narrow = tokens.select("doc_id", "n_tokens", "token_ids")
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            sizes = np.array([len(x.as_py() or b"") if x.is_valid else 0 for x in batch.column(2)], np.int64)
            for i, j in slices(np.concatenate(([0], np.cumsum(sizes)))):
                part = batch.slice(i, j - i)
                texts = [bpe.decode(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded"])

    return narrow.mapInArrow(decode, f"doc_id {id_type}, n_tokens long, token_ids binary, decoded string")
