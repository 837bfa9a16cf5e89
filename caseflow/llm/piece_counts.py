"""Token counts by heap-and-linked-list byte-pair merging.

The characters of a word are linked in a list; the adjacent pair of the lowest rank (leftmost of
equals) is popped from a heap and merged until no pair is left.  The count is the number of
symbols at the start minus the merges; no identifier is made.  A character that no piece knows
counts as its UTF-8 bytes (byte fallback).

No piece holds a space behind another character, so a word with the spaces before it can
be counted on its own, and a worker remembers the counts of short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import slices
from caseflow.llm.merging import SHIFT, heap_merges

SPACE = "▁"  # fixed value: how the model writes a space
REMEMBERED, LONGEST = 700_000, 64


class PieceCounter(dict):
    """Ranks of one model file, and the counts of words seen before."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[str, float] = {}
        self.fallback = False
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.fallback = True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in piece.lstrip(SPACE) for piece in score):
            raise ValueError("a piece holds a space behind another character; words can't be counted apart")
        symbol = {c: i for i, c in enumerate(dict.fromkeys([*score, *(c for piece in score for c in piece)]))}
        self.char = {c: i for c, i in symbol.items() if len(c) == 1}
        self.known = {c for c in self.char if c in score}
        merged = [x for x in score if len(x) > 1]  # no merge makes a single character
        order = {s: r for r, s in enumerate(sorted({score[x] for x in merged}, reverse=True))}
        #: Rank of a pair of symbols (runs of spaces share one), and what the merge makes.
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for piece in merged:
            for k in range(1, len(piece)):
                if piece[:k] in symbol and piece[k:] in symbol:
                    pair = symbol[piece[:k]] << SHIFT | symbol[piece[k:]]
                    self.rank[pair], self.made[pair] = order[score[piece]], symbol[piece]
        probe = "  ﬁ  a\n"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that keep texts as they are, with a space before, can be counted")

    def __missing__(self, word: str) -> int:
        n = self.count_word(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count_word(self, word: str) -> int:
        char, extra = self.char, 0
        if not self.known.issuperset(word):
            extra = sum(len(c.encode("utf-8", "replace")) - 1 for c in word if c not in self.known) if self.fallback else 0
        unknown = (1 << SHIFT) - 1
        symbols = [char.get(c, unknown) for c in word]
        return len(symbols) + extra - heap_merges(symbols, self.rank, self.made)

    def count(self, text: str) -> int:
        """Tokens of a whole text, without begin or end tokens."""
        if not text:
            return 0
        return sum(map(self.__getitem__, WORD.findall(SPACE + text.replace(" ", SPACE))))


#: Spaces and the characters behind them up to the next space.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids stay as they are;
    other columns are left out.  No shuffle; memory is bounded by a slice of 1 MB of text (or
    one longer text) and the remembered words.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            column = batch.column(1).fill_null("")
            sizes = np.array(pa.compute.binary_length(column), np.int64)
            for i, j in slices(np.concatenate(([0], np.cumsum(sizes)))):
                counts = [pieces.count(x) for x in column.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes[i:j]), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return narrow.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
