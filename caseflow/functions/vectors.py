"""Vectors and text embeddings as columns."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS, NGRAM = 512, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null without two vectors of a length above zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def char_ngrams(c: Column, n: int = NGRAM) -> Column:
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    last = F.length(padded) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def plain(text: str) -> str:
    """Lower case without accents, everything but letters, digits and spaces as a space."""
    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").lower()
    return re.sub(r"[^a-z0-9 ]+", " ", folded).strip()


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """``plain`` of each text; Unicode decomposition has no built-in function."""
    return texts.map(lambda t: None if t is None else plain(t))


class Places(dict):
    """The place of each token among DIMENSIONS, by a 32-bit BLAKE2b hash that is made once for each."""

    def __missing__(self, token: str) -> int:
        self[token] = place = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "big") % DIMENSIONS
        return place


def embed_text(text: str | None, places: Places | None = None) -> list[float]:
    """Counts of words and character 4-grams by their hashes, scaled to unit length."""
    folded = plain(text or "")
    if not folded:
        return [0.0] * DIMENSIONS
    padded, places = f" {folded} ", Places() if places is None else places
    grams = map("".join, zip(*(padded[k:] for k in range(NGRAM)), strict=False))
    counts = np.bincount([*map(places.__getitem__, folded.split()), *map(places.__getitem__, grams)], minlength=DIMENSIONS)
    return (counts / math.sqrt(int(counts @ counts))).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashing_embedding(texts: pd.Series) -> pd.Series:
    places = Places()
    return texts.map(lambda t: embed_text(t, places))
