"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features and those of its two neighbours score its label, and a
2 x 2 table scores the labels of neighbouring lines; forward-backward gives each line's probability
of being good, and their mean, weighted by length in bytes, is the document's quality.  A
logistic curve, fitted on the same sample, turns it into the probability of a good label.

The field is fitted on the driver on a bounded sample of labelled documents (MOST_DOCUMENTS, the smallest
hashes of their ids, and a window of MOST_LINES consecutive lines of longer ones); only numbers per
line are gathered for it.  Lines start with their document's label; after a first fit, lines of bad
documents that look good are relabelled once, since a bad document may hold good lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import utf8_column

MOST_DOCUMENTS, MOST_LINES = 3_000, 100
ROUNDS, RATE, PENALTY = 100, 0.2, 1e-4
NAMES = ("one", "length", "upper", "digits", "symbols", "blanks", "triples", "shouts", "bars", "distinct", "repeated", "word_length", "same_line", "stops")
WIDTH = len(NAMES)

KIND = np.zeros(256, np.uint8)  # 1 letter, 2 upper case, 3 digit, 4 blank, 5 symbol
KIND[128:] = 1
for _first, _last, _kind in ((0x21, 0x7E, 5), (0x61, 0x7A, 1), (0x41, 0x5A, 2), (0x30, 0x39, 3)):
    KIND[_first : _last + 1] = _kind
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers between 0 and about 1 for each line that is not blank, and the lines' lengths."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    data = np.frombuffer(b"\n".join(lines), np.uint8)
    length = np.array([len(x) for x in lines])
    starts = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    kind = KIND[data]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] == 5)
    triple = np.zeros(len(data), bool)
    triple[2:] = same[2:] & same[1:-1]
    share = lambda flags: np.add.reduceat(flags.astype(np.float32), starts) / length
    out = np.empty((len(lines), WIDTH), np.float32)
    letters = np.maximum(share((kind == 1) | (kind == 2)), 1e-6)
    out[:, 0] = 1
    out[:, 1] = np.log1p(length) / 8
    out[:, 2] = np.minimum(share(kind == 2) / letters, 1)
    out[:, 3] = share(kind == 3)
    out[:, 4] = np.minimum(4 * share(kind == 5), 2)
    out[:, 5] = share(kind == 4)
    out[:, 6] = np.minimum(8 * share(triple), 2)
    out[:, 7] = np.minimum(8 * share(same & (data == 0x21)), 2)
    out[:, 8] = np.minimum(16 * share(data == 0x7C), 2)
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    for i, x in enumerate(lines):
        words = x.split()
        n = len(words)
        out[i, 9] = len(set(words)) / n
        out[i, 10] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[i, 11] = min((len(x) - n) / n / 10, 2)
        out[i, 12] = seen[x] > 1 and n > 3
        out[i, 13] = min(2 * sum(w[-1] in b".,;:" for w in words) / n, 2)
    return out, length.astype(np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features, the line before's and the line after's (zeros at the ends)."""
    none = np.zeros((min(1, len(x)), x.shape[1]), x.dtype)
    return np.concatenate((x, np.concatenate((none, x[:-1])), np.concatenate((x[1:], none))), axis=1)


def chains(unary: np.ndarray, pair: np.ndarray, lengths: np.ndarray, importance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line (n x 2), expected counts of neighbouring labels, and the log partition sum.

    ``unary``: scores of both labels of all lines, document after document; all chains step together.
    ``importance`` weighs each document's counts and its log partition sum.
    """
    order = np.argsort(-lengths, kind="stable")
    weight = np.ones(len(lengths)) if importance is None else importance[order]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    long = lengths[order]
    alive = [int(np.searchsorted(-long, -t, side="left")) for t in range(int(long[0]) if len(long) else 0)]
    forward, scale = np.empty_like(unary), np.empty(len(unary))
    table, top = np.exp(pair), unary.max(1)
    local = np.exp(unary - top[:, None])
    for t, k in enumerate(alive):
        at = starts[:k] + t
        a = local[at] if t == 0 else (forward[at - 1] @ table) * local[at]
        scale[at] = a.sum(1)
        forward[at] = a / scale[at][:, None]
    backward, expected = np.ones_like(unary), np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        follow = local[at] * backward[at] / scale[at][:, None]
        expected += table * ((forward[at - 1] * weight[: alive[t], None]).T @ follow)
        backward[at - 1] = follow @ table.T
    of_line = np.repeat(np.ones(len(lengths)) if importance is None else importance, lengths)
    return forward * backward, expected, float(of_line @ (np.log(scale) + top))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Field:
    """Weights of the field: per feature for the label good, and the table of neighbouring labels."""

    def __init__(self, weights: np.ndarray | None = None, pair: np.ndarray | None = None, curve: tuple[float, float] = (1.0, 0.0)):
        self.weights = np.zeros(3 * WIDTH) if weights is None else weights
        self.pair = np.zeros((2, 2)) if pair is None else pair
        self.curve = curve

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each line to be good."""
        if not len(x):
            return np.zeros(0)
        score = x @ self.weights
        return chains(np.stack((-score / 2, score / 2), 1), self.pair, lengths)[0][:, 1]

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, importance: np.ndarray) -> None:
        """Maximum likelihood by Adam; ``importance`` weighs documents, whose labels are rarely balanced."""
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        inner = np.ones(len(y), bool)
        inner[bounds[:-1]] = False
        seen = np.zeros((2, 2))
        line_weight = np.repeat(importance, lengths)
        np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), line_weight[inner])
        n = line_weight.sum()
        theta = np.concatenate((self.weights, self.pair.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1):
            score = x @ theta[:-4]
            marginal, expected, _ = chains(np.stack((-score / 2, score / 2), 1), theta[-4:].reshape(2, 2), lengths, importance)
            slope = np.concatenate((x.T @ ((y - marginal[:, 1]) * line_weight), (seen - expected).ravel())) / n - PENALTY * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.pair = theta[:-4], theta[-4:].reshape(2, 2)

    def calibrate(self, quality: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the logistic curve, both labels weighing the same (Newton's method, with a small penalty)."""
        z = np.stack((logit(quality), np.ones(len(y))), 1)
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
        theta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ theta))
            slope = z.T @ (weight * (y - p)) - 1e-3 * (theta - [1.0, 0.0])
            bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
            theta = theta + np.linalg.solve(bend, slope)
        self.curve = (float(theta[0]), float(theta[1]))

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted means of the lines' marginals; 0 for texts without lines."""
        lengths = np.array([len(size) for _, size in texts], np.int64)
        out = np.zeros(len(texts))
        some = lengths > 0
        if some.any():
            x = np.concatenate([with_neighbours(f) for f, size in texts if len(size)]).astype(np.float64)
            good = self.marginals(x, lengths[some])
            size = np.concatenate([size for _, size in texts if len(size)])
            at = np.concatenate(([0], np.cumsum(lengths[some])[:-1]))
            quality = np.add.reduceat(good * size, at) / np.add.reduceat(size, at)
            out[some] = 1 / (1 + np.exp(-(self.curve[0] * logit(quality) + self.curve[1])))
        return out


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on labelled documents that are not held out; untrained (all scores 0.5) without both labels.

    Labels of one id that differ, and null ids, labels or texts, are not learnt from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id"))
    known = known.agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other").select("__id", "y")
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(MOST_DOCUMENTS)  # MOST_DOCUMENTS rows bound what is broadcast

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(0))
            rows = []
            for i in range(batch.num_rows):
                x, _ = features(data[offsets[i] : offsets[i + 1]].tobytes())
                x = with_neighbours(x)
                if len(x) > MOST_LINES:
                    start = int(offsets[i + 1] - offsets[i]) % (len(x) - MOST_LINES + 1)
                    x = x[start : start + MOST_LINES]
                rows.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["id", "y", "x"])

    labelled = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    got = labelled.select("text", F.col("__id").cast("string").alias("id"), F.col("y").cast("int").alias("y")).mapInArrow(lines, "id string, y int, x binary").toPandas()
    got = got[got["x"].str.len() > 0].drop_duplicates("id").sort_values("id")
    field = Field()
    if got["y"].nunique() < 2:
        return field
    parts = [np.frombuffer(b, "<f4").reshape(-1, 3 * WIDTH) for b in got["x"]]
    lengths, doc_y = np.array([len(p) for p in parts]), got["y"].to_numpy()
    x, y = np.concatenate(parts).astype(np.float64), np.repeat(doc_y, lengths)
    share = doc_y.mean()
    importance = np.where(doc_y == 1, 0.5 / share, 0.5 / (1 - share)) / lengths
    field.fit(x, y, lengths, importance)
    good = field.marginals(x, lengths)
    worst = np.repeat(np.minimum.reduceat(good, np.concatenate(([0], np.cumsum(lengths)[:-1]))), lengths)
    y = np.where((np.repeat(doc_y, lengths) == 0) & (good > 0.5) & (good > worst), 1, y)
    field.fit(x, y, lengths, importance)
    size, at = np.expm1(8 * x[:, 1]), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    field.calibrate(np.add.reduceat(field.marginals(x, lengths) * size, at) / np.add.reduceat(size, at), doc_y)
    return field


def score_documents(docs: DataFrame, field: Field, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All rows with ``quality_score`` (0 to 1) and ``quality_good`` (score at least ``threshold``).

    Nulls, empty and blank texts score 0.  Only the text is read for a score; repeated rows score
    alike; an empty table gives an empty one; existing columns of these names are replaced.  No shuffle; a batch is scored
    in steps of about 2 MB, or of one longer text, which is taken whole.
    """
    docs = docs.drop("quality_score", "quality_good")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_good", T.BooleanType())])
    weights, pair, curve = field.weights, field.pair, field.curve

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights, pair, curve)
        for batch in batches:
            data, offsets = utf8_column(batch.column(at))
            scores, held, size = [], [], 0
            for i in range(batch.num_rows):
                held.append(features(data[offsets[i] : offsets[i + 1]].tobytes()))
                size += offsets[i + 1] - offsets[i]
                if size > 2 << 20 or i == batch.num_rows - 1:
                    scores.append(model.score(held))
                    held, size = [], 0
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array(values >= threshold)], names=[*batch.schema.names, "quality_score", "quality_good"])

    return docs.mapInArrow(score, schema)


def op4_line_quality(spark, sf_dir):
    """Quality of every document."""
    from caseflow.llm.common import table

    docs = table(spark, sf_dir, "documents")
    field = fit_field(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_good").cast("int").alias("predicted"))
