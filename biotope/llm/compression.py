"""Compression classifier: how much better the dictionary of good texts shortens a text than the dictionary of bad ones.

Two zstandard dictionaries are built from labelled texts, one from each class. The feature of a text is
(bytes with the bad dictionary - bytes with the good one) / (bytes of the text + SHORT); a logistic curve fitted on other labelled
texts, with the classes' shares among all labelled rows that may be used, turns it into a calibrated score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, table, texts

#: The bounded sample that the model is fitted on: at most so many labelled rows of each class, of texts of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
#: Bytes added to a text's length, so that a difference of a few bytes says little about a short text.
SHORT = 300
DICTIONARY_BYTES, LEVEL = 1 << 16, 3


def fold(doc_id):
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Model:
    """Two dictionaries and the curve; small, and sent to the workers by value."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0, fitted: int = 0):
        self.good, self.bad, self.slope, self.offset, self.fitted = good, bad, slope, offset, fitted

    def compressors(self):
        def one(raw):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        return one(self.good), one(self.bad)

    def score(self, x: float) -> float:
        """Between 1 / (n + 2) and 1 minus that, where n texts fitted the curve: so many can't show that a chance is nearer to 0 or 1."""
        most = math.log(self.fitted + 1)
        z = max(-most, min(most, self.slope * x + self.offset))
        return 1 / (1 + math.exp(-z))


def difference(text: str, good, bad) -> float:
    """The normalised compressed-size difference; 0 for the empty text."""
    raw = text.encode()
    return (len(bad.compress(raw)) - len(good.compress(raw))) / (len(raw) + SHORT) if raw else 0.0


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b"no labelled text "


def logistic(x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """Slope (not below 0) and offset by Newton's steps, with a weak prior on the slope and the classes weighted to their shares."""
    if len(set(y.tolist())) < 2:
        return 0.0, 0.0 if not len(y) else math.copysign(1.0, y[0] - 0.5)
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum()) / sum(shares)
    b, prior = np.zeros(2), np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b += np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + prior, a.T @ (w * (y - p)) - prior @ b)
    return max(0.0, b[0] / scale), b[1]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled rows outside fold 1. labels: doc_id, quality (0 or 1; other values and nulls are left out).

    At most `rows` documents of each class are taken, in the order of a hash of doc_id; they are all that reaches the driver
    (rows * chars characters a class). Every other one of them builds the dictionaries, the rest the curve. Of rows that repeat a
    doc_id the smallest text counts, and of its labels the larger; null texts and longer ones are left out. Without labels of both classes
    every score is the same.
    """
    allowed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 1)
    short = docs.where(F.length("text") <= chars).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.xxhash64("doc_id")
    n = {r[0]: r[1] for r in allowed.groupBy("quality").count().collect()}
    few = [allowed.where(F.col("quality") == q).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(rows) for q in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # 2 * rows rows at most
    got = sorted(short.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(order.alias("o"), "doc_id", "text", "quality").collect())
    samples: dict[int, list[str]] = {0: [], 1: []}
    for r in got:
        samples[r["quality"]].append(r["text"])
    built = Model(*(dictionary([t.encode() for t in samples[q][::2] if t]) for q in (1, 0)))
    good, bad = built.compressors()
    rest = [(difference(t, good, bad), q) for q in (0, 1) for t in samples[q][1::2]]
    built.slope, built.offset = logistic(np.array([x for x, _ in rest], float), np.array([q for _, q in rest], float), (n.get(0, 0), n.get(1, 0)))
    built.fitted = len(rest)
    return built


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; higher: likelier good).

    docs: doc_id, text. A row for every row, equal ones too; null and empty texts have the score of a difference of 0; a null doc_id
    stays null. Texts are compressed whole. Other columns are not read. An empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def run(batches):
        good, bad = model.compressors()
        for b in sliced(batches):
            yield table({"doc_id": b.column("doc_id"), "score": [model.score(difference(t, good, bad)) for t in b.column("text").to_pylist()]}, SCORED)

    return texts(docs).mapInArrow(run, "doc_id long, score double")
