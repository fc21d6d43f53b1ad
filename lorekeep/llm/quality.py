"""Quality classification by ordinal cumulative-link regression on graded ratings.

Grades 0..G are ordered. A text has one real score, the mean of weights of its hashed character n-grams
and words, shared by all grades, and P(grade >= g) = sigmoid(score - threshold_g) with ordered thresholds.
The expected grade is the sum of these tail probabilities, and a tail probability decides selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import pieces, sample_texts

BUCKETS = 1 << 15
#: Rated documents that the fit reads at most, and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 24_000_000
#: Bytes of a text that are looked at at once, about.
CHUNK = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: kinds of letters, digits and white space; each punctuation mark its own."""
    out = np.arange(256, dtype=np.uint32)
    out[48:58], out[65:91], out[97:123], out[128:192], out[192:] = 48, 65, 97, 97, 97
    out[[9, 11, 12, 13, 32]] = 32
    return out


_CLASS = _classes()
_SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())
#: How much the groups of features count: what letters a text has says little of how good it is.
GROUPS = (0.2, 1.0, 1.0, 1.0, 2.0)
#: Half of the evidence that short texts need to speak for themselves.
PRIOR = 64


def features(text: bytes, before: bytes = b"", last: bytes = b"") -> list[np.ndarray]:
    """Groups of hashed features, which count by their frequency in the group.

    Byte 3-grams; 1-, 2- and 3-grams of byte classes; and for each word whether it repeats the word
    before, or repeats none. Where the text is a piece of another, ``before`` has the two bytes before it,
    which belong to n-grams that end in it, and ``last`` the word before.
    """
    raw = np.frombuffer(before + text, np.uint8).astype(np.uint32)
    kind = _CLASS[raw]

    def gram(x: np.ndarray, n: int, salt: int) -> np.ndarray:
        x = x[max(0, len(before) - n + 1) :]
        if len(x) < n:
            return np.zeros(0, np.uint32)
        return sum((x[i : len(x) - n + 1 + i] << np.uint32(8 * i) for i in range(n)), np.uint32(salt)) * np.uint32(2654435761) >> _SHIFT

    words = text.lower().split()
    again = np.fromiter(map(eq, words, [last, *words]), np.uint32, len(words))
    return [gram(raw, 3, 0), gram(kind, 1, 11 << 24), gram(kind, 2, 12 << 24), gram(kind, 3, 13 << 24), (again + np.uint32(14 << 24)) * np.uint32(2654435761) >> _SHIFT]


def score_text(text: bytes | None, weights: np.ndarray) -> float:
    """The sum over groups of the mean weight of their features, drawn to 0 by ``PRIOR`` for short texts.

    Whole texts count; they are looked at in pieces, which know what stood before them. No text scores 0.
    """
    total, n, last = np.zeros(5), np.zeros(5), b""
    for part in pieces(text or b"", CHUNK):
        for i, got in enumerate(features(text[part], text[max(0, part.start - 2) : part.start], last)):
            total[i] += float(weights[got].sum())
            n[i] += len(got)
        last = (text[part].lower().rsplit(None, 1) or [last])[-1]
    return float((total / (n + PRIOR) * GROUPS).sum())


class OrdinalModel:
    """Weights over hashed features and the thresholds of grades 1..G."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1..G, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))


def fit(texts: list[bytes], grades: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood by Adam steps over all rows; deterministic.

    Features are frequencies, scaled by their spread over the sample. Thresholds stay in order, since
    each is the one before plus an exponential.
    """
    top = int(grades.max(initial=1))
    docs, cols, values = [], [], []
    for i, text in enumerate(texts):
        for group, much in zip(features(text), GROUPS, strict=True):
            got, n = np.unique(group, return_counts=True)
            docs.append(np.full(len(got), i))
            cols.append(got)
            values.append(much * n / (PRIOR + len(group)))
    row, col, value = np.concatenate(docs), np.concatenate(cols).astype(np.int64), np.concatenate(values)
    count = max(1, len(texts))
    mean = np.bincount(col, value, BUCKETS) / count
    spread = np.sqrt(np.maximum(np.bincount(col, value**2, BUCKETS) / count - mean**2, 0))
    scale = 1 / (spread + 0.01)
    value = value * scale[col]
    base = np.array([np.clip((grades >= g).mean(), 0.01, 0.99) for g in range(1, top + 1)])
    cuts = np.log((1 - base) / base)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    params = np.concatenate([np.zeros(BUCKETS), cuts[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, theta = params[:BUCKETS], np.cumsum(np.r_[params[BUCKETS], np.exp(params[BUCKETS + 1 :])])
        score = np.bincount(row, value * w[col], len(texts))
        tail = 1 / (1 + np.exp(np.clip(theta - score[:, None], -40, 40)))
        full = np.hstack([np.ones((len(texts), 1)), tail, np.zeros((len(texts), 1))])
        p = np.maximum(full[np.arange(len(texts)), grades] - full[np.arange(len(texts)), grades + 1], 1e-9)
        slope = tail * (1 - tail)
        # d log p / d score, and / d threshold_g
        upper = np.where(grades[:, None] == np.arange(top), slope, 0)  # the tail that ends the grade
        lower = np.where(grades[:, None] == np.arange(1, top + 1), slope, 0)  # the tail that begins it
        by_score = (lower.sum(1) - upper.sum(1)) / p
        by_cut = ((upper - lower) / p[:, None]).sum(0) / count
        gw = np.bincount(col, value * by_score[row], BUCKETS) / count - decay * w
        late = np.cumsum(by_cut[::-1])[::-1]
        grad = -np.concatenate([gw, late[:1], late[1:] * np.exp(params[BUCKETS + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * np.r_[np.full(BUCKETS, 0.1), np.ones(top)]
    return OrdinalModel(params[:BUCKETS] * scale, np.cumsum(np.r_[params[BUCKETS], np.exp(params[BUCKETS + 1 :])]))


def sample_rated(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` rated texts and ``most_bytes`` bytes of them, the first by a hash of the id.

    ``ratings`` has the columns doc_id and grade; null ids and grades are left out, and of several
    grades of an id the lowest counts. Rows that repeat an id stand for one text.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("label"))
    pairs = sample_texts(docs, rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), id_col, text_col, most_bytes)
    return [t for t, _ in pairs], np.array([g for _, g in pairs], np.int64)


def fit_ratings(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int = 1) -> OrdinalModel:
    """The model of the rated documents; it has a threshold for each grade up to ``tail`` at least."""
    texts, grades = sample_rated(docs, ratings, id_col, text_col)
    top = max(tail, int(grades.max(initial=1)))
    model = fit(texts, grades) if texts else OrdinalModel(np.zeros(BUCKETS), np.zeros(top))
    if len(model.thresholds) < top:
        model.thresholds = np.r_[model.thresholds, np.full(top - len(model.thresholds), 40.0)]
    return model


def grade(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int = 1, least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability, kept.

    tail_probability is P(grade >= ``tail``), and documents with at least ``least`` are kept. The fit
    reads a bounded sample of rated texts (``SAMPLE_ROWS``, ``SAMPLE_BYTES``); every document is
    scored whole. Without ratings, all that can be said of a text is even odds, and it is kept. Null
    and empty texts score by the thresholds alone. Null and repeated ids pass through, an empty table
    gives no rows, and other columns are ignored, whatever their names.
    """
    model = fit_ratings(docs, ratings, id_col, text_col, tail)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            scores = np.array([score_text(x, weights) for x in batch.column(1).to_pylist()])
            tails = OrdinalModel(weights, thresholds).tails(scores)
            p = tails[:, tail - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= least)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`grade` keeps, with all their columns; no shuffle.

    Rows are judged by their text alone, so ids may be null or repeated. Null and empty texts have the score of a text without
    features and stay or go all alike. Without ratings the model is the one that :func:`grade` has then; an empty table gives no rows.
    """
    model = fit_ratings(docs, ratings, id_col, text_col, tail)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            scores = np.array([score_text(x, weights) for x in texts])
            yield batch.filter(pa.array(OrdinalModel(weights, thresholds).tails(scores)[:, tail - 1] >= least))

    return docs.mapInArrow(run, docs.schema)


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings (doc_id, grade) from quality and toxic marks: 0 bad, 1 good but toxic, 2 good."""
    good, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(toxic == 1, 1).when(good == 1, 2).alias("grade"))
