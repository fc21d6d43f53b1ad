"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A window of a text is
compressed with the ordinary dictionary, and again with both one after the other; what the toxic
dictionary saves is the window's distance. Counts of windows over several thresholds of the distance
are calibrated by logistic regression on labelled texts that no dictionary has seen.

What toxic texts say as ordinary ones do teaches a dictionary nothing and makes distances noisy. So the
toxic dictionary is trained on the words of toxic texts that ordinary texts use significantly less.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import pieces, sample_texts

#: Labelled rows of each class that the fit reads at most, and their bytes.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2500, 3500, 24_000_000
WINDOW, LEVEL = 40, 3
ORDINARY_DICT, TOXIC_DICT, SEGMENT = 32768, 4096, 32
TOP = 10  # the highest threshold of a distance, in bytes
#: Bytes of a text that are cut into windows at once, about.
CHUNK = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_WINDOW = re.compile(rb" \S(?:.{0,%d}\S)?\S* " % (WINDOW - 3))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall(text.decode("utf-8", "replace").lower().encode())


def windows(words: list[bytes]) -> list[bytes]:
    """Stretches of about ``WINDOW`` bytes, cut between words, with a space on either side.

    Each next window begins at the space that ends the one before, so every word is in one.
    """
    line = b"  ".join(words)
    return _WINDOW.findall(b" " + line + b" ")


def all_windows(text: bytes) -> Iterator[list[bytes]]:
    """The windows of a whole text, some at once.

    The last window of a piece may go on in the next one, where it is cut anew.
    """
    rest: list[bytes] = []
    for part in pieces(text, CHUNK):
        some = windows(rest + words_of(text[part]))
        rest = some.pop().split() if some else []
        yield some
    yield windows(rest)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors, which can't travel between processes."""

    def __init__(self, model: Model):
        self.model = model
        self.plain, self.both = (_compressor(x) for x in (model.ordinary, model.ordinary + model.toxic))

    def distances(self, text: bytes) -> np.ndarray:
        """What the toxic dictionary saves in each window, as a histogram of 0..TOP bytes."""
        out = np.zeros(TOP + 1, np.int64)
        for some in all_windows(text):
            saved = [len(a) - len(b) for a, b in zip(map(self.plain, some), map(self.both, some), strict=True)]
            out += np.bincount(np.clip(np.array(saved, np.int64), 0, TOP), minlength=TOP + 1)
        return out

    def features(self, text: bytes) -> np.ndarray:
        seen = self.distances(text)
        over = np.cumsum(seen[::-1])[::-1][1:]  # windows that save at least 1, 2, ... bytes
        highest = np.flatnonzero(seen).max(initial=0)
        return np.concatenate([np.log1p(over), over / max(1, seen.sum()), [highest]])

    def score(self, text: bytes | None) -> float:
        return float(_odds(self.features(text or b"")[None], self.model)[0])


def _compressor(content: bytes):
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False).compress


def _odds(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.c_[(x - model.mean) / model.spread, np.ones(len(x))] @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most ``size`` bytes; where there is too little to train on, the samples."""
    samples = [s for s in samples if s]
    if sum(map(len, samples)) < 4 * size or len(samples) < 64:
        return b"".join(dict.fromkeys(samples))[:size]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _distinctive(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float = 4.0) -> set[bytes]:
    """Words in so many toxic texts that chance explains it by ``least`` standard deviations or more."""
    count = lambda texts: Counter(w for t in texts for w in set(t))
    of_toxic, of_ordinary = count(toxic), count(ordinary)
    out = set()
    for w, n in of_toxic.items():
        expected = (of_ordinary[w] + 0.5) / (len(ordinary) + 1) * len(toxic)
        if n >= 3 and (n - expected) / (expected + 0.5) ** 0.5 >= least:
            out.add(w)
    return out


def fit(texts: list[bytes], toxic: np.ndarray, share: float | None = None) -> Model:
    """Fit on labelled texts. ``share`` is the share of toxic texts where the sample was drawn from."""
    first = {}
    for t, y in zip(texts, toxic, strict=True):  # copies teach nothing more
        first.setdefault(t, int(y))
    part = np.array([zlib.crc32(t) >> 7 & 1 for t in first], bool)
    y = np.array(list(first.values()), np.int64)
    said = [words_of(t) for t in first]
    pick = lambda k, c: [said[i] for i in np.flatnonzero((part == k) & (y == c))]
    bad, good = pick(True, 1), pick(True, 0)
    special = _distinctive(bad, good)
    ordinary = _train(ORDINARY_DICT, [w for t in good for w in windows(t)])
    marked = [w for t in bad for w in windows([x for x in t if x in special])]
    model = Model(ordinary, _train(TOXIC_DICT, marked), np.zeros(2 * TOP + 1), np.ones(2 * TOP + 1), np.zeros(2 * TOP + 2))
    base = share if share is not None else float(y.mean()) if len(y) else 0.5
    base = min(max(base, 0.01), 0.99)
    model.weights[-1] = np.log(base / (1 - base))
    rest = [i for i, t in enumerate(first) if not part[i]]
    if len({int(y[i]) for i in rest}) < 2:
        return model
    scorer, keys = model.scorer(), list(first)
    x, target = np.array([scorer.features(keys[i]) for i in rest]), y[rest].astype(float)
    weight = np.where(target == 1, base / target.mean(), (1 - base) / (1 - target.mean()))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-2
    z = np.c_[(x - model.mean) / model.spread, np.ones(len(x))]
    w, ridge = model.weights.copy(), np.r_[np.ones(z.shape[1] - 1), 0.0]

    def cost(w: np.ndarray) -> float:
        side = np.where(target == 1, 1, -1) * (z @ w)
        return float((weight * np.logaddexp(0, -side)).sum() + (ridge * w * w).sum() / 2)

    for _ in range(100):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (weight * (p - target)) + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-6 * np.eye(len(w))
        step, now = np.linalg.solve(curve, slope), cost(w)
        while np.abs(step).max() > 1e-7 and cost(w - step) > now:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-7:
            break
    model.weights = w
    return model


def is_held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[bytes], np.ndarray, float | None]:
    """Bounded sample of the rows that may be learned from, and the share of toxic ones among them all."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros(0, np.int64), None
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_ORDINARY))
    pairs = sample_texts(docs, some.withColumnRenamed("toxic", "label"), id_col, text_col, SAMPLE_BYTES)
    return [t for t, _ in pairs], np.array([y for _, y in pairs], np.int64), counts.get(1, 0) / sum(counts.values())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic (0 or 1, other values are left out; if an id has both, it is
    toxic). Only rows with crc32(id as text) mod 5 other than 0 are learned from, a bounded sample of
    them, in which rows that repeat an id stand for one text. Scores come from whole texts alone; null
    and empty texts have the score of a text without windows. Without labels every score is 0.5. A null
    id isn't held out. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = fit(*sample_labelled(docs, labels, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = [scorer.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scored = picked.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
