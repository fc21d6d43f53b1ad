"""Benchmark decontamination by the q-gram lemma.

An alignment of a benchmark item of m characters with at most k edits keeps at least
m - q + 1 - k * q of the item's q-grams, on diagonals (place in the text less place in the item) that
lie within k of each other. Shared q-grams are counted in diagonal bands that overlap by k, so that
one band holds all of them; bands that reach the bound are kept, and a banded alignment verifies each.
Items so short that the bound would vanish are searched by shorter q-grams; items of fewer than q
characters, which allow no edit, are one q-gram and match where they stand as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import materialize

Q, RATE = 10, 0.08
#: Characters of items in one index, and of texts that are searched at once.
INDEX_CHARS, SLICE_CHARS = 8_000_000, 200_000
_BETWEEN = 0x110000  # stands between texts, is no code point
_BITS = 22


def _fold_table() -> np.ndarray:
    table = np.arange(0x20000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        if c.isspace():
            table[i] = 32
        elif len(low := c.lower()) == 1:
            table[i] = ord(low)
    return table


_FOLD: np.ndarray | None = None


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with white space runs as one space, and their offsets in the text."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _fold_table()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < len(_FOLD), _FOLD[np.minimum(raw, len(_FOLD) - 1)], raw)
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q codes from each place on."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # by doubling: hashes of 1, 2, 4 ... codes, of which those in q are joined
        power, width, done = codes.astype(np.uint64) + np.uint64(1), 1, 0
        factor = base
        while True:
            if q & width:
                out = out * factor + power[done : done + n]
                done += width
            if 2 * width > q:
                break
            power = power[:-width] * factor + power[width:]
            factor *= factor
            width *= 2
        return out ^ (out >> np.uint64(29))


@dataclass
class Index:
    """The q-grams of some items, sorted by hash."""

    ids: list[int | None]
    items: list[np.ndarray]
    edits: np.ndarray  # k of each item
    bound: np.ndarray  # q-grams that a band must share
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    q: int
    words: np.ndarray  # items that are one q-gram and match as whole words

    @staticmethod
    def all(rows: list[tuple[int, str]], q: int, rate: float) -> list[Index]:
        """An index for each length of q-grams that some items need: the longest, ``q`` at most, whose bound is 1 or more."""
        by_q: dict[int, list[tuple[int, str]]] = {}
        for i, text in rows:
            m = len(normalize((text or "").strip())[0])
            if m:
                by_q.setdefault(min(q, m // (int(rate * m) + 1)), []).append((i, text))
        return [Index.build(some, length, rate, q) for length, some in sorted(by_q.items())]

    @staticmethod
    def build(rows: list[tuple[int, str]], q: int, rate: float, most: int = 0) -> Index:
        codes = [normalize((text or "").strip())[0] for _, text in rows]
        m = np.array([len(c) for c in codes], np.int64)
        edits = (rate * m).astype(np.int64)
        grams = [_qgrams(c, q) for c in codes]
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(g), dtype=np.int32) for g in grams]])
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        words = (m == q) & (edits == 0) & (m < most)
        bound = np.where(words, np.iinfo(np.int64).max, m - q + 1 - edits * q)  # no band reaches it
        return Index([i for i, _ in rows], codes, edits, bound, hashes[order], item[order], place[order], bitmap, q, words)

    def whole_words(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, start) of the short items that stand in a text with no letter or digit beside them."""
        if not self.words.any():
            return []
        grams = _qgrams(codes, self.q)
        kinds, of = np.unique(codes, return_inverse=True)
        joined = np.array([c < _BETWEEN and chr(c).isalnum() for c in kinds.tolist()], bool)[of]
        beside = np.concatenate([[False], joined, [False]])
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] & ~beside[: len(grams)] & ~beside[self.q + 1 :][: len(grams)])
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        return [(int(i), p) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True) for i in self.item[a:b] if self.words[i] and (self.items[i] == codes[p : p + self.q]).all()]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that reach their item's bound."""
        grams = _qgrams(codes, self.q)
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, grams[at], "left")
        n = np.searchsorted(self.hashes, grams[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return []
        flat = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item = self.item[flat].astype(np.int64)
        # an item with fewer hits than its bound in the whole slice is out; most hits go here
        enough = np.bincount(item, minlength=len(self.ids)) >= self.bound
        some = enough[item]
        if not some.any():
            return []
        item, diagonal = item[some], (np.repeat(at, n) - self.place[flat])[some]
        k = self.edits[item]
        step = k + 16  # bands begin every ``step`` diagonals and are k wider
        shift = diagonal + 2 * step * (1 + len(codes))  # not negative
        band = shift // step
        also = shift % step < k  # lies in the overlap with the band before
        key = np.concatenate([item * (1 << 40) + band, (item * (1 << 40) + band - 1)[also]])
        keys, count = np.unique(key, return_counts=True)
        of = keys >> 40
        out = []
        for i, b in zip(of[good := count >= self.bound[of]], keys[good] & ((1 << 40) - 1), strict=True):
            width, wide = int(self.edits[i]) + 16, int(self.edits[i])
            first = int(b) * width - 2 * width * (1 + len(codes))
            last = first + width + wide - 1
            if out and out[-1][0] == i and first <= out[-1][2] + 1:
                out[-1] = (int(i), out[-1][1], last)
            else:
                out.append((int(i), first, last))
        return out

    def verify(self, codes: np.ndarray, item: int, first: int, last: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the alignments of an item with text on the diagonals first..last."""
        pattern, k = self.items[item], int(self.edits[item])
        out, todo = [], [(max(0, first - k), min(len(codes), last + k + len(pattern) + 1))]
        while todo:
            at, stop = todo.pop()
            if stop - at < max(1, len(pattern) - k):
                continue
            low, high = max(first, at) - k, min(last, stop - len(pattern)) + k
            found = banded(pattern, codes, low, high, at, stop) if low <= high else None
            if found is None or found[1] > k:
                continue
            end, edits = found
            back = banded(pattern[::-1], codes[at:end][::-1], -k, k, 0, end - at)
            start = max(at, end - (back[0] if back and back[1] <= edits else len(pattern)))
            out.append((start, end, edits))
            todo += [(at, start), (end, stop)]
        return out


def banded(pattern: np.ndarray, codes: np.ndarray, first: int, last: int, at: int, stop: int) -> tuple[int, int] | None:
    """(end, edits) of the best alignment of the whole pattern with a stretch of codes[at:stop].

    Only cells on the diagonals first..last count. The stretch begins anywhere; of equal edits the
    earliest end is best.
    """
    width, big = last - first + 1, 1 << 30
    offsets = np.arange(width)
    begin = first + offsets  # text place before row 0, by diagonal
    row = np.where((begin >= at) & (begin <= stop), 0, big)
    padded = np.full(width, 0xFFFFFFFF, np.uint32)
    for i, c in enumerate(pattern):
        lo, hi = first + i, last + i + 1  # text places that the row compares
        padded[:] = 0xFFFFFFFF
        a, b = max(lo, at), min(hi, stop)
        if a < b:
            padded[a - lo : b - lo] = codes[a:b]
        step = row + (padded != c)  # a text place or a difference: same diagonal
        step[padded == 0xFFFFFFFF] = big
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # the pattern's place is left out: next diagonal
        ends = lo + 1 + offsets
        step[(ends < at) | (ends > stop)] = big
        row = np.minimum(np.minimum.accumulate(step - offsets) + offsets, big)  # text places left out
    if row.min() >= big:
        return None
    best = int(np.argmin(row))
    return first + len(pattern) + best, int(row[best])


def _search(texts: list[tuple[int, str]], index: Index) -> Iterator[tuple[int, int | None, int, int, int]]:
    """(row, item id, start, end, edits) for some texts that are searched together."""
    overlap = max((len(c) for c in index.items), default=0) * 2 + 64
    parts: list[tuple[int, np.ndarray, np.ndarray, bool, bool]] = []
    held = 0

    def flush() -> Iterator[tuple[int, int, int, int, int]]:
        gap = np.full(1 + int(index.edits.max(initial=0)), _BETWEEN, np.uint32)  # no alignment gets across
        codes = np.concatenate([x for _, c, *_ in parts for x in (c, gap)])
        starts = np.cumsum([0, *[len(c) + len(gap) for _, c, *_ in parts]])
        seen = set()
        short = [(item, start, start + index.q, 0) for item, start in index.whole_words(codes)]
        long = ((item, *hit) for item, first, last in index.regions(codes) for hit in index.verify(codes, item, first, last))
        for item, start, end, edits in (hit for hits in (short, long) for hit in hits):
            p = int(np.searchsorted(starts, start, "right")) - 1
            row, own, offsets, before, after = parts[p]
            a, b = start - int(starts[p]), end - int(starts[p])
            if index.words[item] and (before and a == 0 or after and b == len(own)):
                continue  # what stands beside it is in the next slice, which has it too
            if b <= len(own) and (hit := (row, index.ids[item], int(offsets[a]), int(offsets[b - 1]) + 1, edits)) not in seen:
                seen.add(hit)
                yield hit

    for row, text in texts:
        codes, offsets = normalize(text or "")
        for at in range(0, max(1, len(codes)), SLICE_CHARS):
            end = at + SLICE_CHARS + overlap
            parts.append((row, codes[at:end], offsets[at:end], at > 0, end < len(codes)))
            held += len(parts[-1][1])
            if held >= SLICE_CHARS:
                yield from flush()
                parts, held = [], 0
    if parts:
        yield from flush()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE
) -> DataFrame:
    """One row for each passage of a document that is a benchmark item: doc_id, item_id, start, end, edits.

    A passage matches if the item (white space trimmed and folded, lower case) becomes the passage by
    at most rate * length edits; start and end are code points of the original text. An item of fewer than ``q``
    characters has no letter or digit beside it. Blank items and null texts
    match nothing; an item without an id is found like any other, and items that repeat an id and a passage count once.
    Rows are documents of their own, also where they repeat an id, and null document ids pass through. Other columns are ignored, whatever their names.
    The benchmark is indexed in blocks of ``INDEX_CHARS`` characters, each of which is broadcast and
    held against all documents, so that its size has no limit. An empty side gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index.all(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, x.as_py()) for i, x in enumerate(batch.column(1)) if x.is_valid]
                hits = {hit for index in shared.value for hit in _search(rows, index)}
                hits = sorted(hits, key=lambda h: (h[0], h[1] is None, h[1] or 0, h[2:]))
                rows, *rest = zip(*hits, strict=True) if hits else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=["doc_id", "item_id", "start", "end", "edits"]
                )

        return texts.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint")

    out: DataFrame | None = None
    for block, last in _blocks(benchmark, item_col, item_text):
        found = search(block) if last and out is None else materialize(search(block), "passages")
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Blocks of items of about ``INDEX_CHARS`` characters, at least one, and whether it is the last."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").toLocalIterator():
        if size >= INDEX_CHARS:
            yield block, False
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    yield block, True


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE
) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, with all their columns; no shuffle.

    Rows are judged by their text alone, so ids may be null or repeated. Null and empty texts have no passage and stay;
    an empty table gives no rows, and without a benchmark all rows stay.
    """
    place = docs.columns.index(text_col)
    for block, last in _blocks(benchmark, item_col, item_text):
        docs = _without(docs, place, docs.sparkSession.sparkContext.broadcast(Index.all(block, q, rate)))
        if not last:
            docs = materialize(docs, "clean")
    return docs


def _without(docs: DataFrame, place: int, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            rows = [(i, str(x.as_py())) for i, x in enumerate(batch.column(place)) if x.is_valid]
            for hit in (hit for index in shared.value for hit in _search(rows, index)):
                clean[hit[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
