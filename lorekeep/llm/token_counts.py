"""Token counts of a unigram tokenizer, by dynamic programming that a trie shares.

The best segmentation of a pre-token under a unigram model is found from left to right: the score of a
prefix needs the scores of shorter prefixes only. Pre-tokens with the same beginning therefore share
these scores. Distinct pre-tokens are inserted in a trie, every node gets the forward score and token
count of its prefix, computed once, and the count of a pre-token is stored at its terminal node. The nodes
of one depth are computed together: sorted pre-tokens show where their prefixes part, and each node carries
on the pieces that its parent left open.

The pieces are those of a public byte-level vocabulary, given by path. It has merge ranks and no
probabilities; a piece of rank r gets the Zipf probability proportional to 1 / (r + 1).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that the vocabulary was published with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts whose new pre-tokens make one trie, about, and the counts that a task remembers.
TRIE_CHARS, MOST_CHUNKS = 4_000_000, 400_000
#: Longer pre-tokens make a trie of their own, and longer stretches without a space aren't remembered.
LONG = 64
SHIFT = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a file with one base64 piece and its rank a line; read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


class Pieces:
    """The vocabulary as a trie in a hash table, so that many steps are taken at once."""

    def __init__(self, scores: dict[bytes, float]):
        step: dict[int, int] = {}
        final = [-math.inf]
        for piece, score in scores.items():
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in step:
                    step[key] = len(final)
                    final.append(-math.inf)
                state = step[key]
            final[state] = score
        self.final = np.array(final)
        self.bits = max(4, (3 * len(step)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        keys, to = np.array(list(step), np.int64), np.array(list(step.values()), np.int32)
        place = self._place(keys)
        while len(keys):  # those that find a free place take it, the first of equals
            free = np.flatnonzero(self.keys[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            took = free[first]
            self.keys[place[took]], self.next[place[took]] = keys[took], to[took]
            left = np.ones(len(keys), bool)
            left[took] = False
            keys, to, place = keys[left], to[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte more, 0 where no piece goes on so."""
        keys = state.astype(np.int64) << 8 | byte
        place = self._place(keys)
        out = np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[place[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.next[place[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, tokens: list[bytes]) -> list[int]:
        """The number of pieces in the best segmentation of each of some distinct pre-tokens, the smallest of equals."""
        if not tokens:
            return []
        tokens = [*tokens]
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        size = np.fromiter((len(tokens[i]) for i in order), np.int64, len(order))
        flat = np.frombuffer(b"".join(tokens[i] for i in order), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        # how many bytes each has in common with the one before
        common = np.zeros(len(order), np.int64)
        alive = np.arange(1, len(order))
        while len(alive):
            d = common[alive]
            alive = alive[(d < size[alive]) & (d < size[alive - 1])]
            d = common[alive]
            alive = alive[flat[start[alive] + d] == flat[start[alive - 1] + d]]
            common[alive] += 1
        out = np.zeros(len(order), np.int64)
        row = np.arange(len(order))  # the tokens that go on
        node = np.zeros(len(order), np.int64)  # of each of them
        best, many = np.zeros(1), np.zeros(1, np.int64)  # of each node
        first, opened = np.zeros(1, np.int64), np.zeros(1, np.int64)  # where a node's open pieces are, and how many
        state, base, count = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)  # of each open piece
        depth = 0
        while len(row):
            ended = size[row] == depth
            out[row[ended]] = many[node[ended]]
            row, node = row[~ended], node[~ended]
            if not len(row):
                break
            new = common[row] <= depth  # else its prefix is that of the row before
            new[0] = True
            heads = np.flatnonzero(new)
            parent, byte = node[heads], flat[start[row[heads]] + depth]
            # each child goes on with its parent's open pieces, and with one that begins here
            takes = opened[parent]
            child = np.r_[np.repeat(np.arange(len(heads)), takes), np.arange(len(heads))]
            of = _ranges(first[parent], takes)
            state = self.steps(np.r_[state[of], np.zeros(len(heads), np.int32)], byte[child])
            base, count = np.r_[base[of], best[parent]], np.r_[count[of], many[parent]]
            goes = np.flatnonzero(state)
            goes = goes[np.argsort(child[goes], kind="stable")]
            child, state, base, count = child[goes], state[goes], base[goes], count[goes]
            score = self.final[state] + base
            top = np.full(len(heads), -np.inf)
            np.maximum.at(top, child, score)
            least = np.full(len(heads), np.iinfo(np.int64).max)
            won = score == top[child]
            won &= score > -np.inf
            np.minimum.at(least, child[won], count[won] + 1)
            lost = top == -np.inf  # a byte that the vocabulary lacks is a token of its own
            best, many = np.where(lost, best[parent] - 100.0, top), np.where(lost, many[parent] + 1, least)
            opened = np.bincount(child, minlength=len(heads))
            first = np.cumsum(opened) - opened
            node = np.cumsum(new) - 1
            depth += 1
        back = np.empty(len(order), np.int64)
        back[order] = out
        return back.tolist()


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens, n_chars; no shuffle.

    ``vocabulary`` is the path of a rank file on the driver; its pieces (a fixed number) are broadcast.
    Null and empty texts count 0. Whole texts are counted, whatever their length. Null and repeated ids
    pass through, an empty table gives no rows, and other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(zipf_scores(read_ranks(vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        # no pre-token goes on from a non-space to a space, so chunks that begin there are independent
        chunks, pieces = regex.compile(r"\s*\S+|\s+").findall, regex.compile(PATTERN).findall
        known: dict[str, int] = {}  # tokens, and pre-tokens shifted, so that one sum adds both

        def learn(chunk_lists: list[list[str]]) -> None:
            parts = {c: pieces(c) for c in set().union(*chunk_lists) - known.keys()}
            distinct = list({p for some in parts.values() for p in some})
            counts: dict[str, int] = {}
            for long in (False, True):  # a trie is as deep as its longest pre-token
                some = [p for p in distinct if (len(p) > LONG) == long]
                counts.update(zip(some, vocabulary.count([p.encode("utf-8", "surrogatepass") for p in some]), strict=True))
            for c, some in parts.items():
                known[c] = sum([counts[p] for p in some]) + (len(some) << SHIFT)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                held, end = 0, at
                while end < len(texts) and (end == at or held + len(texts[end]) <= TRIE_CHARS):
                    held += len(texts[end])
                    end += 1
                lists = [chunks(t) for t in texts[at:end]]
                learn(lists)
                for text, some in zip(texts[at:end], lists, strict=True):
                    got = sum(map(known.__getitem__, some))
                    rows.append((got & ((1 << SHIFT) - 1), got >> SHIFT, len(text)))
                if len(known) > MOST_CHUNKS:
                    known.clear()
                at = end
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in columns]], names=["doc_id", "n_tokens", "n_pretokens", "n_chars"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_chars bigint")
