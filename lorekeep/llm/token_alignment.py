"""Alignment of two tokenizers over a corpus.

Texts are encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B). The tokens of a whole
chunk of texts lie one after another on one axis of bytes; A ends and B ends are counted on it once, and
where both have one, the axis is cut into groups. Prefix sums over the cuts give each document its
own figures. The links of a chunk are counted by distinct pair of ids, so the corpus-wide counts are made of
small dictionaries, one a chunk, which also bring the counts back: a pair that is frequent everywhere
has one row a chunk, and no table of all pairs goes to a task.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import materialize

#: Bytes of text whose links share one dictionary, and of text that is encoded at once.
CHUNK, AT_ONCE = 2 << 20, 1 << 19
#: Ids of B that a pair's number leaves room for.
B_BITS = 32
#: A space between visible ASCII characters: a token of either kind may begin there, and none goes across it.
SEAM = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Tokenizers:
    """Both vocabularies, as encoders and as arrays of the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are then plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_char = byte_characters()
        words = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (words[-1][1] + 1)
        for word, i in words:
            self.a_bytes[i] = bytes(of_char[c] for c in word) if all(c in of_char for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_names, self.b_names = Names(self.a_bytes), Names(self.b_bytes)
        self.seams = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text, which is encoded with a space before it."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)


@functools.cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    return Tokenizers(a_path, b_path)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        out[chr(b) if b in shown else chr(spare)] = b
        spare += b not in shown
    return out


def parts(text: str, size: int) -> list[str]:
    """The text, cut at seams into parts of at least ``size`` characters; the space of a seam goes, since each part is encoded behind one."""
    out, at = [], 0
    while len(text) - at > size and (seam := SEAM.search(text, at + size)):
        out.append(text[at : seam.start()])
        at = seam.end()
    return [*out, text[at:]]


def _ids(tok: Tokenizers, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of A and B for each text, which are encoded about ``AT_ONCE`` characters at a time."""
    a, b = [], []
    at = waiting = 0
    for i, text in enumerate(texts):
        waiting += len(text) + 1
        if waiting >= AT_ONCE or i + 1 == len(texts):
            for out, ids in zip((a, b), tok.encode(texts[at : i + 1]), strict=True):
                out += [np.array(x, np.int32) for x in ids]
            at, waiting = i + 1, 0
    return a, b


def _encoded(tok: Tokenizers, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of A and B for each text; none where the bytes of either differ from space + text."""
    cut = [parts(t.decode("utf-8", "replace"), AT_ONCE) if tok.seams else [t.decode("utf-8", "replace")] for t in texts]
    a, b = _ids(tok, [p for ps in cut for p in ps])
    if len(a) > len(texts):  # the parts of long texts belong together
        limits = np.concatenate([[0], np.cumsum([len(ps) for ps in cut])]).tolist()
        a, b = ([np.concatenate(x[p:q]) for p, q in zip(limits, limits[1:], strict=False)] for x in (a, b))
    whole = np.array([bool(t) for t in texts])
    for ids, names in ((a, tok.a_names), (b, tok.b_names)):
        whole &= names.spell(ids, texts)
    none = np.zeros(0, np.int32)
    return tuple([x if w else none for x, w in zip(ids, whole.tolist(), strict=True)] for ids in (a, b))


class Names:
    """Byte strings by number, joined at once for many numbers."""

    def __init__(self, names: list[bytes]):
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.size = np.array([len(x) for x in names], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        shift = self.start[ids] - (ends - size)
        at = np.repeat(shift, size)
        at += np.arange(len(at))
        return self.bytes[at], ends

    def spell(self, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """For each text whether its ids join to space + text."""
        spelled = np.array([int(self.size[x].sum()) for x in ids]) == np.array([len(t) + 1 for t in texts])
        long = np.flatnonzero(spelled)
        if len(long):
            want = np.frombuffer(b" " + b" ".join([texts[i] for i in long.tolist()]), np.uint8)
            got, _ = self.join(np.concatenate([ids[i] for i in long.tolist()]))
            begins = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in long.tolist()])[:-1]])
            spelled[long] = np.logical_and.reduceat(got == want, begins)
        return spelled


def _per_document(at_bytes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How much of a count on the axis of bytes falls to each document, by prefix sums at the documents' limits."""
    sums = np.concatenate([[0], np.cumsum(at_bytes)])
    return np.diff(sums[limits])


class Aligned:
    """The tokens of many documents on one axis of bytes, cut where tokens of both kinds end."""

    def __init__(self, tok: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.tok, self.docs = tok, len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *ids]) for ids in (a, b))
        a_ends, b_ends = np.cumsum(tok.a_names.size[self.a], dtype=np.int64), np.cumsum(tok.b_names.size[self.b], dtype=np.int64)
        of_a = np.concatenate([[0], np.cumsum(self.n_a)])
        limits = np.concatenate([[0], a_ends])[of_a]  # where documents end on the axis
        size = int(limits[-1]) + 1
        a_at, b_at = np.bincount(a_ends, minlength=size), np.bincount(b_ends, minlength=size)
        cut = (a_at > 0) & (b_at > 0)
        # an end at a document's limit belongs to it, so counts are taken over (limit, limit]
        self.n_groups, self.n_links = (_per_document(x[1:], limits) for x in (cut, a_at * b_at))
        self.a_last, self.b_last = cut[a_ends], cut[b_ends]  # the last token of its group
        self.a_group, self.b_group = (np.cumsum(last) - last for last in (self.a_last, self.b_last))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, pair number) of every link: token occurrences of A and B that end together."""
        # tokens have one byte at least, so one of each kind ends at a cut
        doc = np.repeat(np.arange(self.docs), self.n_groups)
        return doc, (self.a[self.a_last].astype(np.int64) << B_BITS) | self.b[self.b_last]

    def group_digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` for each document; '' without tokens."""
        # A token's place among both: those of its kind before it, and those of the other kind in earlier groups (B: also in its own)
        b_ended, a_ended = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (self.b_last, self.a_last))
        b_until, a_until = b_ended[self.a_group], a_ended[self.b_group + 1]
        codes = np.empty(len(self.a) + len(self.b), np.int32)
        # separators: 0 comma, 1 bar behind the A tokens of a group, 2 semicolon behind a group
        codes[np.arange(len(self.a)) + b_until] = self.a * 3 + self.a_last
        codes[np.arange(len(self.b)) + a_until] = self.b * 3 + 2 * self.b_last
        text, ends = _written(max(len(self.tok.a_bytes), len(self.tok.b_bytes))).join(codes)
        limits = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        said = memoryview(text)
        return [hashlib.sha256(said[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(limits, limits[1:], strict=False)]


@functools.cache
def _written(ids: int) -> Names:
    """Every id in decimal with each separator."""
    return Names([b"%d%c" % (i, sep) for i in range(ids) for sep in b",|;"])


def _chunks(lengths: list[int], size: int) -> Iterator[slice]:
    """Stretches of texts that hold about ``size`` bytes, one text at least."""
    at = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield slice(at, i)
            at, total = i, 0
        total += n + 1
    if at < len(lengths):
        yield slice(at, len(lengths))


ALIGNED = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, link array<int>, times array<int>, pair array<bigint>, total array<bigint>"


def _align(a_path: str, b_path: str):
    """One row a document, with its links by place in the chunk's dictionary, and one row a chunk with the dictionary."""

    def lists(values: np.ndarray, limits: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        chunk = TaskContext.get().partitionId() << 40
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("link", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pair", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for part in _chunks(sizes, CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = [x or b"" for x in rows.column(1).to_pylist()]
                found = Aligned(tok, *_encoded(tok, texts))
                doc, pair = found.links()
                known, place, total = np.unique(pair, return_inverse=True, return_counts=True)
                both, times = np.unique(doc * max(1, len(known)) + place, return_counts=True)
                limits = np.searchsorted(both, np.arange(found.docs + 1) * max(1, len(known)))
                n, one = found.docs, lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one([chunk] * n), rows.column(0), one(found.n_a), one(found.n_b), one(found.n_groups), one(found.n_links), pa.array(found.group_digests(), pa.string()), lists(both % max(1, len(known)), limits, pa.int32()), lists(times, limits, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                    schema=schema,
                )
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "pair": known.tolist(), "total": total.tolist()}], schema=schema)
                chunk += 1

    return run


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a chunk, with what the corpus says about the pairs of its dictionary."""
    order = np.argsort(pairs.column("pair").to_numpy())
    counts, best = pairs.column("corpus").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    link, times = (documents.column(c).combine_chunks() for c in ("link", "times"))
    at = link.flatten().to_numpy(zero_copy_only=False)
    n = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    limits = np.concatenate([[0], np.cumsum(link.value_lengths().to_numpy(zero_copy_only=False))])
    sums = {"n_best": _per_document(best[at] * n, limits), "count_sum": _per_document(counts[at] * n, limits)}
    columns = [documents.column(c) if c not in sums else pa.array(sums[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row a row of ``docs``.

    Texts are encoded as space + text. Null and empty texts, and those whose tokens don't join to the same bytes, have
    no tokens: zeros and ''. A group ends where tokens of A and B both end; these two are linked. A pair of ids counts
    how many links of all texts hold it, repeated rows each; n_best counts links whose pair no other of the same B id exceeds, and
    count_sum adds the counts up. Null ids stay null, an empty table gives no rows, other columns are
    ignored whatever their names. Texts are encoded in parts of half a million characters, cut where a
    space stands between visible ASCII characters; a text without any is encoded whole.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = materialize(texts.mapInArrow(_align(a_path, b_path), ALIGNED), "aligned")
    dictionary = found.where("pair is not null").select("chunk", F.explode(F.arrays_zip("pair", "total")).alias("p")).select("chunk", "p.pair", "p.total")
    counts = materialize(dictionary.groupBy("pair").agg(F.sum("total").alias("corpus")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # one row an id of B, so its size is that of the vocabulary at most
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("corpus").alias("highest"))
    known = counts.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "corpus", (F.col("corpus") == F.col("highest")).alias("best"))
    told = dictionary.select("chunk", "pair").join(known, "pair").select(F.col("chunk").alias("of"), "pair", "corpus", "best")
    documents = found.where("pair is null").drop("pair", "total")
    return documents.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_finish, RESULT)
