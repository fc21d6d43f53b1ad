"""Removal of repeated byte strings, by common prefixes from Burrows-Wheeler transforms.

Two documents share a string of ``length`` bytes where two of their suffixes have a common prefix of that
length. All suffixes of a corpus fit no task, so they are dealt out first, such that equal windows of
``length`` bytes always meet: a window belongs to its anchor, the least hash of the short strings in
it. Neighbouring windows of one anchor form a segment. Anchors that only one document has are left out;
the segments of the others are grouped by anchor into blocks of bounded size.

In a block the suffixes are sorted, and the transform is extended backward: a boundary between suffixes that
share n bytes sets, in front of each character, the boundaries of n + 1. So common prefixes come by
increasing value, all of one value at a time, and the expansion stops at ``length``: suffixes that no
boundary divides by then share a window. Each window learns the smallest document that has it, and
documents lose what a smaller one has.

Hot strings: equal segments are merged in each chunk of documents and once more in their block, so a passage
that a third of all documents share has a row a chunk; an anchor that very many segments have gives
its windows one by one, which merge where they are equal, so that no block holds more than its share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, shared_path
from lorekeep.session import discard, materialize

#: Bytes that two documents must share.
LENGTH = 50
#: Bytes of the strings whose hashes are compared for an anchor; windows are no shorter than these.
ANCHOR = 20
#: Bytes of documents that are searched at once, and whose equal segments merge.
CHUNK = 1 << 20
#: Rows that are handed to Python at once, so that batches of whole texts stay small.
ROWS = 4096
#: Bytes of text in a part of the table of documents, and such parts at most.
PART, MOST_PARTS = 16 << 20, 50_000
#: Windows of a segment at most, bytes of segments that one group gets, and that are sorted at once.
RUN, GROUP, BLOCK = 512, 1 << 20, 1 << 19
#: Occurrences of an anchor beyond which its windows go one by one.
HOT = 10_000
#: Windows that are hashed at once, so that arrays stay in the cache.
STRIPE = 1 << 15
#: The rank of documents without an id, behind all others.
NO_ID = (1 << 63) - 1

_MULTIPLIER, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# anchors


def _powers() -> dict[int, np.uint64]:
    return {k: np.uint64(pow(_MULTIPLIER, k, 1 << 64)) for k in (1, 2, 4, 8, 16, 32)}


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of 48 bits, above 0, of the ``k`` bytes from each place on; sums of shorter strings' sums."""
    power = _powers()
    step = data.astype(np.uint64) + np.uint64(1)
    total, done, size = None, 0, 1
    while True:
        if k & size:
            if total is None:
                total = step
            else:
                n = len(total) - size
                total = total[:n] * power[size] + step[done : done + n]
            done += size
        if 2 * size > k:
            break
        step = step[:-size] * power[size] + step[size:]
        size *= 2
    total = total ^ (total >> np.uint64(32))
    return np.maximum((total * np.uint64(_MIX)) >> np.uint64(16), np.uint64(1)).astype(np.int64)


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Runs:
    """The segments of a chunk of documents: start (in the joined bytes), count of windows, anchor, document."""

    def __init__(self, texts: list[bytes], length: int):
        self.joined, self.length = b"".join(texts), length
        self.limits = np.concatenate([[0], np.cumsum(np.array([len(x) for x in texts], np.int64))]).astype(np.int64)
        data = np.frombuffer(self.joined, np.uint8)
        windows = max(0, len(data) - length + 1)
        k = min(ANCHOR, length)
        least = np.zeros(windows + 1, np.int64)  # 0: no window of one document
        for at in range(0, windows, STRIPE):
            n = min(STRIPE, windows - at)
            least[at : at + n] = least_in_windows(string_hashes(data[at : at + n + length - 1], k), length - k + 1)
        for end in self.limits[1:-1].tolist():
            least[max(0, end - length + 1) : end] = 0
        first = np.flatnonzero(np.concatenate([[True], least[1:-1] != least[:-2]])) if windows else np.zeros(0, np.int64)
        count = np.diff(np.append(first, windows))
        real = least[first] != 0
        first, count = first[real], count[real]
        if len(count) and count.max() > RUN:
            pieces = -(-count // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, count = np.repeat(first, pieces) + nth * RUN, np.minimum(RUN, np.repeat(count, pieces) - nth * RUN)
        self.start, self.count, self.anchor = first, count, least[first]
        self.document = np.searchsorted(self.limits, first, "right") - 1


def _chunk_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk that lie together."""
    chunk = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the number of their chunk, which has about ``CHUNK`` bytes, one document at least, and of their row in it."""
    chunk, held, row = TaskContext.get().partitionId() << 40, 0, 0
    for batch in batches:
        out, rows = [], []
        for n in pa.compute.binary_length(batch.column(1)).to_pylist():
            if held and held + n > CHUNK:
                chunk, held, row = chunk + 1, 0, 0
            out.append(chunk)
            rows.append(row)
            held, row = held + n, row + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(rows, pa.int32()), *batch.columns], names=["chunk", "row", "doc_id", "text"])


def _anchors(length: int):
    """(anchor, seen): each anchor of a chunk once; seen packs the chunk, whether several documents have it, and its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunk_parts(batch):
                runs = Runs(part.column("text").to_pylist(), length)
                order = np.lexsort((runs.document, runs.anchor))
                anchor, document = runs.anchor[order], runs.document[order]
                if not len(anchor):
                    continue
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                last = np.append(first[1:], len(anchor)) - 1
                several = document[first] != document[last]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(np.full(len(first), part.column("chunk")[0].as_py())), pa.array(((last - first + 1) << 1 | several).astype(np.int32))], names=["anchor", "chunk", "seen"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that several documents have, with whether the anchor is hot, from rows sorted by anchor.

    What is held of an anchor until its end is at most ``HOT`` rows; a hot one streams on from there.
    """
    now, held, total, several, rows = -1, [], 0, False, 0

    def out(chunks: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(anchor), pa.array(hot)], names=["chunk", "anchor", "hot"])

    def ended() -> Iterator[pa.RecordBatch]:
        if held and (rows > 1 or several):
            chunks = np.concatenate(held)
            yield out(chunks, np.full(len(chunks), now), np.full(len(chunks), total > HOT))

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, chunk, seen = (batch.column(c).to_numpy() for c in ("anchor", "chunk", "seen"))
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor))
        for a, b in ((first[0], last[0]), *([(first[-1], last[-1])] if len(first) > 1 else [])):
            if anchor[a] != now:
                yield from ended()
                now, held, total, several, rows = anchor[a], [], 0, False, 0
            rows, total, several = rows + b - a, total + int((seen[a:b] >> 1).sum()), several or bool((seen[a:b] & 1).any())
            held.append(chunk[a:b].copy())
            if total > HOT and rows > 1:
                yield from ended()
                held = []
            if a == first[0] and len(first) > 1:
                # the anchors that begin and end in this batch
                lo, hi = last[0], first[-1]
                if hi > lo:
                    at = first[1:-1] - lo
                    n = np.diff(np.append(at, hi - lo))
                    sums, any_several = np.add.reduceat(seen[lo:hi] >> 1, at), np.maximum.reduceat(seen[lo:hi] & 1, at)
                    keep, hot = np.repeat((n > 1) | (any_several > 0), n), np.repeat(sums > HOT, n)
                    yield out(chunk[lo:hi][keep], anchor[lo:hi][keep], hot[keep])
    yield from ended()


# segments

#: A hot anchor is negative, and its segments are single windows. places: where a segment starts in the joined documents of its chunk.
SEGMENTS = "chunk bigint, anchor bigint, segment binary, low bigint, high bigint, place int, places array<int>"


def _digest(said: bytes) -> bytes:
    return hashlib.md5(said, usedforsecurity=False).digest()


def _in_order(documents: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a chunk by row, and the ranks of their ids."""
    documents = documents.sort_by("row")
    return documents, documents.column("doc_id").fill_null(NO_ID).to_numpy()


def _segments(length: int):
    """The segments of a chunk's documents that have a shared anchor, equal ones once, with the least and the greatest document."""

    def run(documents: pa.Table, anchors: pa.Table) -> pa.Table:
        documents, rank = _in_order(documents)
        runs = Runs(documents.column("text").to_pylist(), length)
        known, hot = anchors.column("anchor").to_numpy(), anchors.column("hot").to_numpy(zero_copy_only=False)
        found: dict[bytes, list] = {}
        more: dict[bytes, list[int]] = {}
        if len(known):
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            at = np.minimum(np.searchsorted(known, runs.anchor), len(known) - 1)
            chosen = np.flatnonzero(known[at] == runs.anchor)
            joined, tail = runs.joined, length - 1
            of = zip(runs.start[chosen].tolist(), runs.count[chosen].tolist(), runs.anchor[chosen].tolist(), hot[at[chosen]].tolist(), rank[runs.document[chosen]].tolist(), strict=True)
            for start, count, anchor, is_hot, d in of:
                for place, n in [(start + j, 1) for j in range(count)] if is_hot else [(start, count)]:
                    piece = joined[place : place + n + tail]
                    if (had := found.get(piece)) is None:
                        found[piece] = [-anchor if is_hot else anchor, d, d, place]
                        continue
                    more.setdefault(piece, []).append(place)
                    if d < had[1]:
                        had[1] = d
                    elif d > had[2]:
                        had[2] = d
        anchor, low, high, place = zip(*found.values(), strict=True) if found else ([],) * 4
        columns = [pa.array([documents.column("chunk")[0].as_py()] * len(found), pa.int64()), pa.array(anchor, pa.int64()), pa.array(list(found), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(place, pa.int32()), pa.array([more.get(x) for x in found] if more else [None] * len(found), pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, names=["chunk", "anchor", "segment", "low", "high", "place", "places"])

    return run


# the transform


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (0 to 256) in the order of their first ``depth`` characters at least; ties in any order."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = padded[:n].copy()
    for j in range(1, 7):
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key)
    known, bits = 7, n.bit_length()
    in_order = key[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    while known < depth and not new.all():
        # a group's rank is the place of its first; groups of one are done
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.zeros(n + 2 * known, np.int64)
        rank[order] = start + 1
        together = np.flatnonzero(~(new & np.append(new[1:], True)))
        at = order[together]
        if 3 * bits <= 63:
            key, reach = (rank[at] << bits | rank[at + known]) << bits | rank[at + 2 * known], 3 * known
        else:
            key, reach = rank[at] << 32 | rank[at + known], 2 * known
        by = np.argsort(key)
        order[together] = at[by]
        key = key[by]
        new[together] = np.concatenate([[True], key[1:] != key[:-1]])
        known = reach
    return order


def prefix_groups(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` whether its suffix shares less than ``length`` characters with the one before.

    ``text`` ends on a 0, and a 0 is like no other character. Only the Burrows-Wheeler transform of the
    order is looked at: row p of the first column is row ``source[p]`` of the last one, so the suffixes of
    rows p - 1 and p share one character more than those of their sources, if they begin alike.
    """
    last = text[order - 1].astype(np.uint16)
    source = np.argsort(last, kind="stable").astype(np.int32)
    column = last[source]
    divided = np.concatenate([[True], column[1:] != column[:-1]])  # nothing in common
    divided[column == 0] = True
    undivided = np.flatnonzero(~divided)
    here, before = source[undivided], source[undivided - 1]
    already = 0  # boundaries that are set but still among the undivided
    for _ in range(1, length):
        group = np.cumsum(divided, dtype=np.int32)
        apart = group[here] != group[before]  # their sources share one character less, which is known by now
        n = np.count_nonzero(apart)
        if n == already:
            break
        divided[undivided[apart]] = True
        already = n
        if 8 * n > len(undivided):
            undivided, here, before = undivided[~apart], here[~apart], before[~apart]
            already = 0
    return divided


def least_documents(segments: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment, one after another, the least document of any segment that has it; and the windows' limits."""
    sizes = np.array([len(x) for x in segments], np.int64)
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int16)
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order = sorted_suffixes(text, length)
    divided = prefix_groups(text, order, length)
    in_order = low[of[order]]
    least = np.minimum.reduceat(in_order, np.flatnonzero(divided))[np.cumsum(divided) - 1]
    at = np.empty(len(text), np.int64)
    at[order] = least
    windows = ends[of] - 1 - np.arange(len(text)) >= length
    return at[windows], np.concatenate([[0], np.cumsum(sizes - length + 1)])


#: One value stands for all windows of a segment, or leasts has one for each.
FOUND = "sid binary, least bigint, leasts array<bigint>"


def _compare(length: int):
    """What a group of distinct segments finds out: the least document of each window, for segments in which that matters."""

    def told(segments: list[bytes], least: np.ndarray, leasts: pa.Array) -> pa.Table:
        return pa.Table.from_arrays([pa.array([_digest(x) for x in segments], pa.binary()), pa.array(least, pa.int64()), leasts], names=["sid", "least", "leasts"])

    def block(rows: pa.Table) -> pa.Table:
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        segments = rows.column("segment").to_pylist()
        least, limits = least_documents(segments, low, length)
        lowest, highest = np.minimum.reduceat(least, limits[:-1]), np.maximum.reduceat(least, limits[:-1])
        wanted = np.flatnonzero(lowest < high)
        n = np.where(lowest == highest, 0, np.diff(limits))[wanted]
        at = np.repeat(limits[:-1][wanted], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(least[at], pa.int64()), mask=pa.array(n == 0))
        return told([segments[i] for i in wanted.tolist()], lowest[wanted], lists)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("anchor")
        anchor, low, high = (rows.column(c).to_numpy() for c in ("anchor", "low", "high"))
        begins = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        # with an anchor of its own a segment has no other to be compared with: its windows are its own documents'
        alone = begins & np.append(begins[1:], True)
        copied = rows.filter(pa.array(alone & (low < high)))
        out = [told(copied.column("segment").to_pylist(), copied.column("low").to_numpy(), pa.nulls(len(copied), pa.list_(pa.int64())))]
        rows, begins = rows.filter(pa.array(~alone)), begins[~alone]
        if len(rows):
            # blocks begin with an anchor, so that all of it is in one
            held = np.cumsum(pa.compute.binary_length(rows.column("segment")).to_numpy())
            cuts, done = [0], 0
            for i in np.flatnonzero(begins).tolist():
                if i > cuts[-1] and held[i - 1] - done >= BLOCK:
                    cuts.append(i)
                    done = held[i - 1]
            out += [block(rows.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
        return pa.concat_tables(out)

    return run


# what goes

RESULT = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"


def _cut(length: int):
    """The documents of a chunk without the windows that smaller documents have."""

    def windows(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(place, least document) of all windows that segments tell of."""
        place, n, least = (told.column(c).to_numpy() for c in ("place", "n", "least"))
        # further places of the same segments
        places, leasts = told.column("places").combine_chunks(), told.column("leasts").combine_chunks()
        others = np.repeat(np.arange(len(place)), pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy(zero_copy_only=False))
        of = np.concatenate([np.arange(len(place)), others])
        place = np.concatenate([place, places.flatten().to_numpy(zero_copy_only=False)])
        size = pa.compute.fill_null(pa.compute.list_value_length(leasts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, values = np.cumsum(size) - size, leasts.flatten().to_numpy(zero_copy_only=False)
        # 0, 1, ... along each segment
        along = np.arange(n[of].sum()) - np.repeat(np.cumsum(n[of]) - n[of], n[of])
        each = np.repeat(of, n[of])
        known = least[each].copy()
        listed = size[each] > 0
        known[listed] = values[begin[each[listed]] + along[listed]]
        return np.repeat(place, n[of]) + along, known

    def run(documents: pa.Table, told: pa.Table) -> pa.Table:
        documents, rank = _in_order(documents)
        texts = documents.column("text").to_pylist()
        joined, limits = b"".join(texts), np.concatenate([[0], np.cumsum(np.array([len(x) for x in texts], np.int64))]).astype(np.int64)
        starts = np.zeros(len(joined) + 1, np.int32)
        if told.num_rows:
            place, least = windows(told)
            starts[place[least < rank[np.searchsorted(limits, place, "right") - 1]]] = 1
        sums = np.concatenate([[0], np.cumsum(starts[:-1])])
        gone = sums[1:] > np.concatenate([np.zeros(min(length, len(joined)), sums.dtype), sums[1 : max(1, len(joined) - length + 1)]])
        edge = np.zeros(len(gone) + 1, bool)
        edge[limits] = True
        begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        ends = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
        of = np.searchsorted(begins, limits)
        base = np.repeat(limits[:-1], np.diff(of))
        spans = pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(ends - base, pa.int64())], names=["start", "end"])
        left = np.frombuffer(joined, np.uint8)[~gone].tobytes()
        cut = np.concatenate([[0], np.cumsum(~gone)])[limits]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rank), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(left)]).cast(pa.binary())
        return pa.Table.from_arrays([documents.column("doc_id"), pa.array(np.diff(limits)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans), kept], names=["doc_id", "n_bytes", "removed", "kept"])

    return run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes, in order), kept (the bytes that are left), one row a row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    id. Strings are taken from the texts as they come, in UTF-8, and never cross documents; null texts are
    empty, and texts shorter than ``length`` lose nothing. Rows that share an id take nothing from each other, and neither do rows
    without one, which rank behind all others. An empty table gives no rows; other columns are
    ignored whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary")).alias("text")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # written in parts by chunk, so that both later readings find the documents of a chunk together without a shuffle of texts
    name = f"lorekeep_documents_{uuid.uuid4().hex}"
    chunked = texts.mapInArrow(_chunked, "chunk bigint, row int, doc_id bigint, text binary")
    parts = min(MOST_PARTS, total // PART + 1)
    with arrow_rows(spark, ROWS):
        chunked.write.bucketBy(parts, "chunk").option("path", shared_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    documents = spark.table(name)
    seen = documents.select("chunk", "text").mapInArrow(_anchors(length), "anchor bigint, chunk bigint, seen int")
    shared = seen.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared, "chunk bigint, anchor bigint, hot boolean")
    with arrow_rows(spark, ROWS):
        shared = materialize(shared, "shared", free_shuffles=True, codec="zstd")
    segments = documents.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_segments(length), SEGMENTS)
    segments = materialize(segments, "segments", free_shuffles=True, codec="zstd")
    discard(shared)
    groups = (segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) // GROUP + 1
    group = F.pmod(F.when(F.col("anchor") > 0, F.col("anchor")).otherwise(F.xxhash64("segment")), F.lit(groups))
    grouped = segments.select("anchor", "segment", "low", "high", group.alias("group")).repartition("group")
    distinct = grouped.groupBy("group", "anchor", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = materialize(distinct.groupBy("group").applyInArrow(_compare(length), FOUND), "found", free_shuffles=True)
    n = (F.octet_length("segment") - (length - 1)).alias("n")
    told = segments.select("chunk", F.unhex(F.md5("segment")).alias("sid"), n, "place", "places").join(found, "sid").drop("sid")
    told = materialize(told, "told", free_shuffles=True, codec="zstd")
    discard(segments)
    discard(found)
    return documents.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut(length), RESULT)
