"""Substring deduplication by line hashing.

Documents are cut into lines, and lines at the ends of sentences, so that a passage is found where its
lines were joined or broken anew. Every unit is normalised and hashed, whatever its length. Short units repeat by
chance in ordinary text, so what is grouped over the whole corpus are stretches of neighbouring units: for
each unit the shortest stretch with enough words that begins there, and the shortest that ends there. The
earliest occurrence (smallest id, then place) of each stretch stays, and units of the others go. Any longer
repeat is made of such stretches: a unit of it lies in the one that begins there, or, near the end of
the repeat, in the one that ends with it. So a unit goes if it lies in neighbouring units with enough
words that an earlier place has in the same order, whatever else its single lines have appeared in before.

Offsets in the original text are kept. Digests are counted with map-side combination, so that a line that a
third of all documents share is no large group, and occurrences of very frequent stretches meet their winner by broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, fresh_name, join_counted
from lorekeep.session import materialize

#: Repeats of fewer words stay: such lines repeat by chance and are part of ordinary text.
RUN_WORDS = 20
#: Texts that are cut at once, and the power of two of documents whose stretches are laid over their units at once.
ROWS, TOGETHER = 512, 9
#: A line break, or the space after the end of a sentence.
BREAK = re.compile(r"\n|(?<=[.!?]) ")


def stretches(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest stretches with ``least`` words or more from each unit on, and up to each unit; each once, in order.

    ``words`` has the words of each unit, one at least.
    """
    found = set()
    last, total = -1, 0
    for first in range(len(words)):
        while total < least and last + 1 < len(words):
            last += 1
            total += words[last]
        if total < least:
            break
        found.add((first, last))
        total -= words[first]
    first = total = 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= least:
            total -= words[first]
            first += 1
        if total >= least:
            found.add((first, last))
    return sorted(found)


def units(rows: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """row, doc_id, unit, start, end, n_words, stretches (n, digest of 16 bytes) of ``rows`` (row, doc_id, text).

    unit counts the document's units that have a word, from 0; start and end are code points of the
    text. A unit is normalised by lower case and single spaces. stretches has those that begin with the unit, and their n of units.
    """
    names = ["row", "doc_id", "unit", "start", "end", "n_words", "stretches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in batches:
            found, of, sizes, digests, limits = [], [], [], [], [0]
            for i, text in enumerate(batch.column(2).to_pylist()):
                at, said, n_words = 0, [], []
                for part in BREAK.split(text or ""):
                    end = at + len(part)
                    words = part.lower().split()
                    if words:
                        found.append((len(said), at, end, len(words)))
                        said.append(md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                        n_words.append(len(words))
                    at = end + 1
                of += [i] * len(said)
                k = 0
                here = stretches(n_words, run_words)
                for unit in range(len(said)):
                    while k < len(here) and here[k][0] == unit:
                        sizes.append(here[k][1] - unit + 1)
                        digests.append(said[unit] if here[k][1] == unit else md5(b"".join(said[unit : here[k][1] + 1])).digest())
                        k += 1
                    limits.append(len(sizes))
            longs = zip(*found, strict=True) if found else ([],) * 4
            at_rows = pa.array(of, pa.int64())
            ids = [batch.column(k).take(at_rows) for k in (0, 1)]
            both = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["n", "digest"])
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x, pa.int64()) for x in longs], pa.ListArray.from_arrays(pa.array(limits, pa.int32()), both)], names=names)

    return rows.mapInArrow(run, "row bigint, doc_id bigint, unit bigint, start bigint, end bigint, n_words bigint, stretches array<struct<n:bigint,digest:binary>>")


def _repeats(rows: DataFrame, run_words: int) -> DataFrame:
    """The units of ``rows`` (row, doc_id, text) that go, with their row."""
    with arrow_rows(rows.sparkSession, ROWS):
        found = materialize(units(rows, run_words), "units")
    place = ("doc_id", "row", "unit")
    begun = found.select(*place, F.explode("stretches").alias("s")).select(*place, "s.n", "s.digest")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), *[F.col(c).alias(f"keep_{c}") for c in place])
    groups = begun.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = materialize(groups, "groups", free_shuffles=True)
    again = join_counted(begun, groups, "digest", "copies").where("row <> first.keep_row OR unit <> first.keep_unit")
    again = materialize(again.select("row", "unit", "n", "first"), "again", free_shuffles=True)
    block = F.shiftright("row", TOGETHER).alias("block")
    rows = found.select(block, "row", "doc_id", "unit", "start", "end", "n_words")
    covers = again.select(block.alias("of"), "row", "unit", "n", "first.*")
    return rows.groupBy("block").cogroup(covers.groupBy("of")).applyInArrow(_covered, GONE)


GONE = "row bigint, doc_id bigint, unit bigint, start bigint, end bigint, n_words bigint, keep_doc_id bigint, keep_unit bigint"


def _covered(rows: pa.Table, again: pa.Table) -> pa.Table:
    """The units of some documents that lie in a repeated stretch, each with its earliest place in one."""
    row, unit = rows.column("row").to_numpy(), rows.column("unit").to_numpy()
    order = np.lexsort((unit, row))
    ids, begin = np.unique(row[order], return_index=True)
    # units are numbered from 0 in each row, so a stretch begins at its row's begin and covers the places from there
    n = again.column("n").to_numpy()
    at = begin[np.searchsorted(ids, again.column("row").to_numpy())] + again.column("unit").to_numpy()
    of, nth = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = at[of] + nth
    last = again.column("last").to_numpy(zero_copy_only=False)[of]
    keep = again.column("keep_doc_id")
    doc = keep.fill_null(0).to_numpy()[of]
    keep_unit = again.column("keep_unit").to_numpy()[of] + nth
    best = np.lexsort((keep_unit, again.column("keep_row").to_numpy()[of], doc, last, place))
    best = best[np.concatenate([[True], place[best][1:] != place[best][:-1]])] if len(best) else best
    taken = rows.select(["row", "doc_id", "unit", "start", "end", "n_words"]).take(pa.array(order[place[best]]))
    return taken.append_column("keep_doc_id", keep.take(pa.array(of[best]))).append_column("keep_unit", pa.array(keep_unit[best], pa.int64()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row for each unit that goes: doc_id, unit, start, end, n_words, keep_doc_id, keep_unit.

    A unit goes if neighbouring units of ``run_words`` words or more, itself among them, are in an earlier place
    in the same order; keep_doc_id and keep_unit name the earliest place of the unit in such company. Repeats inside a
    document count too, and the first occurrence of a unit never goes. Rows are documents of their own,
    also where their id is null or repeated: null ids rank behind all others, equal ids in the order
    in which they are read. Null and empty texts have no units, and an empty table gives no rows; other
    columns are ignored, whatever their names. ``run_words=1`` takes out every repeat.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _repeats(rows, run_words).select("doc_id", "unit", "start", "end", "n_words", "keep_doc_id", "keep_unit")


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with what :func:`repeated_lines` finds cut out, and what was removed (array of start, end, in order).

    The break or space behind a removed unit goes with it. The array is the last column, ``removed`` or,
    if there is such a column, that name with as many underscores as make it new.
    """
    row, spans, removed = fresh_name(docs, "row"), fresh_name(docs, "spans"), fresh_name(docs, "removed")
    text = F.col(f"`{text_col}`")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = _repeats(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), text.cast("string").alias("text")), run_words)
    of_row = gone.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    met = numbered.join(of_row, row, "left").withColumn(removed, F.coalesce(spans, none))
    # between the spans: from the end of one, past its line break, to the start of the next
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(removed, lambda s: s["end"] + 1))
    ends = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.char_length(text).cast("bigint") + 1))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(F.concat(text, F.lit("\n")), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    joined = F.array_join(pieces, "")
    cut = F.when(F.endswith(joined, F.lit("\n")), F.substring(joined, F.lit(1), F.char_length(joined) - 1)).otherwise(joined)
    left = met.withColumn(text_col, F.when(text.isNull() | (F.size(removed) == 0), text).otherwise(cut))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns], removed)
