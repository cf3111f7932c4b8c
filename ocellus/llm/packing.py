"""Operator 8: hierarchical best-fit packing of documents into training sequences of CAPACITY tokens.

A document longer than a sequence gives whole sequences of its own and a rest. Rests and shorter documents are items.
Every partition packs what it holds where it is, best fit, longest first, in runs of PART_ITEMS items or PART_BYTES of
text at most: nothing is moved for that. Bins that are FULL of capacity or more are emitted. The others are the items of
the next level: neighbouring parts are merged so that a part has about PART_ITEMS again, and packed again, until one
part is left, which emits all that it has. A level that hardly lowers the number of bins is the last one too (documents
of over half a sequence never fill a bin, however often they are merged), so no task grows with the table.

Sequences hold their text, so that nothing else is needed to train on them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, grouped_batches, prepare

CAPACITY = 2048
FULL = 0.98
PART_ITEMS = 20_000
PART_BYTES = 16 << 20
#: A level that leaves more than this share of its items as underfull bins is the last.
SHRINK = 0.95
_LISTS = ("doc_ids", "starts", "lengths", "texts")
_SCHEMA = "part long, done boolean, used int, doc_ids array<long>, starts array<int>, lengths array<int>, texts array<string>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Packs items in the order given, each into the fullest bin that has room; on ties the one that has had this room for longest."""
    room: list[deque[int]] = [deque() for _ in range(capacity + 1)]  # bins by the room left
    bins: list[list[int]] = []
    some = 0  # bit r: a bin with room r exists
    for item, size in enumerate(sizes):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].popleft()
            if not room[left]:
                some &= ~(1 << left)
            bins[at].append(item)
        else:
            left, at = capacity, len(bins)
            bins.append([item])
        left -= size
        room[left].append(at)
        some |= 1 << left
    return bins


def pieces(text: pa.Array, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, first token, tokens, text) of the pieces of at most `capacity` tokens that a column of texts is cut into."""
    raw, off = K.text_buffer(text)
    found: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []
    for i, j in K.slices(off):
        b = raw[off[i] : off[j]]
        d, s, e = K.word_spans(b, off[i : j + 1] - off[i], K.INK)
        if not len(d):
            continue
        docs, first = K.runs(d)
        count = np.diff(np.append(first, len(d)))
        n = -(-count // capacity)
        row = np.repeat(np.arange(len(docs)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = k * capacity
        length = np.minimum(count[row] - start, capacity)
        a, z = s[first[row] + start], e[first[row] + start + length - 1]
        held = b.tobytes()
        texts += [held[x:y] for x, y in zip(a.tolist(), z.tolist())]
        found.append((i + docs[row], start, length))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(3)), texts)
    return (*(np.concatenate(c) for c in zip(*found)), texts)


def _bins(part: int, used: np.ndarray, order: np.ndarray, lists: list[pa.ListArray], capacity: int, last: bool) -> pa.RecordBatch:
    """The items of a part, given in a stable order of their own and packed in `order`, as bins; bins stand where their first item stood."""
    sizes = used[order].tolist()
    bins = [sorted(order[i] for i in items) for items in best_fit(sizes, capacity)]
    bins.sort(key=lambda items: items[0])
    flat = np.array([i for items in bins for i in items], np.int64)
    ends = np.cumsum([len(items) for items in bins])
    total = np.diff(np.concatenate([[0], np.cumsum(used[flat])[ends - 1]]))
    out = []
    for c in lists:
        own = c.take(pa.array(flat))
        upto = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
        out.append(pa.ListArray.from_arrays(pa.array(upto[np.concatenate([[0], ends])].astype(np.int32)), own.flatten()))
    done = np.ones(len(bins), bool) if last else total >= capacity * FULL
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), part)), pa.array(done), pa.array(total.astype(np.int32)), *out], ["part", "done", "used", *_LISTS])


def _single(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32)), values)


def _local(capacity: int, part_items: int, part_bytes: int, numbers: dict[str, int] | None):
    """Packs the rows of a partition, run by run. numbers: of the files, if parts are files."""

    def pack(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        row, start, length, texts = pieces(table.column("text"), capacity)
        if not len(row):
            return
        ids = table.column("doc_id").combine_chunks().take(pa.array(row))
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        lists = [_single(ids), _single(pa.array(start.astype(np.int32))), _single(pa.array(length.astype(np.int32))), _single(pa.array(texts, pa.string()))]
        number = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
        order = np.lexsort((np.arange(len(row)), start, number, -length))
        yield _bins(part, length, order, lists, capacity, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, rows, size = -1, 0, 0
        for batch in batches:
            place = batch.column("place").to_pylist()
            place = [numbers.get(p, 0) for p in place] if numbers is not None else place
            change = [0, *(k for k in range(1, len(place)) if place[k] != place[k - 1]), len(place)]
            for a, b in zip(change[:-1], change[1:]):
                if a == b:
                    continue
                if held and (place[a] != at or rows >= part_items or size >= part_bytes):
                    yield from pack(at, held)
                    held, rows, size = [], 0, 0
                held.append(batch.slice(a, b - a))
                at, rows, size = place[a], rows + b - a, size + batch.nbytes * (b - a) // batch.num_rows
        if held:
            yield from pack(at, held)

    return run


def _merge(capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, ["part"]):
            group = group.combine_chunks()
            used = group.column("used").to_numpy().astype(np.int64)
            lists = [group.column(c).combine_chunks() for c in _LISTS]
            lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
            ids = [[(x is None, x or 0) for x in own] for own in lists[0].to_pylist()]
            starts = lists[1].to_pylist()
            own = np.array(sorted(range(len(used)), key=lambda k: (ids[k], starts[k])))  # the same in every run, however rows came
            used, lists = used[own], [c.take(pa.array(own)) for c in lists]
            order = np.argsort(-used, kind="stable")
            yield _bins(group.column("part")[0].as_py(), used, order, lists, capacity, last)

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES, by_file: bool = False) -> DataFrame:
    """(part, doc_ids, starts, lengths, used, texts): one row a sequence; entry k is tokens [starts, starts + lengths) of doc_ids[k], and their text.

    Every token of every document is in one sequence, and no sequence has more than `capacity`. Tokens are words between
    white space; a piece of text goes from its first token to its last. Which documents share a sequence depends on how
    docs is partitioned. part numbers neighbourhoods: those of Spark's partitions, or, by_file, the files of docs in the
    order of their names, so that a table that was written in order is packed and numbered in that order; a sequence that
    a higher level made has the number of the first neighbourhood in it. Uses doc_id and text alone. Defined cases: a
    null, empty or blank text has no tokens and is in no sequence; a null doc_id is packed as null; repeated rows are
    packed each; equal lengths go by doc_id (null last), start and place; an empty table gives no rows; texts of any
    length are cut into sequences.
    """
    prepare(docs.sparkSession)
    names = sorted(f.rpartition("/")[2] for f in docs.inputFiles()) if by_file else []
    numbers = {f: k for k, f in enumerate(names)} if names else None
    place = F.substring_index(F.input_file_name(), "/", -1) if names else F.spark_partition_id().cast("long")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("place"))
    packed = cut(plain.mapInArrow(_local(capacity, part_items, part_bytes, numbers), _SCHEMA))
    emitted = packed.filter("done")
    level = packed.filter("NOT done")
    facts = level.agg(F.count("*").alias("n"), F.max("part").alias("last")).first()
    items, wide = facts["n"], (facts["last"] or 0) + 1  # of the level, and numbers that its parts take
    while items:
        parts = max(1, min(wide, -(-items // part_items)))
        step = -(-wide // parts)  # so many neighbouring numbers become one part, which keeps the first of them
        merged = level.withColumn("part", F.col("part") - F.pmod("part", F.lit(step)))
        packed = cut(merged.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(capacity, step >= wide), _SCHEMA))
        left = 0 if step >= wide else packed.filter("NOT done").count()
        if left > SHRINK * items:  # what is underfull here stays so
            emitted, left = emitted.unionByName(packed), 0
        else:
            emitted = emitted.unionByName(packed.filter("done"))
        level, items = packed.filter("NOT done"), left
    return emitted.select("part", "doc_ids", "starts", "lengths", "used", "texts")
