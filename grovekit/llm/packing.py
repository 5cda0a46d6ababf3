"""Variable-capacity best-fit packing of documents into training sequences.

Texts are encoded into token ids (``pieces``), each ended by an end token. Pieces go longest first, each into the open
sequence with the least room that takes it. If none does, a sequence is opened: for every permitted capacity the filling
that the pieces still to come would give is tried, and the capacity with the least cost per token is taken. At the end
every sequence shrinks to the smallest permitted capacity that holds it, and is filled with the ids of its pieces.

Every task packs the documents that it reads, GROUP_BYTES of text at a time, so nothing is shuffled, no key can be hot, and
no task holds more than a group. A group is large against a sequence: what is lost is a last sequence or two in some
hundreds, and those shrink to what is in them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks
from .pieces import MODEL, Memo, encode_block, load

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens that a sequence costs beside its capacity.
OVERHEAD = 16
#: Bytes of text, and documents, that are packed together, about.
GROUP_BYTES, GROUP_DOCS = 16 << 20, 200_000
#: The id that ends each document: that of the piece </s> in MODEL.
END_ID = 2


def _trial(room: int, lengths: list[int], counts: list[int]) -> int:
    """Tokens that the longest pieces that fit, again and again, would put into ``room``."""
    used, at = 0, len(lengths)
    while room > 0:
        at = min(at, bisect_left(lengths, room + 1))
        while at and not counts[at - 1]:
            at -= 1
        if not at:
            break
        k = min(counts[at - 1], room // lengths[at - 1])
        used += k * lengths[at - 1]
        room -= k * lengths[at - 1]
        at -= 1
    return used


def best_fit(pieces: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and capacity of each bin. Pieces come longest first and fit the largest capacity."""
    sizes = sorted(capacities)
    lengths = sorted(set(pieces))
    place = {n: i for i, n in enumerate(lengths)}
    counts = [0] * len(lengths)
    for n in pieces:
        counts[place[n]] += 1
    open_bins: list[tuple[int, int]] = []  # (room left, bin)
    used: list[int] = []
    which, offset = [], []
    for n in pieces:
        counts[place[n]] -= 1
        i = bisect_left(open_bins, (n, -1))
        if i < len(open_bins):
            room, b = open_bins.pop(i)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / (n + _trial(c - n, lengths, counts)), c))
            b = len(used)
            used.append(0)
        which.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    return which, offset, [sizes[bisect_left(sizes, u)] for u in used]


def cut_pieces(n_tokens: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, numbers and lengths of the pieces, longest first; of equal ones in the order of the documents."""
    pieces = -(-n_tokens // largest)
    row = np.repeat(np.arange(len(n_tokens)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(n_tokens[row] - k * largest, largest)
    order = np.argsort(-size, kind="stable")
    return row[order], k[order], size[order]


def _with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end token after each document, and the new offsets."""
    return np.insert(ids, offs[1:], end_id).astype(np.int32), offs + np.arange(len(offs))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the runs [start, start + size), end to end."""
    to = np.concatenate([[0], np.cumsum(size)])
    return np.arange(to[-1]) + np.repeat(start - to[:-1], size)


def _list_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group_bytes: int = GROUP_BYTES, model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """One row per training sequence: sequence (a number), capacity, n_tokens, fill (their share of it), ids (the tokens),
    and pieces, in the order of ``ids``: doc (all columns of the document but its text, whatever their names), piece,
    start (in the tokens of the document), n_tokens and offset (in the sequence).

    A document longer than the largest capacity is cut into pieces of that size and a rest; nothing is dropped. Null and
    empty texts have the end token alone. Of pieces of one length the earlier document comes first; rows that repeat ids
    are documents of their own. An empty table gives an empty one. Which documents share a sequence goes by the
    parts of the table that tasks read.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load(model))
    names = docs.columns
    at = names.index("text")
    rest = [f for i, f in enumerate(docs.schema.fields) if i != at]
    long = T.LongType()
    piece = T.StructType([T.StructField("doc", T.StructType(rest)), *(T.StructField(c, long) for c in ("piece", "start", "n_tokens", "offset"))])
    schema = T.StructType([T.StructField("sequence", long), T.StructField("capacity", long), T.StructField("n_tokens", long), T.StructField("fill", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("pieces", T.ArrayType(piece))])
    largest = max(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo = vocab.value, Memo()
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        size = rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
            ids = np.concatenate([x for _, x, _ in held])
            n = np.concatenate([np.diff(o) for _, _, o in held])
            held.clear()
            begin = np.cumsum(n) - n
            row, k, length = cut_pieces(n, largest)
            which, offset, caps = best_fit(length.tolist(), capacities, overhead)
            which, offset, caps = np.array(which), np.array(offset), np.array(caps, np.int64)
            order = np.lexsort((offset, which))
            row, k, length, offset, which = (x[order] for x in (row, k, length, offset, which))
            columns = [table.column(i).combine_chunks() if table.num_rows else table.column(i) for i in range(table.num_columns)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            doc = pa.StructArray.from_arrays([c for i, c in enumerate(columns) if i != at], names=[f.name for f in rest])
            edge = np.searchsorted(which, np.arange(len(caps) + 1))
            used = np.add.reduceat(length, edge[:-1])
            for a in range(0, len(caps), 512):  # batches of some hundred sequences
                b = min(len(caps), a + 512)
                p = slice(edge[a], edge[b])
                tokens = pa.array(ids[_runs(begin[row[p]] + k[p] * largest, length[p])])
                pieces = pa.StructArray.from_arrays([doc.take(pa.array(row[p])), pa.array(k[p]), pa.array(k[p] * largest), pa.array(length[p]), pa.array(offset[p])], names=["doc", "piece", "start", "n_tokens", "offset"])
                yield pa.RecordBatch.from_arrays([pa.array(first + made + np.arange(a, b)), pa.array(caps[a:b]), pa.array(used[a:b]), pa.array(used[a:b] / caps[a:b]), _list_of(tokens, used[a:b]), _list_of(pieces, np.diff(edge[a : b + 1]))], names=schema.names)
            made += len(caps)

        for batch, block in blocks(batches, limit=1 << 20):
            held.append((batch, *_with_end(*encode_block(v, block, memo), end_id)))
            size += len(block.data)
            rows += block.n
            if size >= group_bytes or rows >= GROUP_DOCS:
                yield from out()
                size = rows = 0
        if held:
            yield from out()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def fill_rate(sequences: DataFrame) -> DataFrame:
    """n_sequences, n_tokens, capacity and fill over all sequences."""
    total = sequences.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"), F.sum("capacity").alias("capacity"))
    return total.withColumn("fill", F.try_divide("n_tokens", "capacity"))
