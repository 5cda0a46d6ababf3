"""Exact deduplication by content-defined chunk recipes.

A text, without its white space, is cut where a rolling hash of the last bytes meets a mask, so equal passages are
cut alike wherever they lie. Each chunk gets an identifier. Chunks whose identifier occurs more than once are compared byte by
byte: of equal ones one is left, and no two with one identifier may be. Were two different chunks to share an identifier,
longer identifiers are taken and verified in turn, and in the end the chunk itself, so identifiers are verified whatever
their length. A document is then its recipe, the ordered list of chunk identifiers, and documents are equal when recipes are.
The recipe is about a sixtieth of the text; beside recipes only chunks that recur are moved, once for each part that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Scratch, TextBlock, binary_array, blocks, fresh, held_ids, id_filter, prefix_hash, project, released, salted_group_stats, span_hash, split_by_ids, text_buffers

#: Bytes that decide on a cut, bits of the mask (chunks of 2**bits bytes on average), most bytes of a chunk.
WINDOW, MASK_BITS, MAX_CHUNK = 24, 10, 16384
#: Bytes of an identifier, and the longest that the hash gives; beyond, a chunk is its own identifier.
ID_BYTES, MOST_ID_BYTES = 16, 64


def normalised(block: TextBlock) -> TextBlock:
    """The block without its white space bytes."""
    keep = ~IS_SPACE[block.data]
    total = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return TextBlock(block.data[keep], total[block.offs])


def cut(block: TextBlock, window: int = WINDOW, bits: int = MASK_BITS, most: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the chunks. Cuts depend on the bytes of the document only."""
    n = len(block.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.unique(block.offs[:-1][np.diff(block.offs) > 0])
    cuts = np.zeros(0, np.int64)
    if n >= window:
        at = np.arange(window, n + 1)
        h = span_hash(prefix_hash(block.data), at - window, at)
        at = at[(h >> np.uint64(64 - bits)) == 0]
        at = at[at - window >= block.offs[block.doc_of(at - 1)]]  # the window lies within one document
        cuts = at[at < n]
    start = np.union1d(first, cuts)
    end = np.append(start[1:], n)
    pieces = -(-(end - start) // most)
    if pieces.max() > 1:  # too long a chunk is cut again at fixed steps
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + k * most
        end = np.minimum(np.append(start[1:], n), start + most)
    return start, end, block.doc_of(start)


def identify(chunk: bytes, size: int) -> bytes:
    """An identifier of so many bytes; of none: the chunk itself."""
    return hashlib.blake2b(chunk, digest_size=size).digest() if size else chunk


def _cook(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_points, text_sha256, and the recipe of identifiers of so many bytes."""

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            points = block.per_doc((block.data & 0xC0) != 0x80)
            block = normalised(block)
            start, end, doc = cut(block)
            raw = block.data.tobytes()
            ids = [identify(raw[a:b], size) for a, b in zip(start.tolist(), end.tolist())]
            if not size:  # chunks of any length: the length comes before each
                ids = [len(x).to_bytes(4, "big") + x for x in ids]
            total = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            offs = total[np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.n))])]
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist())]
            recipe = binary_array(np.frombuffer(b"".join(ids), np.uint8), offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points), pa.array(sha), recipe], names=["doc_id", "n_points", "text_sha256", "recipe"])

    return docs.mapInArrow(cook, "doc_id long, n_points long, text_sha256 string, recipe binary")


def _numbered(docs: DataFrame, size: int) -> DataFrame:
    return _cook(docs, size).withColumn("row", F.monotonically_increasing_id())


def _repeated_ids(cooked: DataFrame, size: int) -> DataFrame:
    """The identifiers that occur more than once in the recipes, whether in one document or in several."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, _ = text_buffers(b.column(0))
            ids, n = np.unique(np.frombuffer(data.tobytes(), f"V{size}"), return_counts=True) if len(data) else (np.zeros(0, f"V{size}"), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([binary_array(np.frombuffer(ids.tobytes(), np.uint8), np.arange(len(ids) + 1) * size), pa.array(n.astype(np.int64))], names=["id", "n"])

    return cooked.select("recipe").mapInArrow(count, "id binary, n long").groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1").select("id")


def _id_numbers(ids: list[bytes]) -> np.ndarray:
    """The first eight bytes of identifiers as numbers."""
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in ids), np.uint64)


def shipped_chunks(docs: DataFrame, cooked: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """id, chunk: of the chunks whose identifier occurs more than once, each content once for each block of text. A chunk of which
    there is one needs no comparison, and stays where it is (but for the few that the filter of ids cannot tell)."""
    repeated = scratch.save(_repeated_ids(cooked, size))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield _id_numbers(b.column(0).to_pylist())

    held = id_filter(repeated, numbers, repeated.count())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches):
            block = normalised(block)
            start, end, _ = cut(block)
            raw = block.data.tobytes()
            ids = [identify(raw[a:b], size) for a, b in zip(start.tolist(), end.tolist())]
            again = np.flatnonzero(held_ids(held.value, _id_numbers(ids))).tolist() if ids else []
            seen = dict.fromkeys((ids[i], raw[start[i] : end[i]]) for i in again)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], names=["id", "chunk"])

    return docs.select("text").mapInArrow(cut_up, "id binary, chunk binary")


def _distinct_contents(docs: DataFrame, cooked: DataFrame, size: int, scratch: Scratch) -> bool:
    """Whether each identifier of so many bytes stands for one content: of equal chunks one stays, in every part before it is
    moved, and then no identifier may be left twice."""
    one = shipped_chunks(docs, cooked, size, scratch).distinct()
    return one.groupBy("id").count().filter("count > 1").limit(1).count() == 0


def recipes(docs: DataFrame, id_bytes: int = ID_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_points (code points of the text), text_sha256 (of the normalised text), recipe, row (a number of its own for each
    row): a written table, with identifiers of the shortest length, from ``id_bytes`` on by doubling, that tells all chunks apart; the chunks themselves if none does."""
    docs, scratch = project(docs, doc_id="long", text="string"), scratch or Scratch(docs.sparkSession)
    size = id_bytes
    while size <= MOST_ID_BYTES:
        cooked = scratch.save(_numbered(docs, size))
        if _distinct_contents(docs, cooked, size, scratch):
            return cooked
        scratch.drop(cooked)
        size *= 2
    return scratch.save(_numbered(docs, 0))


def exact_groups(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per document with the group of equal texts that it belongs to.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty, and all
    empty texts are one group. The row with the most code points stays, then the smallest doc_id (a null doc_id comes
    first). Of rows that repeat a doc_id with equal texts one alone stays. Very long texts are cut like others, so only
    their recipes move. Further columns take no part; an empty table gives an empty report.
    Returns doc_id, keep_id, group_size, kept, text_sha256, n_points.
    """
    scratch = Scratch(docs.sparkSession)
    base = recipes(docs, id_bytes, scratch)
    # null ids first, then the smallest; ``row`` tells rows apart that are alike, and spreads them
    best = F.struct(F.col("n_points"), F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("minus"), (-F.col("row")).alias("at"))
    grouped = salted_group_stats(base, ["recipe"], F.xxhash64("row"), {"group_size": F.count(F.lit(1)), "_best": F.max(best)}, {"group_size": F.sum, "_best": F.max})
    keep = -F.col("_best.minus")
    return grouped.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long"), (F.col("row") == -F.col("_best.at")).alias("kept"), "text_sha256", "n_points")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns as they are, whatever their names.

    Of rows that are alike in doc_id, text without white space and length one stays, the one whose text is the least. A
    null text counts as empty, so one row of all empty ones stays. An empty table gives an empty one. Only texts whose id
    some dropped row has are moved.
    """
    scratch = Scratch(docs.sparkSession)
    with released():
        report = scratch.save(exact_groups(docs))
    sure, maybe = split_by_ids(docs, report.filter("NOT kept"))
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    row, one = fresh(docs.columns, "row"), "struct(*)"
    marked = maybe.select(F.expr(one).alias(row), F.col("`doc_id`").cast("long").alias("id"), text.alias("whole"), F.sha2(F.translate(text, " \t\n\x0b\f\r", "").cast("binary"), 256).alias("sha"), F.length(text).cast("long").alias("points"))
    # rows that are alike shrink to one in every part before they are moved
    marked = marked.groupBy("id", "sha", "points").agg(F.min_by(row, "whole").alias(row))
    kept = report.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), F.col("n_points").alias("k_points"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")) & (F.col("points") == F.col("k_points"))
    return sure.unionByName(marked.join(kept, same, "left_semi").select(F.col(row).alias("r")).select("r.*"))
