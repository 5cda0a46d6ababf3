"""Shared plumbing of the training-data operators.

* ``TextBlock``: a slice of an Arrow string column as one byte buffer with document offsets, on which word
  boundaries, line boundaries and hashes are computed with numpy, never per character in Python.
* ``Scratch`` (of ``sources.scratch``): intermediate tables in the folder that all executors share.
* ``salted_group_stats``: per-group aggregates brought back to the rows of the group without a hot task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch, released  # noqa: F401

# Python workers live on from stage to stage: freed memory should go back to the system at once.
pa.set_memory_pool(pa.system_memory_pool())
_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):  # large arrays are mapped by themselves, so they go back when they are freed, wherever they lie
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would grow with use
    _LIBC.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Returns memory that was freed to the system, where the C library can."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Bytes of text that are turned into arrays at once in a Python worker; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows of a hot group are dealt over this many sub-groups.
SALTS = 64

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1
_INVERSE = pow(_PRIME, -1, 1 << 64)

#: White space of the contracts: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---------------------------------------------------------------------------------------------- hashing


class _Powers:
    """Powers of the hash base and of its inverse; the worker keeps those that blocks of the usual size need."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = -(-n // _STEP) * _STEP
            base = np.full(size, _PRIME & _MASK64, U64)
            base[0] = 1
            inv = np.full(size, _INVERSE, U64)
            inv[0] = 1
            up, down = np.cumprod(base, dtype=U64), np.cumprod(inv, dtype=U64)
            if size > BLOCK_BYTES + _STEP:  # a very long text: not kept
                return up[:n], down[:n]
            cls.up, cls.down = up, down
        return cls.up[:n], cls.down[:n]


#: Powers are made so many at a time.
_STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h[i]``: polynomial hash state of the first i bytes, modulo 2**64."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the bytes [start, end), the same wherever they lie; lengths take part."""
    _, down = _Powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_raw(prefix: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position on, not mixed: its upper bits depend on all of them."""
    n = len(prefix) - width
    _, down = _Powers.get(len(prefix))
    return (prefix[width:] - prefix[:n]) * down[:n]


# ---------------------------------------------------------------------------------------------- texts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


class TextBlock:
    """Texts end to end as bytes; ``offs`` has the start of each, and the end of the last."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, pos, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def lowered(self) -> TextBlock:
        return TextBlock(LOWER[self.data], self.offs)

    def edges(self) -> np.ndarray:
        """Marks the first byte of every document that has one."""
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offs[:-1]] = True
        return first[: len(self.data)]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the maximal runs without white space."""
        data = self.data
        if not len(data):
            z = np.zeros(0, np.int64)
            return z, z, z
        solid, first = ~IS_SPACE[data], self.edges()
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, self.doc_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines split at line feeds; an empty document has no line here."""
        data = self.data
        if not len(data):
            z = np.zeros(0, np.int64)
            return z, z, z
        feed, first = data == 10, self.edges()
        begins = first.copy()
        begins[1:] |= feed[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        # the line feed that ends a line is not part of it
        return start, end - (data[end - 1] == 10), self.doc_of(start)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, TextBlock]]:
    """Slices of the batches whose texts hold about ``limit`` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        data, offs = text_buffers(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), TextBlock(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to
    give_back()


def binary_array(data: np.ndarray, offs: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow binary or string array over a byte buffer, without a Python object per row."""
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# ---------------------------------------------------------------------------------------------- bucket exchange


class BucketWriter:
    """Gathers fixed-width records of a task and hands them on as one binary row per bucket.

    A shuffle then moves a few large rows, not one row for each record; the reader gets numpy arrays back.
    """

    SCHEMA = "bucket int, n long, payload binary"

    def __init__(self, n_buckets: int, dtype: np.dtype, flush_bytes: int = 12 << 20):
        self.n_buckets, self.dtype, self.limit = n_buckets, np.dtype(dtype), flush_bytes
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append((bucket.astype(np.int32), records))
            self.bytes += records.nbytes + 4 * len(records)
        if self.bytes > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket = np.concatenate([b for b, _ in self.held])
        records = np.concatenate([r for _, r in self.held])
        self.held, self.bytes = [], 0
        order = np.argsort(bucket, kind="stable")
        records = records[order]
        counts = np.bincount(bucket, minlength=self.n_buckets)
        full = np.flatnonzero(counts)
        offs = np.concatenate([[0], np.cumsum(counts[full])])
        size = self.dtype.itemsize
        step = max(1, len(full) * (4 << 20) // max(1, records.nbytes))  # rows for batches of about 4 MB
        for a in range(0, len(full), step):
            b = min(len(full), a + step)
            part = records[offs[a] : offs[b]].view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full[a:b].astype(np.int32)), pa.array(counts[full[a:b]].astype(np.int64)), binary_array(part, (offs[a : b + 1] - offs[a]) * size)], names=["bucket", "n", "payload"]
            )


def read_payloads(table: pa.Table | pa.RecordBatch, dtype: np.dtype, column: str = "payload") -> np.ndarray:
    """All records of a bucket."""
    parts = [np.frombuffer(text_buffers(c)[0].tobytes(), dtype) for c in (table.column(column).chunks if isinstance(table, pa.Table) else [table.column(column)])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


#: Bytes that a task holds of one bucket, about.
BUCKET_BYTES = 8 << 20


def bucket_count(spark: SparkSession, expected_bytes: int, per_partition: int = 1) -> int:
    """Buckets for an exchange of so many bytes: by the bytes, so that what a task holds does not grow with the table, and
    no fewer than the shuffle partitions."""
    return max(per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(expected_bytes) // BUCKET_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col("`text`").cast("string")))).first()[0] or 0


def fresh(taken: list[str], stem: str) -> str:
    """A column name that none of ``taken`` has, in whatever case."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem = f"_{stem}"
    return stem


# ---------------------------------------------------------------------------------------------- groups


def salted_group_stats(df: DataFrame, keys: list[str], salt: Column, partial: dict[str, Column], merge: dict[str, Callable[[str], Column]], salts: int = SALTS) -> DataFrame:
    """Adds to each row aggregates over its group, whatever the size of the group.

    Rows are aggregated by (key, salt), those by key, and the result goes back to each (key, salt) that occurs, so
    a group with a third of all rows is spread over ``salts`` tasks both ways. Column ``_salt`` stays.
    """
    df = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    part = df.groupBy(*keys, "_salt").agg(*[c.alias(k) for k, c in partial.items()])
    whole = part.groupBy(*keys).agg(*[merge[k](k).alias(k) for k in partial], F.collect_list("_salt").alias("_salts"))
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    on = None
    back = back.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, "_salt"]], *partial)
    for k in [*keys, "_salt"]:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k in keys else F.col(k) == F.col(f"_r_{k}")
        on = e if on is None else on & e
    return df.join(back, on, "inner").drop(*[f"_r_{k}" for k in [*keys, "_salt"]])


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; extra columns of the input, however named, take no part."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()


# ---------------------------------------------------------------------------------------------- bounded filters


def _filter_bits(n: int) -> int:
    """Eight bits for each id, between 2**20 and 2**27 (16 MB): the size is bounded whatever the data."""
    return 1 << min(27, max(20, (8 * max(1, n)).bit_length()))


def id_filter(rows: DataFrame, ids: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int):
    """A bit filter, of bounded size, of the ids that ``ids`` finds in ``rows``; to be used with ``in_filter``.

    ``expected``: ids, at most. Where they would leave less than a bit to each, a filter would hold back little: there is
    none (a value of None), and all rows take the exact way behind it.
    """
    bits = _filter_bits(expected)
    if expected > bits:
        return rows.sparkSession.sparkContext.broadcast(None)
    piece = 1 << 13  # bytes

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(bits // 8, np.uint8)
        for x in ids(batches):
            x = (mix(x.astype(U64)) % U64(bits)).astype(np.int64)
            np.bitwise_or.at(raw, x >> 3, (1 << (7 - (x & 7))).astype(np.uint8))
        for i in np.flatnonzero(raw.reshape(-1, piece).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw[i * piece : (i + 1) * piece].tobytes()], pa.binary())], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("bits"):
            x = np.frombuffer(x.as_py(), np.uint8)
            total = x if total is None else total | x
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    raw = np.zeros(bits // 8, np.uint8)
    for part, x in rows.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        raw[part * piece : part * piece + len(x)] = np.frombuffer(x, np.uint8)
    return rows.sparkSession.sparkContext.broadcast((bits, raw))


def held_ids(held: tuple[int, np.ndarray] | None, ids: np.ndarray) -> np.ndarray:
    """Which ids a filter holds, some others included; all of them if there is none."""
    if held is None:
        return np.ones(len(ids), bool)
    bits, raw = held
    x = (mix(ids.astype(U64)) % U64(bits)).astype(np.int64)
    return (raw[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def in_filter(docs: DataFrame, held, inside: bool = True) -> DataFrame:
    """The rows whose doc_id the filter holds (or surely does not hold). Held ids may include some others."""
    at = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = held_ids(held.value, _doc_ids(b.column(at)))
            yield b.filter(pa.array(hit if inside else ~hit))

    return docs.mapInArrow(run, docs.schema)


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id is surely not in ``ids`` (a column doc_id), and those for which a join must tell."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield _doc_ids(b.column(0))

    held = id_filter(ids.select("doc_id"), found, ids.count())
    return in_filter(docs, held, inside=False), in_filter(docs, held)
