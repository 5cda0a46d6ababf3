"""A Merkle manifest of a dataset: one root for all rows, and for every row a proof that it is under that root.

Rows are leaves. Those of a group (``source``), in the order of their ids, make a tree in which every three consecutive
nodes become their hash; the groups' roots, in the order of the groups, make a tree in the same way. The work:

1. The leaves are sorted by range into partitions. Counts by partition and group give each partition the place of its first
   leaf within its group, so the partition knows which nodes above its leaves are complete in it, and builds those.
2. At either end of a partition nodes are left whose siblings lie in other partitions: a few for each level. Only these are
   shuffled, by their coordinates (group, level, place), in chunks that a few dozen partitions have a share in; a chunk
   finishes the levels below its top, and tops go into the chunks above, until each group has its root.
3. The groups' roots are dealt into aligned blocks, in which whole subtrees are made, block roots again, and so on.
4. Each partition asks for the nodes that it lacks (a few for each level), builds its own again, and returns the proofs.

Through the driver go counts by partition, never nodes; no group is ever in one task, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bucket_count

#: Nodes that become one, and hex digits of a digest.
ARITY, HEX = 3, 64
#: Bytes of a leaf in a partition, about; levels of a chunk beyond those within one partition, and of later chunks and blocks.
LEAF_BYTES, WIDER, STEP = 160, 3, 6
#: Rows of proofs that are handed on at once.
PROOF_ROWS = 2048
_PART_BITS = 33  # of the row numbers that Spark gives: those above are the partition


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and the value; null as a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)).cast("binary"), 256)


def document_leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of each row of documents, in hex; ``text`` in place of its own text."""
    own = {c: F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text")}
    return leaf_digest(own["doc_id"].cast("long"), own["source"], own["lang"], own["n_chars"].cast("long"), own["text"] if text is None else text)


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _above(n: int) -> int:
    return -(-n // ARITY)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    out = 0
    while n > 1:
        n, out = _above(n), out + 1
    return out


class Span:
    """The consecutive leaves [first, first + n) of a tree of ``total`` leaves, and all nodes above that are complete in them.

    ``levels[l]``: place of the first complete node of level l, the place behind the last, their digests, and the nodes that
    this level has in the whole tree.
    """

    def __init__(self, digests: bytes, first: int, total: int):
        self.first, self.n = first, len(digests) // HEX
        a, b, count = first, first + self.n, total
        self.levels = [(a, b, digests, count)]
        while count > 1:
            # a run is complete if all its nodes are here; the last one of a level may be short
            up, to = _above(a), _above(b) if b == count else b // ARITY
            to = max(up, to)
            begin, wide = (up * ARITY - a) * HEX, ARITY * HEX
            digests = b"".join([_sha(digests[k : k + wide]) for k in range(begin, begin + (min(to * ARITY, count) - up * ARITY) * HEX, wide)]) if to > up else b""
            a, b, count = up, to, _above(count)
            self.levels.append((a, b, digests, count))

    def ragged(self) -> Iterator[tuple[int, int, bytes]]:
        """Level, place and digest of the complete nodes whose parents are not complete here; the root is none."""
        for level, ((a, b, digests, _), (up, to, _, _)) in enumerate(zip(self.levels, self.levels[1:])):
            inner = (up * ARITY, to * ARITY) if up < to else (b, b)
            for i in (*range(a, min(inner[0], b)), *range(max(inner[1], a), b)) if up < to else range(a, b):
                yield level, i, digests[(i - a) * HEX : (i - a + 1) * HEX]

    def reach(self, level: int) -> tuple[int, int]:
        """First and last node of a level above these leaves, complete or not."""
        return self.first // ARITY**level, (self.first + self.n - 1) // ARITY**level

    def lacking(self) -> Iterator[tuple[int, int]]:
        """Level and place of the nodes beside the paths of these leaves that are not complete here."""
        for level, (a, b, _, count) in enumerate(self.levels[:-1]):
            low, high = self.reach(level)
            for i in range(low // ARITY * ARITY, min(high // ARITY * ARITY + ARITY, count)):
                if not a <= i < b:
                    yield level, i

    def siblings(self, others: dict[tuple[int, int], bytes]) -> tuple[list[bytes], list[bytes], list[tuple[int, int]]]:
        """Digests to the left and to the right of each node above these leaves, level by level from below, and where in the
        lists each level begins and which place is its first. ``others``: the digests of those that are lacking."""
        left, right, at = [], [], []
        for level, (a, b, digests, count) in enumerate(self.levels[:-1]):
            low, high = self.reach(level)
            begin, end = low // ARITY * ARITY, min(high // ARITY * ARITY + ARITY, count)
            whole = b"".join([others[level, i] for i in range(begin, min(a, end) if a < b else end)]) + digests
            if a < b:
                whole += b"".join([others[level, i] for i in range(b, end)])
            at.append((len(left), low))
            for i in range(low, high + 1):
                run = i // ARITY * ARITY
                k, s, e = (i - begin) * HEX, (run - begin) * HEX, (min(run + ARITY, count) - begin) * HEX
                left.append(whole[s:k])
                right.append(whole[k + HEX : e])
        return left, right, at


def _hex(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else x for x in column.to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:]):
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != int(column[x]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


_NODE = "kind int, gid long, total long, level int, place long, part long, digest string"
_NAMES = [x.split()[0] for x in _NODE.split(", ")]
_LACKED, _KNOWN, _ROOT = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=_NAMES)


def _finisher(top: int):
    return lambda table: _finish(table, top)


def _finish(table: pa.Table, top: int) -> pa.Table:
    """One chunk: from its nodes, of levels below ``top``, all above them up to its top or the root."""
    gid, total = table.column("gid")[0].as_py(), table.column("total")[0].as_py()
    known = dict(zip(zip(table.column("level").to_pylist(), table.column("place").to_pylist()), _hex(table.column("digest"))))
    by_level: dict[int, set[int]] = {}
    for level, i in known:
        by_level.setdefault(level, set()).add(i)
    counts = [total]
    while counts[-1] > 1:
        counts.append(_above(counts[-1]))
    out = []
    for level in range(min(by_level), min(top, len(counts) - 1)):
        for up in sorted({i // ARITY for i in by_level.get(level, ())}):
            digest = _sha(b"".join(known[level, i] for i in range(up * ARITY, min(up * ARITY + ARITY, counts[level]))))
            known[level + 1, up] = digest
            by_level.setdefault(level + 1, set()).add(up)
            out.append((_ROOT if counts[level + 1] == 1 else _KNOWN, gid, total, level + 1, up, None, digest.decode()))
    return pa.Table.from_batches([_batch(out)])


def _finished(scratch: Scratch, nodes: DataFrame, rows_a_part: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """All nodes that some partition may lack, and the roots of the groups that lie in several partitions."""
    known = nodes.filter(F.col("kind") == _KNOWN)
    low, top, tall = 0, height(max(1, rows_a_part)) + WIDER, height(largest)
    every, tops = known, None
    while low < tall:
        now = known.filter((F.col("level") >= low) & (F.col("level") < top))
        if tops is not None:
            now = now.unionByName(tops)
        chunk = F.expr(f"place div element_at(array({', '.join(f'{ARITY**k}L' for k in range(1, top + 1))}), {top} - level)")
        made = scratch.save(now.withColumn("chunk", chunk).groupBy("gid", "chunk").applyInArrow(_finisher(top), _NODE))
        every = every.unionByName(made)
        tops = made.filter((F.col("kind") == _KNOWN) & (F.col("level") == top))
        low, top = top, top + STEP
    return every.filter(F.col("kind") == _KNOWN), every.filter(F.col("kind") == _ROOT)


def _block(table: pa.Table, total: int, step: int) -> pa.Table:
    """One aligned block of a tree: for each node the siblings on its way to the block's top, and the top."""
    order = np.argsort(table.column("place").to_numpy())
    place = table.column("place").to_numpy()[order]
    digests = b"".join(_hex(table.column("digest").take(pa.array(order))))
    n, first = len(order), int(place[0])
    # within its block a node's run is as in the whole tree: blocks begin at multiples of a power of the arity, and only the last one is short
    span = Span(digests, 0, n)
    levels = min(step, height(total))
    left, right, at = span.siblings({})
    rows: list[tuple] = []
    for k in range(n):
        where = [b + k // ARITY**level - low for level, (b, low) in enumerate(at)]
        rows.append(([left[x].decode() for x in where], [right[x].decode() for x in where]))
    top = span.levels[-1][2]
    for _ in range(len(at), levels):  # a short last block: its top is alone in its runs
        rows = [(x + [""], y + [""]) for x, y in rows]
        top = _sha(top)
    names = ["place", "digest", "lefts", "rights", "block", "top"]
    lists = pa.list_(pa.string())
    columns = [pa.array(place), table.column("digest").take(pa.array(order)), pa.array([x for x, _ in rows], lists), pa.array([y for _, y in rows], lists), pa.array([first // ARITY**step] * n, pa.int64()), pa.array([top.decode()] * n)]
    return pa.table(dict(zip(names, columns)))


def _upper_proofs(scratch: Scratch, nodes: DataFrame, total: int) -> DataFrame:
    """place, digest, lefts, rights (siblings by level, up to the root) and root, of the ``total`` leaves (place, digest) of one tree."""
    kind = "place long, digest string, lefts array<string>, rights array<string>, block long, top string"
    step = STEP
    made = scratch.save(nodes.withColumn("block", F.expr(f"place div {ARITY**step}L")).groupBy("block").applyInArrow(lambda t: _block(t, total, step), kind))
    blocks = -(-total // ARITY**step)
    if blocks <= 1:
        return made.withColumnRenamed("top", "root").drop("block")
    over = _upper_proofs(scratch, made.select(F.col("block").alias("place"), F.col("top").alias("digest")).distinct(), blocks)
    over = over.select(F.col("place").alias("block"), F.col("lefts").alias("l"), F.col("rights").alias("r"), "root")
    return made.join(over, "block").select("place", "digest", F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"), "root")


def manifest(docs: DataFrame, leaf: Column, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, the group, leaf (64 hex digits), place (of the leaf in its group, from 0), subroot (of
    the group), root, proof (by level from below, through the subroot to the root: the digests to the left and to the right of
    the node on the way, end to end) and the columns of ``carry``.

    Groups are ordered by the bytes of their names, null first; leaves within a group by key, null first, and those of one key
    by leaf, so repeated rows and keys have a fixed order. Texts are hashed where they are read, whole, and never moved.
    Further columns of ``docs`` take no part, whatever their names. An empty table has an empty manifest.
    """
    spark, scratch, carry = docs.sparkSession, Scratch(docs.sparkSession), carry or {}
    kept = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(f"`{group}`").cast("string").alias("source"), F.col(f"`{key}`").cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.monotonically_increasing_id().alias("row"),
        *[c.alias(k) for k, c in zip(kept, carry.values())],
    )
    rows = scratch.save(rows)  # texts are read once: sorting by range reads its rows twice
    by = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf", "row"]
    n_rows = rows.count()
    n = bucket_count(spark, n_rows * LEAF_BYTES)
    base = scratch.save(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("row").withColumn("at", F.monotonically_increasing_id()))
    scratch.drop(rows)
    base = base.withColumn("part", F.shiftright("at", _PART_BITS))

    # counts by partition and group: where in its group a partition's first leaf is
    count = base.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    before = Window.partitionBy("source").orderBy("part")
    count = count.withColumn("first", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    count = scratch.save(count)
    # groups that begin in each partition, a row for each partition: their running sum numbers the groups in their order
    begun = sorted((r.part, r.begun, r.largest) for r in count.groupBy("part").agg(F.sum((F.col("first") == 0).cast("long")).alias("begun"), F.max("total").alias("largest")).collect())
    starts, groups = [], 0
    for part, more, _ in begun:
        starts.append((part, groups))
        groups += more
    starts = spark.createDataFrame(starts, "part long, earlier long")
    gid = F.col("earlier") - 1 + F.sum((F.col("first") == 0).cast("long")).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    count = scratch.save(count.join(starts, "part").select("part", "at", "n", "first", "total", gid.alias("gid")))

    side = ["gid", "first", "n", "total"]
    leaves = base.select("part", F.lit(1).alias("kind"), "at", F.lower(F.hex("leaf")).alias("digest"))
    local = leaves.unionByName(count.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches, "part"):
            part, out, start = t.column("part")[0].as_py(), [], 0
            spans = t.filter(pc.equal(t.column("kind"), 0)).select(side).to_pylist()
            digests = b"".join(_hex(t.filter(pc.equal(t.column("kind"), 1)).column("digest")))
            for s in spans:
                span = Span(digests[start : start + s["n"] * HEX], s["first"], s["total"])
                start += s["n"] * HEX
                if s["n"] == s["total"]:
                    out.append((_ROOT, s["gid"], s["total"], 0, 0, None, span.levels[-1][2].decode()))
                else:
                    out += [(_KNOWN, s["gid"], s["total"], level, i, None, x.decode()) for level, i, x in span.ragged()]
                    out += [(_LACKED, s["gid"], s["total"], level, i, part, None) for level, i in span.lacking()]
            yield _batch(out)

    dealt = lambda df: df.repartition(n, "part").sortWithinPartitions("part", "kind", "at")
    nodes = scratch.save(dealt(local).mapInArrow(build, _NODE))
    known, roots = _finished(scratch, nodes, n_rows // max(1, len(begun)), max([x for _, _, x in begun], default=0))
    roots = nodes.filter(F.col("kind") == _ROOT).unionByName(roots)
    upper = _upper_proofs(scratch, roots.select(F.col("gid").alias("place"), "digest"), groups)
    found = nodes.filter(F.col("kind") == _LACKED).drop("digest", "kind", "total").join(known.select("gid", "level", "place", "digest"), ["gid", "level", "place"])
    heads = count.join(upper.withColumnRenamed("place", "gid"), "gid").withColumnRenamed("digest", "subroot")

    whole = base.select("part", F.lit(2).alias("kind"), "at", "source", "id", F.lower(F.hex("leaf")).alias("digest"), *kept)
    whole = whole.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True).unionByName(heads.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    text, number = T.StringType(), T.LongType()
    step = T.ArrayType(T.StructType([T.StructField("left", text), T.StructField("right", text)]))
    kinds = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([T.StructField("id", number), T.StructField("source", text), T.StructField("digest", text), T.StructField("place", number), T.StructField("subroot", text), T.StructField("root", text), T.StructField("proof", step), *[T.StructField(c, kinds[c]) for c in kept]])
    names, wide = schema.names, whole.select("source", "id", "digest", *kept).columns

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches, "part"):
            kind = t.column("kind").to_numpy()
            a, b = (int(np.searchsorted(kind, k)) for k in (1, 2))
            others: dict[int, dict] = {}
            for r in t.slice(0, a).select(["gid", "level", "place", "digest"]).to_pylist():
                others.setdefault(r["gid"], {})[r["level"], r["place"]] = r["digest"].encode()
            rows = t.slice(b).select(wide).combine_chunks()
            start = 0
            for s in t.slice(a, b - a).select([*side, "subroot", "root", "lefts", "rights"]).to_pylist():
                own = rows.slice(start, s["n"])
                start += s["n"]
                span = Span(b"".join(_hex(own.column("digest"))), s["first"], s["total"])
                left, right, at = span.siblings(others.get(s["gid"], {}))
                base_at = len(left)
                left, right = pa.array([*(x.decode() for x in left), *s["lefts"]], pa.string()), pa.array([*(x.decode() for x in right), *s["rights"]], pa.string())
                deep, high = len(at), len(s["lefts"])
                for x in range(0, s["n"], PROOF_ROWS):
                    piece = own.slice(x, PROOF_ROWS)
                    place = np.arange(s["first"] + x, s["first"] + x + piece.num_rows)
                    where = np.empty((len(place), deep + high), np.int64)
                    for level, (begin, low) in enumerate(at):
                        where[:, level] = begin + place // ARITY**level - low
                    where[:, deep:] = base_at + np.arange(high)
                    where = pa.array(where.ravel())
                    steps = pa.StructArray.from_arrays([left.take(where), right.take(where)], names=["left", "right"])
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * (deep + high), pa.int32()), steps)
                    columns = {"id": piece.column("id"), "source": piece.column("source"), "digest": piece.column("digest"), "place": pa.array(place), "subroot": pa.array([s["subroot"]] * len(place), pa.string()), "root": pa.array([s["root"]] * len(place), pa.string()), "proof": proof}
                    yield from pa.table([columns[c] if c in columns else piece.column(c) for c in names], names=names).to_batches()

    out = dealt(whole).mapInArrow(prove, schema)
    back = {"id": key, "source": group, "digest": "leaf"} | dict(zip(kept, carry))
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in names])


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all digests of a proof, from below, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]).cast("binary"), 256))
