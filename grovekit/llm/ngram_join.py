"""Near-duplicate documents by an exact Jaccard join on word shingles, with filters under several token orders.

A document is the set of its distinct shingles, as 63-bit hashes. Two sets of Jaccard similarity t or more share a
token among the first ``n - ceil(t * n) + 1`` of each, under any total order of the tokens. So:

* equal sets (by 128 bits of their sums) are one class from the start, and only classes are joined;
* the first order puts tokens that recur within parts of the corpus last (a filter of bounded size, and a table of the
  most frequent; any order is exact, so they only save work) and the others in hash order; its prefixes go to buckets by
  token, where most tokens turn out to have one class and are forgotten;
* classes that share a prefix token under the first order are candidates: all pairs of a short list; for a long list pairs
  with its first class, and once these have been verified, the pairs that are not connected yet. A candidate must fit in
  size and in the places of the common token;
* candidates must then agree under each of the further orders, whose prefixes are taken along with the classes: they must
  share a prefix token there too, and as many as the similarity needs beside what lies behind the prefixes. Pairs that
  fail one order go; texts have not been touched by then. Parity sketches (an exact lower bound of the symmetric
  difference) hold back some that pass;
* those left are verified in full. Texts, not token sets, are brought together for that: they are smaller.

No link is lost; links within a component that add nothing are not all looked at. Components come from alternating
large-star and small-star rounds over written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, BucketWriter, Scratch, TextBlock, binary_array, blocks, bucket_count, give_back, held_ids, id_filter, in_filter, mix, prefix_hash, project, read_payloads, released, salted_group_stats, span_hash, split_by_ids, text_buffers, text_bytes

#: Words of a shingle; similarity as a fraction.
SHINGLE, SIM = 5, (75, 100)
#: Seeds of the token orders beside the first.
ORDERS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
#: Tokens of the frequency table, at most; classes with a token that bring it into the filter; tokens of the filter, at
#: most: the most frequent ones.
FREQUENT, FREQUENT_MIN, FILTERED = 1 << 16, 3, 1 << 24
#: Classes of a token up to which all pairs are candidates at once.
SHORT_LIST = 4
#: Classes of a long list that a task compares with one another, or with as many others, on average.
LIST_BLOCK = 2048
#: A token with more postings than this in what a task writes at once is split: its postings are dealt by class into
#: SPLIT lists, so no task holds the list of a token that a large part of the corpus has.
HOT_POSTINGS, SPLIT = 256, 64
#: Pairs, at most, that are broadcast (about 50 bytes each).
FEW_PAIRS = 200_000
#: Least bits of a parity sketch, a power of two; a sketch has four bits or more for each token.
SKETCH = 256
_SCAN_BYTES = 1 << 20
#: Classes that a task remembers to have met.
_SEEN = 1 << 20
_NULL_ID = np.iinfo(np.int64).min
#: A posting: token within its bucket, class, size of the set and place in it (up to 65,535: a filter only).
_POST = np.dtype([("t", "<u4"), ("c", "<u8", 2), ("n", "<u4"), ("i", "<u2")])
_HOT = np.dtype([("t", "<u8"), ("c", "<u8", 2), ("n", "<u4"), ("i", "<u2")])
_COUNT = np.dtype([("t", "<u8"), ("n", "<u8")])


def shingles(block: TextBlock, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Documents and tokens of the distinct shingles, ordered by document, then token."""
    block = block.lowered()
    start, end, doc = block.words()
    h = span_hash(prefix_hash(block.data), start, end)
    count = np.bincount(doc, minlength=block.n)
    m = len(h) - size + 1
    docs, keys = [], []
    if m > 0:
        key = np.zeros(m, np.uint64)
        for j in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
        ok = doc[:m] == doc[size - 1 :]
        docs.append(doc[:m][ok]), keys.append(mix(key[ok]))
    short = (count > 0) & (count < size)
    if short.any():  # the whole sequence is the only shingle
        first = np.concatenate([[0], np.cumsum(count)])[:-1][short]
        key = np.zeros(len(first), np.uint64)
        for j in range(size - 1):
            there = j < count[short]
            key[there] = key[there] * np.uint64(0x9E3779B97F4A7C15) + h[first[there] + j]
        docs.append(np.flatnonzero(short)), keys.append(mix(key + count[short].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, t = np.concatenate(docs), np.concatenate(keys) >> np.uint64(1)
    order = np.lexsort((t, d))
    d, t = d[order], t[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    return d[new], t[new]


def fingerprints(doc: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums over each set, as rows of two numbers; equal sets have equal sums."""
    out = np.empty((n, 2), np.uint64)
    edge = np.searchsorted(doc, np.arange(n + 1))
    for i, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        total = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(mix(token ^ np.uint64(seed)), dtype=np.uint64, out=total[1:])
        out[:, i] = mix(total[edge[1:]] - total[edge[:-1]])
    return out


def _class_array(c: np.ndarray) -> pa.Array:
    """Rows of two numbers as values of 16 bytes, which sort alike."""
    return binary_array(np.ascontiguousarray(c.astype(">u8")).view(np.uint8).reshape(-1), 16 * np.arange(len(c) + 1))


def _classes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(text_buffers(column)[0].tobytes(), ">u8").reshape(-1, 2).astype(np.uint64)


def _first_seen(cls: np.ndarray, seen: set[bytes]) -> np.ndarray:
    """Marks the rows whose class this task meets first (as far as it remembers)."""
    out = np.zeros(len(cls), bool)
    raw = np.ascontiguousarray(cls).tobytes()
    if len(seen) > _SEEN:
        seen.clear()
    for i in range(len(cls)):
        c = raw[16 * i : 16 * i + 16]
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _sketches(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the parity sketches, end to end, and their offsets: the parity of the tokens that fall on each bit.

    Bits are the last ones of a hash, so a longer sketch folds into a shorter one.
    """
    size = np.bincount(doc, minlength=n)
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(bits)])
    cell = edge[doc] + (mix(token).astype(np.int64) & (bits[doc] - 1))
    return np.packbits((np.bincount(cell, minlength=edge[-1]) & 1).astype(bool), bitorder="little"), edge // 8


def prefix_length(n, sim: tuple[int, int] = SIM):
    """Tokens of the prefix of a set of n."""
    return n - -(-sim[0] * n // sim[1]) + 1


def _order_key(token: np.ndarray, known: tuple) -> np.ndarray:
    """The first order: tokens that recur in no part by hash, then those of the filter, then the table by rising count."""
    held, frequent, rank = known
    low = token >> np.uint64(1)
    key = np.where(held_ids(held, token), low + np.uint64(1 << 62), low)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
        key = np.where(frequent[at] == token, np.uint64(1 << 63) + rank[at], key)
    return key


def _prefixes(doc: np.ndarray, token: np.ndarray, key: np.ndarray, n: int, sim: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Documents, tokens, sizes and places of the prefixes."""
    order = np.lexsort((key, doc))
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(doc)) - first[doc]
    head = place < prefix_length(count, sim)[doc]
    return doc[head], token[order][head], count[doc][head], place[head]


def _enough_left(n, i, m, j, sim: tuple[int, int]):
    """Whether sets of n and m tokens can be similar if their first common token has the places i and j.

    The overlap must be ``t / (1 + t) * (n + m)`` or more, and is at most what is left from that token on.
    """
    return sim[0] * (n + m) <= (sim[0] + sim[1]) * np.minimum(n - i, m - j)


def prefixes(doc: np.ndarray, token: np.ndarray, n: int, sim: tuple[int, int] = SIM) -> pa.Array:
    """For each set its prefixes under the further orders, one after another: the first 16 bits of each key, rising."""
    size = np.bincount(doc, minlength=n)
    p = np.where(size > 0, prefix_length(size, sim), 0)
    offs = np.concatenate([[0], np.cumsum(len(ORDERS) * p)])
    out = np.empty(offs[-1], "<u2")
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = np.arange(len(doc)) - first[doc]
    head = place < p[doc]
    for k, seed in enumerate(ORDERS):
        key = mix(token ^ np.uint64(seed))
        key = key[np.lexsort((key, doc))]
        out[(offs[:-1] + k * p)[doc[head]] + place[head]] = (key[head] >> np.uint64(48)).astype(np.uint16)
    return binary_array(out.view(np.uint8), 2 * offs)


class Profile:
    """What is known of a class without its text: the size of its set, the prefixes, the parity sketch."""

    __slots__ = ("n", "prefixes", "sketch")

    def __init__(self, n: int, raw: bytes, sketch: bytes):
        a = np.frombuffer(raw, "<u2")
        p = len(a) // len(ORDERS)
        self.n, self.prefixes, self.sketch = n, [a[k * p : (k + 1) * p] for k in range(len(ORDERS))], np.frombuffer(sketch, "<u8")


def agree_in_orders(x: Profile, y: Profile, sim: tuple[int, int] = SIM) -> bool:
    """Whether two sets may be similar by their prefixes under each further order.

    They must have a prefix token in common. Below the lower end of the two prefixes all tokens of both sets are known;
    those in common there and what either set has beside them must make up the overlap that the similarity needs. Keys are
    known by some bits, so tokens may seem to be in common that are not, and never the other way round.
    """
    need = sim[0] * (x.n + y.n)  # the overlap, times sim[0] + sim[1]
    for p, q in zip(x.prefixes, y.prefixes):
        both = np.sort(np.concatenate([p, q]))
        same = both[1:][both[1:] == both[:-1]]
        if not len(same):
            return False
        end = min(p[-1], q[-1])
        common = int(np.searchsorted(same, end))
        rest = min(x.n - int(np.searchsorted(p, end)), y.n - int(np.searchsorted(q, end)))
        if (sim[0] + sim[1]) * (common + rest) < need:
            return False
    return True


def agree_in_sketch(x: Profile, y: Profile, sim: tuple[int, int] = SIM) -> bool:
    """Whether the sketches, the longer one folded, differ in no more bits than the sets may: |x ^ y| is at most
    (1 - t) / (1 + t) * (|x| + |y|), and each token of one set alone changes one bit."""
    a, b = x.sketch, y.sketch
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (sim[1] + sim[0]) <= (sim[1] - sim[0]) * (x.n + y.n)


def _folded(column: pa.Array) -> pa.Array:
    """Sketches of half the length, of two bits or more for each token. Bits that differ in the folded ones differ in the
    whole ones, so nothing similar is held back."""
    words = [np.frombuffer(x, "<u8") for x in column.to_pylist()]
    return pa.array([(x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes() for x in words], pa.binary())


def jaccard_sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, cls (128 bits of the set); kind 1: payload of counts of frequent tokens."""
    docs = project(docs, doc_id="long", text="string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            r = np.empty(int((n > 1).sum()), _COUNT)
            r["t"], r["n"] = t[n > 1], n[n > 1]
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.array([None], pa.int64())] * 2, pa.array([None], pa.binary()), pa.array([r.tobytes()], pa.binary())], names=names)

        names = ["kind", "doc_id", "n", "cls", "payload"]
        for batch, block in blocks(batches, limit=_SCAN_BYTES):
            doc, token = shingles(block)
            cls = fingerprints(doc, token, block.n)
            count = np.bincount(doc, minlength=block.n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(block.n, np.int32)), batch.column(0), pa.array(count.astype(np.int64)), _class_array(cls), pa.nulls(block.n, pa.binary())], names=names)
            held.append(token[_first_seen(cls, seen)[doc]])
            size += len(held[-1])
            if size > 2_000_000:
                yield from frequent()
                held, size = [], 0
        if size:
            yield from frequent()
        held.clear(), seen.clear()
        give_back()

    return docs.mapInArrow(scan, "kind int, doc_id long, n long, cls binary, payload binary")


def _frequent_tokens(sets: DataFrame, size: int, scratch: Scratch) -> tuple:
    """What the first order goes by: a filter of the tokens that recur, and the most frequent ones with their ranks by
    count. Both are of bounded size."""
    spark = sets.sparkSession
    buckets = bucket_count(spark, size // 2)
    most, filtered = max(1, FREQUENT // buckets), max(1, FILTERED // buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = BucketWriter(buckets, _COUNT)
        for b in batches:
            r = read_payloads(b, _COUNT)
            yield from w.add((r["t"] % np.uint64(buckets)).astype(np.int32), r)
        yield from w.flush()

    def add(table: pa.Table) -> pa.Table:
        r = read_payloads(table, _COUNT)
        t, at = np.unique(r["t"], return_inverse=True)
        out = np.empty(len(t), _COUNT)
        out["t"], out["n"] = t, np.bincount(at, weights=r["n"]).astype(np.uint64)
        out = out[out["n"] >= FREQUENT_MIN]
        out = out[np.lexsort((out["t"], out["n"]))][-filtered:]
        top = out[-most:]
        return pa.table({"payload": pa.array([out.tobytes()], pa.binary()), "top": pa.array([top.tobytes()], pa.binary())})

    rows = scratch.save(sets.filter("kind = 1").select("payload").mapInArrow(deal, BucketWriter.SCHEMA).groupBy("bucket").applyInArrow(add, "payload binary, top binary"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield read_payloads(b, _COUNT)["t"]

    n_tokens = (rows.agg(F.sum(F.length("payload"))).first()[0] or 0) // _COUNT.itemsize
    held = id_filter(rows.select("payload"), tokens, n_tokens)
    # FREQUENT tokens at most, or the first one of each bucket where there are more buckets than that
    tops = [np.frombuffer(bytes(x[0]), _COUNT) for x in rows.orderBy(F.length("top").desc()).limit(FREQUENT).select("top").collect()]
    r = np.concatenate(tops) if tops else np.empty(0, _COUNT)
    rank = np.empty(len(r), np.uint64)
    rank[np.lexsort((r["t"], r["n"]))] = np.arange(len(r), dtype=np.uint64)
    order = np.argsort(r["t"])
    return held, r["t"][order], rank[order]


def _lists(r: np.ndarray, short: int, sim: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of postings: candidate pairs (rows of four numbers as two classes), and the postings of each token with more than
    ``short`` classes, or with a posting of size 0: the sign that its list is split.

    In a long list a class is paired with the first one, by size, that it may be similar to, and with the next in an order
    that differs from list to list, so that large groups are well connected at once.
    """
    r = r[np.lexsort((r["c"][:, 1], r["c"][:, 0], r["t"]))]
    same_t = np.zeros(len(r), bool)
    same_t[1:] = r["t"][1:] == r["t"][:-1]
    r = r[~(same_t & np.concatenate([[False], (r["c"][1:] == r["c"][:-1]).all(1)]))] if len(r) else r
    new = np.ones(len(r), bool)
    new[1:] = r["t"][1:] != r["t"][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(r)))
    split = np.add.reduceat(r["n"] == 0, start, dtype=np.int64) > 0 if len(start) else np.zeros(0, bool)
    a, b, long = [], [], []  # places of the postings
    for s in range(2, short + 1):
        rows = start[(size == s) & ~split]
        if len(rows):
            members = rows[:, None] + np.arange(s)[None, :]
            i, j = np.triu_indices(s, 1)
            a.append(members[:, i].ravel()), b.append(members[:, j].ravel())
    far = (size > short) | split
    for x, s in zip(start[far].tolist(), size[far].tolist()):
        members = x + np.lexsort((r["c"][x : x + s, 1], r["c"][x : x + s, 0], r["n"][x : x + s]))
        members = members[r["n"][members] > 0]
        s = len(members)
        if not s:
            continue
        n = r["n"][members].astype(np.int64)
        long.append(r[members])
        shuffled = members[np.argsort(mix(r["c"][members, 0] ^ r["t"][x]))]
        a.append(shuffled[:-1]), b.append(shuffled[1:])
        first = 0
        while first < s:
            last = int(np.searchsorted(n * sim[0], n[first] * sim[1], "right"))
            a.append(np.full(last - first - 1, members[first])), b.append(members[first + 1 : last])
            first = last
    if not a:
        z = np.zeros((0, 2), np.uint64)
        return z, z, long
    a, b = np.concatenate(a), np.concatenate(b)
    (n, i), (m, j) = ((r["n"][x].astype(np.int64), r["i"][x].astype(np.int64)) for x in (a, b))
    ok = _enough_left(n, i, m, j, sim)
    x, y = r["c"][a[ok]], r["c"][b[ok]]
    swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
    x, y = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
    order = np.lexsort((y[:, 1], y[:, 0], x[:, 1], x[:, 0]))
    x, y = x[order], y[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]).any(1) | (y[1:] != y[:-1]).any(1)
    return x[keep], y[keep], long


_FOUND = "a binary, b binary, list_id long, sub long, same binary, places long, members array<struct<cls:binary,n:long,i:long>>"


def _candidates(docs: DataFrame, known: tuple, size: int, sim: tuple[int, int]) -> DataFrame:
    """Rows a, b (candidate classes, a before b), or list_id, sub and members: up to LIST_BLOCK classes of a long list, with
    a digest of them, if they are the whole list, and the sum of their places."""
    spark = docs.sparkSession
    buckets = bucket_count(spark, size, 4)
    held, table = known[0], spark.sparkContext.broadcast(known[1:])
    docs = project(docs, doc_id="long", text="string")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = (held.value, *table.value)
        seen: set[bytes] = set()
        w, hot = BucketWriter(buckets, _POST), BucketWriter(buckets + SPLIT * buckets, _HOT)
        held_rows, count = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            r = np.concatenate(held_rows)
            held_rows.clear()
            t, at, n = np.unique(r["t"], return_inverse=True, return_counts=True)
            often = (n > HOT_POSTINGS)[at]
            if often.any():
                x = r[often]
                part = (mix(x["c"][:, 0]) % np.uint64(SPLIT)).astype(np.int64)
                yield from hot.add(buckets + part * buckets + (x["t"] % np.uint64(buckets)).astype(np.int64), x)
                sign = np.zeros(int((n > HOT_POSTINGS).sum()), _HOT)  # tells the bucket of the token
                sign["t"] = t[n > HOT_POSTINGS]
                r = np.concatenate([r[~often], sign])
            x = np.empty(len(r), _POST)
            x["t"], x["c"], x["n"], x["i"] = (r["t"] // np.uint64(buckets)).astype(np.uint32), r["c"], r["n"], r["i"]
            yield from w.add((r["t"] % np.uint64(buckets)).astype(np.int32), x)

        for _, block in blocks(batches, limit=_SCAN_BYTES):
            doc, token = shingles(block)
            cls = fingerprints(doc, token, block.n)
            mine = _first_seen(cls, seen)[doc]
            doc, token = doc[mine], token[mine]
            doc, token, n, place = _prefixes(doc, token, _order_key(token, order), block.n, sim)
            r = np.empty(len(doc), _HOT)
            r["t"], r["c"], r["n"], r["i"] = token, cls[doc], n, np.minimum(place, 65535)
            held_rows.append(r)
            count += len(r)
            if count > 400_000:
                yield from out()
                count = 0
        if held_rows:
            yield from out()
        yield from w.flush()
        yield from hot.flush()
        held_rows.clear(), seen.clear()
        give_back()

    def pair(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < buckets:
            r = read_payloads(t, _POST)
            whole = np.empty(len(r), _HOT)
            whole["t"], whole["c"], whole["n"], whole["i"] = r["t"].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), r["c"], r["n"], r["i"]
        else:  # the token's low bits: as its bucket has them
            r = read_payloads(t, _HOT)
            whole = r.copy()
            whole["t"] = ((r["t"] // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) + r["t"] % np.uint64(buckets)
        # a part of a split list is a list of its own, whatever its length
        a, b, long = _lists(whole, SHORT_LIST if bucket < buckets else 0, sim)
        pieces = [(int(x["t"][0]), (bucket // buckets << 32) + k, x[k : k + LIST_BLOCK]) for x in long for k in range(0, len(x), LIST_BLOCK)]
        none, kind = len(pieces), pa.list_(pa.struct([("cls", pa.binary()), ("n", pa.int64()), ("i", pa.int64())]))
        joined = np.concatenate([x for _, _, x in pieces]) if pieces else np.empty(0, _HOT)
        split = set(whole["t"][whole["n"] == 0].tolist())
        whole_list = {t for x in long for t in [int(x["t"][0])] if len(x) <= LIST_BLOCK and t not in split} if bucket < buckets else set()
        digest = [hashlib.md5(np.ascontiguousarray(x["c"]).tobytes() if t in whole_list else b"%d %d" % (t, sub)).digest() for t, sub, x in pieces]
        members = pa.StructArray.from_arrays([_class_array(joined["c"]), pa.array(joined["n"].astype(np.int64)), pa.array(joined["i"].astype(np.int64))], ["cls", "n", "i"])
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for _, _, x in pieces])]).astype(np.int32)), members)
        del r, whole, long, joined
        give_back()
        return pa.table({
            "a": pa.concat_arrays([_class_array(a), pa.nulls(none, pa.binary())]), "b": pa.concat_arrays([_class_array(b), pa.nulls(none, pa.binary())]),
            "list_id": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([x for x, _, _ in pieces], pa.int64())]),
            "sub": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([x for _, x, _ in pieces], pa.int64())]),
            "same": pa.concat_arrays([pa.nulls(len(a), pa.binary()), pa.array(digest, pa.binary())]),
            "places": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([int(x["i"].astype(np.int64).sum()) for _, _, x in pieces], pa.int64())]),
            "members": pa.concat_arrays([pa.nulls(len(a), kind), members.cast(kind)]),
        })

    return docs.mapInArrow(post, BucketWriter.SCHEMA).groupBy("bucket").applyInArrow(pair, _FOUND)


def similar(x: np.ndarray, y: np.ndarray, sim: tuple[int, int] = SIM) -> bool:
    """Whether two sets (sorted tokens) link."""
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return sim[1] * common >= sim[0] * (len(x) + len(y) - common)


def _ids_of(columns: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for k in columns:
                yield b.column(k).to_numpy()

    return run


def _texts_of(docs: DataFrame, ids: DataFrame, columns: tuple[int, ...]) -> DataFrame:
    """doc_id and text of the documents that the columns of ``ids`` name (and some others)."""
    wanted = id_filter(ids, _ids_of(columns), len(columns) * ids.count())
    return in_filter(project(docs, doc_id="long", text="string"), wanted)


def _profiles(docs: DataFrame, found: DataFrame, classes: DataFrame, scratch: Scratch, sim: tuple[int, int]) -> DataFrame:
    """cls, n, rep, prefixes, sketch of the classes that candidates and long lists have, out of the text of one document of
    each."""
    named = found.select(F.explode(F.when(F.col("a").isNotNull(), F.array("a", "b")).otherwise(F.col("members.cls"))).alias("cls")).distinct()
    wanted = scratch.save(classes.join(named, "cls").select("cls", "n", "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, block in blocks(batches, limit=_SCAN_BYTES):
            doc, token = shingles(block)
            cls = fingerprints(doc, token, block.n)
            mine = pa.array(_first_seen(cls, seen))
            sketch = binary_array(*_sketches(doc, token, block.n))
            yield pa.RecordBatch.from_arrays([x.filter(mine) for x in (_class_array(cls), prefixes(doc, token, block.n, sim), sketch)], names=["cls", "prefixes", "sketch"])
        seen.clear()
        give_back()

    made = _texts_of(docs, wanted.select("rep"), (0,)).mapInArrow(run, "cls binary, prefixes binary, sketch binary")
    made = made.groupBy("cls").agg(F.first(F.struct("prefixes", "sketch")).alias("s")).select("cls", "s.*")
    return scratch.save(wanted.join(made, "cls"))


def _in_pairs(pairs: DataFrame, profile: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """a, b, a_rep, b_rep: the candidate pairs (a, b) that sizes, the further orders and sketches leave."""
    side = lambda x: profile.select(F.col("cls").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "n", "prefixes", "sketch")])
    names = [f"{x}_{c}" for c in ("n", "prefixes", "sketch") for x in "ab"]

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for m, n, p, q, r, s in zip(*(b.column(4 + k).to_pylist() for k in range(6))):
                x, y = Profile(m, p, r), Profile(n, q, s)
                ok.append(agree_in_orders(x, y, sim) and agree_in_sketch(x, y, sim))
            yield b.select(["a", "b", "a_rep", "b_rep"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    # the parts of both sides that pairs need are brought together by pair; few pairs go to where the classes are
    few = pairs.count() <= FEW_PAIRS
    near = F.broadcast(pairs) if few else pairs
    fit = near.join(side("a"), "a").join(near.join(side("b"), "b"), ["a", "b"]).filter(F.least("a_n", "b_n") * sim[1] >= F.greatest("a_n", "b_n") * sim[0])
    return fit.select("a", "b", "a_rep", "b_rep", *names).mapInArrow(agree, "a binary, b binary, a_rep long, b_rep long")


def _in_lists(member: DataFrame, profile: DataFrame, sim: tuple[int, int], block: int = LIST_BLOCK) -> DataFrame:
    """a, b: pairs of one list and different labels that sizes, places and sketches leave.

    member: list_id, sub, cls, label, n, i, in pieces (list_id, sub) of bounded size. Classes of a list's commonest label
    are connected already, so pairs have one class of another label at least: those are dealt by class into blocks, and so
    are the former; each pair of blocks is a group of its own, so no task holds a whole list, and pairs that fail are never
    written. The work of a list grows with its size times the number of its classes that are not connected to the rest.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _folded(b.column(1))], names=["cls", "sketch"])

    by_label = member.groupBy("list_id", "label").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    lists = by_label.groupBy("list_id").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("n_top"), F.sum("c").alias("size")).filter("n_top < size")
    # the sizes of the classes beside the commonest label: what is similar to none of them by its size stays away
    beside = by_label.join(lists, "list_id").filter("label <> top").groupBy("list_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lists = lists.join(beside, "list_id")
    # to the pieces first: a piece is small, a list may not be
    pieces = member.select("list_id", "sub").distinct().join(lists, "list_id")
    near = (F.col("n") * sim[1] >= F.col("low") * sim[0]) & (F.col("n") * sim[0] <= F.col("high") * sim[1])
    # sketches are folded before they are sent to each list that has the class
    short = profile.select("cls", "sketch").mapInArrow(fold, "cls binary, sketch binary")
    rows = member.join(pieces, ["list_id", "sub"]).filter((F.col("label") != F.col("top")) | near).join(short, "cls")
    tops, others = F.ceil(F.col("n_top") / block), F.ceil((F.col("size") - F.col("n_top")) / block)
    is_top = F.col("label") == F.col("top")
    rows = rows.withColumn("own", F.when(is_top, F.pmod(F.xxhash64("cls"), tops)).otherwise(-1 - F.pmod(F.xxhash64("cls"), others)))
    rows = rows.withColumn("other", F.explode(F.when(is_top, F.sequence(-others, F.lit(-1).cast("long"))).otherwise(F.sequence(-others, tops - 1))))
    rows = rows.select("list_id", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cls", "label", "n", "i", "sketch")

    def pairs(t: pa.Table) -> pa.Table:
        n, i, own_block = (t.column(c).to_numpy() for c in ("n", "i", "own"))
        cls, label = t.column("cls").to_pylist(), np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True)[1]
        across = t.column("p")[0] != t.column("q")[0]
        sketch = [np.frombuffer(x.as_py(), "<u8") for x in t.column("sketch")]
        words = np.array([len(x) for x in sketch])
        row, matrix = np.zeros(len(words), np.int64), {}
        for w in np.unique(words).tolist():
            of = np.flatnonzero(words == w)
            row[of], matrix[w] = np.arange(len(of)), np.stack([sketch[k] for k in of.tolist()])
        order = np.lexsort((label, n))
        out: list[tuple] = []
        for at in range(len(order)):
            x = order[at]
            last = int(np.searchsorted(n[order] * sim[0], n[x] * sim[1], "right"))
            y = order[at + 1 : last]
            y = y[(label[y] != label[x]) & _enough_left(n[x], i[x], n[y], i[y], sim)]
            if across:
                y = y[own_block[y] != own_block[x]]
            for w, m in matrix.items():  # longer sketches fold to the length of the shorter
                part = y[words[y] == w]
                if not len(part):
                    continue
                theirs, own = m[row[part]], sketch[x]
                while theirs.shape[1] > len(own):
                    theirs = theirs[:, : theirs.shape[1] // 2] ^ theirs[:, theirs.shape[1] // 2 :]
                while len(own) > theirs.shape[1]:
                    own = own[: len(own) // 2] ^ own[len(own) // 2 :]
                apart = np.bitwise_count(theirs ^ own).sum(1).astype(np.int64)
                for k in part[apart * (sim[1] + sim[0]) <= (sim[1] - sim[0]) * (n[x] + n[part])].tolist():
                    out.append((cls[x], cls[k]) if cls[x] < cls[k] else (cls[k], cls[x]))
        matrix.clear()
        give_back()
        return pa.table({c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate("ab")})

    return rows.groupBy("list_id", "p", "q").applyInArrow(pairs, "a binary, b binary").distinct()


def _verified(near: DataFrame, docs: DataFrame, scratch: Scratch, sim: tuple[int, int]) -> DataFrame:
    """Of near pairs (a, b, a_rep, b_rep) those that link, by their texts."""
    near = scratch.save(near)
    found = _texts_of(docs, near.select("a_rep", "b_rep"), (0, 1)).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a few pairs at a time: texts may be long
                b = batch.slice(at, 64)
                at += b.num_rows
                sides = []
                for column in (2, 3):
                    block = TextBlock(*text_buffers(b.column(column)))
                    doc, token = shingles(block)
                    sides.append((token, np.searchsorted(doc, np.arange(block.n + 1)), fingerprints(doc, token, block.n)))
                (x, i, cx), (y, j, cy) = sides
                # a row that repeats an id with another text is not the one meant
                meant = (cx == _classes(b.column(0))).all(1) & (cy == _classes(b.column(1))).all(1)
                ok = [bool(m) and similar(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], sim) for k, m in enumerate(meant)]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    whole = near.join(found.select(F.col("doc_id").alias("a_rep"), F.col("text").alias("x")), "a_rep").join(found.select(F.col("doc_id").alias("b_rep"), F.col("text").alias("y")), "b_rep")
    return scratch.save(whole.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary").distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the least node of the component, for every node of an edge (a, b). Nothing is collected, and the rows
    of a node with very many neighbours are spread over tasks."""
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spread = lambda df: salted_group_stats(df, ["u"], F.xxhash64("v"), {"m": F.min("v")}, {"m": F.min}, 16)
    before = None
    while True:
        # large star: neighbours above u, and u's least neighbour
        both = spread(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, linked to the least of them
        low = spread(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, sim: tuple[int, int] = SIM) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts without words, null ones included, have empty sets and link with nothing. Rows with one doc_id count as one
    document, so their classes are linked; a null doc_id comes before all others. A very long text is shingled whole. Extra
    columns take no part; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = text_bytes(docs)
    sets = scratch.save(jaccard_sets(docs).withColumn("row", F.monotonically_increasing_id()))
    base = sets.filter("kind = 0").select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "n", "cls", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("_salt"))
    one = base.filter("n > 0").groupBy("cls", "_salt").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    classes = scratch.save(one.groupBy("cls").agg(F.min("rep").alias("rep"), F.min("n").alias("n"), F.collect_list("_salt").alias("salts")))
    found = scratch.save(_candidates(docs, _frequent_tokens(sets, size, scratch), size, sim))
    profile = _profiles(docs, found, classes, scratch, sim)
    edges = _verified(_in_pairs(scratch.save(found.filter("a IS NOT NULL").select("a", "b").distinct()), profile, sim), docs, scratch, sim)
    # ids that have several classes, or one and an empty set
    shared = base.groupBy("doc_id").agg(F.min(F.when(F.col("n") > 0, F.col("cls"))).alias("low"), F.max(F.when(F.col("n") > 0, F.col("cls"))).alias("high"), F.min("n").alias("least"))
    shared = scratch.save(shared.filter("low < high OR (low IS NOT NULL AND least = 0)"))
    repeats = shared.limit(1).count() > 0
    if repeats:
        edges = scratch.save(edges.unionByName(base.filter("n > 0").select("doc_id", F.col("cls").alias("b")).join(shared.select("doc_id", F.col("low").alias("a")), "doc_id").filter("a <> b").select("a", "b").distinct()))
    labels = components(edges, scratch)
    long = found.filter("members IS NOT NULL")
    # of lists with the same classes the one of the first token in the order will do: places are the least in it
    first = long.groupBy("same").agg(F.min_by(F.struct("list_id", "sub"), F.struct("places", "list_id", "sub")).alias("f")).select("f.*")
    long = long.join(first, ["list_id", "sub"], "left_semi").select("list_id", "sub", "members")
    if long.limit(1).count():
        # pairs of a long list that are not connected yet
        member = long.select("list_id", "sub", F.explode("members").alias("m")).select("list_id", "sub", "m.*")
        member = scratch.save(member.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")))
        more = _verified(_in_pairs(scratch.save(_in_lists(member, profile, sim)), profile, sim), docs, scratch, sim)
        if more.limit(1).count():
            labels = components(edges.unionByName(more), scratch)
    # from classes to the smallest doc_id of a component, and to all documents
    known = classes.select("cls", "rep", "salts").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    known = scratch.save(salted_group_stats(known, ["label"], F.xxhash64("cls"), {"component_id": F.min("rep")}, {"component_id": F.min}).drop("_salt"))
    of_class = known.select(F.col("cls").alias("_cls"), F.explode("salts").alias("_s"), "component_id")
    full = base.filter("n > 0").join(of_class, (F.col("cls") == F.col("_cls")) & (F.col("_salt") == F.col("_s"))).select("doc_id", "n", "component_id")
    none = base.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    if repeats:
        of_id = shared.filter("least = 0").select("doc_id", F.col("low").alias("cls")).join(known, "cls").select("doc_id", F.col("component_id").alias("_of"))
        none = none.join(of_id, "doc_id", "left").select("doc_id", "n", F.coalesce("_of", "component_id").alias("component_id"))
    out = full.unionByName(none)
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return out.select(null("doc_id"), F.col("n").alias("n_shingles"), null("component_id"))


def near_dedup(docs: DataFrame, sim: tuple[int, int] = SIM) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns as they are.

    Rows that repeat the doc_id that stays all stay, with whatever texts; so do rows without a doc_id, and documents without
    words. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    with released():
        dropped = scratch.save(near_duplicates(docs, sim).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    sure, maybe = split_by_ids(docs, dropped)
    return sure.unionByName(maybe.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]))
