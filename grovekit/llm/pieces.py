"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary (pieces, scores, kinds) is read from a ``.model`` file; nothing is trained. White space is marked
with U+2581 and a mark is put before the text. A character that no piece covers is spelled in byte pieces. No piece
has a mark after another character, so the best path never crosses into a mark from one: a text falls into segments
(marks, then other characters) that are encoded alone. The distinct segments of a block of text are encoded
together, one array operation for each byte position; long segments are encoded one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TextBlock, blocks, prefix_hash, project, span_hash

#: Vocabulary of the query.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Below the least score of a piece: what an unknown character costs.
UNKNOWN_PENALTY = 10.0
#: Segments longer than this many bytes are encoded one by one.
LONG = 192
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte c is ``base[s] + c``, if its ``check`` is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[bytes, list[int]] = {}
        for k in keys:
            for i in range(len(k)):
                children.setdefault(k[:i], [])
                children.setdefault(k[: i + 1], [])
                if not children[k[:i]] or children[k[:i]][-1] != k[i]:
                    children[k[:i]].append(k[i])
        children = {k: sorted(set(v)) for k, v in children.items()}
        children.setdefault(b"", [])
        size = max(4096, 4 * len(children) + 512)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[:257] = False  # so that no base is negative
        queue, lowest = [(b"", 0)], 257
        for prefix, node in queue:
            codes = np.array(children[prefix], np.int64)
            if prefix in keys:
                self.value[node] = keys[prefix]
            if not len(codes):
                self.base[node] = 0
                continue
            if lowest + 1024 >= size:
                free, size = self._grow(free)
            while not free[lowest]:
                lowest += 1
            if len(codes) == 1:  # the first free slot will do
                b = lowest - int(codes[0])
            else:  # the first base where all children are free; bases are tried many at a time
                b = max(lowest, 1) - int(codes[0])
                while True:
                    if b + 2048 >= size:
                        free, size = self._grow(free)
                    tries = np.arange(b, b + 1024)
                    ok = free[tries + codes[0]]
                    for c in codes[1:].tolist():
                        ok &= free[tries + c]
                    if ok.any():
                        b += int(ok.argmax())
                        break
                    b += 1024
            self.base[node] = b
            for c in codes.tolist():
                free[b + c] = False
                self.check[b + c] = node
                queue.append((prefix + bytes([c]), b + c))
        end = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()

    def _grow(self, free: np.ndarray) -> tuple[np.ndarray, int]:
        n = len(free)
        self.base, self.check, self.value = (np.concatenate([x, np.full(n, f, np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
        return np.concatenate([free, np.ones(n, bool)]), 2 * n


@dataclass
class Vocabulary:
    trie: DoubleArray
    scores: np.ndarray
    #: id of the piece of each byte value.
    byte_ids: np.ndarray
    unknown_score: float
    longest: int
    #: Bytes that each id decodes to, end to end, and their offsets; marks are spaces.
    plain: np.ndarray
    plain_offs: np.ndarray


def load(model: str | bytes) -> Vocabulary:
    """Reads a vocabulary from a model file, or from its bytes."""
    raw = model if isinstance(model, bytes) else open(model, "rb").read()
    pieces: list[tuple[bytes, float, int]] = []
    for field, value in _fields(raw):
        if field == 1:
            parts = dict(_fields(value))
            pieces.append((parts.get(1, b""), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, _NORMAL)))
    return vocabulary(pieces)


def vocabulary(pieces: list[tuple[bytes, float, int]]) -> Vocabulary:
    """Of (piece, log score, kind) by id. All 256 byte pieces must be there."""
    byte_ids, keys, plain = np.full(256, -1, np.int64), {}, []
    for i, (piece, _, kind) in enumerate(pieces):
        if kind == _BYTE:
            byte_ids[int(piece[3:-1], 16)] = i
            plain.append(bytes([int(piece[3:-1], 16)]))
        elif kind in (_NORMAL, _USER):
            if MARK in piece.decode().lstrip("▁").encode():
                raise ValueError(f"piece {i} has a white space mark after another character")
            keys.setdefault(piece, i)
            plain.append(piece.replace(MARK, b" "))
        else:
            plain.append(b"")
    if byte_ids.min() < 0:
        raise ValueError("byte fallback needs all 256 byte pieces")
    scores = np.array([s for _, s, _ in pieces])
    used = [s for _, s, k in pieces if k == _NORMAL]
    return Vocabulary(DoubleArray(keys), scores, byte_ids, min(used) - UNKNOWN_PENALTY, max(map(len, keys)), np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])]))


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def encode_one(vocab: Vocabulary, segment: bytes) -> list[int]:
    """Ids of one segment, marks included: the path of the highest score; of equal ones the first found."""
    n = len(segment)
    base, check, value = vocab.trie.base.tolist() if n > 4096 else vocab.trie.base, vocab.trie.check, vocab.trie.value
    best: list[float] = [-np.inf] * (n + 1)
    back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    best[0], s = 0.0, 0
    while s < n:
        lead = segment[s]
        step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        node, single = 0, False
        for e in range(s, min(n, s + vocab.longest)):
            child = int(base[node]) + segment[e]
            if check[child] != node:
                break
            node = child
            if value[node] >= 0:
                single |= e + 1 - s == step
                got = best[s] + float(vocab.scores[value[node]])
                if got > best[e + 1]:
                    best[e + 1], back[e + 1] = got, (s, int(value[node]))
        if not single and best[s] + vocab.unknown_score > best[s + step]:
            best[s + step], back[s + step] = best[s] + vocab.unknown_score, (s, -1)
        s += step
    out: list[int] = []
    while n:
        s, i = back[n]
        out += [i] if i >= 0 else [int(vocab.byte_ids[b]) for b in segment[s:n][::-1]]
        n = s
    return out[::-1]


def _encode_many(vocab: Vocabulary, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments given as the padded rows of a byte matrix: flat, and the count of each."""
    w, wide = rows.shape
    base, check, value = vocab.trie.base, vocab.trie.check, vocab.trie.value
    best = np.full((w, wide + 1), -np.inf)
    best[:, 0] = 0
    from_, by = np.zeros((w, wide + 1), np.int16), np.full((w, wide + 1), -1, np.int32)
    for s in range(wide):
        idx = np.flatnonzero((size > s) & ((rows[:, s] & 0xC0) != 0x80))
        if not len(idx):
            continue
        all_, here = idx, best[idx, s]
        step = _char_bytes(rows[idx, s])
        single = np.zeros(len(idx), bool)
        node, local = np.zeros(len(idx), np.int64), np.arange(len(idx))
        for e in range(s, min(wide, s + vocab.longest)):
            child = base[node] + rows[idx, e].astype(np.int64)
            go = (check[child] == node) & (size[idx] > e)
            if not go.any():
                break
            idx, node, local = idx[go], child[go], local[go]
            v = value[node]
            ends = np.flatnonzero(v >= 0)
            if len(ends):
                r, l, v = idx[ends], local[ends], v[ends]
                single[l] |= step[l] == e + 1 - s
                got = here[l] + vocab.scores[v]
                won = got > best[r, e + 1]
                r = r[won]
                best[r, e + 1], from_[r, e + 1], by[r, e + 1] = got[won], s, v[won]
        lone = np.flatnonzero(~single)
        if len(lone):
            r, to = all_[lone], s + step[lone]
            got = here[lone] + vocab.unknown_score
            won = got > best[r, to]
            r, to = r[won], to[won]
            best[r, to], from_[r, to], by[r, to] = got[won], s, -1
    # paths, from the ends; an unknown character gives an id for each of its bytes
    at, r = size.astype(np.int64), np.arange(w)
    out_r, out_end, out_id = [], [], []
    while True:
        go = at > 0
        r, at = r[go], at[go]
        if not len(r):
            break
        i, s = by[r, at], from_[r, at].astype(np.int64)
        known = i >= 0
        out_r.append(r[known]), out_end.append(at[known]), out_id.append(i[known].astype(np.int64))
        u = np.flatnonzero(~known)
        for k in range(4):
            m = u[at[u] - s[u] > k]
            out_r.append(r[m]), out_end.append(s[m] + k + 1), out_id.append(vocab.byte_ids[rows[r[m], s[m] + k]])
        at = s
    out_r, out_end, out_id = map(np.concatenate, (out_r, out_end, out_id))
    order = np.lexsort((out_end, out_r))
    return out_id[order], np.bincount(out_r, minlength=w)


def _take(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of a flat array, end to end, and their offsets."""
    n = offs[which + 1] - offs[which]
    to = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(to[-1]) + np.repeat(offs[which] - to[:-1], n)], to


def marked(block: TextBlock) -> TextBlock:
    """Texts with a mark before each that is not empty and a mark for each space."""
    full = np.diff(block.offs) > 0
    data = np.insert(block.data, block.offs[:-1][full], 0x20)
    offs = block.offs + np.concatenate([[0], np.cumsum(full)])
    n = np.where(data == 0x20, 3, 1)
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(data, n)
    at = to[:-1][data == 0x20]
    for k in range(3):
        out[at + k] = MARK[k]
    return TextBlock(out, to[offs])


class Memo:
    """Segments encoded before, by a 64-bit hash; forgotten when there are too many."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.flat, self.offs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its place."""
        at = np.searchsorted(self.keys, keys)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == keys) if len(self.keys) else np.zeros(len(keys), bool), at

    def add(self, keys: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        all_offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        order = np.argsort(both)
        self.flat, self.offs = _take(np.concatenate([self.flat, flat]), all_offs, order)
        self.keys = both[order]


def _encode_distinct(vocab: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments, end to end, and their offsets."""
    order, flats, counts = [], [], []
    for low, high in ((0, 12), (12, 24), (24, 48), (48, 96), (96, LONG)):
        group = np.flatnonzero((size > low) & (size <= high))
        for a in range(0, len(group), 20_000):
            g = group[a : a + 20_000]
            at = start[g][:, None] + np.arange(high)[None, :]
            rows = np.where(np.arange(high)[None, :] < size[g][:, None], data[np.minimum(at, len(data) - 1)], 0)
            flat, n = _encode_many(vocab, rows, size[g])
            order.append(g), flats.append(flat), counts.append(n)
    for g in np.flatnonzero(size > LONG).tolist():
        ids = encode_one(vocab, data[start[g] : start[g] + size[g]].tobytes())
        order.append(np.array([g])), flats.append(np.array(ids, np.int64)), counts.append(np.array([len(ids)]))
    if not order:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    place = np.empty(len(start), np.int64)
    place[np.concatenate(order)] = np.arange(len(start))
    return _take(np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), place)


def encode_block(vocab: Vocabulary, block: TextBlock, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a block, end to end, and their offsets."""
    memo = memo or Memo()
    text = marked(block)
    data = text.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
    mark = np.zeros(len(data) + 3, bool)
    mark[: len(data) - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    before = np.zeros(len(data), bool)  # a mark ends just before
    before[3:] = mark[: len(data) - 3]
    begins = (mark[: len(data)] & ~before) | text.edges()
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    keys, first, which = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
    if len(memo.keys) > memo.most:
        memo.clear()
    new = ~memo.find(keys)[0]
    memo.add(keys[new], *_encode_distinct(vocab, data, start[first[new]], (end - start)[first[new]]))
    ids, to = _take(memo.flat, memo.offs, memo.find(keys)[1][which])
    return ids, to[np.searchsorted(start, text.offs)]


def decode_block(vocab: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> TextBlock:
    """Texts of ids: pieces end to end, marks as spaces, without the mark put before the text."""
    data, to = _take(vocab.plain, vocab.plain_offs, ids)
    starts = to[offs]
    lead = starts[:-1][np.diff(starts) > 0]
    lead = lead[data[lead] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    return TextBlock(data[keep], total[starts])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the ids decode to the very text).

    Null and empty texts have no ids. A text that itself holds U+2581 decodes to a space there, and says so in
    ``round_trip``. Rows are encoded one by one, each with its whole text: repeated rows repeat, null ids stay null. Other
    columns take no part; an empty table gives an empty one. The vocabulary, read once by the driver, has a fixed size and
    travels with the function. A vocabulary with a white space mark after another character within a piece is refused.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo = vocab.value, Memo()
        for batch, block in blocks(batches, limit=1 << 20):
            ids, offs = encode_block(v, block, memo)
            back = decode_block(v, ids, offs)
            same = np.diff(back.offs) == np.diff(block.offs)
            if same.all():
                wrong = np.flatnonzero(back.data != block.data)
                same[np.unique(block.doc_of(wrong))] = False
            else:
                for i in np.flatnonzero(same).tolist():
                    same[i] = np.array_equal(back.data[back.offs[i] : back.offs[i + 1]], block.data[block.offs[i] : block.offs[i + 1]])
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(offs)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return project(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text; repeated
    rows repeat, other columns take no part, an empty table gives an empty one."""
    vocab = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            back = decode_block(vocab.value, np.array([i for x in lists for i in x], np.int64), offs)
            raw = back.data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[a:e].decode("utf-8", "replace") for a, e in zip(back.offs[:-1], back.offs[1:])], pa.string())], names=["doc_id", "text"])

    return project(rows, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")
