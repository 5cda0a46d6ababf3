"""Periodic runs in sequences of words: where a text says the same thing again and again.

A run is a stretch that repeats with a smallest period and that no neighbouring word extends. Every run holds, under one
of two opposite orders of the words, a Lyndon word as long as its period that is the longest one starting where it
starts. So the words are scanned from right to left under both orders with a stack of Lyndon words (the suffixes that are
compared are told apart by their longest common extension), and each longest Lyndon word, taken as a period, is extended
to both sides. Extensions are searched for by halving over a rolling hash, then compared word by word: hashes alone decide
nothing. No suffix array is made.

The scan is one step of Python for a word, so it is spent on words that can be in a run only. In a run of at least
``least`` words and three periods, each window of ``(least + 2) // 3`` words comes twice in the document; numpy marks the
stretches of such windows, and a run lies in one stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U64, TextBlock, binary_array, blocks, mix, prefix_hash, project, span_hash

#: Words of a run, and times that its period must fit into it, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Extensions:
    """Longest common extensions within a sequence of numbers: by hash, and verified."""

    def __init__(self, seq: np.ndarray):
        self.seq, self.n = seq, len(seq)
        powers = np.full(self.n + 1, _BASE, U64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=U64)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(seq.astype(U64) + U64(1)) * self.powers[: self.n], dtype=U64, out=self.sums[1:])
        self.one, self.sum, self.power = seq.tolist(), self.sums.tolist(), self.powers.tolist()
        self.known: dict[int, tuple[int, int]] = {}  # by distance: where words are known to be equal to those so far on

    def alike(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of ``size`` words from i and from j agree (i < j)."""
        s = self.sum
        return ((s[i + size] - s[i]) * self.power[j - i] - s[j + size] + s[j]) & _MASK == 0

    def verified(self, i: int, j: int, size: int) -> int:
        """How many of ``size`` words from i and from j are equal before the first that are not. What has been compared at
        this distance before is not compared again."""
        d = j - i
        low, high = self.known.get(d, (i, i))
        if high < i or low > i + size:
            low = high = i
        for a, b in ((i, low), (max(high, i), i + size)):
            if a < b:
                odd = np.flatnonzero(self.seq[a:b] != self.seq[a + d : b + d])
                if len(odd):
                    return a + int(odd[0]) - i
        self.known[d] = (min(i, low), max(high, i + size))
        return size

    def ahead(self, i: int, j: int) -> int:
        """Length of the longest common prefix of what starts at i and at j (i < j)."""
        one, n, k = self.one, self.n, 0
        while k < 4:
            if j + k >= n or one[i + k] != one[j + k]:
                return k
            k += 1
        step, most = 4, n - j
        while k + step <= most and self.alike(i, j, k + step):
            k += step
            step *= 2
        low, high = k, min(k + step, most + 1)  # alike at low, not at high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.alike(i, j, middle) else (low, middle)
        return self.verified(i, j, low)

    def _halving(self, most: np.ndarray, agree) -> np.ndarray:
        """For each pair the largest size, up to ``most``, that a search by halving finds to agree."""
        size = np.zeros(len(most), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            at = np.flatnonzero(size + step <= most)
            at = at[agree(at, size[at] + step)]
            size[at] += step
        return size

    def all_ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        def agree(at, size):
            a, b = i[at], j[at]
            return (self.sums[a + size] - self.sums[a]) * self.powers[b - a] == self.sums[b + size] - self.sums[b]

        return self._halving(np.minimum(most, self.n - j), agree)

    def all_behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths of the longest common suffixes of what ends before i and before j."""

        def agree(at, size):
            a, b = i[at], j[at]
            return (self.sums[a] - self.sums[a - size]) * self.powers[b - a] == self.sums[b] - self.sums[b - size]

        return self._halving(np.minimum(most, i), agree)


def longest_lyndon(ext: Extensions, rising: bool) -> np.ndarray:
    """For each place the end of the longest Lyndon word that starts there, smaller words (or greater ones) first."""
    n, one = ext.n, ext.one
    key = [*(one if rising else [-x for x in one]), float("-inf")]
    stack, end = [n], [0] * n
    for i in range(n - 1, -1, -1):
        x = key[i]
        while True:  # the Lyndon words on the stack join this one as long as their suffixes are greater
            j = stack[-1]
            y = key[j]
            if x == y:
                same = ext.ahead(i, j)
                if not key[i + same] < key[j + same]:
                    break
            elif not x < y:
                break
            stack.pop()
        end[i] = stack[-1]
        stack.append(i)
    return np.array(end, np.int64)


def runs_of(seq: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, longest: int | None = None) -> np.ndarray:
    """Start, length and smallest period of each run of a sequence of numbers from 0 on, by start, then period.

    ``longest``: a bound on the length of runs, where one is known.
    """
    n = len(seq)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    ext, at = Extensions(seq), np.arange(n)
    bound = n if longest is None else longest
    found = []
    for rising in (True, False):
        j = longest_lyndon(ext, rising)
        full = np.append(seq, -1)
        open_ = (full[j] == seq) | (at > 0) & (seq[at - 1] == full[j - 1])
        i, j = at[open_], j[open_]
        most = np.full(len(i), bound)
        right, left = ext.all_ahead(i, j, most), ext.all_behind(i, j, most)
        period, size = j - i, j - i + right + left
        good = (size >= least) & (size >= times * period)
        found.append(np.column_stack([i - left, size, period, i])[good])
    found = np.concatenate(found)
    found = found[np.lexsort(found[:, ::-1].T)]
    out = set()
    checked: dict[tuple, bool] = {}
    for start, size, period, i in found.tolist():
        if (run := (start, size, period)) not in checked:
            checked[run] = bool((seq[start : start + size - period] == seq[start + period : start + size]).all())
        if not checked[run]:  # a hash has lied: word by word
            odd = np.flatnonzero(seq[i : n - period] != seq[i + period :])
            right = int(odd[0]) if len(odd) else n - period - i
            odd = np.flatnonzero(seq[:i][::-1] != seq[period : i + period][::-1])
            left = int(odd[0]) if len(odd) else i
            start, size = i - left, period + left + right
            if size < least or size < times * period:
                continue
        out.add((start, size, period))
    return np.array(sorted((s, p, z) for s, z, p in out), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _stretches(word: np.ndarray, doc: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of the stretches that can hold runs. Equal hashes of unlike words only add to them."""
    if not len(word):
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    wide = (least + 2) // 3
    if times < 3 or wide < 2:  # a shorter run need not repeat its windows
        return edge[:-1], edge[1:]
    m = len(word) - wide + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z, z
    key = mix(doc[:m].astype(U64))
    for k in range(wide):
        key = key * U64(_BASE) + word[k : m + k]
    whole = np.flatnonzero(doc[:m] == doc[wide - 1 :])
    key = mix(key[whole])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(m + 1, bool)
    twice[whole[order[1:][same]]] = True
    twice[whole[order[:-1][same]]] = True
    # windows of one document follow each other without a gap: there are wide - 1 places between documents
    step = np.diff(np.concatenate([[0], twice.astype(np.int8)]))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = last - first + wide - 1 >= least
    first, last = first[long], last[long] + wide - 1
    return first, last


def _numbers(block: TextBlock, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    raw = np.empty(offs[-1], np.uint8)
    at = 0
    while at < len(start):  # about a megabyte at a time
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1)
        if to == at + 1:
            raw[offs[at] : offs[to]] = block.data[start[at] : end[at]]
        else:
            raw[offs[at] : offs[to]] = block.data[np.arange(offs[at], offs[to]) + np.repeat(start[at:to] - offs[at:to], size[at:to])]
        at = to
    return binary_array(raw, offs).dictionary_encode().indices.to_numpy().astype(np.int64)


def block_runs(block: TextBlock, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, words=None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the documents of a block: document; and first word (counted over the block), length, period."""
    start, end, doc = words or block.words()
    first, last = _stretches(span_hash(prefix_hash(block.data), start, end), doc, least, times)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    size = last - first
    offs = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(offs[-1]) + np.repeat(first - offs[:-1], size)
    # one sequence of all stretches: behind each stands a number of its own, which no run can hold
    seq = np.insert(_numbers(block, start[word], end[word]), offs[1:], np.arange(len(size)) + offs[-1])
    found = runs_of(seq, least, times, int(size.max()))
    begins = offs[:-1] + np.arange(len(size))
    part = np.searchsorted(begins, found[:, 0], "right") - 1
    found = found.copy()
    found[:, 0] += first[part] - begins[part]
    return doc[found[:, 0]], found


def _without_repeats(block: TextBlock, words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts whose words are joined by one space, of each run only its first period."""
    start, end, doc = words
    n = len(start)
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone)[:n] == 0)
    # a kept word that another follows in its document has a byte of white space behind it
    follows = np.append(doc[kept][1:] == doc[kept][:-1], False).astype(np.int64)
    edge = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(edge, start[kept], 1)
    np.add.at(edge, end[kept] + follows, -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    total = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    data = block.data[keep]
    data[IS_SPACE[data]] = 0x20
    return data, total[block.offs]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """Per row: doc_id, n_words, runs (an array of first word, length and period in words, by start, then period) and
    collapsed (the words joined by one space, without those that any run holds behind its first period).

    Runs have at least ``least`` words and ``times`` periods (two at least). Words are the maximal stretches without a
    character of ``[\\x20\\x09-\\x0D]``, numbered from 0. A null or empty text has no word, no run, and an empty collapsed text.
    Rows are judged one by one on their whole texts, a very long one alone: repeated rows, and those without an id, come back
    as often as they are there. Other columns take no part; an empty table gives an empty one. Nothing is shuffled.
    """
    if least < 2 or times < 2:
        raise ValueError("runs of two words and two periods at least")
    docs = project(docs, doc_id="long", text="string")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            words = block.words()
            doc, found = block_runs(block, least, times, words)
            n_words = np.bincount(words[2], minlength=block.n)
            before = np.concatenate([[0], np.cumsum(n_words)])
            data, offs = _without_repeats(block, words, found)
            count = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.n))])
            rows = pa.StructArray.from_arrays([pa.array(found[:, 0] - before[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(item))
            runs = pa.ListArray.from_arrays(pa.array(count, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), runs, binary_array(data, offs, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_echoes(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts is made periodic (a probe with known runs).

    With h the unsigned CRC-32 of the id in decimal, g = h // 10 and n words: where 10 divides h and n > 0, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). Such texts have one space between words.
    Rows without an id stay as they are.
    """
    docs = project(docs, doc_id="long", text="string")
    return (
        docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
        .withColumn("w", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("w"))
        .withColumn("a", F.expr("if(n > 0, int(g % n), 0)")).withColumn("p", F.expr("1 + int((n - a) div (3 + g % 8))"))
        .select("doc_id", F.when(F.col("n") > 0, F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")).otherwise(F.col("text")).alias("text"))
    )


def run_digests(runs: DataFrame) -> DataFrame:
    """Of what ``periodic_runs`` returns: doc_id, n_runs, the run of the greatest length / period (then the smallest start and
    period), and digests of all runs and of the collapsed text. Without a run its four columns are null."""
    # fractions are compared exactly, by cross products
    best = F.expr("array_sort(runs, (x, y) -> case when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return runs.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
