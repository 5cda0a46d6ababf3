"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a document on its own text, by figures that it shares with others. On a sample the cost of each
figure (seconds per byte) and the rejection share of each rule are measured; rules then run in falling order of rejection per
cost, a rule costing what is not computed yet, and a document that one rule rejects is not given to the next. A verdict is a
conjunction, so the order changes the cost, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, blocks, mix, prefix_hash, project, span_hash

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
#: Documents, about, that cost and selectivity are estimated on: the share drawn falls as the table grows.
SAMPLE_DOCS = 2000
#: Words in the windows whose repetition is measured.
REPEAT_WINDOW = 8


def _copies(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (doc, key), whether each in that order equals the one before it, and the next one."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    return order, same[:-1], same[1:]


#: Figures that are places in the text, not a number for each document.
_PIECES = ("words", "lines")


class Measures:
    """Figures of the documents of a block; each is computed when first asked for, from others that it uses.

    ``only`` gives those of some documents: figures that are there already are taken over, others are computed on their texts
    alone. ``spent`` has the seconds that each figure took, without those it uses; ``uses`` which ones these are.
    """

    def __init__(self, block: TextBlock | None, n: int | None = None):
        self._block, self.n, self._kept = block, block.n if n is None else n, {}
        self._from: tuple[Measures, np.ndarray] | None = None
        self._stack, self._inner, self.spent, self.uses = [""], 0.0, {}, {}

    @property
    def block(self) -> TextBlock:
        if self._block is None:
            whole, rows = self._from[0].block, self._from[1]
            spans = list(zip(whole.offs[rows].tolist(), whole.offs[rows + 1].tolist()))
            data = np.concatenate([whole.data[a:b] for a, b in spans]) if spans else whole.data[:0]
            self._block = TextBlock(data, np.concatenate([[0], np.cumsum([b - a for a, b in spans])]).astype(np.int64))
        return self._block

    def only(self, rows: np.ndarray) -> Measures:
        """The figures of these documents."""
        out = Measures(None, len(rows))
        out._from = self, rows
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        for name, value in self._kept.items():
            if name in _PIECES:  # starts, ends and documents of words or lines
                start, end, doc = value
                mine = place[doc] >= 0
                moved = np.cumsum(self.block.offs[rows + 1] - self.block.offs[rows]) - self.block.offs[rows + 1]
                new = place[doc[mine]]
                out._kept[name] = start[mine] + moved[new], end[mine] + moved[new], new
            elif name == "word_hash":
                out._kept[name] = value[place[self._kept["words"][2]] >= 0]
            elif name != "prefix":
                out._kept[name] = value[rows]
        return out

    def __getattr__(self, name: str):
        if name.startswith("_") or not hasattr(Measures, f"_get_{name}"):
            raise AttributeError(name)
        self.uses.setdefault(self._stack[-1], set()).add(name)
        if name not in self._kept:
            began, outer, self._inner = time.perf_counter(), self._inner, 0.0
            self._stack.append(name)
            self._kept[name] = getattr(self, f"_get_{name}")()
            self._stack.pop()
            took = time.perf_counter() - began
            self.spent[name], self._inner = took - self._inner, outer + took
        return self._kept[name]

    def _get_words(self):
        return self.block.words()

    def _get_prefix(self):
        return prefix_hash(self.block.data)

    def _get_n_words(self):
        return np.bincount(self.words[2], minlength=self.n)

    def _get_word_chars(self):
        from .common import IS_SPACE

        data = self.block.data
        return self.block.per_doc(~IS_SPACE[data] & ((data & 0xC0) != 0x80))

    def _get_n_symbols(self):
        return self.block.per_doc(_IS_SYMBOL[self.block.data])

    def _get_n_digits(self):
        return self.block.per_doc(_IS_DIGIT[self.block.data])

    def _get_lines(self):
        """Lines that hold a word."""
        start, end, doc = self.block.lines()
        words = self.words[0]
        full = np.searchsorted(words, end, "left") > np.searchsorted(words, start, "left")
        return start[full], end[full], doc[full]

    def _get_n_lines(self):
        return np.bincount(self.lines[2], minlength=self.n)

    def _get_n_dup_lines(self):
        start, end, doc = self.lines
        order, again, _ = _copies(doc, span_hash(self.prefix, start, end))
        return np.bincount(doc[order][again], minlength=self.n)

    def _get_word_hash(self):
        return span_hash(self.prefix, *self.words[:2])

    def _get_n_stutter(self):
        """Words equal to the word before them."""
        h, doc = self.word_hash, self.words[2]
        return np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=self.n)

    def _get_n_repeat_words(self):
        h, doc = self.word_hash, self.words[2]
        m = len(h) - REPEAT_WINDOW + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        key = np.zeros(m, np.uint64)
        for j in range(REPEAT_WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
        inside = np.flatnonzero(doc[:m] == doc[REPEAT_WINDOW - 1 :])
        order, again, followed = _copies(doc[inside], mix(key[inside]))
        hit = inside[order[again | followed]]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + REPEAT_WINDOW, -1)
        return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    name: str
    #: True for the documents to reject.
    rejects: Callable[[Measures], np.ndarray]


#: The base rules, then those of the verdict. Thresholds are whole-number comparisons.
BASE_RULES = (
    Rule("too_short", lambda m: m.n_words < 20),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
VERDICT_RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 14 * m.n_words)),
    Rule("stutter", lambda m: 100 * m.n_stutter > 25 * m.n_words),
    Rule("digits", lambda m: 2 * m.n_digits > m.word_chars),
)
RULES = BASE_RULES + VERDICT_RULES


@dataclass(frozen=True)
class Figures:
    """Of a sample: the rejected share of each rule, the cost (seconds a byte) of each figure by itself, and what each rule and
    each figure uses."""

    share: dict[str, float]
    cost: dict[str, float]
    uses: dict[str, frozenset[str]]

    def all_of(self, name: str) -> set[str]:
        """Every figure that a rule or a figure needs."""
        out: set[str] = set()
        stack = [name]
        while stack:
            for f in self.uses.get(stack.pop(), ()):
                if f not in out:
                    out.add(f)
                    stack.append(f)
        return out


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS) -> Figures:
    """Costs and rejected shares on a sample of about ``sample_docs`` documents. Without rows all are 0."""

    def tried(block: TextBlock) -> tuple[Measures, list[int]]:
        m, bad = Measures(block), []
        for r in rules:
            m._stack = [r.name]
            bad.append(int(r.rejects(m).sum()))
        return m, bad

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches):
            m, bad = tried(block)
            names, values = [f"f {k}" for k in m.spent] + [f"r {r.name}" for r in rules], [*m.spent.values(), *map(float, bad)]
            k = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.float64()), pa.array([len(block.data)] * k, pa.int64()), pa.array([block.n] * k, pa.int64())], names=["name", "value", "bytes", "docs"])

    uses = {k: frozenset(v) for k, v in tried(TextBlock(np.frombuffer(b"a", np.uint8), np.array([0, 1])))[0].uses.items()}
    n = docs.count()  # of a Parquet table: read from its footers
    sample = project(docs, text="string").sample(min(1.0, sample_docs / max(1, n)), 7)
    # each part of the table tries its own few documents; only sums by name are brought together
    total = {r[0]: r[1:] for r in sample.mapInArrow(trial, "name string, value double, bytes long, docs long").groupBy("name").agg(F.sum("value"), F.sum("bytes"), F.sum("docs")).collect()}
    share = {r.name: bad / max(1, seen) for r in rules for bad, _, seen in [total.get(f"r {r.name}", (0.0, 0, 0))]}
    return Figures(share, {k[2:]: value / max(1, size) for k, (value, size, _) in total.items() if k[0] == "f"}, uses)


def plan(figures: Figures, rules: tuple[Rule, ...] = RULES, given: tuple[Rule, ...] = ()) -> list[Rule]:
    """Rules by falling rejection per cost; ties by their place in ``rules``. A rule costs what it needs beyond what the rules
    before it, and those of ``given``, have computed: one that needs nothing more comes at once."""
    done = {f for r in given for f in figures.all_of(r.name)}
    left, out = list(rules), []
    while left:
        price = {r.name: sum(figures.cost.get(f, 0.0) for f in figures.all_of(r.name) - done) for r in left}
        best = max(left, key=lambda r: figures.share[r.name] / max(price[r.name], 1e-15))
        left.remove(best)
        out.append(best)
        done |= figures.all_of(best.name)
    return out


def cascade(m: Measures, order: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the documents ``alive`` (their places) pass all rules. A rule is given those only that passed the ones before."""
    now, out = m, np.zeros(m.n, bool)
    places = np.arange(m.n)  # of the documents that ``now`` has
    for rule in order:
        if not len(alive):
            break
        if len(alive) < now.n:
            now, places = now.only(np.searchsorted(places, alive)), alive
        alive = alive[~rule.rejects(now)]
    out[alive] = True
    return out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes all rules, with all their columns as they are, whatever their names.

    A null text counts as empty, and fails. Rows are judged one by one: repeated rows, and those of equal ids, stay or
    go alike. A very long text is a block of its own and judged whole; an empty table gives an empty one.
    """
    order = plan(estimate(docs, rules), rules)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            good = cascade(Measures(block), order, np.arange(block.n))
            if good.any():
                yield batch.filter(pa.array(good))

    if names.count("text") != 1:
        raise ValueError("one column named text is needed")
    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed and kept.

    The base figures are asked for of every document; the cascade of the other rules is given only those that the base rules
    leave, and each of its rules only those that the ones before it leave. What a rule needs beyond the base figures is what it
    costs. Null and empty texts have no word and fail. Rows are judged one by one, each on its whole text: repeated
    rows repeat, null ids stay null. Other columns take no part; an empty table gives an empty report.
    """
    docs = project(docs, doc_id="long", text="string")
    order = plan(estimate(docs, BASE_RULES + VERDICT_RULES), VERDICT_RULES, given=BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            m = Measures(block)
            failed = np.zeros(block.n, bool)
            for r in BASE_RULES:
                failed |= r.rejects(m)
            kept = cascade(m, order, np.flatnonzero(~failed))
            columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
