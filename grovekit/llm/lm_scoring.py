"""Language-model scores of documents by deleted interpolation.

A trigram model: the probability of a word w after u v is a mixture of maximum-likelihood estimates,

    l3[k] * c(u v w) / c(u v)  +  l2[k] * c(v w) / c(v)  +  l1[k] * c(w) / N  +  l0[k] / (V + 1),

with weights for each bucket k of the context's frequency: by ``floor(log2 c(u v))``, or by ``floor(log2 c(v))`` where the
pair u v has not been seen. The weights are learned by expectation-maximisation on counts held out (deleted) from the
training part, until their likelihood stands still; then all training counts are used.

Counts cover the whole training part and are never gathered in one place. Texts are packed into chunks, in the tasks that
read them. Each chunk asks, for its distinct words, bigrams and trigrams, the bucket of each for its counts; buckets add
up what the chunks bring and answer in the order of the question, so an answer is a count or two for each key. A chunk sends
one message to a bucket at most, and none without a key: messages are no more than keys, and keys no more than tokens. No
table of words or bigrams is broadcast. Words are told apart by 64 bits, bigrams and trigrams by 38 bits beside their
bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, TextBlock, blocks, bucket_count, give_back, mix, prefix_hash, project, span_hash, text_buffers

#: Tokens that are no words: the end of a text, and the context of its first token.
END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
#: Parts of ten by document: scored only; counts deleted from training for the mixture weights.
HELD_OUT, DELETED = 0, 1
#: Buckets of context frequency: HALF by the word before, as many by the two words before.
HALF = 24
BUCKETS = 2 * HALF
#: Rounds of EM, at most, and the gain in the deleted tokens' mean log-likelihood below which it stands still.
ROUNDS, STILL = 200, 1e-7
#: Least weight of each component, so that no probability is zero.
FLOOR = 1e-6
_KEY_BITS = 38
#: Bytes of text in a chunk: what one task holds at once.
CHUNK_BYTES = 4 << 20
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def packed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, size, payload: the documents (doc_id, text, part) of a chunk, compressed. Deleted ones have even chunks."""
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)).cast("int")
    docs = project(docs, doc_id="long", text="string").withColumn("part", part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 20, 0
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[deleted][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held[deleted]:
                    w.write_batch(b)
            chunk, made = 2 * (first + made) + (not deleted), made + 1
            out = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([size[deleted]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "payload"])
            held[deleted], size[deleted] = [], 0
            return out

        for batch, block in blocks(batches, limit=min(1 << 20, chunk_bytes)):
            gone = pa.compute.equal(batch.column(2), DELETED)
            for deleted in (False, True):
                b = batch.filter(gone if deleted else pa.compute.invert(gone))
                if b.num_rows:
                    held[deleted].append(b)
                    size[deleted] += len(text_buffers(b.column(1))[0]) + 16 * b.num_rows
                    if size[deleted] >= chunk_bytes:
                        yield close(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield close(deleted)
        give_back()

    return docs.mapInArrow(run, "chunk long, size long, payload binary")


def _opened(payload: pa.Scalar) -> tuple[pa.Table, TextBlock]:
    table = pa.ipc.open_stream(payload.as_buffer()).read_all()
    return table, TextBlock(*text_buffers(table.column("text")))


def tokens_of(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their places within their documents, and their documents: the words of each text (A-Z lowered), then
    END."""
    block = block.lowered()
    start, end, doc = block.words()
    h = span_hash(prefix_hash(block.data), start, end)
    count = np.bincount(doc, minlength=block.n)
    last = np.cumsum(count + 1) - 1  # place of each END
    token = np.empty(len(h) + block.n, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[is_end], token[~is_end] = END, h
    place = np.arange(len(token)) - np.repeat(last - count, count + 1)
    return token, place, np.repeat(np.arange(block.n), count + 1)


def _before(token: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k-th token before each, START where the text has not begun."""
    out = np.full_like(token, START)
    out[k:] = token[: len(token) - k]
    out[place < k] = START
    return out


def _keys(token: np.ndarray, place: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words (kind 0), bigrams and trigrams: distinct keys by bucket, then value; the bucket of each; place of each
    token's key."""
    if not kind:
        word, at = np.unique(token, return_inverse=True)
        b = (word % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        return word[order], b[order], to[at]
    h = token.copy()
    for k in range(1, kind + 1):
        h = mix(h + _before(token, place, k) * _FACTORS[k - 1])
    code = ((h % np.uint64(buckets)) << np.uint64(_KEY_BITS)) | (h >> np.uint64(64 - _KEY_BITS))
    code, at = np.unique(code, return_inverse=True)
    return code & np.uint64((1 << _KEY_BITS) - 1), (code >> np.uint64(_KEY_BITS)).astype(np.int64), at


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte tells how many."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts, of which most are small, in a byte each, the large ones on the side; compressed."""
    large = np.flatnonzero(x >= 255)
    raw = b"".join([len(large).to_bytes(4, "little"), np.minimum(x, 255).astype(np.uint8).tobytes(), large.astype("<u4").tobytes(), x[large].astype("<u8").tobytes()])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_counts(raw: bytes) -> np.ndarray:
    raw = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)
    large = int.from_bytes(raw[:4], "little")
    n = len(raw) - 4 - 12 * large
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.uint64)
    out[np.frombuffer(raw, "<u4", large, 4 + n)] = np.frombuffer(raw, "<u8", large, 4 + n + 4 * large)
    return out


def asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """The messages of the chunks: bucket, kind, chunk, keys, counts."""
    names = ["bucket", "kind", "chunk", "keys", "counts"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                table, block = _opened(payload)
                token, place, doc = tokens_of(block)
                trains = (table.column("part").to_numpy() != HELD_OUT)[doc]
                for kind in range(3):
                    key, bucket, at = _keys(token, place, kind, buckets)
                    n = np.bincount(at, weights=trains, minlength=len(key)).astype(np.uint64)
                    edge = np.searchsorted(bucket, np.arange(buckets + 1))
                    rows: list[list] = [[], [], []]
                    for b in np.flatnonzero(np.diff(edge)).tolist():
                        part = key[edge[b] : edge[b + 1]]
                        if kind:  # sorted: differences need fewer bytes
                            part = np.diff(part, prepend=np.uint64(0))
                        rows[0].append(b), rows[1].append(_pack(part)), rows[2].append(_pack_counts(n[edge[b] : edge[b + 1]]))
                    columns = [rows[0], [kind] * len(rows[0]), [chunk] * len(rows[0]), rows[1], rows[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
                del table, block, token, place, doc, trains, key, bucket, at, n, rows, columns
                give_back()

    return chunks.mapInArrow(run, "bucket int, kind int, chunk long, keys binary, counts binary")


def answered(messages: DataFrame) -> DataFrame:
    """The answers: chunk, kind, bucket, kept and deleted counts in the order of the chunk's keys; and in chunk -1, by
    bucket, the totals (tokens and distinct words, kept and all)."""

    def answer(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("chunk", "kind", "bucket", "kept", "deleted")}
        bucket = table.column("bucket")[0].as_py()

        def put(chunk: int, kind: int, kept: np.ndarray, deleted: np.ndarray) -> None:
            for name, x in zip(rows, (chunk, kind, bucket, _pack_counts(kept), _pack_counts(deleted))):
                rows[name].append(x)

        for kind in range(3):
            part = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not part.num_rows:
                continue
            chunk = part.column("chunk").to_pylist()
            keys = [_unpack(x) for x in part.column("keys").to_pylist()]
            if kind:
                keys = [np.cumsum(x, dtype=np.uint64) for x in keys]
            size = [len(x) for x in keys]
            gone = np.repeat(np.array(chunk) % 2 == 0, size)
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate([_unpack_counts(x) for x in part.column("counts").to_pylist()]).astype(np.float64)
            kept, deleted = (np.bincount(at, weights=np.where(m, n, 0), minlength=len(distinct)).astype(np.uint64) for m in (~gone, gone))
            edge = np.concatenate([[0], np.cumsum(size)])
            for c, a, e in zip(chunk, edge[:-1].tolist(), edge[1:].tolist()):
                put(c, kind, kept[at[a:e]], deleted[at[a:e]])
            if not kind:
                both = kept + deleted
                put(-1, 0, np.array([kept.sum(), (kept > 0).sum()], np.uint64), np.array([both.sum(), (both > 0).sum()], np.uint64))
        return pa.table({k: pa.array(v, pa.binary() if k in ("kept", "deleted") else pa.int64() if k == "chunk" else pa.int32()) for k, v in rows.items()})

    return messages.groupBy("bucket").applyInArrow(answer, "chunk long, kind int, bucket int, kept binary, deleted binary")


def _features(block: TextBlock, answers: pa.Table, all_counts: bool, buckets: int) -> tuple[np.ndarray, ...]:
    """For each token its document, and the counts c(w), c(v), c(v w), c(u v), c(u v w)."""
    token, place, doc = tokens_of(block)
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds = np.array(answers.column("kind").to_pylist())
    found, texts = [], 0.0
    for kind in range(3):
        key, _, at = _keys(token, place, kind, buckets)
        rows = np.flatnonzero(kinds == kind).tolist()
        n = [_unpack_counts(answers.column("kept")[i].as_py()) for i in rows]
        if all_counts:
            n = [a + _unpack_counts(answers.column("deleted")[i].as_py()) for a, i in zip(n, rows)]
        n = np.concatenate(n).astype(np.float64) if n else np.zeros(0)
        if len(n) != len(key):
            raise ValueError("the answers are not those of this chunk")
        if not kind:  # as many texts begin as end
            texts = float(n[np.flatnonzero(key == END)[0]]) if len(key) else 0.0
        found.append(n[at])
    c1, c2, c3 = found
    c1_before, c2_before = np.empty_like(c1), np.empty_like(c2)
    for x, y in ((c1_before, c1), (c2_before, c2)):
        x[1:] = y[:-1]
        x[place == 0] = texts
    return doc, c1, c1_before, c2, c2_before, c3


def context_bucket(c_v: np.ndarray, c_uv: np.ndarray) -> np.ndarray:
    step = lambda c: np.minimum(np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0), HALF - 1)
    return np.where(c_uv > 0, HALF + step(c_uv), step(c_v)).astype(np.int64)


def estimates(c1, c1_before, c2, c2_before, c3, n: float, v: float) -> np.ndarray:
    """The four estimates of each token, as columns."""
    return np.column_stack([c3 / np.maximum(c2_before, 1), c2 / np.maximum(c1_before, 1), c1 / max(1, n), np.full(len(c1), 1 / (v + 1))])


def shares(k: np.ndarray, p: np.ndarray, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The step E, by bucket: what of its tokens each of the four estimates accounts for, the tokens, and the sum of the
    logarithms of their probabilities."""
    part = p * weights[k]
    total = part.sum(1)
    part *= (times / total)[:, None]
    columns = [*part.T, times, times * np.log(total)]
    return np.column_stack([np.bincount(k, weights=x, minlength=BUCKETS) for x in columns])


def fit_weights(step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights of each bucket by EM: ``step`` (E, over all deleted tokens) and the share of each estimate (M) in turn. A
    bucket without tokens takes the weights of the nearest one of its half that has some; without any, all weigh alike."""
    w, before = np.full((BUCKETS, 4), 0.25), -np.inf
    for _ in range(ROUNDS):
        sums = step(w)
        n = sums[:, 4]
        if not n.any():
            break
        some = n > 0
        w[some] = np.maximum(sums[some, :4] / n[some, None], FLOOR)
        w /= w.sum(1, keepdims=True)
        now = sums[:, 5].sum() / n.sum()
        if now - before < STILL:
            break
        before = now
    for half in (range(HALF), range(HALF, BUCKETS)):
        known = [k for k in half if n[k] > 0]
        for k in half:
            if known and not n[k] > 0:
                w[k] = w[min(known, key=lambda x: (abs(x - k), x))]
    return w


def _deleted_counts(chunks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """What EM goes by: the distinct combinations of the five counts of the deleted tokens, and how often each occurs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload in left.column("payload"):
            _, block = _opened(payload)
            _, *c = _features(block, right, False, buckets)
            order = np.lexsort(c)
            c = [x[order].astype(np.uint64) for x in c]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = np.any([x[1:] != x[:-1] for x in c], 0)
            first = np.flatnonzero(new)
            out.append([*(_pack_counts(x[first]) for x in c), _pack_counts(np.diff(np.append(first, len(order))).astype(np.uint64))])
        return pa.table({f"c{k}": pa.array([x[k] for x in out], pa.binary()) for k in range(6)})

    return chunks.filter("chunk % 2 = 0").groupBy("chunk").cogroup(answers.filter("chunk >= 0 AND chunk % 2 = 0").groupBy("chunk")).applyInArrow(run, ", ".join(f"c{k} binary" for k in range(6)))


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty: one token, the end; a null doc_id is hashed as the empty text. Repeated rows, and those
    that repeat an id, count and are scored each. ``base_score`` is that of the additive unigram model, ``score`` that of
    the interpolated trigram model, both as log10 of the text's probability. Documents whose crc32 part is HELD_OUT take
    no part in the counts; without training documents all counts are 0 and probabilities uniform. A text longer than a
    chunk is a chunk of its own. Other columns take no part; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chunks = scratch.save(packed(docs, chunk_bytes))
    buckets = bucket_count(spark, 1.25 * (chunks.agg(F.sum("size")).first()[0] or 0))
    answers = scratch.save(answered(asked(chunks, buckets)))
    totals = [(_unpack_counts(bytes(r[0])), _unpack_counts(bytes(r[1]))) for r in answers.filter("chunk = -1").select("kept", "deleted").toLocalIterator()]
    kept_n, kept_v = (sum(int(a[i]) for a, _ in totals) for i in (0, 1))
    all_n, all_v = (sum(int(b[i]) for _, b in totals) for i in (0, 1))
    deleted = scratch.save(_deleted_counts(chunks, answers, buckets))

    def step(weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros((BUCKETS, 6))
            for b in batches:
                for row in zip(*(b.column(k) for k in range(6))):
                    *c, times = (_unpack_counts(x.as_py()).astype(np.float64) for x in row)
                    if len(times):
                        part += shares(context_bucket(c[1], c[3]), estimates(*c, kept_n, kept_v), weights, times)
            k = np.flatnonzero(part[:, 4])
            yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(part[k, j]) for j in range(6))], names=["k", *(f"x{j}" for j in range(6))])

        sums = deleted.mapInArrow(run, "k long, " + ", ".join(f"x{j} double" for j in range(6))).groupBy("k").agg(*(F.sum(f"x{j}") for j in range(6)))
        out = np.zeros((BUCKETS, 6))
        for k, *x in sums.collect():  # a row for each bucket of context frequency
            out[k] = x
        return out

    weights = fit_weights(step)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        out = [pa.table([pa.array([], t) for t in kinds], names=names)]
        for payload in left.column("payload"):
            table, block = _opened(payload)
            doc, *c = _features(block, right, True, buckets)
            p = (estimates(*c, all_n, all_v) * weights[context_bucket(c[1], c[3])]).sum(1)
            base = np.log10((c[0] + 0.1) / (all_n + 0.1 * (all_v + 1)))
            total = lambda x=None: np.bincount(doc, weights=x, minlength=block.n)
            held = table.column("part").to_numpy() == HELD_OUT
            give_back()
            out.append(pa.table([table.column("doc_id"), pa.array(held), pa.array(total().astype(np.int64)), pa.array(total(c[0] > 0).astype(np.int64)), pa.array(np.full(block.n, all_n, np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))], names=names))
        return pa.concat_tables(out)

    whole = chunks.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk"))
    return whole.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
