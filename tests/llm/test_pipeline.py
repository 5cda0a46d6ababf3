"""The pipeline, stage by stage, against brute force."""

import re

import corpus_pipeline
import pyarrow as pa

from grovekit.llm import packing, pieces
from grovekit.llm.common import TextBlock, text_buffers

from .test_operators import WORD, WS, brute_components, brute_windows, documents, order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passes(t):
    """The quality rules in plain Python."""
    w, t = WORD.findall(t or ""), t or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    chars = sum(map(len, w))
    stutter, digits = sum(a == b for a, b in zip(w, w[1:])), len(re.findall("[0-9]", t))
    bad = len(w) < 20 or 100 * len(cover) > 30 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
    return not (bad or not 2 * len(w) <= chars <= 14 * len(w) or 100 * stutter > 25 * len(w) or 2 * digits > chars)


def ids_of(texts):
    flat, offs = packing._with_end(*pieces.encode_block(pieces.load(pieces.MODEL), TextBlock(*text_buffers(pa.array([t or "" for t in texts])))), packing.END_ID)
    return [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]


def test_an_empty_table_and_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts and columns, columns of other names go through all stages."""
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(None if i % 7 == 0 else i // 2, t, None, "b", None, [i], i * 0.5) for i, (_, t) in enumerate(documents(60))]
    df = spark.createDataFrame(rows, SCHEMA + ", bucket array<int>, _salt double")
    df.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        assert docs.columns == df.columns
        assert all(r["_salt"] == r["bucket"][0] * 0.5 for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(p["doc"]["_salt"] for x in packed for p in x["pieces"]) == sorted(r["_salt"] for r in docs.collect())


def test_stages(spark, tmp_path):
    rows = [x for x in dict(documents(160)).items() if x[0] is not None]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    have = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if k < 5 else {}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == df.columns
            have = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            assert set(have) == {i for i, t in before.items() if passes(t)} and all(before[i] == t for i, t in have.items())
        if k == 1:
            best = {}
            for i, t in before.items():
                key = WS.sub("", t)
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            assert set(have) == {i for _, i in best.values()}
        if k == 2:
            assert set(have) == {c for _, _, c in brute_components(sorted(before.items()))}
        if k == 3:
            gone = {i: n for i, _, n, _, _ in brute_windows(list(before.items()))}
            for i, t in have.items():  # characters go whole: up to a few bytes less at each end of a span
                lost = len(before[i].encode()) - len(t.encode())
                assert lost <= gone[i] and (lost > 0 or gone[i] < 8)
    got = [(p["doc"]["doc_id"], p["start"], p["doc"]["lang"], x["ids"][p["offset"] : p["offset"] + p["n_tokens"]]) for x in docs.collect() for p in x["pieces"]]
    want = [(i, s, "en", x[s : s + 8192]) for i, x in zip(have, ids_of(have.values())) for s in range(0, len(x), 8192)]
    assert order(got) == order(want) and len(have) > 10
    whole = [(p["doc"]["doc_id"], x["ids"][p["offset"] : p["offset"] + p["n_tokens"]]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect() for p in x["pieces"]]
    assert order(whole) == order((i, t) for i, _, _, t in want)
