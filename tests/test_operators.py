"""Invariants of predictors, sources and statistics on small examples."""

import math

import pytest
from pyspark.sql import functions as F

from grovekit.operators import agreement, corpus, pickers, placers, resampling, retrieval
from grovekit.plans import views
from grovekit.sources import artifacts, files, tables
from grovekit.sources.vector_store import VectorStore

SF = "/root/testdata/sf0.001"


def test_no_neighbour_vote_across_folders(spark):
    """On a split without common folders a vote of neighbours can never be right."""
    n = corpus.folder_split(corpus.drop_copies(views.notes(spark, SF), "text"), "vault", "path_key", 0.4, 7)
    v = placers.with_soft(placers.verdicts(n))
    assert v.filter("exact").count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("v", 1, 1, "a b a"), ("v", 2, 2, "b c"), ("v", 3, 3, "d")], "vault string, id long, ord long, text string")
    q = spark.createDataFrame([("v", 9, "A a zz")], "vault string, id long, text string")
    got = {r["doc"]: r["score"] for r in retrieval.bm25_scores(docs, q).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got.keys() == {1} and abs(got[1] - 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))) < 1e-12


def test_union_is_of_both(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, f string, pos int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "id long, f string, pos int")
    got = [r["f"] for r in retrieval.union_candidates(a, b, ["id"], "f", 3).orderBy("pos").collect()]
    assert got == ["x", "y", "z"]


def test_bootstrap_of_equal_vaults(spark):
    h = spark.createDataFrame([("all", f"v{i}", "a", 3, 4) for i in range(5)], "bucket string, vault string, arm string, h long, n long")
    r = resampling.bootstrap(h, 50).first()
    assert r["low"] == r["high"] == r["acc"] == 0.75


def test_kappa_wilson_gini(spark):
    p = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (1, 0)], "a int, b int")
    r = agreement.kappa(p, "a", "b").first()
    assert abs(r["kappa"] - (0.75 - 0.5) / 0.5) < 1e-12
    assert math.isnan(agreement.kappa(p.filter("a > 1"), "a", "b").first()["kappa"])
    low, high = agreement.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(r["l"] - 0.2366) < 1e-3 and abs(r["h"] - 0.7634) < 1e-3
    g = agreement.gini(spark.createDataFrame([("k", 1), ("k", 1), ("k", 4)], "key string, x int"), "key", "x").first()["gini"]
    assert abs(g - (2 * (1 * 1 + 2 * 1 + 3 * 4) - 4 * 6) / (3 * 6)) < 1e-12


def test_sheets_and_json(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "yes", twice', "ok"), ("2", "line\nbreak", "")], "id string, t string, v string")
    tables.write_sheet(df, str(tmp_path / "s"))
    back = tables.read_sheet(spark, str(tmp_path / "s"))
    assert {r["t"] for r in back.collect()} == {'say "yes", twice', "line\nbreak"}
    assert tables.check_values(back, "v", ["ok"]).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        tables.check_values(back, "v", ["no"])
    (tmp_path / "t.jsonl").write_text('{"id":"a","gold_path":["x"]}\n\n{"id":"b","text":"t"}\n')
    rows = {r["id"]: r for r in tables.read_json_lines(spark, str(tmp_path / "t.jsonl")).collect()}
    assert rows["a"]["gold_path"] == ["x"] and rows["b"]["gold_path"] is None and len(rows) == 2


def test_vector_store(spark, tmp_path):
    """Missing texts are embedded once each and kept, also by two lookups at a time; a text set anew has its new vector."""
    import threading

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "")], "id long, text string")
    with pytest.raises(KeyError):
        VectorStore(spark, str(tmp_path / "s")).lookup(docs)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[3.0 + len(t), 4.0] for t in texts]

    open_ = lambda f=embed: VectorStore(spark, str(tmp_path / "s"), f)
    open_().put(spark.createDataFrame([("a", [0.0, 2.0])], "text string, vector array<double>"))
    got = []
    runs = [threading.Thread(target=lambda: got.append({r["id"]: r["vector"] for r in open_().lookup(docs).collect()})) for _ in range(2)]
    [t.start() for t in runs], [t.join() for t in runs]
    assert got[0] == got[1] and calls.value == 2 and got[0][4] is None
    assert [round(x, 6) for x in got[0][1]] == [0.0, 1.0] and abs(sum(x * x for x in got[0][2]) - 1) < 1e-6 and [round(x, 6) for x in got[0][5]] == [0.6, 0.8]
    open_().put(spark.createDataFrame([("b", [1.0, 0.0])], "text string, vector array<double>"))
    assert [round(x, 6) for x in {r["id"]: r["vector"] for r in open_(None).lookup(docs).collect()}[3]] == [1.0, 0.0]
    (tmp_path / "s" / "lock").touch()  # left by a program that died
    assert VectorStore(spark, str(tmp_path / "s"), embed, stale=0.0).lookup(spark.createDataFrame([("c",)], "text string")).count() == 1


def test_scan_and_ingest(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "n.md").write_text("hello")
    (tmp_path / "a" / "x.py").write_text("no")
    (tmp_path / "a" / ".git" / "h.md").write_text("no")
    (tmp_path / "a" / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "a" / "e.md").write_text("  \n")
    f = files.scan_files(spark, str(tmp_path)).select(F.lit("R oot").alias("root"), F.lit("src").alias("source"), "path", "content")
    got = {r["path"]: r for r in files.ingest(f).collect()}
    assert {k: v["reason"] for k, v in got.items()} == {"a/n.md": None, "a/bad.md": "not_utf8", "a/e.md": "empty"}
    assert got["a/n.md"]["folder"] == ["r-oot", "src", "a"]


def test_picker_that_fails(spark):
    p = spark.createDataFrame([(i, f"x{i}") for i in range(5)], "id long, prompt string").coalesce(1)

    def broken(prompts):
        raise RuntimeError("wrong key")

    r = pickers.with_picker(p, broken).first()
    assert r["raw"] is None and r["picker_error"] == "RuntimeError: wrong key"
    assert pickers.with_picker(p, lambda ps: [t + "!" for t in ps], 2).filter("raw = concat(prompt, '!') AND picker_error IS NULL").count() == 5
    assert pickers.with_picker(p, lambda ps: ps[1:]).first()["picker_error"] == "4 replies to 5 prompts"


def test_picker_asks_again(spark):
    """What may pass is asked again, with longer and longer waits; the last failure is told."""
    p = spark.createDataFrame([(1, "x")], "id long, prompt string").coalesce(1)

    def busy(times):
        said = []

        def pick(prompts):
            said.append(1)
            if len(said) <= times:
                raise RuntimeError("429 slow down")
            return [f"after {len(said)}"] * len(prompts)

        return pick

    assert pickers.with_picker(p, busy(3), wait=lambda a: 0.0).first()["raw"] == "after 4"
    assert pickers.with_picker(p, busy(9), attempts=2, wait=lambda a: 0.0).first()["picker_error"] == "RuntimeError: 429 slow down"
    assert 1 <= pickers.back_off(0) < 3 and 30 <= pickers.back_off(9) < 32


@pytest.mark.parametrize("block", [2000, 3])
def test_scores_in_blocks(spark, block):
    """Whatever the blocks, the best of each query are those of all pairs; also by a part of the notes."""
    import random

    r = random.Random(4)
    word = lambda: r.choice("abcdefghij")
    notes = [(f"v{i % 2}", i, i, " ".join(word() for _ in range(r.randint(0, 6))), [r.random() for _ in range(3)], i % 3 == 0) for i in range(30)]
    asked = [(f"v{i % 2}", 100 + i, " ".join(word() for _ in range(4)), [r.random() for _ in range(3)]) for i in range(9)]
    d = spark.createDataFrame(notes, "vault string, id long, ord long, text string, vector array<double>, g boolean")
    q = spark.createDataFrame(asked, "vault string, id long, text string, vector array<double>")
    idf, size = {}, {}
    for v in ("v0", "v1"):
        own = [n[3].split() for n in notes if n[0] == v]
        size[v] = (len(own), sum(map(len, own)) / len(own))
        for w in "abcdefghij":
            df = sum(w in t for t in own)
            idf[v, w] = math.log(1 + (len(own) - df + 0.5) / (df + 0.5))
    bm = {(a[1], n[1]): s for a in asked for n in notes if a[0] == n[0] for t in [n[3].split()] for s in [sum(idf[a[0], w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / size[a[0]][1])) for w in a[2].split() if w in t)] if s > 0}
    cos = {(a[1], n[1]): sum(x * y for x, y in zip(a[3], n[4])) / math.sqrt(sum(x * x for x in a[3]) * sum(x * x for x in n[4])) for a in asked for n in notes if a[0] == n[0]}
    corpus, queries = d.select("vault", "id", "ord", "text", "g"), q.select("vault", "id", "text")
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert near({(x["id"], x["doc"]): x["score"] for x in retrieval.bm25_scores(corpus, queries, block=block).collect()}, bm)
    vectors = (d.select("vault", "id", "ord", "vector"), q.select("vault", "id", "vector"))
    assert near({(x["id"], x["doc"]): x["score"] for x in retrieval.cosine_scores(*vectors, block=block).collect()}, cos)
    for scores, frame in ((bm, lambda **k: retrieval.bm25_scores(corpus, queries, block=block, **k)), (cos, lambda **k: retrieval.cosine_scores(*vectors, block=block, **k))):
        best = {(x["id"], x["doc"]) for x in retrieval.top_k(frame(k=4), ["id"], 4).collect()}
        for a in asked:
            ranked = sorted((k for k in scores if k[0] == a[1]), key=lambda k: (-round(scores[k], 9), k[1]))[:4]
            assert set(ranked) == {k for k in best if k[0] == a[1]}
    parts = {(x["id"], x["doc"]) for x in retrieval.top_k(retrieval.bm25_scores(corpus, queries, k=2, part="g", block=block), ["id", "g"], 2).collect()}
    for a in asked:
        for g in (True, False):
            ranked = sorted((k for k in bm if k[0] == a[1] and (k[1] % 3 == 0) == g), key=lambda k: (-round(bm[k], 9), k[1]))[:2]
            assert set(ranked) == {k for k in parts if k[0] == a[1] and (k[1] % 3 == 0) == g}


@pytest.mark.parametrize("block", [2000, 4])
def test_near_pairs(spark, block):
    import random

    r = random.Random(6)
    rows = [(i, f"v{i % 3}", [r.choice([-1.0, 1.0]) for _ in range(4)]) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, vault string, vector array<double>")
    want = {(a[0], b[0], sum(x * y for x, y in zip(a[2], b[2])) / 4) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and sum(x * y for x, y in zip(a[2], b[2])) >= 2}
    assert {tuple(x) for x in retrieval.near_pairs(df, 0.5, "vault", block).collect()} == want


def test_kept_results(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [artifacts.kept(spark, str(tmp_path), "a", make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_scratch_tables_go(spark, tmp_path):
    """Tables of a step go at its end; a folder must be named where the master is no local one."""
    import os

    from grovekit.sources import scratch

    with scratch.released():
        s = scratch.Scratch(spark)
        assert s.save(spark.range(3)).count() == 3 and os.path.isdir(s.root)
    assert not os.path.exists(s.root) and s not in scratch._OPEN

    class Conf:
        get = staticmethod(lambda key, default: None)

    class Elsewhere:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_folder(Elsewhere)


def test_bm25_blocks_that_cannot_matter(spark):
    """The best of each query are those of all scores; more than half of the blocks stay closed."""
    import random

    r = random.Random(3)
    words = {x: [f"{x}{i}" for i in range(60)] for x in "abcd"}
    text = lambda x: " ".join([f"the{x}"] * r.randint(5, 9) + [r.choice(words[x]) for _ in range(r.randint(3, 40))])
    docs = [("v" if i % 9 else "w", i, i, text("abcd"[i * 7 % 4]), i % 3 == 0) for i in range(900)] + [("v", 2000, 2000, "", False), ("v", 2001, 2001, None, True)]
    corpus = spark.createDataFrame(docs, "vault string, id long, ord long, text string, g boolean")
    q = spark.createDataFrame([(r.choice("vw"), 5000 + i, text(r.choice("abcd"))) for i in range(60)] + [("v", 9000, "nothing known"), ("v", 9001, None)], "vault string, id long, text string")
    every = retrieval.bm25_scores(corpus, q, part="g")
    counts = retrieval.Counts(spark)
    for part in (None, "g"):
        keys = ["vault", "id", *([part] if part else [])]
        want = {(x.vault, x.id, x.doc, x.rk) for x in retrieval.top_k(every, keys, 4).collect()}
        got = {(x.vault, x.id, x.doc, x.rk) for x in retrieval.top_k(retrieval.bm25_scores(corpus, q, k=4, part=part, block=500, counts=counts), keys, 4).collect()}
        assert got == want and want
    assert 0 < counts.opened.value < counts.all.value / 2


def test_ranks_and_percentiles(spark):
    """Against sorted lists: ties, nulls, one value, one row, very different sizes and values."""
    from grovekit.operators import ranks

    rows = [("a", float(i * 7919 % 1000)) for i in range(2000)] + [("b", 5.0)] * 40 + [("c", None), ("d", -1.5), (None, 2.0), (None, 4.0), ("e", 1e-300), ("e", 1e300), ("e", 3.0), ("f", None), ("f", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r.g, r.share): r.x for r in ranks.percentiles(df, "g", "x", (0.0, 0.3, 0.5, 0.95, 1.0), buckets=8).collect()}
    for g in {g for g, x in rows if x is not None}:
        own = sorted(x for h, x in rows if h == g and x is not None)
        for s in (0.0, 0.3, 0.5, 0.95, 1.0):
            at = s * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert math.isclose(got[g, s], low + (high - low) * (at - math.floor(at)), rel_tol=1e-12), (g, s)
    assert len(got) == 5 * 6 and ranks.percentiles(df.filter("false"), "g", "x", (0.5,)).count() == 0
    for keys in ([], ["g"]):
        out = ranks.ranked(df, [F.col("x").desc_nulls_last()], keys).collect()
        by = {}
        for r in out:
            by.setdefault(r.g if keys else 0, []).append((r["rank"], r.x))
        for own in by.values():
            own.sort()
            assert [k for k, _ in own] == list(range(1, len(own) + 1))
            values = [x for _, x in own]
            assert values == sorted((x for x in values if x is not None), reverse=True) + [None] * values.count(None)
    plan = ranks.ranked(df, ["x"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and ranks.ranked(df.filter("false"), ["x"]).count() == 0


def test_resampling_by_hand(spark):
    """Every draw and every permutation anew, one by one."""
    import hashlib

    md5 = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    rows = [("all", f"v{i}", arm, (i * 3 + len(arm)) % 7, 7 + i % 2) for i in range(6) for arm in ("x", "yy") if not (i == 2 and arm == "x")] + [("one", "v0", "x", 1, 2)]
    reps = 60
    got = {(r.bucket, r.arm): (r.acc, r.low, r.high) for r in resampling.bootstrap(spark.createDataFrame(rows, "bucket string, vault string, arm string, h long, n long"), reps, 4).collect()}
    for bucket, arm in {(r[0], r[2]) for r in rows}:
        own = sorted({r[1] for r in rows if r[0] == bucket})
        stats = []
        for rep in range(reps):
            drawn = [own[int(md5(4, rep, j)[:15], 16) % len(own)] for j in range(len(own))]
            hit = [r for v in drawn for r in rows if r[:3] == (bucket, v, arm)]
            if hit:
                stats.append(sum(r[3] for r in hit) / max(1, sum(r[4] for r in hit)))
        stats.sort()
        q = lambda s: stats[math.floor(s * (len(stats) - 1))] + (stats[math.ceil(s * (len(stats) - 1))] - stats[math.floor(s * (len(stats) - 1))]) * (s * (len(stats) - 1) % 1)
        assert math.isclose(got[bucket, arm][1], q(0.025), abs_tol=1e-12) and math.isclose(got[bucket, arm][2], q(0.975), abs_tol=1e-12)
    data = [("k", f"v{i}", x, y) for i, (x, y) in enumerate([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 4.0), (4.0, 9.0)])] + [("lone", "v0", 1.0, 1.0)]
    out = {r.key: r for r in resampling.rank_correlation(spark.createDataFrame(data, "key string, vault string, x double, y double"), ("key",), "x", "y", 200, 1).collect()}
    pairs = [(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)]
    corr = lambda ps: sum((a - 3) * (b - 3) for a, b in ps) / 10
    null = [corr([(pairs[i][0], k + 1) for k, i in enumerate(sorted(range(5), key=lambda i: (md5(1, rep, f"v{i}"), f"v{i}")))]) for rep in range(200)]
    assert math.isclose(out["k"].rho, corr(pairs)) and math.isclose(out["k"].p, sum(abs(c) >= abs(corr(pairs)) - 1e-9 for c in null) / 200) and out["lone"].rho is None and out["lone"].p is None


def test_projection_against_all_folders(spark):
    """The folder of the longest common beginning among all of the vault, by comparing with each."""
    import random

    r = random.Random(5)
    key = lambda: "/" + "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
    dirs = {("v", key()) for _ in range(25)} | {("w", "/a/b")}
    preds = [(s, i, key()) for s in "vwz" for i in range(40)]
    got = {(x.vault, x.id): x.projected for x in placers.project_to_existing(spark.createDataFrame(preds, "vault string, id long, pred string"), spark.createDataFrame(sorted(dirs), "vault string, path_key string")).collect()}
    parts = lambda k: [x for x in k.split("/") if x]
    for s, i, p in preds:
        a = parts(p)
        known = [(d != p, -next((k for k in range(len(a) + 1) if k == len(a) or k >= len(parts(d)) or a[k] != parts(d)[k])), abs(len(a) - len(parts(d))), len(parts(d)), d) for v, d in dirs if v == s]
        assert got[s, i] == (min(known)[-1] if known else None), (s, p)


def test_cosines_behind_pivots(spark):
    """Cells that are too far stay closed, and no result is lost; vectors of no length, and equal ones, included."""
    import numpy as np

    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8))
    x = centres[r.integers(0, 12, 900)] + 0.15 * r.normal(size=(900, 8))
    x[5], x[6] = 0, x[7]
    rows = [(i, i, f"s{i % 2}", v.tolist(), i % 5 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, ord long, scope string, vector array<double>, g boolean")
    q = df.filter("id % 3 = 0").select("id", "scope", "vector")
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    cos = unit @ unit.T
    for scope, part in ((None, None), ("scope", None), ("scope", "doc_g")):
        counts = retrieval.Counts(spark)
        keys = ["id", *([part] if part else [])]
        got = {(a.id, a.doc, a.rk) for a in retrieval.top_k(retrieval.cosine_scores(df, q, scope, 3, part, counts=counts), keys, 3).collect()}
        want = set()
        for i in range(0, 900, 3):
            for g in ((True, False) if part else (None,)):
                near = sorted((-round(cos[i, j], 9), j) for j in range(900) if (scope is None or j % 2 == i % 2) and (g is None or (j % 5 == 0) == g))[:3]
                want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
        assert got == want
        assert 0 < counts.opened.value < 0.6 * counts.all.value
    for least, block in ((0.95, 100), (0.9, 2000), (0.3, 150)):
        pairs = {(a.a, a.b) for a in retrieval.near_pairs(df.select("id", "scope", "vector"), least, "scope", block).collect()}
        assert pairs == {(i, j) for i in range(900) for j in range(i + 1, 900) if i % 2 != j % 2 and round(cos[i, j], 6) >= least}
    assert retrieval.near_pairs(df.filter("false").select("id", "scope", "vector"), 0.9, "scope").count() == 0


def test_synthetic_corpora_are_whole(spark):
    """The numbers of rows of a kind, and gold and misleading notes that are there and apart."""
    t = corpus.synthetic_trees(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "tree string"), "tree").collect()
    count = lambda rows, kind, **of: sum(r.kind == kind and all(r[k] == v for k, v in of.items()) for r in rows)
    assert [count(t, k, tree="b") for k in ("dir", "fact", "task", "query")] == [11, 34, 30, 16]
    notes = {r.id: r for r in t if r.kind == "fact"}
    assert len(notes) == 3 * 34 and {r.path_key for r in notes.values()} <= {r.path_key for r in t if r.kind == "dir"}
    for r in t:
        if r.kind == "query":
            assert all(notes[g].tree == r.tree and notes[g].twin_key == r.twin_key for g in r.gold.split(",")) and r.n_distractors in (0, 2)
    c = corpus.confusable_corpora(spark.createDataFrame([(1,), (2,)], "k int"), "k").collect()
    assert [count(c, k, corpus="2") for k in ("fact", "project", "global", "mixed", "adversarial", "identity")] == [104, 64, 5, 6, 3, 1]
    ids = {r.id: r for r in c if r.kind == "fact"}
    for r in c:
        if r.kind != "fact":
            gold, wrong = set(r.gold.split(",")), set(r.distractors.split(","))
            assert gold | wrong <= set(ids) and not gold & wrong and all(ids[x].corpus == r.corpus for x in gold | wrong)
            if r.kind == "identity":
                assert {ids[x].text for x in gold | wrong} == {ids[r.gold].text}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_scores_are_made_once(spark):
    """What goes back to the scores reads a written table: a plan that scores would do so for each time."""
    from grovekit.plans import q_corpus, q_retrieval

    for query in (q_corpus.d12b_pinned_sample, q_retrieval.e6_bm25_topk, q_retrieval.e15_snippets):
        assert "InArrow" not in _plan(query(spark, SF))
    assert "substring(text" in _plan(q_retrieval.e15_snippets(spark, SF)).split("Optimized Logical Plan")[1].split("Join", 1)[1].split("collect_list")[-1]


def test_bm25_moves_blocks(spark):
    """Blocks of texts meet as one row each, whatever is in them; a scope of all notes is no single task's join."""
    docs = spark.createDataFrame([("v", i, i, f"w{i % 7} w{i % 11} the") for i in range(90)], "vault string, id long, ord long, text string")
    words = docs.select("vault", F.col("id").alias("doc"), F.col("text").alias("words"), F.lit(9).alias("size"))
    blocks = retrieval._token_blocks(words, "vault", ["doc"], 30).collect()
    assert len(blocks) == 3 and sum(b.n for b in blocks) == 90 and sum(b.tokens for b in blocks) == 270
    plan = _plan(retrieval.bm25_scores(docs, docs.select("vault", "id", "text"), k=2, block=30))
    assert "FlatMapCoGroupsInArrow" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("strips", [(12, 4), (2, 1)])
def test_bm25_strips(spark, monkeypatch, strips):
    """A block goes to a few strips and not to every block of the other side; the best across a strip's blocks, ties among them and
    those of each part are as a sort of all pairs has them."""
    monkeypatch.setattr(retrieval, "STRIP", strips[0])
    monkeypatch.setattr(retrieval, "STRIPS", strips[1])
    sent, strip = [], retrieval._strips
    monkeypatch.setattr(retrieval, "_strips", lambda *a: (sent.append((a[0], a[2], strip(*a))), sent[-1][2])[1])
    docs = spark.createDataFrame([(f"v{i % 7 // 6}", i, i, f"w{i % 5} x{i % 11} y{i % 3} " + "the " * (i % 4), i % 3 == 0) for i in range(400)], "vault string, id long, ord long, text string, g boolean")
    q = spark.createDataFrame([(f"v{i % 7 // 6}", 1000 + i, f"w{i % 5} w{i % 4} x{i % 13} the") for i in range(150)] + [("v0", 2000, "unknown"), ("v0", 2001, None)], "vault string, id long, text string")
    every = retrieval.bm25_scores(docs, q, part="g", block=2000).collect()
    assert {(x.id, x.doc): round(x.score, 9) for x in every} == {(x.id, x.doc): round(x.score, 9) for x in retrieval.bm25_scores(docs, q, block=9).collect()}
    for part in (None, "g"):
        keys = ["vault", "id", *([part] if part else [])]
        ranked = {}
        for x in sorted(every, key=lambda x: (-round(x.score, 9), x.doc_ord)):
            ranked.setdefault(tuple(x[c] for c in keys), []).append(x.doc)
        best = retrieval.bm25_scores(docs, q, k=3, part=part, block=9)
        got = {}
        for x in sorted(retrieval.top_k(best, keys, 3).collect(), key=lambda x: x.rk):
            got.setdefault(tuple(x[c] for c in keys), []).append(x.doc)
        assert got == {key: docs[:3] for key, docs in ranked.items()} and got
    asked, notes, both = sent[-1]
    n_q, n_d = ({x["vault"]: x["count"] for x in t.groupBy("vault").count().collect()} for t in (asked, notes))
    n_strips = lambda n: min(n, max(strips[1], -(-n // strips[0])))
    sides = {(x["vault"], x["_side"]): x["count"] for x in both.groupBy("vault", "_side").count().collect()}
    for v in n_q:
        assert n_q[v] > 1 and n_d[v] > 6 and sides[v, "query"] == n_q[v] * n_strips(n_d[v]) and sides[v, "note"] == n_d[v] * n_strips(n_q[v])
    assert strips[1] < 4 or sum(n for (_, side), n in sides.items() if side != "df") <= 4 * (sum(n_q.values()) + sum(n_d.values()))


def test_hybrid_has_no_row_for_a_neighbour(spark):
    """Against a loop over all notes, where one folder has most of them; the plan has no join of queries with neighbours."""
    import random

    r = random.Random(5)
    paths = [["a"], ["a", "b"], ["a", "b", "c"], ["d"]]
    rows = [("v", i, i, p, "/" + "/".join(p), [r.uniform(-1, 1) for _ in range(3)]) for i in range(60) for p in [paths[0 if i % 20 == 0 else 3 if i % 9 == 0 else 2 if i % 7 == 0 else 1]]]
    notes = spark.createDataFrame(rows, "vault string, id long, ord long, path array<string>, path_key string, vector array<double>")
    out = retrieval.hybrid(notes, notes.select("vault", "id", "vector"), 4, 2)
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    near = lambda p, q: p == q or p[:-1] == q and q != [] or q[:-1] == p and p != []
    want = set()
    for q in rows:
        order = lambda some: sorted((x for x in some if x[1] != q[1]), key=lambda x: (-round(cos(q[5], x[5]), 9), x[2]))  # noqa: E731, B023
        cand = [x for x in rows if x[1] != q[1] and any(near(s[3], x[3]) for s in order(rows)[:2])]
        want |= {(q[1], x[1], len(cand), k + 1) for k, x in enumerate(order(cand)[:4])}
    assert {(x.id, x.doc, x.n_candidates, x.rk) for x in out.collect()} == want
    assert "zip_with" not in _plan(out)


def test_prompts_come_in_small_batches(spark, monkeypatch):
    """A worker holds a few hundred claims with the texts shown, whatever the size of its part; the setting is as before after it."""
    from grovekit.operators import policies

    name, seen, save = "spark.sql.execution.arrow.maxRecordsPerBatch", [], policies.Scratch.save
    before = spark.conf.get(name)
    monkeypatch.setattr(policies.Scratch, "save", lambda self, df: (seen.append(int(spark.conf.get(name))), save(self, df))[1])
    claims = spark.sql("SELECT id, 'a claim' AS text, CAST(NULL AS string) AS project, CAST(NULL AS array<struct<id:bigint,text:string,sim:double>>) AS related FROM range(3)")
    assert policies.decide_by_model(claims, lambda prompts: ['[{"event": "ADD", "text": "x"}]'] * len(prompts)).filter("NOT invalid").count() == 3
    assert seen and max(seen) <= pickers.PROMPTS and spark.conf.get(name) == before
    with pickers.few_prompts(spark):
        sizes = spark.range(1000, numPartitions=1).mapInPandas(lambda frames: (f.assign(id=len(f)) for f in frames), "id long")
        assert sizes.agg(F.max("id")).first()[0] == pickers.PROMPTS


def test_single_precision_tells_only_who_may_be_best():
    """Of scores that are off by a share, all that are among the best or tie with them are still there, and few others."""
    import numpy as np

    r = np.random.default_rng(3)
    for n, k in ((40, 3), (5000, 24), (5000, 5)):
        for exact in (r.random(n) * 90, np.repeat(r.random(n // 20) * 90, 20), 50 + r.random(n) * 1e-4):
            exact[:7] = 0
            off = 1e-5
            at = retrieval._may_be_best(exact * (1 + off * r.uniform(-1, 1, n)), k, off)
            best = np.flatnonzero(exact >= np.sort(exact)[-k] - 1e-9)
            assert set(best) <= set(at) and not set(range(7)) & set(at)
    assert len(retrieval._may_be_best(np.arange(1.0, 9001.0), 24, 1e-6)) == 24


def test_bm25_of_notes_that_differ_little(spark):
    """Scores that single precision takes for one are ranked as a sort of all pairs ranks them."""
    docs = [("v", i, i, " ".join(["a b c d"] * 60 + [f"e{i % 3}"] * (1 + i // 3 % 2) + ["f"] * (400 + i // 6))) for i in range(120)]
    corpus = spark.createDataFrame(docs, "vault string, id long, ord long, text string")
    q = spark.createDataFrame([("v", 1000 + i, "a a a b c d f e0 " + "f " * i) for i in range(5)], "vault string, id long, text string")
    every = retrieval.top_k(retrieval.bm25_scores(corpus, q), ["id"], 6).collect()
    best = retrieval.top_k(retrieval.bm25_scores(corpus, q, k=6), ["id"], 6).collect()
    assert {(x.id, x.rk, x.doc) for x in best} == {(x.id, x.rk, x.doc) for x in every} and len(best) == 30


def test_cascade_moves_no_lists_of_words(spark):
    """To the shortlists go the distinct words of the items to place as one string, not all words of all items as lists."""
    from grovekit.plans import q_retrieval

    plan = _plan(q_retrieval.f8_cascade(spark, SF)).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    made = [x for x in plan.split("\n") if "regexp_extract_all" in x and "gold" in x]
    assert made and all("array_join(array_distinct(" in x for x in made)


def test_near_pairs_send_a_vector_once_a_block(spark, monkeypatch):
    """Where all cells can hold pairs, small ones go together: blocks meet, and not each cell with each."""
    import random

    r, made = random.Random(9), []
    df = spark.createDataFrame([(i, f"v{i % 3}", [r.gauss(0, 1) for _ in range(12)]) for i in range(200)], "id long, vault string, vector array<double>")
    rows, make = df.collect(), type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (made.append(len(data)), make(self, data, *a, **k))[1])
    got = {(x.a, x.b) for x in retrieval.near_pairs(df, 0.6, "vault", 10).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    assert got == {(x.id, y.id) for x in rows for y in rows if x.id < y.id and x.vault != y.vault and round(cos(x.vector, y.vector), 6) >= 0.6} and got
    assert max(made) <= 80  # cells; pairs of them that meet would be some 3,000


def test_all_pairs_come_in_small_blocks(spark):
    """A task makes a million pairs at most at a time where all are asked for."""
    df = spark.createDataFrame([("v", i, [1.0, float(i)]) for i in range(3)], "vault string, id long, vector array<double>")
    assert f"{retrieval.PAIR_BLOCK}.0" in _plan(retrieval.cosine_scores(df, df)) and retrieval.PAIR_BLOCK**2 <= 1_000_000
    assert retrieval.cosine_scores(df, df).count() == 9


def test_hash_vector_by_hand(spark):
    """Texts are cut and hashed once, a batch at a time, and not by an expression that runs for each cell."""
    import hashlib
    import re

    texts = ["A a b/c  9.5", "", None, "x\ny " * 40, "w" * 100 + " a a\u00e9b", "!?"]

    def want(text):
        out = [0.0] * 16
        for t in re.findall("[a-z0-9_./+-]+", (text or "").lower()):
            number = lambda kind: int(hashlib.md5(f"{kind}|{t}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
            out[number("cell") % 16] += 1.0 if number("sign") % 2 == 0 else -1.0
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", retrieval.hash_vector(F.col("text")).alias("v"))
    assert {r["id"]: r["v"] for r in df.collect()} == {i: want(t) for i, t in enumerate(texts)}
    assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_token_text_is_the_tokens(spark):
    """Letters that fold into the range, and those whose lower case is longer or depends on its neighbours."""
    from grovekit.functions.text import token_text, tokenize

    df = spark.createDataFrame([("A \u017f \u212a\u0130x \u0131B \u03a3a\u03a3",), ("",), (None,), ("a  B/c",)], "t string")
    assert df.filter(F.array_join(tokenize(F.col("t")), " ") != token_text(F.col("t"))).count() == 0


@pytest.mark.parametrize("strips", [(16, 8), (2, 1)])
def test_vector_strips(spark, monkeypatch, strips):
    """A vector goes to a few strips and not to every block of the other side; the best of vectors that no cell keeps apart, and of
    each part, are those of all pairs, with exact and near copies and vectors of no length."""
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTOR_STRIP", strips[0])
    monkeypatch.setattr(retrieval, "VECTOR_STRIPS", strips[1])
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 24))
    x[7::50], x[8::50] = x[3], x[3] * 2 + 1e-7 * r.normal(size=(12, 24))
    x[11], x[12] = 0, 0
    df = spark.createDataFrame([(i, i, v.tolist(), i % 5 == 0) for i, v in enumerate(x)], "id long, ord long, vector array<double>, g boolean")
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    cos = unit @ unit.T
    q = df.select("id", "vector")
    for part in (None, "doc_g"):
        scores = retrieval.cosine_scores(df, q, None, 4, part, block=100)
        got = {(a.id, a.doc, a.rk) for a in retrieval.top_k(scores, ["id", *([part] if part else [])], 4).collect()}
        want = set()
        for i in range(600):
            for g in ((True, False) if part else (None,)):
                near = sorted((-round(cos[i, j], 9), j) for j in range(600) if g is None or (j % 5 == 0) == g)[:4]
                want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
        assert got == want


@pytest.mark.parametrize("block", [3, 1000])
def test_path_graph_in_blocks(spark, monkeypatch, block):
    """Pairs of blocks of a folder are dealt out, none is lost or comes twice, and no task has a folder's square."""
    monkeypatch.setattr(retrieval, "EDGE_BLOCK", block)
    paths = [["a"], ["a", "b"], ["a", "b", "c"], ["d"], ["x", "y"]]
    rows = [(f"v{i % 2}", i, paths[i % 7 % 5]) for i in range(60)] + [("v0", 100, ["d"]), ("v2", 101, ["a"]), (None, 102, ["a"]), (None, 103, ["a"])]
    n = spark.createDataFrame(rows, "vault string, id long, path array<string>").withColumn("path_key", F.concat(F.lit("/"), F.array_join("path", "/")))
    got = [tuple(r) for r in retrieval.path_graph(n).select("vault", "a", "b").collect()]
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and x[1] != y[1] and (x[2] == y[2] or x[2][:-1] == y[2] or y[2][:-1] == x[2])}
    assert len(got) == len(set(got)) and set(got) == want
    folder = n.filter("vault = 'v0' AND path_key = '/a'").select("vault", F.col("path_key").alias("_key"), "id")
    pairs = retrieval._all_pairs(folder, folder, "vault")
    used = pairs.select(F.spark_partition_id()).distinct().count()
    assert (used > 1) == (block == 3)
