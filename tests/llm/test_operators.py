"""The training-data operators against brute force on small fixtures, with nulls, empty and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grovekit.llm import chat, exact_dedup, lm_scoring, ngram_join, packing, pieces, quality, sharding, suffix_dedup
from grovekit.llm.common import TextBlock, text_buffers

WS = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(n=120, seed=1):
    """Texts with copies, near copies, shared passages, odd characters; nulls, empties, repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(150)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    base, shared = [text(r.randint(3, 120)) for _ in range(20)], [text(60) for _ in range(3)]
    rows = []
    for i in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        t = r.choice([" ", "\n", "\t "]).join(w)
        rows.append((i, t + ("\n" + r.choice(shared) + "\n" + text(20) if r.random() < 0.4 else "")))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "ab" * 400), (904, "x" * 150), (905, rows[3][1]), (905, rows[3][1]), (906, rows[3][1].upper()), (None, rows[4][1]), (907, "\x00 \x85 \u00a0 one two"), (908, "one line\n" * 40)]
    return rows


def frame(spark, rows):
    """With columns whose names might clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, bucket string, n long, cls long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_quality_report(spark):
    rows = documents()
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = set()
        for k in range(len(w) - 7):
            if grams[tuple(w[k : k + 8])] > 1:
                cover.update(range(k, k + 8))
        chars, sym, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        stutter = sum(a == b for a, b in zip(w, w[1:]))
        bad = 10 * sym > len(w) or 2 * dup > len(lines) or not 2 * len(w) <= chars <= 14 * len(w) or 100 * stutter > 25 * len(w) or 2 * len(re.findall("[0-9]", t)) > chars
        want.append((i, len(w), chars, sym, dup, len(cover), failed, not (failed or bad)))
    df = frame(spark, rows)
    assert order(quality.quality_report(df).collect()) == order(want)
    kept = sorted(str(r["doc_id"]) for r in quality.quality_filter(df).collect())
    assert kept == sorted(str(x[0]) for x in want if x[-1])
    assert quality.quality_report(empty(spark)).count() == 0 and quality.quality_filter(empty(spark)).count() == 0


def test_rule_order():
    """By rejection per cost, where a rule costs what is not computed yet."""
    rule = lambda n: quality.Rule(n, None)
    uses = {"a": frozenset({"x"}), "b": frozenset({"y"}), "c": frozenset({"x", "z"}), "x": frozenset({"w"}), "z": frozenset({"w"})}
    figures = quality.Figures({"a": 0.1, "b": 0.8, "c": 0.09}, {"w": 1.0, "x": 1.0, "y": 4.0, "z": 0.5}, uses)
    names = lambda given=(): [r.name for r in quality.plan(figures, tuple(map(rule, "abc")), given)]
    assert figures.all_of("c") == {"w", "x", "z"} and names() == ["b", "a", "c"] and names((rule("a"),)) == ["a", "b", "c"]


def test_rules_see_what_is_left(spark):
    """In a report each rule is given fewer documents than the one before it, the first those that the base rules leave; figures
    of some documents are those of a block that has them alone."""
    texts = [t or "" for _, t in documents(300, 7)] + [" ".join(f"w{i}#" for i in range(40)), " ".join(str(10**6 + i * 7919) for i in range(40)), " ".join(f"v{i} v{i}" for i in range(30)), "word " * 3]
    block = TextBlock(*text_buffers(pa.array(texts)))
    m = quality.Measures(block)
    failed = np.zeros(block.n, bool)
    for r in quality.BASE_RULES:
        failed |= r.rejects(m)
    seen = []
    counted = [quality.Rule(r.name, lambda x, r=r: (seen.append(x.n), r.rejects(x))[1]) for r in quality.VERDICT_RULES]
    alive = np.flatnonzero(~failed)
    kept = quality.cascade(m, counted, alive)
    assert seen[0] == len(alive) < block.n and seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    bad = np.zeros(block.n, bool)
    for r in quality.VERDICT_RULES:
        bad |= r.rejects(quality.Measures(block))
    assert (kept == ~failed & ~bad).all()
    names = [n[5:] for n in dir(quality.Measures) if n.startswith("_get_n_")] + ["word_chars"]
    for ready in ([], ["words"], ["word_hash", "lines"], ["n_digits", "n_stutter"]):
        whole = quality.Measures(block)
        [getattr(whole, x) for x in ready]
        rows = np.flatnonzero(np.arange(block.n) % 3 != 1)
        part, alone = whole.only(rows), quality.Measures(TextBlock(*text_buffers(pa.array([texts[i] for i in rows]))))
        for n in names:
            assert (getattr(part, n) == getattr(alone, n)).all(), (ready, n)
    f = quality.estimate(frame(spark, list(enumerate(texts))))
    assert set(f.share) == {r.name for r in quality.RULES} and f.all_of("stutter") >= {"n_stutter", "n_words", "words", "word_hash", "prefix"} and f.cost["n_digits"] > 0
    first = quality.plan(f, quality.VERDICT_RULES, quality.BASE_RULES)
    assert {r.name for r in first} == {r.name for r in quality.VERDICT_RULES} and first[-1].name in ("stutter", "digits", "duplicate_lines", "symbols")


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_exact_groups(spark, id_bytes):
    """Identifiers of one byte collide all the time; verified ones must still tell texts apart."""
    rows = [*documents(), (None, None), (None, None), (910, "long " * 300_000), (911, " long" * 300_000)]
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((i, len(t or "")))
    want = []
    for k, g in groups.items():
        keep = min(g, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        done = False
        for x in sorted(g, key=repr):
            stays = x == keep and not done
            done |= stays
            want.append((x[0], keep[0], len(g), stays, hashlib.sha256(k.encode()).hexdigest()))
    df = frame(spark, rows)
    got = exact_dedup.exact_groups(df, id_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert order(got) == order(want)
    if id_bytes == 16:
        assert sorted(str(r["doc_id"]) for r in exact_dedup.exact_dedup(df).collect()) == sorted(str(x[0]) for x in want if x[3])
        assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_only_repeated_chunks_are_moved(spark):
    """Bytes that are compared follow the chunks that recur, in one document or in several."""
    r = random.Random(11)
    text = lambda k: " ".join("%016x" % r.getrandbits(64) for _ in range(k))
    alone, twice = [text(2000) for _ in range(30)], text(3000)
    moved = {}
    for name, texts in {"none": alone, "some": [*alone, twice, twice], "within": [*alone[:5], twice + " " + twice], "all": [*alone, *alone]}.items():
        scratch = exact_dedup.Scratch(spark)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        cooked = scratch.save(exact_dedup._cook(df, 16))
        moved[name] = exact_dedup.shipped_chunks(df, cooked, 16, scratch).selectExpr("sum(length(chunk)) AS n").first().n or 0
    size = len(alone[0].replace(" ", "")) * 30
    assert moved["none"] < 0.02 * size and 0.8 * 48_000 < moved["within"] < 60_000 and 0.8 * 48_000 < moved["some"] < 2 * 48_000 + 0.02 * size and moved["all"] > 0.9 * size


@pytest.mark.parametrize("size,most", [(1, 64), (1, 1)])
def test_identifiers_are_verified(spark, monkeypatch, size, most):
    """Colliding identifiers are made longer until they tell all chunks apart; at last the chunks themselves do."""
    monkeypatch.setattr(exact_dedup, "MOST_ID_BYTES", most)
    df = frame(spark, documents()).select("doc_id", "text")
    sizes = {len(r.recipe) for r in exact_dedup.recipes(df, size).collect() if r.recipe}
    assert min(sizes) > 5 if most == 1 else any(g in sizes and all(s % g == 0 for s in sizes) for g in (2, 4, 8))
    texts = {WS.sub("", t or "") for _, t in documents()}
    assert exact_dedup.recipes(df, size).select("recipe").distinct().count() == len(texts)


def brute_windows(rows, width=200):
    enc = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + width] for _, b in enc for s in range(len(b) - width + 1))
    out = []
    for i, b in enc:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("spread", [100_000, 2])
def test_suffix_dedup(spark, spread):
    rows = documents()
    assert order(suffix_dedup.repeat_report(frame(spark, rows), spread=spread).collect()) == order(brute_windows(rows))


@pytest.mark.parametrize("spread", [100_000, 2])
def test_suffix_dedup_with_a_weak_hash(monkeypatch, spread):
    """With hashes that take four values every match must still come from the sorted buckets, and none that is not one.

    The steps are run one after another without the engine, as its workers would not see the patched hash.
    """
    weak = lambda prefix, start, end: (end - start).astype(np.uint64) * np.uint64(7) + (prefix[end] - prefix[start]) % np.uint64(4)
    monkeypatch.setattr(suffix_dedup, "span_hash", weak)
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x % np.uint64(4))
    rows = [(i, (t or "")[:400]) for i, t in documents(30) if i is not None and i != 905]
    block = TextBlock(*text_buffers(pa.array([t for _, t in rows])))
    ids = np.array([i for i, _ in rows])
    at, doc, h, around = suffix_dedup.anchors(block)
    c = suffix_dedup._contexts(block, ids, at, doc, suffix_dedup.K)
    c["g"] = h
    if spread == 2:
        c = np.concatenate(list(suffix_dedup._in_sections(c, h, suffix_dedup.K)))
    half = len(c) // 2
    spans = []
    kept = []
    for part in (c[:half], c[half:]):  # two parts, as of two tasks
        one, settled = suffix_dedup._collapsed(part, np.argsort(part["g"], kind="stable"), suffix_dedup.K)
        kept.append(one), spans.append(settled)
    spans.append(suffix_dedup.sort_contexts(np.concatenate(kept), suffix_dedup.K))
    gone = suffix_dedup._removed(block, ids, suffix_dedup._by_document(np.concatenate(spans)))
    want = {i: n for i, _, n, _, _ in brute_windows(rows)}
    assert dict(zip(ids.tolist(), block.per_doc(gone).tolist())) == want and sum(want.values()) > 1000


def test_surroundings_that_parts_share_are_settled_unsorted(monkeypatch):
    """Of surroundings that two parts have alike, one goes to the sort, and all are found."""
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    block, rest = (TextBlock(*text_buffers(pa.array(t))) for t in ([text], [text, "x" * 90 + text[:700]]))
    parts, sorted_rows, found = [], [], suffix_dedup.repeated_windows
    for ids, b in ((np.array([1]), block), (np.array([2, 3]), rest)):
        at, doc, h, around = suffix_dedup.anchors(b)
        c = suffix_dedup._contexts(b, ids, at, doc, suffix_dedup.K)
        c["g"] = h
        parts.append(suffix_dedup._collapsed(c, np.lexsort((around, h)), suffix_dedup.K))
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda g, x, *a: (sorted_rows.append(len(x)), found(g, x, *a))[1])
    spans = suffix_dedup._merged(np.concatenate([*(s for _, s in parts), suffix_dedup.sort_contexts(np.concatenate([c for c, _ in parts]), suffix_dedup.K)]))
    assert [(d, s, e) for d, s, e in zip(spans["d"].tolist(), spans["s"].tolist(), spans["e"].tolist())] == [(1, 0, 900), (2, 0, 900), (3, 90, 790)]
    assert sum(sorted_rows) < sum(len(c) for c, _ in parts) // 2


@pytest.mark.parametrize("spread", [100_000, 2])
@pytest.mark.parametrize("parts", [1, 3])
def test_copies_beside_a_spread_passage(spark, parts, spread):
    """Two copies of a short own text beside a passage of many rows, before or after it, and rows alike in id and text."""
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, rows = text(500), []
    for i in range(12):
        own = text(r.randint(5, 90))
        rows += [(4 * i + j, own + passage if i % 2 else passage + own) for j in range(2)]
        rows += [(4 * i + 2, text(r.randint(5, 90)) + passage + text(20))] * 2
    df = frame(spark, rows).repartitionByRange(parts, "doc_id") if parts == 1 else frame(spark, rows[::4] + rows[2::4]).coalesce(1).union(frame(spark, rows[1::4]).coalesce(1)).union(frame(spark, rows[3::4]).coalesce(1))
    assert order(suffix_dedup.repeat_report(df, spread=spread).collect()) == order(brute_windows(rows))


def test_suffix_dedup_of_odd_tables(spark):
    """Null ids with different texts, a very long text, an empty table."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b = text(300), text(2_000_000)
    rows = [(None, a), (None, text(300)), (None, text(100) + a), (7, b), (8, b[:1000] + text(50)), (9, None), (9, "")]
    got = {(x["doc_id"], x["n_bytes"]): x["n_removed"] for x in suffix_dedup.repeat_report(frame(spark, rows)).collect()}
    assert got == {(None, 300): 300, (None, 400): 300, (7, 2_000_000): 1000, (8, 1050): 1000, (9, 0): 0} or got[None, 300] in (0, 300) and got[None, 400] == 300
    assert sorted(x["n_removed"] for x in suffix_dedup.repeat_report(frame(spark, rows)).collect()) == [0, 0, 0, 300, 300, 1000, 1000]
    assert suffix_dedup.repeat_report(empty(spark)).count() == 0


def test_sections():
    for k in (1, 2, 3, 5, 50, 100):
        assert [o for a, b in suffix_dedup.sections(k) for o in range(a, b + 1)] == list(range(k + 1))


def test_suffix_order():
    """Ranks at cover columns and sorted columns are those of the suffixes themselves."""
    r = np.random.default_rng(3)
    x = r.integers(97, 99, (60, 60), dtype=np.uint8)
    x[30:] = x[:30]
    group = np.repeat([0, 1], 30)
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    ranks = suffix_dedup.cover_ranks(group, x)
    for column in (0, 1, 2, 5, 40):
        rows = suffix_dedup.sort_column(group, x, column, np.arange(60), ranks)
        keys = [(group[i], x[i, column:].tobytes()) for i in rows]
        assert keys == sorted(keys)


@pytest.mark.parametrize("form", ["quality_filter", "exact_dedup", "near_dedup", "remove_repeats", "place"])
def test_clashing_columns(spark, form):
    """Columns whose names operators might use inside come back unchanged, of whatever type."""
    from pyspark.sql import functions as F

    forms = {"quality_filter": quality.quality_filter, "exact_dedup": exact_dedup.exact_dedup, "near_dedup": ngram_join.near_dedup, "remove_repeats": suffix_dedup.remove_repeats, "place": sharding.place}
    names = ["bucket", "n", "row", "id", "sha", "points", "whole", "cls", "label", "list_id", "_sha", "_slot", "_shard", "_salt", "_twin", "_bucket", "payload", "kept", "part", "chunk"]
    rows = [(i, t) for i, t in documents(40) if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.hash("text").cast("string")) for c in names})
    df = df.withColumn("double", F.col("doc_id") * 0.5).withColumn("struct", F.struct(F.col("doc_id").alias("a"), F.array("text").alias("b"))).withColumn("map", F.create_map(F.lit("k"), F.col("doc_id")))
    out = forms[form](df)
    assert out.columns[: len(df.columns)] == df.columns
    before = {(r["doc_id"], r["sha"]): r for r in df.collect()}
    got = out.collect()
    assert len(got) > 5
    for r in got:
        was = before[r["doc_id"], r["sha"]]
        assert all(r[c] == was[c] for c in df.columns if c != "text" or form != "remove_repeats")


def test_remove_repeats_keeps_characters_whole(spark):
    p = "é" * 100
    rows = [(1, "a" + p + "b"), (2, "xé" + p + "y"), (3, None), (4, "short")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert len(got) == 4 and got[3]["text"] is None and got[4]["text"] == "short"
    assert got[1]["text"] == "ab" and got[1]["n_chars"] == 2 and got[2]["text"] in ("xéy", "xy")
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def brute_components(rows):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = -(10**30) if d is None else d
        least[find(i)] = min(least.get(find(i), 10**30), k)
    return [(d, len(sets[i]), None if least[find(i)] == -(10**30) else least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("short,frequent,hot,block", [(4, 3, 256, 2048), (2, 10**6, 3, 5)])
def test_near_duplicates(spark, monkeypatch, short, frequent, hot, block):
    """Also with lists that are long from three classes on, split from four postings on, and in pieces of five."""
    for name, value in (("SHORT_LIST", short), ("FREQUENT_MIN", frequent), ("HOT_POSTINGS", hot), ("LIST_BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "SPLIT", 4)
    rows = [*documents(160), (920, "far " * 200_000), (921, "very far " * 200_000 + "end")]
    assert order(ngram_join.near_duplicates(frame(spark, rows)).collect()) == order(brute_components(rows))


def token_sets(seed=5):
    """Sets that overlap in many ways: from not at all to nearly equal."""
    r, out = random.Random(seed), []
    for _ in range(8):
        base = r.sample(range(10**6), r.randint(8, 200))
        for k in (0, 1, 2, 3, 5, len(base) // 8, len(base) // 4, len(base) // 2, len(base) - 3):
            out.append(np.array(sorted({*base[: len(base) - k], *r.sample(range(10**6, 2 * 10**6), k)}), np.uint64))
    return out


def made_profiles(sets):
    doc, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    data, edge = ngram_join._sketches(doc, token, len(sets))
    sketches = [data[edge[c] : edge[c + 1]].tobytes() for c in range(len(sets))]
    return sketches, [ngram_join.Profile(len(s), x, y) for s, x, y in zip(sets, ngram_join.prefixes(doc, token, len(sets)).to_pylist(), sketches)]


def test_further_orders_hold_pairs_back():
    """No pair that links fails the further orders or the sketch; pairs that share a token of the first order's prefixes
    are held back by the second order, and some that pass it by the third."""
    sets = token_sets()
    _, made = made_profiles(sets)
    first = [set(sorted(s.tolist())[: ngram_join.prefix_length(len(s))]) for s in sets]
    held_by = Counter()
    for a in range(len(sets)):
        for b in range(a):
            if not first[a] & first[b]:
                continue
            x, y = made[a], made[b]
            alone = []
            for k in range(len(ngram_join.ORDERS)):
                one = [ngram_join.Profile.__new__(ngram_join.Profile) for _ in range(2)]
                for o, p in zip(one, (x, y)):
                    o.n, o.prefixes, o.sketch = p.n, p.prefixes[k : k + 1], p.sketch
                alone.append(ngram_join.agree_in_orders(*one))
            assert ngram_join.agree_in_orders(x, y) == all(alone)
            if ngram_join.similar(sets[a], sets[b]):
                assert all(alone) and ngram_join.agree_in_sketch(x, y)
                held_by["link"] += 1
            else:
                held_by["second"] += not alone[0]
                held_by["third"] += alone[0] and not alone[1]
                held_by["left"] += all(alone)
    assert held_by["link"] > 20 and held_by["second"] > 50 and held_by["third"] > 0, held_by


def test_orders_come_before_the_texts(spark, monkeypatch):
    """Candidates of the first order's posting lists that the further orders reject are not among the pairs whose texts
    are fetched; what is fetched holds all links."""
    from grovekit.llm.common import Scratch, text_bytes

    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts, lead = [], [" ".join(r.sample(words, 7)) for _ in range(12)]
    for i in range(48):  # a few words in common at the front, or nearly all
        body = " ".join(r.sample(words, 40))
        texts += [lead[i % 12] + " " + body] + ([lead[i % 12] + " " + body + " tail"] if i % 4 == 0 else [])
    rows = list(enumerate(texts))
    docs, scratch = frame(spark, rows), Scratch(spark)
    size = text_bytes(docs)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 100)
    monkeypatch.setattr(ngram_join, "FREQUENT_MIN", 10**6)  # common words are not put last
    sets = scratch.save(ngram_join.jaccard_sets(docs))
    found = scratch.save(ngram_join._candidates(docs, ngram_join._frequent_tokens(sets, size, scratch), size, (75, 100)))
    classes = sets.filter("kind = 0").selectExpr("cls", "doc_id AS rep", "n")
    profile = ngram_join._profiles(docs, found, classes, scratch, (75, 100))
    pairs = found.filter("a IS NOT NULL").select("a", "b").distinct()
    near = {(x["a_rep"], x["b_rep"]) for x in ngram_join._in_pairs(pairs, profile, (75, 100)).collect()}
    near = {(min(p), max(p)) for p in near}
    linked = {(c, d) for d, _, c in brute_components(rows) if c != d}
    assert linked <= near and len(linked) == 12 and pairs.count() > len(near) + 10


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with different texts, one of them empty, are one document; one of each group stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, a + " more"), (2, b + " more"), (7, c), (7, ""), (4, c + " more"), (8, ""), (6, c), (11, "p q r s t u"), (11, "v w x y z"), (12, None)]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert order(got) == order(brute_components(rows)) and {r["component_id"] for r in got if r["doc_id"] in (2, 5, 9)} == {2}
    assert sorted(r["doc_id"] for r in ngram_join.near_dedup(frame(spark, rows)).collect()) == [2, 4, 8, 11, 11, 12]


@pytest.mark.parametrize("block", [10**6, 7, 1])
def test_long_lists_in_blocks(spark, block):
    """Every pair of a list that links is left, whatever the blocks; none twice, none of one label."""
    sets = token_sets()
    sketches, _ = made_profiles(sets)
    name = lambda c: bytes([0] * 15 + [c])
    profile = spark.createDataFrame([(name(c), bytearray(sketches[c])) for c in range(len(sets))], "cls binary, sketch binary")
    # two lists with all classes, in pieces; odd labels are shared by two neighbours, and a third of all is of one label
    label = [0 if c % 3 == 0 else c - c % 4 if c % 4 == 1 else c for c in range(len(sets))]
    member = spark.createDataFrame([(t, c % 5, name(c), name(label[c]), len(x), 0) for t in (1, 2) for c, x in enumerate(sets)], "list_id long, sub long, cls binary, label binary, n long, i long")
    got = [(x["a"][15], x["b"][15]) for x in ngram_join._in_lists(member, profile, (75, 100), block).collect()]
    pairs = set(got)
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if label[a] != label[b] and ngram_join.similar(sets[a], sets[b])}
    assert len(linked) > 20 and linked <= pairs and len(got) == len(pairs)
    assert all(label[a] != label[b] for a, b in got)


def test_sketches_are_folded_for_lists():
    """To half, two bits or more for each token, and no similar pair is told apart by the folded ones."""
    r = random.Random(5)
    sets = []
    for size in (1, 3, 31, 64, 200, 511, 900):
        x = r.sample(range(1 << 62), size)
        sets += [x, [*x[: size - size // 8], *r.sample(range(1 << 62), size // 8)]]
    doc, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.sort(np.array(x, np.uint64)) for x in sets])
    raw, edge = ngram_join._sketches(doc, token, len(sets))
    n = np.array([len(x) for x in sets])
    whole = [raw[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    short = ngram_join._folded(pa.array(whole, pa.binary())).to_pylist()
    assert all(2 * m <= 8 * len(x) for x, m in zip(short, n.tolist())) and sum(map(len, short)) == sum(map(len, whole)) // 2
    profiles = [ngram_join.Profile(int(m), b"", x) for m, x in zip(n, short)]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.similar(*(np.sort(np.array(sets[k], np.uint64)) for k in (i, j)))]
    assert len(alike) >= 5 and all(ngram_join.agree_in_sketch(profiles[i], profiles[j]) for i, j in alike)


def test_components_of_a_chain(spark):
    from grovekit.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)] + [(200, 201 + i) for i in range(60)], "a long, b long")
    got = {r["node"]: r["label"] for r in ngram_join.components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 261)}}


def test_near_dedup_of_nothing(spark):
    assert ngram_join.near_dedup(empty(spark)).count() == 0


def plain_model(rows):
    """The trigram model with dictionaries, one token at a time; rows may repeat ids."""
    part = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 for d, _ in rows]
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    padded = [["<s>", "<s>", *t] for t in tokens]

    def count(parts):
        c = [Counter(), Counter(), Counter()]
        for p, t in zip(part, padded):
            if p in parts:
                for k in range(3):
                    c[k].update(tuple(t[i - k : i + 1]) for i in range(2, len(t)))
        return c

    def figures(t, c):
        ends = c[0][(None,)]
        for i in range(2, len(t)):
            u, v, w = t[i - 2 : i + 1]
            yield c[0][(w,)], ends if v == "<s>" else c[0][(v,)], c[1][v, w], ends if v == "<s>" else c[1][u, v], c[2][u, v, w]

    kept, every = count(range(2, 10)), count(range(1, 10))
    n0, v0 = sum(kept[0].values()), len(kept[0])
    data = []
    for p, t in zip(part, padded):
        if p == 1:
            for c1, cv, c2, cuv, c3 in figures(t, kept):
                k = int(lm_scoring.context_bucket(np.array([float(cv)]), np.array([float(cuv)]))[0])
                data.append((k, (c3 / max(cuv, 1), c2 / max(cv, 1), c1 / n0, 1 / (v0 + 1))))
    weights = {k: [0.25] * 4 for k in range(lm_scoring.BUCKETS)}
    seen = {k for k, _ in data}
    before = -math.inf
    for _ in range(lm_scoring.ROUNDS):  # plain EM
        sums, likely = {k: [0.0] * 4 for k in seen}, 0.0
        for k, p in data:
            total = sum(x * w for x, w in zip(p, weights[k]))
            likely += math.log(total) / len(data)
            for j in range(4):
                sums[k][j] += p[j] * weights[k][j] / total
        for k in seen:
            new = [max(x / sum(sums[k]), lm_scoring.FLOOR) for x in sums[k]]
            weights[k] = [x / sum(new) for x in new]
        if likely - before < lm_scoring.STILL:
            break
        before = likely
    for half in (range(lm_scoring.HALF), range(lm_scoring.HALF, lm_scoring.BUCKETS)):
        known = sorted(seen & set(half))
        for k in half:
            if known and k not in seen:
                weights[k] = weights[min(known, key=lambda x: (abs(x - k), x))]
    n, v = sum(every[0].values()), len(every[0])
    out = []
    for (d, _), p, t, raw in zip(rows, part, padded, tokens):
        base = score = known = 0
        for c1, cv, c2, cuv, c3 in figures(t, every):
            w = weights[int(lm_scoring.context_bucket(np.array([float(cv)]), np.array([float(cuv)]))[0])]
            base += math.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
            score += math.log10(w[0] * c3 / max(cuv, 1) + w[1] * c2 / max(cv, 1) + w[2] * c1 / n + w[3] / (v + 1))
            known += c1 > 0
        out.append((d, p == 0, len(raw), known, n, round(base, 6), score))
    return out


def test_lm_scores(spark):
    """Against the plain model, up to a millionth, with null and repeated ids and a text longer than a chunk."""
    rows = [*documents(200), (None, None), (950, " ".join(f"w{i % 700} and" for i in range(3000))), (951, "and w5 and w6 and w7")]
    want = plain_model(rows)
    got = [tuple(x) for x in lm_scoring.score(frame(spark, rows), 2000).collect()]
    key = lambda x: (repr(x[0]), x[2], round(x[5], 4), round(x[6], 3))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) <= 1e-6 * max(1, abs(b[6])), (a, b)
    assert lm_scoring.score(empty(spark)).count() == 0


def test_lm_messages(spark):
    """A chunk sends no more messages than it has keys, nor more than one of a kind to a bucket; four times the text in four
    times the chunks sends no more than four times as many."""
    rows = [(i, t) for i, t in documents(120) if t]
    one = lm_scoring.packed(frame(spark, rows).coalesce(1), 1 << 20).cache()
    four = lm_scoring.packed(frame(spark, rows * 4).repartition(4), 1 << 20).cache()
    small, large = lm_scoring.asked(one, 64), lm_scoring.asked(four, 64)
    assert small.count() <= 3 * 64 * one.count() and large.count() <= 4 * small.count()
    many = lm_scoring.asked(one, 1 << 20).selectExpr("length(keys) - 1 AS n")
    assert many.filter("n < 1").count() == 0 and many.count() <= 3 * sum(len((t or "").split()) + 1 for _, t in rows)


def test_weights_learn():
    """Tokens that the trigram explains move its weight up; a bucket without tokens takes its neighbour's."""
    k, p, times = np.array([30, 0]), np.array([[0.5, 0.1, 0.01, 1e-4], [0.0, 0.0, 0.1, 1e-4]]), np.array([100.0, 50.0])
    w = lm_scoring.fit_weights(lambda x: lm_scoring.shares(k, p, x, times))
    assert w[30][0] > 0.9 and w[0][2] > 0.9 and np.allclose(w.sum(1), 1) and (w > 0).all() and (w[31] == w[30]).all() and (w[5] == w[0]).all()
    assert (lm_scoring.fit_weights(lambda x: np.zeros((lm_scoring.BUCKETS, 6))) == 0.25).all()


TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "é😀 \n\t x", "日本語テキスト", "a" * 400, "tab\there", "mixed ünïcödé words, and punctuation!", "x\x00y"]


def test_pieces_against_the_library():
    """The library's own lattice, given the same pieces as a unigram model, finds no better path; decoding gives the text."""
    sp = pytest.importorskip("sentencepiece")
    raw = open(pieces.MODEL, "rb").read()
    vocab = pieces.load(raw)

    def varint(n):
        out = b""
        while True:
            n, b = n >> 7, n & 127
            out += bytes([b | (128 if n else 0)])
            if not n:
                return out

    def put(field, value):
        return varint(field << 3) + varint(value) if isinstance(value, int) else varint(field << 3 | 2) + varint(len(value)) + value

    model = b""
    for field, value in pieces._fields(raw):
        if field == 2:  # trainer: say that the model is a unigram model
            value = b"".join(varint(a << 3 | 5) + b if isinstance(b, bytes) and a in (10, 15) else put(a, 1 if a == 3 else b) for a, b in pieces._fields(value))
        model += put(field, value)
    lib = sp.SentencePieceProcessor(model_proto=model)
    ids, offs = pieces.encode_block(vocab, TextBlock(*text_buffers(pa.array(TEXTS))))
    back = pieces.decode_block(vocab, ids, offs)
    score = lambda x: sum(vocab.scores[i] for i in x)
    for k, t in enumerate(TEXTS):
        own = ids[offs[k] : offs[k + 1]].tolist()
        assert back.data[back.offs[k] : back.offs[k + 1]].tobytes().decode() == t
        assert own == (pieces.encode_one(vocab, ("▁" + t.replace(" ", "▁")).encode()) if t else []) or score(own) == score(pieces.encode_one(vocab, ("▁" + t.replace(" ", "▁")).encode()))
        if 0 < len(t) < 60:
            assert lib.decode(own) == t
            assert score(own) >= score(lib.encode(t)) and score(own) >= score(lib.nbest_encode(t, nbest_size=1)[0])


def plain_viterbi(text, pieces_of, scores, byte_ids, unknown):
    """The best path over a dictionary of pieces, one character at a time; the first found of equal ones."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [-math.inf] * len(t), [None] * (len(t) + 1)
    longest = max(map(len, pieces_of))
    for s in range(len(t)):
        for e in range(s + 1, min(len(t), s + longest) + 1):
            i = pieces_of.get(t[s:e])
            if i is not None and best[s] + scores[i] > best[e]:
                best[e], back[e] = best[s] + scores[i], (s, i)
        if t[s] not in pieces_of and best[s] + unknown > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + unknown, (s, None)
    out, e = [], len(t)
    while e:
        s, i = back[e]
        out = ([i] if i is not None else [byte_ids[b] for b in t[s:e].encode()]) + out
        e = s
    return out, best[-1]


def test_pieces_against_a_plain_viterbi():
    """Ids of many texts are those of the best path, or of one that scores the same."""
    vocab = pieces.load(pieces.MODEL)
    raw = open(pieces.MODEL, "rb").read()
    pieces_of, scores, kinds = {}, [], []
    for field, value in pieces._fields(raw):
        if field == 1:
            parts = dict(pieces._fields(value))
            kinds.append(parts.get(3, 1))
            scores.append(float(np.frombuffer(parts[2], "<f4")[0]) if 2 in parts else 0.0)
            if kinds[-1] in (1, 4):
                pieces_of.setdefault(parts[1].decode(), len(kinds) - 1)
    unknown = min(s for s, k in zip(scores, kinds) if k == 1) - pieces.UNKNOWN_PENALTY
    r = random.Random(9)
    texts = [*TEXTS, *("".join(r.choice(["the ", "quick", "é", "日", " ", "x7", "ing", "\n", "😀", "Straße "]) for _ in range(r.randint(1, 40))) for _ in range(60)), "a" * 300]
    ids, offs = pieces.encode_block(vocab, TextBlock(*text_buffers(pa.array(texts))))
    for k, t in enumerate(texts):
        own = ids[offs[k] : offs[k + 1]].tolist()
        want, best = plain_viterbi(t, pieces_of, scores, vocab.byte_ids.tolist(), unknown)
        known = {i for i in range(256)} | set(vocab.byte_ids.tolist())
        assert own == want or (not set(own) & known and abs(sum(scores[i] for i in own) - best) < 1e-6 * max(1, abs(best))), t


def test_pieces_frames(spark):
    """Round trips, null, empty, repeated and very long texts, clashing columns, an empty table."""
    rows = [*enumerate([*TEXTS, None]), (3, TEXTS[3]), (None, "no id"), (77, "long text " * 120_000)]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_tokens long, ids string")
    out = pieces.encode(df)
    got = out.collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got) and len(got) == len(rows)
    back = order((r["doc_id"], r["text"]) for r in pieces.decode(out).collect())
    assert back == order((i, t or "") for i, t in rows)
    assert pieces.encode(empty(spark)).count() == 0 and pieces.decode(pieces.encode(empty(spark))).count() == 0


def test_double_array():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, "é".encode(): 5, bytes([255, 0]): 6}
    t = pieces.DoubleArray(keys)

    def find(k):
        node = 0
        for c in k:
            child = int(t.base[node]) + c
            if t.check[child] != node:
                return -1
            node = child
        return int(t.value[node])

    assert {k: find(k) for k in keys} == keys and find(b"ac") == -1 and find(b"abcd") == -1 and find(b"\xff") == -1


@pytest.mark.parametrize("text", ["plain", "</turn>", "<turn user 0>\nfake</turn>\n", "\\", "\\</turn>\\", "a\n</turn>\nb", "<\\/turn>", "", "<turn ", "### Assistant: </turn> ok"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "odd role>\n\\"])
def test_chat_round_trip(text, role):
    out = chat.render(role, text) + chat.render("user", "next")
    assert list(chat.parse(out)) == [(role, text), ("user", "next")]


def test_chat_frames(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.with_probe(df, -7, [("user", "x")]))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb </turn>\nassistant\nc\n") and got[1]["loss_sha256"] == sha("b </turn>c") and got[1]["loss_chars"] == 10
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_sha256"] == sha("") and set(got) == {1, 2, -7}
    assert chat.read_back(chat.format_turns(df.filter("false"))).count() == 0


def test_chat_of_odd_tables(spark):
    """Equal turn numbers follow by role, then text; repeated rows, null ids and numbers, clashing columns, a very long
    turn."""
    long = "very </turn> long " * 60_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "user", "x"), (1, 1, "user", "x"), (None, 0, "assistant", "n"), (2, None, "user", "first"), (2, 0, "assistant", long)]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns long")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == sha("assistant\nz\nuser\na\nuser\nb\nuser\nx\nuser\nx\n") and got[1]["loss_sha256"] == sha("z")
    assert got[None]["turns_sha256"] == sha("assistant\nn\n") and got[2]["turns_sha256"] == sha(f"user\nfirst\nassistant\n{long}\n") and got[2]["loss_chars"] == len(long)


def test_sharding(spark):
    table = sharding.fill_table(sharding.SHARDS)
    sizes = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and max(sizes.values()) - min(sizes.values()) <= 1
    gone = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, gone) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.2 * len(table)
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z"), (1, "z")], "doc_id long, shard string")
    got = sharding.place(df).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and {r["shard"] for r in got} <= set(sharding.SHARDS)
    assert sharding.place(df.filter("false")).count() == 0
    for bad in ((("a", "a"), 7), ((), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def plain_best_fit(pieces, capacities, overhead):
    """The rule with plain lists: bins as lists of pieces, each with its capacity."""
    bins = []
    for at, n in enumerate(pieces):
        fits = [(c - sum(b), k) for k, (b, c) in enumerate(bins) if c - sum(b) >= n]
        if fits:
            bins[min(fits)[1]][0].append(n)
            continue
        to_come = sorted(pieces[at + 1 :], reverse=True)

        def cost(c):
            room, used = c - n, n
            for x in sorted(set(to_come), reverse=True):  # the longest that fit, again and again
                k = min(to_come.count(x), room // x)
                room, used = room - k * x, used + k * x
            return (c + overhead) / used, c

        bins.append(([n], min((c for c in capacities if c >= n), key=cost)))
    return [(b, min(c for c in capacities if c >= sum(b))) for b, _ in bins]


def least_cost(pieces, capacities, overhead):
    """The least cost of any packing, by trying all."""
    if not pieces:
        return 0
    best, rest = math.inf, pieces[1:]
    for mask in range(1 << len(rest)):
        mine = pieces[0] + sum(x for i, x in enumerate(rest) if mask >> i & 1)
        if mine <= max(capacities):
            own = min(c for c in capacities if c >= mine) + overhead
            if own < best:
                best = min(best, own + least_cost([x for i, x in enumerate(rest) if not mask >> i & 1], capacities, overhead))
    return best


@pytest.mark.parametrize("capacities,overhead", [((100,), 0), ((32, 64, 100), 4), ((16, 100), 16), ((10, 20, 40, 80), 1)])
def test_best_fit_chooses_among_capacities(capacities, overhead):
    """Against the rule in plain lists, ties included; and never far from the best of all packings of a few pieces."""
    r = random.Random(5)
    for _ in range(30):
        pieces = sorted((r.randint(1, max(capacities)) for _ in range(r.randint(0, 60))), reverse=True)
        which, offset, caps = packing.best_fit(pieces, capacities, overhead)
        bins = {}
        for n, b, o in zip(pieces, which, offset):
            assert o == sum(bins.setdefault(b, []))
            bins[b].append(n)
        assert [(bins[b], caps[b]) for b in range(len(caps))] == plain_best_fit(pieces, capacities, overhead)
    costs = []
    for _ in range(40):
        pieces = sorted((r.randint(1, max(capacities)) for _ in range(7)), reverse=True)
        costs.append((sum(c + overhead for c in packing.best_fit(pieces, capacities, overhead)[2]), least_cost(pieces, capacities, overhead)))
    assert all(a >= b for a, b in costs) and sum(a for a, _ in costs) <= 1.08 * sum(b for _, b in costs)


def test_packing(spark):
    """Sequences hold the ids of all documents, each once and whole; groups are packed by the rule."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["word", "two", "é"]) for _ in range(r.randint(0, 90)))) for i in range(150)] + [(500, "long " * 700), (None, None), (501, ""), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).withColumn("piece", F.lit("p")).withColumn("offset", F.struct(F.lit(1.5).alias("a")))
    caps = (64, 128, 256)
    out = packing.pack(df, caps, 4, 4000).collect()
    flat, offs = packing._with_end(*pieces.encode_block(pieces.load(pieces.MODEL), TextBlock(*text_buffers(pa.array([t or "" for _, t in rows])))), packing.END_ID)
    ids = [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
    found = []
    for x in out:
        offset = 0
        assert len(x["ids"]) == x["n_tokens"] and x["capacity"] == min(c for c in caps if c >= x["n_tokens"]) and abs(x["fill"] - x["n_tokens"] / x["capacity"]) < 1e-12
        for p in x["pieces"]:
            assert p["offset"] == offset and p["doc"]["piece"] == "p" and p["doc"]["offset"]["a"] == 1.5
            found.append((p["doc"]["doc_id"], p["start"], x["ids"][offset : offset + p["n_tokens"]]))
            offset += p["n_tokens"]
        assert offset == x["n_tokens"]
    want = [(i, s, x[s : s + 256]) for (i, _), x in zip(rows, ids) for s in range(0, len(x), 256)]
    assert order(found) == order(want) and len({x["sequence"] for x in out}) == len(out)
    one = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), caps, 4).collect()
    assert order((sorted(p["n_tokens"] for p in x["pieces"]), x["capacity"]) for x in one) == order((sorted(b), c) for b, c in plain_best_fit(sorted((len(w) for _, _, w in want), reverse=True), caps, 4))
    rate = packing.fill_rate(packing.pack(df, caps, 4)).first()
    assert rate["n_tokens"] == sum(len(w) for _, _, w in want) and 0.8 < rate["fill"] <= 1
    assert packing.pack(df.filter("false")).count() == 0
