"""The Merkle manifest, URL filters and periodic runs against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovekit.llm import merkle, periodic, queries, url_filter
from grovekit.llm.common import TextBlock, text_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------------------------------------- Merkle manifest


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 :][:3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def plain_leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    held = {k: sorted(groups[k], key=lambda x: x[:3]) for k in names}
    trees = {k: plain_tree([x[2] for x in held[k]]) for k in names}
    top = plain_tree([trees[k][-1][0] for k in names])
    out = []
    for g, k in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(held[k]):
            proof = plain_proof(trees[k], i) + plain_proof(top, g)
            tampered = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                tampered = (*r[:4], r[4].replace("\n", ""))
            folded = plain_leaf(tampered)
            for a, b in proof:
                folded = sha(a + folded + b)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), folded, folded == top[-1][0]))
    return out


def merkle_rows(n=150, seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot"] * 6 + ["é", "zz", "a", None, ""]), r.choice(["en", None]), r.choice([None, i]), r.choice(["one\ntwo", "x" * i, "é\n", ""])) for i in range(n)]
    rows += [(900, "alone", "en", 1, "one leaf"), (901, "hot", None, None, None), (None, None, None, None, None), (None, "hot", "en", 2, "no id\n"), (None, "hot", "en", 2, "no id\n"), (902, "hot", "en", 3, "twice"), (902, "hot", "en", 3, "twice"), (902, "hot", "de", 3, "same id"), (-5, "hot", "en", 0, "y\n" * 60_000)]
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 150])
def test_manifest_query(spark, tmp_path, n):
    rows = merkle_rows() if n == 150 else merkle_rows()[:n]
    spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", root string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_nothing(spark):
    out = merkle.manifest(empty(spark), merkle.document_leaf(empty(spark)), carry={"tampered": F.col("text")})
    assert out.count() == 0 and out.columns == ["doc_id", "source", "leaf", "place", "subroot", "root", "proof", "tampered"]


@pytest.mark.parametrize("total", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100])
def test_spans(total):
    """Whatever two places a tree is cut at: the ragged nodes and what is lacking make all proofs."""
    leaves = [sha(str(i)) for i in range(total)]
    tree = plain_tree(leaves)
    r = random.Random(total)
    for _ in range(20):
        a, b = sorted((r.randrange(total + 1), r.randrange(total + 1)))
        spans = [merkle.Span("".join(leaves[x:y]).encode(), x, total) for x, y in ((0, a), (a, b), (b, total)) if x < y]
        nodes = {(level, i): d for s in spans for level, i, d in s.ragged()}
        for s in spans:
            for level, (x, y, digests, count) in enumerate(s.levels):
                assert count == len(tree[level]) and digests.decode() == "".join(tree[level][x:y])
        if len(spans) > 1:
            rows = [(1, 0, total, level, i, None, d.decode()) for (level, i), d in nodes.items()]
            above = merkle._finish(pa.Table.from_batches([merkle._batch(rows)]), 99).to_pylist()
            assert [x["digest"] for x in above if x["kind"] == 2] == tree[-1]
            nodes |= {(x["level"], x["place"]): x["digest"].encode() for x in above}
        for s in spans:
            left, right, at = s.siblings({k: nodes[k] for k in s.lacking()})
            for i in range(s.first, s.first + s.n):
                where = [begin + i // 3**level - low for level, (begin, low) in enumerate(at)]
                assert [(left[x].decode(), right[x].decode()) for x in where] == plain_proof(tree, i)


@pytest.mark.parametrize("top", [2, 3])
def test_chunks_and_blocks_in_rounds(spark, monkeypatch, top):
    """Low chunks and small blocks, so that several rounds are needed, for many groups and one large one."""
    monkeypatch.setattr(merkle, "WIDER", -3)
    monkeypatch.setattr(merkle, "STEP", top)
    rows = [(i, "hot" if i % 2 else f"s{i}", "en", i, f"text {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = merkle.manifest(docs, merkle.document_leaf(docs))
        got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof")).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(r.f == r.root for r in got)
    assert sorted(tuple(r)[:5] for r in got) == sorted(r[:5] for r in plain_manifest(rows))


# ---------------------------------------------------------------------------------------------- URL filters

RULES = [("com/", "allow", "com", "/"), ("example.com/en/", "block", "example.com", "/en/"), ("www.example.com/en/", "allow", "www.example.com", "/en/"), ("net/es/", "block", "net", "/es/"), ("net/fr/", "block", "net", "/fr/")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[2] or host.endswith("." + r[2])) and path.startswith(r[3])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))[:2]


def plain_features(host, path):
    out = set()
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", path)):
        for n in url_filter.GRAMS:
            out |= {zlib.crc32((mark + text[i : i + n]).encode()) % url_filter.BUCKETS for i in range(len(text) - n + 1)}
    return sorted(out)


URLS = ["https://Example.COM/en/1", "http://www.example.com/en/", "https://a.b.example.com/en/x?y#z", "https://notexample.com/en/1", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/", "https://net/es/", "ftp://h", "http://h?q=/en/", "http://h#f", "no scheme", "", None, "://", "https://ÄÖ.example.com/en/ü", "http://casino.example.org/en/1", "http://a://b.com/c", "http://com", "http://com/", "https://h/" + "a/" * 40_000, "http://😀😀.com/😀é/😀😀😀😀", "http://x.net/es/1", "http://a\nb.com/en/\nx"]


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_rules_and_scores(spark, weights):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, Host string, score string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, weights).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        x = plain_features(host, path)
        score = sum(weights[b] for b in x) / math.sqrt(max(1, len(x))) + weights[-1]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert abs(got[i].score - score) < 1e-6 and got[i].verdict == (verdict or ("block" if score >= math.log(7 / 3) else "allow")), u
    assert url_filter.filter_urls(df.filter("false"), weights).count() == 0


def test_weights_are_the_best(spark, weights):
    """The gradient of the loss of the labelled table vanishes, computed anew by numpy."""
    rows = url_filter.labelled_urls(spark).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        f = plain_features(*plain_parts(r.url))
        x[i, f] = 1 / math.sqrt(len(f))
    y = np.array([float(r.blocked) for r in rows])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, c = np.array(weights[:-1]), weights[-1]
    error = (1 / (1 + np.exp(-(x @ w + c))) - y) * share
    assert np.abs(x.T @ error + url_filter.DECAY * w).max() < 2e-5 and abs(error.sum()) < 2e-5
    assert ((x @ w + c > 0) == (y == 1)).mean() > 0.99


def test_held_out_urls(spark):
    """Trained on four names of five, tried on the fifth: names that share no word with those learnt from cannot be known, but
    few URLs that are fine are blocked, and most of those to block that hold a known word are."""
    rows = url_filter.labelled_urls(spark).collect()
    name = lambda u: u.split("//")[1].split(".example")[0].rpartition(".")[2]
    held = lambda u: zlib.crc32(name(u).encode()) % 5 == 0
    train = spark.createDataFrame([r for r in rows if not held(r.url)], "url string, blocked boolean")
    w = url_filter.fit(train)
    words = "casino bets poker ads spam pills adult".split()
    known = [f"https://m.{a}-{b}.example.org/de/77" for a, b in (("casino", "club"), ("best", "bets"), ("poker", "den"), ("adult", "zone"), ("spam", "hub"), ("pills", "now"))]
    fine = [r.url for r in rows if held(r.url) and not r.blocked]
    df = spark.createDataFrame([(u,) for u in known + fine], "url string")
    got = {r.url: r.score for r in url_filter.filter_urls(df, w, rules=()).collect()}
    assert words and sum(got[u] > 0 for u in known) >= 5 and sum(got[u] < math.log(7 / 3) for u in fine) >= 0.9 * len(fine)


def test_odd_labels(spark):
    one = spark.createDataFrame([("https://a.com/", True), (None, None)], "url string, blocked boolean")
    assert not any(url_filter.fit(one)) and not any(url_filter.fit(one.filter("false")))
    both = spark.createDataFrame([(None, True), ("", False), ("https://a.com/", True), ("https://a.com/", True)], "url string, blocked boolean")
    assert len(url_filter.fit(both, most=3)) == url_filter.BUCKETS + 1


# ---------------------------------------------------------------------------------------------- periodic runs


def plain_runs(w, least, times):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if w[k] != w[k + q]:
                k += 1
                continue
            j = k
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - k
            if size >= least and size >= times * q and not any((k, size, x) in out for x in range(1, q) if q % x == 0):
                out.add((k, size, q))
            k = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_numbers():
    r = random.Random(1)
    for _ in range(400):
        n, k = r.randint(0, 70), r.choice([1, 2, 2, 3, 4])
        s = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            p, a = r.randint(1, 9), r.randrange(n)
            b = r.randint(a, n)
            s = [s[i] if not a <= i < b else s[a + (i - a) % p] if a + (i - a) % p < b else 0 for i in range(n)]
        text = " ".join("abcdefgh"[x] for x in s).encode()
        block = TextBlock(*text_buffers(pa.array([text.decode(), None, "", text.decode()])))
        for least, times in ((2, 2), (24, 3), (6, 3), (5, 2)):
            want = plain_runs(s, least, times)
            assert periodic.runs_of(np.array(s, np.int64), least, times).tolist() == [list(x) for x in want]
            doc, found = periodic.block_runs(block, least, times)
            for d, first in ((0, 0), (3, n)):
                assert [(a - first, b, c) for a, b, c in found[doc == d].tolist()] == want


def test_hashes_that_lie():
    """Powers of one base modulo 2**64 cannot tell some words apart; a hash that knows nothing at all changes no run either."""
    thue = [bin(i).count("1") & 1 for i in range(4096)]
    assert periodic.runs_of(np.array(thue * 3)).tolist() == [[0, 12288, 4096]]
    r = random.Random(2)
    whole = periodic.Extensions.__init__

    def blind(self, seq):
        whole(self, seq)
        self.sums[:] = 0
        self.sum = [0] * (self.n + 1)

    periodic.Extensions.__init__ = blind
    try:
        for _ in range(150):
            s = [r.randrange(2) for _ in range(r.randint(0, 60))]
            assert periodic.runs_of(np.array(s, np.int64), 4, 2).tolist() == [list(x) for x in plain_runs(s, 4, 2)]
    finally:
        periodic.Extensions.__init__ = whole


def test_many_equal_words_take_no_quadratic_time():
    assert periodic.runs_of(np.zeros(30_000, np.int64)).tolist() == [[0, 30_000, 1]]


def run_rows():
    r = random.Random(5)
    words = ["w%d" % i for i in range(40)] + ["é", "\u00a0", "\x85"]
    text = lambda k: r.choice([" ", "\n", " \t\v"]).join(r.choice(words) for _ in range(k))
    rows = [(i, text(r.randint(0, 140))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t\r"), (503, "ha " * 50), (504, "\n".join(["la la la di"] * 12) + "\nla la"), (505, ("a b c " * 8 + "x ") * 5), (506, text(30) * 4), (507, " ".join("abcd" for _ in range(24))), (508, " ".join("abcd" for _ in range(23))), (510, text(20_000)), (None, "no id " * 20), (503, "ha " * 50)]
    return rows


def test_runs_query(spark, tmp_path):
    rows = run_rows()
    spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, runs long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w, 24, 3) if n < 5000 else []
        gone = {k for a, size, q in runs for k in range(a + q, a + size)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *best, sha("".join(f"{a},{s},{q}\n" for a, s, q in runs)), sha(" ".join(w[k] for k in range(n) if k not in gone))))
    assert any(x[1] > 1 for x in want)
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_the_longest_word(spark):
    """A word of a megabyte, many times over."""
    text = " ".join(["z" * 1_000_000] * 30)
    r = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 30, 1)] and len(r.collapsed) == 1_000_000
