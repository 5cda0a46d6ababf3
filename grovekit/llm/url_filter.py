"""Filters on URLs: rules on hosts and paths first, a logistic regression for the rest.

A rule names a host and the beginning of a path; it fits that host and all hosts below it, and the longest that fits
decides. URLs that no rule fits are judged by a logistic regression on hashed character n-grams of host and path, trained
on a small labelled table. Judging takes SQL functions on rows alone: nothing is shuffled, and what each task gets is the
model, an array of a fixed number of weights.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Buckets of the hash, lengths of n-grams, and the rows of the labelled table that are used, at most.
BUCKETS, GRAMS, MOST_LABELLED = 1 << 16, (3, 4, 5), 2000
#: Weight of the squared norm, and steps of the search for the best weights, at most.
DECAY, STEPS = 1e-4, 200
#: Probability from which the model blocks: most URLs are fine, and to block one of them costs more than to let one pass.
BLOCK_FROM = 0.7


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: The labelled table of the query: names of hosts that advertise, gamble, sell pills, spam or show adult content, and of
#: hosts that do not. Each name stands below several suffixes and prefixes and before several paths, the same for both
#: kinds, so that only names tell them apart.
BLOCKED = "casino casino-royal big-win bets free-bet poker slots jackpot lottery adult adult-video xxx sexy-cams hot-dating ads ad-server tracker track-clicks popup banner-ads spam spam-mail link-farm content-farm cheap-meds pills pharmacy-online viagra replica-watches payday-loans free-money miracle-diet malware warez crack-keys phishing"
ALLOWED = "news daily-times library university science history weather recipes garden travel-notes museum school city-council health-info sports chess music books poetry cinema photo nature birds rivers mountains railway software linux database kernel python compiler maths physics chemistry biology medicine language words dictionary letters theory thing thinker other mother weather-station nation station action motion tradition reading writing opening morning winter summer market-hall farmers fishing windows winding tracks addresses adverbs better betony atlas stone patents print student parents street state theatre plants internet country what that rates"
_PREFIXES, _SUFFIXES, _PATHS = ("", "www.", "m.", "blog."), (".example.com", ".example.net", ".example.org"), ("/en/", "/de/", "/fr/", "/es/")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what follows it up to
    ``?``, ``#`` or the end. Both are empty without ``://``, and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: Iterable[Rule] = RULES) -> tuple[Column, Column]:
    """The rule (host and path end to end) that fits and is the longest, and its verdict; null if none fits. Rules come as a
    list that is part of the query: some hundreds at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host)):  # the last one asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _grams(mark: str, text: Column, n: int) -> Column:
    """Buckets of the n-grams of a text, found in one pass over it; the mark tells those of hosts from those of paths."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.transform(grams, lambda g: (F.crc32(F.concat(F.lit(mark), g).cast("binary")) % BUCKETS).cast("int"))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of ``^host$`` and of the path, ascending; none if both are empty."""
    framed = F.when(F.length(host) > 0, F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")
    return F.array_sort(F.array_distinct(F.concat(*[_grams("h", framed, n) for n in GRAMS], *[_grams("p", path, n) for n in GRAMS])))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table of the query: url, blocked."""
    rows = []
    for names, blocked in ((BLOCKED, True), (ALLOWED, False)):
        for i, name in enumerate(names.split()):
            for k in range(4):
                rows.append((f"https://{_PREFIXES[(i + k) % 4]}{name}{_SUFFIXES[(i + k) % 3]}{_PATHS[(i // 3 + k) % 4]}{1000 + 1111 * ((i + 3 * k) % 9)}", blocked))
    return spark.createDataFrame(rows, "url string, blocked boolean")


def fit(labelled: DataFrame, most: int = MOST_LABELLED) -> list[float]:
    """Weights of the buckets, then the constant, from columns url and blocked.

    At most ``most`` rows take part, those of the smallest MD5 of the url. Rows without a label take no part; a null or empty
    url has the constant alone. Both labels weigh the same, however many rows each has. With rows of one label only, or of
    none, all weights are 0.
    """
    host, path = host_and_path(F.col("`url`").cast("string"))
    table = labelled.filter("blocked IS NOT NULL").select(F.col("`url`").cast("string").alias("url"), F.col("`blocked`").cast("double").alias("label"), features(host, path).cast("array<string>").alias("x"))
    table = table.orderBy(F.md5(F.coalesce("url", F.lit("")).cast("binary")), "label").limit(most).cache()
    out = [0.0] * (BUCKETS + 1)
    count = {r.label: r["count"] for r in table.groupBy("label").count().collect()}
    if len(count) == 2:
        table = table.withColumn("weight", F.when(F.col("label") == 1, F.lit(0.5 / count[1.0])).otherwise(0.5 / count[0.0]))
        words = CountVectorizer(inputCol="x", outputCol="found", binary=True, vocabSize=BUCKETS).fit(table)
        rows = Normalizer(inputCol="found", outputCol="features").transform(words.transform(table))
        model = LogisticRegression(regParam=DECAY, standardization=False, maxIter=STEPS, tol=1e-9, weightCol="weight").fit(rows)
        for b, w in zip(words.vocabulary, model.coefficients):
            out[int(b)] = float(w)
        out[BUCKETS] = float(model.intercept)
    table.unpersist()
    return out


def log_odds(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Log odds that a URL is one to block."""
    held = F.split(F.lit(",".join(f"{w!r}" if w else "0" for w in weights)), ",").cast("array<double>")  # folded to one constant
    x = features(host, path)
    total = F.aggregate(x, F.lit(0.0), lambda a, f: a + F.get(held, f))
    return total / F.sqrt(F.greatest(F.size(x), F.lit(1))) + F.get(held, F.lit(BUCKETS))


def filter_urls(df: DataFrame, weights: Sequence[float], rules: Iterable[Rule] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, score (log odds of the model, for every row) and verdict: that of the longest rule that fits,
    else ``block`` from a probability of ``BLOCK_FROM`` on and ``allow`` below.

    A null, empty or odd url (without ``://``) has an empty host and path, which no rule fits, and the model's constant as its
    score. Columns of the input with these names are replaced, all others come back as they are; repeated rows come back
    repeated, an empty table empty. A very long url is judged whole.
    """
    made = ("host", "path", "rule", "score", "verdict")
    rest = [c for c in df.columns if c.lower() not in made]
    value = F.col(f"`{url}`").cast("string")
    at = fresh(rest, "_parts")
    host, path = host_and_path(value)
    rows = df.withColumn(at, F.struct(host.alias("host"), path.alias("path")))
    host, path = F.col(f"{at}.host"), F.col(f"{at}.path")
    rule, verdict = longest_rule(host, path, rules)
    score = log_odds(host, path, weights)
    out = rows.select(*[f"`{c}`" for c in rest], host.alias("host"), path.alias("path"), rule.alias("rule"), score.alias("score"), verdict.alias("verdict"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= math.log(BLOCK_FROM / (1 - BLOCK_FROM)), "block").otherwise("allow")))
