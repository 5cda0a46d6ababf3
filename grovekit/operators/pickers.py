"""Pickers: what chooses a folder from a shortlist. A model may stand behind one; offline ones need none."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import parse_key


def _shortlists(short: DataFrame, keys: Sequence[str], folder: str, gold: str, score: Column) -> DataFrame:
    return short.withColumn("_s", score).groupBy(*keys).agg(
        F.max_by(folder, F.struct("_s", -F.col("pos"))).alias("pred"), F.bool_or(F.col(folder) == F.col(gold)).alias("gold_in_shortlist"), F.count(F.lit(1)).alias("n_candidates"), F.first(gold).alias("gold")
    )


def first_pick(short: DataFrame, keys: Sequence[str], folder: str, gold: str) -> DataFrame:
    """The first candidate."""
    return _shortlists(short, keys, folder, gold, F.lit(0))


def overlap_pick(short: DataFrame, keys: Sequence[str], folder: str, words: str, gold: str) -> DataFrame:
    """The candidate with most names among the words of the note; of equal ones the earlier."""
    names = F.transform(parse_key(F.col(folder)), F.lower)
    return _shortlists(short, keys, folder, gold, F.size(F.array_intersect(F.col(words), names)))


#: What a message says of a failure that may pass.
TRANSIENT = ("429", "rate_limit", "500", "502", "503", "504", "overloaded", "timeout", "Timeout", "Connection")


def back_off(attempt: int) -> float:
    """Seconds to wait after a failure that may pass: doubled each time up to thirty, and a draw of up to two."""
    return min(2.0**attempt, 30.0) + random.random() * 2


#: Prompts that a Python worker holds at a time: each has whole texts of notes.
PROMPTS = 256


@contextmanager
def few_prompts(spark: SparkSession, rows: int = PROMPTS) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of at most so many rows (of 10,000, by Spark's default)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_picker(prompts: DataFrame, pick: Callable[[list[str]], list[str]], batch: int = 16, attempts: int = 6, wait: Callable[[int], float] = back_off) -> DataFrame:
    """Adds raw, the replies of ``pick`` to the column prompt, asked in batches, and picker_error.

    A batch that fails in a way that may pass is asked again, up to ``attempts`` times in all, after ``wait`` (attempt)
    seconds. One that fails for good gives null replies and says in picker_error what happened.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw", T.StringType()), T.StructField("picker_error", T.StringType())])

    def ask(part: list[str]) -> tuple[list[str | None], str | None]:
        for attempt in range(attempts):
            try:
                out = list(pick(part))
            except Exception as e:
                said = f"{type(e).__name__}: {e}"
                if attempt + 1 == attempts or not any(x in said for x in TRANSIENT):
                    return [None] * len(part), said
                time.sleep(wait(attempt))
            else:
                if len(out) != len(part):
                    return [None] * len(part), f"{len(out)} replies to {len(part)} prompts"
                return out, None
        raise AssertionError("the last attempt returns")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str | None] = []
            errors: list[str | None] = []
            for a in range(0, len(f), batch):
                got, error = ask(f["prompt"].iloc[a : a + batch].tolist())
                out += got
                errors += [error] * len(got)
            yield f.assign(raw=pd.Series(out, index=f.index, dtype=object), picker_error=pd.Series(errors, index=f.index, dtype=object))

    return prompts.mapInPandas(run, schema)
