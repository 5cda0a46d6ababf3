"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: ``(offset + j * skip) mod size``, a
permutation as the size is prime. Shards take turns; at its turn a shard claims its next preferred slot that is
free. The full table, of a size fixed by a parameter, is broadcast; a document finds its shard by one hash and one
probe. When a shard leaves, few slots beside its own change hands. Nothing is shuffled, and no Python runs on executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Slots of the table (a prime, over a hundred for each shard) and the shards of the query.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. ``size`` is a prime and at least the number of shards."""
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("at least one shard, each once, and no more shards than slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    offset = [_number(f"offset|{s}") % size for s in shards]
    skip = [_number(f"skip|{s}") % (size - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            slot = (offset[i] + tried[i] * skip[i]) % size
            while table[slot] >= 0:
                tried[i] += 1
                slot = (offset[i] + tried[i] * skip[i]) % size
            table[slot] = i
            tried[i] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table size. A null key counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(df: DataFrame, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The table as a DataFrame (slot, shard), made of one literal: its rows are the slots, whatever the data."""
    names = ",".join(shards[i] for i in fill_table(shards, size))
    return df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("slot", "shard"))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot and shard to every row; equal keys get equal shards, and a null key that of the empty text.

    Columns of the input that are called slot or shard are replaced; all others come back as they are, whatever their
    names. Repeated rows come back repeated, and an empty table empty.
    """
    rest = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    at, name = fresh(rest, "_slot"), fresh(rest, "_shard")
    table = lookup_table(df, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(name))
    rows = df.withColumn(at, slot_of(F.col(f"`{key}`"), size)).select(*[f"`{c}`" for c in rest], at)
    return rows.join(F.broadcast(table), at).select(*[f"`{c}`" for c in rest], F.col(at).alias("slot"), F.col(name).alias("shard"))
