"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own; shards take turns
and claim the first free slot of their order. A row's key hashes to a slot, so placement is one
lookup in a broadcast table. Adding or removing a shard moves little more than that shard's share.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetstar.llm.text import unused

SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
SLOTS = 4099  # prime, over 100 slots a shard: shares differ by about one percent
MOST_SLOTS = 1_000_003  # the broadcast table never has more rows


def number(text: str) -> int:
    """60 bits of md5; the column form is ``number_of``."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def number_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fill(shards: Mapping[str, int] | Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. ``shards`` may map names to weights: claims per turn."""
    turns = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    if not turns or any(w < 0 for w in turns.values()) or not any(turns.values()):
        raise ValueError("At least one shard with a positive weight is needed")
    if not sum(w > 0 for w in turns.values()) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"The number of slots has to be a prime between the number of shards and {MOST_SLOTS}")
    table: list[str | None] = [None] * slots
    starts = {s: number(f"offset:{s}") % slots for s in turns}
    steps = {s: number(f"skip:{s}") % (slots - 1) + 1 for s in turns}
    seen = dict.fromkeys(turns, 0)
    free = slots
    while free:
        for shard, weight in turns.items():
            for _ in range(min(weight, free)):
                while True:
                    slot = (starts[shard] + seen[shard] * steps[shard]) % slots
                    seen[shard] += 1
                    if table[slot] is None:
                        break
                table[slot] = shard
                free -= 1
    return table


def slot_table(spark: SparkSession, table: Sequence[str], slot: str, shard: str) -> DataFrame:
    """The lookup table as rows; made from a literal, so it involves no Python data path."""
    names = list(dict.fromkeys(table))
    cells = F.from_json(F.lit(json.dumps([names.index(s) for s in table])), "array<int>")
    rows = spark.range(1).select(F.posexplode(cells).alias(slot, "cell"))
    listed = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return rows.select(F.col(slot).cast("bigint").alias(slot), F.get(listed, F.col("cell")).alias(shard))


def place(
    rows: DataFrame,
    key: str = "doc_id",
    fallback: str | None = "text",
    shards: Mapping[str, int] | Sequence[str] = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """All columns plus ``slot`` and ``shard``; columns of these names are replaced.

    Equal keys go to one slot. Rows with a null key are dealt by the content of ``fallback`` (null
    counts as empty), so that many null keys do not meet on one shard. One broadcast of ``slots``
    rows, no shuffle; an empty table stays empty.
    """
    keyed = F.concat(F.lit("k"), F.col(f"`{key}`").cast("string"))
    other = F.lit("") if fallback is None else F.coalesce(F.col(f"`{fallback}`"), F.lit(""))
    at, to = unused([*rows.columns, "slot", "shard"], "_slot"), unused([*rows.columns, "slot", "shard"], "_shard")
    spot = F.pmod(number_of(F.coalesce(keyed, F.concat(F.lit("t"), other))), F.lit(slots))
    lookup = slot_table(rows.sparkSession, fill(shards, slots), at, to)
    placed = rows.withColumn(at, spot).join(F.broadcast(lookup), at, "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, F.col(at).alias("slot"), F.col(to).alias("shard"))
