"""Star schema: surrogate keys, five dimensions, one fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.keys import surrogate_key
from budgetstar.model import (
    DIMENSIONS,
    ENTITY_KEYS,
    FACT_COLUMNS,
    YEAR_CUTOFF,
    Dimension,
    Star,
    cell_columns,
)
from budgetstar.operators.clean import has_amount, impute_sector
from budgetstar.operators.reshape import unpivot_phases


def with_keys(table: DataFrame) -> DataFrame:
    """The five surrogate keys next to the codes they are made of; row by row, no shuffle."""
    return table.select(*[surrogate_key(d.codes).alias(d.key) for d in DIMENSIONS], "*")


def keyed_wide(silver: DataFrame) -> DataFrame:
    """Imputed and keyed wide records.

    Keys are hashed once per record here, not once per long row: unpivoting comes afterwards.
    """
    keyed = with_keys(impute_sector(silver))
    return keyed.withColumn("has_amount", has_amount(cell_columns(keyed.columns)))


def build_dimension(members: DataFrame, dimension: Dimension) -> DataFrame:
    """One row per key. Name variants of one code resolve to the smallest row, always the same one.

    The plain distinct runs first: it hashes on every column, so its partial step shrinks the scan
    to the distinct members of each task before anything moves. Only those few rows meet the
    grouped minimum, which has to sort.
    """
    rows = members.where(F.col(dimension.required).isNotNull()).select(dimension.key, *dimension.columns).distinct()
    best = rows.groupBy(dimension.key).agg(F.min(F.struct(*dimension.columns)).alias("member"))
    return best.select(dimension.key, "member.*")


def build_fact(keyed: DataFrame) -> DataFrame:
    """Keys, year, phase, amount. Works on keyed wide records and on keyed long rows alike."""
    if "monto" in keyed.columns:
        return keyed.where(F.col("monto").isNotNull()).select(*FACT_COLUMNS)
    return unpivot_phases(keyed, ids=ENTITY_KEYS)


def build_star(keyed: DataFrame, cutoff: int = YEAR_CUTOFF) -> Star:
    """All gold tables from keyed wide records; records without any amount add no member."""
    members = keyed.where("has_amount") if "has_amount" in keyed.columns else keyed
    dims = {d.name: build_dimension(members, d) for d in DIMENSIONS}
    return Star(fact=build_fact(keyed), dims=dims, cutoff=cutoff)


def fk_orphans(star: Star) -> DataFrame:
    """Per key: distinct keys in the fact, in the dimension, and fact keys without a member.

    One scan of the fact shrinks it to its distinct tuples of keys; only those are stacked as (name,
    key) and meet the stacked keys of the dimensions.
    """
    tuples = star.fact.groupBy(*[d.key for d in DIMENSIONS]).agg(F.count("*").alias("n"))
    cells = [e for d in DIMENSIONS for e in (F.lit(d.key), F.col(d.key))]
    stacked = tuples.select(F.stack(F.lit(len(DIMENSIONS)), *cells).alias("key_name", "key"), "n")
    in_fact = stacked.groupBy("key_name", "key").agg(F.sum("n").alias("n")).withColumn("f", F.lit(1))
    members = [star.dim(d.name).select(F.lit(d.key).alias("key_name"), F.col(d.key).alias("key")) for d in DIMENSIONS]
    in_dim = reduce(DataFrame.unionByName, members).withColumn("d", F.lit(1))
    # A NULL key has no member, so it stays an orphan in the plain comparison.
    both = in_fact.join(in_dim, ["key_name", "key"], "full")
    orphan: Column = F.col("f").isNotNull() & F.col("d").isNull()
    found = both.groupBy("key_name").agg(
        F.count("f").alias("fact_keys"),
        F.count("d").alias("dim_keys"),
        F.count_if(orphan).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
    )
    names = star.fact.sparkSession.createDataFrame([(d.key,) for d in DIMENSIONS], "key_name string")
    counts = ("fact_keys", "dim_keys", "orphan_keys", "orphan_rows")
    return names.join(found, "key_name", "left").select("key_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
