"""Whole-entity sampling: an entity keeps all of its facts or none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetstar.functions.keys import NULL_MARK, shuffled_order
from budgetstar.model import DIMENSIONS, ENTITY_KEYS, FACT_COLUMNS, Star
from budgetstar.operators.quality import _summary_rates, _summary_shares, sample_gates, sample_summary
from budgetstar.sources.shared import cut_lineage


def entity_sizes(fact: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Facts per entity in the given years, with the text that orders entities pseudo-randomly."""
    chosen = fact if years is None else fact.where(F.col("anio").isin(list(years)))
    sizes = chosen.groupBy(*ENTITY_KEYS).agg(F.count("*").alias("n_facts"))
    return sizes.select(*ENTITY_KEYS, "n_facts", shuffled_order(ENTITY_KEYS).alias("order_key"))


ORDERED_ROWS = 100_000  # entities that one task may put in order
PREFIX_STEP = 3  # hexadecimal digits by which the order key is narrowed: 4,096 ranges a step
ORDER_DIGITS = 32  # of the md5 that orders entities


def select_entities(sizes: DataFrame, target_rows: int) -> DataFrame:
    """The greedy choice in order: take an entity when it still fits, stop when the target is met.

    Walking entities one by one is not needed. With ``room`` rows left, consider only entities
    after the last position that are no larger than ``room``: the greedy walk takes all of them up
    to the first whose running total goes over. That one is skipped, the room shrinks below its
    size, and the same step repeats behind it. Every step rules out at least one entity size, so
    there are at most as many steps as distinct sizes (in practice a handful).

    Entities are written once, sorted by position, so a step skips the files before it. Running
    totals come from sums per range of order keys; the range where the total goes over is narrowed
    until at most ORDERED_ROWS of its entities are left, and only those meet in one window. Only a
    prefix and two numbers per narrowing reach the driver.
    """
    tie = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in ENTITY_KEYS])
    placed = sizes.withColumn("_at", F.concat(F.col("order_key"), F.lit("|"), tie))
    placed = cut_lineage(placed.repartitionByRange("_at").sortWithinPartitions("_at"))
    taken: list[Column] = []
    last, room = "", int(target_rows)
    while room > 0:
        fits = (F.col("_at") > last) & (F.col("n_facts") <= room)
        crossing = _first_crossing(placed.where(fits), room)
        if crossing is None:
            taken.append(fits)
            break
        at, before = crossing
        taken.append(fits & (F.col("_at") < at))
        last, room = at, room - before
    chosen = reduce(lambda a, b: a | b, taken, F.lit(False))
    return cut_lineage(placed.where(chosen).drop("_at"))


def _first_crossing(candidates: DataFrame, room: int) -> tuple[str, int] | None:
    """Position of the first candidate whose running total exceeds ``room`` and the total before it."""
    prefix, before, inside = "", 0, None
    while inside is None or inside > ORDERED_ROWS and len(prefix) < ORDER_DIGITS:
        rows = candidates.where(F.col("_at").startswith(prefix))
        width = len(prefix) + PREFIX_STEP
        sums = rows.groupBy(F.substring("order_key", 1, width).alias("range")).agg(
            F.sum("n_facts").alias("s"), F.count("*").alias("n")
        )
        over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # at most 4,096 rows
        running = sums.withColumn("upto", F.sum("s").over(over) + before).where(F.col("upto") > room)
        hit = running.orderBy("range").select("range", F.col("upto") - F.col("s"), "n").first()
        if hit is None:
            return None
        prefix, before, inside = hit[0], int(hit[1]), hit[2]
    rows = candidates.where(F.col("_at").startswith(prefix))
    ordered = Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("n_facts").over(ordered) + before)
    first = upto.where(F.col("upto") > room).orderBy("_at").select("_at", F.col("upto") - F.col("n_facts")).first()
    return first[0], int(first[1])


def sample_facts(fact: DataFrame, entities: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Every fact of the chosen entities; the measured size of the entity table decides the join."""
    chosen = fact if years is None else fact.where(F.col("anio").isin(list(years)))
    keys = entities.select(*ENTITY_KEYS)
    return chosen.join(keys, list(ENTITY_KEYS), "left_semi").select(*FACT_COLUMNS)


def sample_star(star: Star, entities: DataFrame, years: Sequence[int] | None = None) -> Star:
    """Facts of the chosen entities and the dimension members they use.

    The facts, no more than the target of the sample, are kept as a table: gates, counts and manifest
    then read the sample and not the whole fact again.
    """
    dims = {
        d.name: star.dim(d.name).join(entities.select(d.key).distinct(), d.key, "left_semi")
        for d in DIMENSIONS
    }
    facts = cut_lineage(sample_facts(star.fact, entities, years))
    return Star(fact=facts, dims=dims, cutoff=star.cutoff)


def sample_integrity(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose sampled facts are not exactly the facts they own."""
    observed = facts.groupBy(*ENTITY_KEYS).agg(F.count("*").alias("observed"))
    both = entities.select(*ENTITY_KEYS, "n_facts").join(observed, list(ENTITY_KEYS), "full")
    return both.agg(
        F.count("n_facts").alias("entities"),
        F.coalesce(F.sum("n_facts"), F.lit(0)).alias("expected_facts"),
        F.coalesce(F.sum("observed"), F.lit(0)).alias("observed_facts"),
        F.count_if(~F.col("n_facts").eqNullSafe(F.col("observed"))).alias("broken_entities"),
    )


def require_intact(facts: DataFrame, entities: DataFrame) -> None:
    broken = sample_integrity(facts, entities).first().broken_entities
    if broken:
        raise RuntimeError(f"{broken:,} entities lost facts during sampling.")


def flat_sample(star: Star, limit: int = 500) -> DataFrame:
    """A repeatable sample of facts with every descriptive column and no key.

    The fact is read once for the first rows in hashed order. Each dimension is cut to the members
    those rows use; the written rows are of known size, which decides how they meet a dimension.
    """
    rows = star.fact.select(*FACT_COLUMNS).orderBy(shuffled_order(FACT_COLUMNS), *FACT_COLUMNS).limit(limit)
    rows = cut_lineage(rows)
    flat = rows
    for dimension in DIMENSIONS:
        wanted = rows.select(dimension.key).distinct()
        members = star.dim(dimension.name).join(wanted, dimension.key, "left_semi")
        flat = flat.join(members, dimension.key, "left")
    return flat.select("anio", "fase", "monto", *[c for d in DIMENSIONS for c in d.columns])


def export_csv(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").option("header", True).csv(path)


def sample_manifest(star: Star, entities: DataFrame, target_rows: int, years: Sequence[int]) -> DataFrame:
    """One row describing a sample: parameters, counts and gate results, from one pass over its facts."""
    summary = sample_summary(star)
    gates = sample_gates(star, target_rows, summary=summary)
    failed = F.concat_ws(":", "gate", "scope")
    verdict = gates.agg(
        F.every("passed").alias("gates_passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), failed))), ",").alias("failed_gates"),
    )
    overall = _summary_rates(summary).where(F.col("scope") == "global").select("execution_rate_pct")
    first_region = _summary_shares(summary, star).limit(1)
    counts = {
        "entities": entities,
        **{f"{d.table}_rows": star.dim(d.name) for d in DIMENSIONS},
    }
    return verdict.select(
        F.lit(int(target_rows)).cast("bigint").alias("target_rows"),
        F.lit(",".join(str(y) for y in years)).alias("years"),
        F.coalesce(summary.agg(F.sum("rows")).scalar(), F.lit(0)).alias("fact_rows"),
        *[t.agg(F.count("*")).scalar().alias(n) for n, t in counts.items()],
        overall.scalar().alias("execution_rate_pct"),
        first_region.select("department").scalar().alias("top_department"),
        "gates_passed",
        "failed_gates",
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("errorifexists").json(path)
