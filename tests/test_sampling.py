import random

import pytest
from conftest import facts, tiny_star
from pyspark.sql import functions as F

from budgetstar.functions.keys import shuffled_order
from budgetstar.model import ENTITY_KEYS, FACT_COLUMNS
from budgetstar.operators.quality import (
    execution_rates,
    gate_failures,
    region_pim_share,
    sample_gates,
)
from budgetstar.operators import sampling
from budgetstar.operators.sampling import (
    entity_sizes,
    require_intact,
    sample_facts,
    sample_integrity,
    select_entities,
)


def plain_loop(sizes, target):
    taken, total = [], 0
    for name, n in sizes:
        if total == target:
            break
        if total + n <= target:
            taken.append(name)
            total += n
    return taken


def ordered(spark, sizes):
    """Entities in the given order: the order key counts up, spread over the prefix buckets."""
    step = 16**6 // (len(sizes) + 1)
    rows = [(*[i + 1] * len(ENTITY_KEYS), n, f"{(i + 1) * step:06x}" + "0" * 26) for i, n in enumerate(sizes)]
    columns = ", ".join(f"{k} bigint" for k in ENTITY_KEYS)
    return spark.createDataFrame(rows, f"{columns}, n_facts bigint, order_key string")


def chosen(spark, sizes, target):
    table = select_entities(ordered(spark, sizes), target)
    return sorted((r[ENTITY_KEYS[0]] for r in table.collect()))


@pytest.mark.parametrize(
    "sizes, target, kept",
    [
        ([4, 3, 2, 1], 6, [4, 2]),
        ([5, 5, 1, 1], 12, [5, 5, 1, 1]),
        ([7, 7, 7], 10, [7]),
        ([3, 1, 4, 1, 5], 9, [3, 1, 4, 1]),
        ([9, 9], 5, []),
        ([2, 2], 0, []),
    ],
)
def test_greedy_cases(spark, sizes, target, kept):
    picked = chosen(spark, sizes, target)
    assert [sizes[i - 1] for i in picked] == kept


@pytest.mark.parametrize("seed", range(8))
def test_greedy_equals_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40, 1000]) for _ in range(rng.randint(5, 300))]
    target = rng.randint(0, sum(sizes) + 3)
    assert chosen(spark, sizes, target) == plain_loop(list(enumerate(sizes, 1)), target)


def test_all_entities_in_one_bucket(spark):
    sizes = [random.Random(3).randint(1, 9) for _ in range(200)]
    table = ordered(spark, sizes).withColumn("order_key", F.concat(F.lit("abc"), "order_key"))
    picked = sorted(r[ENTITY_KEYS[0]] for r in select_entities(table, 333).collect())
    assert picked == plain_loop(list(enumerate(sizes, 1)), 333)


@pytest.mark.parametrize("most", [1, 7, 50])
def test_ranges_are_narrowed_until_few_entities_are_left(spark, monkeypatch, most):
    monkeypatch.setattr(sampling, "ORDERED_ROWS", most)
    sizes = [random.Random(5).randint(1, 9) for _ in range(150)]
    assert chosen(spark, sizes, 333) == plain_loop(list(enumerate(sizes, 1)), 333)


def test_steps_on_skewed_sizes(spark, monkeypatch):
    steps = []
    step = sampling._first_crossing
    monkeypatch.setattr(sampling, "_first_crossing", lambda *a: steps.append(a) or step(*a))
    rng = random.Random(11)
    sizes = [int(rng.paretovariate(0.8)) for _ in range(400)]
    target = sum(sizes) // 2
    assert chosen(spark, sizes, target) == plain_loop(list(enumerate(sizes, 1)), target)
    assert len(steps) <= len(set(sizes)) + 1


def test_one_giant_entity_among_small_ones(spark):
    sizes = [1] * 50 + [1_000_000] + [2] * 50
    assert chosen(spark, sizes, 121) == plain_loop(list(enumerate(sizes, 1)), 121)


def test_sample_of_the_star_keeps_whole_entities(spark, layers):
    fact, years = layers.star.fact, [1998, 1999]
    sizes = entity_sizes(fact, years)
    loop = plain_loop(
        [(tuple(r[k] for k in ENTITY_KEYS), r.n_facts) for r in sizes.orderBy("order_key").collect()], 777
    )
    entities = select_entities(sizes, 777)
    assert sorted(loop) == sorted(tuple(r[k] for k in ENTITY_KEYS) for r in entities.collect())
    sample = sample_facts(fact, entities, years)
    row = sample_integrity(sample, entities).first()
    assert row.broken_entities == 0 and row.observed_facts == sample.count() <= 777
    require_intact(sample, entities)
    with pytest.raises(RuntimeError, match="lost facts"):
        require_intact(sample.where(F.col("fase") != "pim"), entities)


def test_a_target_beyond_the_fact_keeps_all_of_it(spark, layers):
    fact = layers.star.fact
    entities = select_entities(entity_sizes(fact), 10_000_000)
    assert sample_facts(fact, entities).count() == fact.count()


def test_order_is_md5_of_the_joined_keys(spark):
    row = spark.createDataFrame([(1, 2, 3, 4, 5)], list(ENTITY_KEYS)).select(shuffled_order(ENTITY_KEYS)).first()
    import hashlib

    assert row[0] == hashlib.md5(b"1|2|3|4|5").hexdigest()


GOOD = [(1, 2024, "pim", 100), (1, 2024, "devengado", 80)]


def failures(spark, rows, target=None, places=((1, "LIMA"),), threshold=100.0):
    star = tiny_star(spark, rows, places)
    target = len(rows) if target is None else target
    gates = sample_gates(star, target, region_threshold=threshold)
    return gate_failures(gates, target), gates


def test_rates_overall_and_per_year(spark):
    rows = {r.scope: r for r in execution_rates(facts(spark, GOOD)).collect()}
    assert rows["global"].execution_rate_pct == rows["2024"].execution_rate_pct == 80.0
    assert (rows["2024"].pim, rows["2024"].devengado) == (100.0, 80.0)


def test_consistent_sample_passes(spark):
    assert failures(spark, GOOD)[0] == []


def test_rate_above_hundred_fails(spark):
    messages, _ = failures(spark, [(1, 2024, "pim", 50), (1, 2024, "devengado", 120)])
    assert any("outside [0, 100]" in m for m in messages)


def test_undefined_rate_fails(spark):
    messages, _ = failures(spark, [(1, 2024, "devengado", 1)])
    assert any("undefined" in m for m in messages)


@pytest.mark.parametrize("executed", [0, 100])
def test_rate_bounds_are_inclusive(spark, executed):
    assert failures(spark, [(1, 2024, "pim", 100), (1, 2024, "devengado", executed)])[0] == []


def test_null_amount_fails(spark):
    messages, _ = failures(spark, [(1, 2024, "pim", None), (1, 2024, "pim", 9), (1, 2024, "devengado", 8)])
    assert messages == ["Column 'monto' has 1 null values."]


def test_row_target_fails(spark):
    messages, _ = failures(spark, GOOD, target=1000)
    assert any("against a target of 1,000" in m for m in messages)
    assert failures(spark, GOOD, target=3)[0] == []


def test_concentration_is_reported_not_enforced(spark):
    rows = [(1, 2024, "pim", 100), (2, 2024, "devengado", 80)]
    messages, gates = failures(spark, rows, places=[(1, "LIMA"), (2, "CUSCO")], threshold=50.0)
    note = [r for r in gates.collect() if r.gate == "concentration_note"]
    assert messages == [] and [(n.scope, n.value) for n in note] == [("LIMA", 100.0)]
    assert not [r for r in failures(spark, GOOD)[1].collect() if r.gate == "concentration_note"]


def test_shares_leave_out_unmatched_geography(spark):
    assert region_pim_share(tiny_star(spark, [(99, 2024, "pim", 100)], [(1, "LIMA")])).collect() == []
    assert set(FACT_COLUMNS) >= set(ENTITY_KEYS)
