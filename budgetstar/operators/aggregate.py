"""The one query builder: measures over the star, grouped and filtered by any dimension column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.money import as_double
from budgetstar.model import BY_NAME, FACT_COLUMNS, OWNER, Dimension, Star

ALL = "ALL"
# Columns of the fact with few values by the model: phases and fiscal years.
LISTED_COLUMNS = ("fase", "anio")


@dataclass(frozen=True)
class Filters:
    """Optional dashboard filters; None or ``ALL`` (any case) means no filter."""

    year: int | str | None = None
    government_level: str | None = None
    sector: str | None = None
    department: str | None = None

    def labels(self) -> dict[str, str]:
        """Label column to wanted value in upper case; labels are compared in upper case too."""
        wanted = {
            "nivel_gobierno_nombre": self.government_level,
            "sector_nombre": self.sector,
            "departamento_ejecutora_nombre": self.department,
        }
        return {c: str(v).strip().upper() for c, v in wanted.items() if _active(v)}

    def year_condition(self) -> Column | None:
        if not _active(self.year):
            return None
        text = str(self.year).strip()
        if text.isdigit() and str(int(text)) == text:
            return F.col("anio") == int(text)
        return F.lit(False)


def _active(value: object) -> bool:
    return value is not None and str(value).strip().upper() != ALL


def guard_year(table: DataFrame, cutoff: int) -> DataFrame:
    """Rows of reportable years; on the stored fact this prunes partitions."""
    return table.where(F.col("anio") <= cutoff)


@dataclass(frozen=True)
class Measure:
    """An aggregate split into a part per key tuple and a merge of those parts.

    All parts are exact (decimal sums, counts, extremes), so the result does not depend on how
    rows are spread over tasks. Squares of amounts in cents do not fit a number; they are summed in
    two limbs of nine digits, high and low, which merge by plain addition.
    """

    function: str = "sum"
    phase: str | None = None
    column: str = "monto"

    def _value(self) -> Column:
        value = F.col(self.column)
        if self.phase is None:
            return value
        matched = F.when(F.col("fase") == self.phase, value)
        return matched.otherwise(F.lit(0)) if self.function == "sum" else matched

    def parts(self) -> dict[str, Column]:
        value = self._value()
        total, rows = F.sum(value), F.count(value)
        choices = {
            "sum": {"s": total},
            "count": {"n": rows},
            "min": {"lo": F.min(value)},
            "max": {"hi": F.max(value)},
            "avg": {"s": total, "n": rows},
            "variance": _limb_sums(value),
            "stddev": _limb_sums(value),
            "array_agg": {"a": F.collect_set(value)},
        }
        if self.function not in choices:
            raise ValueError(f"Unknown aggregate: {self.function}")
        if self.function == "array_agg" and self.column not in LISTED_COLUMNS:
            raise ValueError(f"array_agg is limited to {', '.join(LISTED_COLUMNS)}, whose values are few")
        return choices[self.function]

    def merged(self, name: str) -> dict[str, Column]:
        merge = {"lo": F.min, "hi": F.max}
        return {
            p: F.array_distinct(F.flatten(F.collect_set(f"{name}__a"))) if p == "a" else merge.get(p, F.sum)(f"{name}__{p}")
            for p in self.parts()
        }

    def result(self, name: str) -> Column:
        def part(p: str) -> Column:
            return F.col(f"{name}__{p}")

        if self.function == "sum":
            return part("s")
        if self.function == "count":
            return F.coalesce(part("n"), F.lit(0))
        if self.function in ("min", "max"):
            return part("lo" if self.function == "min" else "hi")
        if self.function == "array_agg":
            return F.array_sort(part("a"))
        rows = as_double(part("n"))
        if self.function == "avg":
            return F.when(part("n") > 0, as_double(part("s")) / rows)
        variance = _variance(name)
        return variance if self.function == "variance" else F.sqrt(variance)


_LIMB = 1_000_000_000


def _limb_sums(value: Column) -> dict[str, Column]:
    """Sums of both limbs of the amounts in cents and of their products; no term exceeds 18 digits."""
    cents = (value.cast("decimal(18,2)") * F.lit(100)).cast("bigint")
    low = F.pmod(cents, F.lit(_LIMB))
    high = ((cents - low) / F.lit(_LIMB)).cast("bigint")
    terms = {"n": F.count(value), "h": high, "l": low, "hh": high * high, "hl": high * low, "ll": low * low}
    return {k: t if k == "n" else F.sum(t.cast("decimal(20,0)")) for k, t in terms.items()}


def _variance(name: str) -> Column:
    """Sample variance from limb sums.

    Sums are moved to the whole number of cents next to the mean, limb by limb, which stays exact.
    Close amounts leave a small high part, and all is added exactly; of amounts so far apart that
    this would not fit, the high part is nearly everything and nothing cancels.
    """
    part = {k: f"CAST(`{name}__{k}` AS DECIMAL(38,0))" for k in ("n", "h", "l", "hh", "hl", "ll")}
    mean = f"(({part['h']} * {_LIMB} + {part['l']}) div {part['n']})"
    low = f"CAST(pmod({mean}, {_LIMB}) AS DECIMAL(10,0))"
    high = f"CAST(({mean} - pmod({mean}, {_LIMB})) div {_LIMB} AS DECIMAL(10,0))"
    n = f"CAST(`{name}__n` AS DECIMAL(18,0))"
    hh = f"({part['hh']} - 2 * {high} * {part['h']} + {n} * ({high} * {high}))"
    hl = f"({part['hl']} - {low} * {part['h']} - {high} * {part['l']} + {n} * ({high} * {low}))"
    ll = f"({part['ll']} - 2 * {low} * {part['l']} + {n} * ({low} * {low}))"
    exact = f"CAST({hh} * CAST({_LIMB**2} AS DECIMAL(19,0)) + {hl} * {2 * _LIMB} + {ll} AS DOUBLE)"
    rough = f"(CAST({hh} AS DOUBLE) * {float(_LIMB) ** 2} + CAST({hl} AS DOUBLE) * {2.0 * _LIMB} + CAST({ll} AS DOUBLE))"
    squares = f"CASE WHEN {hh} < CAST(1{'0' * 18} AS DECIMAL(38,0)) THEN {exact} ELSE {rough} END"
    rest = f"CAST({part['h']} * {_LIMB} + {part['l']} - {part['n']} * {mean} AS DOUBLE)"  # the mean is no whole number
    return F.expr(f"CASE WHEN `{name}__n` > 1 THEN ({squares} - {rest} * {rest} / `{name}__n`) / 10000 / (`{name}__n` - 1) END")


def phase_total(phase: str) -> Measure:
    return Measure("sum", phase)


PLANNED_AND_EXECUTED = {"pim": phase_total("pim"), "devengado": phase_total("devengado")}


def owners(columns: Sequence[str]) -> list[Dimension]:
    """Dimensions that own the columns, in model order; fact columns need none."""
    names = {OWNER[c].name for c in columns if c in OWNER}
    return [d for n, d in BY_NAME.items() if n in names]


def join_members(
    table: DataFrame, star: Star, columns: Sequence[str], how: str = "left"
) -> tuple[DataFrame, list[Dimension]]:
    """Join only the dimensions that own one of the columns, each cut to its key and those columns."""
    used = owners(columns)
    for dimension in used:
        wanted = [c for c in dimension.columns if c in set(columns)]
        table = table.join(star.dim(dimension.name).select(dimension.key, *wanted), dimension.key, how)
    return table, used


def _restrict(fact: DataFrame, star: Star, labels: Mapping[str, str]) -> DataFrame:
    """Facts of the members that carry the wanted labels.

    Members are filtered first, and the fact is cut to their keys where it is scanned, so rows the
    filter drops are never aggregated or moved.
    """
    for dimension in owners(list(labels)):
        members = star.dim(dimension.name)
        for column in (c for c in labels if OWNER[c].name == dimension.name):
            members = members.where(F.upper(column) == labels[column])
        fact = fact.join(members.select(dimension.key), dimension.key, "left_semi")
    return fact


def aggregate(
    star: Star,
    measures: Mapping[str, Measure],
    by: Mapping[str, str] | None = None,
    filters: Filters | None = None,
    where: Sequence[Column] = (),
    fact_where: Sequence[Column] = (),
    where_columns: Sequence[str] = (),
    how: str = "left",
    guard: bool = True,
    on_fact: Sequence[str] = (),
) -> DataFrame:
    """Measures per group, as exact decimals.

    ``by`` maps output names to fact or dimension columns; ``where`` holds extra predicates over
    the dimension columns named in ``where_columns``; ``fact_where`` predicates reach the scan;
    columns in ``on_fact`` were already attached to the fact and need no join.

    The fact is first summed per surrogate key (and year or phase where grouped). That step is
    combined inside each task, so a key that holds a third of all rows still sends one row per
    task, and what meets a dimension is never larger than the distinct key tuples. The dimension
    side needs no broadcast hint: its measured size decides.
    """
    by, filters = dict(by or {}), filters or Filters()
    labels = filters.labels()
    attached = {*on_fact, *FACT_COLUMNS}
    dim_columns = [c for c in (*by.values(), *labels, *where_columns) if c in OWNER and c not in attached]
    unknown = [c for c in by.values() if c not in OWNER and c not in attached]
    if unknown:
        raise ValueError(f"Unknown grouping column: {', '.join(unknown)}")

    fact = guard_year(star.fact, star.cutoff) if guard else star.fact
    for condition in (filters.year_condition(), *fact_where):
        if condition is not None:
            fact = fact.where(condition)

    phases = {m.phase for m in measures.values()}
    if not by and None not in phases:  # no group can vanish, so only the wanted phases are read
        fact = fact.where(F.col("fase").isin(sorted(phases)))

    if labels and how != "full":
        fact = _restrict(fact, star, {c: v for c, v in labels.items() if c in dim_columns})
    keys = [d.key for d in owners(dim_columns)]
    fact_groups = [c for c in by.values() if c in attached and c not in keys]
    parts = [p.alias(f"{n}__{k}") for n, m in measures.items() for k, p in m.parts().items()]
    partial = fact.groupBy(*keys, *fact_groups).agg(*parts)

    if dim_columns:
        partial, _ = join_members(partial, star, dim_columns, how)
        for column, value in labels.items():
            partial = partial.where(F.upper(column) == value)
        for condition in where:
            partial = partial.where(condition)
    groups = [F.col(c).alias(o) for o, c in by.items()]
    if dim_columns:
        merged = [p.alias(f"{n}__{k}") for n, m in measures.items() for k, p in m.merged(n).items()]
        partial = partial.groupBy(*groups).agg(*merged)
    else:
        partial = partial.withColumnsRenamed({c: o for o, c in by.items()})
    return partial.select(*by, *[m.result(n).alias(n) for n, m in measures.items()])


def top(table: DataFrame, measure: str, limit: int | None, *ties: str, descending: bool = True) -> DataFrame:
    """Rows by measure, ties by label; a limit keeps the best rows of each task, then the best of those."""
    order = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    ordered = table.orderBy(order, *[F.col(t).asc_nulls_last() for t in ties])
    return ordered if limit is None else ordered.limit(limit)


def doubles(table: DataFrame, *columns: str) -> DataFrame:
    return table.withColumns({c: as_double(F.col(c)) for c in columns})
