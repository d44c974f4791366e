"""Grain-checked aggregation: one dimension family per grouping, optionally by year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from budgetstar.model import DIMENSIONS, FACT, FACT_COLUMNS, Star
from budgetstar.operators.aggregate import Filters, Measure, aggregate, guard_year
from budgetstar.sources.shared import cut_lineage

# The eight dimension families and the columns that belong to each (code and label).
FAMILY_CODES = {
    "project": ("producto_proyecto", "tipo_act_proy"),
    "institution": ("pliego", "sector", "nivel_gobierno", "ejecutora", "sec_ejec"),
    "program": ("programa_ppto",),
    "geography": ("departamento_ejecutora", "provincia_ejecutora", "distrito_ejecutora"),
    "economic": (
        "tipo_transaccion",
        "generica",
        "subgenerica",
        "subgenerica_det",
        "especifica",
        "especifica_det",
    ),
    "financing": ("fuente_financiamiento", "rubro", "tipo_recurso", "categoria_gasto"),
    "function": ("funcion", "division_funcional", "grupo_funcional"),
    "activity": ("actividad_accion_obra",),
}
# Key columns that stand for a family, table aliases, aggregate names.
FAMILY_KEYS = {"sk_programatica_id": "project", "sk_institucion_id": "institution"}
ALIASES = {
    "f": FACT,
    "g": "dim_geografia",
    "i": "dim_institucion",
    "p": "dim_programatica",
    "e": "dim_economica",
    "fi": "dim_financiamiento",
}
AGGREGATES = ("sum", "count", "avg", "min", "max", "stddev", "variance", "array_agg")

YEAR, UNKNOWN, SCALAR = "year", "unknown", "scalar"
FAMILY_OF = {
    **{c: f for f, codes in FAMILY_CODES.items() for code in codes for c in (code, f"{code}_nombre")},
    **FAMILY_KEYS,
    "anio": YEAR,
}
TABLES = {FACT: FACT_COLUMNS, **{d.table: (d.key, *d.columns) for d in DIMENSIONS}}


class GrainError(ValueError):
    """A request the star schema cannot answer at one grain."""


class UnknownTableError(GrainError):
    pass


class UnknownColumnError(GrainError):
    pass


class AmbiguousColumnError(GrainError):
    pass


class UngroupedColumnError(GrainError):
    pass


class MixedGrainError(GrainError):
    pass


def resolve(column: str) -> str:
    """``i.sector`` or ``sector`` to the bare column name, checked against the gold tables."""
    qualifier, _, name = column.rpartition(".")
    if qualifier:
        table = ALIASES.get(qualifier, qualifier)
        if table not in TABLES:
            raise UnknownTableError(f"Unknown table alias '{qualifier}' in column '{column}'")
        if name not in TABLES[table]:
            raise UnknownColumnError(f"Column '{name}' not found in table '{table}'")
        return name
    found = [t for t, columns in TABLES.items() if name in columns]
    if not found:
        raise UnknownColumnError(f"Column '{name}' not found in any known table")
    if len(found) > 1:
        raise AmbiguousColumnError(f"Column '{name}' is ambiguous (exists in {', '.join(found)})")
    return name


def grain_of(columns: Sequence[str]) -> str:
    """Name of the grain of a grouping; more than one family, or a mix with no name, is an error."""
    families = {FAMILY_OF.get(c, UNKNOWN) for c in columns}
    if not families:
        return SCALAR
    if len(families) == 1:
        return f"{families.pop()}-level"
    named = families - {YEAR}
    if len(named) == 1 and UNKNOWN not in named:
        return f"{named.pop()}_year-level"
    raise MixedGrainError(f"Mixed or ambiguous analytical grain: {', '.join(sorted(families))}")


def check_request(by: Sequence[str], selected: Sequence[str] = (), filtered: Sequence[str] = ()) -> tuple[list[str], str]:
    """Resolved grouping columns and the grain; selected plain columns have to be grouped."""
    groups = [resolve(c) for c in by]
    loose = [c for c in selected if resolve(c) not in groups]
    if loose:
        raise UngroupedColumnError(f"Non-aggregated columns {', '.join(loose)} must appear in GROUP BY")
    for column in filtered:
        resolve(column)
    return groups, grain_of(groups)


def grain_aggregate(
    star: Star,
    measures: Mapping[str, Measure],
    by: Sequence[str] = (),
    filters: Filters | None = None,
    selected: Sequence[str] = (),
) -> tuple[DataFrame, str]:
    """Measures per group and the name of the grain; amounts stay exact decimals."""
    for name, measure in measures.items():
        if measure.function not in AGGREGATES:
            raise GrainError(f"Unknown aggregate '{measure.function}' for '{name}'")
    groups, grain = check_request(by, selected)
    return aggregate(star, measures, {c: c for c in groups}, filters), grain


def rank_then_follow(
    star: Star,
    winners: DataFrame,
    key: str,
    label: str,
    measures: Mapping[str, Measure],
) -> DataFrame:
    """Yearly measures of a few ranked members.

    ``winners`` comes from a limit, one row per key. It is worked out and written once; its
    measured size decides how the fact is cut to those keys.
    """
    chosen = cut_lineage(winners.select(key, label))
    fact = guard_year(star.fact, star.cutoff).join(chosen, key)
    return aggregate(star.with_fact(fact), measures, {label: label, "anio": "anio"}, on_fact=[label])
