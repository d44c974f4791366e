"""The gold model: phases, dimensions, fact columns and the ``Star`` handle."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Phases of budget execution, in the order they happen.
PHASES = (
    "pia",
    "pim",
    "certificado",
    "comprometido_anual",
    "comprometido",
    "devengado",
    "girado",
)
PLANNED, EXECUTED, PAID = "pim", "devengado", "girado"

# Fixed value: the last fiscal year that may be reported (the next one repeats it in the source).
YEAR_CUTOFF = 2025

MONEY = T.DecimalType(18, 2)

# Anchored, so comprometido_anual_2024 belongs to comprometido_anual only and a text column that
# merely contains a phase name never becomes an amount.
_CELL = re.compile(rf"^({'|'.join(sorted(PHASES, key=len, reverse=True))})_(\d{{4}})$")


def named(*codes: str) -> tuple[str, ...]:
    """Each code column followed by its ``_nombre`` label column."""
    return tuple(c for code in codes for c in (code, f"{code}_nombre"))


@dataclass(frozen=True)
class Dimension:
    name: str
    columns: tuple[str, ...]
    codes: tuple[str, ...]  # hashed into the key; the order matters
    required: str  # rows without this code have no member

    @property
    def table(self) -> str:
        return f"dim_{self.name}"

    @property
    def key(self) -> str:
        return f"sk_{self.name}_id"

    @property
    def schema(self) -> T.StructType:
        codes = [T.StructField(c, T.StringType()) for c in self.columns]
        return T.StructType([T.StructField(self.key, T.LongType()), *codes])


# The five dimensions of the gold layer.
DIMENSIONS: tuple[Dimension, ...] = (
    Dimension(
        name="geografia",
        columns=named("departamento_ejecutora", "provincia_ejecutora", "distrito_ejecutora"),
        codes=("departamento_ejecutora", "provincia_ejecutora", "distrito_ejecutora"),
        required="departamento_ejecutora",
    ),
    Dimension(
        name="institucion",
        columns=(*named("nivel_gobierno", "sector", "pliego"), "sec_ejec", *named("ejecutora")),
        codes=("nivel_gobierno", "sector", "pliego", "sec_ejec"),
        required="nivel_gobierno",
    ),
    Dimension(
        name="programatica",
        columns=named(
            "programa_ppto",
            "tipo_act_proy",
            "producto_proyecto",
            "actividad_accion_obra",
            "funcion",
            "division_funcional",
            "grupo_funcional",
            "meta",
        ),
        codes=(
            "programa_ppto",
            "producto_proyecto",
            "actividad_accion_obra",
            "funcion",
            "division_funcional",
            "grupo_funcional",
            "meta",
        ),
        required="programa_ppto",
    ),
    Dimension(
        name="economica",
        columns=(
            "tipo_transaccion",
            *named("generica", "subgenerica", "subgenerica_det", "especifica", "especifica_det"),
        ),
        codes=(
            "tipo_transaccion",
            "generica",
            "subgenerica",
            "subgenerica_det",
            "especifica",
            "especifica_det",
        ),
        required="tipo_transaccion",
    ),
    Dimension(
        name="financiamiento",
        columns=named("fuente_financiamiento", "rubro", "tipo_recurso", "categoria_gasto"),
        codes=("fuente_financiamiento", "rubro", "tipo_recurso", "categoria_gasto"),
        required="fuente_financiamiento",
    ),
)

BY_NAME: Mapping[str, Dimension] = {d.name: d for d in DIMENSIONS}
ENTITY_KEYS: tuple[str, ...] = tuple(d.key for d in DIMENSIONS)
FACT = "fact_presupuesto"
FACT_COLUMNS: tuple[str, ...] = (*ENTITY_KEYS, "anio", "fase", "monto")
FACT_SCHEMA = T.StructType(
    [
        *[T.StructField(k, T.LongType()) for k in ENTITY_KEYS],
        T.StructField("fase", T.StringType()),
        T.StructField("monto", MONEY),
        T.StructField("anio", T.IntegerType()),
    ]
)
OWNER: Mapping[str, Dimension] = {c: d for d in DIMENSIONS for c in d.columns}


def split_cell(column: str) -> tuple[str, int] | None:
    """``pim_2024`` -> ``("pim", 2024)``; None for every other column."""
    match = _CELL.match(column)
    return (match.group(1), int(match.group(2))) if match else None


def cell_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if split_cell(c)]


def text_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if not split_cell(c)]


@dataclass(frozen=True)
class Star:
    """The gold tables plus the last reportable year."""

    fact: DataFrame
    dims: Mapping[str, DataFrame] = field(default_factory=dict)
    cutoff: int = YEAR_CUTOFF

    def dim(self, name: str) -> DataFrame:
        return self.dims[name]

    def with_fact(self, fact: DataFrame) -> Star:
        return replace(self, fact=fact)

    def tables(self) -> dict[str, DataFrame]:
        return {FACT: self.fact, **{BY_NAME[n].table: df for n, df in self.dims.items()}}
