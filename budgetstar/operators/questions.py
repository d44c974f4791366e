"""Tag a table of questions with the analytical grain they ask for. Row by row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.text import stripped

YEAR, SCALAR = "year-level", "scalar"

# Words and phrases (English and Spanish) of each grain, with and without accents. A
# phrase that contains a listed word needs no entry of its own.
GRAIN_WORDS = {
    "economic-level": (
        "economic",
        "economico",
        "economica",
        "expense category",
        "categoria de gasto",
        "categoria gasto",
        "generic expense",
        "genérica",
        "generica",
        "subgenérica",
        "subgenerica",
        "específica",
        "especifica",
    ),
    "financing-level": (
        "financing",
        "financiamiento",
        "rubro",
        "resource type",
        "tipo recurso",
        "tipo de recurso",
    ),
    "geography-level": (
        "department",
        "departamento",
        "region",
        "province",
        "provincia",
        "district",
        "distrito",
        "geographic",
        "geográfico",
        "geografico",
        "geography",
        "geografia",
        "location",
        "ubicación",
        "ubicacion",
        "por región",
        "por region",
    ),
    "institution-level": (
        "institution",
        "institución",
        "institucion",
        "sector",
        "government level",
        "nivel gobierno",
        "nivel de gobierno",
        "national",
        "nacional",
        "regional",
        "local",
        "pliego",
        "institutional",
        "institucional",
        "executing unit",
        "ejecutora",
    ),
    "program-level": (
        "program",
        "programa",
        "programmatic",
        "programática",
        "programatica",
        "ppto",
    ),
    "project-level": (
        "project",
        "proyecto",
        "product",
        "producto",
        "investment",
        "inversión",
        "inversion",
    ),
    "function-level": (
        "function",
        "función",
        "funcion",
        "functional",
        "funcional",
    ),
    "activity-level": (
        "activity",
        "actividad",
        "action",
        "acción",
        "accion",
        "obra",
    ),
    YEAR: (
        "year",
        "anio",
        "año",
        "annual",
        "anual",
        "annually",
        "anualmente",
        "yearly",
        "year-over-year",
        "interanual",
        "trend",
        "tendencia",
        "evolution",
        "evolución",
        "evolucion",
        "over time",
        "historical",
        "histórico",
        "historico",
        "time series",
        "serie temporal",
        "serie de tiempo",
    ),
}

# The instruction that goes with each kind of question.
SCALAR_RULE = "Aggregate all rows without GROUP BY."
ONE_FAMILY_RULE = "GROUP BY must stay within one dimension family plus optionally year."
SPLIT_RULE = (
    "WARNING: This question spans multiple dimension families. You MUST decompose it into separate "
    "sub-queries connected via CTEs (WITH ... AS (...)). Do NOT group by columns from different "
    "dimension families in a single SELECT."
)

_EDGE_MARKS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _with_singulars(word: Column) -> Column:
    """The word and its possible singulars: activities -> activity, sectores -> sector, programs -> program."""
    size = F.length(word)
    plural = (size > 3) & word.endswith("s") & ~word.endswith("ss")
    ies = F.when(plural & (size > 4) & word.endswith("ies"), F.concat(F.left(word, size - 3), F.lit("y")))
    es = F.when(plural & (size > 4) & word.endswith("es"), F.left(word, size - 2))
    s = F.when(plural, F.left(word, size - 1))
    return F.array_compact(F.array(word, ies, es, s))


def question_tokens(question: Column, strip_punctuation: bool = True) -> Column:
    """Words with their singulars, in order."""
    words = F.split(stripped(F.lower(question)), r"\s+")
    if strip_punctuation:
        words = F.transform(words, lambda w: F.regexp_replace(w, _EDGE_MARKS, ""))
    words = F.filter(words, lambda w: w != "")
    return F.flatten(F.transform(words, _with_singulars))


def tag_question_grain(questions: DataFrame, question: str = "question", strip_punctuation: bool = True) -> DataFrame:
    """Adds the detected grains, the primary one, validity and the instruction text.

    Runs of up to three words are looked up in the fixed dictionary with one array overlap per
    grain; nothing is exploded, joined or grouped, so any number of questions is one narrow stage.
    """

    def joined(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(" "), b)

    words, pairs = F.col("_words"), F.col("_pairs")
    tagged = (
        questions.withColumn("_words", question_tokens(F.coalesce(F.col(question), F.lit("")), strip_punctuation))
        .withColumn("_pairs", F.zip_with(words, F.slice(words, 2, F.size(words)), joined))
        .withColumn("_triples", F.zip_with(pairs, F.slice(words, 3, F.size(words)), joined))
        .withColumn("_runs", F.array_compact(F.concat("_words", "_pairs", "_triples")))
    )
    found = [
        F.when(F.arrays_overlap(F.col("_runs"), F.array(*[F.lit(w) for w in ws])), F.lit(grain))
        for grain, ws in sorted(GRAIN_WORDS.items())
    ]
    tagged = tagged.withColumn("_found", F.array_compact(F.array(*found)))
    families = F.array_remove("_found", YEAR)
    tagged = tagged.withColumn("_families", families).withColumn("has_year", F.array_contains("_found", YEAR))

    n, year = F.size("_families"), F.col("has_year")
    primary = F.when(n == 1, F.element_at("_families", 1)).when((n == 0) & year, YEAR).when(n == 0, SCALAR)
    tagged = tagged.withColumn("primary_grain", primary).withColumn("is_valid", n <= 1)
    grain = F.when(
        (n == 1) & year, F.regexp_replace("primary_grain", "-level$", "_year-level")
    ).otherwise(F.col("primary_grain"))
    tagged = tagged.withColumn("composite_grain", grain)
    rule = (
        F.when(n > 1, SPLIT_RULE)
        .when(F.col("primary_grain") == SCALAR, SCALAR_RULE)
        .otherwise(F.concat(F.lit("Analytical grain: "), F.col("composite_grain"), F.lit(". " + ONE_FAMILY_RULE)))
    )
    detected = F.when(F.size("_found") == 0, SCALAR).otherwise(F.array_join("_found", ","))
    return tagged.select(
        *questions.columns,
        detected.alias("detected_grains"),
        "primary_grain",
        "composite_grain",
        "has_year",
        "is_valid",
        (~F.col("is_valid")).alias("needs_decomposition"),
        rule.alias("constraint"),
    )
