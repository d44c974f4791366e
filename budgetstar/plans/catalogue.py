"""Registered queries: one callable per operator, each from a source folder to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetstar.functions.money import (
    as_double,
    currency_label,
    execution_tier,
    rate_pct,
    rate_pct_or_null,
    target_gap,
)
from budgetstar.model import (
    BY_NAME,
    DIMENSIONS,
    ENTITY_KEYS,
    MONEY,
    cell_columns,
    split_cell,
    text_columns,
)
from budgetstar.operators import clean, logs, quality, questions, reshape, sampling, star
from budgetstar.operators.aggregate import (
    PLANNED_AND_EXECUTED,
    Filters,
    Measure,
    aggregate,
    guard_year,
    phase_total,
)
from budgetstar.operators.grain import AGGREGATES, grain_aggregate
from budgetstar.plans import dashboard, reports
from budgetstar.plans import questions as worked
from budgetstar.plans.layers import Layers
from budgetstar.sources import bronze, fixture
from budgetstar.sources.parquet import register_star as register_views
from budgetstar.sources.parquet import write_layer
from budgetstar.sources.shared import application_folder
from budgetstar.streaming import traces
from budgetstar.streaming.ingest import ingest_incremental

Query = Callable[[SparkSession, str], DataFrame]

YEAR = fixture.REPORT_YEAR
CENTRE = "ASIA"  # the department whose weight the centralization report measures
SAMPLE_YEARS = (1997, 1998, 1999, 2000)
SAMPLE_TARGET = 10_007
ONE_YEAR = Filters(year=YEAR)

QUERIES: dict[str, Query] = {}


def named(name: str) -> Callable:
    """Register a query under a name that an import already uses."""

    def register(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Layers(spark, sf_dir))
        return build

    return register


def query(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
    return named(build.__name__)(build)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _tagged(name: str, frames: dict[str, DataFrame]) -> DataFrame:
    return _stack([df.select(F.lit(tag).alias(name), "*") for tag, df in frames.items()])


def _wide_silver(at: Layers) -> DataFrame:
    """Silver without keys: the columns of the wide source."""
    return at.silver.drop(*ENTITY_KEYS, "has_amount")


def _amounts_as_double(table: DataFrame) -> DataFrame:
    return table.withColumns({c: as_double(F.col(c)) for c in [*cell_columns(table.columns)]})


# --- bronze and silver ---------------------------------------------------------------------------


@query
def bronze_ingest(at: Layers) -> DataFrame:
    """Two folders of CSV files read back: every value as text, header blanks stripped."""
    return bronze.scan_csv(at.spark, [f"{at.csv_folder}/delivery_1", f"{at.csv_folder}/delivery_2"])


@query
def bronze_glob(at: Layers) -> DataFrame:
    """Two deliveries, the second with its columns in another order."""
    return bronze.scan_csv(at.spark, f"{at.csv_folder}/delivery_*/*.csv")


@query
def bronze_incremental(at: Layers) -> DataFrame:
    """The deliveries picked up one after the other by the incremental ingest."""
    folder = f"{application_folder(at.spark)}/incremental-{uuid.uuid4().hex[:12]}"
    names = [h.strip() for h in fixture.bronze_headers(at.wide.columns).values()]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    for delivery in ("delivery_1", "delivery_2"):
        run = ingest_incremental(
            at.spark, f"{at.csv_folder}/{delivery}", f"{folder}/{delivery}", f"{folder}/{delivery}-marks", schema
        )
        run.awaitTermination()
    return at.spark.read.option("recursiveFileLookup", True).schema(schema).parquet(folder + "/delivery_1", folder + "/delivery_2")


@query
def parquet_round_trip(at: Layers) -> DataFrame:
    """Fact rows written split by year, read back and summed."""
    path = f"{application_folder(at.spark)}/round-trip-{uuid.uuid4().hex[:12]}"
    back = write_layer(star.build_fact(at.silver), path, partition_by=["anio"])
    return back.groupBy("anio", "fase").agg(F.count("*").alias("n"), as_double(F.sum("monto")).alias("total"))


@query
def schema_dictionary(at: Layers) -> DataFrame:
    """CSV files read in the types of their data dictionary: variable, type, readable values."""
    columns = list(fixture.bronze_headers(at.wide.columns).items())
    kinds = [(h.strip(), "Numérico" if split_cell(c) else " Carácter ") for c, h in columns]
    dictionary = at.spark.createDataFrame(kinds, "VARIABLE string, TIPO_DATO string")
    schema = bronze.schema_from_dictionary(dictionary, [h for _, h in columns])
    typed = clean.clean_columns(bronze.scan_csv(at.spark, f"{at.csv_folder}/delivery_*", schema))
    counts = typed.agg(*[F.count(c).alias(c) for c in typed.columns])
    cells = [e for f in typed.schema.fields for e in (F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f.name))]
    return counts.select(F.stack(F.lit(len(typed.columns)), *cells).alias("variable", "data_type", "readable"))


@query
def rejected_values(at: Layers) -> DataFrame:
    """Values of all deliveries that do not fit the types of the data dictionary, by column and text."""
    headers = fixture.bronze_headers(at.wide.columns)
    key = headers["key_value"].strip()
    fields = [T.StructField(h.strip(), MONEY if split_cell(c) else T.StringType()) for c, h in headers.items()]
    found = bronze.rejected_values(at.spark, f"{at.csv_folder}/delivery_*", T.StructType(fields), [key])
    return found.groupBy("column", "text").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


@query
def clean_columns(at: Layers) -> DataFrame:
    return clean.clean_columns(bronze.strip_headers(fixture.bronze_text(at.spark, at.source)))


@query
def clean_silver(at: Layers) -> DataFrame:
    source = bronze.strip_headers(fixture.bronze_text(at.spark, at.source))
    return _amounts_as_double(clean.clean_silver(source))


@query
def clean_fold_accents(at: Layers) -> DataFrame:
    wide = at.wide.select(*text_columns(at.wide.columns))
    line_no = F.element_at(F.split("key_value", "-"), 2).cast("int")
    accented = wide.select(
        *[
            F.when(line_no % 3 == 0, F.concat(F.lit(" "), F.translate(F.lower(c), "aeiou", "áéíóú"))).otherwise(F.col(c)).alias(c)
            for c in wide.columns
        ]
    )
    return clean.clean_fold_accents(accented)


@query
def impute_sector(at: Layers) -> DataFrame:
    return clean.impute_sector(clean.clean_silver(at.wide)).select("key_value", "sec_ejec", "sector", "sector_nombre")


@query
def unpivot_phases(at: Layers) -> DataFrame:
    long = reshape.unpivot_phases(at.silver, ids=["key_value"])
    return long.withColumn("monto", as_double(F.col("monto")))


@query
def long_row_key(at: Layers) -> DataFrame:
    keyed = reshape.with_row_key(reshape.unpivot_phases(at.silver, ids=["key_value"]))
    return keyed.select("sk_silver_id", as_double(F.col("monto")).alias("monto"))


@query
def union_layers(at: Layers) -> DataFrame:
    """Two deliveries with different years, stacked and unpivoted."""
    wide = _wide_silver(at)
    early, late = ([c for c in cell_columns(wide.columns) if (split_cell(c)[1] < 1999) is first] for first in (True, False))
    whole = clean.union_layers([wide.select("key_value", *early), wide.select("key_value", *late)])
    long = reshape.unpivot_phases(whole)
    return long.groupBy("anio", "fase").agg(F.count("*").alias("n"), as_double(F.sum("monto")).alias("total"))


# --- star ----------------------------------------------------------------------------------------


@query
def surrogate_keys(at: Layers) -> DataFrame:
    return star.with_keys(clean.impute_sector(clean.clean_silver(at.wide))).select("key_value", *ENTITY_KEYS)


def _dimension_query(name: str) -> Query:
    return lambda spark, sf_dir: Layers(spark, sf_dir).star.dim(name)


for _dimension in DIMENSIONS:
    QUERIES[_dimension.table] = _dimension_query(_dimension.name)


@query
def fact_presupuesto(at: Layers) -> DataFrame:
    fact = star.build_fact(at.silver)
    return fact.withColumn("monto", as_double(F.col("monto")))


@query
def fk_orphans(at: Layers) -> DataFrame:
    return star.fk_orphans(at.star)


@query
def register_star(at: Layers) -> DataFrame:
    """The gold tables under their names, asked in SQL."""
    register_views(at.star)
    return at.spark.sql(
        """
        SELECT g.departamento_ejecutora_nombre AS department, f.fase, count(*) AS n,
               CAST(sum(f.monto) AS DOUBLE) AS total
        FROM fact_presupuesto f JOIN dim_geografia g ON f.sk_geografia_id = g.sk_geografia_id
        GROUP BY 1, 2
        """
    )


# --- predicates and measures ---------------------------------------------------------------------


@named("guard_year")
def guard_year_rows(at: Layers) -> DataFrame:
    kept = guard_year(at.star.fact, at.star.cutoff)
    return kept.groupBy("anio", "fase").agg(F.count("*").alias("n"), as_double(F.sum("monto")).alias("total"))


@query
def filtered_kpis(at: Layers) -> DataFrame:
    gold = at.star
    return _tagged(
        "scenario",
        {
            "level and department": dashboard.kpis(gold, Filters(YEAR, "f", "all", " asia ")),
            "sector as text year": dashboard.kpis(gold, Filters(str(YEAR), None, "nation_3", "ALL")),
            "blocked year": dashboard.kpis(gold, Filters(year=fixture.CUTOFF + 1)),
            "no such department": dashboard.kpis(gold, Filters(department="nowhere")),
        },
    )


@query
def ilike_filter(at: Layers) -> DataFrame:
    return worked.ilike_filter(at.star, "producto_proyecto_nombre", "widGet")


@query
def phase_totals(at: Layers) -> DataFrame:
    return dashboard.phase_totals(at.star)


@query
def execution_rate(at: Layers) -> DataFrame:
    """Both ratio conventions; the opening budget is missing for some groups and so is their rate."""
    measures = {"pia": phase_total("pia"), "girado": phase_total("girado")}
    groups = aggregate(at.star, measures, {"anio": "anio", "line": "subgenerica"})
    part, whole = F.col("girado"), F.col("pia")
    return groups.select(
        "anio", "line", rate_pct(part, whole).alias("rate_or_zero"), rate_pct_or_null(part, whole).alias("rate_or_null")
    )


@query
def join_pruning(at: Layers) -> DataFrame:
    """Grouped by a fact column and filtered by one dimension: the other four are never read."""
    groups = aggregate(at.star, PLANNED_AND_EXECUTED, {"anio": "anio"}, Filters(department="ASIA"))
    return groups.select("anio", *[as_double(F.col(c)).alias(c) for c in PLANNED_AND_EXECUTED])


@named("currency_label")
def currency_label_amounts(at: Layers) -> DataFrame:
    totals = aggregate(at.star, {"amount": phase_total("pim")}, {"name": "sector_nombre"})
    largest = aggregate(at.star, {"amount": Measure("max")}, {"name": "sector_nombre"})
    both = _tagged("kind", {"total": totals, "largest": largest})
    return both.select("kind", "name", as_double(F.col("amount")).alias("amount"), currency_label(F.col("amount")).alias("label"))


@named("execution_tier")
def execution_tier_groups(at: Layers) -> DataFrame:
    groups = aggregate(
        at.star, {"part": phase_total("girado"), "whole": phase_total("pim")}, {"anio": "anio", "name": "ejecutora_nombre"}
    )
    rated = groups.select("anio", "name", rate_pct(F.col("part"), F.col("whole")).alias("rate"))
    return rated.select("*", execution_tier(F.col("rate")).alias("tier"), target_gap(F.col("rate")).alias("target_gap"))


@query
def measure_catalog(at: Layers) -> DataFrame:
    """Every aggregate of the request interface at one grain."""
    measures = {f"monto_{a}": Measure(a) for a in AGGREGATES if a != "array_agg"}
    measures["fases"] = Measure("array_agg", column="fase")
    groups, grain = grain_aggregate(at.star, measures, ["fi.fuente_financiamiento_nombre", "anio"])
    shown = {"monto_sum": "decimal(28,2)", "monto_min": "decimal(28,2)", "monto_max": "decimal(28,2)"}
    shown |= {"monto_avg": "decimal(28,3)", "monto_stddev": "decimal(28,3)", "monto_variance": "decimal(28,0)"}
    return groups.select(
        F.lit(grain).alias("grain"),
        "fuente_financiamiento_nombre",
        "anio",
        "monto_count",
        *[as_double(F.col(c).cast(t)).alias(c) for c, t in shown.items()],
        F.array_join("fases", ",").alias("fases"),
    )


@named("grain_aggregate")
def grain_aggregate_requests(at: Layers) -> DataFrame:
    requests = {"scalar": [], "year": ["anio"], "sector": ["i.sector_nombre"], "sector by year": ["sector_nombre", "f.anio"]}
    frames = {}
    for name, by in requests.items():
        groups, grain = grain_aggregate(at.star, {"pim": phase_total("pim")}, by)
        columns = groups.columns
        frames[name] = groups.select(
            F.lit(grain).alias("grain"),
            (F.col("sector_nombre") if "sector_nombre" in columns else F.lit(None).cast("string")).alias("sector"),
            (F.col("anio") if "anio" in columns else F.lit(None)).cast("string").alias("anio"),
            as_double(F.col("pim")).alias("pim"),
        )
    return _tagged("request", frames)


# --- dashboard -----------------------------------------------------------------------------------


@query
def filter_options(at: Layers) -> DataFrame:
    return dashboard.filter_options(at.star)


@query
def kpis(at: Layers) -> DataFrame:
    return dashboard.kpis(at.star)


@query
def pair_coverage(at: Layers) -> DataFrame:
    return _tagged(
        "years", {"all": dashboard.pair_coverage(at.star), "reportable": dashboard.pair_coverage(at.star, guard=True)}
    )


@query
def top_concentrations(at: Layers) -> DataFrame:
    columns = dashboard.CONCENTRATION_COLUMNS
    return _tagged("by", {c: dashboard.top_concentrations(at.star, c, 10, ONE_YEAR) for c in columns})


@query
def execution_variance(at: Layers) -> DataFrame:
    columns = dashboard.VARIANCE_COLUMNS
    return _tagged("by", {c: dashboard.execution_variance(at.star, c, Filters(department="Asia")) for c in columns})


@query
def variance_top10(at: Layers) -> DataFrame:
    return dashboard.chart_top(dashboard.execution_variance(at.star, "sector_nombre"), "dimension")


@query
def geographic_heatmap(at: Layers) -> DataFrame:
    return dashboard.geographic_heatmap(at.star)


@query
def heatmap_matrix(at: Layers) -> DataFrame:
    return dashboard.heatmap_matrix(at.star, [y for y in fixture.YEARS if y <= fixture.CUTOFF])


@query
def economic_composition(at: Layers) -> DataFrame:
    return dashboard.economic_composition(at.star, ONE_YEAR)


@query
def financing_structure(at: Layers) -> DataFrame:
    return dashboard.financing_structure(at.star, Filters(year=YEAR, government_level="o"))


@query
def programmatic_allocation(at: Layers) -> DataFrame:
    columns = dashboard.PROGRAM_COLUMNS
    return _tagged("by", {c: dashboard.programmatic_allocation(at.star, c, 10, ONE_YEAR) for c in columns})


@query
def dashboard_unfiltered(at: Layers) -> DataFrame:
    """The filterable breakdowns over all reportable years and members."""
    frames = {f"top {c}": dashboard.top_concentrations(at.star, c, 10).toDF("name", "amount") for c in dashboard.CONCENTRATION_COLUMNS}
    for c in dashboard.VARIANCE_COLUMNS:
        frames[f"variance {c}"] = dashboard.execution_variance(at.star, c).select(F.col("dimension").alias("name"), F.col("pim").alias("amount"))
    for c in dashboard.PROGRAM_COLUMNS:
        frames[f"program {c}"] = dashboard.programmatic_allocation(at.star, c, 10).toDF("name", "amount")
    frames["economic"] = dashboard.economic_composition(at.star).select(F.col("economic_category").alias("name"), F.col("pim").alias("amount"))
    frames["financing"] = dashboard.financing_structure(at.star).select(F.col("financing_source").alias("name"), F.col("pim").alias("amount"))
    return _tagged("breakdown", frames)


# --- reports and worked questions ----------------------------------------------------------------


@query
def report_top_departments(at: Layers) -> DataFrame:
    return reports.top_departments(at.star, YEAR)


@query
def report_pim_growth(at: Layers) -> DataFrame:
    return reports.pim_growth(at.star)


@query
def report_pim_growth_all_years(at: Layers) -> DataFrame:
    return reports.pim_growth(at.star, guard=False)


@query
def report_sector_projects(at: Layers) -> DataFrame:
    return reports.sector_projects(at.star, YEAR)


@query
def report_sector_projects_approx(at: Layers) -> DataFrame:
    """The sketch next to the exact count, and whether it is within its tolerance."""
    near = reports.sector_projects_approx(at.star, YEAR).select("government_sector", F.col("estimated_project_count").alias("near"))
    exact = reports.sector_projects(at.star, YEAR).select("government_sector", F.col("estimated_project_count").alias("exact"))
    both = exact.join(near, "government_sector", "left")
    counts = {c: F.replace(F.col(c), F.lit(","), F.lit("")).cast("bigint") for c in ("near", "exact")}
    gap = F.abs(counts["near"] - counts["exact"])
    within = gap <= F.greatest(F.lit(1.0), 0.1 * counts["exact"])
    return both.select("government_sector", counts["exact"].alias("exact"), F.coalesce(within, F.lit(False)).alias("within_tolerance"))


@query
def report_centralization(at: Layers) -> DataFrame:
    return reports.centralization(at.star, YEAR, CENTRE)


@query
def q_total_pim(at: Layers) -> DataFrame:
    return worked.total_pim(at.star, YEAR)


@query
def q_sector_rate(at: Layers) -> DataFrame:
    return worked.sector_rate(at.star, YEAR)


@query
def q_top5_departments(at: Layers) -> DataFrame:
    return worked.top5_departments(at.star, YEAR)


@query
def q_level_compare(at: Layers) -> DataFrame:
    return worked.level_compare(at.star, YEAR)


@query
def q_by_source(at: Layers) -> DataFrame:
    return worked.by_source(at.star, YEAR)


@query
def top_project_trend(at: Layers) -> DataFrame:
    return worked.top_project_trend(at.star, "o", "amer")


@query
def multi_family_union(at: Layers) -> DataFrame:
    return worked.multi_family_union(at.star)


# --- quality -------------------------------------------------------------------------------------


@query
def reconcile_total(at: Layers) -> DataFrame:
    return quality.reconcile_total(_wide_silver(at), at.star.fact)


@query
def volumetrics(at: Layers) -> DataFrame:
    return quality.volumetrics(_wide_silver(at), at.star.fact)


@query
def reconcile_by_year_phase(at: Layers) -> DataFrame:
    return quality.reconcile_by_year_phase(_wide_silver(at), at.star.fact)


@query
def key_uniqueness(at: Layers) -> DataFrame:
    return quality.key_uniqueness(_wide_silver(at))


@query
def duplicate_keys(at: Layers) -> DataFrame:
    return quality.duplicate_keys(_wide_silver(at))


@query
def duplicate_key_diff(at: Layers) -> DataFrame:
    return quality.duplicate_key_diff(_wide_silver(at))


@query
def duplicate_key_amounts(at: Layers) -> DataFrame:
    return quality.duplicate_key_amounts(_wide_silver(at))


@query
def table_audit(at: Layers) -> DataFrame:
    return quality.table_audit(at.star)


@query
def layer_storage(at: Layers) -> DataFrame:
    """Rows per stored layer, and that each has files with bytes; their numbers depend on the run."""
    usage = quality.layer_storage({n: at.spark.read.parquet(p) for n, p in at.folders().items()})
    return usage.select("layer", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("is_stored"))


@query
def run_drift(at: Layers) -> DataFrame:
    """The kept star against a second run of the pipeline over the same source."""
    again = Layers(at.spark, at.source, run="again")
    return quality.run_drift(
        quality.snapshot(at.star.tables()), quality.snapshot(star.build_star(again.silver, fixture.CUTOFF).tables())
    )


@query
def drift_rows(at: Layers) -> DataFrame:
    """The star against a copy in which three names differ, two members and no fact rows are missing."""
    first = at.star.tables()
    units, programs = first["dim_institucion"], first["dim_programatica"]
    renamed = units.orderBy("sk_institucion_id").limit(3).select(F.col("sk_institucion_id").alias("k"))
    gone = programs.orderBy("sk_programatica_id").limit(2).select("sk_programatica_id")
    marked = units.join(renamed, F.col("sk_institucion_id") == F.col("k"), "left")
    name = F.when(F.col("k").isNotNull(), F.concat("ejecutora_nombre", F.lit("*"))).otherwise(F.col("ejecutora_nombre"))
    second = first | {
        "dim_institucion": marked.withColumn("ejecutora_nombre", name).select(*units.columns),
        "dim_programatica": programs.join(gone, "sk_programatica_id", "left_anti").select(*programs.columns),
    }
    return quality.drift_rows(first, second)


@query
def fact_year_range(at: Layers) -> DataFrame:
    return quality.fact_year_range(at.star.fact)


@query
def execution_rates(at: Layers) -> DataFrame:
    return quality.execution_rates(at.star.fact)


@query
def region_pim_share(at: Layers) -> DataFrame:
    return quality.region_pim_share(at.star)


# --- sampling ------------------------------------------------------------------------------------


def _entities(at: Layers) -> DataFrame:
    return sampling.select_entities(sampling.entity_sizes(at.star.fact, SAMPLE_YEARS), SAMPLE_TARGET)


@query
def entity_sizes(at: Layers) -> DataFrame:
    return sampling.entity_sizes(at.star.fact, SAMPLE_YEARS).orderBy("order_key", *ENTITY_KEYS)


@query
def entity_sample(at: Layers) -> DataFrame:
    return _entities(at)


@query
def sample_facts(at: Layers) -> DataFrame:
    facts = sampling.sample_facts(at.star.fact, _entities(at), SAMPLE_YEARS)
    return facts.withColumn("monto", as_double(F.col("monto")))


@query
def sample_dims(at: Layers) -> DataFrame:
    sample = sampling.sample_star(at.star, _entities(at), SAMPLE_YEARS)
    return _tagged(
        "table_name",
        {
            BY_NAME[n].table: d.select(
                F.col(BY_NAME[n].key).alias("sk"),
                F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("~")) for c in BY_NAME[n].columns]).alias("member"),
            )
            for n, d in sample.dims.items()
        },
    )


@query
def sample_integrity(at: Layers) -> DataFrame:
    entities = _entities(at)
    return sampling.sample_integrity(sampling.sample_facts(at.star.fact, entities, SAMPLE_YEARS), entities)


@query
def sample_gates(at: Layers) -> DataFrame:
    sample = sampling.sample_star(at.star, _entities(at), SAMPLE_YEARS)
    return quality.sample_gates(sample, SAMPLE_TARGET, region_threshold=20.0)


@query
def sample_manifest(at: Layers) -> DataFrame:
    entities = _entities(at)
    sample = sampling.sample_star(at.star, entities, SAMPLE_YEARS)
    return sampling.sample_manifest(sample, entities, SAMPLE_TARGET, SAMPLE_YEARS)


@query
def star_flat_sample(at: Layers) -> DataFrame:
    return sampling.flat_sample(at.star).withColumn("monto", as_double(F.col("monto")))


# --- question and log jobs -----------------------------------------------------------------------


@query
def tag_question_grain(at: Layers) -> DataFrame:
    return questions.tag_question_grain(fixture.question_table(at.spark, at.source)).drop("question")


@query
def audit_query_log(at: Layers) -> DataFrame:
    return logs.audit_query_log(fixture.query_log(at.spark, at.source)).drop("sql")


@query
def trace_group_fields(at: Layers) -> DataFrame:
    return logs.trace_group_fields(fixture.query_log(at.spark, at.source)).drop("sql")


@query
def trace_stage_stats(at: Layers) -> DataFrame:
    return logs.trace_stage_stats(fixture.trace_log(at.spark, at.source))


@query
def trace_stage_stats_approx(at: Layers) -> DataFrame:
    """Exact percentiles, and whether the sketch is within one percent of them."""
    log = fixture.trace_log(at.spark, at.source)
    exact, near = logs.trace_stage_stats(log), logs.trace_stage_stats_approx(log)
    both = exact.join(near.select("stage", F.col("p50_ms").alias("n50"), F.col("p95_ms").alias("n95")), "stage")
    close = [F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(0.05), 0.01 * F.col(a)) for a, b in (("p50_ms", "n50"), ("p95_ms", "n95"))]
    return both.select("stage", "runs", "p50_ms", "p95_ms", (close[0] & close[1]).alias("within_tolerance"))


@query
def trace_stage_stats_stream(at: Layers) -> DataFrame:
    """The log delivered in three parts, counted by a stream that goes on after each."""
    folder = f"{application_folder(at.spark)}/traces-{uuid.uuid4().hex[:12]}"
    log = fixture.trace_log(at.spark, at.source)
    for part in range(3):
        delivered = log.where(F.pmod(F.xxhash64("trace_id"), F.lit(3)) == part).select("payload")
        delivered.write.mode("append").text(f"{folder}/log")
        traces.write_band_counts(traces.read_trace_stream(at.spark, f"{folder}/log"), f"{folder}/bands", f"{folder}/marks").awaitTermination()
    return traces.stage_percentiles(at.spark.read.parquet(f"{folder}/bands")).select(
        "stage", "runs", "failed", "max_ms", "p50_band", "p95_band"
    )


@query
def trace_failures(at: Layers) -> DataFrame:
    return logs.trace_failures(fixture.trace_log(at.spark, at.source))
