"""One statement per registered query. Expected values of the text jobs are typed by hand."""

from oracles.prefix import (
    DIMENSIONS,
    KEY_LIST,
    KEYS,
    PHASES,
    TEXT_COLUMNS,
    YEARS,
    cell,
    hashed,
    on_star,
)

CUTOFF, YEAR = 2000, 1998
SAMPLE_YEARS, TARGET = "(1997, 1998, 1999, 2000)", 10007
GEO, INST, PROG, ECON, FIN = KEYS

PIM = "sum(CASE WHEN fase = 'pim' THEN monto ELSE 0 END)"
DEV = "sum(CASE WHEN fase = 'devengado' THEN monto ELSE 0 END)"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {dbl(part)} / {dbl(whole)} * 100.0 ELSE 0.0 END"


def short(value: str) -> str:
    return f"regexp_replace(format('{{:.2f}}', {value}), '0$', '')"


def percent(part: str, whole: str) -> str:
    return f"{short(f'round({dbl(part)} / {dbl(whole)} * 100, 2)')} || ' %'"


def billions(amount: str) -> str:
    return dbl(f"round(CAST({amount} AS DECIMAL(24,2)) * 0.000000001, 2)")


ORACLES: dict[str, str] = {}

# --- bronze and silver ---------------------------------------------------------------------------

CELLS = [(f"{p}_{y}", p, y) for p in PHASES for y in YEARS]


def header(column: str) -> str:
    if column == "key_value":
        return "KEY_VALUE"
    return column.replace("_", " ").title().replace("Programa", "Prográma").replace("Funcion", "Función")


def padded(column: str) -> str:
    return f"CASE WHEN ln % 4 = 0 THEN '  ' || lower({column}) || ' ' ELSE {column} END"


def amount_text(phase: str, year: int) -> str:
    return f"CASE WHEN ln % 5 = 0 THEN 'n/d' ELSE CAST({cell(phase, year)} AS VARCHAR) END"


ALL_TEXT = ["key_value", *TEXT_COLUMNS]
for name, rename in (("bronze_ingest", header), ("clean_columns", str)):
    columns = [f'{padded(c)} AS "{rename(c)}"' for c in ALL_TEXT]
    columns += [f'{amount_text(p, y)} AS "{rename(c)}"' for c, p, y in CELLS]
    ORACLES[name] = on_star(f"SELECT {', '.join(columns)} FROM raw_wide")
ORACLES["bronze_glob"] = ORACLES["bronze_incremental"] = ORACLES["bronze_ingest"]

ORACLES["clean_silver"] = on_star(
    "SELECT "
    + ", ".join(f"upper(trim({c})) AS {c}" for c in ALL_TEXT)
    + ", "
    + ", ".join(f"CASE WHEN ln % 5 <> 0 THEN {dbl(cell(p, y))} END AS {c}" for c, p, y in CELLS)
    + " FROM raw_wide"
)
ORACLES["rejected_values"] = on_star(
    f"""SELECT c AS "column", 'n/d' AS text, count(*) AS n, min({padded('key_value')}) AS first_key, max({padded('key_value')}) AS last_key
    FROM raw_wide, (SELECT unnest([{', '.join(f"'{header(c)}'" for c, _, _ in CELLS)}]) AS c) WHERE ln % 5 = 0 GROUP BY c"""
)
ORACLES["schema_dictionary"] = on_star(
    " UNION ALL ".join(
        [f"SELECT '{c}' AS variable, 'string' AS data_type, count({c}) AS readable FROM raw_wide" for c in ALL_TEXT]
        + [
            f"SELECT '{c}', 'decimal(18,2)', count(CASE WHEN ln % 5 <> 0 THEN {cell(p, y)} END) FROM raw_wide"
            for c, p, y in CELLS
        ]
    )
)
ORACLES["clean_fold_accents"] = on_star(
    "SELECT " + ", ".join(f"lower(trim({c})) AS {c}" for c in ALL_TEXT) + " FROM raw_wide"
)
ORACLES["impute_sector"] = on_star("SELECT key_value, sec_ejec, sector, sector_nombre FROM silver")
ORACLES["unpivot_phases"] = on_star(f"SELECT key_value, anio, fase, {dbl('monto')} AS monto FROM long_rows")
ORACLES["long_row_key"] = on_star(
    f"SELECT {hashed(['key_value', 'CAST(anio AS VARCHAR)', 'fase'])} AS sk_silver_id, {dbl('monto')} AS monto FROM long_rows"
)
ORACLES["union_layers"] = on_star(
    f"SELECT anio, fase, count(*) AS n, {dbl('sum(monto)')} AS total FROM long_rows GROUP BY anio, fase"
)

# --- star ----------------------------------------------------------------------------------------

ORACLES["surrogate_keys"] = on_star(f"SELECT key_value, {KEY_LIST} FROM keyed")
for name in DIMENSIONS:
    ORACLES[f"dim_{name}"] = on_star(f"SELECT * FROM dim_{name}")
ORACLES["fact_presupuesto"] = on_star(f"SELECT {KEY_LIST}, anio, fase, {dbl('monto')} AS monto FROM fact")
ORACLES["fk_orphans"] = on_star(
    " UNION ALL ".join(
        f"""SELECT 'sk_{d}_id' AS key_name,
          (SELECT count(DISTINCT sk_{d}_id) FROM fact) AS fact_keys,
          (SELECT count(*) FROM dim_{d}) AS dim_keys,
          (SELECT count(DISTINCT sk_{d}_id) FROM fact WHERE sk_{d}_id NOT IN (SELECT sk_{d}_id FROM dim_{d})) AS orphan_keys,
          (SELECT count(*) FROM fact WHERE sk_{d}_id NOT IN (SELECT sk_{d}_id FROM dim_{d})) AS orphan_rows"""
        for d in DIMENSIONS
    )
)
ORACLES["parquet_round_trip"] = on_star(
    f"SELECT anio, fase, count(*) AS n, {dbl('sum(monto)')} AS total FROM fact GROUP BY anio, fase"
)
ORACLES["register_star"] = on_star(
    f"""SELECT departamento_ejecutora_nombre AS department, fase, count(*) AS n, {dbl('sum(monto)')} AS total
    FROM fact JOIN dim_geografia USING ({GEO}) GROUP BY 1, 2"""
)

# --- predicates and measures ---------------------------------------------------------------------

FLAT = f"""flat AS (
  SELECT f.*, g.departamento_ejecutora_nombre AS department, i.sector_nombre AS sector,
    i.nivel_gobierno_nombre AS level, i.ejecutora_nombre AS unit,
    p.programa_ppto_nombre AS program, p.producto_proyecto_nombre AS project, p.producto_proyecto AS project_code,
    p.funcion_nombre AS funcion, e.generica_nombre AS generica, e.subgenerica AS line, fi.fuente_financiamiento_nombre AS source
  FROM fact f
  LEFT JOIN dim_geografia g USING ({GEO})
  LEFT JOIN dim_institucion i USING ({INST})
  LEFT JOIN dim_programatica p USING ({PROG})
  LEFT JOIN dim_economica e USING ({ECON})
  LEFT JOIN dim_financiamiento fi USING ({FIN})
)"""
OPEN = f"open_flat AS (SELECT * FROM flat WHERE anio <= {CUTOFF})"


def on_flat(body: str, *ctes: str) -> str:
    return on_star(body, FLAT, OPEN, *ctes)


ORACLES["guard_year"] = on_star(
    f"""SELECT anio, fase, count(*) AS n, {dbl('sum(monto)')} AS total
    FROM fact WHERE anio <= {CUTOFF} GROUP BY anio, fase"""
)


def kpi_line(scenario: str, condition: str) -> str:
    p, d = f"coalesce({PIM}, 0)", f"coalesce({DEV}, 0)"
    return f"""SELECT '{scenario}' AS scenario, {dbl(p)} AS pim, {dbl(d)} AS devengado,
      {rate(d, p)} AS execution_rate, {dbl(f'greatest({p} - {d}, 0)')} AS unexecuted_gap
      FROM open_flat WHERE {condition}"""


ORACLES["kpis"] = on_flat(f"SELECT * EXCLUDE (scenario) FROM ({kpi_line('x', 'true')})")
ORACLES["filtered_kpis"] = on_flat(
    " UNION ALL ".join(
        [
            kpi_line("level and department", f"anio = {YEAR} AND level = 'F' AND department = 'ASIA'"),
            kpi_line("sector as text year", f"anio = {YEAR} AND sector = 'NATION_3'"),
            kpi_line("blocked year", "anio = 2001"),
            kpi_line("no such department", "department = 'NOWHERE'"),
        ]
    )
)
ORACLES["ilike_filter"] = on_flat(
    f"""SELECT project AS label, {dbl(PIM)} AS pim, {dbl(DEV)} AS devengado
    FROM open_flat WHERE project ILIKE '%widget%' GROUP BY project"""
)
ORACLES["phase_totals"] = on_flat(f"SELECT {dbl(PIM)} AS pim, {dbl(DEV)} AS devengado FROM open_flat")
_PIA = "sum(CASE WHEN fase = 'pia' THEN monto ELSE 0 END)"
_GIR = "sum(CASE WHEN fase = 'girado' THEN monto ELSE 0 END)"
ORACLES["execution_rate"] = on_flat(
    f"""SELECT anio, line, {rate(_GIR, _PIA)} AS rate_or_zero,
      {dbl(_GIR)} / nullif({dbl(_PIA)}, 0) * 100.0 AS rate_or_null
    FROM open_flat GROUP BY anio, line"""
)
ORACLES["join_pruning"] = on_flat(
    f"""SELECT anio, {dbl(PIM)} AS pim, {dbl(DEV)} AS devengado
    FROM open_flat WHERE department = 'ASIA' GROUP BY anio"""
)
_LABEL = """CASE
  WHEN abs(a) >= 1000000000000 THEN 'S/. ' || format('{:,.2f}', CAST(round(a * 0.000000000001, 2) AS DOUBLE)) || ' T'
  WHEN abs(a) >= 1000000000 THEN 'S/. ' || format('{:,.2f}', CAST(round(a * 0.000000001, 2) AS DOUBLE)) || ' B'
  WHEN abs(a) >= 1000000 THEN 'S/. ' || format('{:,.2f}', CAST(round(a * 0.000001, 2) AS DOUBLE)) || ' M'
  ELSE 'S/. ' || format('{:,.2f}', CAST(a AS DOUBLE)) END"""
ORACLES["currency_label"] = on_flat(
    f"""SELECT kind, name, {dbl('a')} AS amount, {_LABEL} AS label FROM (
      SELECT 'total' AS kind, sector AS name, CAST({PIM} AS DECIMAL(24,2)) AS a FROM open_flat GROUP BY sector
      UNION ALL
      SELECT 'largest', sector, CAST(max(monto) AS DECIMAL(24,2)) FROM open_flat GROUP BY sector)"""
)
ORACLES["execution_tier"] = on_flat(
    f"""SELECT anio, name, r AS rate,
      CASE WHEN r >= 75 THEN 'success' WHEN r >= 40 THEN 'warning' ELSE 'danger' END AS tier, r - 75.0 AS target_gap
    FROM (SELECT anio, unit AS name, {rate(_GIR, PIM)} AS r FROM open_flat GROUP BY anio, unit)"""
)
ORACLES["measure_catalog"] = on_flat(
    f"""SELECT 'financing_year-level' AS grain, source AS fuente_financiamiento_nombre, anio,
      n AS monto_count, {dbl('s')} AS monto_sum, {dbl('lo')} AS monto_min, {dbl('hi')} AS monto_max,
      {dbl("CAST(s::DOUBLE / n AS DECIMAL(28,3))")} AS monto_avg,
      {dbl("CAST(dev AS DECIMAL(28,3))")} AS monto_stddev,
      {dbl("CAST(v AS DECIMAL(28,0))")} AS monto_variance, fases
    FROM (SELECT source, anio, count(*) AS n, sum(monto) AS s, min(monto) AS lo, max(monto) AS hi,
        var_samp(monto::DOUBLE) AS v, stddev_samp(monto::DOUBLE) AS dev,
        string_agg(DISTINCT fase, ',' ORDER BY fase) AS fases
      FROM open_flat GROUP BY source, anio)"""
)
ORACLES["grain_aggregate"] = on_flat(
    f"""SELECT 'scalar' AS request, 'scalar' AS grain, CAST(NULL AS VARCHAR) AS sector, CAST(NULL AS VARCHAR) AS anio, {dbl(PIM)} AS pim FROM open_flat
    UNION ALL SELECT 'year', 'year-level', NULL, CAST(anio AS VARCHAR), {dbl(PIM)} FROM open_flat GROUP BY anio
    UNION ALL SELECT 'sector', 'institution-level', sector, NULL, {dbl(PIM)} FROM open_flat GROUP BY sector
    UNION ALL SELECT 'sector by year', 'institution_year-level', sector, CAST(anio AS VARCHAR), {dbl(PIM)} FROM open_flat GROUP BY sector, anio"""
)

# --- dashboard -----------------------------------------------------------------------------------

ORACLES["filter_options"] = on_star(
    f"""SELECT DISTINCT 'years' AS filter, CAST(anio AS VARCHAR) AS value FROM fact WHERE anio <= {CUTOFF}
    UNION ALL SELECT DISTINCT 'government_levels', nivel_gobierno_nombre FROM dim_institucion WHERE nivel_gobierno_nombre IS NOT NULL
    UNION ALL SELECT DISTINCT 'sectors', sector_nombre FROM dim_institucion WHERE sector_nombre IS NOT NULL
    UNION ALL SELECT DISTINCT 'departments', departamento_ejecutora_nombre FROM dim_geografia WHERE departamento_ejecutora_nombre IS NOT NULL"""
)


def coverage(tag: str, condition: str) -> str:
    return f"""SELECT '{tag}' AS years, count(*) AS total_entity_years,
      CAST(sum(CASE WHEN p AND d THEN 1 ELSE 0 END) AS BIGINT) AS complete_entity_years,
      CAST(sum(CASE WHEN p AND d THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS coverage_pct
    FROM (SELECT bool_or(fase = 'pim') AS p, bool_or(fase = 'devengado') AS d
      FROM fact WHERE {condition} GROUP BY {KEY_LIST}, anio)"""


ORACLES["pair_coverage"] = on_star(f"{coverage('all', 'true')} UNION ALL {coverage('reportable', f'anio <= {CUTOFF}')}")


def top_planned(by: str, column: str) -> str:
    return f"""SELECT * FROM (SELECT '{by}' AS by, {column} AS dimension, {dbl(PIM)} AS total_monto
      FROM open_flat WHERE anio = {YEAR} GROUP BY {column} ORDER BY {PIM} DESC NULLS LAST, {column} NULLS LAST LIMIT 10)"""


ORACLES["top_concentrations"] = on_flat(
    top_planned("sector_nombre", "sector") + " UNION ALL " + top_planned("departamento_ejecutora_nombre", "department")
)
ORACLES["programmatic_allocation"] = on_flat(
    " UNION ALL ".join(
        [
            top_planned("programa_ppto_nombre", "program"),
            top_planned("producto_proyecto_nombre", "project"),
            top_planned("funcion_nombre", "funcion"),
        ]
    )
)


def planned(tag: str, column: str, limit: str = "") -> str:
    return f"""SELECT * FROM (SELECT '{tag}' AS breakdown, {column} AS name, {dbl(PIM)} AS amount
      FROM open_flat GROUP BY {column} ORDER BY {PIM} DESC NULLS LAST, {column} NULLS LAST {limit})"""


def both_phases(output: str, column: str, condition: str = "true", tag: str = "") -> str:
    return f"""SELECT {tag}{column} AS {output}, {dbl(PIM)} AS pim, {dbl(DEV)} AS devengado
      FROM open_flat WHERE {condition} GROUP BY {column}"""


ORACLES["execution_variance"] = on_flat(
    " UNION ALL ".join(
        both_phases("dimension", column, "department = 'ASIA'", f"'{by}' AS by, ")
        for by, column in (
            ("sector_nombre", "sector"),
            ("departamento_ejecutora_nombre", "department"),
            ("nivel_gobierno_nombre", "level"),
        )
    )
)
ORACLES["variance_top10"] = on_flat(
    f"""SELECT coalesce(dimension, 'Unspecified') AS dimension, pim, devengado
    FROM ({both_phases('dimension', 'sector')}) ORDER BY pim DESC, 1 LIMIT 10"""
)
_HEAT = f"""SELECT department, anio AS fiscal_year, {dbl(PIM)} AS pim, {dbl(DEV)} AS devengado,
  {rate(DEV, PIM)} AS execution_rate FROM open_flat GROUP BY department, anio"""
ORACLES["geographic_heatmap"] = on_flat(_HEAT)
ORACLES["heatmap_matrix"] = on_flat(
    "SELECT coalesce(department, 'Unspecified') AS department, "
    + ", ".join(f"coalesce(max(CASE WHEN fiscal_year = {y} THEN execution_rate END), 0.0) AS y{y}" for y in YEARS if y <= CUTOFF)
    + f" FROM ({_HEAT}) GROUP BY 1"
)
ORACLES["economic_composition"] = on_flat(both_phases("economic_category", "generica", f"anio = {YEAR}"))
ORACLES["financing_structure"] = on_flat(both_phases("financing_source", "source", f"anio = {YEAR} AND level = 'O'"))

# --- reports and worked questions ----------------------------------------------------------------

_SPENT = f"anio = {YEAR} AND fase = 'devengado'"
ORACLES["report_top_departments"] = on_flat(
    f"""SELECT department, {billions('t')} AS billion_soles, {percent('t', 'sum(t) OVER ()')} AS percentage_of_national_total
    FROM (SELECT department, sum(monto) AS t FROM open_flat
      WHERE {_SPENT} AND trim(coalesce(department, '')) <> '' GROUP BY department)
    ORDER BY t DESC, department LIMIT 5"""
)


def growth(table: str) -> str:
    return f"""SELECT anio AS fiscal_year, {billions('t')} AS total_pim_billions,
      coalesce({billions('t - b')}, 0.0) AS net_variance_billions,
      coalesce({percent('(t - b)', 'b')}, '0.0 %') AS yoy_growth_percentage
    FROM (SELECT anio, t, lag(t) OVER (ORDER BY anio) AS b
      FROM (SELECT anio, sum(monto) AS t FROM {table} WHERE fase = 'pim' GROUP BY anio))"""


ORACLES["report_pim_growth"] = on_flat(growth("open_flat"))
ORACLES["report_pim_growth_all_years"] = on_flat(growth("flat"))
ORACLES["report_sector_projects"] = on_flat(
    f"""SELECT sector AS government_sector, format('{{:,}}', count(DISTINCT project_code)) AS estimated_project_count,
      {billions('sum(monto)')} AS expenditure_billions
    FROM open_flat WHERE {_SPENT} AND trim(coalesce(sector, '')) <> ''
    GROUP BY sector ORDER BY sum(monto) DESC, sector LIMIT 5"""
)
_CENTRAL = "sum(CASE WHEN department = 'ASIA' THEN monto ELSE 0 END)"
ORACLES["report_centralization"] = on_flat(
    f"""SELECT sector AS government_sector, {billions('sum(monto)')} AS total_devengado_billions,
      {billions(_CENTRAL)} AS lima_devengado_billions, {percent(_CENTRAL, 'sum(monto)')} AS lima_centralization_rate
    FROM open_flat WHERE {_SPENT} AND trim(coalesce(sector, '')) <> ''
    GROUP BY sector ORDER BY sum(monto) DESC, sector LIMIT 5"""
)
ORACLES["q_total_pim"] = on_flat(f"SELECT {dbl(PIM)} AS total_pim FROM open_flat WHERE anio = {YEAR}")
ORACLES["q_sector_rate"] = on_flat(
    f"SELECT sector, {dbl(DEV)} / nullif({dbl(PIM)}, 0) * 100.0 AS execution_rate FROM open_flat WHERE anio = {YEAR} GROUP BY sector"
)
ORACLES["q_top5_departments"] = on_flat(
    f"""SELECT department, {dbl(PIM)} AS total_pim FROM open_flat WHERE anio = {YEAR}
    GROUP BY department ORDER BY {PIM} DESC, department LIMIT 5"""
)
ORACLES["q_level_compare"] = on_flat(both_phases("government_level", "level", f"anio = {YEAR}"))
ORACLES["q_by_source"] = on_flat(
    f"SELECT source AS financing_source, {dbl(PIM)} AS total_pim FROM open_flat WHERE anio = {YEAR} GROUP BY source"
)
ORACLES["top_project_trend"] = on_flat(
    f"""SELECT w.project AS proyecto, o.anio, {dbl(DEV)} AS gasto_anual, {dbl(PIM)} AS pim_anual
    FROM open_flat o JOIN winner w USING ({PROG}) GROUP BY w.project, o.anio""",
    f"""winner AS (
      SELECT {PROG}, project FROM open_flat
      WHERE level ILIKE '%o%' AND department ILIKE '%amer%'
      GROUP BY {PROG}, project ORDER BY {DEV} DESC NULLS LAST, project NULLS LAST, {PROG} LIMIT 1)""",
)


def top_family(tag: str, column: str) -> str:
    return f"""SELECT * FROM (SELECT '{tag}' AS dimension, {column} AS name, {dbl(PIM)} AS pim
      FROM open_flat GROUP BY {column} ORDER BY {PIM} DESC NULLS LAST, {column} NULLS LAST LIMIT 10)"""


ORACLES["multi_family_union"] = on_flat(top_family("sector", "sector") + " UNION ALL " + top_family("financing_source", "source"))

# --- quality -------------------------------------------------------------------------------------

ORACLES["reconcile_total"] = on_star(
    f"""SELECT {dbl('s')} AS silver_total, {dbl('g')} AS gold_total, {dbl('abs(s - g)')} AS discrepancy, abs(s - g) <= 0.01 AS passed
    FROM (SELECT (SELECT sum(monto) FROM all_cells) AS s, (SELECT sum(monto) FROM fact) AS g)"""
)
ORACLES["volumetrics"] = on_star(
    """SELECT a AS silver_rows, c AS clean_rows, a - c AS dropped_rows, f AS fact_rows, c - f AS unexplained_gap
    FROM (SELECT (SELECT count(*) FROM all_cells) AS a,
      (SELECT count(*) FROM all_cells WHERE monto IS NOT NULL AND monto <> 0) AS c, (SELECT count(*) FROM fact) AS f)"""
)
ORACLES["reconcile_by_year_phase"] = on_star(
    f"""SELECT anio, fase, {dbl('coalesce(s, 0)')} AS monto_silver, {dbl('coalesce(g, 0)')} AS monto_gold,
      {dbl('coalesce(s, 0) - coalesce(g, 0)')} AS diferencia, abs(coalesce(s, 0) - coalesce(g, 0)) > 0.01 AS is_break
    FROM (SELECT anio, fase, sum(monto) AS s FROM all_cells GROUP BY anio, fase HAVING sum(monto) <> 0)
    FULL JOIN (SELECT anio, fase, sum(monto) AS g FROM fact GROUP BY anio, fase) USING (anio, fase)"""
)
ORACLES["key_uniqueness"] = on_star(
    """SELECT count(*) AS total_rows, count(DISTINCT key_value) AS unique_keys,
      count(*) - count(DISTINCT key_value) AS duplicate_rows, count(*) = count(DISTINCT key_value) AS is_unique FROM silver"""
)
ORACLES["duplicate_keys"] = on_star(
    "SELECT key_value, count(*) AS repetitions FROM silver GROUP BY key_value HAVING count(*) > 1"
)
_WIDE = (
    "wide_cells AS (SELECT key_value, "
    + ", ".join(TEXT_COLUMNS)
    + ", "
    + ", ".join(f"{cell(p, y)} AS {c}" for c, p, y in CELLS)
    + " FROM silver)"
)
_COLUMNS = sorted([*TEXT_COLUMNS, *[c for c, _, _ in CELLS]])
_DIFFERS = ", ".join(
    f"CASE WHEN count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END > 1 THEN '{c}' END" for c in _COLUMNS
)
ORACLES["duplicate_key_diff"] = on_star(
    """SELECT key_value, repetitions, len(names) AS n_columns, array_to_string(names, ',') AS differing_columns
    FROM (SELECT key_value, repetitions, list_filter(names, lambda x: x IS NOT NULL) AS names FROM differing)""",
    _WIDE,
    f"differing AS (SELECT key_value, count(*) AS repetitions, [{_DIFFERS}] AS names FROM wide_cells GROUP BY key_value HAVING count(*) > 1)",
)
ORACLES["duplicate_key_amounts"] = on_star(
    f"""SELECT key_value, fase || '_' || anio AS column_name, {dbl('sum(monto)')} AS total
    FROM all_cells WHERE key_value IN (SELECT key_value FROM silver GROUP BY key_value HAVING count(*) > 1)
    GROUP BY key_value, fase, anio HAVING sum(monto) > 0"""
)


def audit_lines() -> list[str]:
    lines = ["SELECT 'fact_presupuesto' AS table_name, 'rows' AS item, '*' AS name, CAST(count(*) AS VARCHAR) AS value FROM fact"]
    kinds = {"anio": "int", "fase": "string", "monto": "decimal(18,2)"}
    tables = {"fact_presupuesto": (KEYS + ["monto", "fase", "anio"], "fact")}
    for d, (columns, _) in DIMENSIONS.items():
        tables[f"dim_{d}"] = ([f"sk_{d}_id", *columns], f"dim_{d}")
        lines.append(f"SELECT 'dim_{d}', 'rows', '*', CAST(count(*) AS VARCHAR) FROM dim_{d}")
    for table, (columns, cte) in tables.items():
        for c in columns:
            kind = "bigint" if c.startswith("sk_") else kinds.get(c, "string")
            lines.append(f"SELECT '{table}', 'column', '{c}', '{kind}'")
            if c.startswith("sk_"):
                lines.append(f"SELECT '{table}', 'distinct', '{c}', CAST(count(DISTINCT {c}) AS VARCHAR) FROM {cte}")
    # As text in column order, NULL as ~; the first ten by md5.
    tables["fact_presupuesto"] = ([*KEYS, "anio", "fase", "monto"], "fact")
    for table, (columns, cte) in tables.items():
        row = f"concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)})"
        lines.append(f"SELECT * FROM (SELECT '{table}', 'preview', '*', v FROM (SELECT {row} AS v FROM {cte}) ORDER BY md5(v), v LIMIT 10)")
    return lines


ORACLES["table_audit"] = on_star(" UNION ALL ".join(audit_lines()))
ORACLES["run_drift"] = on_star(
    " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, count(*) AS rows_a, count(*) AS rows_b, {total} AS total_a, {total} AS total_b,
        true AS same_schema, true AS same_rows, true AS same_total, true AS same_content, true AS passed FROM {cte}"""
        for table, cte, total in [("fact_presupuesto", "fact", dbl("sum(monto)"))]
        + [(f"dim_{d}", f"dim_{d}", dbl("NULL")) for d in DIMENSIONS]
    )
)
UNITS, PROGRAMS = ([f"sk_{d}_id", *DIMENSIONS[d][0]] for d in ("institucion", "programatica"))


def row_text(columns: list[str]) -> str:
    return f"concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)})"


ORACLES["drift_rows"] = on_star(f"""SELECT 'dim_institucion' AS table_name, side, {row_text(UNITS)} AS row, 1 AS n FROM (
    SELECT 'first' AS side, * FROM (SELECT * FROM dim_institucion ORDER BY sk_institucion_id LIMIT 3)
    UNION ALL SELECT 'second', * REPLACE (ejecutora_nombre || '*' AS ejecutora_nombre) FROM (SELECT * FROM dim_institucion ORDER BY sk_institucion_id LIMIT 3)
  ) UNION ALL SELECT 'dim_programatica', 'first', {row_text(PROGRAMS)}, 1 FROM (SELECT * FROM dim_programatica ORDER BY sk_programatica_id LIMIT 2)""")
ORACLES["fact_year_range"] = on_star("SELECT min(anio) AS first_year, max(anio) AS last_year FROM fact")


def rates(table: str) -> str:
    p, d = f"coalesce({PIM}, 0)", f"coalesce({DEV}, 0)"
    columns = f"""{dbl(p)} AS pim, {dbl(d)} AS devengado,
      CASE WHEN {p} <> 0 THEN round({dbl(d)} / {dbl(p)} * 100.0, 2) END AS execution_rate_pct"""
    return f"""SELECT 'global' AS scope, {columns} FROM {table}
      UNION ALL SELECT CAST(anio AS VARCHAR), {columns} FROM {table} GROUP BY anio"""


def shares(table: str, geography: str) -> str:
    return f"""SELECT department, {dbl('t')} AS pim, round({dbl('t')} / {dbl('sum(t) OVER ()')} * 100.0, 2) AS share_pct
      FROM (SELECT departamento_ejecutora_nombre AS department, sum(monto) AS t
        FROM {table} JOIN {geography} USING ({GEO})
        WHERE fase = 'pim' AND departamento_ejecutora_nombre IS NOT NULL GROUP BY 1)"""


ORACLES["execution_rates"] = on_star(rates("fact"))
ORACLES["region_pim_share"] = on_star(shares("fact", "dim_geografia"))

# --- sampling ------------------------------------------------------------------------------------

_ORDER = "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS) + "))"
_SIZES = f"""sizes AS (
  SELECT {KEY_LIST}, count(*) AS n_facts, {_ORDER} AS order_key FROM fact WHERE anio IN {SAMPLE_YEARS} GROUP BY {KEY_LIST})"""
_PICK = (
    _SIZES,
    "numbered AS (SELECT *, row_number() OVER (ORDER BY order_key) AS pos FROM sizes)",
    "running AS (SELECT pos, n_facts, sum(n_facts) OVER (ORDER BY pos) AS upto FROM numbered)",
    f"cut AS (SELECT coalesce(min(pos), (SELECT max(pos) + 1 FROM numbered)) AS k FROM running WHERE upto > {TARGET})",
    f"""steps AS (
      SELECT (SELECT k FROM cut) - 1 AS pos,
        CAST({TARGET} - coalesce((SELECT max(upto) FROM running WHERE pos < (SELECT k FROM cut)), 0) AS BIGINT) AS room, false AS tail
      UNION ALL
      SELECT x.pos, x.room - x.n_facts, true FROM (
        SELECT numbered.pos, steps.room, numbered.n_facts, row_number() OVER (ORDER BY numbered.pos) AS rn
        FROM steps JOIN numbered ON numbered.pos > steps.pos AND numbered.n_facts <= steps.room) x
      WHERE x.rn = 1)""",
    """picked AS (SELECT * FROM numbered WHERE pos IN (
      SELECT pos FROM running WHERE pos < (SELECT k FROM cut) UNION ALL SELECT pos FROM steps WHERE tail))""",
    f"sampled AS (SELECT f.* FROM fact f SEMI JOIN picked USING ({KEY_LIST}) WHERE f.anio IN {SAMPLE_YEARS})",
    *[f"some_{d} AS (SELECT * FROM dim_{d} WHERE sk_{d}_id IN (SELECT sk_{d}_id FROM picked))" for d in DIMENSIONS],
)


def on_sample(body: str, *ctes: str) -> str:
    return on_star(body, *_PICK, *ctes)


ORACLES["entity_sizes"] = on_star("SELECT * FROM sizes", _SIZES)
ORACLES["entity_sample"] = on_sample("SELECT * EXCLUDE (pos) FROM picked")
ORACLES["sample_facts"] = on_sample(f"SELECT {KEY_LIST}, anio, fase, {dbl('monto')} AS monto FROM sampled")
ORACLES["sample_dims"] = on_sample(
    " UNION ALL ".join(
        f"""SELECT 'dim_{d}' AS table_name, sk_{d}_id AS sk,
          concat_ws('|', {', '.join(f"coalesce({c}, '~')" for c in columns)}) AS member FROM some_{d}"""
        for d, (columns, _) in DIMENSIONS.items()
    )
)
ORACLES["sample_integrity"] = on_sample(
    """SELECT (SELECT count(*) FROM picked) AS entities,
      (SELECT CAST(sum(n_facts) AS BIGINT) FROM picked) AS expected_facts,
      (SELECT count(*) FROM sampled) AS observed_facts, CAST(0 AS BIGINT) AS broken_entities"""
)
_GATES = f"""gates AS (
  SELECT 'execution_rate' AS gate, scope, execution_rate_pct AS value,
    coalesce(execution_rate_pct BETWEEN 0 AND 100, false) AS passed FROM ({rates('sampled')})
  UNION ALL SELECT 'row_target', 'rows', {dbl('count(*)')}, abs(count(*) - {TARGET}) <= greatest(1, floor({TARGET} * 0.001)) FROM sampled
  {' '.join(f"UNION ALL SELECT 'null_values', '{c}', {dbl(f'count(*) - count({c})')}, count(*) = count({c}) FROM sampled" for c in [*KEYS, 'anio', 'fase', 'monto'])}
  UNION ALL SELECT 'concentration_note', department, share_pct, true
    FROM (SELECT * FROM ({shares('sampled', 'some_geografia')}) ORDER BY pim DESC, department LIMIT 1) WHERE share_pct > 20.0)"""
ORACLES["sample_gates"] = on_sample("SELECT * FROM gates", _GATES)
ORACLES["sample_manifest"] = on_sample(
    f"""SELECT CAST({TARGET} AS BIGINT) AS target_rows, '1997,1998,1999,2000' AS years,
      (SELECT count(*) FROM sampled) AS fact_rows, (SELECT count(*) FROM picked) AS entities,
      {', '.join(f'(SELECT count(*) FROM some_{d}) AS dim_{d}_rows' for d in DIMENSIONS)},
      (SELECT execution_rate_pct FROM ({rates('sampled')}) WHERE scope = 'global') AS execution_rate_pct,
      (SELECT department FROM ({shares('sampled', 'some_geografia')}) ORDER BY pim DESC, department LIMIT 1) AS top_department,
      (SELECT bool_and(passed) FROM gates) AS gates_passed,
      coalesce((SELECT string_agg(gate || ':' || scope, ',' ORDER BY gate || ':' || scope) FROM gates WHERE NOT passed), '') AS failed_gates""",
    _GATES,
)
_FACT_TEXT = ", ".join(f"CAST({c} AS VARCHAR)" for c in [*KEYS, "anio", "fase", "monto"])
ORACLES["star_flat_sample"] = on_star(
    f"""SELECT anio, fase, {dbl('monto')} AS monto, {', '.join(TEXT_COLUMNS)} FROM chosen
    LEFT JOIN dim_geografia USING ({GEO}) LEFT JOIN dim_institucion USING ({INST}) LEFT JOIN dim_programatica USING ({PROG})
    LEFT JOIN dim_economica USING ({ECON}) LEFT JOIN dim_financiamiento USING ({FIN})""",
    f"chosen AS (SELECT * FROM fact ORDER BY md5(concat_ws('|', {_FACT_TEXT})), {KEY_LIST}, anio, fase, monto LIMIT 500)",
)

# --- question and log jobs: computed from the columns the texts are made of ------------------------

_SPLIT = (
    "WARNING: This question spans multiple dimension families. You MUST decompose it into separate sub-queries "
    "connected via CTEs (WITH ... AS (...)). Do NOT group by columns from different dimension families in a single SELECT."
)
_ONE = "GROUP BY must stay within one dimension family plus optionally year."
ORACLES["tag_question_grain"] = f"""WITH asked AS (
  SELECT o_orderkey AS question_id, o_orderkey % 3 = 0 AS has_year,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'geography-level' WHEN '2-HIGH' THEN 'institution-level'
      WHEN '3-MEDIUM' THEN 'program-level' WHEN '4-NOT SPECIFIED' THEN 'financing-level' END AS a,
    CASE o_orderstatus WHEN 'O' THEN 'project-level' WHEN 'P' THEN 'economic-level' END AS b FROM orders),
counted AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n, coalesce(a, b) AS family FROM asked),
graded AS (SELECT *, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN family WHEN has_year THEN 'year-level' ELSE 'scalar' END AS primary_grain,
  concat_ws(',', CASE WHEN a < b THEN a ELSE b END, CASE WHEN a < b THEN b ELSE a END, CASE WHEN has_year THEN 'year-level' END) AS found FROM counted),
composed AS (SELECT *, CASE WHEN n = 1 AND has_year THEN replace(primary_grain, '-level', '_year-level') ELSE primary_grain END AS composite_grain FROM graded)
SELECT question_id, CASE WHEN coalesce(found, '') = '' THEN 'scalar' ELSE found END AS detected_grains, primary_grain, composite_grain, has_year,
  n <= 1 AS is_valid, n > 1 AS needs_decomposition,
  CASE WHEN n > 1 THEN '{_SPLIT}' WHEN primary_grain = 'scalar' THEN 'Aggregate all rows without GROUP BY.'
    ELSE 'Analytical grain: ' || composite_grain || '. {_ONE}' END AS "constraint"
FROM composed"""
_FORM = "doc_id % 6"
ORACLES["audit_query_log"] = f"""SELECT doc_id AS query_id, CASE WHEN {_FORM} = 3 THEN 2 ELSE 1 END AS statements,
  CASE {_FORM} WHEN 2 THEN 'DELETE' WHEN 3 THEN 'DROP' WHEN 5 THEN 'UPDATE' ELSE '' END AS forbidden_words,
  {_FORM} IN (0, 1, 4) AS is_accepted,
  CASE {_FORM} WHEN 2 THEN 'not_select' WHEN 3 THEN 'not_single_statement' WHEN 5 THEN 'forbidden_keyword' ELSE 'accepted' END AS verdict
FROM documents"""
ORACLES["trace_group_fields"] = f"""SELECT doc_id AS query_id, CASE {_FORM} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_fields,
  CASE {_FORM} WHEN 0 THEN lang WHEN 1 THEN '`' || source || '`|date_trunc(''y'', d)' WHEN 4 THEN source ELSE '' END AS group_fields
FROM documents"""

_STAGES = """stages AS (
  SELECT 'INTENT_PARSING' AS stage, false AS failed, CAST(1 AS DECIMAL(14,2)) AS ms FROM events
  UNION ALL
  SELECT CASE event_type WHEN 'view' THEN 'SEMANTIC_VALIDATION' WHEN 'click' THEN 'SQL_EXECUTION'
      WHEN 'purchase' THEN 'RESULT_TRANSFORMATION' WHEN 'signup' THEN 'SQL_GENERATION' WHEN 'error' THEN 'SQL_EXECUTION'
      ELSE 'USER_INPUT' END, event_type = 'error', CAST(value AS DECIMAL(14,2)) FROM events)"""
ORACLES["trace_stage_stats"] = f"""WITH {_STAGES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM stages)
SELECT stage, count(*) AS runs, count(*) FILTER (WHERE failed) AS failed, {dbl('sum(ms)')} / {dbl('count(ms)')} AS avg_ms,
  {dbl('min(CASE WHEN rn * 100 >= n * 50 THEN ms END)')} AS p50_ms, {dbl('min(CASE WHEN rn * 100 >= n * 95 THEN ms END)')} AS p95_ms,
  {dbl('max(ms)')} AS max_ms
FROM ranked GROUP BY stage"""
# Bands grow with the duration, sixteen to a doubling.
ORACLES["trace_stage_stats_stream"] = f"""SELECT stage, runs, failed, max_ms,
  CAST(floor(log2(p50_ms * 100.0 + 1.0) * 16.0) AS INTEGER) AS p50_band, CAST(floor(log2(p95_ms * 100.0 + 1.0) * 16.0) AS INTEGER) AS p95_band
FROM ({ORACLES['trace_stage_stats']})"""
ORACLES["trace_failures"] = """SELECT failure_type, count(*) AS queries, count(DISTINCT user_id) AS sessions FROM (
  SELECT user_id, CASE WHEN event_type = 'error'
      THEN CASE event_id % 3 WHEN 0 THEN 'SQL_SYNTAX_ERROR' WHEN 1 THEN 'MISSING_GROUP_BY' ELSE 'DATA_JOIN_MISMATCH' END
    WHEN event_id % 4 = 0 THEN 'EMPTY_RESULT_SET' END AS failure_type FROM events)
WHERE failure_type IS NOT NULL GROUP BY failure_type"""

# --- exact forms next to sketches and metadata -----------------------------------------------------

ORACLES["trace_stage_stats_approx"] = f"""SELECT stage, runs, p50_ms, p95_ms, true AS within_tolerance FROM ({ORACLES['trace_stage_stats']})"""
ORACLES["report_sector_projects_approx"] = f"""SELECT government_sector,
  CAST(replace(estimated_project_count, ',', '') AS BIGINT) AS exact, true AS within_tolerance FROM ({ORACLES['report_sector_projects']})"""
_SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ORACLES["layer_storage"] = on_star(
    " UNION ALL ".join(
        [f"SELECT 'source/{t}' AS layer, count(*) AS rows, true AS is_stored FROM {t}" for t in _SOURCES]
        + ["SELECT 'silver', count(*), true FROM raw_wide", "SELECT 'gold/fact_presupuesto', count(*), true FROM fact"]
        + [f"SELECT 'gold/dim_{d}', count(*), true FROM dim_{d}" for d in DIMENSIONS]
    )
)
ORACLES["dashboard_unfiltered"] = on_flat(
    " UNION ALL ".join(
        [planned(f"top {c}", n, "LIMIT 10") for c, n in (("sector_nombre", "sector"), ("departamento_ejecutora_nombre", "department"))]
        + [
            planned(f"variance {c}", n)
            for c, n in (("sector_nombre", "sector"), ("departamento_ejecutora_nombre", "department"), ("nivel_gobierno_nombre", "level"))
        ]
        + [
            planned(f"program {c}", n, "LIMIT 10")
            for c, n in (("programa_ppto_nombre", "program"), ("producto_proyecto_nombre", "project"), ("funcion_nombre", "funcion"))
        ]
        + [planned("economic", "generica"), planned("financing", "source")]
    )
)
