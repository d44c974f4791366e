"""DuckDB CTEs that rebuild every layer from the raw tables, independently of the Spark code.

The long layer is a cross join of records, years and phases with a CASE per phase; no UNPIVOT.
"""

YEARS = tuple(range(1995, 2002))
PHASES = ("pia", "pim", "certificado", "comprometido_anual", "comprometido", "devengado", "girado")


def text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


_SECTOR = "CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN ' ' ELSE {} END"

# Descriptive columns with a source; the others of the gold model are NULL.
SOURCES = {
    "departamento_ejecutora": text("r_regionkey"),
    "departamento_ejecutora_nombre": "r_name",
    "provincia_ejecutora": text("n.n_nationkey"),
    "provincia_ejecutora_nombre": "n.n_name",
    "distrito_ejecutora": "c_mktsegment",
    "distrito_ejecutora_nombre": "c_mktsegment",
    "nivel_gobierno": "o_orderstatus",
    "nivel_gobierno_nombre": "o_orderstatus",
    "sector": _SECTOR.format(text("sn.n_nationkey")),
    "sector_nombre": _SECTOR.format("sn.n_name"),
    "pliego": f"CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE {text('s_suppkey % 20')} END",
    "sec_ejec": text("s_suppkey"),
    "ejecutora_nombre": "s_name",
    "programa_ppto": "p_brand",
    "programa_ppto_nombre": "p_brand",
    "producto_proyecto": text("p_partkey"),
    "producto_proyecto_nombre": "p_name",
    "funcion": "p_type",
    "funcion_nombre": "p_type",
    "meta": text("p_size"),
    "tipo_transaccion": "l_linestatus",
    "generica": "l_returnflag",
    "generica_nombre": "l_returnflag",
    "subgenerica": text("l_linenumber"),
    "fuente_financiamiento": "o_orderpriority",
    "fuente_financiamiento_nombre": "o_orderpriority",
    "rubro": "substr(o_orderpriority, 1, 1)",
}


def _pair(code: str) -> list[str]:
    return [code, code + "_nombre"]


DIMENSIONS = {
    "geografia": (
        _pair("departamento_ejecutora") + _pair("provincia_ejecutora") + _pair("distrito_ejecutora"),
        ["departamento_ejecutora", "provincia_ejecutora", "distrito_ejecutora"],
    ),
    "institucion": (
        _pair("nivel_gobierno") + _pair("sector") + _pair("pliego") + ["sec_ejec"] + _pair("ejecutora"),
        ["nivel_gobierno", "sector", "pliego", "sec_ejec"],
    ),
    "programatica": (
        _pair("programa_ppto")
        + _pair("tipo_act_proy")
        + _pair("producto_proyecto")
        + _pair("actividad_accion_obra")
        + _pair("funcion")
        + _pair("division_funcional")
        + _pair("grupo_funcional")
        + _pair("meta"),
        [
            "programa_ppto",
            "producto_proyecto",
            "actividad_accion_obra",
            "funcion",
            "division_funcional",
            "grupo_funcional",
            "meta",
        ],
    ),
    "economica": (
        ["tipo_transaccion"]
        + _pair("generica")
        + _pair("subgenerica")
        + _pair("subgenerica_det")
        + _pair("especifica")
        + _pair("especifica_det"),
        ["tipo_transaccion", "generica", "subgenerica", "subgenerica_det", "especifica", "especifica_det"],
    ),
    "financiamiento": (
        _pair("fuente_financiamiento") + _pair("rubro") + _pair("tipo_recurso") + _pair("categoria_gasto"),
        ["fuente_financiamiento", "rubro", "tipo_recurso", "categoria_gasto"],
    ),
}
TEXT_COLUMNS = [c for columns, _ in DIMENSIONS.values() for c in columns]
KEYS = [f"sk_{name}_id" for name in DIMENSIONS]
KEY_LIST = ", ".join(KEYS)

PHASE_AMOUNTS = {
    "pia": "CASE WHEN ln % 3 = 0 THEN 0.00 ELSE ext * 0.90 END",
    "pim": "ext",
    "certificado": "CASE WHEN rf = 'N' THEN NULL ELSE ext * (1 - disc) END",
    "comprometido_anual": "ext * (1 - disc)",
    "comprometido": "ext * (1 - disc) * 0.95",
    "devengado": "CASE WHEN ls = 'F' THEN ext * (1 - disc) ELSE ext * (1 - disc) * 0.50 END",
    "girado": "CASE WHEN ls = 'F' THEN ext * (1 - disc) END",
}


def cell(phase: str, year: str | int) -> str:
    share = f"CASE WHEN y0 = {year} THEN 1.00 WHEN y0 + 1 = {year} AND ln % 2 = 1 THEN 0.50 END"
    return f"CAST(CAST({PHASE_AMOUNTS[phase]} AS DECIMAL(18,6)) * {share} AS DECIMAL(18,2))"


def hashed(parts: list[str]) -> str:
    joined = ", ".join(f"coalesce({p}, '~')" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('_', {joined})), 1, 15) AS BIGINT)"


_RAW_TEXT = ",\n    ".join(f"{SOURCES.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in TEXT_COLUMNS)
_DEFAULTS = {"sector": "GL", "sector_nombre": "GOBIERNOS LOCALES (MUNICIPALIDADES)"}


def _cleaned(column: str) -> str:
    value = f"upper(trim({column}))"
    if column in _DEFAULTS:
        value = f"coalesce(nullif({value}, ''), '{_DEFAULTS[column]}')"
    return f"{value} AS {column}"


_CLEAN_TEXT = ",\n    ".join(_cleaned(c) for c in TEXT_COLUMNS)
_KEYS = ",\n    ".join(f"{hashed(codes)} AS sk_{name}_id" for name, (_, codes) in DIMENSIONS.items())
_LONG_AMOUNT = " ".join(f"WHEN '{p}' THEN CAST({a} AS DECIMAL(18,6))" for p, a in PHASE_AMOUNTS.items())
_PHASE_ROWS = ", ".join(f"('{p}')" for p in PHASES)


def _dimension(name: str) -> str:
    columns, codes = DIMENSIONS[name]
    listed = ", ".join(columns)
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return f"""dim_{name} AS (
  SELECT sk_{name}_id, {listed} FROM (
    SELECT *, row_number() OVER (PARTITION BY sk_{name}_id ORDER BY {order}) AS rn
    FROM (SELECT DISTINCT sk_{name}_id, {listed} FROM long_rows WHERE {codes[0]} IS NOT NULL)
  ) WHERE rn = 1
)"""


PREFIX = f"""WITH RECURSIVE raw_wide AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS key_value,
    {_RAW_TEXT},
    l_linenumber AS ln, year(l_shipdate) AS y0, l_linestatus AS ls, l_returnflag AS rf,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS ext, CAST(l_discount AS DECIMAL(4,2)) AS disc
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n.n_nationkey
  JOIN region ON n.n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN part ON l_partkey = p_partkey
),
silver AS (
  SELECT key_value,
    {_CLEAN_TEXT},
    ln, y0, ls, rf, ext, disc
  FROM raw_wide
),
keyed AS (
  SELECT *,
    {_KEYS}
  FROM silver
),
all_cells AS (
  SELECT k.*, CAST(y.anio AS INTEGER) AS anio, p.fase,
    CAST((CASE p.fase {_LONG_AMOUNT} END)
      * CASE WHEN y0 = y.anio THEN 1.00 WHEN y0 + 1 = y.anio AND ln % 2 = 1 THEN 0.50 END AS DECIMAL(18,2)) AS monto
  FROM keyed k
  CROSS JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS anio) y
  CROSS JOIN (VALUES {_PHASE_ROWS}) p(fase)
),
long_rows AS (
  SELECT * FROM all_cells WHERE monto IS NOT NULL AND monto <> 0
),
fact AS (
  SELECT {KEY_LIST}, anio, fase, monto FROM long_rows
),
{",".join(chr(10) + _dimension(n) for n in DIMENSIONS)}
"""


def on_star(body: str, *ctes: str) -> str:
    """A statement over the rebuilt layers, with CTEs of its own before the final SELECT."""
    extra = "".join(f", {c}" for c in ctes)
    return f"{PREFIX}{extra}\n{body.strip()}"
