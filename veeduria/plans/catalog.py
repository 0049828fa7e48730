"""Query catalogue over the driver's tables: Spark plan + DuckDB oracle SQL.

The published thresholds are in pesos and give no rows on the test tables,
so flags here run with calibrated parameters and per-flag role bindings.
Each entry is ``build(ctx) -> DataFrame`` plus the equivalent SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.params import NATURAL_PERSON_PATTERNS, Params
from veeduria.plans import oracle as O
from veeduria.plans.context import Context
from veeduria.sources.bindings import Binding

# Calibration for the driver tables: order priority plays the procurement
# modality (urgent and high = awarded without competition), part type PROMO
# plays a service contract, part names with 'old' or 'gizmo' play vague
# objects.
TEST = Params(
    non_competitive=("1-URGENT", "2-HIGH"),
    natural_person=NATURAL_PERSON_PATTERNS,
    service=("PROMO",),
    vague=("%old%", "%gizmo%"),
    f01_min_contracts=5, f01_min_value=0,
    f02_factor=10, f02_min_value=0,
    f03_min_months=4, f03_min_contracts=5, f03_min_z=2.5,
    f04_min_hhi=0.5, f04_min_contracts=3, f04_min_value=0,
    f06_min_entities=12, f06_min_contracts=15,
    f08_min_contracts=5, f08_min_value=0, f08_min_share=0.8,
    f09_min_value=80_000,
    f10_min_days=1800, f10_min_value=60_000,
)

NATION_SUPPLIER = Binding("nation", "supplier")
CUSTOMER_SUPPLIER = Binding("customer", "supplier")
NATION_CUSTOMER = Binding("nation", "customer")
DEFAULT = NATION_SUPPLIER

FLAG_BINDING = {
    "F01": NATION_SUPPLIER, "F02": NATION_CUSTOMER, "F03": CUSTOMER_SUPPLIER,
    "F04": CUSTOMER_SUPPLIER, "F06": NATION_SUPPLIER, "F08": CUSTOMER_SUPPLIER,
    "F09": NATION_SUPPLIER, "F10": NATION_SUPPLIER,
}
ALL_BINDINGS = [NATION_SUPPLIER, CUSTOMER_SUPPLIER, NATION_CUSTOMER]


def present(df: DataFrame) -> DataFrame:
    """Output projection shared with the oracle: exact decimals become
    DOUBLE, dates and timestamps ISO text, arrays sorted comma-joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.sort_array(c), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


@dataclass
class Entry:
    name: str
    build: Callable[[Context], DataFrame]
    sql: str | None
    doc: str = ""


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        CATALOG[name] = Entry(name, fn, sql, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def with_ctes(body: str, bindings=(DEFAULT,), extra: str = "") -> str:
    """Wrap a SELECT with the contract CTEs of ``bindings``."""
    parts = O.ctes(list(bindings), TEST)
    if extra:
        parts += ",\n" + extra
    return f"WITH {parts}\n{body}"


# ------------------------------------------------------------------ flags --
from veeduria.operators import flags as FL  # noqa: E402

ALERT_SQL_COLS = ("codigo, bandera, nivel, nombre_entidad, nit_entidad, proveedor, documento_proveedor, "
                  "id_contrato, anio, detalle, CAST(valor_cop AS DOUBLE) AS valor_cop, severidad")


def flag_df(ctx: Context, code: str) -> DataFrame:
    b = FLAG_BINDING[code]
    return FL.REGISTRY[code].build(ctx.contracts(b, TEST), TEST)


def alerts_df(ctx: Context) -> DataFrame:
    """Alert table, each flag on its calibrated binding, all of them from
    one written star join. In a materialising context it is written once (partitioned by flag) and every
    score and report reads the written table."""
    key = ("alerts",)
    if key not in ctx._cache:
        ctx.keep(payments=False)
        a = FL.union_alerts([flag_df(ctx, k) for k in FL.REGISTRY])
        if ctx.materialize:
            a = ctx.write_table(a, "alerts", partition_by="codigo")
        ctx._cache[key] = a
    return ctx._cache[key]


def alerts_sql_body() -> str:
    return "\nUNION ALL\n".join(
        f"({O.flag_sql(k, O.cte_name(FLAG_BINDING[k]), TEST)})" for k in FL.REGISTRY)


def alerts_cte() -> str:
    """CTE list defining ``alertas`` (contract CTEs of all bindings first)."""
    return O.ctes(ALL_BINDINGS, TEST) + f",\nalertas AS ({alerts_sql_body()})"


def with_alerts(body: str, bindings=()) -> str:
    return f"WITH {alerts_cte()}\n{body}"


_FLAG_QUERY_NAMES = {"F01": "f01_split", "F02": "f02_jump", "F03": "f03_spike", "F04": "f04_hhi",
                     "F06": "f06_octopus", "F08": "f08_dominance", "F09": "f09_vague",
                     "F10": "f10_extension"}

for _code, _qname in _FLAG_QUERY_NAMES.items():
    _b = FLAG_BINDING[_code]
    register(_qname, with_ctes(f"SELECT {ALERT_SQL_COLS} FROM ({O.flag_sql(_code, O.cte_name(_b), TEST)})", [_b]),
             f"{_code} {FL.REGISTRY[_code].name}")(lambda ctx, _c=_code: flag_df(ctx, _c))


@register("r01_alerts", with_alerts(f"SELECT {ALERT_SQL_COLS} FROM alertas"))
def r01_alerts(ctx: Context) -> DataFrame:
    """R1/U1 union of the eight flags."""
    return alerts_df(ctx)


@register("r01_alerts_shared", with_ctes(
    "SELECT " + ALERT_SQL_COLS + " FROM (" + "\nUNION ALL\n".join(
        f"({O.flag_sql(k, O.cte_name(DEFAULT), TEST)})" for k in FL.REGISTRY) + ")"))
def r01_alerts_shared(ctx: Context) -> DataFrame:
    """R1 on one binding with shared aggregates (X1): one shuffle feeds five flags."""
    ctx.keep(payments=False)
    return FL.run_flags_shared(ctx.contracts(DEFAULT, TEST), TEST)
