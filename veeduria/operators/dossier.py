"""Evidence dossiers (R27): top alerts with their largest contracts.

The per-alert loop of look-up queries becomes one plan with one scan of the
contracts: the top-N alerts get a key shape (which of buyer / supplier / year
they fix) and are listed per key, so a contract row meets at most one list
per shape, through one left join on typed columns for each shape that the
flags asked for can have. Only rows with a match are exploded. Where every
shape fixes the year, the alerts' years are joined first, and prune the
partitions of a table kept by year. The lists are broadcast up to
``BROADCAST_ALERTS`` alerts; beyond, AQE decides. The ``row_number() <= k``
filter is planned with a partial per-task group limit before the shuffle, so
even an alert covering a third of all contracts moves only k rows per task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.functions.fmt import millions
from veeduria.functions.text import one_line
from veeduria.operators.derive import is_service, is_vague
from veeduria.params import FLAG_NAMES, Params
from veeduria.session import reuse

ROW_FLAGS = ("F09", "F10")

ALERT_ORDER = ("severidad DESC", "valor_cop DESC", "codigo", "nit_entidad", "documento_proveedor",
               "id_contrato", "anio", "detalle")


def alert_order() -> list[Column]:
    return [F.desc("severidad"), F.desc("valor_cop"), F.asc("codigo"), F.asc_nulls_last("nit_entidad"),
            F.asc_nulls_last("documento_proveedor"), F.asc_nulls_last("id_contrato"),
            F.asc_nulls_last("anio"), F.asc_nulls_last("detalle")]


def top_alerts(a: DataFrame, n: int = 15, per_flag: int | None = None) -> DataFrame:
    """Top-N alerts by severity then value, numbered 1..N. With ``per_flag``
    the top k of every flag instead (M18 option)."""
    if per_flag:
        w = Window.partitionBy("codigo").orderBy(*alert_order())
        t = a.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_flag).drop("_k")
    else:
        t = a.orderBy(*alert_order()).limit(n)
    # numbering runs over the already limited frame (N rows)
    return t.withColumn("rank", F.row_number().over(Window.orderBy(*alert_order())))


def top_bound(n: int, per_flag: int | None = None) -> int:
    """Largest number of rows ``top_alerts`` gives."""
    return per_flag * len(FLAG_NAMES) if per_flag else n


# key columns per shape
SHAPES = {1: ("nit_entidad", "documento_proveedor", "anio"), 2: ("documento_proveedor", "anio"),
          3: ("nit_entidad", "anio"), 4: ("nit_entidad", "documento_proveedor"), 5: ("documento_proveedor",),
          6: ("nit_entidad",), 7: ("nit_entidad", "mes"), 8: ("id_contrato",)}
BROADCAST_ALERTS = 100_000
MONTH_IN_DETAIL = "firmados en ([0-9]{4}-[0-9]{2}) "     # F03 names its month in the detail only


def _shapes_of(codes: list[str], mode: str) -> list[int]:
    """Shapes the alerts of these flags can have."""
    out = set()
    for code in codes:
        if mode == "exact" and code == "F03":
            out.add(7)
        elif mode == "exact" and code in ROW_FLAGS:
            out.add(8)
        elif mode == "keys" and code == "F06":
            out |= {4, 5, 6}
        else:
            out |= {1, 2, 3}
    return sorted(out)


def _exact(p: Params) -> Column:
    """Replay of each flag's row predicate (evidence='exact')."""
    v = F.col("valor_del_contrato")
    code = F.col("codigo")
    return ((code != "F01") | F.col("es_sin_competencia")) \
        & ((code != "F06") | (F.col("es_persona_natural") & is_service(p))) \
        & ((code != "F09") | (is_vague(p) & (v > F.lit(p.f09_min_value)))) \
        & ((code != "F10") | ((F.col("dias_adicionados") >= p.f10_min_days) & (v > F.lit(p.f10_min_value))))


def evidence(c: DataFrame, top: DataFrame, per_alert: int = 10, mode: str = "keys",
             p: Params = Params(), codes: list[str] | None = None, object_chars: int | None = 160,
             top_rows: int | None = None) -> DataFrame:
    """One row per (alert, evidence contract), at most ``per_alert`` largest
    contracts per alert. ``mode='keys'`` re-selects by the alert's keys and
    year (F06 without year), as published; ``mode='exact'`` selects the rows
    that raised the alert: F06 by year too, F03 by the month of the spike,
    F09 and F10 by contract id, and it replays the flag's own predicate.
    ``codes``: flags among ``top`` (default all). ``object_chars``: length of
    the object text shown; None shows all of it. ``top_rows``: bound of the
    number of alerts in ``top``, where known; it decides on the broadcast."""
    codes = sorted(FLAG_NAMES) if codes is None else codes
    cc = c.select("id_contrato", "proceso_de_compra", "fecha_de_firma", "nit_entidad", "documento_proveedor", "anio",
                  "nombre_entidad", "proveedor_adjudicado", "modalidad_de_contratacion", "valor_del_contrato",
                  "dias_adicionados", "objeto_del_contrato", "es_sin_competencia", "es_persona_natural",
                  "tipo_de_contrato", F.date_format("fecha_de_firma", "yyyy-MM").alias("mes"))
    t = (top.where(F.col("codigo").isin(codes))
            .select("rank", "codigo", "nit_entidad", "documento_proveedor", "anio", "id_contrato",
                    F.nullif(F.regexp_extract("detalle", MONTH_IN_DETAIL, 1), F.lit("")).alias("mes")))
    nit, doc = F.col("nit_entidad").isNotNull(), F.col("documento_proveedor").isNotNull()
    f06 = F.col("codigo") == "F06" if mode == "keys" else F.lit(False)
    own = [(7, F.col("codigo") == "F03"), (8, F.col("codigo").isin(*ROW_FLAGS))] if mode == "exact" else []
    t = t.withColumn("shape", functools.reduce(
        lambda acc, kv: acc.when(kv[1], F.lit(kv[0])),
        [*own, (1, nit & doc & ~f06), (2, ~nit & doc & ~f06), (3, nit & ~doc & ~f06),
         (4, nit & doc & f06), (5, ~nit & doc & f06), (6, nit & ~doc & f06)], F))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if top_rows is not None and top_rows <= BROADCAST_ALERTS else df
    shapes = _shapes_of(codes, mode)
    if all({"anio", "mes"} & set(SHAPES[k]) for k in shapes):
        year = F.coalesce(F.substring("mes", 1, 4).try_cast("int"), F.col("anio"))
        cc = cc.join(side(t.select(year.alias("_anio")).distinct()), F.col("anio") == F.col("_anio"), "left_semi")
    for k in shapes:
        listed = (t.where(F.col("shape") == k).groupBy(*[F.col(x).alias(f"_{x}") for x in SHAPES[k]])
                   .agg(F.collect_list(F.struct("rank", "codigo")).alias(f"_hits{k}")))
        on = functools.reduce(Column.__and__, [F.col(x) == F.col(f"_{x}") for x in SHAPES[k]])
        cc = cc.join(side(listed), on, "left").drop(*[f"_{x}" for x in SHAPES[k]])
    hits = [f"_hits{k}" for k in shapes]
    found = F.concat(*[F.coalesce(h, F.array().cast("array<struct<rank:int,codigo:string>>")) for h in hits])
    j = (cc.where(functools.reduce(Column.__or__, [F.col(h).isNotNull() for h in hits]))
           .select("*", F.explode(found).alias("_hit")).select("*", "_hit.rank", "_hit.codigo").drop("_hit", *hits))
    if mode == "exact":
        j = j.where(_exact(p))
    w = Window.partitionBy("rank").orderBy(F.desc("valor_del_contrato"), F.asc("id_contrato"),
                                           F.asc("proceso_de_compra"), F.asc("fecha_de_firma"),
                                           F.asc_nulls_last("objeto_del_contrato"))
    j = j.withColumn("ev_rank", F.row_number().over(w)).where(F.col("ev_rank") <= per_alert)
    return j.select("rank", "ev_rank", "id_contrato", "proceso_de_compra",
                    F.to_date("fecha_de_firma").alias("firma"), "nombre_entidad", "proveedor_adjudicado",
                    F.col("modalidad_de_contratacion").alias("modalidad"),
                    millions("valor_del_contrato").alias("millones"), "dias_adicionados",
                    (one_line("objeto_del_contrato") if object_chars is None
                     else F.substring(one_line("objeto_del_contrato"), 1, object_chars)).alias("objeto"))


def dossiers(c: DataFrame, a: DataFrame, n: int = 15, per_alert: int = 10, mode: str = "keys",
             p: Params = Params(), per_flag: int | None = None) -> DataFrame:
    """Flat dossier rows: alert columns + evidence columns."""
    top = reuse(top_alerts(a, n, per_flag))     # a bounded table; the flags run once
    ev = evidence(c, top, per_alert, mode, p, top_rows=top_bound(n, per_flag))
    head = top.select("rank", "codigo", "bandera", F.col("nombre_entidad").alias("a_entidad"),
                      F.col("proveedor").alias("a_proveedor"), F.col("anio").alias("a_anio"), "detalle",
                      "valor_cop", "severidad")
    return head.join(ev, "rank")


def dossiers_nested(c: DataFrame, a: DataFrame, **kw) -> DataFrame:
    """One row per alert with an ``array<struct>`` of its evidence (bounded
    by ``per_alert``), ready for a JSON or Parquet sink (S13)."""
    flat = dossiers(c, a, **kw)
    ev_cols = ["ev_rank", "id_contrato", "proceso_de_compra", "firma", "nombre_entidad",
               "proveedor_adjudicado", "modalidad", "millones", "dias_adicionados", "objeto"]
    keys = ["rank", "codigo", "bandera", "a_entidad", "a_proveedor", "a_anio", "detalle", "valor_cop",
            "severidad"]
    return (flat.groupBy(*keys)
                .agg(F.sort_array(F.collect_list(F.struct(*ev_cols))).alias("contratos")))
