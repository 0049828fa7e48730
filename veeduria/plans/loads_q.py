"""Catalogue entries: journalled loads (S5, S7, S8, S10), counts of landed
records (S14), ordered exports (T3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.operators.derive import derive
from veeduria.operators.normalize import normalize
from veeduria.plans import oracle as O
from veeduria.plans.catalog import DEFAULT, TEST, alerts_df, register, with_alerts, with_ctes
from veeduria.plans.context import Context
from veeduria.plans.sources_q import landed_text
from veeduria.schema import ALERT
from veeduria.session import reuse, scratch_table_dir
from veeduria.sources import landed as L
from veeduria.sources import sinks as K
from veeduria.sources.journal import Table

CC = O.cte_name(DEFAULT)
START, END = "1997-03-15", "1999-01-01"
_WHEN = f"fecha_de_firma >= TIMESTAMP '{START}' AND fecha_de_firma < TIMESTAMP '{END}'"


def _dir(ctx: Context, name: str) -> str:
    return scratch_table_dir(ctx.spark, f"{name}_{uuid.uuid4().hex[:10]}")


def _rows(ctx: Context) -> DataFrame:
    """The rows that the loads of a query are cut from, joined once."""
    return reuse(ctx.contracts(DEFAULT, TEST).select("id_contrato", "nit_entidad", "documento_proveedor",
                                                     "valor_del_contrato", "fecha_de_firma", "anio"))


def _out(t: Table) -> DataFrame:
    return t.read().groupBy("anio", "nit_entidad").agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").alias("valor"))


def _out_sql(source: str) -> str:
    return f"SELECT anio, nit_entidad, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor FROM {source} GROUP BY 1, 2"


@register("s05_reload", with_ctes(_out_sql(f"""(
  SELECT anio, nit_entidad, CASE WHEN {_WHEN} THEN valor_del_contrato ELSE 2 * valor_del_contrato END AS valor_del_contrato
  FROM {CC})""")))
def s05_reload(ctx: Context):
    """S5 dated reload: a table of doubled values gets the true rows of a
    range that starts within a year; rows of that year outside the range and
    all other years stay. The reload is run twice, as after a lost driver."""
    c = _rows(ctx)
    t = Table(ctx.spark, _dir(ctx, "s05"), c.schema)
    t.rebuild(c.withColumn("valor_del_contrato", (2 * F.col("valor_del_contrato")).cast(c.schema["valor_del_contrato"].dataType)),
              "full-1")
    for _ in range(2):
        t.reload(c, "reload-1", START, END)
    return _out(t)


@register("s07_rebuild", with_ctes(_out_sql(f"(SELECT * FROM {CC} WHERE anio >= 1998)")))
def s07_rebuild(ctx: Context):
    """S7 full load: the table is dropped and built again; a load that was
    staged but never committed is not seen."""
    c = _rows(ctx)
    t = Table(ctx.spark, _dir(ctx, "s07"), c.schema)
    t.rebuild(c.where(F.col("anio") < 1998), "full-1")
    t.rebuild(c.where(F.col("anio") >= 1998), "full-2")
    t.stage(c.where(F.col("anio") == 1996), "killed")
    return _out(t)


@register("s08_append", with_ctes(_out_sql(f"(SELECT * FROM {CC} UNION ALL SELECT * FROM {CC} WHERE anio = 1997)")))
def s08_append(ctx: Context):
    """S8 batches: even years first, then odd ones, then one year again; each
    batch is named, so its second run adds nothing."""
    c = _rows(ctx)
    t = Table(ctx.spark, _dir(ctx, "s08"), c.schema)
    batches = {"even": F.col("anio") % 2 == 0, "odd": F.col("anio") % 2 == 1, "again": F.col("anio") == 1997}
    for name in ("even", "odd", "odd", "again", "even"):
        t.append(c.where(batches[name]), name)
    return _out(t)


@register("s10_materialize", with_alerts("SELECT codigo, anio, count(*) AS n, CAST(sum(valor_cop) AS DOUBLE) AS valor, "
                                         "CAST(max(severidad) AS INTEGER) AS severidad FROM alertas GROUP BY 1, 2"))
def s10_materialize(ctx: Context):
    """S10 the alert table, materialised by a full load and read back."""
    a = alerts_df(ctx)
    t = Table(ctx.spark, _dir(ctx, "s10"), ALERT)
    t.rebuild(a, "alerts-1")
    return t.read().groupBy("codigo", "anio").agg(F.count(F.lit(1)).alias("n"), F.sum("valor_cop").alias("valor"),
                                                  F.max("severidad").alias("severidad"))


@register("s14_landed_count", with_ctes(f"SELECT count(*) AS n, 'lines' AS kind FROM raw_{DEFAULT.name} "
                                        f"UNION ALL SELECT count(*), 'contratos' FROM {CC}"))
def s14_landed_count(ctx: Context):
    """S14 landed records and clean contracts counted from landed files."""
    path = _dir(ctx, "s14")
    K.write_json(landed_text(ctx.raw_contracts(DEFAULT)), path)
    rows = L.read_landed_json(ctx.spark, path)
    clean = L.source_filter(normalize(rows))
    return (L.load_count(rows).withColumn("kind", F.lit("lines"))
             .unionByName(L.load_count(derive(clean, TEST)).withColumn("kind", F.lit("contratos"))))


_ORDER = ["severidad DESC", "valor_cop DESC NULLS LAST", "codigo", "coalesce(nit_entidad, '')",
          "coalesce(documento_proveedor, '')", "coalesce(id_contrato, '')", "anio", "coalesce(detalle, '')"]


@register("t03_sorted_feed", with_alerts(f"""
SELECT row_number() OVER (ORDER BY {", ".join(_ORDER)}) AS orden, codigo, nit_entidad, documento_proveedor, id_contrato, anio,
       CAST(valor_cop AS DOUBLE) AS valor_cop, severidad FROM alertas"""))
def t03(ctx: Context):
    """T3 the whole alert feed, exported as CSV in order and read back with
    each row's place in the files."""
    a = alerts_df(ctx)
    path = _dir(ctx, "t03")
    key = [F.coalesce(c, F.lit("")).asc() for c in ("nit_entidad", "documento_proveedor", "id_contrato")]
    order = [F.desc("severidad"), F.desc_nulls_last("valor_cop"), F.asc("codigo"), *key, F.asc("anio"),
             F.coalesce("detalle", F.lit("")).asc()]
    K.write_sorted(a, path, order)
    back = K.with_place(K.read_csv(ctx.spark, path, ALERT))
    return back.select("orden", "codigo", "nit_entidad", "documento_proveedor", "id_contrato", "anio", "valor_cop", "severidad")
