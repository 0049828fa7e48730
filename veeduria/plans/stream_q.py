"""Catalogue entries: streaming refresh over the ``events`` table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veeduria.plans.catalog import register
from veeduria.plans.context import Context
from veeduria.session import move_folder, scratch_table_dir
from veeduria.sources import sinks as K
from veeduria.streaming import refresh as RF


def _dirs(ctx: Context, name: str) -> tuple[str, str]:
    tag = uuid.uuid4().hex[:10]
    return (scratch_table_dir(ctx.spark, f"{name}_{tag}/table"),
            scratch_table_dir(ctx.spark, f"{name}_{tag}/checkpoint"))


@register("st_weekly", """
SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS semana, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v
FROM events GROUP BY 1, 2""")
def st_weekly(ctx: Context):
    """Weekly series maintained by a watermarked streaming aggregate (same
    rows as the batch query once the landed data is consumed)."""
    table, ckpt = _dirs(ctx, "st_weekly")
    return RF.run_weekly(ctx.spark, ctx.sf_dir, "events.parquet", table, ckpt).drop("n_tarde")


#: Rows of this kind land in a second arrival, after all others.
LATE_TYPE = "signup"


@register("st_weekly_late", f"""
WITH e AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS semana,
             (SELECT max(ts) FROM events WHERE event_type <> '{LATE_TYPE}') - INTERVAL 7 DAY AS marca FROM events)
SELECT CAST(semana AS VARCHAR) AS semana, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v,
       CAST(count_if(event_type = '{LATE_TYPE}' AND semana + INTERVAL 7 DAY <= marca) AS BIGINT) AS n_tarde
FROM e GROUP BY 1, 2""")
def st_weekly_late(ctx: Context):
    """Weekly series with rows that land long after their week: sign-ups come
    in a second arrival, most of them behind the watermark of the first; they
    are counted as late and merged, so the table equals the batch query."""
    table, ckpt = _dirs(ctx, "st_weekly_late")
    landed = table.rsplit("/", 1)[0] + "/landed"
    events = ctx.spark.read.parquet(f"{ctx.sf_dir}/events.parquet")
    late = F.col("event_type") == LATE_TYPE
    events.where(~late).write.parquet(landed)
    RF.run_weekly(ctx.spark, landed, None, table, ckpt)
    events.where(late).write.mode("append").parquet(landed)
    return RF.run_weekly(ctx.spark, landed, None, table, ckpt)


@register("st_dedupe", """
SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM events) WHERE rn = 1""")
def st_dedupe(ctx: Context):
    """Streaming de-duplication of replayed records by id within a watermark:
    the table lands together with a second copy of its clicks, and once more
    in a later run."""
    table, ckpt = _dirs(ctx, "st_dedupe")
    landed = table.rsplit("/", 1)[0] + "/landed"
    events = ctx.spark.read.parquet(f"{ctx.sf_dir}/events.parquet")
    events.write.parquet(landed)
    events.where(F.col("event_type") == "click").write.mode("append").parquet(landed)
    RF.run_dedupe(ctx.spark, landed, None, table, ckpt)
    events.write.mode("append").parquet(landed)
    return RF.run_dedupe(ctx.spark, landed, None, table, ckpt)


# ------------------------------------------------------ incremental flags ---
from veeduria.operators import flags as FL  # noqa: E402
from veeduria.plans import oracle as O  # noqa: E402
from veeduria.plans.catalog import DEFAULT, TEST  # noqa: E402
from veeduria.streaming import flags_refresh as FR  # noqa: E402

CUT = "1998-07-01"
_RAW = f"raw_{DEFAULT.name}"
_CC2 = (f"raw2 AS (SELECT * REPLACE (CAST(valor_del_contrato AS DECIMAL(20,2)) AS valor_del_contrato) FROM {_RAW}),\n"
        f"norm2 AS ({O.normalized_sql('raw2')}),\ncc2 AS ({O.derived_sql('norm2', TEST)})")
_ST_FLAGS = (f"WITH {O.ctes([DEFAULT], TEST)},\n{_CC2}\nSELECT codigo, bandera, nivel, nombre_entidad, nit_entidad,"
             f" proveedor, documento_proveedor, id_contrato, anio, detalle, CAST(valor_cop AS DOUBLE) AS valor_cop,"
             f" severidad FROM (" + "\nUNION ALL\n".join(f"({O.flag_sql(k, 'cc2', TEST)})" for k in FL.REGISTRY) + ")")


@register("st_flags", _ST_FLAGS)
def st_flags(ctx: Context):
    """Incremental alert refresh: contract pages land in two arrivals (before
    and after mid-1998); after each, the stream recomputes only the flag
    partitions the new pages touch. The contracts of early 1997 land first
    with twice their value, buyers that have another name since and the dates
    of a year before, and land again, corrected, with the second arrival.
    The final table equals a full batch run over the corrected records."""
    from veeduria.plans.sources_q import landed_text
    base, ckpt = _dirs(ctx, "st_flags")
    landed = base.rsplit("/", 1)[0] + "/landed"
    raw = landed_text(ctx.raw_contracts(DEFAULT))
    day = F.col("fecha_de_firma")                       # ISO text compares in date order
    first, again = day < F.lit(CUT), (day >= F.lit("1997-01-01")) & (day < F.lit("1997-04-01"))
    wrong = {"valor_del_contrato": (2 * F.col("valor_del_contrato").cast("decimal(18,4)")).cast("string"),
             "nombre_entidad": F.concat(F.lit("ZZ "), F.col("nombre_entidad")),
             "fecha_de_firma": F.regexp_replace("fecha_de_firma", "^1997", "1996")}
    # both arrivals are written from one join, aside, and moved in when they land
    arrivals = F.array_compact(F.array(F.when(first, 1), F.when(~first | again, 2)))
    early = (F.col("arrival") == 1) & again
    rows = raw.select("*", F.explode(arrivals).alias("arrival"))
    K.write_json(rows.select(*[F.when(early, wrong[c]).otherwise(F.col(c)).alias(c) if c in wrong else F.col(c)
                               for c in rows.columns]), f"{landed}_aside", partition_by=("arrival",))
    for n in (1, 2):
        if not move_folder(ctx.spark, f"{landed}_aside/arrival={n}", f"{landed}/arrival={n}"):
            K.write_json(raw.limit(0), f"{landed}/arrival={n}")         # an arrival without records
        alerts = FR.run_refresh(ctx.spark, landed, base, ckpt, TEST)
    return alerts
