"""Catalogue entries: second-tier detectors (design-only in the reference)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veeduria.operators import extra as X
from veeduria.operators import flags as FL
from veeduria.operators import scores as S
from veeduria.plans import oracle as O
from veeduria.plans.catalog import (CUSTOMER_SUPPLIER, DEFAULT, NATION_CUSTOMER, TEST, register, with_ctes)
from veeduria.plans.context import Context
from veeduria.session import reuse

CC = O.cte_name(DEFAULT)
CS = O.cte_name(CUSTOMER_SUPPLIER)
NC = O.cte_name(NATION_CUSTOMER)
THRESHOLD = 50_000


@register("x05_bunching", with_ctes(f"""
SELECT nit_entidad, n_90, n_80, CAST(n_90 AS DOUBLE) / CAST(n_80 AS DOUBLE) AS ratio FROM (
  SELECT nit_entidad,
         CAST(count_if(valor_del_contrato >= {THRESHOLD * 0.9} AND valor_del_contrato < {THRESHOLD}) AS BIGINT) AS n_90,
         CAST(count_if(valor_del_contrato >= {THRESHOLD * 0.8} AND valor_del_contrato < {THRESHOLD * 0.9}) AS BIGINT) AS n_80
  FROM {CC} WHERE nit_entidad IS NOT NULL GROUP BY 1) WHERE n_80 >= 1"""))
def x05(ctx: Context):
    """X05 values bunched under a threshold."""
    return X.bunching(ctx.contracts(DEFAULT, TEST), THRESHOLD)


_EXP = ", ".join(f"({d}, CAST({repr(v)} AS DOUBLE))" for d, v in sorted(X.BENFORD.items()))


@register("xb_benford", with_ctes(f"""
SELECT CAST(g.digito AS INTEGER) AS digito, g.nit_entidad, g.total, CAST(coalesce(d.n, 0) AS BIGINT) AS n, e.esperado,
       CAST(coalesce(d.n, 0) AS DOUBLE) / CAST(g.total AS DOUBLE) AS observado,
       abs(CAST(coalesce(d.n, 0) AS DOUBLE) / CAST(g.total AS DOUBLE) - e.esperado) AS desvio
FROM (SELECT t.nit_entidad, t.total, r.digito FROM t, (SELECT unnest(range(1, 10)) AS digito) r) g
LEFT JOIN d ON d.nit_entidad = g.nit_entidad AND d.digito = g.digito
JOIN (VALUES {_EXP}) e(digito, esperado) ON e.digito = g.digito""", [DEFAULT], f"""
d AS (SELECT nit_entidad, CAST(left(CAST(CAST(floor(valor_del_contrato) AS DECIMAL(38,0)) AS VARCHAR), 1) AS INTEGER)
             AS digito, count(*) AS n
      FROM {CC} WHERE valor_del_contrato >= 1 AND nit_entidad IS NOT NULL GROUP BY 1, 2),
t AS (SELECT nit_entidad, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY 1 HAVING sum(n) >= 50)"""))
def xb(ctx: Context):
    """XB Benford first-digit deviation per buyer."""
    return X.benford(ctx.contracts(DEFAULT, TEST), 50)


_HHI = f"""h AS (
  SELECT nit_entidad, anio, v_total, proveedores, {O.hhi_of('sq', 'v_total')} AS hhi FROM (
    SELECT nit_entidad, anio, sum({O.units('v')} * {O.units('v')}) AS sq, sum(v) AS v_total,
           count(*) AS proveedores FROM (
      SELECT nit_entidad, anio, documento_proveedor, sum(valor_del_contrato) AS v FROM {CS}
      WHERE nit_entidad IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


@register("xh_hhi_p95", with_ctes("""
SELECT nit_entidad, anio, CAST(v_total AS DOUBLE) AS v_total, proveedores, hhi,
       (SELECT quantile_cont(hhi, 0.95) FROM h) AS umbral
FROM h WHERE hhi > (SELECT quantile_cont(hhi, 0.95) FROM h)""", [CUSTOMER_SUPPLIER], _HHI))
def xh(ctx: Context):
    """XH buyer-years above the national 95th percentile of HHI."""
    return X.hhi_above_national(ctx.contracts(CUSTOMER_SUPPLIER, TEST), 0.95)


_svc = O.ilike_any("tipo_de_contrato", TEST.service)


@register("xo_overlap", with_ctes("""
SELECT documento_proveedor, CAST(max(entidades) AS BIGINT) AS max_entidades,
       CAST(min(CASE WHEN entidades >= 3 THEN dia END) AS VARCHAR) AS desde
FROM run GROUP BY 1 HAVING max(entidades) >= 3""", [DEFAULT], f"""
iv AS (SELECT documento_proveedor, nit_entidad, CAST(fecha_de_inicio_del_contrato AS DATE) AS ini,
              CAST(fecha_de_fin_del_contrato AS DATE) AS fin
       FROM {CC} WHERE es_persona_natural AND {_svc} AND documento_proveedor IS NOT NULL
        AND nit_entidad IS NOT NULL
        AND CAST(fecha_de_fin_del_contrato AS DATE) > CAST(fecha_de_inicio_del_contrato AS DATE)),
ev AS (SELECT documento_proveedor, nit_entidad, dia, sum(d) AS d FROM (
         SELECT documento_proveedor, nit_entidad, ini AS dia, 1 AS d FROM iv
         UNION ALL SELECT documento_proveedor, nit_entidad, fin AS dia, -1 AS d FROM iv)
       GROUP BY 1, 2, 3 HAVING sum(d) <> 0),
act AS (SELECT *, sum(d) OVER (PARTITION BY documento_proveedor, nit_entidad ORDER BY dia
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS activos FROM ev),
act2 AS (SELECT *, coalesce(lag(activos) OVER (PARTITION BY documento_proveedor, nit_entidad ORDER BY dia), 0)
                   AS antes FROM act),
chg AS (SELECT documento_proveedor, dia,
               sum(CASE WHEN activos > 0 THEN 1 ELSE 0 END - CASE WHEN antes > 0 THEN 1 ELSE 0 END) AS de
        FROM act2 GROUP BY 1, 2
        HAVING sum(CASE WHEN activos > 0 THEN 1 ELSE 0 END - CASE WHEN antes > 0 THEN 1 ELSE 0 END) <> 0),
run AS (SELECT *, sum(de) OVER (PARTITION BY documento_proveedor ORDER BY dia
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entidades FROM chg)"""))
def xo(ctx: Context):
    """XO natural person with contracts running at once for 3+ buyers."""
    return X.overlap(ctx.contracts(DEFAULT, TEST), TEST, 3)


@register("xa_advance", with_ctes(f"""
SELECT id_contrato, nit_entidad, documento_proveedor, CAST(valor_del_contrato AS DOUBLE) AS valor_del_contrato,
       CAST(valor_de_pago_adelantado AS DOUBLE) AS valor_de_pago_adelantado,
       CAST(valor_pagado AS DOUBLE) AS valor_pagado
FROM {CC} WHERE valor_de_pago_adelantado > valor_del_contrato * 0.05
  AND coalesce(valor_pagado, 0) < valor_del_contrato * 0.1"""))
def xa(ctx: Context):
    """XA high advance payment with little paid."""
    return X.advance_risk(ctx.contracts(DEFAULT, TEST), "0.05", "0.1")


_SHARED = "alertas AS (" + "\nUNION ALL\n".join(
    f"({O.flag_sql(k, CC, TEST)})" for k in FL.REGISTRY) + ")"


@register("xw_watchlist", with_ctes(f"""
SELECT c.nit_entidad, c.contratos, c.valor, CAST(coalesce(a.alertas, 0) AS BIGINT) AS alertas FROM (
  SELECT nit_entidad, count(*) AS contratos, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor FROM {CC}
  WHERE nit_entidad IN (SELECT nit_entidad FROM watch) GROUP BY 1) c
LEFT JOIN (SELECT nit_entidad, count(*) AS alertas FROM alertas
           WHERE nit_entidad IN (SELECT nit_entidad FROM watch) GROUP BY 1) a USING (nit_entidad)""",
    [DEFAULT], _SHARED + """,
watch AS (SELECT nit_entidad FROM alertas WHERE nit_entidad IS NOT NULL GROUP BY 1
          HAVING least(100, sum(severidad)) >= 100)"""))
def xw(ctx: Context):
    """XW activity of a watchlist (buyers whose score reaches 100)."""
    ctx.keep(payments=False)
    c = ctx.contracts(DEFAULT, TEST)
    a = reuse(FL.run_flags_shared(c, TEST))     # flags run once for both consumers
    watch = S.entity_scores(a).where(F.col("score") >= 100).select(F.col("key").alias("nit_entidad"))
    return X.watchlist_activity(c, a, watch)


@register("xm_markers", with_ctes(f"""
SELECT CAST(dia AS VARCHAR) AS dia, contratos, CAST(valor AS DOUBLE) AS valor,
       CAST(datediff('day', dia, make_date(year(dia), 12, 31)) AS INTEGER) AS dias_al_cierre,
       CASE WHEN datediff('day', dia, make_date(year(dia), 12, 31)) < 30 THEN 'cierre de vigencia' END AS marcador
FROM (SELECT CAST(fecha_de_firma AS DATE) AS dia, count(*) AS contratos, sum(valor_del_contrato) AS valor
      FROM {CC} GROUP BY 1)"""))
def xm(ctx: Context):
    """XM daily series with year-end markers."""
    return X.calendar_markers(ctx.contracts(DEFAULT, TEST), 30)


@register("xg_growth", with_ctes(f"""
SELECT documento_proveedor, anio, CAST(total AS DOUBLE) AS total,
       CASE WHEN lag(anio) OVER w = anio - 1 THEN CAST(total AS DOUBLE) / CAST(lag(total) OVER w AS DOUBLE) END
         AS crecimiento
FROM (SELECT documento_proveedor, anio, sum(valor_del_contrato) AS total FROM {NC}
      WHERE documento_proveedor IS NOT NULL GROUP BY 1, 2)
WINDOW w AS (PARTITION BY documento_proveedor ORDER BY anio)""", [NATION_CUSTOMER]))
def xg_growth(ctx: Context):
    """XG supplier billing growth (previous calendar year)."""
    return X.supplier_growth(ctx.contracts(NATION_CUSTOMER, TEST))


@register("xg_peers", with_ctes(f"""
SELECT sector, anio, nit_entidad, CAST(valor AS DOUBLE) AS valor,
       percent_rank() OVER (PARTITION BY sector, anio ORDER BY valor) AS pct_rank
FROM (SELECT sector, anio, nit_entidad, sum(valor_del_contrato) AS valor FROM {CS}
      WHERE nit_entidad IS NOT NULL GROUP BY 1, 2, 3)""", [CUSTOMER_SUPPLIER]))
def xg_peers(ctx: Context):
    """XG buyer's yearly value as percentile rank among its sector peers."""
    return X.peer_rank(ctx.contracts(CUSTOMER_SUPPLIER, TEST), "sector")


@register("x07_lightning", with_ctes(f"""
SELECT id_contrato, d.modalidad_de_contratacion, dias, umbral, CAST(valor_del_contrato AS DOUBLE) AS valor_del_contrato
FROM d JOIN (SELECT modalidad_de_contratacion, quantile_cont(CAST(dias AS DOUBLE), 0.05) AS umbral FROM d GROUP BY 1) q
  ON d.modalidad_de_contratacion = q.modalidad_de_contratacion
WHERE dias < umbral""", [DEFAULT], f"""
d AS (SELECT *, CAST(datediff('day', fecha_de_inicio_del_contrato, fecha_de_fin_del_contrato) AS INTEGER) AS dias
      FROM {CC} WHERE modalidad_de_contratacion IS NOT NULL
       AND datediff('day', fecha_de_inicio_del_contrato, fecha_de_fin_del_contrato) >= 0)"""))
def x07(ctx: Context):
    """X07 lightning awards: duration in the lowest 5 % of the modality."""
    return X.lightning(ctx.contracts(DEFAULT, TEST), 0.05)


# Test-binding term weights for the vagueness score (part names play objects).
VAGUE_TERMS = {"%old%": 2, "%gizmo%": 1, "%ring%": 1}
_vsc = " + ".join(f"CASE WHEN objeto_del_contrato ILIKE {O.q(p)} THEN {w} ELSE 0 END" for p, w in VAGUE_TERMS.items())


@register("xv_vague", with_ctes(f"""
SELECT nit_entidad, count(*) AS n, CAST(count_if(v > 0) AS BIGINT) AS n_vagos, CAST(sum(v) AS BIGINT) AS puntaje FROM (
  SELECT nit_entidad, {_vsc} AS v FROM {CC} WHERE nit_entidad IS NOT NULL) GROUP BY 1"""))
def xv(ctx: Context):
    """XV weighted vagueness score of object texts per buyer."""
    return X.vagueness_by_entity(ctx.contracts(DEFAULT, TEST), VAGUE_TERMS)


_F02 = O.flag_sql("F02", NC, TEST)


@register("xs_periods", with_ctes(f"""
SELECT c.id_contrato, c.documento_proveedor, CAST(c.fecha_de_firma AS VARCHAR) AS fecha_de_firma,
       CAST(c.valor_del_contrato AS DOUBLE) AS valor_del_contrato, CAST(p.desde AS VARCHAR) AS desde,
       CAST(p.hasta AS VARCHAR) AS hasta
FROM {NC} c JOIN p ON c.documento_proveedor = p.documento_proveedor
WHERE CAST(c.fecha_de_firma AS DATE) >= p.desde AND CAST(c.fecha_de_firma AS DATE) < p.hasta""",
    [NATION_CUSTOMER], f"""
p AS (SELECT documento_proveedor, make_date(anio + 1, 1, 1) AS desde, make_date(anio + 2, 1, 1) AS hasta
      FROM ({_F02}))"""))
def xs(ctx: Context):
    """XS contracts signed inside a supplier's watch period (the year after a
    billing-jump alert): interval join on id + period."""
    c = ctx.contracts(NATION_CUSTOMER, TEST)
    a = FL.f02_jump(c, TEST)
    periods = a.select("documento_proveedor",
                       F.make_date(F.col("anio") + 1, F.lit(1), F.lit(1)).alias("desde"),
                       F.make_date(F.col("anio") + 2, F.lit(1), F.lit(1)).alias("hasta"))
    return (X.contracts_in_periods(c, periods)
             .select("id_contrato", "documento_proveedor", "fecha_de_firma", "valor_del_contrato", "desde", "hasta"))


@register("xd_company_age", with_ctes(f"""
SELECT c.id_contrato, c.documento_proveedor, CAST(c.fecha_de_firma AS VARCHAR) AS fecha_de_firma,
       CAST(f.primera AS VARCHAR) AS primera, CAST(datediff('day', f.primera, c.fecha_de_firma) AS INTEGER) AS edad_dias,
       CAST(c.valor_del_contrato AS DOUBLE) AS valor_del_contrato
FROM {NC} c JOIN (SELECT documento_proveedor, min(fecha_de_firma) AS primera FROM {NC}
                  WHERE documento_proveedor IS NOT NULL GROUP BY 1) f USING (documento_proveedor)
WHERE datediff('day', f.primera, c.fecha_de_firma) <= 30 AND c.valor_del_contrato > 80000""", [NATION_CUSTOMER]))
def xd(ctx: Context):
    """XD large contracts signed within 30 days of the supplier's first
    appearance (company-age proxy)."""
    r = X.company_age(ctx.contracts(NATION_CUSTOMER, TEST), 30, 80000)
    return r.select("id_contrato", "documento_proveedor", "fecha_de_firma", "primera", "edad_dias",
                    "valor_del_contrato")


@register("xr_pairs", with_ctes(f"""
WITH_X
SELECT p.perdedor, p.ganador, p.juntos, n.derrotas, CAST(p.juntos AS DOUBLE) / CAST(n.derrotas AS DOUBLE) AS confianza,
       CAST(p.juntos AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM lost) AS soporte,
       CAST(p.juntos AS DOUBLE) * (SELECT CAST(count(*) AS DOUBLE) FROM lost)
         / CAST(n.derrotas * g.victorias AS DOUBLE) AS lift
FROM (SELECT perdedor, ganador, count(*) AS juntos FROM lost GROUP BY 1, 2 HAVING count(*) >= 2) p
JOIN (SELECT perdedor, count(*) AS derrotas FROM lost GROUP BY 1) n USING (perdedor)
JOIN (SELECT ganador, count(*) AS victorias FROM lost GROUP BY 1) g USING (ganador)""".replace("WITH_X\n", ""),
    [DEFAULT], f"""
part AS (SELECT proceso_de_compra, documento_proveedor, sum(valor_del_contrato) AS v FROM {CC}
         WHERE documento_proveedor IS NOT NULL AND proceso_de_compra IS NOT NULL GROUP BY 1, 2),
win AS (SELECT proceso_de_compra, ganador FROM (
          SELECT proceso_de_compra, documento_proveedor AS ganador, count(*) OVER (PARTITION BY proceso_de_compra) AS k,
                 row_number() OVER (PARTITION BY proceso_de_compra ORDER BY v DESC, documento_proveedor DESC) AS rn
          FROM part) WHERE rn = 1 AND k >= 2),
lost AS (SELECT part.documento_proveedor AS perdedor, win.ganador, part.proceso_de_compra FROM part
         JOIN win USING (proceso_de_compra) WHERE part.documento_proveedor <> win.ganador)"""))
def xr(ctx: Context):
    """XR suppliers repeatedly beside the same winner in a process."""
    return X.loser_winner_pairs(ctx.contracts(DEFAULT, TEST), 2)
