"""Catalogue entries: detectors on as-of joins, range joins, learned weights
and tests of fit (XB, XD, XM, XV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veeduria.functions.fmt import round_half
from veeduria.operators import extra as X
from veeduria.plans import oracle as O
from veeduria.plans.catalog import DEFAULT, NATION_CUSTOMER, TEST, register, with_ctes
from veeduria.plans.context import Context

CC = O.cte_name(DEFAULT)
NC = O.cte_name(NATION_CUSTOMER)
DAYS = 90

_XD = """SELECT c.id_contrato, c.documento_proveedor, CAST(c.fecha_de_firma AS VARCHAR) AS fecha_de_firma,
       CAST(c.valor_del_contrato AS DOUBLE) AS valor_del_contrato"""


#: What the result needs of a contract; the as-of join moves and writes every column it is given.
_CONTRACT = ("id_contrato", "documento_proveedor", "fecha_de_firma", "valor_del_contrato")


@register("xd_donor", with_ctes(f"""{_XD}, CAST(d.fecha AS VARCHAR) AS fecha_donacion, CAST(d.monto AS DOUBLE) AS monto_donacion,
       CAST(datediff('day', d.fecha, c.fecha_de_firma) AS INTEGER) AS dias_desde_donacion
FROM {NC} c ASOF JOIN d ON c.documento_proveedor = d.donante AND c.fecha_de_firma >= d.fecha
WHERE datediff('day', d.fecha, c.fecha_de_firma) <= {DAYS}""", [NATION_CUSTOMER], """
d AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS donante, o_orderdate AS fecha,
             max(CAST(o_totalprice AS DECIMAL(18,2))) AS monto FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""))
def xd_donor(ctx: Context):
    """XD contracts of suppliers that gave a donation shortly before: orders
    in part play the donations; the latest one up to the signature counts."""
    o = ctx.tables.orders.where(F.col("o_orderstatus") == "P")
    gifts = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("donante"),
                     F.col("o_orderdate").alias("fecha"), F.col("o_totalprice").cast("decimal(18,2)").alias("monto"))
    r = X.donor_contracts(ctx.contracts(NATION_CUSTOMER, TEST).select(*_CONTRACT), gifts, DAYS)
    return r.select(*_CONTRACT, "fecha_donacion", "monto_donacion", "dias_desde_donacion")


@register("xd_ex_official", with_ctes(f"""{_XD}, CAST(d.fin AS VARCHAR) AS fin_cargo, d.cargo,
       CAST(datediff('day', d.fin, c.fecha_de_firma) AS INTEGER) AS dias_desde_cargo
FROM {NC} c ASOF JOIN d ON c.documento_proveedor = d.persona AND c.fecha_de_firma > d.fin
WHERE datediff('day', d.fin, c.fecha_de_firma) < {DAYS}""", [NATION_CUSTOMER], """
d AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS persona, o_orderdate AS fin, max(o_orderstatus) AS cargo
      FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2)"""))
def xd_ex_official(ctx: Context):
    """XD contracts of suppliers that left a public post shortly before: low
    priority orders play the posts, their date the last day."""
    o = ctx.tables.orders.where(F.col("o_orderpriority") == "5-LOW")
    posts = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("persona"),
                     F.col("o_orderdate").alias("fin"), F.col("o_orderstatus").alias("cargo"))
    r = X.ex_official_contracts(ctx.contracts(NATION_CUSTOMER, TEST).select(*_CONTRACT), posts, DAYS)
    return r.select(*_CONTRACT, "fin_cargo", "cargo", "dias_desde_cargo")


_DIGIT = "left(CAST(CAST(floor(valor_del_contrato) AS DECIMAL(38,0)) AS VARCHAR), 1)"
_CHI = " + ".join(f"((n{d} - t * {e!r}::DOUBLE) * (n{d} - t * {e!r}::DOUBLE)) / (t * {e!r}::DOUBLE)" for d, e in X.BENFORD.items())
_MAD = " + ".join(f"abs(n{d} / t - {e!r}::DOUBLE)" for d, e in X.BENFORD.items())


@register("xb_benford_test", with_ctes(f"""
SELECT nit_entidad, total, {O.rnd('chi2', 6)} AS chi2, {O.rnd('mad', 9)} AS mad,
       {O.rnd('exp(-x) * (1.0::DOUBLE + x + x * x / 2.0::DOUBLE + x * x * x / 6.0::DOUBLE)', 9)} AS p_valor
FROM (SELECT *, chi2 / 2.0::DOUBLE AS x FROM (
  SELECT nit_entidad, total, 0.0::DOUBLE + {_CHI} AS chi2, (0.0::DOUBLE + {_MAD}) / 9.0::DOUBLE AS mad FROM (
    SELECT nit_entidad, count(*) AS total, CAST(count(*) AS DOUBLE) AS t,
           {", ".join(f"CAST(count_if({_DIGIT} = '{d}') AS DOUBLE) AS n{d}" for d in X.BENFORD)}
    FROM {CC} WHERE valor_del_contrato >= 1 AND nit_entidad IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)))"""))
def xb_test(ctx: Context):
    """XB chi-square, tail probability and mean absolute deviation of the
    first digits per buyer."""
    r = X.benford_test(ctx.contracts(DEFAULT, TEST), 50)
    return r.select("nit_entidad", "total", round_half(F.col("chi2"), 6).alias("chi2"),
                    round_half(F.col("mad"), 9).alias("mad"), round_half(F.col("p_valor"), 9).alias("p_valor"))


_PERIODS = """
y AS (SELECT DISTINCT year(fecha_de_firma) AS y FROM {cc}),
p AS (SELECT 'restriccion' AS marca, make_date(y, 3, 1) AS desde, make_date(y, 7, 1) AS hasta FROM y
      UNION ALL SELECT 'eleccion', make_date(y, 5, 20), make_date(y, 6, 20) FROM y
      UNION ALL SELECT 'cierre', make_date(y, 12, 1), make_date(y + 1, 1, 1) FROM y),
s AS (SELECT *, 'antes' AS fase, desde - 30 AS a, desde AS b FROM p
      UNION ALL SELECT *, 'durante', desde, hasta FROM p UNION ALL SELECT *, 'despues', hasta, hasta + 30 FROM p)"""


@register("xm_effects", with_ctes(f"""
SELECT s.marca, CAST(s.desde AS VARCHAR) AS desde, CAST(s.hasta AS VARCHAR) AS hasta, s.fase,
       CAST(datediff('day', max(s.a), max(s.b)) AS INTEGER) AS dias, count(c.fecha_de_firma) AS contratos,
       CAST(coalesce(sum(c.valor_del_contrato), 0) AS DOUBLE) AS valor
FROM s LEFT JOIN {CC} c ON CAST(c.fecha_de_firma AS DATE) >= s.a AND CAST(c.fecha_de_firma AS DATE) < s.b
GROUP BY 1, 2, 3, 4""", [DEFAULT], _PERIODS.format(cc=CC)))
def xm_effects(ctx: Context):
    """XM contracts before, during and after each year's restriction,
    election and year-end periods, which overlap."""
    c = ctx.contracts(DEFAULT, TEST)
    y = c.select(F.year("fecha_de_firma").alias("y")).distinct()

    def day(year, month, d):
        return F.make_date(year, F.lit(month), F.lit(d))
    kinds = F.array(*[F.struct(F.lit(m).alias("marca"), a.alias("desde"), b.alias("hasta")) for m, a, b in (
        ("restriccion", day(F.col("y"), 3, 1), day(F.col("y"), 7, 1)),
        ("eleccion", day(F.col("y"), 5, 20), day(F.col("y"), 6, 20)),
        ("cierre", day(F.col("y"), 12, 1), day(F.col("y") + 1, 1, 1)))])
    return X.period_effects(c, y.select(F.explode(kinds).alias("k")).select("k.*"))


_WEIGHTS = f"""
tx AS (SELECT coalesce(tipo_de_contrato, '') AS tipo, objeto_del_contrato AS objeto, count(*) AS c,
         list_distinct(list_filter(regexp_split_to_array(lower(objeto_del_contrato), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))
           AS w FROM {CC} WHERE objeto_del_contrato IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT tipo, termino, sum(c) AS n FROM (SELECT tipo, c, unnest(w) AS termino FROM tx) GROUP BY 1, 2),
ty AS (SELECT tipo, sum(c) AS objetos FROM tx GROUP BY 1),
tw AS (SELECT tipo, termino, CAST(n AS BIGINT) AS n,
         CAST(round(ln(CAST(objetos AS DOUBLE) / CAST(n AS DOUBLE)) * 1000000) AS BIGINT) AS peso
       FROM tt JOIN ty USING (tipo)),
sp AS (SELECT x.tipo, x.objeto, max(x.c) AS c, CAST(max(len(x.w)) AS BIGINT) AS palabras,
         CAST(coalesce(sum(tw.peso), 0) AS DOUBLE) / CAST(greatest(max(len(x.w)), 1) AS DOUBLE) / 1000000 AS especificidad
       FROM (SELECT *, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS termino FROM tx) x
       LEFT JOIN tw ON tw.tipo = x.tipo AND tw.termino = x.termino GROUP BY 1, 2)"""


@register("xv_weights", with_ctes("SELECT tipo, termino, n, peso FROM tw", [DEFAULT], _WEIGHTS))
def xv_weights(ctx: Context):
    """XV weights of words per contract type, learned from all contracts."""
    return X.term_weights(ctx.contracts(DEFAULT, TEST))


@register("xv_specificity", with_ctes("SELECT tipo, objeto, c AS contratos, palabras, especificidad FROM sp", [DEFAULT], _WEIGHTS))
def xv_specificity(ctx: Context):
    """XV mean specificity of every object text."""
    c = ctx.contracts(DEFAULT, TEST)
    return X.specificity(c, X.term_weights(c))


@register("xv_vague_buyers", with_ctes(f"""
SELECT nit_entidad, count(*) AS n, CAST(count_if(especificidad < 1.9) AS BIGINT) AS n_vagos,
       CAST(coalesce(sum(valor_del_contrato) FILTER (especificidad < 1.9), 0) AS DOUBLE) AS valor_vago
FROM {CC} c JOIN sp ON sp.tipo = coalesce(c.tipo_de_contrato, '') AND sp.objeto = c.objeto_del_contrato
WHERE nit_entidad IS NOT NULL GROUP BY 1""", [DEFAULT], _WEIGHTS))
def xv_vague_buyers(ctx: Context):
    """XV per buyer: contracts with an object of common words only."""
    c = ctx.contracts(DEFAULT, TEST)
    return X.vague_buyers(c, X.term_weights(c), 1.9)
