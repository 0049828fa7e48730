"""Second-tier detectors described in the design notes (not in the published
flag set). Each is a ``DataFrame -> DataFrame`` plan over the clean
contract table; thresholds are parameters."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.operators.derive import is_service
from veeduria.operators.flags import hhi_of, units
from veeduria.operators.asof import asof_join
from veeduria.operators.ranks import exact_quantile, with_percent_rank
from veeduria.params import Params
from veeduria.session import reuse

# ---------------------------------------------------------------------------
# Benford's expected first-digit shares, log10(1 + 1/d).
# ---------------------------------------------------------------------------
BENFORD = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


def _v():
    return F.col("valor_del_contrato")


def bunching(c: DataFrame, threshold: int, min_below: int = 1) -> DataFrame:
    """X05 values bunched just under a legal threshold T, per buyer:
    contracts in [0.9T, T) against contracts in [0.8T, 0.9T)."""
    t = Decimal(threshold)
    hi = (_v() >= F.lit(t * Decimal("0.9"))) & (_v() < F.lit(t))
    lo = (_v() >= F.lit(t * Decimal("0.8"))) & (_v() < F.lit(t * Decimal("0.9")))
    g = (c.where(F.col("nit_entidad").isNotNull())
          .groupBy("nit_entidad")
          .agg(F.count(F.when(hi, 1)).alias("n_90"), F.count(F.when(lo, 1)).alias("n_80")))
    return (g.where(F.col("n_80") >= min_below)
             .withColumn("ratio", F.col("n_90").cast("double") / F.col("n_80").cast("double")))


def first_digit(c: DataFrame) -> DataFrame:
    """Leading digit of the integer part of the value (values >= 1)."""
    return c.where(_v() >= 1).withColumn(
        "digito", F.substring(F.floor(_v()).cast("decimal(38,0)").cast("string"), 1, 1).cast("int"))


def benford(c: DataFrame, min_n: int = 50) -> DataFrame:
    """XB first-digit distribution per buyer against Benford's law: one row
    per (buyer, digit) with observed share, expected share and absolute
    deviation (buyers with at least ``min_n`` contracts). The expected table
    has a fixed 9 rows, so it is broadcast."""
    d = (first_digit(c).where(F.col("nit_entidad").isNotNull())
         .groupBy("nit_entidad", "digito").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("nit_entidad")
    d = d.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= min_n)
    exp = c.sparkSession.createDataFrame(sorted(BENFORD.items()), "digito int, esperado double")
    digits = d.select("nit_entidad", "total").distinct()
    # every buyer gets all nine digits: expand with a fixed 9-element array
    grid = digits.select("nit_entidad", "total", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("digito"))
    out = (grid.join(d.select("nit_entidad", "digito", "n"), ["nit_entidad", "digito"], "left")
               .join(F.broadcast(exp), "digito")
               .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    share = F.col("n").cast("double") / F.col("total").cast("double")
    return (out.withColumn("observado", share)
               .withColumn("desvio", F.abs(F.col("observado") - F.col("esperado"))))


def benford_test(c: DataFrame, min_n: int = 50) -> DataFrame:
    """XB one row per buyer: the chi-square of its first digits against
    Benford's law, the probability of one at least as large by chance, and
    the mean absolute deviation of the nine shares. For the 8 degrees of
    freedom of nine digits the tail is exp(-x) (1 + x + x^2/2 + x^3/6) with
    x = chi2 / 2, an exact closed form. The nine counts are columns of one
    aggregate, so no digit table is joined."""
    digits = first_digit(c).where(F.col("nit_entidad").isNotNull())
    n = {d: F.col(f"n{d}") for d in BENFORD}
    g = (digits.groupBy("nit_entidad")
               .agg(F.count(F.lit(1)).alias("total"),
                    *[F.count_if(F.col("digito") == d).alias(f"n{d}") for d in BENFORD])
               .where(F.col("total") >= min_n))
    total = F.col("total").cast("double")
    chi2 = sum((((n[d] - total * e) * (n[d] - total * e)) / (total * e) for d, e in BENFORD.items()), F.lit(0.0))
    mad = sum((F.abs(n[d] / total - e) for d, e in BENFORD.items()), F.lit(0.0)) / 9.0
    x = F.col("chi2") / 2.0
    tail = F.exp(-x) * (1.0 + x + x * x / 2.0 + x * x * x / 6.0)
    return g.select("nit_entidad", "total", chi2.alias("chi2"), mad.alias("mad")).withColumn("p_valor", tail)


def hhi_table(c: DataFrame) -> DataFrame:
    """HHI of supplier value shares per buyer and year (all buyers)."""
    by = (c.where(F.col("nit_entidad").isNotNull())
           .groupBy("nit_entidad", "anio", "documento_proveedor").agg(F.sum(_v()).alias("v")))
    vi = units(F.col("v"))
    g = by.groupBy("nit_entidad", "anio").agg(F.sum(vi * vi).alias("sq"), F.sum("v").alias("v_total"),
                                               F.count(F.lit(1)).alias("proveedores"))
    return g.withColumn("hhi", hhi_of(F.col("sq"), F.col("v_total"))).drop("sq")


def hhi_above_national(c: DataFrame, p: float = 0.95, min_suppliers: int = 1) -> DataFrame:
    """XH buyer-years whose HHI is above the national p-quantile of HHI
    (exact quantile, attached as a scalar subquery)."""
    h = hhi_table(c).where(F.col("proveedores") >= min_suppliers)
    q = exact_quantile(h, "hhi", p, alias="umbral")
    return h.withColumn("umbral", q.scalar()).where(F.col("hhi") > F.col("umbral"))


def overlap(c: DataFrame, p: Params = Params(), min_entities: int = 3) -> DataFrame:
    """XO a natural person's service contracts truly running at the same
    time for ``min_entities`` or more buyers.

    Intervals [start, end) are turned into +1/-1 day deltas and
    pre-aggregated per (supplier, buyer, day) and then per (supplier, day)
    before any window, so a window's length is bounded by distinct days, not
    by the number of contracts (a hot supplier does not put its raw rows in
    one task). Step 1: active contracts per (supplier, buyer) by running
    sum; step 2: buyer becomes active / inactive; step 3: running count of
    active buyers per supplier."""
    ok = (F.col("es_persona_natural") & is_service(p) & F.col("documento_proveedor").isNotNull()
          & F.col("nit_entidad").isNotNull()
          & (F.to_date("fecha_de_fin_del_contrato") > F.to_date("fecha_de_inicio_del_contrato")))
    iv = c.where(ok).select("documento_proveedor", "nit_entidad",
                            F.to_date("fecha_de_inicio_del_contrato").alias("ini"),
                            F.to_date("fecha_de_fin_del_contrato").alias("fin"))
    ev = iv.select("documento_proveedor", "nit_entidad",
                   F.explode(F.array(F.struct(F.col("ini").alias("dia"), F.lit(1).alias("d")),
                                     F.struct(F.col("fin").alias("dia"), F.lit(-1).alias("d")))).alias("e"))
    ev = (ev.groupBy("documento_proveedor", "nit_entidad", F.col("e.dia").alias("dia"))
            .agg(F.sum("e.d").alias("d")).where(F.col("d") != 0))
    w1 = Window.partitionBy("documento_proveedor", "nit_entidad").orderBy("dia") \
               .rowsBetween(Window.unboundedPreceding, 0)
    act = ev.withColumn("activos", F.sum("d").over(w1))
    w1p = Window.partitionBy("documento_proveedor", "nit_entidad").orderBy("dia")
    act = act.withColumn("antes", F.coalesce(F.lag("activos").over(w1p), F.lit(0)))
    chg = act.select("documento_proveedor", "dia",
                     (F.when(F.col("activos") > 0, 1).otherwise(0)
                      - F.when(F.col("antes") > 0, 1).otherwise(0)).alias("de"))
    chg = chg.groupBy("documento_proveedor", "dia").agg(F.sum("de").alias("de")).where(F.col("de") != 0)
    w2 = Window.partitionBy("documento_proveedor").orderBy("dia").rowsBetween(Window.unboundedPreceding, 0)
    run = chg.withColumn("entidades", F.sum("de").over(w2))
    return (run.groupBy("documento_proveedor")
               .agg(F.max("entidades").alias("max_entidades"),
                    F.min(F.when(F.col("entidades") >= min_entities, F.col("dia"))).alias("desde"))
               .where(F.col("max_entidades") >= min_entities))


def advance_risk(c: DataFrame, min_advance_share: str = "0.05", max_paid_share: str = "0.1") -> DataFrame:
    """XA advance payment above a share of the value while little is paid
    (exact decimal comparisons, map-only)."""
    a, pd_ = Decimal(min_advance_share), Decimal(max_paid_share)
    return (c.where((F.col("valor_de_pago_adelantado") > _v() * F.lit(a))
                    & (F.coalesce("valor_pagado", F.lit(0)) < _v() * F.lit(pd_)))
             .select("id_contrato", "nit_entidad", "documento_proveedor", "valor_del_contrato",
                     "valor_de_pago_adelantado", "valor_pagado"))


def watchlist_activity(c: DataFrame, a: DataFrame, watch: DataFrame, key: str = "nit_entidad") -> DataFrame:
    """XW contracts and alerts of the ids on a watchlist (left-semi joins;
    the watchlist size is not assumed bounded, so AQE picks the strategy)."""
    cc = (c.join(watch, key, "left_semi").groupBy(key)
           .agg(F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor")))
    aa = a.join(watch, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("alertas"))
    return cc.join(aa, key, "left").withColumn("alertas", F.coalesce("alertas", F.lit(0)).cast("bigint"))


def calendar_markers(c: DataFrame, days_before: int = 30) -> DataFrame:
    """XM daily series with a year-end marker: each day gets the number of
    days to the end of its year and a 'cierre de vigencia' label in the last
    ``days_before`` days (an equi-join on year with a one-row-per-year
    calendar derived from the data, not a range join)."""
    d = (c.groupBy(F.to_date("fecha_de_firma").alias("dia"))
          .agg(F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor")))
    cal = d.select(F.year("dia").alias("anio")).distinct() \
           .withColumn("cierre", F.make_date(F.col("anio"), F.lit(12), F.lit(31)))
    j = d.withColumn("anio", F.year("dia")).join(cal, "anio")
    falta = F.datediff(F.col("cierre"), F.col("dia"))
    return (j.withColumn("dias_al_cierre", falta)
             .withColumn("marcador", F.when(falta < days_before, F.lit("cierre de vigencia")))
             .drop("anio", "cierre"))


def period_effects(c: DataFrame, periods: DataFrame, around_days: int = 30, bucket_days: int = 16) -> DataFrame:
    """XM contracts before, during and after marked periods (``marca``,
    ``desde``, ``hasta`` exclusive; periods may overlap): a range join of days
    to periods without an equal key. Contracts are summed per day first; each
    period's three spans are cut at time buckets, days and spans meet in their
    bucket only and are compared there. Spans without contracts count 0; an
    empty or reversed period has no 'durante'."""
    days = (c.groupBy(F.to_date("fecha_de_firma").alias("dia"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("v"))
             .withColumn("_b", F.floor(F.unix_date("dia") / bucket_days)))
    d, h = F.col("desde"), F.col("hasta")
    spans = periods.where(d.isNotNull() & h.isNotNull()).select(
        "marca", "desde", "hasta", F.explode(F.array(
            F.struct(F.lit("antes").alias("fase"), F.date_sub(d, around_days).alias("a"), d.alias("b")),
            F.struct(F.lit("durante").alias("fase"), d.alias("a"), h.alias("b")),
            F.struct(F.lit("despues").alias("fase"), h.alias("a"), F.date_add(h, around_days).alias("b")))).alias("s")
    ).select("marca", "desde", "hasta", "s.*").where(F.col("a") < F.col("b"))
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.unix_date("a") / bucket_days),
                                                 F.floor(F.unix_date(F.date_sub("b", 1)) / bucket_days))).alias("_b"))
    hits = (cut.join(days, "_b").where((F.col("dia") >= F.col("a")) & (F.col("dia") < F.col("b")))
               .groupBy("marca", "desde", "hasta", "fase").agg(F.sum("n").alias("_n"), F.sum("v").alias("_v")))
    return (spans.join(hits, ["marca", "desde", "hasta", "fase"], "left")
                 .select("marca", "desde", "hasta", "fase", F.datediff("b", "a").alias("dias"),
                         F.coalesce("_n", F.lit(0)).alias("contratos"), F.coalesce("_v", F.lit(0)).alias("valor")))


def supplier_growth(c: DataFrame) -> DataFrame:
    """XG supplier billing growth year over year (previous calendar year
    only; a gap year gives NULL)."""
    y = (c.where(F.col("documento_proveedor").isNotNull())
          .groupBy("documento_proveedor", "anio").agg(F.sum(_v()).alias("total")))
    w = Window.partitionBy("documento_proveedor").orderBy("anio")
    prev_y, prev_t = F.lag("anio").over(w), F.lag("total").over(w)
    y = y.withColumn("_py", prev_y).withColumn("_pt", prev_t)
    return y.withColumn("crecimiento", F.when(F.col("_py") == F.col("anio") - 1,
                                              F.col("total").cast("double") / F.col("_pt").cast("double"))) \
            .drop("_py", "_pt")


def peer_rank(c: DataFrame, peer_col: str = "sector") -> DataFrame:
    """XG buyer's yearly value as a percentile rank among its peers (same
    sector and year), read off a histogram of the buyer-year totals."""
    g = (c.where(F.col("nit_entidad").isNotNull())
          .groupBy(peer_col, "anio", "nit_entidad").agg(F.sum(_v()).alias("valor")))
    return with_percent_rank(reuse(g), "valor", [peer_col, "anio"])


def lightning(c: DataFrame, p: float = 0.05) -> DataFrame:
    """X07 contracts whose planned duration is in the lowest p-quantile of
    their modality (exact quantile per modality, joined back on modality)."""
    dur = c.where(F.col("modalidad_de_contratacion").isNotNull()).withColumn(
        "dias", F.datediff(F.col("fecha_de_fin_del_contrato"), F.col("fecha_de_inicio_del_contrato")))
    dur = dur.where(F.col("dias") >= 0)
    q = exact_quantile(dur, "dias", p, ["modalidad_de_contratacion"], alias="umbral")
    return (dur.join(q, "modalidad_de_contratacion").where(F.col("dias") < F.col("umbral"))
               .select("id_contrato", "modalidad_de_contratacion", "dias", "umbral", "valor_del_contrato"))


_BREAK = "[^\\p{L}\\p{N}]+"
#: Weights are kept in whole millionths, so that sums don't depend on order.
WEIGHT_UNIT = 1_000_000


def words_of(col: str) -> Column:
    """The distinct words (letters and digits) of a text, lower-cased."""
    return F.array_distinct(F.array_remove(F.split(F.lower(col), _BREAK), ""))


def term_weights(c: DataFrame) -> DataFrame:
    """XV (tipo, termino, n, peso): how specific a word is among the objects
    of its contract type: the logarithm of objects per object with the word,
    in millionths. A table to keep: it is learned from all contracts once and
    applied to any."""
    w = words_of("objeto_del_contrato")
    # equal texts are counted once with their number, before they are cut into words
    texts = (c.where(F.col("objeto_del_contrato").isNotNull())
              .groupBy(F.coalesce("tipo_de_contrato", F.lit("")).alias("tipo"), "objeto_del_contrato")
              .agg(F.count(F.lit(1)).alias("c")))
    terms = texts.select("tipo", "c", F.explode(w).alias("termino")).groupBy("tipo", "termino").agg(F.sum("c").alias("n"))
    sizes = texts.groupBy("tipo").agg(F.sum("c").alias("objetos"))
    weight = F.round(F.log(F.col("objetos").cast("double") / F.col("n").cast("double")) * WEIGHT_UNIT).cast("long")
    return terms.join(sizes, "tipo").select("tipo", "termino", "n", weight.alias("peso"))


def specificity(c: DataFrame, weights: DataFrame) -> DataFrame:
    """XV (tipo, objeto, contratos, palabras, especificidad): mean weight of
    an object's words; 0 is a text of words that every object of its type
    has. A word that the table does not know weighs as much as the type's
    rarest one. A text without words scores 0."""
    texts = (c.where(F.col("objeto_del_contrato").isNotNull())
              .groupBy(F.coalesce("tipo_de_contrato", F.lit("")).alias("tipo"), F.col("objeto_del_contrato").alias("objeto"))
              .agg(F.count(F.lit(1)).alias("contratos")).withColumn("_w", words_of("objeto")))
    most = weights.groupBy("tipo").agg(F.max("peso").alias("_most"))
    # one row per word; outer, so that a text without words stays
    words = (texts.select("tipo", "objeto", "contratos", F.size("_w").cast("long").alias("palabras"),
                          F.explode_outer("_w").alias("termino"))
                  .join(weights.select("tipo", "termino", "peso"), ["tipo", "termino"], "left").join(most, "tipo", "left"))
    weight = F.when(F.col("termino").isNotNull(), F.coalesce("peso", "_most", F.lit(0))).otherwise(0)
    score = words.groupBy("tipo", "objeto", "contratos", "palabras").agg(F.sum(weight).cast("double").alias("_sum"))
    mean = F.col("_sum") / F.greatest(F.col("palabras"), F.lit(1)).cast("double") / float(WEIGHT_UNIT)
    return score.select("tipo", "objeto", "contratos", "palabras", mean.alias("especificidad"))


def vague_buyers(c: DataFrame, weights: DataFrame, below: float) -> DataFrame:
    """XV per buyer: contracts with an object text, how many of them are less
    specific than ``below``, and the value of those."""
    s = specificity(c, weights).where(F.col("especificidad") < below).select(
        "tipo", F.col("objeto").alias("objeto_del_contrato"), F.lit(1).alias("_vago"))
    rows = (c.where(F.col("objeto_del_contrato").isNotNull() & F.col("nit_entidad").isNotNull())
             .groupBy("nit_entidad", F.coalesce("tipo_de_contrato", F.lit("")).alias("tipo"), "objeto_del_contrato")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("valor")))
    v = F.col("_vago").isNotNull()
    return (rows.join(s, ["tipo", "objeto_del_contrato"], "left").groupBy("nit_entidad")
                .agg(F.sum("n").alias("n"), F.sum(F.when(v, F.col("n")).otherwise(0)).alias("n_vagos"),
                     F.coalesce(F.sum(F.when(v, F.col("valor"))), F.lit(0)).alias("valor_vago")))


def vagueness(c: DataFrame, terms: dict[str, int]) -> DataFrame:
    """XV weighted vagueness score of the object text: sum of the weights of
    the ILIKE terms it matches, per contract (map-only)."""
    score = None
    for pat, wgt in terms.items():
        t = F.when(F.col("objeto_del_contrato").ilike(pat), F.lit(wgt)).otherwise(F.lit(0))
        score = t if score is None else score + t
    return c.withColumn("vaguedad", score)


def vagueness_by_entity(c: DataFrame, terms: dict[str, int]) -> DataFrame:
    """XV per buyer: contracts, contracts with a vague object, total score."""
    v = vagueness(c.where(F.col("nit_entidad").isNotNull()), terms)
    return (v.groupBy("nit_entidad")
             .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vaguedad") > 0, 1)).alias("n_vagos"),
                  F.sum("vaguedad").alias("puntaje")))


def contracts_in_periods(c: DataFrame, periods: DataFrame, key: str = "documento_proveedor") -> DataFrame:
    """XS contracts signed while their supplier is inside a period
    [desde, hasta) (sanction, watch): equi-join on the id, then a range
    filter; never a cross join."""
    j = c.join(periods, key)
    f = F.to_date("fecha_de_firma")
    return j.where((f >= F.col("desde")) & (f < F.col("hasta")))


def company_age(c: DataFrame, max_days: int, min_value: int = 0) -> DataFrame:
    """XD contracts signed by a supplier within ``max_days`` of its first
    appearance (company-age proxy), above ``min_value``: one aggregate per
    supplier joined back (no window over a supplier's rows)."""
    first = (c.where(F.col("documento_proveedor").isNotNull())
              .groupBy("documento_proveedor").agg(F.min("fecha_de_firma").alias("primera")))
    j = c.join(first, "documento_proveedor").withColumn(
        "edad_dias", F.datediff(F.col("fecha_de_firma"), F.col("primera")))
    return j.where((F.col("edad_dias") <= max_days) & (F.col("valor_del_contrato") > F.lit(min_value)))


def donor_contracts(c: DataFrame, donations: DataFrame, max_days: int) -> DataFrame:
    """XD contracts whose supplier gave a donation (``donante``, ``fecha``,
    ``monto``) at most ``max_days`` before the signature: the latest one up to
    the day of signature, by as-of join."""
    j = asof_join(c.where(F.col("documento_proveedor").isNotNull()),
                  donations.withColumnRenamed("donante", "documento_proveedor"), "documento_proveedor",
                  "fecha_de_firma", "fecha", {"fecha": "fecha_donacion", "monto": "monto_donacion"})
    days = F.datediff("fecha_de_firma", "fecha_donacion")
    return j.withColumn("dias_desde_donacion", days).where(F.col("dias_desde_donacion") <= max_days)


def ex_official_contracts(c: DataFrame, posts: DataFrame, max_days: int) -> DataFrame:
    """XD contracts whose supplier left a public post (``persona``, ``fin``,
    ``cargo``) less than ``max_days`` before: the latest post that ended
    strictly before the signature, by as-of join."""
    j = asof_join(c.where(F.col("documento_proveedor").isNotNull()),
                  posts.withColumnRenamed("persona", "documento_proveedor"), "documento_proveedor",
                  "fecha_de_firma", "fin", {"fin": "fin_cargo", "cargo": "cargo"}, strict=True)
    days = F.datediff("fecha_de_firma", "fin_cargo")
    return j.withColumn("dias_desde_cargo", days).where(F.col("dias_desde_cargo") < max_days)


def loser_winner_pairs(c: DataFrame, min_together: int = 2) -> DataFrame:
    """XR suppliers that keep appearing beside the same winner: per process
    the winner is the supplier of the largest award (``max(struct)``, a
    sort-based aggregate over process totals); every other participant gets one (loser, winner) edge, so a
    process with k participants emits k-1 rows, never all pairs. Pairs seen
    in at least ``min_together`` processes, with the share of the loser's
    processes that the winner took (``confianza``), the share of all lost
    participations that stand beside the pair (``soporte``), and how many
    times ``confianza`` exceeds the winner's share of all of them (``lift``;
    1 = as often as for any loser). The total is a scalar subquery."""
    part = (c.where(F.col("documento_proveedor").isNotNull() & F.col("proceso_de_compra").isNotNull())
             .groupBy("proceso_de_compra", "documento_proveedor").agg(F.sum(_v()).alias("v")))
    win = (part.groupBy("proceso_de_compra")
               .agg(F.max(F.struct("v", "documento_proveedor")).alias("w"), F.count(F.lit(1)).alias("k"))
               .where(F.col("k") >= 2)
               .select("proceso_de_compra", F.col("w.documento_proveedor").alias("ganador")))
    lost = (part.join(win, "proceso_de_compra").where(F.col("documento_proveedor") != F.col("ganador"))
                .select(F.col("documento_proveedor").alias("perdedor"), "ganador", "proceso_de_compra"))
    pairs = lost.groupBy("perdedor", "ganador").agg(F.count(F.lit(1)).alias("juntos"))
    n_lost = pairs.groupBy("perdedor").agg(F.sum("juntos").alias("derrotas"))
    n_won = pairs.groupBy("ganador").agg(F.sum("juntos").alias("victorias"))
    total = pairs.agg(F.sum("juntos").cast("double")).scalar()
    share = F.col("juntos").cast("double") / F.col("derrotas").cast("double")
    return (pairs.where(F.col("juntos") >= min_together).join(n_lost, "perdedor").join(n_won, "ganador")
                 .select("perdedor", "ganador", "juntos", "derrotas", share.alias("confianza"),
                         (F.col("juntos").cast("double") / total).alias("soporte"),
                         ((F.col("juntos").cast("double") * total)
                          / (F.col("derrotas") * F.col("victorias")).cast("double")).alias("lift")))
