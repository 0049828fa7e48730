"""DuckDB SQL text for the correctness oracle.

Mirrors the binding, normalisation and derived columns in plain SQL so that
each catalogue query can be checked against an independent engine. Output
columns are presented the same way as ``present`` does on the Spark side
(decimals as DOUBLE, dates as text, arrays as sorted joined text).
"""

from __future__ import annotations

from veeduria.params import FLAG_LEVELS, FLAG_NAMES, FLAG_SEVERITY, Params
from veeduria.sources.bindings import REP_SUPPLIERS, Binding

def _ws() -> str:
    from veeduria.functions.text import WHITESPACE
    return " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


WS = f"({_ws()})"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean_id(x: str) -> str:
    return f"NULLIF({strip(f'split_part({strip(x)}, {q(chr(45))}, 1)')}, '')"


def txt(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '?')"


def millions(x: str) -> str:
    return f"CAST(round({x} / 1000000) AS BIGINT)"


def fixed(x: str, d: int) -> str:
    k = f"{float(10 ** d)}"
    return txt(f"CAST(round(({x}) * {k}) / {k} AS DECIMAL(38,{d}))")


def rnd(x: str, d: int) -> str:
    """Engine-stable round of a double (see fmt.round_half)."""
    k = f"{float(10 ** d)}"
    return f"(round(({x}) * {k}) / {k})"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def units(x: str) -> str:
    return f"CAST(({x}) * 10000 AS HUGEINT)"


def hhi_of(sq: str, total: str) -> str:
    t = f"CAST({units(total)} AS DOUBLE)"
    return f"(CAST({sq} AS DOUBLE) / ({t} * {t}))"


def ilike_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"{col} ILIKE {q(p)}" for p in patterns) + ")"


def _raw_id(prefix: str, key: str) -> str:
    s = f"CAST({key} AS VARCHAR)"
    return f"{q(prefix)} || {s} || '-' || right({s}, 1)"


def raw_contracts_sql(b: Binding) -> str:
    if b.entity == "nation":
        nit, name, orden, cod = _raw_id("N", "n_nationkey"), "n_name", "'Nacional'", "CAST(n_nationkey AS VARCHAR)"
    else:
        nit, name, orden, cod = _raw_id("C", "c_custkey"), "c_name", "'Territorial'", "CAST(c_custkey AS VARCHAR)"
    if b.supplier == "supplier":
        doc, prov, codp = _raw_id("S", "s_suppkey"), "s_name", "CAST(s_suppkey AS VARCHAR)"
        tipodoc, rep = q("Cédula de Ciudadanía"), "s_suppkey"
    else:
        doc, prov, codp = _raw_id("C", "c_custkey"), "c_name", "CAST(c_custkey AS VARCHAR)"
        tipodoc = f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN {q('Cédula de Ciudadanía')} ELSE 'NIT' END"
        rep = "c_custkey"
    value = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
    return f"""SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id_contrato,
    CAST(l_orderkey AS VARCHAR) AS proceso_de_compra,
    {name} AS nombre_entidad, {nit} AS nit_entidad, {cod} AS codigo_entidad,
    r_name AS departamento, n_name AS ciudad, {orden} AS orden, c_mktsegment AS sector,
    CAST(NULL AS VARCHAR) AS rama, o_orderstatus AS estado_contrato, p_type AS tipo_de_contrato,
    o_orderpriority AS modalidad_de_contratacion, CAST(NULL AS VARCHAR) AS justificacion_modalidad_de,
    p_name || ' ' || p_type AS objeto_del_contrato,
    o_orderdate AS fecha_de_firma, o_orderdate AS fecha_de_inicio_del_contrato,
    l_shipdate AS fecha_de_fin_del_contrato,
    {tipodoc} AS tipodocproveedor, {doc} AS documento_proveedor, {codp} AS codigo_proveedor,
    {prov} AS proveedor_adjudicado,
    CAST(NULL AS VARCHAR) AS nombre_representante_legal,
    'R' || CAST({rep} // {REP_SUPPLIERS} AS VARCHAR) AS identificaci_n_representante_legal, CAST(NULL AS VARCHAR) AS es_pyme,
    {value} AS valor_del_contrato,
    CASE WHEN l_linestatus = 'F' THEN {value} ELSE CAST(0 AS DECIMAL(18,4)) END AS valor_pagado,
    CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS valor_de_pago_adelantado,
    CAST(datediff('day', o_orderdate, l_shipdate) AS INTEGER) AS dias_adicionados
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey"""


def normalized_sql(src: str) -> str:
    ent = f"NULLIF(upper(rtrim({strip('nombre_entidad')}, '*')), '')"
    sup = f"NULLIF(upper({strip('proveedor_adjudicado')}), '')"
    return (f"SELECT * REPLACE ({clean_id('nit_entidad')} AS nit_entidad, "
            f"{clean_id('documento_proveedor')} AS documento_proveedor, "
            f"{ent} AS nombre_entidad, {sup} AS proveedor_adjudicado) FROM {src}")


def derived_sql(src: str, p: Params) -> str:
    return f"""SELECT *, CAST(year(fecha_de_firma) AS INTEGER) AS anio,
    CAST(month(fecha_de_firma) AS INTEGER) AS mes,
    CAST(date_trunc('month', fecha_de_firma) AS DATE) AS mes_firma,
    {ilike_any('modalidad_de_contratacion', p.non_competitive)} AS es_sin_competencia,
    {ilike_any('tipodocproveedor', p.natural_person)} AS es_persona_natural
  FROM {src}
  WHERE valor_del_contrato IS NOT NULL AND valor_del_contrato > 0 AND fecha_de_firma IS NOT NULL"""


def cte_name(b: Binding) -> str:
    return f"cc_{b.name}"


def ctes(bindings, p: Params) -> str:
    """``raw_x, norm_x, cc_x`` CTE bodies for each binding (no WITH)."""
    parts = []
    for b in dict.fromkeys(bindings):
        parts.append(f"raw_{b.name} AS ({raw_contracts_sql(b)})")
        parts.append(f"norm_{b.name} AS ({normalized_sql('raw_' + b.name)})")
        parts.append(f"{cte_name(b)} AS ({derived_sql('norm_' + b.name, p)})")
    return ",\n".join(parts)


# ----------------------------------------------------------------- flags ---

def _alert_cols(code, *, ne="CAST(NULL AS VARCHAR)", nit="CAST(NULL AS VARCHAR)",
                pr="CAST(NULL AS VARCHAR)", doc="CAST(NULL AS VARCHAR)", idc="CAST(NULL AS VARCHAR)",
                anio, det, val) -> str:
    return (f"{q(code)} AS codigo, {q(FLAG_NAMES[code])} AS bandera, {q(FLAG_LEVELS[code])} AS nivel, "
            f"{ne} AS nombre_entidad, {nit} AS nit_entidad, {pr} AS proveedor, {doc} AS documento_proveedor, "
            f"{idc} AS id_contrato, CAST({anio} AS INTEGER) AS anio, {det} AS detalle, "
            f"CAST({val} AS DECIMAL(38,4)) AS valor_cop, CAST({FLAG_SEVERITY[code]} AS INTEGER) AS severidad")


V = "valor_del_contrato"


def lbl_e(cc: str, outer: str) -> str:
    """Buyer label: largest name over all rows of the id (as entity_labels)."""
    return f"(SELECT max(x.nombre_entidad) FROM {cc} x WHERE x.nit_entidad = {outer}.nit_entidad)"


def lbl_s(cc: str, outer: str) -> str:
    """Supplier label: largest name over all rows of the id."""
    return (f"(SELECT max(x.proveedor_adjudicado) FROM {cc} x"
            f" WHERE x.documento_proveedor = {outer}.documento_proveedor)")


def flag_sql(code: str, cc: str, p: Params) -> str:
    """One flag as a SELECT over the clean contract relation ``cc``."""
    if code == "F01":
        det = (f"{txt('count(*)')} || ' contratos sin competencia con la misma entidad en ' || {txt('anio')}"
               f" || ' que suman $' || {txt(millions(f'sum({V})'))} || 'M'")
        return (f"SELECT {_alert_cols('F01', ne=lbl_e(cc, 't'), nit='t.nit_entidad', pr=lbl_s(cc, 't'), doc='t.documento_proveedor', anio='t.anio', det=det, val=f'sum({V})')}"
                f" FROM {cc} t WHERE es_sin_competencia AND nit_entidad IS NOT NULL AND documento_proveedor IS NOT NULL"
                f" GROUP BY t.nit_entidad, t.documento_proveedor, t.anio"
                f" HAVING count(*) >= {p.f01_min_contracts} AND sum({V}) > {p.f01_min_value}")
    if code == "F02":
        ratio = f"{dbl('a.total')} / {dbl('b.total')}"
        det = (f"'Facturó $' || {txt(millions('a.total'))} || 'M en ' || {txt('a.anio')} || ' vs $' || "
               f"{txt(millions('b.total'))} || 'M el año anterior (' || {fixed(ratio, 1)} || 'x)'")
        y = (f"(SELECT documento_proveedor, anio, sum({V}) AS total"
             f" FROM {cc} WHERE documento_proveedor IS NOT NULL GROUP BY documento_proveedor, anio)")
        return (f"SELECT {_alert_cols('F02', pr=lbl_s(cc, 'a'), doc='a.documento_proveedor', anio='a.anio', det=det, val='a.total')}"
                f" FROM {y} a JOIN {y} b ON a.documento_proveedor = b.documento_proveedor AND a.anio = b.anio + 1"
                f" WHERE a.total > b.total * {p.f02_factor} AND a.total > {p.f02_min_value}")
    if code == "F03":
        from fractions import Fraction
        from decimal import Decimal
        k2 = Fraction(Decimal(str(p.f03_min_z))) ** 2
        m = (f"(SELECT nit_entidad, mes_firma, count(*) AS n, sum({V}) AS total"
             f" FROM {cc} WHERE nit_entidad IS NOT NULL GROUP BY nit_entidad, mes_firma)")
        s = (f"(SELECT *, CAST(count(*) OVER w AS HUGEINT) AS meses, sum(CAST(n AS HUGEINT)) OVER w AS s1,"
             f" sum(CAST(n AS HUGEINT) * CAST(n AS HUGEINT)) OVER w AS s2 FROM {m} WINDOW w AS (PARTITION BY nit_entidad))")
        dev = "(CAST(n AS HUGEINT) * meses - s1)"
        var = "(meses * s2 - s1 * s1)"
        media = f"({dbl('s1')} / {dbl('meses')})"
        sd = f"(sqrt({dbl(var)}) / {dbl('meses')})"
        z = f"(({dbl('n')} - {media}) / {sd})"
        det = (f"{txt('n')} || ' contratos firmados en ' || strftime(mes_firma, '%Y-%m') || ' vs media mensual de ' || "
               f"{fixed(media, 1)} || ' (z=' || {fixed(z, 1)} || ')'")
        return (f"SELECT {_alert_cols('F03', ne=lbl_e(cc, 's'), nit='s.nit_entidad', anio='year(mes_firma)', det=det, val='total')}"
                f" FROM {s} s WHERE meses >= {p.f03_min_months} AND {var} > 0 AND n >= {p.f03_min_contracts}"
                f" AND {dev} >= 0 AND {k2.denominator} * {dev} * {dev} >= {k2.numerator} * {var}")
    if code == "F04":
        by = (f"(SELECT nit_entidad, anio, documento_proveedor, sum({V}) AS v_prov, count(*) AS n_prov"
              f" FROM {cc} WHERE nit_entidad IS NOT NULL"
              f" GROUP BY nit_entidad, anio, documento_proveedor)")
        g = (f"(SELECT nit_entidad, anio, sum({units('v_prov')} * {units('v_prov')}) AS sq, sum(v_prov) AS v_total,"
             f" sum(n_prov) AS n_total FROM {by} GROUP BY nit_entidad, anio)")
        h = f"(SELECT *, {hhi_of('sq', 'v_total')} AS hhi FROM {g})"
        det = (f"'HHI ' || {fixed('hhi', 2)} || ' con ' || {txt('n_total')} || ' contratos por $' || "
               f"{txt(millions('v_total'))} || 'M'")
        return (f"SELECT {_alert_cols('F04', ne=lbl_e(cc, 'h'), nit='h.nit_entidad', anio='anio', det=det, val='v_total')}"
                f" FROM {h} h WHERE hhi > {float(p.f04_min_hhi)} AND n_total >= {p.f04_min_contracts}"
                f" AND v_total > {p.f04_min_value}")
    if code == "F06":
        det = (f"{txt('count(*)')} || ' contratos de prestación de servicios con ' || {txt('count(DISTINCT nit_entidad)')}"
               f" || ' entidades distintas en ' || {txt('anio')} || ' por $' || {txt(millions(f'sum({V})'))} || 'M'")
        return (f"SELECT {_alert_cols('F06', pr=lbl_s(cc, 't'), doc='t.documento_proveedor', anio='t.anio', det=det, val=f'sum({V})')}"
                f" FROM {cc} t WHERE es_persona_natural AND {ilike_any('tipo_de_contrato', p.service)}"
                f" AND documento_proveedor IS NOT NULL GROUP BY t.documento_proveedor, t.anio"
                f" HAVING count(DISTINCT nit_entidad) >= {p.f06_min_entities} AND count(*) >= {p.f06_min_contracts}")
    if code == "F08":
        vnc = f"sum(CASE WHEN es_sin_competencia THEN {V} ELSE 0 END)"
        pct = f"CAST(round(100.0 * {dbl(vnc)} / {dbl(f'sum({V})')}) AS BIGINT)"
        det = (f"{txt(pct)} || '% del valor adjudicado sin competencia (' || {txt('count(*)')} || ' contratos, $' || "
               f"{txt(millions(f'sum({V})'))} || 'M)'")
        return (f"SELECT {_alert_cols('F08', ne=lbl_e(cc, 't'), nit='t.nit_entidad', anio='t.anio', det=det, val=vnc)}"
                f" FROM {cc} t WHERE nit_entidad IS NOT NULL GROUP BY t.nit_entidad, t.anio"
                f" HAVING count(*) >= {p.f08_min_contracts} AND sum({V}) > {p.f08_min_value}"
                f" AND {vnc} > sum({V}) * {p.f08_min_share}")
    row = dict(ne="nombre_entidad", nit="nit_entidad", pr="proveedor_adjudicado", doc="documento_proveedor",
               idc="id_contrato", anio="anio", val=V)
    if code == "F09":
        det = (f"'Contrato ' || {txt('id_contrato')} || ' por $' || {txt(millions(V))} || 'M con objeto genérico: ' || "
               f"{txt(f'left(objeto_del_contrato, {p.detail_object_chars})')}")
        return (f"SELECT {_alert_cols('F09', det=det, **row)} FROM {cc}"
                f" WHERE {V} > {p.f09_min_value} AND {ilike_any('objeto_del_contrato', p.vague)}")
    if code == "F10":
        plazo = "datediff('day', fecha_de_inicio_del_contrato, fecha_de_fin_del_contrato)"
        det = (f"'Contrato ' || {txt('id_contrato')} || ' con ' || {txt('dias_adicionados')} || "
               f"' días adicionados sobre plazo original de ' || {txt(plazo)} || ' días ($' || {txt(millions(V))} || 'M)'")
        return (f"SELECT {_alert_cols('F10', det=det, **row)} FROM {cc}"
                f" WHERE dias_adicionados >= {p.f10_min_days} AND {V} > {p.f10_min_value}")
    raise KeyError(code)
