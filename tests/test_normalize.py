"""Landed-record cleaning cases (FIXTURES.md §1)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veeduria.operators.derive import derive
from veeduria.operators.normalize import dedupe, normalize
from veeduria.sources import landed as L

REC = {
    "id_contrato": "C-0001", "proceso_de_compra": "P-0001", "nit_entidad": " 900100-7 ",
    "nombre_entidad": " Alcaldía Uno** ", "departamento": "Meta",
    "tipo_de_contrato": "Prestación de servicios", "modalidad_de_contratacion": "Contratación directa",
    "objeto_del_contrato": "Apoyo a la gestión", "fecha_de_firma": "2024-01-15T00:00:00.000",
    "fecha_de_inicio_del_contrato": "2024-01-15T00:00:00.000", "fecha_de_fin_del_contrato": "2024-07-15T00:00:00.000",
    "tipodocproveedor": "Cédula de Ciudadanía", "documento_proveedor": "800200-1",
    "proveedor_adjudicado": " empresa dos ", "valor_del_contrato": "600000000", "valor_pagado": "0",
    "valor_de_pago_adelantado": "0", "dias_adicionados": "180",
}


def land(tmp_path, spark, records, multi_line=False):
    p = tmp_path / "landed"
    p.mkdir()
    if multi_line:
        (p / "page-0.json").write_text(json.dumps(records), encoding="utf-8")
    else:
        (p / "page-0.json").write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
    return L.read_landed_json(spark, str(p), multi_line)


def test_normalises_ids_names_types(tmp_path, spark):
    recs = [REC,
            dict(REC, id_contrato="C-0002", nit_entidad="123 - 4", nombre_entidad="\tDEPARTAMENTO DE ANTIOQUIA//\t",
                 documento_proveedor=None, modalidad_de_contratacion="REGIMEN ESPECIAL", fecha_de_firma="n/a"),
            dict(REC, id_contrato="C-0003", nit_entidad="900100", valor_del_contrato="x",
                 modalidad_de_contratacion=None),
            dict(REC, id_contrato="C-0004", valor_del_contrato="0")]
    n = normalize(land(tmp_path, spark, recs)).orderBy("id_contrato").collect()
    assert [r.nit_entidad for r in n] == ["900100", "123", "900100", "900100"]
    assert n[0].nombre_entidad == "ALCALDÍA UNO" and n[0].proveedor_adjudicado == "EMPRESA DOS"
    assert n[1].nombre_entidad == "DEPARTAMENTO DE ANTIOQUIA//"
    assert n[0].documento_proveedor == "800200" and n[1].documento_proveedor is None
    assert str(n[0].valor_del_contrato) == "600000000.00" and n[0].dias_adicionados == 180
    assert n[1].fecha_de_firma is None and n[2].valor_del_contrato is None
    assert n[0].es_pyme is None                       # field absent from every record


def test_derived_columns_and_clean_filter(tmp_path, spark):
    recs = [REC, dict(REC, id_contrato="C-2", modalidad_de_contratacion="REGIMEN ESPECIAL"),
            dict(REC, id_contrato="C-3", modalidad_de_contratacion=None),
            dict(REC, id_contrato="C-4", fecha_de_firma="n/a"), dict(REC, id_contrato="C-5", valor_del_contrato="0"),
            dict(REC, id_contrato="C-6", tipodocproveedor="NIT")]
    c = derive(normalize(land(tmp_path, spark, recs))).orderBy("id_contrato").collect()
    assert [r.id_contrato for r in c] == ["C-0001", "C-2", "C-3", "C-6"]
    assert [r.es_sin_competencia for r in c] == [True, True, None, True]
    assert [r.es_persona_natural for r in c] == [True, True, True, False]
    assert c[0].anio == 2024 and c[0].mes == 1 and str(c[0].mes_firma) == "2024-01-01"


def test_json_array_pages(tmp_path, spark):
    df = land(tmp_path, spark, [REC, dict(REC, id_contrato="C-9")], multi_line=True)
    assert df.count() == 2


def test_dedupe_keeps_latest(tmp_path, spark):
    recs = [REC, dict(REC, fecha_de_firma="2024-02-01T00:00:00.000", valor_del_contrato="5")]
    d = dedupe(normalize(land(tmp_path, spark, recs))).collect()
    assert len(d) == 1 and str(d[0].fecha_de_firma) == "2024-02-01 00:00:00"


def test_windows_and_range_edges(tmp_path, spark):
    recs = [dict(REC, id_contrato="a", fecha_de_firma="2024-01-31T23:59:59.000"),
            dict(REC, id_contrato="b", fecha_de_firma="2024-02-01T00:00:00.000"),
            dict(REC, id_contrato="c", fecha_de_firma="2024-03-10T00:00:00.000")]
    c = derive(normalize(land(tmp_path, spark, recs)))
    w = [(str(r.start), str(r.end)) for r in L.month_windows(c, desde="2024-01-20").orderBy("start").collect()]
    assert w == [("2024-01-20", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-04-01")]
    ids = sorted(r.id_contrato for r in L.date_range(c, "2024-02-01", "2024-03-01").collect())
    assert ids == ["b"]
    latest = [r.id_contrato for r in L.latest(c, 2).collect()]
    assert latest == ["c", "b"]


def test_parameterised_sql(spark, contracts):
    contracts([{}, dict(nombre_entidad="OTRA")]).createOrReplaceTempView("contratos_clean")
    r = L.sql(spark, "SELECT count(*) AS n FROM contratos_clean WHERE nombre_entidad = :e", e="OTRA").collect()
    assert r[0].n == 1
    # user text is a bound literal, never spliced into the statement
    r = L.sql(spark, "SELECT count(*) AS n FROM contratos_clean WHERE nombre_entidad = :e",
              e="x' OR '1'='1").collect()
    assert r[0].n == 0


def test_strip_all_whitespace(spark):
    from veeduria.functions.text import clean_supplier_name
    r = spark.createDataFrame([("\n\t acme  ",)], "s string").select(clean_supplier_name("s").alias("x")).first()
    assert r.x == "ACME"
    r = spark.createDataFrame([("   ",)], "s string").select(clean_supplier_name(F.col("s")).alias("x")).first()
    assert r.x is None


def test_dedupe_hot_key_and_null_ids(contracts):
    import datetime as dt
    rows = [dict(id_contrato="HOT", fecha_de_firma=dt.datetime(2024, 1, 1 + i % 28), valor_del_contrato=1000 + i)
            for i in range(300)]
    rows += [dict(id_contrato=None, valor_del_contrato=5), dict(id_contrato=None, valor_del_contrato=6)]
    c = contracts(rows)
    d = dedupe(c).collect()
    hot = [r for r in d if r.id_contrato == "HOT"]
    assert len(hot) == 1 and hot[0].fecha_de_firma == dt.datetime(2024, 1, 28)
    assert str(hot[0].valor_del_contrato) == "1279.00"        # latest date (i = 27 mod 28), then largest value
    assert sorted(str(r.valor_del_contrato) for r in d if r.id_contrato is None) == ["5.00", "6.00"]
