"""Incremental alerts against a full run; dossier evidence per flag."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from veeduria.operators import dossier as D
from veeduria.operators import flags as FL
from veeduria.operators.derive import derive
from veeduria.operators.normalize import normalize
from veeduria.params import Params
from veeduria.schema import LANDED_CONTRACT
from veeduria.streaming import flags_refresh as FR

SMALL = Params(f01_min_contracts=2, f01_min_value=0, f02_min_value=0, f02_factor=2, f04_min_value=0, f04_min_contracts=1,
               f08_min_value=0, f08_min_contracts=1, f10_min_days=10, f10_min_value=0)


def _landed(i, **kw):
    return dict(id_contrato=f"C-{i}", nombre_entidad="AAA", nit_entidad="900", documento_proveedor="800",
                proveedor_adjudicado="EMPRESA", modalidad_de_contratacion="Contratación directa",
                objeto_del_contrato="Compra", fecha_de_firma="2023-02-01T00:00:00.000",
                valor_del_contrato="1000000", dias_adicionados="0") | kw


def test_relanded_and_renamed_records_equal_a_full_run(spark, tmp_path):
    first = [_landed(i) for i in range(5)] + [_landed(5, dias_adicionados="30"), _landed(6, dias_adicionados="30"),
                                              _landed(7, fecha_de_firma="2021-01-01T00:00:00.000")]
    second = [*first[:3],                                                    # the same page again
              _landed(5, dias_adicionados="0"),                              # no longer extended
              _landed(6, valor_del_contrato="0"),                            # no longer a contract
              _landed(7, fecha_de_firma="2022-01-01T00:00:00.000"),          # another year
              _landed(8, nombre_entidad="ZZZ", fecha_de_firma="2024-03-01T00:00:00.000")]
    landed, out, ckpt = (str(tmp_path / x) for x in ("landed", "out", "ckpt"))
    for n, page in enumerate((first, second)):
        folder = tmp_path / "landed" / f"page={n}"
        folder.mkdir(parents=True)
        (folder / "p.json").write_text("\n".join(json.dumps(r) for r in page))
        got = FR.run_refresh(spark, landed, out, ckpt, SMALL)
    last = {r["id_contrato"]: r for r in first + second}
    (tmp_path / "all.json").write_text("\n".join(json.dumps(r) for r in last.values()))
    full = FL.run_flags(derive(normalize(spark.read.schema(LANDED_CONTRACT).json(str(tmp_path / "all.json"))), SMALL), SMALL)
    want = sorted(map(str, full.collect()))
    assert sorted(map(str, got.select(full.columns).collect())) == want
    assert any("ZZZ" in x and "2023" in x for x in want) and not any("F10" in x for x in want)


def _alert(spark, code, nit=None, doc=None, cid=None, year=2024, detail="x"):
    return spark.createDataFrame([(1, code, nit, doc, cid, year, detail)],
                                 "rank int, codigo string, nit_entidad string, documento_proveedor string,"
                                 " id_contrato string, anio int, detalle string")


def test_exact_evidence_is_what_raised_the_alert(spark, contracts):
    day = dt.datetime
    ops = dict(tipodocproveedor="Cédula de Ciudadanía", tipo_de_contrato="Prestación de servicios")
    c = contracts([dict(ops, fecha_de_firma=day(2023, 5, 1)), dict(ops, fecha_de_firma=day(2024, 5, 1)),
                   dict(fecha_de_firma=day(2024, 12, 9)), dict(fecha_de_firma=day(2024, 11, 9)),
                   dict(nit_entidad=None, documento_proveedor=None, dias_adicionados=900,
                        valor_del_contrato=9_000_000_000)])

    def ids(alert, mode="exact", **kw):
        return sorted(r.id_contrato for r in D.evidence(c, alert, mode=mode, **kw).collect())

    f06 = _alert(spark, "F06", doc="800200")
    assert ids(f06) == ["C-1"]
    assert ids(f06, "keys") == ["C-0", "C-1", "C-2", "C-3"]           # published: all years of the supplier
    f03 = _alert(spark, "F03", nit="900100", detail="9 contratos firmados en 2024-12 vs media mensual de 1.0 (z=4.0)")
    assert ids(f03) == ["C-2"]
    assert ids(f03, "keys") == ["C-1", "C-2", "C-3"]
    assert ids(_alert(spark, "F10", cid="C-4")) == ["C-4"]
    assert ids(_alert(spark, "F10", cid="C-4"), codes=["F04"]) == []
    whole = D.evidence(c.withColumn("objeto_del_contrato", F.lit("x" * 200)), f03, mode="exact", object_chars=None)
    assert len(whole.first().objeto) == 200
