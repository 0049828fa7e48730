from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veeduria.session import ensure_checkpoint_dir, get_spark

    s = get_spark("local[*]", app="veeduria-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    ensure_checkpoint_dir(s)
    yield s


BASE_ROW = dict(
    id_contrato="C-1", proceso_de_compra="P-1", nombre_entidad="ALCALDIA UNO", nit_entidad="900100",
    codigo_entidad=None, departamento="Meta", ciudad=None, orden=None, sector=None, rama=None,
    estado_contrato=None, tipo_de_contrato="Suministro", modalidad_de_contratacion="Contratación directa",
    justificacion_modalidad_de=None, objeto_del_contrato="Compra de equipos",
    fecha_de_firma=dt.datetime(2024, 1, 15), fecha_de_inicio_del_contrato=dt.datetime(2024, 1, 15),
    fecha_de_fin_del_contrato=dt.datetime(2024, 6, 15), tipodocproveedor="NIT",
    documento_proveedor="800200", codigo_proveedor=None, proveedor_adjudicado="EMPRESA DOS",
    nombre_representante_legal=None, identificaci_n_representante_legal=None, es_pyme=None,
    valor_del_contrato=Decimal("1000000"), valor_pagado=Decimal("0"), valor_de_pago_adelantado=Decimal("0"),
    dias_adicionados=0,
)


def make_contracts(spark, rows):
    """Typed contract rows (defaults from BASE_ROW) -> clean contract table
    with the published default parameters."""
    from veeduria.operators.derive import derive
    from veeduria.schema import CONTRACT

    full = []
    for i, r in enumerate(rows):
        d = dict(BASE_ROW)
        d["id_contrato"] = f"C-{i}"
        d.update(r)   # an explicit id_contrato (also None) wins
        for k in ("valor_del_contrato", "valor_pagado", "valor_de_pago_adelantado"):
            if d[k] is not None:
                d[k] = Decimal(str(d[k])).quantize(Decimal("0.01"))
        full.append(tuple(d[f.name] for f in CONTRACT.fields))
    return derive(spark.createDataFrame(full, CONTRACT))


@pytest.fixture
def contracts(spark):
    return lambda rows: make_contracts(spark, rows)
