"""Explicit schemas: landed contract record, clean contract, alert, score."""

from __future__ import annotations

from pyspark.sql import types as T

# The 29 kept columns of a contract record, in source order.
CONTRACT_COLUMNS = [
    "id_contrato", "proceso_de_compra", "nombre_entidad", "nit_entidad", "codigo_entidad",
    "departamento", "ciudad", "orden", "sector", "rama", "estado_contrato", "tipo_de_contrato",
    "modalidad_de_contratacion", "justificacion_modalidad_de", "objeto_del_contrato",
    "fecha_de_firma", "fecha_de_inicio_del_contrato", "fecha_de_fin_del_contrato",
    "tipodocproveedor", "documento_proveedor", "codigo_proveedor", "proveedor_adjudicado",
    "nombre_representante_legal", "identificaci_n_representante_legal", "es_pyme",
    "valor_del_contrato", "valor_pagado", "valor_de_pago_adelantado", "dias_adicionados",
]
MONEY_COLUMNS = ["valor_del_contrato", "valor_pagado", "valor_de_pago_adelantado"]
INT_COLUMNS = ["dias_adicionados"]
DATE_COLUMNS = ["fecha_de_firma", "fecha_de_inicio_del_contrato", "fecha_de_fin_del_contrato"]

MONEY = T.DecimalType(20, 2)

# Landed record: every value is text (the portal serves JSON strings).
LANDED_CONTRACT = T.StructType([T.StructField(c, T.StringType(), True) for c in CONTRACT_COLUMNS])


def _typed(c: str) -> T.DataType:
    if c in MONEY_COLUMNS:
        return MONEY
    if c in INT_COLUMNS:
        return T.IntegerType()
    if c in DATE_COLUMNS:
        return T.TimestampNTZType()
    return T.StringType()


# Normalised contract table (what ``normalize`` returns for landed records).
CONTRACT = T.StructType([T.StructField(c, _typed(c), True) for c in CONTRACT_COLUMNS])

ALERT_COLUMNS = ["codigo", "bandera", "nivel", "nombre_entidad", "nit_entidad", "proveedor",
                 "documento_proveedor", "id_contrato", "anio", "detalle", "valor_cop", "severidad"]

ALERT = T.StructType([
    T.StructField("codigo", T.StringType(), False),
    T.StructField("bandera", T.StringType(), False),
    T.StructField("nivel", T.StringType(), False),
    T.StructField("nombre_entidad", T.StringType(), True),
    T.StructField("nit_entidad", T.StringType(), True),
    T.StructField("proveedor", T.StringType(), True),
    T.StructField("documento_proveedor", T.StringType(), True),
    T.StructField("id_contrato", T.StringType(), True),
    T.StructField("anio", T.IntegerType(), True),
    T.StructField("detalle", T.StringType(), True),
    T.StructField("valor_cop", T.DecimalType(38, 4), True),
    T.StructField("severidad", T.IntegerType(), False),
])

SCORE_COLUMNS = ["key", "label", "score", "raw_score", "n_alertas", "valor_bajo_alerta", "banderas"]
