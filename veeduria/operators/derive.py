"""Derived columns and the clean-row filter (the ``contratos_clean`` view)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.functions.text import ilike_any
from veeduria.params import Params


def is_clean():
    """Positive value and a signature date."""
    v = F.col("valor_del_contrato")
    return v.isNotNull() & (v > 0) & F.col("fecha_de_firma").isNotNull()


def derived(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Year, month, month start (date), and the two boolean predicates
    of every row, clean or not."""
    firma = F.col("fecha_de_firma")
    return (df.withColumn("anio", F.year(firma))
              .withColumn("mes", F.month(firma))
              .withColumn("mes_firma", F.trunc(F.to_date(firma), "month"))
              .withColumn("es_sin_competencia", ilike_any("modalidad_de_contratacion", p.non_competitive))
              .withColumn("es_persona_natural", ilike_any("tipodocproveedor", p.natural_person)))


def derive(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Keep rows with a positive value and a signature date; add year,
    month, month start (date), and the two boolean predicates.

    All expressions are built-ins inside whole-stage codegen; the filter
    reaches the Parquet scan as pushed predicates when the input is a scan.
    """
    return derived(df.where(is_clean()), p)


def is_service(p: Params = Params()):
    """P5: service-contract predicate."""
    return ilike_any("tipo_de_contrato", p.service)


def is_vague(p: Params = Params()):
    """Vague object text predicate."""
    return ilike_any("objeto_del_contrato", p.vague)
