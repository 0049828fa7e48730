"""Cleaning: schema alignment, coercion, identity normalisation, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.functions.text import clean_entity_name, clean_id, clean_supplier_name
from veeduria.schema import CONTRACT, CONTRACT_COLUMNS


def align(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Add absent contract columns as NULL and fix the column order; the
    columns ``also`` stay behind them."""
    have = set(df.columns)
    cols = []
    for f in CONTRACT.fields:
        if f.name in have:
            cols.append(F.col(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *also)


def coerce(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Text money, day counts and dates to typed values; bad text
    becomes NULL (``try_cast``), already-typed columns and those in ``also``
    are kept exact."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in CONTRACT.fields:
        c = F.col(f.name)
        if isinstance(types.get(f.name), T.StringType) and not isinstance(f.dataType, T.StringType):
            if isinstance(f.dataType, T.TimestampNTZType):
                # ISO text with a 'T' separator and optional millis
                c = F.replace(F.trim(c), F.lit("T"), F.lit(" ")).try_cast(f.dataType)
            elif isinstance(f.dataType, T.IntegerType):
                # "180" or "180.0": go through decimal, then to int
                c = F.trim(c).try_cast("decimal(20,2)").try_cast("int")
            else:
                c = F.trim(c).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out, *also)


IDENTITIES = {"nit_entidad": clean_id, "documento_proveedor": clean_id, "nombre_entidad": clean_entity_name,
              "proveedor_adjudicado": clean_supplier_name}


def clean_identities(df: DataFrame) -> DataFrame:
    """Ids without check digit, names stripped and upper-cased."""
    return df.withColumns({c: clean(c) for c, clean in IDENTITIES.items()})


def normalize(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Landed or bound records -> normalised contract table (29 columns, and
    those in ``also`` as they are)."""
    return clean_identities(coerce(align(df, also), also))


DEDUPE_ORDER = ("fecha_de_firma", "valor_del_contrato", "documento_proveedor", "nit_entidad",
                "objeto_del_contrato", "modalidad_de_contratacion", "fecha_de_fin_del_contrato")


def dedupe(df: DataFrame, key: str = "id_contrato", order: tuple[str, ...] = DEDUPE_ORDER) -> DataFrame:
    """Keep one row per ``key``: latest signature date, then largest value,
    then the remaining order columns, then all other columns (deterministic).

    Keys are counted first (a hash aggregate over the key column alone). Rows
    whose key occurs once pass through: with few repeated keys AQE broadcasts
    those, and the facts are neither shuffled nor sorted. Only rows of
    repeated keys are reduced, by ``max(struct(order..., rest...))``: a
    sort-based aggregate with a map-side partial step, so a key repeated by a
    third of all rows shrinks inside each task before the shuffle (a
    ``row_number`` window would sort all of them in one task). ``max`` over a
    struct orders NULL lowest, which is "descending, NULLs last". Rows
    without a key are not duplicates of each other and pass through
    unchanged.
    """
    cols = df.columns
    rest = [c for c in cols if c not in order and c != key]
    repeated = df.groupBy(F.col(key).alias("_rep")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and _rep is not null")
    marked = df.join(repeated.select("_rep"), F.col(key) == F.col("_rep"), "left")
    m = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_m")
    kept = (marked.where(F.col("_rep").isNotNull()).groupBy(key).agg(m)
                  .select(key, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)]))
    return kept.select(*cols).unionByName(marked.where(F.col("_rep").isNull()).select(*cols))


__all__ = ["align", "coerce", "clean_identities", "normalize", "dedupe", "CONTRACT_COLUMNS"]
