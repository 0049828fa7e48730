"""The contracts written once for a query equal those of each binding's own
plan, and a query of many flags runs the star join once."""

from __future__ import annotations

import datetime as dt

import pytest

from veeduria.operators import scores as S
from veeduria.operators.normalize import normalize
import __spark_entry__  # noqa: F401  (registers every query)
from veeduria.plans import catalog as C
from veeduria.plans import loads_q
from veeduria.plans.context import Context
from veeduria.sources import bindings as B
from veeduria.sources import sinks as K


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Tables with a repeated and a null key on either side of each join."""
    d = str(tmp_path_factory.mktemp("star"))
    day = dt.datetime(1997, 3, 5)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R0")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0* ", 0), (1, "N1", 0), (2, "LOST", 9)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
                     [(1, " c one ", 0, "HOUSEHOLD"), (2, None, 1, "X"), (3, "c3", 2, "X"), (None, "none", 0, "X")]),
        "supplier": ("s_suppkey long, s_name string", [(5, "s five\t"), (6, "s6"), (6, "s6 twice"), (None, "none")]),
        "part": ("p_partkey long, p_name string, p_type string", [(7, "old thing", "PROMO"), (8, None, "LARGE")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(10, 1, "F", day, "1-URGENT"), (11, 2, "O", None, "5-LOW"), (12, 3, "O", day, "2-HIGH"),
                    (10, 2, "O", day, None), (None, 1, "F", day, "1-URGENT")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double,"
                     " l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz",
                     [(k, p, s, i, 1000.0 * i, 0.1, 0.02, "F", day)
                      for i, (k, p, s) in enumerate([(10, 7, 5), (10, 8, 6), (11, 7, 6), (12, 7, 5), (None, 7, 5),
                                                     (10, None, 5), (11, 8, None), (99, 7, 5)])]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("b", [B.Binding(e, s) for e in ("nation", "customer") for s in ("supplier", "customer")])
def test_kept_rows_equal_each_bindings_own(spark, star, b):
    kept = Context(spark, star)
    kept.keep()
    own = normalize(Context(spark, star).raw_contracts(b))
    assert kept.normalized(b).schema.simpleString() == own.schema.simpleString()
    assert _rows(kept.normalized(b)) == _rows(own) and own.count() > 3


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r01_alerts", "r01_alerts_shared", "m13_contract_score", "xw_watchlist",
                                  "r11_geo_all", "r28_departments"])
def test_flags_read_one_written_join(spark, star, name):
    plan = _plan(C.CATALOG[name].build(Context(spark, star)))
    assert "l_orderkey" not in plan, "the star join is planned again"


def test_kept_rows_hold_what_reads_can_not_make_cheaply(spark, star):
    ctx = Context(spark, star)
    ctx.keep()
    assert not {"id_contrato", "objeto_del_contrato", "valor_pagado", "nit_entidad_cliente"} & set(ctx._kept.columns)
    cleaned = B.join_tables(ctx.tables, cleaned=True)._jdf.queryExecution().optimizedPlan().toString()
    trims = [line for line in cleaned.splitlines() if "trim(" in line]
    assert trims and not any("l_suppkey" in line for line in trims), "cleaned per contract"


@pytest.mark.parametrize("score", [S.entity_scores, S.supplier_scores])
def test_scores_read_the_alerts_once(spark, star, score):
    plan = _plan(score(C.CATALOG["r01_alerts"].build(Context(spark, star))))
    assert "severidad" not in plan, "the alerts are planned again for the ranks"


def test_loads_are_cut_from_rows_joined_once(spark, star):
    assert "l_orderkey" not in _plan(loads_q._rows(Context(spark, star)))


def test_landed_json_is_compressed(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "'some text that comes again' AS t")
    K.write_json(df, str(tmp_path / "j"))
    files = list((tmp_path / "j").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert _rows(spark.read.schema(df.schema).json(str(tmp_path / "j"))) == _rows(df)
