"""What queries move and write: only the columns they need, alerts once,
exports compressed; and the same rows by it."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers every query)
from veeduria.operators import flags as FL
from veeduria.operators.asof import asof_join
from veeduria.operators.normalize import normalize
from veeduria.plans import catalog as C
from veeduria.plans import summaries
from veeduria.plans.context import Context
from veeduria.sources import bindings as B
from veeduria.sources.landed import CORRUPT, LANDED_SCHEMA
from veeduria.streaming import flags_refresh as FR

DAY = dt.datetime(1997, 3, 5)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Tables with odd names and keys, gifts and posts before the contracts."""
    d = str(tmp_path_factory.mktemp("moved"))
    later = DAY + dt.timedelta(days=20)
    names = [(1, " one ** "), (2, "***"), (3, "  "), (4, None), (5, "a*b * "), (-6, "minus\t"), (7, "straße*")]
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R0")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, " n0* ", 0), (1, "N1", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
                     [(k, n, abs(k) % 2, "HOUSEHOLD") for k, n in names]),
        "supplier": ("s_suppkey long, s_name string", names),
        "part": ("p_partkey long, p_name string, p_type string", [(1, "old thing", "PROMO"), (2, None, "LARGE")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
                   " o_orderpriority string",
                   [(k * 10 + i, k, "P" if i else "F", 10.0 * i, DAY if i else later, "5-LOW" if i else "1-URGENT")
                    for k, _ in names for i in range(2)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double,"
                     " l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz",
                     [(k * 10 + i, 1 + i, s, n, 20000.0 * (n + 1), 0.1, 0.02, "FO"[i], DAY)
                      for k, _ in names for i in range(2) for n, (s, _) in enumerate(names)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def _written(spark, df):
    """Schemas of the scratch tables that a result reads."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles() if "/tables/reuse_" in f}
    return [spark.read.parquet(f).schema.simpleString() for f in folders]


@pytest.mark.parametrize("name", ["xd_donor", "xd_ex_official"])
def test_asof_queries_write_what_they_return(spark, star, name):
    df = C.CATALOG[name].build(Context(spark, star))
    (blocks,) = _written(spark, df)
    assert "valor_del_contrato" in blocks and "_salt" not in blocks
    assert "objeto_del_contrato" not in blocks and "nombre_entidad" not in blocks
    got = df.collect()
    # the later orders of the six customers with keys that stay apart, seven lines each, 20 days after; the
    # donations and posts themselves count on their own day for donors only
    assert {r[-1] for r in got} == ({0, 20} if name == "xd_donor" else {20})
    assert sum(r[-1] == 20 for r in got) == 6 * 7


@pytest.mark.parametrize("right, strict, want", [("date", False, 1), ("date", True, None), ("timestamp_ntz", False, 1)])
def test_asof_keeps_the_left_types(spark, right, strict, want):
    a = spark.createDataFrame([("x", DAY, 7)], "who string, t timestamp_ntz, n int")
    b = spark.createDataFrame([("x", DAY.date() if right == "date" else DAY, 1)], f"who string, u {right}, v int")
    got = asof_join(a, b, "who", "t", "u", {"v": "value"}, strict)
    assert [f.dataType for f in got.schema.fields[:3]] == [f.dataType for f in a.schema.fields]
    assert [tuple(r) for r in got.collect()] == [("x", DAY, 7, want)]


@pytest.mark.parametrize("b", [B.Binding(e, s) for e in ("nation", "customer") for s in ("supplier", "customer")])
def test_odd_names_and_keys_are_cleaned_alike(spark, star, b):
    kept = Context(spark, star)
    kept.keep()
    own = normalize(Context(spark, star).raw_contracts(b))
    assert _rows(kept.normalized(b)) == _rows(own) and own.count() == 98


def test_alert_csv_is_compressed(spark, star):
    df = C.CATALOG["s11_csv"].build(Context(spark, star))
    assert df.inputFiles() and all(f.endswith(".csv.gz") for f in df.inputFiles())
    assert _rows(df) == _rows(C.CATALOG["r01_alerts"].build(Context(spark, star))) and df.count() > 0


def test_alerts_keep_no_payments(spark, star):
    ctx = Context(spark, star)
    C.alerts_df(ctx)
    assert not set(B.PAYMENTS) & set(ctx._kept.columns)
    c, own = ctx.contracts(C.DEFAULT, C.TEST), Context(spark, star).contracts(C.DEFAULT, C.TEST)
    assert set(own.columns) - set(c.columns) == {"valor_pagado", "valor_de_pago_adelantado"}
    assert _rows(c) == _rows(own.select(c.columns))


def test_bundle_works_out_the_alerts_once(spark, star):
    sections = summaries.bundle_sections(Context(spark, star))
    for name in ("banderas", "top_entidades", "top_contratistas", "alertas_top"):
        plan = sections[name][0]._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderdate" not in plan, f"{name} plans the flags again"


# ------------------------------------------------------------- alert refresh --
def _land(folder, arrival, records, junk=""):
    path = folder / f"arrival={arrival}"
    path.mkdir(parents=True)
    text = "".join(json.dumps({"id_contrato": k, "nit_entidad": "9", "documento_proveedor": "8",
                               "valor_del_contrato": v, "fecha_de_firma": d}) + "\n" for k, v, d in records)
    (path / "p.json").write_text(text + junk)


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti")


def test_only_folders_with_replaced_versions_are_joined(spark, tmp_path):
    landed, out, ckpt = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "ckpt")

    def held():
        return sorted((r.id_contrato or "", str(r.valor_del_contrato), r.anio) for r in FR.contracts_table(spark, out).collect())
    _land(landed, 1, [("a", "1", "2020-01-01T00:00:00"), ("b", "2", "2021-01-01T00:00:00"), ("b", "3", "2021-02-01T00:00:00"),
                      ("c", "4", "2022-01-01T00:00:00"), ("bad", "x", "2022-01-01T00:00:00"), (None, "5", "2021-01-01T00:00:00")],
          '{"id_contrato": "c", "valor\n')
    FR.run_refresh(spark, str(landed), out, ckpt)
    assert _joins(FR.contracts_table(spark, out)) == 0
    assert held() == [("", "5.00", 2021), ("a", "1.00", 2020), ("b", "2.00", 2021), ("b", "3.00", 2021), ("c", "4.00", 2022)]
    assert [r.registro for r in FR.rejected_records(spark, out).collect()] == ['{"id_contrato": "c", "valor']
    # b moves to another year, a is no valid contract any more, a line that can't be parsed names c
    _land(landed, 2, [("b", "6", "2020-05-01T00:00:00"), ("a", "-1", "2020-01-01T00:00:00"), (None, "7", "2021-01-01T00:00:00")],
          '{"id_contrato": "c", "fecha\n')
    FR.run_refresh(spark, str(landed), out, ckpt)
    want = [("", "5.00", 2021), ("", "7.00", 2021), ("b", "6.00", 2020), ("c", "4.00", 2022)]
    assert held() == want
    plan = FR.contracts_table(spark, out)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "0/2020" in plan and "0/2021" in plan and "0/2022" not in plan
    _land(landed, 3, [("b", "8", "2023-05-01T00:00:00")])
    FR.run_refresh(spark, str(landed), out, ckpt)
    assert held() == sorted([w for w in want if w[0] != "b"] + [("b", "8.00", 2023)])


def test_landed_text_is_parsed_once(spark, tmp_path):
    landed, out, ckpt = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "ckpt")
    _land(landed, 1, [("a", "1", "2020-01-01T00:00:00"), ("bad", "x", "2022-01-01T00:00:00")], "{\n")
    scans = []

    class Batch:
        """Counts how often a batch is taken as input."""
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            if name in ("select", "where", "withColumn", "withColumns"):
                scans.append(name)
            return getattr(self.df, name)
    batch = spark.read.schema(LANDED_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).json(str(landed))
    spark.createDataFrame([], FR._REPLACED).write.parquet(f"{out}/replaced/batch_id=-1")
    FR._batch_writer(out, C.TEST)(Batch(batch), 0)
    assert len(scans) == 1
    assert spark.read.parquet(f"{out}/contracts/batch_id=0").where("anio is null").count() == 2


@pytest.mark.parametrize("years", [0, 1])
def test_arrivals_end_in_a_full_run(spark, star, tmp_path, years):
    """With every contract of a year before, the second arrival has no records."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{star}/{t}.parquet")
        if t == "orders":
            df = df.withColumn("o_orderdate", F.expr(f"o_orderdate - make_interval({years})"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    keys = ["codigo", "nit_entidad", "documento_proveedor", "id_contrato", "anio", "valor_cop", "severidad"]
    got = C.CATALOG["st_flags"].build(Context(spark, str(tmp_path)))
    want = FL.run_flags(Context(spark, str(tmp_path)).contracts(C.DEFAULT, C.TEST), C.TEST)
    assert sorted(tuple(map(str, r[:5])) + (float(r[5]), r[6]) for r in got.select(keys).collect()) == sorted(
        tuple(map(str, r[:5])) + (float(r[5]), r[6]) for r in want.select(keys).collect())
    assert {r.anio for r in got.collect()} == {1997 - years}
