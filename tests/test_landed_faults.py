"""Landed records that can't be parsed, CSV with line breaks, short search
terms, long paths in the component search."""

from __future__ import annotations

from veeduria.operators.graph import connected_components
from veeduria.plans.profiles import supplier_search
from veeduria.sources import landed, sinks


def test_corrupt_records_are_counted(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"id_contrato": "A"}\n{"id_contrato": "B", "valor\n{"id_contrato": "C"}\n')
    path = str(tmp_path / "page.json")
    assert sorted(r.id_contrato for r in landed.read_landed_json(spark, path).collect()) == ["A", "C"]
    (bad,) = landed.corrupt_records(spark, path).collect()
    assert bad.n == 1 and bad.example.startswith('{"id_contrato": "B"')


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, 'end "'), (4, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "out"), df.schema).collect()) == rows
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '""quoted""' in text and "\\" not in text


def test_short_term_has_the_same_columns(contracts):
    c = contracts([{}, {"proveedor_adjudicado": "OTRA EMPRESA"}])
    short, full = supplier_search(c, "EM"), supplier_search(c, "EMP")
    assert short.columns == full.columns and short.count() == 0 and full.count() == 2


def test_long_path_is_one_component(spark):
    edges = [(i, i + 1) for i in range(299)] + [(1000, 1001)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.component for r in got if r.node < 300} == {0}
    assert {r.component for r in got if r.node >= 1000} == {1000}
