"""Alert roll-ups (FIXTURES.md §3, §4)."""

from __future__ import annotations

from decimal import Decimal

from veeduria.operators import flags as FL
from veeduria.operators import scores as S
from veeduria.plans import reports as R
from veeduria.plans import summaries as SU
from veeduria.schema import ALERT


def alerts(spark, rows):
    full = []
    for r in rows:
        d = dict(codigo="F01", bandera="b", nivel="contratista", nombre_entidad=None, nit_entidad=None,
                 proveedor=None, documento_proveedor=None, id_contrato=None, anio=2024, detalle="d",
                 valor_cop=Decimal("10"), severidad=25)
        d.update(r)
        d["valor_cop"] = Decimal(str(d["valor_cop"]))
        full.append(tuple(d[f.name] for f in ALERT.fields))
    return spark.createDataFrame(full, ALERT)


def test_levels_feed_the_right_scores(spark):
    a = alerts(spark, [
        dict(codigo="F01", nit_entidad="E1", nombre_entidad="ENT", documento_proveedor="S1", proveedor="SUP"),
        dict(codigo="F03", nit_entidad="E1", nombre_entidad="ENT", severidad=20),
        dict(codigo="F06", documento_proveedor="S1", proveedor="SUP", severidad=15),
    ])
    e = {r.key: r for r in S.entity_scores(a).collect()}
    s = {r.key: r for r in S.supplier_scores(a).collect()}
    assert e["E1"].raw_score == 45 and e["E1"].banderas == ["F01", "F03"]
    assert s["S1"].raw_score == 40 and s["S1"].banderas == ["F01", "F06"]
    assert e["E1"].n_alertas == 2 and e["E1"].label == "ENT"


def test_score_cap(spark):
    a = alerts(spark, [dict(nit_entidad="E", codigo=c) for c in ("F01", "F01", "F01", "F01", "F01")])
    r = S.entity_scores(a).first()
    assert r.score == 100 and r.raw_score == 125 and r.valor_bajo_alerta == Decimal("50")


def test_geography_fanout_vs_modal(spark, contracts):
    c = contracts([dict(departamento="Meta"), dict(departamento="Meta"), dict(departamento="Boyacá")])
    a = alerts(spark, [dict(nit_entidad="900100", valor_cop=100)])
    fan = {r.d: r.valor for r in R.geography(a, R.entity_departments(c)).collect()}
    modal = {r.d: r.valor for r in R.geography(a, R.modal_departments(c)).collect()}
    assert fan == {"Meta": Decimal("100"), "Boyacá": Decimal("100")}
    assert modal == {"Meta": Decimal("100")}


def test_summary_descriptions(spark):
    a = alerts(spark, [dict(codigo="F09", severidad=10, valor_cop=2e9)])
    r = S.flag_summary(a).first()
    assert r.n == 1 and r.v == 2.0 and r.descripcion.startswith("Contrato de más de")


def _deepest_aggregate(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Aggregate(")[0].split()[-1] for line in plan.splitlines() if "Aggregate(" in line][-1]


def test_labels_count_contracts_by_hash(spark, contracts):
    """A string max over all contracts sorts every one of them."""
    c = contracts([dict(nombre_entidad="A"), dict(nombre_entidad="B"), dict(nit_entidad="2", nombre_entidad=None),
                   dict(nit_entidad=None), dict(documento_proveedor="9", proveedor_adjudicado=None)])
    assert _deepest_aggregate(FL.entity_labels(c)) == _deepest_aggregate(FL.supplier_labels(c)) == "Hash"
    assert {tuple(r) for r in FL.entity_labels(c).collect()} == {("900100", "B"), ("2", None)}
    assert {tuple(r) for r in FL.supplier_labels(c).collect()} == {("800200", "EMPRESA DOS"), ("9", None)}


def test_rollups_add_alerts_up_by_hash(spark, contracts, monkeypatch):
    monkeypatch.setattr(S, "reuse", lambda df: df)
    a = alerts(spark, [
        dict(nit_entidad="E", nombre_entidad="X", valor_cop=1), dict(nit_entidad="E", nombre_entidad="Y", valor_cop=2),
        dict(nit_entidad="E", nombre_entidad=None, codigo="F03", severidad=20, valor_cop=4),
        dict(nit_entidad="G", nombre_entidad=None), dict(nit_entidad=None, documento_proveedor="S")])
    for df in (S.entity_scores(a), S.flag_summary(a)):
        assert _deepest_aggregate(df) == "Hash"
    e = {r.key: (r.label, r.raw_score, r.n_alertas, r.valor_bajo_alerta, r.banderas) for r in S.entity_scores(a).collect()}
    assert e == {"E": ("Y", 70, 3, Decimal("7"), ["F01", "F03"]), "G": (None, 25, 1, Decimal("10"), ["F01"])}
    assert {(r.codigo, r.n, r.valor) for r in S.flag_summary(a).collect()} == {("F01", 4, Decimal("23")), ("F03", 1, Decimal("4"))}


def test_geography_moves_a_row_per_buyer(spark, contracts):
    """F16: alerts are added up per buyer before they meet the departments."""
    a = alerts(spark, [dict(nit_entidad="900100", valor_cop=v * 10**9) for v in (1, 2, 3)] + [dict(nit_entidad=None)])
    dims = R.entity_departments(contracts([dict(departamento="Meta"), dict(departamento=None)]))
    for df in (R.geography(a, dims), SU.geography_all(a, dims)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sum(valor_cop" in plan[plan.index("Join "):], plan
    assert [tuple(r)[:2] for r in R.geography(a, dims).collect()] == [("Meta", Decimal(6 * 10**9))]
    assert {tuple(r) for r in SU.geography_all(a, dims).collect()} == {("Meta", 6 * 10**9), (None, 6 * 10**9)}
    largest = SU.departments_of_largest(a, dims)
    assert "valor_cop" not in largest._jdf.queryExecution().optimizedPlan().toString(), "the alerts are planned twice"
    assert [(r.d, r.pct) for r in largest.collect()] == [("Meta", 100.0)]
