"""Party network against a plain k-core; bundle order and bound; formats."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from veeduria.functions.fmt import padded, thousands
from veeduria.operators import network as N
from veeduria.sources import sinks


def plain_clusters(rows, k, max_degree):
    edges = set()
    for e, s, r in rows:
        if s is not None:
            edges |= {(f"E:{e}", f"S:{s}")} if e is not None else set()
            edges |= {(f"S:{s}", f"R:{r}")} if r is not None else set()

    def near(es):
        out = {}
        for a, b in es:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
        return out
    hubs = {n for n, x in near(edges).items() if len(x) > max_degree}
    edges = {e for e in edges if not hubs & set(e)}
    while weak := {n for n, x in near(edges).items() if len(x) < k}:
        edges = {e for e in edges if not weak & set(e)}
    links, out, seen = near(edges), set(), set()
    for start in sorted(links):
        if start not in seen:
            group, todo = set(), [start]
            while todo:
                n = todo.pop()
                if n not in group:
                    group.add(n)
                    todo += links[n]
            seen |= group
            out |= {(min(group), n, len(links[n]), len(group)) for n in group}
    return hubs, out


@pytest.mark.parametrize("k, max_degree", [(2, 8), (3, 20), (2, 3)])
def test_clusters_against_a_plain_core(contracts, k, max_degree):
    rng = random.Random(k * 100 + max_degree)
    rows = [(rng.choice([*map(str, range(25)), None]), rng.choice([*map(str, range(40)), None]), None) for _ in range(90)]
    rows = [(e, s, None if s is None else rng.choice([str(int(s) // 3), None])) for e, s, _ in rows]
    rows += [("hub", str(s), "x") for s in range(30)] + [("e1", "s1", "r1"), ("e2", "s1", "r1"), ("e1", "s2", "r1"), ("e2", "s2", "r1")]
    c = contracts([{"nit_entidad": e, "documento_proveedor": s, "identificaci_n_representante_legal": r} for e, s, r in rows])
    hubs, want = plain_clusters(rows, k, max_degree)
    assert {r.nodo for r in N.hubs(c, max_degree).collect()} == hubs
    got = {(r.cluster, r.nodo, r.grado, r.tamano) for r in N.party_clusters(c, k, max_degree).collect()}
    assert got == want
    assert all(r.tipo == {"E": "entidad", "S": "contratista", "R": "representante"}[r.nodo[0]]
               for r in N.party_clusters(c, k, max_degree).collect())


def test_bundle_keeps_order_and_checks_its_size(spark):
    one = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "n int, t string").repartition(3)
    none = one.limit(0)
    doc = sinks.json_bundle({"z": (one, [F.desc("n")]), "a": (one, [F.asc("n")]), "none": (none, [F.asc("n")])}).first().data
    assert list(json.loads(doc)) == ["z", "a", "none"]
    assert json.loads(doc)["z"] == [{"n": 3, "t": "c"}, {"n": 2}, {"n": 1, "t": "a"}] and json.loads(doc)["none"] == []
    with pytest.raises(Exception, match="more than 2 rows"):
        sinks.json_bundle({"z": (one, [F.desc("n")])}, max_rows=2).collect()


def test_number_formats(spark):
    rows = [(0,), (7,), (1234,), (123456789,), (-4321,), (None,)]
    got = spark.createDataFrame(rows, "n long").select(thousands("n").alias("t"), padded("n", 2).alias("p")).collect()
    assert [r.t for r in got] == ["0", "7", "1,234", "123,456,789", "-4,321", None]
    assert [r.p for r in got] == ["00", "07", "1234", "123456789", "-4321", None]
