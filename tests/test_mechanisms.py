"""As-of join, distributed ranks, load journal, late stream rows, rejected
records, ordered export, range join and test of fit against plain readings."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veeduria.operators import extra as X
from veeduria.operators.asof import asof_join
from veeduria.operators.ranks import value_counts, with_percent_rank
from veeduria.operators.scores import with_percent_rank as score_rank
from veeduria.sources import sinks
from veeduria.sources.journal import Table
from veeduria.sources.landed import load_count, read_landed_json
from veeduria.streaming import flags_refresh as FR
from veeduria.streaming import refresh as RF


# -------------------------------------------------------------------- as-of --
@pytest.mark.parametrize("strict", [False, True])
def test_asof_ties_gaps_and_a_hot_id(spark, strict):
    rng = random.Random(4)
    ids = ["hot"] * 6 + ["a", "b", "c", None]
    left = [(k, rng.choice(ids), rng.choice([*range(60), None])) for k in range(900)]
    right = [(rng.choice(ids[:9] + ["other", None]), rng.choice([*range(60), None]), rng.randrange(5)) for _ in range(300)]
    left += left[:20]                                           # repeated rows stay repeated
    want = Counter()
    for k, i, t in left:
        ok = [(t2, v) for i2, t2, v in right if i is not None and i2 == i and t is not None and t2 is not None
              and (t2 < t if strict else t2 <= t)]
        want[(k, i, t, *(max(ok) if ok else (None, None)))] += 1
    a = spark.createDataFrame(left, "k int, who string, t int")
    b = spark.createDataFrame(right, "who string, u int, v int")
    got = asof_join(a, b, "who", "t", "u", {"u": "since", "v": "value"}, strict)
    assert got.columns == ["k", "who", "t", "since", "value"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert asof_join(a, b.limit(0), "who", "t", "u", {"u": "since"}, strict).where("since is not null").isEmpty()
    assert asof_join(a.limit(0), b, "who", "t", "u", {"u": "since"}, strict).isEmpty()


# -------------------------------------------------------------------- ranks --
def test_percent_rank_by_histogram(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1.5, 2.5, None, rng.random()])) for _ in range(700)]
    rows += [("one", 3.0), ("hot", 1.0)] + [("hot", 2.0)] * 2000
    df = spark.createDataFrame(rows, "g string, v double")
    got = Counter((r.g, r.v, None if r.p is None else round(r.p, 12)) for r in with_percent_rank(df, "v", ["g"], "p").collect())
    want = Counter()
    for g, v in rows:
        vs = [x for h, x in rows if h == g and x is not None]
        want[g, v, None if v is None else round(sum(x < v for x in vs) / (len(vs) - 1), 12) if len(vs) > 1 else 0.0] += 1
    assert got == want
    whole = {r.v: (r.before, r["count"], r.total) for r in value_counts(df, "v").collect()}
    vs = sorted(v for _, v in rows if v is not None)
    assert whole == {v: (sum(x < v for x in vs), vs.count(v), len(vs)) for v in set(vs)}


def test_score_rank_over_blocks(spark):
    rng = random.Random(8)
    values = [rng.randrange(0, 3000) for _ in range(500)] + [7] * 300
    got = score_rank(spark.createDataFrame([(v,) for v in values], "raw_score long"), "raw_score").collect()
    assert Counter((r.raw_score, round(r.pct_rank, 12)) for r in got) == Counter(
        (v, round(sum(x < v for x in values) / (len(values) - 1), 12)) for v in values)


# ------------------------------------------------------------------ journal --
SCHEMA = "id int, fecha_de_firma timestamp_ntz, anio int"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, dt.datetime(*d), d[0]) for i, d in pairs], SCHEMA)


def held(t, version=None):
    return sorted(r.id for r in t.read(version).collect())


def test_journal_loads(spark, tmp_path):
    a = rows_of(spark, [(1, (2020, 5, 1)), (2, (2021, 1, 1)), (3, (2021, 7, 1)), (4, (2022, 2, 2))])
    t = Table(spark, str(tmp_path / "t"), a.schema)
    assert held(t) == [] and t.versions() == []
    t.rebuild(a, "full")
    t.append(rows_of(spark, [(5, (2021, 9, 9)), (6, (2023, 1, 1))]), "b1")
    assert held(t) == [1, 2, 3, 4, 5, 6]
    before = dict.fromkeys(str(p) for p in tmp_path.rglob("anio=2020/*.parquet"))
    # [2021-06-01, 2022-01-01): rows 3 and 5 go; 2 and 4 stay; row 9 lies outside the range and is not taken
    new = rows_of(spark, [(7, (2021, 6, 1)), (8, (2021, 12, 31)), (9, (2022, 1, 1))])
    t.reload(new, "r1", "2021-06-01", "2022-01-01")
    assert held(t) == [1, 2, 4, 6, 7, 8]
    assert {r.anio for r in t.journal().where("load = 'r1'").collect()} == {2021}
    assert before.keys() == {str(p) for p in tmp_path.rglob("anio=2020/*.parquet")}      # untouched
    # every load again changes nothing; earlier versions can be read
    versions = t.versions()
    t.rebuild(a, "full"), t.append(a, "b1"), t.reload(new, "r1", "2021-06-01", "2022-01-01")
    assert t.versions() == versions and held(t) == [1, 2, 4, 6, 7, 8]
    assert held(t, versions[0]) == [1, 2, 3, 4]
    t.append(a.limit(0), "empty")
    assert t.done("empty") and held(t) == [1, 2, 4, 6, 7, 8]


def test_killed_loads_are_not_seen(spark, tmp_path):
    a = rows_of(spark, [(1, (2020, 5, 1))])
    t = Table(spark, str(tmp_path / "t"), a.schema)
    t.rebuild(a, "full")
    b = rows_of(spark, [(2, (2020, 6, 1))])
    t.stage(b, "killed")                                         # ended before its commit
    assert held(t) == [1]
    half = tmp_path / "t" / "journal" / "version=2"              # ended within its commit
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")
    assert t.versions() == [1] and held(t) == [1]
    t.append(b, "killed")
    assert t.versions() == [1, 2] and held(t) == [1, 2]


# ------------------------------------------------------------------- stream --
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_rows_a_month_late_are_merged_and_counted(spark, tmp_path):
    rng = random.Random(2)
    every = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=rng.randrange(24 * 90)), 1, rng.choice("ab"),
              round(rng.random() * 9, 2), "{}") for k in range(400)]
    waves = [[e for e in every if e[1] >= pd.Timestamp("2024-02-20")],
             [e for e in every if e[1] < pd.Timestamp("2024-02-01")],
             [e for e in every if pd.Timestamp("2024-02-01") <= e[1] < pd.Timestamp("2024-02-20")] + [(999, None, 1, "a", 1.0, "{}")]]
    landed, table, ckpt = (str(tmp_path / x) for x in ("landed", "table", "ckpt"))
    for wave in waves:
        spark.createDataFrame(pd.DataFrame(wave, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"ts": "datetime64[ns]"}),
                              EVENTS).coalesce(1).write.mode("append").parquet(landed)
        got = RF.run_weekly(spark, landed, None, table, ckpt)
    every = [e for w in waves for e in w]
    want, late = {}, Counter()
    mark = max(e[1] for e in waves[0]) - pd.Timedelta(days=7)
    for n, wave in enumerate(waves):
        for e in wave:
            week = None if e[1] is None else (e[1] - pd.Timedelta(days=e[1].weekday())).date()
            c, v = want.get((week, e[3]), (0, 0))
            want[week, e[3]] = (c + 1, v + round(e[4] * 100))
            late[week, e[3]] += bool(n and week and pd.Timestamp(week) + pd.Timedelta(days=7) <= mark)
    assert {(r.semana, r.event_type): (r.n, round(float(r.v) * 100), r.n_tarde) for r in got.collect()} == {
        k: (*x, late[k]) for k, x in want.items()}
    assert RF.late_count(spark, table) == sum(late.values()) > 50
    assert RF.late_rows(spark, table).count() == sum(late.values())


def test_replays_however_late_are_dropped(spark, tmp_path):
    def row(i, day):
        return (i, pd.Timestamp(day), 1, "a", 1.0, "{}")
    waves = [[row(1, "2024-03-01"), row(2, "2024-03-02"), row(2, "2024-03-02")],
             [row(1, "2024-03-01 05:00"), row(3, "2024-01-05")],            # a replay; a row long behind the others
             [row(3, "2024-01-05"), row(1, "2024-06-01"), (None, pd.Timestamp("2024-01-05"), 1, "a", 1.0, "{}")]]
    landed, sink, ckpt = (str(tmp_path / x) for x in ("landed", "sink", "ckpt"))
    for wave in waves:
        pdf = pd.DataFrame(wave, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"event_id": "Int64"})
        spark.createDataFrame(pdf, EVENTS).coalesce(1).write.mode("append").parquet(landed)
        got = RF.run_dedupe(spark, landed, None, sink, ckpt)
    assert Counter(r.event_id for r in got.collect()) == Counter([1, 2, 3, 1, None])


def test_unparsable_landed_lines_are_kept_apart(spark, tmp_path):
    good = {"id_contrato": "A", "nit_entidad": "9", "documento_proveedor": "8", "valor_del_contrato": "5",
            "fecha_de_firma": "2024-01-01T00:00:00.000"}
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "p.json").write_text(json.dumps(good) + '\n{"id_contrato": "B", "valor\n')
    landed, out, ckpt = (str(tmp_path / x) for x in ("landed", "out", "ckpt"))
    df = read_landed_json(spark, landed)
    assert df.count() == 1 and load_count(df).first().n == 1
    FR.run_refresh(spark, landed, out, ckpt)
    assert [r.id_contrato for r in FR.contracts_table(spark, out).collect()] == ["A"]
    assert [r.registro for r in FR.rejected_records(spark, out).collect()] == ['{"id_contrato": "B", "valor']


# ------------------------------------------------------------------ exports --
@pytest.mark.parametrize("kind", ["csv", "json"])
def test_files_keep_the_order(spark, tmp_path, kind):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.randrange(50)]), 'a\n"b"' if k % 7 == 0 else "t") for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, t string").repartition(5)
    write = sinks.write_csv if kind == "csv" else sinks.write_json
    sinks.write_sorted(df, str(tmp_path / "o"), [F.desc_nulls_last("v"), F.asc("k")], write)
    back = sinks.read_csv(spark, str(tmp_path / "o"), df.schema) if kind == "csv" else spark.read.schema(df.schema).json(str(tmp_path / "o"))
    got = sorted((r.orden, r.k, r.v, r.t) for r in sinks.with_place(back).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]


# ---------------------------------------------------------------- detectors --
def test_overlapping_periods(spark, contracts):
    rng = random.Random(9)
    day0 = dt.date(2024, 1, 1)
    days = [day0 + dt.timedelta(days=rng.randrange(200)) for _ in range(300)]
    c = contracts([{"fecha_de_firma": dt.datetime(d.year, d.month, d.day, 13), "valor_del_contrato": 10} for d in days])
    periods = [("a", 20, 90), ("b", 30, 31), ("c", 85, 120), ("empty", 50, 50), ("reversed", 60, 55), ("far", 900, 950)]
    df = spark.createDataFrame([(m, day0 + dt.timedelta(days=a), day0 + dt.timedelta(days=b)) for m, a, b in periods],
                               "marca string, desde date, hasta date")
    got = {(r.marca, r.fase): (r.dias, r.contratos, int(r.valor)) for r in X.period_effects(c, df, 25, 7).collect()}
    want = {}
    for m, a, b in periods:
        for fase, lo, hi in (("antes", a - 25, a), ("durante", a, b), ("despues", b, b + 25)):
            n = sum(lo <= (d - day0).days < hi for d in days)
            if lo < hi:
                want[m, fase] = (hi - lo, n, 10 * n)
    assert got == want


def test_benford_tail_against_the_gamma_integral(contracts):
    rng = random.Random(1)
    rows = [{"nit_entidad": "1", "valor_del_contrato": round(10 ** rng.uniform(0, 6))} for _ in range(200)]
    rows += [{"nit_entidad": "2", "valor_del_contrato": rng.randrange(500, 999)} for _ in range(60)]
    got = {r.nit_entidad: r for r in X.benford_test(contracts(rows), 50).collect()}
    for nit in "12":
        digits = [int(str(r["valor_del_contrato"])[0]) for r in rows if r["nit_entidad"] == nit]
        n = len(digits)
        e = {d: n * math.log10(1 + 1 / d) for d in range(1, 10)}
        chi = sum((digits.count(d) - e[d]) ** 2 / e[d] for d in e)
        mad = sum(abs(digits.count(d) - e[d]) / n for d in e) / 9
        # upper tail of chi-square with 8 degrees of freedom, by Simpson's rule
        top, steps = chi + 120, 40000
        h = (top - chi) / steps
        f = [(x := chi + i * h) ** 3 * math.exp(-x / 2) / (2 ** 4 * math.gamma(4)) for i in range(steps + 1)]
        tail = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        assert abs(got[nit].chi2 - chi) < 1e-9 * chi and abs(got[nit].mad - mad) < 1e-9 and abs(got[nit].p_valor - tail) < 1e-9


def test_term_weights_apply_to_unknown_words(contracts):
    known = contracts([{"objeto_del_contrato": t} for t in ("compra de papel", "compra de lapices", "compra", "compra de papel")])
    weights = X.term_weights(known)
    w = {r.termino: r.peso for r in weights.collect()}
    assert w["compra"] == 0 and w["de"] == round(math.log(4 / 3) * 1e6) and w["lapices"] == round(math.log(4) * 1e6)
    new = contracts([{"objeto_del_contrato": t} for t in ("compra zzz", "...", "Compra, COMPRA")])
    got = {r.objeto: (r.palabras, r.especificidad) for r in X.specificity(new, weights).collect()}
    assert got == {"compra zzz": (2, w["lapices"] / 2 / 1e6), "...": (0, 0.0), "Compra, COMPRA": (1, 0.0)}
