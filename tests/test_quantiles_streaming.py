"""Exact distributed quantile vs numpy; streaming refresh with late data."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from veeduria.operators.ranks import exact_quantile
from veeduria.streaming import refresh as RF


def test_exact_quantile_matches_numpy_with_hot_value(spark):
    random.seed(7)
    rows = [(random.choice("abc"), random.random() * 1000) for _ in range(20000)] + [("a", 5.0)] * 15000
    df = spark.createDataFrame(rows, "k string, v double")
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    for p in (0.05, 0.5, 0.95):
        got = {r.k: r.q for r in exact_quantile(df, "v", p, ["k"]).collect()}
        exp = pdf.groupby("k")["v"].quantile(p, interpolation="linear").to_dict()
        assert got.keys() == exp.keys()
        for k in exp:
            assert abs(got[k] - exp[k]) <= 1e-9 * max(1.0, abs(exp[k]))
        g = exact_quantile(df, "v", p).first().q
        assert abs(g - float(np.quantile(pdf["v"], p))) <= 1e-9 * max(1.0, abs(g))


def test_weekly_stream_late_data_updates_week(spark, tmp_path):
    land = tmp_path / "landed"
    land.mkdir()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def put(name, rows):
        pd_rows = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        spark.createDataFrame(pd_rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("*.parquet"):
            f.rename(land / f"{name}.parquet")

    put("b1", [(1, pd.Timestamp("2024-01-02 10:00"), 1, "click", 1.5, "{}"),
               (2, pd.Timestamp("2024-01-09 10:00"), 1, "click", 2.0, "{}")])
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    r1 = {(str(r.semana), r.event_type): r.n for r in RF.run_weekly(spark, str(land), None, table, ckpt).collect()}
    assert r1 == {("2024-01-01", "click"): 1, ("2024-01-08", "click"): 1}
    # a late event for the first week, inside the 7-day watermark
    put("b2", [(3, pd.Timestamp("2024-01-07 23:00"), 2, "click", 1.0, "{}")])
    r2 = {(str(r.semana), r.event_type): r.n for r in RF.run_weekly(spark, str(land), None, table, ckpt).collect()}
    assert r2 == {("2024-01-01", "click"): 2, ("2024-01-08", "click"): 1}


def test_exact_quantile_small_groups_with_ties(spark):
    random.seed(5)
    rows = [(g, float(random.randint(0, 60))) for g in "abcde" for _ in range(random.randint(3, 700))]
    df = spark.createDataFrame(rows, "k string, v double")
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    for p in (0.05, 0.5, 0.95):
        got = {r.k: r.q for r in exact_quantile(df, "v", p, ["k"]).collect()}
        exp = pdf.groupby("k")["v"].quantile(p).to_dict()
        assert all(abs(got[k] - exp[k]) <= 1e-9 for k in exp), (p, got, exp)
