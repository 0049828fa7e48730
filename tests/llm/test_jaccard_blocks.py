"""Blocks of neighbouring sizes and spanning forests of the Jaccard join."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veeduria.llm import jaccard_join as J


def parts_of(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    groups = {}
    for i, v in enumerate(label):
        groups.setdefault(v, []).append(i)
    return sorted(map(tuple, groups.values()))


@pytest.mark.parametrize("split", [None, 40])
def test_forest_equals_all_pairs(split):
    rng = np.random.default_rng(3)
    roots = [np.unique(rng.integers(0, 2**62, size).astype(np.uint64)) for size in (1, 6, 30, 200)]
    sets = []
    for _ in range(120):
        s = roots[rng.integers(len(roots))].copy()
        lost = rng.random(len(s)) < 0.12
        s[lost] = rng.integers(0, 2**62, lost.sum()).astype(np.uint64)
        sets.append(np.unique(s))
    sets.sort(key=len)
    true = [(i, j) for i in range(120) for j in range(i)
            if J.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    found = J.forest(sets, None) if split is None else J.forest(sets[:split], sets[split:])
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, true)))
    assert len(set(found)) == len(found) == 120 - len(parts_of(120, true))
    assert parts_of(120, found) == parts_of(120, true)


def test_blocks_keep_sizes_near_each_other(spark):
    """A long text in a cluster of short ones has a block of its own, and
    none holds many times the shingles asked for."""
    sizes = [30 + i % 12 for i in range(400)] + [50_000]
    sets = spark.createDataFrame([(i, -i, n) for i, n in enumerate(sizes)], "c1 long, c2 long, n long")
    cluster = spark.range(len(sizes)).select(F.col("id").alias("c1"), F.lit(7).cast("long").alias("cluster"))
    got = J.blocks(sets, cluster, block=2000).collect()
    assert len(got) == len(sizes)
    by = {}
    for r in got:
        by.setdefault(r.block, []).append(r.n)
    assert [50_000] in by.values()
    for b, ns in by.items():
        assert max(ns) * J.PERCENT <= min(ns) * 100 + 100 and (len(ns) == 1 or sum(ns) < 3 * 2000)
    order = sorted(by)
    assert all(max(by[x]) <= max(by[y]) or x >> 32 == y >> 32 for x, y in zip(order, order[1:]))
    # small clusters of like sizes stay whole
    assert {r.block for r in J.blocks(sets.where("n < 50"), cluster).collect()} == {-1}


def test_long_text_among_short_copies(spark):
    """Rows are those of the definition whatever the blocks."""
    line = [f"w{i}" for i in range(60)]
    texts = [" ".join(line[:-(i % 9) or None] + [f"x{i}"]) for i in range(60)] + \
            [" ".join(line + [f"long{i}" for i in range(3000)]), " ".join(line + [f"long{i}" for i in range(2900)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = {d: g[0] for g in parts_of(len(texts), links) for d in g}
    for block in (J.BLOCK_SHINGLES, 300):
        got = {r.doc_id: r.component_id for r in J.components(df, block=block).collect()}
        assert got == want
