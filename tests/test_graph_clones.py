"""Connected components vs union-find; near copies vs brute force."""

from __future__ import annotations

import itertools
import random

from veeduria.operators.clones import exact_clones, near_clones
from veeduria.operators.graph import connected_components
from veeduria.session import reuse


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(400, 460)]          # a long chain
    edges += [(1000, j) for j in range(1001, 1100)]          # a hub
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    uf = union_find(edges)
    # component id = smallest node of the component
    mins = {}
    for n, root in uf.items():
        mins[root] = min(mins.get(root, n), n)
    assert got == {n: mins[root] for n, root in uf.items()}


def _shingles(t, k=5):
    w = " ".join(t.split()).lower().split(" ")
    return {" ".join(w)} if len(w) <= k else {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_groups(docs, percent=75):
    sh = {d: _shingles(t) for d, t in docs if t and t.strip(" \t\n\x0b\x0c\r") and d is not None}
    uf = union_find([(a, b) for a, b in itertools.combinations(sorted(sh), 2)
                     if 100 * len(sh[a] & sh[b]) >= percent * len(sh[a] | sh[b])])
    members = {}
    for x, root in uf.items():
        members.setdefault(root, []).append(x)
    return {(x, min(m), len(m)) for m in members.values() for x in m}


def got_groups(df, **kw):
    return {tuple(r) for r in near_clones(df, "doc_id", "text", **kw).select("doc_id", "grupo", "n").collect()}


def test_near_clones_keep_chains(spark):
    """A~B and B~C but not A~C, with the outlier as the smallest id: the case
    that stars around a bucket's smallest member lose."""
    rng = random.Random(5)
    docs = []
    for i in range(40):
        w = [f"t{i}x{j}" for j in range(60)]
        left, right = list(w), list(w)
        left[20], right[40] = "edit", "other"
        ids = rng.sample(range(3), 3)
        docs += [(10 * i + d, " ".join(x)) for d, x in zip(ids, (left, w, right))]
    docs += [(9000, "short text"), (9001, "Short  text"), (9002, ""), (9003, "  \n"), (9004, None), (None, "short text"),
             (9005, "short other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {d: _shingles(t) for d, t in docs[:3]}
    ends = [d for d, t in docs[:3] if "edit" in t or "other" in t]
    assert len(sets[ends[0]] & sets[ends[1]]) / len(sets[ends[0]] | sets[ends[1]]) < 0.75
    got = got_groups(df)
    assert got == brute_groups(docs) and {x[2] for x in got if x[0] < 9000} == {3}


def test_near_clones_of_random_edits(spark):
    rng = random.Random(7)
    docs = []
    for i in range(15):
        w = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(4, 60))]
        for j in range(8):
            x = list(w)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = f"v{rng.randrange(30)}"
            docs.append((100 * i + j, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (60, 75, 90):
        assert got_groups(df, percent=percent) == brute_groups(docs, percent)


def test_near_clones_against_brute_force(spark):
    random.seed(11)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choice(vocab) for _ in range(300)) for _ in range(12)]
    docs = []
    for i, b in enumerate(base):
        docs.append((i * 10, b))
        w = b.split()
        w[150] = "changed"                                   # one edited word: Jaccard ~0.97
        docs.append((i * 10 + 1, " ".join(w)))
        docs.append((i * 10 + 2, b.replace(" ", "\n  ")))   # whitespace-only variant: exact copy
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_groups(df) == brute_groups(docs)
    ex = {(r.doc_id, r.grupo, r.n) for r in exact_clones(df, "doc_id", "text").collect()}
    assert ex == {(i * 10 + j, i * 10, 2) for i in range(12) for j in (0, 2)}


def test_only_sets_of_candidates_are_written(spark, monkeypatch):
    from veeduria.operators import clones

    written = []
    monkeypatch.setattr(clones, "reuse", lambda df: (written.append(reuse(df)), written[-1])[1])
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["other"])), (2, " ".join(base[:-1] + ["other"])), (3, " ".join(base).upper())]
    rows += [(i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(10, 60)] + [(None, "a b c"), (70, None), (71, " \t")]
    got = clones.near_clones(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 4), (2, 1, 4), (2, 1, 4), (3, 1, 4)]
    sets = [df.count() for df in written if "hs" in df.columns]
    assert sets and max(sets) == 2, "sets of texts without a candidate are written"
