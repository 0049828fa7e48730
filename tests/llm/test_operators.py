"""The dealt operators against brute force, on the smallest tables and on a
table of edge cases: nulls in every column, empty and very long texts, ties,
repeated rows, no rows, and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veeduria.llm import (fingerprints, html_text, jaccard_join, langid, license_scan, mixing, packing, quality, queries,
                          substring_dedup, token_orc, tokens)

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, h long, part int, "
          "label string, w array<string>, t string, start int, source_size long")
LINE = " ".join(f"word{i}" for i in range(30))
EDGE = [
    (1, f"{LINE} tail one"), (2, f"{LINE} tail one"), (2, f"{LINE} tail one"), (3, f"head {LINE} other end"),
    (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (None, f"{LINE} tail one"), (None, None),
    (9, "x " * 6000 + LINE), (10, "Under the MIT License; apache license, version 2 cc by-nc KK İx"),
    (11, "###$$$ a|b <c> " * 30), (12, "é ü ñ   á  b\n\nc | d"), (13, "nothing like the others at all, truly"),
    (3, "same id other text"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if k % 3 else None, ["a", "b", None][k % 3], None if t is None else len(t), -1, -2, 3, "x", ["z"],
             "u", 4, 5) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ALL = {
    "fingerprints": fingerprints.report, "jaccard": jaccard_join.components, "jaccard_keep": jaccard_join.keep_first,
    "orc": lambda d: token_orc.token_files(d, queries.vocabulary("byte_bpe_50k.json")),
    "packing": lambda d: packing.pack(d, queries.vocabulary("word_bpe_49k.json")),
    "quality": quality.judge, "langid": langid.identify, "langid_keep": langid.keep_identified,
    "dedup": substring_dedup.report, "dedup_keep": substring_dedup.dedup, "license": license_scan.scan,
    "mixing": mixing.mix_report, "mix": mixing.mix,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, edge, name):
    assert ALL[name](edge.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n in ALL if not n.endswith("keep") and n not in ("mix", "packing")])
def test_one_row_per_document(edge, name):
    got = Counter(r["doc_id"] for r in rows(ALL[name](edge)))
    assert got == Counter(i for i, _ in EDGE)


@pytest.mark.parametrize("name", ["jaccard_keep", "langid_keep", "dedup_keep", "mix"])
def test_stages_keep_columns(edge, name):
    assert ALL[name](edge).columns == edge.columns


# ------------------------------------------------------------ fingerprints --
def check_fingerprints(got, order):
    h = fingerprints.Hasher()
    fp = [fingerprints.simhash(t, h) for _, t in order]
    for i, (r, (d, t)) in enumerate(zip(got, order)):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        efp = fingerprints.simhash(e, h)
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{fp[i]:016x}", f"{efp:016x}")
        assert r["near_edited"] == 1 - (fp[i] ^ efp).bit_count() / 64
        assert r["near_next"] == 1 - (fp[i] ^ fp[(i + 1) % len(fp)]).bit_count() / 64
        if d is not None and d % 20 == 0:
            assert r["n_near"] == sum((x ^ fp[i]).bit_count() <= 3 for x in fp) - 1


def test_fingerprints(docs, texts):
    check_fingerprints(sorted(rows(fingerprints.report(docs)), key=lambda r: r["doc_id"]), texts)


def test_fingerprint_search_is_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(8)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius in (0, 1, 3):
        got = {(r["q"], r["fp"]) for r in fingerprints.near(df, df, radius).collect()}
        assert got == {(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= radius}


# ----------------------------------------------------------------- jaccard --
def brute_components(pairs):
    """pairs: (doc_id, text); component id per position."""
    sets = []
    for _, t in pairs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (d, _), x in zip(pairs, label):
        if d is not None:
            ids[x] = min(ids.get(x, d), d)
    return [(d, len(s), ids.get(x, d)) for (d, _), s, x in zip(pairs, sets, label)]


def order(x):
    return tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_SHINGLES, 60])
def test_jaccard(docs, texts, edge, block):
    for df, pairs in ((docs, texts), (edge, EDGE)):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.components(df, block=block))]
        assert sorted(got, key=order) == sorted(brute_components(pairs), key=order)


def test_jaccard_dense_group_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    pairs = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1:])) for k in range(40)] + [(100, " ".join(base[:30]))]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    for block in (10_000, 300):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.components(df, block=block))]
        assert sorted(got) == sorted(brute_components(pairs))


def test_jaccard_keeps_one_of_each(edge):
    kept = [(r["doc_id"], r["text"]) for r in rows(jaccard_join.keep_first(edge))]
    assert [d for d, t in kept if t and t.startswith("word0")] == [1]
    assert sorted((d for d, t in kept if not words(t)), key=lambda d: (d is None, d or 0)) == [4, 5, 6, None]


# --------------------------------------------------------- tokens, packing --
def encoded(pairs, file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(file))
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch([x or "" for _, x in pairs], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunked_encoding_is_exact(file, drops):
    import random

    random.seed(5)
    letters = list(" \n\t'|.,!aBé1́ \x1cs<")
    t = [(0, "".join(random.choices(letters, k=random.randint(0, 40)))) for _ in range(2000)]
    t += [(0, x) for x in ("<|endoftext|> it's", "z | y |x", " |", "|", "word " * 40 + "l" * 300, "日本 語", None)]
    got = tokens.Encoder(queries.vocabulary(file), drops).encode([x for _, x in t])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x[:-1] for x in encoded(t, file)]


def test_orc_round_trip(spark, docs, texts, edge, tmp_path):
    for df, pairs in ((docs, texts), (edge, sorted(EDGE, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")))):
        ids = encoded(pairs, "byte_bpe_50k.json")
        got = [tuple(r) for r in token_files_rows(df)]
        starts = np.cumsum([0] + [len(x) for x in ids[:-1]]).tolist()
        want = [(d, s, len(x), crc(x)) for (d, _), s, x in zip(pairs, starts, ids)]
        assert sorted(got, key=lambda r: r[1]) == want
    path = str(tmp_path / "ids")
    token_orc.write_tokens(docs, path, queries.vocabulary("byte_bpe_50k.json"))
    assert [r["doc_id"] for r in token_orc.read_tokens(spark, path, [17]).collect()] == [17]
    plan = token_orc.read_tokens(spark, path, [17])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan


def token_files_rows(df):
    return ALL["orc"](df).select("doc_id", "start", "n_tokens", "ids_crc32").collect()


def test_packing(docs, texts):
    ids = dict(zip((d for d, _ in texts), encoded(texts, "word_bpe_49k.json")))
    got = rows(packing.pack(docs, queries.vocabulary("word_bpe_49k.json")))
    pieces, windows = {}, {}
    for r in got:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x)
        part = x[r["start"]:r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == part and r["ids_crc32"] == crc(part)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at and n > 0
            at += n
        assert at == len(x)
    total = [sum(n for _, n in w) for w in windows.values()]
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
    assert max(total) <= 4096 and sum(n != 4096 for n in total) <= 1


def test_packing_edge_rows(edge):
    got = rows(ALL["packing"](edge))
    assert sum(r["length"] for r in got) == sum(len(x) for x in encoded(EDGE, "word_bpe_49k.json"))


# ----------------------------------------------------------------- quality --
def base_counts(text):
    w, t = words(text), text or ""
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_counts(docs, texts, edge):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, pairs in ((docs, texts), (edge, EDGE)):
        got = [(r["doc_id"], *(r[n] for n in names)) for r in rows(quality.judge(df))]
        assert sorted(got, key=order) == sorted(((d, *base_counts(t)) for d, t in pairs), key=order)


def test_quality_thresholds_follow_the_group(spark):
    clean = [(i, " ".join(f"plain{i}{j}" for j in range(40)), "en", "a") for i in range(50)]
    junk = [(100, " ".join(f"w{j}##" for j in range(40)), "en", "a")]
    code = [(200 + i, " ".join(f"v{i}{j}##" for j in range(40)), "en", "code") for i in range(20)]
    df = spark.createDataFrame(clean + junk + code, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in rows(quality.judge(df)) if not r["kept"]) == [100]


def test_quality_thresholds_of_small_and_mixed_groups(spark):
    def some(first, n, sign, lang, source):
        return [(first + i, " ".join(f"w{first}{i}x{j}{sign}" for j in range(40)), lang, source) for i in range(n)]

    junk = [*some(1000, 2, "##", "es", "few"), *some(1100, 12, "##", "es", "mixed"), *some(1200, 1, "##", "xx", "few")]
    kept = [*some(0, 200, "", "es", "a"), *some(300, 2, "", "es", "few"), *some(400, 28, "", "es", "mixed"),
            *some(500, 30, "##", "es", "code"), *some(600, 3, "", "xx", "few"), *some(700, 2, "", None, None)]
    df = spark.createDataFrame(junk + kept, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in rows(quality.judge(df)) if not r["kept"]) == sorted(x[0] for x in junk)


def test_quality_sketches_add_up_and_repeat(spark):
    """Sketches of two halves added up are those of all rows, whatever the
    partitions, and quartiles are the exact ones' bins."""
    df = spark.range(30_000).selectExpr(
        "id AS doc_id", "'en' AS lang", "CASE WHEN id % 3 = 0 THEN 's' ELSE 't' END AS source", "false AS base_failed",
        "pmod(xxhash64(id), 1000003) / 1000003D AS symbol_share", "0D AS dup_line_share",
        "pmod(xxhash64(id, 1), 5000) / 5000D AS capital_share", "exp(pmod(xxhash64(id, 2), 1000) / 60D) AS word_length")
    keys = ("lang", "source")
    whole = sorted(map(tuple, quality.sketches(df).collect()))
    halves = quality.sketches(df.where("doc_id < 9000")).unionByName(quality.sketches(df.where("doc_id >= 9000")))
    assert whole == sorted(map(tuple, quality.merged(halves, *keys).collect()))
    limits = [sorted(map(tuple, quality.thresholds(quality.sketches(df.repartition(n))).collect())) for n in (1, 7)]
    assert limits[0] == limits[1] and len(limits[0]) == 2
    mids = {(r["source"], r["measure"]): r["mid"] for r in quality.fences(quality.sketches(df), *keys).collect()}
    for source in ("s", "t"):
        for c in quality.LEAST:
            values = sorted(r[0] for r in df.where(f"source = '{source}'").select(c).collect())
            exact = values[(len(values) + 1) // 2 - 1]
            assert mids[source, c] <= exact <= mids[source, c] * (1 + 2 / quality.TOP) + 1 / quality.SCALE[c]


def test_quality_threshold_changes_smoothly_with_the_group(spark):
    """No group size at which a threshold jumps: one row more moves it little."""
    def limit(n):
        x = spark.createDataFrame([("en", "all", c, 0, 1000) for c in quality.LEAST]
                                  + [("en", "few", c, 400, n) for c in quality.LEAST],
                                  "lang string, source string, measure string, bin long, n long")
        return next(r["max_symbol_share"] for r in quality.thresholds(x).collect() if r["_source"] == "few")

    found = [limit(n) for n in (4, 5, 19, 20, 21)]
    assert found == sorted(found) and found[1] - found[0] < 0.01 and found[4] - found[2] < 0.005


def test_quality_base_sql(docs):
    import duckdb

    documents = docs.select("doc_id", "text").toPandas()     # the view that the SQL names
    con = duckdb.connect()
    con.register("documents", documents)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = con.sql(f"SELECT {', '.join(names)} FROM ({quality.BASE_SQL})").fetchall()
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in rows(quality.judge(docs)))


# ------------------------------------------------------------------ langid --
def test_langid_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)


def test_langid_edges(spark, edge):
    got = {r["doc_id"]: r for r in rows(langid.identify(edge))}
    for d in (4, 5, 6):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["accepted"]) == ("und", 0.0, False)
    assert got[7]["lang_pred"] == "en"
    unlabelled = edge.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r["lang_pred"], r["accepted"]) for r in rows(langid.identify(unlabelled)) if r["doc_id"] == 7} == {("und", True)}


# ------------------------------------------------------------------- dedup --
def brute_dedup(pairs, window=20):
    """pairs in order, distinct documents; (n_words, n_removed, kept)."""
    seen, out = set(), []
    for _, t in pairs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if k in seen:
                gone[i:i + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_substring_dedup(docs, texts):
    got = sorted(rows(substring_dedup.report(docs)), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute_dedup(texts)


def test_substring_dedup_overlaps_and_edges(spark, edge):
    line = [f"p{i}" for i in range(60)]
    pairs = [(0, " ".join(line[:35])), (1, " ".join(["q"] + line[10:50])), (2, " ".join(line[5:60] + line[5:60])),
             (3, " ".join(["r"] * 70)), (4, " ".join(["s"] * 19 + ["r"] * 20)), (5, " ".join(line[:19])), (6, None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = sorted(rows(substring_dedup.report(df)), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute_dedup(pairs)
    by_id = {r["doc_id"]: r["n_removed"] for r in rows(substring_dedup.report(edge)) if r["doc_id"] not in (None, 3)}
    assert (by_id[1], by_id[2]) == (0, 32) and by_id[9] > 6000 - 20
    kept = {r["doc_id"]: r for r in rows(substring_dedup.dedup(edge)) if r["doc_id"] is not None}
    assert 2 not in kept and kept[1]["text"] == EDGE[0][1] and kept[9]["n_chars"] == len(kept[9]["text"])


def test_substring_dedup_deals_crowded_anchors(spark):
    opening = " ".join(f"o{i}" for i in range(18))
    own = [" ".join(f"d{i}w{j}" for j in range(30)) for i in range(400)]
    pairs = [(i, f"{opening} {own[i // 2 if i % 5 == 0 else i]}") for i in range(400)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    marked = substring_dedup.recurring_anchors(df, 20, 8)
    places = substring_dedup.passages(df, marked, 20, 8).cache()
    assert substring_dedup.crowded_anchors(places, 50).count() > 0
    few, many = substring_dedup.dealt(places, 20, 50)
    assert max([r["count"] for r in rows(few.groupBy("anchor").count())], default=0) <= 50
    met = [r["count"] for r in rows(many.groupBy("shard").count())]
    assert len(met) > 8 and max(met) < sum(met) / 8
    for crowd in (0, 50, 10**9):
        got = sorted(rows(substring_dedup.report(df, crowd=crowd)), key=lambda r: r["doc_id"])
        assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute_dedup(pairs)


# ----------------------------------------------------------------- license --
def test_license_base(docs, texts, edge):
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    for df, pairs in ((docs, texts), (edge, [x for x in EDGE])):
        want = []
        for d, t in pairs:
            p = license_scan.base_places(t)
            low = (t or "").translate({c: c + 32 for c in range(65, 91)})
            want.append((d, len(re.findall(pattern, low)), len(p), min(p)[0] if p else None, max(p)[0] if p else None,
                         ",".join(sorted({x for _, x in p}))))
        got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
               for r in rows(license_scan.scan(df))]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_license_method_spans(spark):
    mit = license_scan.SENTENCES[0][0].split()
    near = " ".join(mit[:8] + ["put", "in"] + mit[8:])
    far = " ".join(mit[:6])
    df = spark.createDataFrame([(1, "x " + near + " y"), (2, far), (3, "cc by nc cc by nc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(license_scan.scan(df))}
    assert (got[1]["labels"], got[1]["n_base"], got[2]["labels"]) == ("mit", 0, "")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["score"]) == (2, 0, 3, 1.0)


def test_license_one_edit_of_every_sentence(spark):
    pairs, want = [], {}
    for sentence, label in license_scan.SENTENCES:
        w = sentence.split()
        for i in range(len(w) + 1):
            forms = [w[:i] + ["put"] + w[i:]]
            if i < len(w) and w[i] not in license_scan.TELLING:
                forms += [w[:i] + ["other"] + w[i + 1:], w[:i] + w[i + 1:]]
            for form in forms:
                if max(sum(form[j:j + 3] == w[k:k + 3] for j in range(len(form) - 2)) for k in range(len(w) - 2)):
                    want[len(pairs)] = label
                    pairs.append((len(pairs), " ".join(["x", "y", *form, "z"])))
    others = ["licensed under cc by sa 4 0", "licensed under the mozilla license version 2 0", "licensed under the"]
    pairs += [(10_000 + i, x) for i, x in enumerate(others)]
    got = {r["doc_id"]: r["labels"].split(",") for r in rows(license_scan.scan(
        spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)))}
    assert [(pairs[d][1], got[d]) for d, label in want.items() if label not in got[d]] == []
    assert [got[10_000 + i] for i in range(len(others))] == [[""]] * len(others)


# ------------------------------------------------------------------ mixing --
def test_mixing_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(mixing.SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op10_mixing(spark, sf).collect())
    assert [(*x[:3], round(x[3], 6), x[4]) for x in got] == [(*x[:3], round(x[3], 6), x[4]) for x in want]
    words_of = {}
    for _, size, _, target, taken in got:
        assert taken in (0, size, 2 * size)
        words_of[target] = words_of.get(target, 0) + taken
    assert abs(sum(x[4] for x in got) / sum(x[1] for x in got) - 1.5) < 0.01


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(i, "a b c", s) for i, s in enumerate("aaaabbbbcccc")], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix_report(df))}
    assert Counter(r["doc_id"] for r in rows(mixing.mix(df))) == Counter({d: n // 3 for d, n in taken.items() if n})


# -------------------------------------------------------------------- html --
@pytest.mark.parametrize("markup,text", [
    (None, ""), ("", ""), ("a <b>b</b>\n c", "a b c"), ("<p>a<p>b", "a\n\nb"), ("x<br>y", "x\ny"),
    ("<ul><li>x<li>y<ol start=3><li>q</ol></ul>", "- x\n- y\n  3. q"),
    ("<table><tr><td>1<td>22<tr><td>333<td>4</table>", "1   | 22\n333 | 4"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<div hidden>no</div><i style='display: none'>no</i>yes<script>var a='<p>'</script>", "yes"),
    ("<style>.h{display:none}</style><p class='h g'>no</p>ok", "ok"), ("<pre>\n a  b\n   c\n</pre>d", " a  b\n   c\n\nd"),
    ("&amp;&lt;x", "&<x"), ("<details><summary>s</summary>gone</details>e", "s\ne"), ("a</b></p>b<unknown>c", "ab" + "c"),
    ("<div>" * 3000 + "deep", "deep"), ("cut <b off", "cut <b off"),
])
def test_html(markup, text):
    assert html_text.visible_text(markup) == text


@pytest.mark.parametrize("markup,text", [
    ("<html><head><title>t</title><p>text", "text"), ("<head><meta x=y> \nwords <b>b</b>", "words b"),
    ("<style>@media print{.n{display:none}} @media screen and (max-width:9px){.n{display:none}}</style><p class=n>a", "a"),
    ("<style>@media screen{.n{display:none}} /* p{display:none} */</style><p class=n>a<p>b", "b"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<i style='backface-visibility:hidden'>a</i><i style='visibility:hidden'>b<b style='visibility:visible'>c</b></i>", "ac"),
    ("<style>.a{display:none}.b{display:block}</style><p class='b a'>x", "x"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<svg><title>no</title><defs/><path d='z'/>no<text>a</text><text>b</text></svg>c<svg><p>d", "a b c\n\nd"),
    ("<xmp>a  <b>&amp;</xmp>c", "a  <b>&amp;\n\nc"),
    ("<table><table style='visibility:hidden'><td style='visibility:visible'>x", "x"),
])
def test_html_drops_no_visible_text(markup, text):
    assert html_text.visible_text(markup) == text


def test_html_keeps_every_visible_word(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            self.parts.append("" if tag in ("a", "b", "i") else " ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            self.parts.append("" if tag in ("a", "b", "i") else " ")

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in rows(queries.op2_html_text(spark, SF))}
    assert got.keys() == pages.keys()
    for k, markup in pages.items():
        p = Plain()
        p.feed(markup or "")
        p.close()
        assert [w for w in got[k].split() if w != "-"] == [w for w in "".join(p.parts).split() if w != "-"]


# ---------------------------------------------------------------- pipeline --
def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline as cp

    got, kept = docs, []
    for _, stage in cp.STAGES:
        got = stage(spark, got, SF)
        got = spark.createDataFrame(got.collect(), got.schema)
        kept.append(got)
    assert [k.columns == docs.columns for k in kept] == [True] * 4 + [False]
    first = {r["doc_id"] for r in kept[0].collect()}
    assert first >= {d for d, t in texts if len(words(t)) > 5}
    near = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    inputs = sorted((r["doc_id"], r["text"]) for r in kept[0].collect())
    assert [d for d, _ in near] == sorted({c for _, _, c in brute_components(inputs)})
    cut = {r["doc_id"]: len(words(r["text"])) for r in kept[2].collect()}
    assert cut == {d: n - gone for (d, _), (n, gone, _) in zip(near, brute_dedup(near)) if n > gone or not n}
    mixed_words = sum(len(words(r["text"])) for r in kept[3].collect())
    assert abs(mixed_words - 1.5 * sum(cut.values())) < 0.05 * sum(cut.values())
    assert {r["doc_id"] for r in kept[4].collect()} == {r["doc_id"] for r in kept[3].collect()}


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunked_ids_are_the_librarys(name, drops):
    from tokenizers import Tokenizer

    from veeduria.llm.queries import vocabulary
    from veeduria.llm.tokens import Encoder

    texts = ["İstanbul İ x", "ǅ ab ŉ", "don't we|you | | x", "한글 각 각", "a  b \n c", " lead", "trail ", "", "|",
             "ﬁne ß µ ª", "中文 汉字 テスト ไทย", "a\x1cb c", "Ⅷ K Å Å", "hello, world. (foo) 's 're l'm", "ÀÉ Àé, ß!"]
    plain = Tokenizer.from_file(vocabulary(name))
    plain.encode_special_tokens = True
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocabulary(name), drops).encode(texts)] == want
