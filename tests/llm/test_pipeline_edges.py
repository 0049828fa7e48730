"""The pipeline's stages on edge cases: nulls, texts without letters, repeated
rows, extra columns, a table without labels, an empty one."""

from __future__ import annotations

import pytest

import corpus_pipeline
from veeduria.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"
WORDS = " ".join(f"word{i}" for i in range(60))


def stages(spark, rows):
    """(name, rows, same columns) after each stage."""
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, "unused")
        got = result.collect()
        out.append((name, got, result.columns == docs.columns))
        docs = spark.createDataFrame(got, result.schema)
    return out


def test_edge_rows(spark):
    rows = [(i, f"the cat {i} and the dog of {WORDS}", "en", "a", 9, 1, "k") for i in range(12)]
    rows += [rows[3], (20, None, "en", "a", None, 1, "k"), (21, "", "en", None, 0, 1, "k"), (22, "42 ² !", None, None, 6, 1, "k"),
             (None, "a null id text of words", "en", "b", 1, 1, "k"), (30, "one two", "en", "b", 7, 1, "k")]
    found = stages(spark, rows)
    by = {name: got for name, got, _ in found}
    assert all(same for _, _, same in found[:4])
    assert len(by["language_id"]) == 15 and not {20, 21, 22} & {r.doc_id for r in by["language_id"]}
    assert {r.doc_id for r in by["near_duplicates"]} == {0, 30, None} and len(by["near_duplicates"]) == 3
    assert {r.doc_id for r in by["packed_windows"]} == {0, 30, None}


@pytest.mark.parametrize("rows, kept", [([], 0), ([(1, "some words here", None, None, 3, 1, "k"), (2, "12", None, None, 2, 1, "k")], 1)])
def test_no_labels_and_no_rows(spark, rows, kept):
    found = stages(spark, rows)
    assert [len(got) for _, got, _ in found[:3]] == [kept] * 3 and bool(found[-1][1]) == bool(kept)


def test_texts_without_words_follow_their_source(spark):
    rows = [(1, "", "en", "a", 0, 1, "k"), (2, "a b c d", "en", "a", 7, 1, "k"), (3, None, "en", "b", 0, 1, "k")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {1, 2}
