"""Near copies where ids repeat: no text may get lost, whatever the order of rows."""

import pytest

from arborium.llm import neardup

A, B = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
ROWS = [
    (1, A, "x"), (1, B, "x"), (1, "", "x"), (1, None, "x"), (1, A, "y"), (2, A.upper(), "x"), (3, B + " end", "x"), (None, A, "x"), (None, None, "x"),
    (4, "few words", "x"), (4, "few words", "x"), (4, "few other", "x"), (5, "few other", "x"), (6, " \t\n", "x"), (6, " \t\n", "x"), (7, A + " z", "x"), (7, A + " y", "x"),
]


@pytest.mark.parametrize("turned", [1, -1])
def test_stage_keeps_each_text(spark, turned):
    docs = spark.createDataFrame(ROWS[::turned], "doc_id long, text string, dup_key string")
    out = neardup.one_of_each_stage(docs, 80)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, A), (1, B), (1, ""), (1, None), (None, A), (None, None), (4, "few words"), (4, "few other"), (6, " \t\n"), (6, " \t\n")]
    assert got == sorted(want, key=str)


def test_components_of_shared_ids(spark):
    rows = [(5, A), (1, B), (1, A), (2, "alone it stands here today"), (2, B + " end")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 36, 1, False), (1, 36, 1, True), (2, 1, 2, True), (2, 37, 1, False)}


def test_blocks_by_bytes(spark, monkeypatch):
    """Units that are cut by the bytes of their sets give the same components."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[: 50 + k % 3], *(f"{k // 4}x{j}" for j in range(3 * (k % 5)))])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, neardup.classify(docs).collect()))
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, neardup.classify(docs).collect())) == whole
