"""The similarity of near copies as a parameter."""

import corpus_pipeline
from arborium.llm import neardup


def shingle_set(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def pairs(spark, changed):
    """Pairs (2 k, 2 k + 1) of texts, the second with a run of changed words at its end."""
    rows = []
    for k in range(20):
        w = [f"p{k}w{j}" for j in range(204)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[: 204 - changed], *(f"x{k}{j}" for j in range(changed))]))]
    a, b = (shingle_set(rows[j][1]) for j in (0, 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), len(a & b) / len(a | b)


def test_stage_drops_copies_at_082(spark):
    frame, share = pairs(spark, 20)
    assert 0.815 < share < 0.825
    assert {r.doc_id for r in corpus_pipeline.drop_close_copies(spark, frame, "").collect()} == set(range(0, 40, 2))
    assert neardup.classify(frame).filter("kept").count() == 40
    assert dict(corpus_pipeline.STAGES)["near_duplicates"] is corpus_pipeline.drop_close_copies


def test_stage_keeps_what_is_less_alike(spark):
    frame, share = pairs(spark, 23)
    assert 0.78 < share < 0.8
    assert corpus_pipeline.drop_close_copies(spark, frame, "").count() == 40


def test_bands_follow_the_similarity():
    for percent in (80, 85, 90):
        like = neardup.Likeness(percent)
        assert (1 - (percent / 100) ** like.rows) ** like.bands <= neardup.MISS and like.bands * like.rows <= neardup.SAMPLES
    assert [(neardup.Likeness(p).bands, neardup.Likeness(p).rows) for p in (80, 85)] == [(28, 5), (24, 6)]
