"""Every operator on odd rows and on an empty table."""

import pytest

from arborium.llm import lattice_lm, media, merkle, mixing, neardup, packing, pii, quality, resampling, token_files, toxicity, url_trust


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 1), (4, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "media": lambda d, labels: media.stored_documents(d),
    "quality": lambda d, labels: quality.judge(d),
    "token_files": lambda d, labels: token_files.round_trip(d),
    "pii": lambda d, labels: pii.find(d),
    "mixing": lambda d, labels: mixing.mix_documents(d),
    "toxicity": lambda d, labels: toxicity.judge(d, labels),
    "lattice_lm": lambda d, labels: lattice_lm.score_documents(d),
    "neardup": lambda d, labels: neardup.classify(d),
    "packing": lambda d, labels: packing.pack(d),
    "resampling": lambda d, labels: resampling.resample(d, d),
    "merkle": lambda d, labels: merkle.manifest(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, labels, name):
    rows = RUNS[name](odd, labels).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, 6, 7, 8, None}
    if name != "packing":
        assert len(rows) == odd.count()


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(empty, labels, name):
    assert RUNS[name](empty, labels).collect() == []


STAGES = {
    "toxicity": lambda d, labels: toxicity.clean_stage(d, labels),
    "neardup": lambda d, labels: neardup.one_of_each_stage(d),
    "pii": lambda d, labels: pii.masked_stage(d),
    "mixing": lambda d, labels: mixing.mixed_stage(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(odd, empty, labels, name):
    out = STAGES[name](odd, labels)
    assert out.columns == odd.columns and out.count() > 0
    assert STAGES[name](empty, labels).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='http://x.net/'>"), (None, "HTTP://A.Net/de/?q", ""), (3, "http://x.example.org/en", None), (3, "http://x.example.org/en", None), (4, "http://y.example.net/en/a", "")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.net", "/de/", "net/", "block"), (3, "x.example.org", "/en", None, "allow"), (4, "y.example.net", "/en/a", "example.net/en/", "allow")}
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
