"""The pipeline against its stages' own promises."""

import zlib

import corpus_pipeline
from arborium.llm import neardup, tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).persist())
    first, clean, single, masked, mixed, packed = seen
    model = toxicity.learn(toxicity.labelled_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    automaton = model.automaton()
    passes = lambda t: model.score(toxicity.weigh(automaton, (t or "").encode())) < toxicity.THRESHOLD
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in first.collect() if passes(r.text)}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in neardup.classify(clean, corpus_pipeline.COPY_PERCENT).collect() if r.kept}
    assert [f.columns for f in (clean, single, masked, mixed)] == [docs.columns] * 4
    assert masked.count() == single.count() and "<IP>" in " ".join(r.text for r in masked.collect())
    encoder = tokens.Encoder.at(tokens.default_path())
    want = sum(len(encoder.encode(r.text.encode())) // 4 for r in mixed.collect())
    assert packed.agg({"length": "sum"}).first()[0] == want
    texts = {r.doc_id: encoder.encode(r.text.encode()) for r in mixed.collect()}
    for r in packed.collect():
        assert zlib.crc32(texts[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
