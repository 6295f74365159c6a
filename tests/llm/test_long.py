"""One very long text with very many matches or words: work must stay near linear in it."""

import hashlib
import time

from arborium.llm import pii, quality
from tests.llm.test_exact import base_spans


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def within(seconds, df):
    began = time.perf_counter()
    rows = sorted(df.collect())
    assert time.perf_counter() - began < seconds
    return rows


def test_200000_spans(spark):
    text = "".join(f"é a{k}@b.co contact 10.0.{k % 256}.1, " for k in range(100_000))
    (row,) = within(40, pii.find(frame(spark, text)))
    assert (row.n_email, row.n_ip) == (100_000, 100_000)
    assert row.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    (row,) = within(40, pii.masked_stage(frame(spark, text)))
    assert row.text == "é <EMAIL> contact <IP>, " * 100_000


def test_long_runs(spark):
    runs = lambda n: ["7" * n, "a" * n + "@b", "+1" + " " * n, "1." * (n // 2), "123-45-6789 " * (n // 12), "4111 1111 1111 1111 x " * (n // 20)]
    for text, row in zip(runs(2400), within(40, pii.find(frame(spark, *runs(2400)))), strict=True):
        assert row.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    got = within(40, pii.find(frame(spark, *runs(300_000))))
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 37_500, 0, 0), (0, 0, 0, 0), (0, 0, 15_000, 0)]


def test_context_across_blocks(spark):
    texts = [" " * n + "my ssn is 123-45-6789, and 234-56-7890" + "x" * 60 + "345-67-8901 part 456-78-9012" for n in range(230, 262)]
    for n, row in zip(range(230, 262), sorted(pii.find(frame(spark, *texts)).collect()), strict=True):
        assert row.spans == f"national_id:{n + 10}:{n + 21},national_id:{n + 27}:{n + 38}"


def test_200000_words_in_a_sampled_text(spark):
    text = " ".join(f"w{k % 150_000}" for k in range(200_000))
    began = time.perf_counter()
    (row,) = quality.judge(frame(spark, text)).collect()
    assert time.perf_counter() - began < 40
    assert (row.n_words, row.n_repeat_words, row.rejected_by) == (200_000, 100_000, "base")
