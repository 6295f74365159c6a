import shutil

from arborium.streaming import ingest
from tests.test_sources import AM


def test_only_new_content_is_parsed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.am").write_text(AM)
    run = lambda: ingest.ingest(spark, f"file://{tmp_path}/in", "hxlineset", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out/rows").count() == 3
    (tmp_path / "in" / "b.am").write_text(AM)
    run()
    rows = spark.read.parquet(f"file://{tmp_path}/out/rows")
    assert {r.neuron_id: r["count"] for r in rows.groupBy("neuron_id").count().collect()} == {"a": 3, "b": 3}


def test_a_batch_that_was_broken_off_comes_once(spark, tmp_path):
    """Rows are written, the list of files isn't: the batch runs again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.am").write_text(AM)
    run = lambda check: ingest.ingest(spark, f"file://{tmp_path}/in", "hxlineset", f"file://{tmp_path}/out", f"file://{tmp_path}/{check}").awaitTermination()
    count = lambda: spark.read.parquet(f"file://{tmp_path}/out/rows").count()
    run("check")
    shutil.rmtree(tmp_path / "out" / "files")
    for left in (tmp_path / "check" / "commits").iterdir():
        left.unlink()
    run("check")
    assert count() == 3
    (tmp_path / "in" / "a.am").rename(tmp_path / "gone.am")
    (tmp_path / "in" / "c.am").write_text(AM)
    run("other")
    assert count() == 6
