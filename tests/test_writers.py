"""Line sets, skeletons and landmarks: written by Spark, read back by the readers."""

import pytest

from arborium.sources import formats, registry, writers

TREES = {
    "a": {1: (-1, 0.0, 0.0, 0.0, 1.0), 2: (1, 1.0, 0.0, 0.5, 2.0), 5: (2, 2.0, 1.0, 0.0, 0.25), 4: (2, 2.0, -1.0, 0.0, 3.0), 3: (4, 3.5, -1.0, 1e-5, 1.0)},
    "b": {7: (-1, 5.0, 0.0, 0.0, None), 8: (7, 6.0, 0.0, 0.0, 1.0), 1: (-1, 9.0, 9.0, 9.0, 1.0), 2: (1, 9.0, 9.0, 8.0, 1.0), 3: (2, 9.0, 9.0, 7.0, 1.0), 9: (-1, 0.0, 0.0, 1.0, 2.0)},
}


def table(spark):
    rows = [(n, p, 2, *v[1:], v[0]) for n, tree in TREES.items() for p, v in tree.items()]
    return spark.createDataFrame(rows, "neuron_id string, point_no long, label int, x double, y double, z double, w double, parent long")


def content(tmp_path, name):
    (part,) = (tmp_path / "out" / f"neuron_id={name}").glob("*.txt")
    return part.read_bytes()


def places(tree):
    at = {p: v[1:4] for p, v in tree.items()}
    return {at[p] for p in tree}, {frozenset((at[p], at[v[0]])) for p, v in tree.items() if v[0] != -1}


@pytest.mark.parametrize("form", ["hxlineset", "hxskel"])
def test_trees(spark, tmp_path, form):
    writers.write(writers.writer_for(form)(table(spark)), f"file://{tmp_path}/out")
    for name, tree in TREES.items():
        data = content(tmp_path, name)
        got = {r[0]: (r[6], *r[2:5], r[5]) for r in registry.FORMATS[form].parse(data)}
        assert places(got) == places(tree)
        widths = {v[1:4]: v[4] for v in tree.values()}
        known = form == "hxskel" or name == "a"
        for v in got.values():
            assert v[4] == widths[v[1:4]] if known and widths[v[1:4]] is not None else v[4] != v[4]


def test_lines_follow_segments(spark, tmp_path):
    writers.write(writers.lineset_lines(table(spark)), f"file://{tmp_path}/out")
    text = content(tmp_path, "a").decode()
    assert text.split("\n@3\n")[-1].split() == "0 1 -1 1 2 3 -1 1 4 -1".split()


def test_landmarks(spark, tmp_path):
    rows = [("m", s, k, float(k), s * 0.5, -1.0) for s in (1, 2) for k in (1, 2, 3)]
    marks = spark.createDataFrame(rows, "neuron_id string, set_id long, mark long, x double, y double, z double")
    writers.write(writers.writer_for("landmarks")(marks), f"file://{tmp_path}/out")
    assert [(s, int(n), *p) for s, n, *p in formats.landmarks(content(tmp_path, "m"))] == [(r[1], r[2], *r[3:]) for r in rows]
    with pytest.raises(Exception, match="different numbers"):
        writers.landmark_lines(marks.filter("set_id = 1 or mark < 3")).collect()


def test_unknown_writers():
    with pytest.raises(ValueError, match="only read"):
        writers.writer_for("nrrd")
    with pytest.raises(ValueError, match="no such"):
        writers.writer_for("nothing")
