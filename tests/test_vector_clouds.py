"""Methods of vector clouds and images, and guesses of formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborium.operators import images as I
from arborium.operators import vector_clouds as V
from arborium.sources import swc


def cloud(spark):
    rng = np.random.default_rng(3)
    rows = [(n, k, *map(float, p)) for n in (1, 2) for k, p in enumerate(rng.normal(size=(30, 3)) * [5, 1, 0.3])]
    return V.cloud(spark.createDataFrame(rows, "neuron_id long, point_no long, x double, y double, z double"), 6)


def test_clouds(spark):
    c = cloud(spark).persist()
    flip = F.when(F.col("point_no") % 2 == 0, -1.0).otherwise(1.0)
    turned = c.withColumns({v: flip * F.col(v) for v in V.VECTOR})
    assert V.differing(c, turned).collect() == []
    assert [r.neuron_id for r in V.differing(c, turned.withColumn("x", F.when((F.col("neuron_id") == 2) & (F.col("point_no") == 3), F.col("x") + 0.1).otherwise(F.col("x")))).collect()] == [2]
    assert [r.neuron_id for r in V.differing(c, c.filter("neuron_id = 1 or point_no > 0")).collect()] == [2]
    assert V.subset(c, F.col("x") > 0).count() + V.subset(c, F.col("x") > 0, invert=True).count() == 60
    stats = V.scaled(c, 6).groupBy("neuron_id").agg(F.avg("x").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and r.s == pytest.approx(1) for r in stats)
    assert V.checked(c.withColumn("more", F.lit(1))).columns[-1] == "more"
    with pytest.raises(ValueError, match="missing"):
        V.checked(c.drop("alpha"))


def test_images(spark):
    a = spark.createDataFrame([(n, i, 1, 1, float(i)) for n in (1, 2, 3) for i in (1, 2, 3)], "image_id long, i long, j long, k long, value double")
    b = a.withColumn("value", F.col("value") * F.when(F.col("image_id") == 2, 1 + 1e-3).otherwise(1 + 1e-9)).filter("image_id <> 3 or i < 3")
    assert sorted(r.image_id for r in I.differing(a, b, "image_id").collect()) == [2, 3]


def test_swc_by_text_and_name(spark, tmp_path):
    held = {"a.txt": "# c\n\n1 2 0 0 1e-3 .5 -1\n", "b.txt": "1 2 0 0 0 0.5\n", "c.txt": "x\n1 2 0 0 0 0.5 -1\n", "d.swc": "nothing", "e.txt": "1 2 0 0 0 NA -1", "f.txt": "1.5 2 0 0 0 1 -1\n", "g.txt": "# only\n"}
    for name, text in held.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rpartition("/")[2]: r.is_swc for r in swc.looks_like_swc(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": True, "b.txt": False, "c.txt": False, "d.swc": True, "e.txt": True, "f.txt": False, "g.txt": False}
    assert {r.is_swc for r in swc.looks_like_swc(spark, f"file://{tmp_path}/d.swc", trust_suffix=False).collect()} == {False}
