"""Formats: written and read again, and small files by hand."""

import gzip
import zlib

import numpy as np
import pytest

from arborium.sources import formats, registry, swc


def test_swc_round_trip(spark, tmp_path):
    (tmp_path / "a.swc").write_text("# made\n1 2 0 0 0 1.5 -1\n2 2 1 0 0 0.5 1\n 3 2 2 0 0 0.5 -3\n")
    v = swc.read(spark, f"file://{tmp_path}/a.swc")
    got = [tuple(r) for r in v.orderBy("point_no").collect()]
    assert got == [("a", 1, 2, 0, 0, 0, 3.0, -1), ("a", 2, 2, 1, 0, 0, 1.0, 1), ("a", 3, 2, 2, 0, 0, 1.0, -1)]
    swc.write(v, f"file://{tmp_path}/out")
    text = sorted((tmp_path / "out" / "neuron_id=a").glob("*.txt"))[0].read_text().splitlines()
    assert text[1] == "2 2 1.0 0.0 0.0 0.5 1"


AM = """# AmiraMesh 3D ASCII 2.0
define Lines 4
define Vertices 3
Parameters { ContentType "HxLineSet" }
Vertices { float[3] Coordinates } @1
Vertices { float Data } @2
Lines { int LineIdx } @3
# Data section follows
@1
0 0 0
1 0 0
2 0 0

@2
0.5
0.5
1

@3
0
1
2
-1
"""


def test_line_sets(spark, tmp_path):
    rows = formats.lineset(AM.encode())
    assert [(r[0], r[5], r[6]) for r in rows] == [(1, 1.0, -1), (2, 1.0, 1), (3, 2.0, 2)]
    assert registry.choose("x.am", AM.encode()).name == "hxlineset"
    (tmp_path / "b.am").write_bytes(gzip.compress(AM.encode()))
    assert registry.read(spark, f"file://{tmp_path}/b.am", "hxlineset").count() == 3


def test_failures(spark, tmp_path):
    (tmp_path / "ok.am").write_text(AM)
    (tmp_path / "bad.am").write_text("nothing")
    assert registry.read(spark, f"file://{tmp_path}", "hxlineset", omit_failures=True).select("neuron_id").distinct().count() == 1
    with pytest.raises(Exception):  # noqa: B017
        registry.read(spark, f"file://{tmp_path}", "hxlineset").collect()


def test_byte_runs_and_zlib():
    assert formats.byte_runs(bytes([3, 7, 130, 1, 2]), 5) == bytes([7, 7, 7, 1, 2])
    raw = np.arange(6, dtype="<f4").tobytes()
    packed = zlib.compress(raw)
    head = f"# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\ndefine Lattice 6\nLattice {{ float Data }} @1(HxZip,{len(packed)})\n@1\n".encode()
    assert formats.amira_sections(head + packed)["Data"].tolist() == [0, 1, 2, 3, 4, 5]


def test_surfaces():
    vertices = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)]
    faces = [("part", 1, 1, 2, 3)]
    assert formats.surface(formats.surface_text(vertices, faces).encode()) == (vertices, faces)
    outer = formats.surface_text(vertices, faces).replace("InnerRegion part", "InnerRegion Exterior").replace("OuterRegion Exterior", "OuterRegion part")
    assert formats.surface(outer.encode())[1] == [("part", 1, 1, 3, 2)]
    assert formats.ply_mesh(formats.ply_text(vertices, faces).encode()) == (vertices, [("mesh", 1, 1, 2, 3)])
    assert formats.obj_mesh(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n") == (vertices, [("mesh", 1, 1, 2, 3)])


@pytest.mark.parametrize("encoding", ["raw", "gzip", "text"])
def test_nrrd(encoding):
    values = np.arange(24, dtype="int16").reshape(2, 3, 4)
    fields, got = formats.nrrd(formats.nrrd_bytes(values, (1.0, 2.0, 0.5), encoding))
    assert (got == values).all() and formats.voxel_sizes(fields) == [1, 2, 0.5]


def test_voxel_size_adds_components():
    assert formats.voxel_sizes({"space directions": "(3,4,0) (0,2,0) (0,0,1)"}) == [7, 2, 1]


def test_raw_stack():
    values = np.arange(8, dtype="<u2").reshape(2, 2, 2, order="F")
    data = b"raw_image_stack_by_hpengL" + np.array([2, 2, 2, 2, 1], "<i2").tobytes() + values.tobytes(order="F")
    assert (formats.raw_stack(data) == values).all()


def test_landmarks_and_typed_stream():
    text = b'! TYPEDSTREAM 1.1\n\nlandmark {\n\tname "a"\n\tlocation 1 2 3\n}\nlandmark {\n\tname "b"\n\tlocation 4 5 6\n}\n'
    assert formats.landmarks(text) == [(1, "a", 1, 2, 3), (1, "b", 4, 5, 6)]
    assert formats.landmarks(b'<?xml version="1.0"?><namedpointset><pointworld set="true" name="p" x="1" y="2" z="3"/></namedpointset>') == [(1, "p", 1, 2, 3)]


def test_traces():
    text = b'<?xml version="1.0"?><tracings><path id="0"><point x="0" y="0" z="0" xd="0" yd="0" zd="0"/><point x="1" y="0" z="0" xd="1" yd="0" zd="0"/></path><path id="1" startson="0" startsindex="1"><point x="1" y="1" z="0" xd="1" yd="1" zd="0"/></path></tracings>'
    assert [r[6] for r in formats.traces(text)] == [-1, 1, 2]


def test_morphml():
    text = b'<morphml xmlns:m="u"><cells><cell><m:segments xmlns:m="u"><m:segment id="0" cable="0"><m:proximal x="0" y="0" z="0" diameter="2"/><m:distal x="1" y="0" z="0" diameter="1"/></m:segment><m:segment id="1" parent="0"><m:distal x="2" y="0" z="0" diameter="1"/></m:segment></m:segments></cell></cells></morphml>'
    assert [(r[0], r[2], r[6]) for r in formats.morphml(text)] == [(1, 0, -1), (2, 1, 1), (3, 2, 2)]


def test_vtk():
    rows = [(1, 2, 0.0, 0.0, 0.0, 1.0, -1), (2, 2, 1.0, 0.0, 0.0, 1.0, 1)]
    assert "LINES 1 3\n2 0 1" in formats.vtk_text(rows)


@pytest.mark.parametrize("shape", [(5,), (3, 4), (2, 3, 4), (2, 3, 2, 3), (2, 2, 2, 2, 2)])
def test_images_of_any_number_of_dimensions(spark, tmp_path, monkeypatch, shape):
    values = np.arange(np.prod(shape), dtype=np.int32).reshape(shape)
    (tmp_path / "a.nrrd").write_bytes(formats.nrrd_bytes(values, (1.0,) * len(shape)))
    monkeypatch.setattr(registry, "SLAB", 7)
    got = {(r.i, r.j, r.k, *r.more): r.value for r in registry.read(spark, f"file://{tmp_path}/a.nrrd", "nrrd", "image").collect()}
    full = values.reshape(*shape, *(1,) * max(0, 3 - len(shape)))
    assert got == {tuple(int(v) + 1 for v in at): float(full[at]) for at in np.ndindex(full.shape)}
