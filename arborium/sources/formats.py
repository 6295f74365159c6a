"""Parsers and writers of whole files: bytes in, rows out. Each is a small function over one file."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from xml.etree import ElementTree

import numpy as np

VERTEX = ("point_no", "label", "x", "y", "z", "w", "parent")


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def oriented(points: np.ndarray, pairs: list[tuple[int, int]], diameters: np.ndarray) -> list[tuple]:
    """Vertex rows from undirected edges of places; each component's root is its first end point, or first point."""
    near: list[list[int]] = [[] for _ in points]
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        near[a].append(b)
        near[b].append(a)
    parent = [0] * len(points)
    for start in [*(k for k, n in enumerate(near) if len(n) == 1), *range(len(points))]:
        if parent[start]:
            continue
        parent[start], stack = -1, [start]
        while stack:
            k = stack.pop()
            for m in sorted(near[k]):
                if not parent[m]:
                    parent[m] = k + 1
                    stack.append(m)
    return [(k + 1, 2, *map(float, p), float(w), q) for k, (p, w, q) in enumerate(zip(points, diameters, parent, strict=True))]


def amira_sections(data: bytes) -> dict[str, np.ndarray]:
    """Data sections of an AmiraMesh file by name: ASCII, binary of either byte order, byte runs or zlib."""
    data = plain(data)
    start = re.search(rb"^@1[ \t]*(?:#[^\n]*)?\r?$", data, re.M)
    head = data[: start.start() if start else len(data)].decode("latin-1")
    order = "<" if "LITTLE-ENDIAN" in head.split("\n", 1)[0] else ">"
    binary = "BINARY" in head.split("\n", 1)[0].upper()
    sizes = {n: int(np.prod([int(v) for v in d.split()])) for n, d in re.findall(r"^\s*(?:define\s+)?(\w+)\s+(\d+(?:\s+\d+)*)\s*$", head, re.M)}
    kinds = {"byte": "u1", "short": "i2", "ushort": "u2", "int": "i4", "float": "f4", "double": "f8"}
    out, rest = {}, data
    for place, kind, width, name, tag, packing in re.findall(r"(\w+)\s*\{\s*(\w+)(?:\[(\d+)\])?\s+(\w+)\s*\}\s*=?\s*@(\d+)(?:\((\w+,\d+)\))?", head):
        count, wide = next(sizes[n] for n in (place, f"n{place}", "nEdges") if n in sizes), int(width or 1)
        mark = re.search(rb"(?:^|\n)@" + tag.encode() + rb"[ \t]*(?:#[^\n]*)?\r?\n", rest)
        body = rest[mark.end() :]
        if packing.startswith("HxByteRLE"):
            values = np.frombuffer(byte_runs(body[: int(packing.split(",")[1])], count * wide), "u1")
        elif packing.startswith("HxZip"):
            values = np.frombuffer(zlib.decompress(body[: int(packing.split(",")[1])]), order + kinds[kind])
        elif binary:
            values = np.frombuffer(body, order + kinds[kind], count * wide)
        else:
            values = np.array(body.split(b"\n@", 1)[0].split()[: count * wide], float)
        out[name] = values.reshape(count, wide) if wide > 1 else values
    return out


def byte_runs(data: bytes, length: int) -> bytes:
    """Byte runs: a count up to 127 repeats the next byte, a larger one less 128 copies that many; a count of 0 is an error."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < length:
        n, at = data[at], at + 1
        if not n:
            raise ValueError("a run of no bytes")
        if n > 127:
            out += data[at : at + n - 128]
            at += n - 128
        else:
            out += data[at : at + 1] * n
            at += 1
    return bytes(out)


def lineset(data: bytes) -> list[tuple]:
    """Line sets: polylines of places, each closed by -1; the last further section is a radius."""
    found = amira_sections(data)
    points = found["Coordinates"]
    others = [v for n, v in found.items() if n not in ("Coordinates", "LineIdx") and len(v) == len(points) and v.ndim == 1]
    line = found["LineIdx"].astype(int)
    pairs = [(a, b) for a, b in zip(line[:-1].tolist(), line[1:].tolist(), strict=True) if a >= 0 and b >= 0]
    return oriented(points, pairs, 2 * others[-1] if others else np.full(len(points), np.nan))


def skeleton(data: bytes) -> list[tuple]:
    """Skeleton graphs: neighbour counts and neighbour lists, each edge twice."""
    found = amira_sections(data)
    counts, near = found["NeighbourCount"].astype(int), found["NeighbourList"].astype(int)
    pairs = list(zip(np.repeat(np.arange(len(counts)), counts).tolist(), near.tolist(), strict=True))
    radii = found.get("Radii", np.full(len(counts), np.nan))
    return oriented(found["Coordinates"], pairs, 2 * radii)


def surface(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(vertices, faces) of an ASCII HyperSurface; outer sides are turned round, the exterior has none."""
    text = plain(data).decode("latin-1")
    block = re.search(r"Vertices\s+(\d+)\s*\n", text)
    count = int(block[1])
    points = np.array(text[block.end() :].split(None, 3 * count)[: 3 * count], float).reshape(-1, 3)
    faces = []
    for patch in re.finditer(r"\{\s*InnerRegion\s+(\S+)\s+OuterRegion\s+(\S+).*?Triangles\s+(\d+)\s*\n([\d\s]*)", text, re.S):
        inner, outer, n = patch[1], patch[2], int(patch[3])
        for a, b, c in np.array(patch[4].split()[: 3 * n], int).reshape(-1, 3).tolist():
            if inner != "Exterior":
                faces.append((inner, a, b, c))
            if outer != "Exterior":
                faces.append((outer, a, c, b))
    return [(k + 1, *map(float, p)) for k, p in enumerate(points)], [(r, k + 1, a, b, c) for k, (r, a, b, c) in enumerate(faces)]


def surface_text(vertices: list[tuple], faces: list[tuple]) -> str:
    """An ASCII HyperSurface of (vertex, x, y, z) and (region, face, v1, v2, v3), each region against the exterior."""
    regions = list(dict.fromkeys(f[0] for f in faces))
    out = ["# HyperSurface 0.1 ASCII", "", "Parameters {", "    Materials {", "        Exterior {", "            Id 1", "        }"]
    for k, r in enumerate(regions, 2):
        out += [f"        {r} {{", f"            Id {k}", "        }"]
    out += ["    }", "}", "", f"Vertices {len(vertices)}", *("%.6f %.6f %.6f" % tuple(v[1:4]) for v in vertices), f"Patches {len(regions)}"]
    for r in regions:
        own = [f for f in faces if f[0] == r]
        out += ["{", f"InnerRegion {r}", "OuterRegion Exterior", "BoundaryID 0", "BranchingPoints 0", "", f"Triangles {len(own)}", *(f"{a} {b} {c}" for _, _, a, b, c in own), "}"]
    return "\n".join(out) + "\n"


def landmarks(data: bytes) -> list[tuple]:
    """(set, name, x, y, z) of Amira, Fiji or typed-stream landmark files."""
    data = plain(data)
    if data.lstrip()[:5] == b"<?xml" or b"<Tracings" in data[:200] or b"<namedpointset" in data[:400]:
        root = ElementTree.fromstring(data)
        return [(1, p.get("name"), *(float(p.get(c)) for c in "xyz")) for p in root.iter("pointworld")]
    if data.startswith(b"! TYPEDSTREAM"):
        found = typed_stream(data).get("landmark", [])
        found = found if isinstance(found, list) else [found]
        return [(1, m.get("name"), *map(float, m["location"])) for m in found]
    found = amira_sections(data)
    return [(k + 1, str(i + 1), *map(float, p)) for k, (_, points) in enumerate(found.items()) for i, p in enumerate(points)]


def typed_stream(data: bytes) -> dict:
    """Nested key-value pairs of a typed-stream text; repeated keys become lists."""
    root: dict = {}
    stack = [root]

    def put(key, value):
        here = stack[-1]
        if key in here:
            here[key] = [*here[key], value] if isinstance(here[key], list) and here[key] and isinstance(here[key][0], type(value)) and not isinstance(value, (float, int)) else [here[key], value]
        else:
            here[key] = value

    number = re.compile(r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    last = None
    for raw in plain(data).decode("latin-1").splitlines():
        line = raw.strip()
        if not line or line[0] in "!#":
            continue
        if line == "}":
            stack.pop()
            continue
        if line.endswith("{"):
            inner: dict = {}
            put(line[:-1].strip(), inner)
            stack.append(inner)
            continue
        key, _, value = line.partition(" ")
        if number.match(key) and last is not None:
            stack[-1][last] = [*stack[-1][last], *map(float, line.split())]
            continue
        cells = value.strip()
        if cells.startswith('"'):
            put(key, cells.strip('"'))
        elif all(number.match(c) for c in cells.split()) and cells:
            values = [float(c) for c in cells.split()]
            put(key, values if len(values) > 1 else values[0])
            last = key if len(values) > 1 else None
        else:
            put(key, {"yes": True, "no": False}.get(cells, cells))
    return root


def traces(data: bytes) -> list[tuple]:
    """Vertex rows of an XML trace file: paths of points, joined where they start on others."""
    root = ElementTree.fromstring(plain(data))
    rows, first, length = [], {}, {}
    paths = [p for p in root.iter("path") if p.get("fittedversionof") is None]
    for path in paths:
        points = path.findall("point")
        first[path.get("id")], length[path.get("id")] = len(rows) + 1, len(points)
        for k, p in enumerate(points):
            n = len(rows) + 1
            radius = p.get("r")
            rows.append([n, 2, *(float(p.get(f"{c}d", p.get(c))) for c in "xyz"), 2 * float(radius) if radius else float("nan"), n - 1 if k else -1])
    for path in paths:
        on = path.get("startson")
        if on in first and length[path.get("id")]:
            rows[first[path.get("id")] - 1][6] = first[on] + int(path.get("startsindex", 0))
    return [tuple(r) for r in rows]


def morphml(data: bytes) -> list[tuple]:
    """Vertex rows of a MorphML cell: segments with an optional proximal point (2 i + 1) and a distal one (2 i + 2)."""
    root = ElementTree.fromstring(plain(data))
    bare = lambda e: e.tag.rpartition("}")[2]
    if bare(root) == "neuroml" and any(bare(e) == "include" for e in root):
        raise ValueError("the second version of the format isn't read")
    rows, distal = {}, {}
    for e in (x for x in root.iter() if bare(x) == "segment"):
        i, parts = int(e.get("id")), {bare(x): x for x in e}
        up = distal.get(int(e.get("parent")), -1) if e.get("parent") is not None else -1
        for name, n in (("proximal", 2 * i + 1), ("distal", 2 * i + 2)):
            if name in parts:
                p = parts[name]
                rows[n] = (n, 2, float(p.get("x")), float(p.get("y")), float(p.get("z")), float(p.get("diameter", "nan")), up)
                up = n
        distal[i] = 2 * i + 2
    order = {n: k + 1 for k, n in enumerate(sorted(rows))}
    return [(order[n], *r[1:6], order.get(r[6], -1)) for n, r in sorted(rows.items())]


def nrrd(data: bytes) -> tuple[dict, np.ndarray]:
    """(header, array) of an attached NRRD file, raw, gzip or text; the first index runs fastest."""
    head, _, body = data.partition(b"\n\n")
    fields = dict(re.split(r":=|:\s*", line, maxsplit=1) for line in head.decode("latin-1").splitlines()[1:] if line and line[0] != "#")
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    kinds = {"signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "ulonglong": "u8", "uint64": "u8", "float": "f4", "double": "f8"}
    kind = ("<" if fields.get("endian", "little") == "little" else ">") + kinds[fields["type"]]
    sizes = [int(v) for v in fields["sizes"].split()]
    encoding = fields.get("encoding", "raw")
    if encoding in ("gzip", "gz"):
        body = gzip.decompress(body)
    values = np.array(body.split(), float) if encoding in ("text", "txt", "ascii") else np.frombuffer(body, kind, int(np.prod(sizes)))
    return fields, values.reshape(sizes, order="F")


def voxel_sizes(fields: dict) -> list[float]:
    """Of an NRRD header: spacings, or the sum of the absolute direction components of each axis."""
    if "spacings" in fields:
        return [float(v) for v in fields["spacings"].split()]
    return [sum(abs(float(v)) for v in d.split(",")) for d in re.findall(r"\(([^)]*)\)", fields.get("space directions", ""))]


def nrrd_bytes(values: np.ndarray, spacing: tuple[float, ...], encoding: str = "gzip") -> bytes:
    names = {"uint8": "uint8", "int16": "int16", "uint16": "uint16", "int32": "int32", "float32": "float", "float64": "double"}
    directions = " ".join("(" + ",".join(str(s if i == k else 0) for i in range(len(spacing))) + ")" for k, s in enumerate(spacing))
    head = f"NRRD0004\ntype: {names[values.dtype.name]}\ndimension: {values.ndim}\nsizes: {' '.join(map(str, values.shape))}\nspace dimension: {values.ndim}\nspace directions: {directions}\nendian: little\nencoding: {encoding}\n\n"
    if encoding == "text":
        return head.encode() + " ".join(map(str, values.ravel(order="F"))).encode()
    body = values.astype(values.dtype.newbyteorder("<")).tobytes(order="F")
    return head.encode() + (gzip.compress(body, mtime=0) if encoding == "gzip" else body)


def raw_stack(data: bytes) -> np.ndarray:
    """Array of a raw image stack: magic, byte order, bytes a sample, four sizes of 16 (or else 32) bits."""
    magic = b"raw_image_stack_by_hpeng"
    if not data.startswith(magic):
        raise ValueError("not a raw image stack")
    order = "<" if data[len(magic) : len(magic) + 1] == b"L" else ">"
    at = len(magic) + 1
    width = struct.unpack_from(order + "h", data, at)[0]
    sizes = struct.unpack_from(order + "4h", data, at + 2)
    start = at + 10
    if start + width * int(np.prod(sizes, dtype=np.int64)) != len(data):
        sizes = struct.unpack_from(order + "4i", data, at + 2)
        start = at + 18
    kind = {1: "u1", 2: order + "u2", 4: order + "f4"}[width]
    values = np.frombuffer(data, kind, int(np.prod(sizes)), start).reshape(sizes, order="F")
    return values[..., 0] if sizes[3] == 1 else values


def obj_mesh(data: bytes) -> tuple[list[tuple], list[tuple]]:
    vertices, faces = [], []
    for line in plain(data).decode("latin-1").splitlines():
        cells = line.split()
        if cells[:1] == ["v"]:
            vertices.append((len(vertices) + 1, *map(float, cells[1:4])))
        elif cells[:1] == ["f"]:
            at = [int(c.split("/")[0]) for c in cells[1:]]
            faces += [("mesh", len(faces) + 1 + k, at[0], at[k + 1], at[k + 2]) for k in range(len(at) - 2)]
    return vertices, faces


def ply_mesh(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """ASCII or little-endian PLY with triangles."""
    data = plain(data)
    head, _, body = data.partition(b"end_header\n")
    text = head.decode("latin-1")
    counts = {k: int(n) for k, n in re.findall(r"element (\w+) (\d+)", text)}
    own = re.split(r"element \w+ \d+", text)
    width = {"float": "f4", "float32": "f4", "double": "f8", "uchar": "u1", "uint8": "u1", "int": "i4", "int32": "i4", "uint": "u4"}
    fields = [(n, "<" + width[k]) for k, n in re.findall(r"property (\w+) (\w+)\s", own[1]) if k != "list"]
    nv, nf = counts["vertex"], counts["face"]
    if "format ascii" in text:
        cells = body.split()
        rows = np.array(cells[: nv * len(fields)], float).reshape(nv, -1)
        points = rows[:, [[n for n, _ in fields].index(c) for c in "xyz"]]
        at, faces = nv * len(fields), []
        for k in range(nf):
            n = int(cells[at])
            faces.append(tuple(int(c) + 1 for c in cells[at + 1 : at + 4]))
            at += n + 1
    else:
        kind = np.dtype(fields)
        rows = np.frombuffer(body, kind, nv)
        points = np.stack([rows[c] for c in "xyz"], 1)
        lists = np.frombuffer(body, np.dtype([("n", "u1"), ("v", "<i4", 3)]), nf, nv * kind.itemsize)
        faces = [tuple((v + 1).tolist()) for v in lists["v"]]
    return [(k + 1, *map(float, p)) for k, p in enumerate(points)], [("mesh", k + 1, *f) for k, f in enumerate(faces)]


def ply_text(vertices: list[tuple], faces: list[tuple]) -> str:
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property double {c}" for c in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    return "\n".join([*head, *(f"{v[1]} {v[2]} {v[3]}" for v in vertices), *(f"3 {f[2] - 1} {f[3] - 1} {f[4] - 1}" for f in faces)]) + "\n"


def vtk_text(vertices: list[tuple], title: str = "trace") -> str:
    """Vertex rows as legacy polydata with a line for each edge."""
    place = {v[0]: k for k, v in enumerate(vertices)}
    lines = [(place[v[6]], place[v[0]]) for v in vertices if v[6] in place]
    return "\n".join(["# vtk DataFile Version 3.0", title, "ASCII", "DATASET POLYDATA", f"POINTS {len(vertices)} float", *(f"{v[2]} {v[3]} {v[4]}" for v in vertices), f"LINES {len(lines)} {3 * len(lines)}", *(f"2 {a} {b}" for a, b in lines)]) + "\n"
