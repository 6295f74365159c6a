"""Depth-first orders, undirected graphs and tree contraction, against brute force on trees of many shapes."""

import collections
import random

import pytest

from arborium import ranking
from arborium.operators import editing as E
from arborium.operators import graphs as R
from arborium.operators import morphometry as M
from arborium.operators import ordering as O
from arborium.operators import topology as T


def frame(spark, forests):
    """forests: neuron -> {point: parent}."""
    rows = [(n, p, q, float(p % 7), float(p % 5), float(p % 3)) for n, tree in forests.items() for p, q in tree.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "neuron_id long, point_no long, parent long, x double, y double, z double")


def grown(seed, n, shape):
    r = random.Random(seed)
    names = r.sample(range(10, 10 * n + 10), n)
    pick = {"random": lambda k: r.randrange(k), "chain": lambda k: k - 1, "star": lambda k: 0, "caterpillar": lambda k: k - 1 if k % 2 else max(0, k - 2), "forest": lambda k: None if r.random() < 0.2 else r.randrange(k)}[shape]
    out = {names[0]: -1}
    for k in range(1, n):
        up = pick(k)
        out[names[k]] = -1 if up is None else names[up]
    return out


SHAPES = ["random", "chain", "star", "caterpillar", "forest"]


@pytest.fixture(scope="module")
def forests():
    return {1 + k: grown(k, n, shape) for k, (shape, n) in enumerate([(s, n) for s in SHAPES for n in (2, 9, 40)])} | {90: {5: -1}, 91: {3: -1, 8: -1}}


def children(tree):
    out = collections.defaultdict(list)
    for p in sorted(tree):
        out[tree[p]].append(p)
    return out


def walked(tree, root):
    kids, order, stack = children(tree), [], [root]
    while stack:
        p = stack.pop()
        order.append(p)
        stack.extend(reversed(kids[p]))
    return order


def plain_segments(tree, root):
    """Close at each vertex whose degree isn't 2; the next segment starts with the parent of the vertex that follows."""
    kids = children(tree)
    order, out, now = walked(tree, root), [], []
    if len(order) == 1:
        return [[root]]
    now = [root]
    for p in order[1:]:
        now = now or [tree[p]]
        now.append(p)
        if len(kids[p]) != 1:
            out.append(now)
            now = []
    return out


def test_depth_first(spark, forests):
    got = {(r.neuron_id, r.point_no): (r.root, r.pre, r.size) for r in O.depth_first(frame(spark, forests)).collect()}
    want = {}
    for n, tree in forests.items():
        for root in (p for p, q in tree.items() if q == -1):
            for k, p in enumerate(walked(tree, root)):
                want[n, p] = (root, k, len(walked(tree, p)))
    assert got == want


def test_segment_order(spark, forests):
    got = collections.defaultdict(dict)
    for r in O.segment_order(frame(spark, forests)).collect():
        got[r.neuron_id, r.root][r.seg_id, r.pos] = r.point_no
    for n, tree in forests.items():
        for root in (p for p, q in tree.items() if q == -1):
            assert got[n, root] == {(s, k): p for s, seg in enumerate(plain_segments(tree, root), 1) for k, p in enumerate(seg, 1)}


def test_renumbered(spark, forests):
    v = frame(spark, forests)
    got = collections.defaultdict(dict)
    for r in O.renumbered(v).collect():
        got[r.neuron_id][r.point_no] = (r.parent, r.x, r.y)
    for n, tree in forests.items():
        roots = sorted((p for p, q in tree.items() if q == -1), key=lambda p: (-len(walked(tree, p)), p))
        order = [p for root in roots for p in walked(tree, root)]
        new = {p: k for k, p in enumerate(order, 1)} | {-1: -1}
        assert got[n] == {new[p]: (new[tree[p]], float(p % 7), float(p % 5)) for p in order}
    kept = {r.neuron_id for r in O.renumbered(v, only_if_needed=True).join(v.select("neuron_id", "point_no"), ["neuron_id", "point_no"]).groupBy("neuron_id").count().collect() if r["count"] == len(forests[r.neuron_id])}
    assert {n for n, tree in forests.items() if all(q < p for p, q in tree.items())} <= kept


def test_circles_are_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        O.depth_first(frame(spark, {1: {1: 2, 2: 1, 3: -1}})).collect()


def test_running_sums(spark):
    rows = [(k, k % 3, (k * 7) % 11) for k in range(500)]
    got = {r.k: r.before for r in ranking.running(spark.createDataFrame(rows, "k long, g long, v long").repartition(5), ["g", "k"], "v", "before").collect()}
    total = 0
    for k, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[k] == total
        total += v


@pytest.mark.parametrize("given", [True, False])
def test_oriented(spark, forests, given):
    edges = [(n, *((p, q) if (p + q) % 2 else (q, p))) for n, tree in forests.items() for p, q in tree.items() if q != -1]
    points = [(n, p) for n, tree in forests.items() for p in tree]
    origins = [(n, p) for n, tree in forests.items() for p, q in tree.items() if q == -1] if given else []
    table = lambda rows, names: spark.createDataFrame(rows, names)
    got = R.oriented(table(points, "neuron_id long, point_no long"), table(edges + edges[::3], "neuron_id long, a long, b long"), table(origins, "neuron_id long, point_no long") if given else None).collect()
    if given:
        assert {(r.neuron_id, r.point_no): r.parent for r in got} == {(n, p): q for n, tree in forests.items() for p, q in tree.items()}
        return
    sides = collections.defaultdict(set)
    for n, a, b in edges:
        sides[n, a].add(b)
        sides[n, b].add(a)
    trees = collections.defaultdict(dict)
    for r in got:
        trees[r.neuron_id, r.root][r.point_no] = r
    for (n, root), held in trees.items():
        assert set(held) == set(walked({p: r.parent for p, r in held.items()}, root)) and all(r.size == len(held) for r in held.values())
        assert root == min((p for p in held if len(sides[n, p]) <= 1), default=min(held))
        assert all(r.parent == -1 or r.parent in sides[n, p] for p, r in held.items()) and held[root].parent == -1
    for n in forests:
        parts = [(len(h), -min(h), h[root].master) for (m, root), h in trees.items() if m == n]
        assert [p[2] for p in sorted(parts, reverse=True)] == [True] + [False] * (len(parts) - 1)
    assert sum(map(len, trees.values())) == len(points)


def test_problems_and_forests_of_graphs_with_circles(spark):
    r = random.Random(3)
    points = [(1, p) for p in range(30)] + [(1, 4), (2, 1), (2, 2), (3, 7)]
    edges = [(1, r.randrange(30), r.randrange(30)) for _ in range(40)] + [(1, 3, 99), (2, 1, 2), (2, 2, 1), (2, 2, 2)]
    parent = {p: p for p in range(30)}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    good = sorted({(min(a, b), max(a, b)) for n, a, b in edges if n == 1 and a != b and b != 99})
    forest = []
    for a, b in good:
        if root(a) != root(b):
            forest.append((a, b))
            parent[root(a)] = root(b)
    parts = len({root(p) for p in range(30)})
    v, e = spark.createDataFrame(points, "neuron_id long, point_no long"), spark.createDataFrame(edges, "neuron_id long, a long, b long")
    got = {x.neuron_id: tuple(x)[1:] for x in R.problems(v, e).collect()}
    assert got == {1: (30, len(good), parts, len(good) - 30 + parts, 1, 1), 2: (2, 1, 1, 0, 0, 0), 3: (1, 0, 1, 0, 0, 0)}
    of, kept = R.spanning_forest(v, e)
    assert sorted((x.a, x.b) for x in kept.collect() if x.neuron_id == 1) == forest
    groups = collections.defaultdict(set)
    for x in of.filter("neuron_id = 1").collect():
        groups[x.component].add(root(x.point_no))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == parts


def plain_orders(tree, classical):
    kids, out = children(tree), {}
    for root in (p for p, q in tree.items() if q == -1):
        for p in reversed(walked(tree, root)):
            below = [out[c] for c in kids[p]]
            top = max(below, default=1)
            rises = below.count(top) > 1 if classical else len(below) > 1 and min(below) == top
            out[p] = top + rises if below else 1
    return out


@pytest.mark.parametrize("classical", [False, True])
def test_orders_by_contraction(spark, forests, classical):
    got = {(r.neuron_id, r.point_no): r.strahler for r in T.strahler(frame(spark, forests), classical).collect()}
    assert got == {(n, p): s for n, tree in forests.items() for p, s in plain_orders(tree, classical).items()}


def test_a_long_caterpillar_takes_few_rounds(spark, monkeypatch):
    """Rounds follow the logarithm: 20,000 branch points in a row."""
    n, rounds = 20_000, []
    graph = spark.range(1, n + 1).selectExpr("1L as neuron_id", "id as head", "explode(array(id + 1, id + 1000000)) as tail")
    real = T.written
    monkeypatch.setattr(T, "written", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = {r.node: r.strahler for r in T.branch_orders(graph).collect()}
    assert len(got) == 2 * n + 1 and got[n + 1] == 1 and {got[k] for k in range(1, n + 1)} == {2}
    assert len(rounds) < 2 * 40


@pytest.mark.parametrize("length", [0.5, 3.0, 9.0, 40.0])
def test_twigs_by_doubling(spark, forests, length):
    v = frame(spark, forests)
    at = {(r.neuron_id, r.point_no): (r.x, r.y, r.z) for r in v.collect()}
    got = {(r.neuron_id, r.point_no) for r in E.prune_twigs(v, length).collect()}
    want = set()
    for n, tree in forests.items():
        kids, stay = children(tree), set()
        for p, q in tree.items():
            if q == -1:
                stay.add(p)
            elif not kids[p]:
                far, k, best = 0.0, p, p
                while tree[k] != -1:
                    far += sum((a - b) ** 2 for a, b in zip(at[n, k], at[n, tree[k]], strict=True)) ** 0.5
                    k = tree[k]
                    if far > length:
                        break
                    if len(kids[k]) + (tree[k] != -1) > 2:
                        best = k
                stay.add(best)
        for p in stay:
            while p != -1:
                want.add((n, p))
                p = tree[p]
    assert got == want


@pytest.mark.parametrize("from_root", [False, True])
def test_spine(spark, forests, from_root):
    r = random.Random(9)
    at = {(n, p): [r.uniform(0, 100) for _ in "xyz"] for n, tree in forests.items() for p in tree}
    rows = [(n, p, q, *at[n, p]) for n, tree in forests.items() for p, q in tree.items()]
    got = collections.defaultdict(set)
    for x in M.spine(spark.createDataFrame(rows, "neuron_id long, point_no long, parent long, x double, y double, z double"), from_root).collect():
        got[x.neuron_id].add(x.point_no)
    for n, tree in forests.items():
        sides = collections.defaultdict(dict)
        for p, q in tree.items():
            if q != -1:
                sides[p][q] = sides[q][p] = sum((a - b) ** 2 for a, b in zip(at[n, p], at[n, q], strict=True)) ** 0.5
        best, way = -1.0, set()
        for start in (p for p in tree if (tree[p] == -1 if from_root else len(sides[p]) == 1)):
            stack = [(start, None, 0.0, [start])]
            while stack:
                p, before, far, path = stack.pop()
                if p != start and len(sides[p]) == 1 and far > best + 1e-9:
                    best, way = far, set(path)
                stack.extend((q, p, far + d, [*path, q]) for q, d in sides[p].items() if q != before)
        assert got[n] == way


def test_main_trees(spark, forests):
    got = {(r.neuron_id, r.point_no) for r in M.main_trees(frame(spark, forests)).collect()}
    want = set()
    for n, tree in forests.items():
        best = min((p for p, q in tree.items() if q == -1), key=lambda p: (-len(walked(tree, p)), p))
        want |= {(n, p) for p in walked(tree, best)}
    assert got == want
