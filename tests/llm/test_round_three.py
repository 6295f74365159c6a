"""Resampling, Merkle manifests and near-duplicate vectors against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arborium.llm import merkle, resampling, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(k, " ".join(f"w{(k * j * 7) % 23}" for j in range(k % 60)) + f" Ünïque{k} x-y", "abc"[k % 3], ["en", "de", None][k % 3]) for k in range(150)]


def plain_features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain_resample(rows, target, longest, buckets, seed, least, percent):
    raw, goal = Counter(), Counter()
    for _, text in rows:
        raw.update(f % buckets for f in plain_features(text, longest)[1])
    for text in target:
        goal.update(f % buckets for f in plain_features(text, longest)[1])
    size, wanted = sum(raw.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (size + buckets) / ((raw[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        n, found = plain_features(text, longest)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((o for o in out if o[4]), key=lambda o: (-o[3], math.inf if o[0] is None else o[0], o[1]))
    rank = {id(o): k + 1 for k, o in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*o[:4], rank.get(id(o))) for o in out), key=str)


@pytest.mark.parametrize(("longest", "head"), [(1, 65_536), (1, 3), (2, 65_536), (2, 3), (3, 3)])
def test_resampling(spark, monkeypatch, longest, head):
    monkeypatch.setattr(resampling, "HEAD", head)
    monkeypatch.setattr(resampling, "PAIRS", head)
    rows = [(d, t) for d, t, *_ in DOCS]
    target = ["w1 w2 w3 w4 unseen", None, "", "Ünïque7 w5 w5"]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=997, percent=30, least_words=10)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, longest, 997, 2024, 10, 30)


def test_resampling_counts_in_pieces(spark, monkeypatch, odd):
    target = spark.createDataFrame([("one two three wort",)], "text string")
    whole = sorted(map(tuple, resampling.resample(odd, target, longest=2, least_words=1, percent=50).collect()), key=str)
    assert whole == plain_resample([(r.doc_id, r.text) for r in odd.collect()], ["one two three wort"], 2, 10_000, 2024, 1, 50)
    monkeypatch.setattr(resampling, "COUNTED", 5)
    assert sorted(map(tuple, resampling.resample(odd, target, longest=2, least_words=1, percent=50).collect()), key=str) == whole


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level):
    """(root, segments of each leaf from the leaf up)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((p % 8, run[: p % 8] + run[p % 8 + 1 :]))
            at[k] = p // 8
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = lambda r, text: h(*(part(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, paths = {}, []
    for lang in langs:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, of(r, r["text"]), k) for k, r in enumerate(rows) if r["lang"] == lang))
        trees[lang], found = plain_tree([o[2] for o in own])
        paths += [(o[3], p) for o, p in zip(own, found, strict=True)]
    root, top = plain_tree([trees[lang] for lang in langs])
    out = []
    for k, path in paths:
        r = rows[k]
        path = path + top[langs.index(r["lang"])]
        changed = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        now = of(r, r["text"].translate(LOWER) if changed else r["text"])
        for at, others in path:
            now = h(*others[:at], now, *others[at:])
        out.append((r["doc_id"], of(r, r["text"]), trees[r["lang"]], root, h(*(o for _, others in path for o in others)), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("langs", [["en"], ["en", None, "de"], [f"l{k}" for k in range(70)]])
def test_merkle(spark, langs):
    rows = [(k, t, s, langs[k * k % len(langs)], len(t) if k % 5 else None) for k, t, s, _ in DOCS] + [(None, "No Id", None, langs[0], 5), (7, None, "a", langs[0], None), (7, "OTHER Text", "a", langs[0], 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == plain_manifest([r.asDict() for r in docs.collect()])


def test_merkle_copies_share_records(spark, monkeypatch):
    """Equal rows make equal nodes; with shuffles only, as for large tables."""
    monkeypatch.setattr(merkle, "small", lambda df: None)
    monkeypatch.setattr("arborium.llm.common.BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(3, "Same Text", "a", "en", 9)] * 600 + [(k, "one", "a", "de", 3) for k in range(20)], SCHEMA).coalesce(2)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == plain_manifest([r.asDict() for r in docs.collect()])


def plain_links(rows, threshold=0.93):
    fit = [r[1] is not None and r[2] is not None and len(r[2]) and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2]) and r[0] is not None for r in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                u, v = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a, r in enumerate(rows):
        met, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - met
            met |= new
            todo += new
        least = r[0] if r[0] is None else min(rows[k][0] for k in met)
        out.append((r[0], len(links[a]), least, r[0] == least))
    return sorted(out, key=str)


def planted(seed, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(160):
        if k % 4 and rows:
            base = np.array(rows[rng.integers(len(rows))][2])
            vec = base + rng.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim) * rng.choice([0.0, 0.2, 0.38, 0.42])
        else:
            vec = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        rows.append((k, int(rng.integers(2)), [float(np.float32(x)) for x in vec]))
    return rows


ODD_VECTORS = [(900, 0, None), (901, 0, []), (902, 0, [0.0] * 24), (903, 1, [1.0, None] * 12), (904, 1, [float("nan")] * 24), (905, None, [1.0] * 24), (None, 1, [1.0] * 24), (906, 0, [1.0] * 24), (906, 0, [1.0] * 24), (906, 0, [-1.0] * 24), (907, 0, [2.0] * 24), (908, 0, [1.0] * 5), (909, 0, [1.0] * 5), (910, 0, [-0.0] + [1.0] * 4), (911, 0, [0.0] + [1.0] * 4)]


@pytest.mark.parametrize("rows_per_block", [1024, 7, 1])
def test_vectors(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows_per_block)
    rows = planted(rows_per_block) + ODD_VECTORS
    got = vectors.link(spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, label int, embedding array<float>, n_links int, kept boolean"))
    want = plain_links(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[1] > 0 for w in want) > 30


def test_vectors_empty(spark):
    assert vectors.link(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []


def test_bounds_hold_and_few_pairs_are_looked_at_again():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 2500):
        base = rng.normal(size=(60, dim))
        values = np.concatenate([base, base + rng.normal(size=(60, dim)) * 0.4])
        links, again = vectors.linked(vectors.Tile(values), vectors.Tile(values))
        unit = values / np.linalg.norm(values, axis=1)[:, None]
        assert (links == (unit @ unit.T >= 0.93)).all()
        assert again < 0.3 * links.size


def test_forest():
    rng = np.random.default_rng(1)
    links = rng.random((40, 40)) < 0.03
    links |= links.T
    np.fill_diagonal(links, False)
    edges = vectors.forest(links)
    group = list(range(40))
    for u, v in edges:
        assert links[u, v] and group[u] != group[v]
        group = [group[u] if g == group[v] else g for g in group]
    assert all(group[u] == group[v] for u, v in zip(*np.nonzero(links), strict=True))
