"""Host trust against explicit edges, its verdicts, and its cut."""

import itertools
import zlib

import pytest

from arborium.llm import url_trust


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_domains(spark):
    hosts = ["a.b.example.org", "example.org", "x.example.co.uk", "localhost", "10.0.0.1", "a.example.org:80", "co.uk", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: list(r.d) for r in frame.select("host", url_trust.domains(frame.host).alias("d")).collect()}
    assert got == {
        "a.b.example.org": ["a.b.example.org", "b.example.org", "example.org"], "example.org": ["example.org"], "x.example.co.uk": ["x.example.co.uk", "example.co.uk"],
        "localhost": ["localhost"], "10.0.0.1": ["10.0.0.1"], "a.example.org:80": ["a.example.org", "example.org"], "co.uk": ["co.uk"], "": [""],
    }


def plain_scores(hosts, weight, seeds, rounds):
    out, into = ({h: sum(w for e, w in weight.items() if e[k] == h) for h in hosts} for k in (0, 1))
    start = {}
    for h in hosts:
        t, d = seeds.get(h, (0.0, 0.0))
        o = 0.0 if zlib.crc32(h.encode()) % url_trust.HIDDEN == 0 else 1.0
        reach, held = max(t + d, url_trust.NEUTRAL), max((t + d) * o, url_trust.NEUTRAL)
        start[h] = {"trust": t, "reach": reach, "trust_held": t * o, "reach_held": held, "distrust": d, "back": reach, "distrust_held": d * o, "back_held": held}
    state = start
    for _ in range(rounds):
        new = {h: {c: 0.15 * v for c, v in s.items()} for h, s in start.items()}
        for (a, b), w in weight.items():
            for c in url_trust.ALONG:
                new[b][c] += 0.85 * state[a][c] * w / out[a]
            for c in url_trust.AGAINST:
                new[a][c] += 0.85 * state[b][c] * w / into[b]
        state = new
    return state


@pytest.mark.parametrize("split", [False, True])
def test_scores(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr("arborium.skew.HOT_ROWS", 1)
    links = {("m.a.x.org", "b.x.org"): 2.0, ("b.x.org", "p.y.net"): 1.0, ("p.y.net", "lone.com"): 3.0, ("n.a.x.org", "p.y.net"): 1.0}
    seeds = {"m.a.x.org": (0.2, 0.0), "n.a.x.org": (0.0, 0.3), "b.x.org": (1.0, 0.0), "p.y.net": (0.0, 1.0), "only.z.org": (0.0, 0.25)}
    hosts = sorted({*seeds, *itertools.chain(*links)})
    up = {h: {".".join(h.split(".")[k:]) for k in range(len(h.split(".")) - 1)} for h in hosts}
    weight = dict(links)
    for d in set().union(*up.values()):
        held = [h for h in hosts if d in up[h]]
        for a, b in itertools.permutations(held, 2):
            weight[a, b] = weight.get((a, b), 0) + url_trust.FAMILY / (len(held) - 1)
    want = plain_scores(hosts, weight, seeds, 6)
    frames = (spark.createDataFrame([(*e, w) for e, w in links.items()], "src string, dst string, weight double"), spark.createDataFrame([(h, *map(float, s)) for h, s in seeds.items()], "host string, trusted double, blocked double"))
    got = {r.host: r.asDict() for r in url_trust.propagate(*frames, rounds=6).collect()}
    assert got.keys() == set(hosts)
    for h in hosts:
        assert {c: got[h][c] for c in url_trust.SCORES} == pytest.approx(want[h])


@pytest.mark.parametrize("linkers", [1, 2, 40])
def test_linkers_of_a_blocked_host(spark, linkers):
    spam = "http://s.example.net/x"
    rows = [(spam, ""), ("http://clean.org/", '<a href="http://other.com/">x</a>'), *((f"http://h{k}.com/", f'<a href="{spam}">x</a>') for k in range(linkers))]
    got = {r.host: r.verdict for r in url_trust.judge(pages_of(spark, rows), cut=url_trust.CUT).collect()}
    assert got == {"s.example.net": "block", "clean.org": "allow", **{f"h{k}.com": "block" for k in range(linkers)}}


def test_distrust_passes_in_a_domain_and_trust_outweighs_it(spark):
    farm = [(f"http://f{k}.farm.com/de/", "") for k in range(9)] + [("http://new.farm.com/", "")]
    mixed = [("http://m.mixed.org/de/", ""), *((f"http://m{k}.mixed.org/en/", "") for k in range(3)), ("http://m.mixed.org/", "")]
    rules = url_trust.rules_of([("block", "com/de/"), ("block", "org/de/"), ("allow", "org/en/")])
    got = {(r.host, r.rule): r.verdict for r in url_trust.judge(pages_of(spark, farm + mixed), rules, cut=0.5).collect()}
    assert got["new.farm.com", None] == "block" and got["m.mixed.org", None] == "allow"


def test_cut_lies_between_hidden_hosts(spark):
    names = ("trust_held", "reach_held", "distrust_held", "back_held")
    hidden = [h for h in (f"h{k}" for k in range(200)) if zlib.crc32(h.encode()) % url_trust.HIDDEN == 0][:8]
    bad = [0.9, 0.8, 0.7, -0.5]
    rows = [(h, 0.0, 1.0, 0.0, 1.0, b, 1.0) for h, b in zip(hidden, bad, strict=False)] + [(h, 1.0, 0.0, 0.0, 1.0, b, 1.0) for h, b in zip(hidden[4:], (0.1, -0.2, 0.0, 0.05), strict=False)] + [("h0x", 1.0, 0.0, 0.0, 1.0, 0.99, 1.0)]
    rows = [r for r in rows if r[0] in hidden or zlib.crc32(r[0].encode()) % url_trust.HIDDEN]
    found = url_trust.found_again(spark.createDataFrame(rows, "host string, trusted double, blocked double, " + ", ".join(f"{n} double" for n in names)))
    assert 0.1 < url_trust.cut_of(found) < 0.7
    assert {(f[2], f[4]) for f in found} == {(4, 4)}
    assert url_trust.cut_of([(lvl, 1, 1, 0, 0) for lvl, *_ in found]) == url_trust.CUT


def test_links_are_counted_by_page(spark):
    spam = "HTTP://S.example.net/x"
    pages = pages_of(spark, [("http://a.com/1", f'<a href="{spam}">x</a><a href=\'http://s.example.net/y\'>'), ("http://a.com/2", f"<A HREF={spam}>"), ("http://s.example.net/", f'<a href="{spam}">own</a>'), ("nothing", f'<a href="{spam}">'), ("http://b.com/", None)])
    got = {(r.src, r.dst): r.weight for r in url_trust.link_edges(url_trust.ruled(pages, url_trust.RULES)).collect()}
    assert got == {("a.com", "s.example.net"): 2.0}
