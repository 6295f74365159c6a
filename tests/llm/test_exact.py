"""Operators against brute force on whole small tables, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from arborium.llm import lattice_lm, media, mixing, neardup, packing, pii, quality, queries, token_files, tokens, toxicity
from arborium.llm.common import LOWER_BYTES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda v: str(int(v) if isinstance(v, float) and v.is_integer() else v)
    key = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert key(got) == key(want)


# Media.
def pad(text):
    b = text.encode()
    return b + b" " * (192 if not b else -len(b) % 192)


def test_media_round_trip(spark, docs, texts):
    for r in media.stored_documents(docs).collect():
        p = pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_walks_boxes():
    data = media.mux(media.padded(b"q" * 192 * 40))
    (track,) = media.tracks(data)
    assert (track.codec, track.handler, len(track.sizes), track.duration) == ("raw ", "vide", 40, 40_000)
    assert [data[o : o + s] for _, o, s in track.keyframes()] == [b"q" * 192] * 5
    assert ("moov", "trak", "mdia", "minf", "stbl", "stco") in {tuple(k.decode() for k in path) for path, _, _ in media.walk(data)}


def test_wide_and_open_boxes():
    wide = media.struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    last = media.struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert [(p[-1], e - s) for p, s, e in media.walk(wide + last)] == [(b"free", 4), (b"mdat", 4)]
    assert list(media.walk(b"\x00\x00\x00\x64moov")) == []


# Tokens.
@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("text", ["", "Hello wörld", "a b  c", "don't I'LL 'S", "x<|endoftext|>y <|endoftext|>", "a\x1cb \x85  z", "İstanbul ΣΑΣ é́", "日本語 ﬁ Ⅷ", "$$$!!12 ~`|{ \x7f", "A" * 200, "é" * 90, "\x00 x"])
def test_words_give_the_ids_of_whole_texts(whole, text):
    assert tokens.Encoder.at(tokens.default_path()).encode(text.encode()) == whole(text).tobytes()


def test_token_files(docs, texts, whole):
    start = 0
    got = sorted(token_files.round_trip(docs).collect())
    for r in got:
        ids = whole(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert len(got) == len(texts)


def test_ties_lie_in_one_order(spark, whole, tmp_path):
    rows = [(5, "b c"), (5, "a"), (None, "z"), (None, "y y"), (5, None), (2, "q"), (5, "a")]
    laid = lambda rows, name: token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder=f"file://{tmp_path}/{name}").orderBy("start").collect()
    first = laid(rows, "a")
    assert first == laid(rows[::-1], "b")
    assert [r.doc_id for r in first] == [None, None, 2, 5, 5, 5, 5] and sum(r.n_tokens for r in first) == sum(len(whole(t or "")) for _, t in rows)


@pytest.mark.parametrize("run", [20_000, 1 << 21])
def test_packing(docs, texts, whole, run):
    pieces = packing.pack(docs, run_tokens=run).toPandas()
    ids = {d: whole(t) for d, t in texts.items()}
    for (d, s, n, crc) in pieces[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False):
        assert zlib.crc32(ids[d][s : s + n]) == crc
    for d, g in pieces.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids[d]) == g.doc_tokens.iloc[0]
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() == g.tier.iloc[0] and g.step_id.nunique() == 1 and g.length.sum().bit_count() == 1 and g.length.sum() <= 2048


def test_steps_balance(docs):
    """All steps of a run but its last hold the same number of tokens."""
    pieces = packing.pack(docs.coalesce(1), step_tokens=4 * 2048).toPandas()
    steps = pieces.groupby("step_id").length.sum()
    assert len(steps) > 10 and (steps.iloc[:-1] == 4 * 2048).all() and 0 < steps.iloc[-1] <= 4 * 2048


# PII.
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(s):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, f"{pii.ORDER[k]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +22", "é😀 a@b.co", "4" * 3000, "1.2.3.", "a" * 5000 + "@", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a@b..c", ".@-.-", "1 2-3 4"]


def test_pii_base(spark, docs, texts):
    more = {10_000 + k: t for k, t in enumerate(TRICKY)}
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    for r in pii.find(frame).collect():
        want = base_spans({**texts, **more}[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_pii_added_kinds(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82WEST12345698765433"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2] and "national_id:10:21" in got[3] and "national_id" not in got[4]


def test_masking(spark):
    rows = [(1, "é a@b.co, 10.0.0.1 end"), (2, "none"), (3, None)]
    out = {r.doc_id: r.text for r in pii.masked_stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "é <EMAIL>, <IP> end", 2: "none", 3: None}


# Quality.
def test_order_by_rejections_a_second():
    rules = [quality.Rule(n, lambda: None) for n in "abc"]
    measured = [quality.Measured(rules[0], 2.0, 0.5), quality.Measured(rules[1], 0.1, 0.2), quality.Measured(rules[2], 1.0, 0.0)]
    assert [r.name for r in quality.ordered(measured)] == ["b", "a", "c"]


def test_repeated_words(spark):
    texts = ["a " * 9, " ".join(map(str, range(30))), " ".join(map(str, [*range(12), *range(12)])), "a b c"]

    def brute(text):
        w = text.split()
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        return len({k + j for s in at.values() if len(s) > 1 for k in s for j in range(8)})

    got = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(got)] == [brute(t) for t in texts]


# Mixing.
def test_water_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0)]
    frame = spark.createDataFrame([(False, s, n) for s, n in sizes], "is_null boolean, source string, source_size long").repartition(3)
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    weight, total = {"a": 3, "b": 1, "c": 2, "d": 3}, 1.5 * 1510
    want, stopped = {}, set()
    while True:
        left = total - sum(2.0 * n for s, n in sizes if s in stopped)
        free = sum(weight[s] for s, _ in sizes if s not in stopped)
        want = {s: 2.0 * n if s in stopped else left * weight[s] / free for s, n in sizes}
        over = {s for s, n in sizes if want[s] > 2 * n}
        if not over:
            break
        stopped |= over
    assert got == pytest.approx(want)


def test_one_id_for_all(spark):
    frame = spark.createDataFrame([(None, "a", " ".join(["w"] * 40 + [f"x{k}"])) for k in range(1500)], "doc_id long, source string, text string")
    mixed = mixing.mix_documents(frame, rows_per_cell=64).toPandas()
    assert mixed.taken.sum() == pytest.approx(1.5 * 1500 * 41, rel=0.01) and set(mixed.copies) == {1, 2}


def test_rows_that_repeat_are_cut_once_more(spark):
    rows = [(7, "a", "same words here")] * 4000 + [(k, "a", " ".join(["w"] * (k % 40))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix_documents(frame, rows_per_cell=64).toPandas()
    assert len(mixed) == 4400 and mixed.taken.sum() == pytest.approx(1.5 * mixed["size"].sum(), rel=0.01)
    assert (mixed[mixed.doc_id == 7].copies - 1.5).abs().max() == 0.5


def test_joins_by_shuffle_give_the_same_mix(docs, monkeypatch):
    broadcast = mixing.mix_documents(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(mixing, "small", lambda df: None)
    monkeypatch.setattr("arborium.skew.HOT_ROWS", 10)
    assert mixing.mix_documents(docs).toPandas().sort_values("doc_id").reset_index(drop=True).equals(broadcast)


def test_mix_is_near_and_stable(docs):
    a, b = (mixing.mix_documents(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and (a.taken <= 2 * a["size"]).all()
    assert a.taken.sum() == pytest.approx(1.5 * a["size"].sum(), rel=0.1)


# Toxicity.
def test_folding():
    assert [toxicity.fold(w.encode()) for w in ("1d!0t!!", "іdіоt", "moron$$$", "tr@sh.", "Stüpid,", "i.d.i.o.t")] == ["idiot", "idiot", "moron", "trash", "stupid", "idiot"]


def test_matches_and_exceptions():
    a = toxicity.Model({"trash": 3.0, "idiot": 2.0}).automaton()
    weigh = lambda t: toxicity.weigh(a, t.encode()) * (1 + math.log1p(len(t.split()) / toxicity.LENGTH))
    assert [round(weigh(t), 6) for t in ("put it in the trash can now", "you trash", "an idiot idiot tr4sh", "trashy idiots", "trash can trash")] == [0, 3, 7, 0, 3]


def test_nested_exceptions():
    phrases = tuple(f"{w} trash" for w in "abcdefg") + ("trash a", "a trash b trash c trash")
    a = toxicity.Model({"trash": 3.0}, exceptions=phrases).automaton()
    assert toxicity.weigh(a, b"a trash b trash c trash d trash e trash f trash g trash") == 0
    assert toxicity.weigh(a, b"z trash") > 0


def test_phrases_are_learned(spark):
    words = [f"w{k}" for k in range(400)]
    text = lambda d, *extra: " ".join([*(words[(7 * d + 3 * j) % 400] for j in range(12)), *extra])
    rows = [(d, text(d, "you", f"x{d}x", "blorg"), 1) for d in range(60)] + [(d, text(d, "a", "blorg", "plant", "grows"), 0) for d in range(100, 115)] + [(d, text(d), 0) for d in range(200, 600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(toxicity.labelled_rows(docs, labels))
    assert "blorg" in model.weights and "blorg plant" in model.exceptions and "you blorg" not in model.exceptions
    automaton = model.automaton()
    assert toxicity.weigh(automaton, b"the blorg plant") == 0 < toxicity.weigh(automaton, b"the blorg")


def test_toxicity_against_brute_force(spark, docs, texts):
    """Counts, weights, fit and scores, made again with lists and dictionaries."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    copy = {r.doc_id: r.copy for r in docs.select("doc_id", toxicity.copy_key(docs.text).alias("copy")).collect()}
    folded = {d: [toxicity.fold(w) for w in t.encode().split()] for d, t in texts.items()}
    first = {}
    for d in sorted(texts):
        if labels.get(d) is not None and not held(d):
            first.setdefault((copy[d], labels[d]), d)
    train = [(d, labels[d]) for d in first.values()]
    sizes = [sum(t == k for _, t in train) for k in (0, 1)]

    def log_odds(found):
        n = collections.defaultdict(lambda: [0, 0])
        for d, t in train:
            for w in set(found(folded[d])):
                n[w][t] += 1
        return {w: (o, t, math.log((t + 0.5) / (sizes[1] + 1)) - math.log((o + 0.5) / (sizes[0] + 1)), 1.64 * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))) for w, (o, t) in n.items()}

    weights = {w: v for w, (_, t, v, e) in log_odds(lambda ws: [w for w in ws if len(w) > 2]).items() if t >= 4 and v - e >= 1}
    pairs = log_odds(lambda ws: [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if a and b and (a in weights or b in weights)])
    harmless = {tuple(p.split()) for p, (o, t, _, e) in pairs.items() if o >= 4 and math.log((o + 0.5) / (t + 0.5)) - e > 0} | {tuple(p.split()) for p in toxicity.EXCEPTIONS}

    def value(words):
        total = sum(weights[w] for k, w in enumerate(words) if w in weights and not (tuple(words[k : k + 2]) in harmless or (k and tuple(words[k - 1 : k + 1]) in harmless)))
        return total / (1 + math.log1p(len(words) / toxicity.LENGTH))

    bias, slope = toxicity.logistic_fit(np.array([value(folded[d]) for d, _ in train]), np.array([float(t) for _, t in train]))
    for r in queries.op7_toxicity(spark, SF).collect():
        want = 1 / (1 + math.exp(-bias - slope * value(folded[r.doc_id])))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == (want >= 0.3) and r.held_out == held(r.doc_id)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.85 and hit / (got.predicted == 1).sum() > 0.9


# Language model.
def brute_lattice(pieces, word):
    word = lattice_lm.MARK + word
    a = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [a[i] + pieces[word[i:j]] for i in range(j) if word[i:j] in pieces]
        if word[j - 1] not in pieces:
            ways.append(a[j - 1] + len(word[j - 1].encode()) * math.log(lattice_lm.BYTES_MASS / 256))
        a[j] = float(np.logaddexp.reduce(ways)) if ways else -math.inf
    return a[-1]


def test_lattice_sums_all_segmentations():
    pieces, logs = lattice_lm.vocabulary()
    words = ["the", "thntionth", "ciónasiell", "a", "鿿x", "", "hello,world", "réeuxç", "x" * 40, "internationaldistributionprofessional"]
    got = lattice_lm.Lattice(pieces, logs).score(words)
    assert np.isfinite(got).all()
    assert got == pytest.approx([brute_lattice(dict(zip(pieces, logs, strict=True)), w) for w in words], rel=1e-9)


def test_strides_change_nothing(monkeypatch):
    pieces, logs = lattice_lm.vocabulary()
    model, words = lattice_lm.Lattice(pieces, logs), ["internationaldistribution" * 9, "x" * 225]
    marked = [lattice_lm.MARK + w for w in words]
    score, n = model.score(words), model.expect(marked, np.array([1.0, 2.0]))
    monkeypatch.setattr(lattice_lm, "STRIDE", 7)
    assert model.score(words) == pytest.approx(score, rel=1e-12) and model.expect(marked, np.array([1.0, 2.0])) == pytest.approx(n)


def test_two_vocabularies_of_one_beginning():
    names = [f"p{k}" for k in range(70)]
    a, b = ([*names, lattice_lm.MARK + c] for c in "ab")
    assert lattice_lm.lattice(a, np.zeros(71)).score(["a"])[0] == 0 and lattice_lm.lattice(b, np.zeros(71)).score(["a"])[0] < 0


def test_scores_against_brute_force(spark):
    """One round of expected counts over all segmentations, then the marginals of all documents."""
    texts = {d: t for d, t in enumerate(["the cat sat", "The internationalisation of cats", "", None, "zq鿿 the", "the the the sat", "a b", "unseen distribution"])}
    words = {d: (t or "").encode().translate(LOWER_BYTES).decode().split() for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    pieces = dict(zip(*lattice_lm.vocabulary(), strict=True))

    def ways(word):
        """(arcs, log) of all segmentations, by their ends."""
        at = {0: [((), 0.0)]}
        for j in range(1, len(word) + 1):
            at[j] = [((*arcs, word[i:j]), log + pieces[word[i:j]]) for i in range(j) if word[i:j] in pieces for arcs, log in at[i]]
            if word[j - 1] not in pieces:
                at[j] += [(arcs, log + len(word[j - 1].encode()) * math.log(lattice_lm.BYTES_MASS / 256)) for arcs, log in at[j - 1]]
        return at[len(word)]

    n = dict.fromkeys(pieces, lattice_lm.PSEUDO)
    for word, often in collections.Counter(w for d in train for w in words[d]).items():
        found = ways(lattice_lm.MARK + word)
        whole = float(np.logaddexp.reduce([log for _, log in found]))
        for arcs, log in found:
            for piece in arcs:
                n[piece] += often * math.exp(log - whole)
    total = sum(n.values())
    end = (len(train) + 0.5) / (total + len(train) + 1)
    pieces = {p: math.log(c / total) + math.log1p(-lattice_lm.BYTES_MASS) + math.log1p(-end) for p, c in n.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lattice_lm.score_documents(frame, rounds=1).collect():
        want = sum(float(np.logaddexp.reduce([log for _, log in ways(lattice_lm.MARK + w)])) for w in words[r.doc_id]) + math.log(end)
        assert r.score == pytest.approx(want / math.log(10), rel=1e-9)


def test_expected_counts():
    pieces, logs = ["▁a", "b", "ab", "▁ab"], np.log([0.2, 0.3, 0.1, 0.4])
    n = lattice_lm.Lattice(pieces, logs).expect(["▁ab"], np.array([2.0]))
    total = 0.2 * 0.3 + 0.4
    assert n == pytest.approx([2 * 0.06 / total, 2 * 0.06 / total, 0, 2 * 0.4 / total])


@pytest.mark.parametrize("head", [0, 500, 10**6])
def test_base_scores(docs, texts, head):
    words = {d: t.encode().translate(LOWER_BYTES).split() + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = collections.Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lattice_lm.score_documents(docs, rounds=1, head=head).collect():
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


# Near duplicates.
def sets(texts):
    out = {}
    for d, t in texts.items():
        w = t.encode().translate(LOWER_BYTES).split()
        out[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(found):
    parent = {d: d for d in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(found, 2):
        both = len(found[a] & found[b])
        if both and 100 * both >= 85 * (len(found[a]) + len(found[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in found}


def near_copies(spark, n=160):
    """One text with a few words changed here and there: pairs on both sides of the threshold, in several blocks."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"v{rng.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def test_components(docs, texts):
    found = sets(texts)
    want = brute_components(found)
    for r in neardup.classify(docs).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(found[r.doc_id]), want[r.doc_id] == r.doc_id)


def test_group_of_near_copies(spark):
    frame, texts = near_copies(spark)
    want = brute_components(sets(texts))
    assert {r.doc_id: r.component_id for r in neardup.classify(frame).collect()} == want
    assert {r.doc_id for r in neardup.one_of_each_stage(frame).collect()} == set(want.values())


def test_buckets_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    frame, texts = near_copies(spark)
    want = brute_components(sets(texts))
    assert {r.doc_id: r.component_id for r in neardup.classify(frame).collect()} == want


def test_odd_sketches_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.8, 0.9, 0.95):
        for _ in range(30):
            common, own = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64), [rng.integers(0, 1 << 63, int(400 * (1 - share) / 2), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, o])) for o in own)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (np.frombuffer(neardup.odd_sketch(neardup.samples(s)), np.uint64) for s in (a, b))
            errors.append(float(neardup.estimated(np.bitwise_count(x ^ y).sum())) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
