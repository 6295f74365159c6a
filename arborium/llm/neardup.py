"""Near-duplicate documents by MinHash and odd sketches, with links confirmed on full sets.

1. One pass over the texts. A document's set holds its distinct 5-word shingles, as 64-bit hashes. Its MinHash
   samples give keys of some samples each (Likeness.bands, rows), and are folded into an odd sketch: a bitmap
   in which each (sample number, value) flips one bit. Equal word sequences are one class from here on.
2. Classes that share a band key form a bucket. Each is held against the bucket's smallest class: by the similarity
   that the XOR of their odd sketches gives, which needs ids and sketches only, and where that passes on the full sets.
   The confirmed links' components are the first groups; in most buckets all classes are then in one group.
3. In a bucket that isn't whole, the classes outside the group of its anchor are held against each other and against the
   anchor's group, in units of at most two blocks of BLOCK classes, each pair in the first band that it shares: by
   sketches first, and those classes that pass with another come again with their sets and are confirmed. A unit
   yields at most one link a class.
4. The confirmed links' components are the result: every pair that shares a band is in one group, or screened out, or refuted.

Rows made: a class for each of its buckets, a pair for each class and anchor, and in open buckets a class for each unit
of it. A bucket of n classes, m of them outside its anchor's group, sends about 2 n + m * n / BLOCK rows: quadratic only
where a bucket beyond BLOCK holds texts that share samples and still aren't linked with each other. Keys with many
rows (band keys, group centres, ids, texts) are split.

The similarity is a parameter, 0.85 unless given. A pair right at it is missed by the bands with a chance of at most
MISS (1.2e-5 at 0.85, 1.5e-5 at 0.80), and by the sketch screen, which lies five standard deviations lower, with less.

Defined results: no words means an empty set, linked with nothing; a null id takes no part (it is its own
component, null, and kept); rows that repeat an id and a text are in one component, all of them kept; texts that share an
id are documents of their own, linked by their sets alone;
an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import hot_keys, hot_of, join_spread
from .common import LOWER_BYTES, fresh, keep_only, let, remove, utf8, written

SHINGLE = 5
#: Linked: 100 * intersection >= percent * union; this percentage unless given.
PERCENT = 85
SAMPLES = 144
SKETCH_BITS = 1024
#: Chance at most that the bands miss a pair right at the similarity.
MISS = 2e-5
#: Five standard deviations of an odd sketch's estimate, as a multiple of sqrt(s (1 - s)).
DEVIATIONS = 0.476
#: Classes in a block of a bucket, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Pairs with one first class that are confirmed in one unit, or the PAIR_PARTS-th part of all pairs if that is more.
PAIR_ROWS, PAIR_PARTS = 64, 4096
#: Shingles hashed at a time, and words and texts whose hashes a worker keeps.
SLICE, KEPT_WORDS, KEPT_TEXTS = 4096, 400_000, 512

_random = np.random.default_rng(20_240_229)
MULTIPLIERS = (_random.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
SHIFTS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


HASHES = WordHashes()


def keep_words() -> None:
    keep_only(HASHES)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_BYTES).split()


def sequence_hash(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = mixed(out * MIX + h[k : k + count] * PLACES[k])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), SLICE):
        np.minimum(best, (low[k : k + SLICE] * MULTIPLIERS + SHIFTS).min(1), out=best)
    return best


class Likeness:
    """What follows from the percentage that links: bands, samples in a band, most differing bits that pass the screen."""

    def __init__(self, percent: int = PERCENT):
        self.percent, s = percent, percent / 100
        fit = [r for r in range(1, SAMPLES + 1) if (1 - s**r) ** (SAMPLES // r) <= MISS]
        if not fit or percent > 100:
            raise ValueError(f"no bands of {SAMPLES} samples find pairs at {percent} percent")
        self.rows = max(fit)
        self.bands = SAMPLES // self.rows
        screen = s - DEVIATIONS * math.sqrt(s * (1 - s))
        self.most_bits = int(SKETCH_BITS / 2 * (1 - math.exp((screen - 1) * 4 * SAMPLES / SKETCH_BITS)))


def band_keys(minima: np.ndarray, bands: int, width: int) -> np.ndarray:
    rows = minima[: bands * width].reshape(bands, width).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * MIX + rows[:, k])
    return out.view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Bitmap, as 64-bit numbers, in which each (number, sample) flips one bit."""
    at = mixed(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def estimated(differing: np.ndarray) -> np.ndarray:
    """Similarity by the number of bits in which two odd sketches differ."""
    odd = np.minimum(2.0 * differing / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - odd)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, sequence, n_shingles, bands, sketch of each document; sequence null without words."""
    like = Likeness(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words()
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                if not words:
                    rows.append((None, 0, None, None))
                    continue
                key = sequence_hash(words)
                if key not in seen:
                    found = shingles(words)
                    minima = samples(found)
                    if len(seen) >= KEPT_TEXTS:
                        seen.clear()
                    seen[key] = (key, len(found), band_keys(minima, like.bands, like.rows), odd_sketch(minima))
                rows.append(seen[key])
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "text_key", "sequence", "n_shingles", "bands", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("doc_id", "text").alias("text_key"))
    return narrow.mapInArrow(sign, "doc_id long, text_key binary, sequence binary, n_shingles long, bands array<long>, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v); the component is its smallest node.

    Alternates large and small stars: neighbours are tied to the smallest node around, until nothing changes. A node
    with very many neighbours is split among tasks.
    """
    current = written(edges.selectExpr("greatest(u, v) as u", "least(u, v) as v").filter("u <> v").distinct(), "edges")
    before, total = None, current.count()
    while True:
        both = current.unionByName(current.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = join_spread(both.filter("v > u"), least, "u", hot=hot_keys(both.filter("v > u"), "u", total)).selectExpr("v as u", "m as v").distinct()
        middle = written(large, "edges")
        smallest = middle.groupBy("u").agg(F.min("v").alias("m"))
        tied = join_spread(middle, smallest, "u", hot=hot_keys(middle, "u", total))
        small = tied.selectExpr("v as u", "m as v").filter("u <> v").unionByName(smallest.selectExpr("u", "m as v")).distinct()
        after = written(small, "edges")
        remove(current)
        remove(middle)
        current = after
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    stars = current.selectExpr("u as node", "v as component")
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, band, first, n): a row for each class and each of its band keys that others share; first is the bucket's smallest."""
    keyed = classes.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    total = shared.agg(F.sum("n")).first()[0] or 0
    return written(join_spread(keyed, shared, "key", hot=hot_of(shared.select("key", "n"), total)), "bucket-members")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, found): the sets of the classes in wanted (doc_id, first_id, sequence), once each."""
    texts = join_spread(docs.selectExpr("cast(doc_id as long) as first_id", "text").filter("first_id is not null"), wanted, "first_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words()
        for batch in batches:
            at, found = [], []
            for k, (text, sequence) in enumerate(zip(utf8(batch.column("text")), batch.column("sequence").to_pylist(), strict=True)):
                words = words_of(text)
                if words and sequence_hash(words) == sequence:
                    at.append(k)
                    found.append(shingles(words).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["doc_id", "found"])

    return texts.select("doc_id", "text", "sequence").mapInArrow(sets, "doc_id long, found binary").dropDuplicates(["doc_id"])


def close(na: str, nb: str, sa: str, sb: str, like: Likeness) -> Column:
    """May two classes be linked, by their set sizes and odd sketches?"""
    differing = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return (100 * F.least(na, nb) >= like.percent * F.greatest(na, nb)) & (differing <= like.most_bits)


def leader_pairs(members: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): each class with the smallest of each of its buckets, where sizes and sketches allow a link."""
    pairs = written(members.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "leader-pairs")
    of = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return join_spread(pairs.join(of("b"), "b"), of("a"), "a", hot=hot_of(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), pairs.count())).filter(close("na", "nb", "sa", "sb", like)).select("a", "b")


def unlinked_members(members: DataFrame, groups: DataFrame) -> DataFrame | None:
    """(key, doc_id, band, leads, component, inside, others, held): the members of buckets that hold several groups; None if no bucket does.

    inside tells the group of the anchor, the smallest class of the bucket's largest group; others and held are the
    blocks into which the bucket's members outside and inside it are cut, by their number and by the bytes of their sets.
    """
    known = groups.select(F.col("node").alias("doc_id"), "component")
    placed = written(members.filter("n > 2").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    sized = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"), (8 * F.sum("n_shingles")).alias("bytes"))
    largest = F.max_by(F.struct("component", "held", "bytes"), F.struct("held", -F.col("component"))).alias("largest")
    parted = sized.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("held").alias("n"), F.sum("bytes").alias("bytes"), largest).filter("groups > 1")
    cut = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    inner, size = F.col("largest.held"), F.col("largest.bytes")
    buckets = written(parted.select("key", "n", F.col("largest.component").alias("anchor"), cut(F.col("n") - inner, F.col("bytes") - size).alias("others"), cut(inner, size).alias("held")), "open-buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    joined = join_spread(placed.drop("n"), buckets, "key", hot=hot_of(buckets.select("key", "n"), total))
    return joined.select("key", "doc_id", "band", (F.col("doc_id") == F.col("first")).alias("leads"), "component", (F.col("component") == F.col("anchor")).alias("inside"), "others", "held")


def units(members: DataFrame) -> DataFrame:
    """members for each unit (key, i, j) that they belong to, with side 0 or 1.

    Members outside the anchor's group are cut into blocks i; a unit holds two of these blocks, or one of them and a block of
    the anchor's group.
    """
    many = F.col
    block = lambda blocks: F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    outside = let(block(many("others")), lambda p: F.concat(F.transform(upto(many("others")), lambda q: place(F.least(p, q), F.greatest(p, q), p > q)), F.transform(upto(many("held")), lambda r: place(p, many("others") + r, F.lit(0)))))
    inside = let(block(many("held")), lambda r: F.transform(upto(many("others")), lambda p: place(p, many("others") + r, F.lit(1))))
    at = F.explode(F.when(F.col("inside"), inside).otherwise(outside)).alias("at")
    return members.select("key", "band", "doc_id", "leads", "component", at).select("key", "at.i", "at.j", "at.side", "band", "doc_id", "leads", "component")


UNIT = ["key", "i", "j"]
MEMBER = ["side", "band", "doc_id", "leads", "component", "n_shingles", "sketch", "bands"]


def by_unit(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """(unit, its rows as lists by column) of batches sorted by unit."""
    unit, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*UNIT, *columns)), strict=True):
            if row[:3] != unit:
                if held:
                    yield unit, list(map(list, zip(*held, strict=True)))
                unit, held = row[:3], []
            held.append(row[3:])
    if held:
        yield unit, list(map(list, zip(*held, strict=True)))


def partners(columns: list[list], like: Likeness) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a unit's pairs in different groups that share no earlier band and pass the screen; a bucket's leader has met all."""
    side, band, leads, groups, size = (np.array(columns[k]) for k in (0, 1, 3, 4, 5))
    bits, bands = np.array(columns[6], np.int64).view(np.uint64), np.array(columns[7], np.int64)
    two = bool(side.any())
    for a in np.flatnonzero((side == 0) & ~leads):
        may = (groups != groups[a]) & ~leads & ((side == 1) if two else (np.arange(len(side)) > a))
        may &= 100 * np.minimum(size, size[a]) >= like.percent * np.maximum(size, size[a])
        rest = np.flatnonzero(may)
        rest = rest[np.bitwise_count(bits[rest] ^ bits[a]).sum(1, dtype=np.int64) <= like.most_bits]
        rest = rest[(bands[rest] == bands[a]).argmax(1) == band[a]]
        if len(rest):
            yield int(a), rest


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "doc_id")


def possible(rows: DataFrame, like: Likeness) -> DataFrame:
    """The rows (key, i, j, doc_id) of units that have a partner by sizes and sketches."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, columns in by_unit(batches, MEMBER):
            found = sorted({k for a, rest in partners(columns, like) for k in (a, *rest.tolist())})
            if found:
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(found), t) for v, t in zip(unit, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array([columns[2][k] for k in found], pa.int64())], names=[*UNIT, "doc_id"])

    return dealt(rows).mapInArrow(look, "key long, i int, j int, doc_id long")


def links_in(rows: DataFrame, like: Likeness) -> DataFrame:
    """Edges (u, v) that connect what is linked in each unit, confirmed on full sets; pairs connected already need no look."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in by_unit(batches, [*MEMBER, "found"]):
            ids, found = columns[2], [np.frombuffer(f, np.uint64) for f in columns[8]]
            parent = {g: g for g in columns[4]}
            out = []

            def root(g: int) -> int:
                while parent[g] != g:  # noqa: B023
                    parent[g] = parent[parent[g]]  # noqa: B023
                    g = parent[g]  # noqa: B023
                return g

            for a, rest in partners(columns, like):
                for b in rest.tolist():
                    x, y = root(columns[4][a]), root(columns[4][b])
                    if x != y and similar(found[a], found[b], like.percent):
                        parent[max(x, y)] = min(x, y)
                        out.append((ids[a], ids[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return dealt(rows).mapInArrow(link, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Is 100 * intersection >= percent * union, for sorted distinct arrays?"""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v): the pairs (a, b), a table, that are similar on full sets.

    A unit holds one class, whose set is kept, and some of its partners, which pass one by one.
    """
    parts = max(1, pairs.count() // PAIR_PARTS, PAIR_ROWS)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    firsts = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("doc_id"), "found")
    seconds = join_spread(dealt, sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", F.lit(1).alias("side"), F.col("b").alias("doc_id"), "found")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, None
        for batch in batches:
            out = []
            for a, part, side, doc, found in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "side", "doc_id", "found")), strict=True):
                here = np.frombuffer(found, np.uint64)
                if not side:
                    unit, held = (a, part), here
                elif (a, part) == unit and similar(held, here, percent):
                    out.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    rows = firsts.unionByName(seconds).repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc_id")
    return rows.mapInArrow(confirm, "u long, v long")


def linked_groups(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of those classes (doc_id, a number of the class; first_id, sequence and others) that are linked with another."""
    like = Likeness(percent)
    members = bucket_members(classes)
    sketches = written(classes.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    sets = written(shingle_sets(docs, sketches.select("doc_id", "first_id", "sequence")), "shingle-sets")
    links = written(confirmed(written(leader_pairs(members, sketches, like), "screened"), sets, percent), "links")
    groups = components(links)
    several = unlinked_members(members, groups)
    if several is None:
        return groups
    apart = units(several).join(sketches.select("doc_id", "n_shingles", "sketch", "bands"), "doc_id")
    apart = written(apart.select(*UNIT, *MEMBER), "units")
    kept = written(possible(apart, like), "possible")
    if not kept.head(1):
        return groups
    more = links_in(apart.join(kept, [*UNIT, "doc_id"]).join(sets, "doc_id").select(*UNIT, *MEMBER, "found"), like)
    return components(links.unionByName(more))


def text_key(doc_id: str, text: str) -> Column:
    """128 bits of id and text; null without an id or a word."""
    alike = F.col(doc_id).isNotNull() & F.rlike(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))
    return F.when(alike, F.unhex(F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)))))


def grouped(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two tables: signatures() of the documents, and (sequence, component, component_id) of each class.

    component is a number of its own: different components may have the same smallest id, where texts share an id.
    """
    signed = written(signatures(docs, percent), "signatures")
    known = signed.filter("sequence is not null and doc_id is not null")
    first = known.groupBy("sequence").agg(F.min_by(F.struct(F.col("doc_id").alias("first_id"), "n_shingles", "bands", "sketch"), "doc_id").alias("c"))
    classes = written(first.select("sequence", "c.*", F.monotonically_increasing_id().alias("doc_id")), "classes")
    groups = linked_groups(docs, classes, percent)
    found = classes.select("sequence", "doc_id", "first_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = written(found.select("sequence", "first_id", F.coalesce("component", "doc_id").alias("component")), "class-groups")
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return signed, written(join_spread(placed.select("sequence", "component"), least, "component"), "components")


def classify(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    signed, of = grouped(docs, percent)
    known = signed.filter("sequence is not null and doc_id is not null")
    rows = join_spread(known.select("doc_id", "sequence", "n_shingles"), of.select("sequence", "component_id"), "sequence").select("doc_id", "n_shingles", "component_id")
    others = signed.filter("sequence is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(others).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_stage(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each component: of its smallest id, and of that id's texts the one with the least key.

    Documents without words or id stay. Rows that repeat an id and a text are one document; an id's other texts are others.
    """
    signed, of = grouped(docs, percent)
    own = signed.filter("text_key is not null").groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.first("sequence").alias("sequence"), F.first("doc_id").alias("doc_id"))
    may = join_spread(own, of.select("sequence", "component"), "sequence")
    best = may.groupBy("component").agg(F.min_by(F.struct("text_key", "n"), F.struct("doc_id", "text_key")).alias("best"))
    key, n = fresh(docs, "dup_key", "dup_rows")
    stay = written(best.select(F.col("best.text_key").alias(key), F.col("best.n").alias(n)), "copies-kept")
    hot = hot_of(stay.select(key, F.col(n).alias("n")), stay.agg(F.sum(n)).first()[0] or 0)
    keyed = docs.withColumn(key, text_key("doc_id", "text"))
    met = join_spread(keyed.filter(F.col(key).isNotNull()), stay, key, hot=hot)
    out = keyed.filter(F.col(key).isNull()).select(*docs.columns)
    if not stay.filter(F.col(n) > 1).head(1):
        return out.unionByName(met.select(*docs.columns))
    out = out.unionByName(met.filter(F.col(n) == 1).select(*docs.columns))
    return out.unionByName(met.filter(F.col(n) > 1).dropDuplicates([key]).select(*docs.columns))
